"""Predicates and values of one text field, as Column expressions over built-in functions.

Every pattern is anchored on the whole field.  Patterns are plain regular expressions that other engines read too.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# The patterns that say what a field looks like and what may be personal data.
BOOLEAN = r"\A(?i:true|false|t|f)\z"
INTEGRAL = r"\A[+-]?[0-9]+\z"
REAL = r"\A[+-]?[0-9]+(?:\.[0-9]*(?:e[+-]?[0-9]+)?|e[+-]?[0-9]+)\z"
DATE = r"\A20[0-9]{2}(?:[-/.][0-9]{2}[-/.][0-9]{2}|[0-9]{4})"
EMAIL = r"\A[^@][^()@]*@[^@ .]*\.[^@]{2,}\z"
PHONE = r"\A(?:\+[ .-]*(?:[0-9][ .-]*){11}|0[23478][ .-]*(?:[0-9][ .-]*){8})\z"
ADDRESS = r"\A[0-9][0-9/]* [a-z]+ (?:st|rd|road|lane|ln|cres|ave)"
CARD = r"\A[0-9 .-]+\z"
CARD_DIGITS = r"\A[0-9]{12,}\z"
CARD_FILLER = r"[ .-]"

# Names in markers and schemas, in order of rank.
LOOKS = ("looks-empty", "looks-integral", "looks-real", "looks-text", "looks-boolean")
TYPES = ("text-field", "boolean-field", "integral-field", "real-field")
#: Which looks a type takes in.
INCLUDES = {
    "text-field": LOOKS,
    "boolean-field": ("looks-boolean", "looks-empty"),
    "integral-field": ("looks-integral", "looks-empty"),
    "real-field": ("looks-real", "looks-integral", "looks-empty"),
}
PII_NAMES = {"phone": "phone number", "email": "email address", "credit-card": "credit card", "address": "address"}


def is_boolean(v: Column) -> Column:
    return v.rlike(BOOLEAN)


def _may_be_number(v: Column) -> Column:
    """A look at the first character, which spares most text the patterns."""
    return F.substring(v, 1, 1).isin(*"0123456789+-")


def numeric_kind(v: Column) -> Column:
    """'integral', 'real' or null.  No digit before the radix point, or a capital exponent, is no number."""
    may = _may_be_number(v)
    return F.when(may & v.rlike(INTEGRAL), F.lit("integral")).when(may & v.rlike(REAL), F.lit("real"))


def numeric_value(v: Column) -> Column:
    """The number of a field that looks numeric, as a double; null for anything else ('NaN', '1d' and the like)."""
    return F.when(_may_be_number(v) & (v.rlike(INTEGRAL) | v.rlike(REAL)), v.try_cast("double"))


def is_date(v: Column) -> Column:
    """A date of this century at the start of the field; what follows is free and the calendar isn't consulted."""
    return v.rlike(DATE)


def looks(v: Column) -> Column:
    """What a field looks like; a null counts as empty."""
    may = _may_be_number(v)
    return (
        F.when(v.isNull() | (v == ""), F.lit("looks-empty"))
        .when(may & v.rlike(INTEGRAL), F.lit("looks-integral"))
        .when(may & v.rlike(REAL), F.lit("looks-real"))
        .when((F.octet_length(v) <= 5) & is_boolean(v), F.lit("looks-boolean"))
        .otherwise(F.lit("looks-text"))
    )


def looks_numeric(look: Column) -> Column:
    return look.isin("looks-integral", "looks-real")


def type_includes(field_type: Column, look: Column) -> Column:
    """Whether values of this look belong to a field of this type."""
    return reduce(lambda a, b: a | b, [(field_type == t) & look.isin(*s) for t, s in INCLUDES.items()])


def type_at_most(a: Column, b: Column) -> Column:
    """The partial order of types: text above all, real above integral, boolean below text alone."""
    return (a == b) | (b == "text-field") | ((a == "integral-field") & (b == "real-field"))


def ascii_lower(v: Column) -> Column:
    return F.translate(v, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def text_hash(v: Column) -> Column:
    """64-bit hash of a field, for distinct counts that outlive a run."""
    return F.xxhash64(v)


def is_email(v: Column) -> Column:
    return v.rlike(EMAIL)


def is_phone(v: Column) -> Column:
    return v.rlike(PHONE)


def is_address(v: Column) -> Column:
    return ascii_lower(v).rlike(ADDRESS)


def is_credit_card(v: Column) -> Column:
    """At least twelve digits with fillers that pass the Luhn test."""
    digits = F.regexp_replace(v, CARD_FILLER, "")
    return v.rlike(CARD) & digits.rlike(CARD_DIGITS) & F.call_function("luhn_check", F.when(digits.rlike(CARD_DIGITS), digits).otherwise(F.lit("1")))


def pii_type(v: Column) -> Column:
    """The first kind of personal data that a field may be: phone, email, credit card, address; null if none."""
    return F.when(is_phone(v), F.lit("phone")).when(is_email(v), F.lit("email")).when(is_credit_card(v), F.lit("credit-card")).when(is_address(v), F.lit("address"))
