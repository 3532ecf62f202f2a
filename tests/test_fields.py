"""Predicates and tokenisers against plain Python, on random strings."""

import random
import re

from pyspark.sql import functions as F

from gaugeline.functions import fields as f
from gaugeline.sources import text


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def number_kind(v):
    """Sign, digits, then a point with digits or none, then a small e with digits."""
    i = 1 if v[:1] in ("+", "-") else 0
    digits = lambda s: len(s) > 0 and all("0" <= c <= "9" for c in s)
    rest = v[i:]
    if digits(rest):
        return "integral"
    head, e, power = rest.partition("e")
    if e:
        power = power[1:] if power[:1] in ("+", "-") else power
        if not digits(power):
            return None
    whole, point, part = head.partition(".")
    return "real" if digits(whole) and (not point or not part or digits(part)) and (point or e) else None


def card(v):
    d = re.sub("[ .-]", "", v)
    return all(c in "0123456789 .-" for c in v) and len(d) >= 12 and luhn(d)


def test_predicates(spark):
    rnd = random.Random(1)
    bits = ["t", "f", "TRUE", "false", "+", "-", ".", "e", "E", "1", "20", "2016", "-03-", "04", "@", " ", "(", "x.com", "0412", "345678", "+61", "4111", "1111 ", "12/3", " road", " Fake", "é", "", "\n"]
    values = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 7))) for _ in range(6000)]
    values += ["4111 1111 1111 1111", "000000000000", "12345678901234567890123456789", "1e5", "1.", ".5"]
    v = F.col("v")
    df = spark.createDataFrame([(x,) for x in values], "v string").select("v", f.is_boolean(v).alias("b"), f.numeric_kind(v).alias("k"), f.numeric_value(v).alias("n"), f.is_credit_card(v).alias("c"), f.looks(v).alias("l"), f.is_date(v).alias("d"))
    for r in df.collect():
        x = r["v"]
        boolean = x.lower() in ("t", "f", "true", "false") and x.isascii()
        kind = number_kind(x)
        assert r["b"] == boolean and r["k"] == kind, repr(x)
        assert r["n"] == (float(x) if kind else None)
        assert r["c"] == card(x), repr(x)
        assert r["l"] == ("looks-empty" if not x else "looks-boolean" if boolean else f"looks-{kind}" if kind else "looks-text")


def quoted(line, sep="|"):
    """Field after field: quoted ones toggle, others end at a separator or a quote mark."""
    out, i = [], 0
    while True:
        if line[i : i + 1] == '"':
            j, open_ = i + 1, True
            while j < len(line) and (open_ or line[j] == '"'):
                open_ ^= line[j] == '"'
                j += 1
            x = line[i + 1 : j]
            out.append(x[:-1] if x.endswith('"') else x)
        else:
            j = i
            while j < len(line) and line[j] not in (sep, '"'):
                j += 1
            out.append(line[i:j])
        if line[j : j + 1] != sep:
            return out
        i = j + 1


def test_tokenisers(spark):
    rnd = random.Random(2)
    lines = ["".join(rnd.choice('ab|"|" ,') for _ in range(rnd.randint(0, 14))) for _ in range(6000)]
    df = spark.createDataFrame([(x,) for x in lines], "v string").select("v", text.split_quoted(F.col("v")).alias("q"), text.split_delimited(F.col("v")).alias("d"), text.split_quoted(F.col("v"), ",").alias("c"))
    for r in df.collect():
        assert r["q"] == quoted(r["v"]), r["v"]
        assert r["c"] == quoted(r["v"], ","), r["v"]
        assert r["d"] == r["v"].split("|")
    long = spark.createDataFrame([('"' + "x" * 60000 + '"|' + "y|" * 2000,)], "v string")
    assert long.select(F.size(text.split_quoted(F.col("v")))).first()[0] == 2002


def test_sum_and_order_of_types(spark):
    grid = spark.createDataFrame([(a, b) for a in f.TYPES for b in f.TYPES], "a string, b string")
    rows = {(r["a"], r["b"]): r["le"] for r in grid.select("a", "b", f.type_at_most(F.col("a"), F.col("b")).alias("le")).collect()}
    for a in f.TYPES:
        assert rows[a, a] and rows[a, "text-field"]
        for b in f.TYPES:
            assert not (a != b and rows[a, b] and rows[b, a])
            assert all(rows[a, c] for c in f.TYPES if rows[a, b] and rows[b, c])
            assert not rows[a, b] or set(f.INCLUDES[a]) <= set(f.INCLUDES[b])
