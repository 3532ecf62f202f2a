"""Any DataFrame as rows of positional text fields, so that tables profile as feeds do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from gaugeline.functions.fields import numeric_value

#: Digits after the point of floating-point columns.  Their plain rendering differs between engines; this doesn't.
SCALE = 4


def as_text(df: DataFrame, name: str, scale: int = SCALE) -> Column:
    """A column as text; null is the empty text."""
    kind = df.schema[name].dataType
    c = F.col(f"`{name}`")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        c = c.cast(T.DecimalType(38, scale)).cast("string")
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        c = F.to_json(c)
    else:
        c = c.cast("string")
    return F.coalesce(c, F.lit(""))


def rows_of(df: DataFrame, columns: list[str] | None = None, scale: int = SCALE) -> DataFrame:
    """One array of fields per row, as a reader of text gives it."""
    names = columns or df.columns
    return df.select(F.lit(False).alias("bad"), F.array(*[as_text(df, n, scale) for n in names]).alias("fields"))


def number_cells(df: DataFrame, columns: list[str] | None = None, scale: int = SCALE) -> DataFrame:
    """(pos, num): the numbers that the fields of ``rows_of`` hold, null for any other field.

    Numeric columns aren't rendered as text to be read again: whole numbers stay, floating-point ones are rounded as
    their text is, and moments are never numbers.  Other columns go through their text.
    """
    names = columns or df.columns
    return df.select(F.posexplode(F.array(*[_number(df, n, scale) for n in names])).alias("pos", "num"))


def _number(df: DataFrame, name: str, scale: int) -> Column:
    kind = df.schema[name].dataType
    c = F.col(f"`{name}`")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return c.cast(T.DecimalType(38, scale)).cast("double")
    if isinstance(kind, T.IntegralType):
        return c.cast("double")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.lit(None).cast("double")
    return numeric_value(as_text(df, name, scale))
