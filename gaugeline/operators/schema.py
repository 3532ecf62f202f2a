"""Positional schemas: their JSON form, and their inference from profiles.

A schema is a list of ``SchemaField``; position is the field's index.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from gaugeline.functions import fields as f

VERSION = "v1"
MATCH_RATIO = 0.95
SPARK_TYPES = {"text-field": T.StringType(), "boolean-field": T.BooleanType(), "integral-field": T.LongType(), "real-field": T.DoubleType()}


class SchemaError(ValueError):
    pass


class InferenceError(ValueError):
    pass


@dataclass(frozen=True)
class SchemaField:
    """Type, and the number of categories; None for a free form."""

    type: str
    uniques: int | None = None


def render_schema(schema: list[SchemaField]) -> str:
    fields = [{"field-type": x.type, "field-form": {"form-type": "freeform"} if x.uniques is None else {"form-type": "categorical", "uniques": x.uniques}} for x in schema]
    return json.dumps({"version": VERSION, "fields": fields}, indent=4) + "\n"


def parse_schema(text: str) -> list[SchemaField]:
    try:
        data = json.loads(text)
        if data["version"] != VERSION:
            raise SchemaError(f"unknown schema version {data['version']!r}")
        out = []
        for i, x in enumerate(data["fields"]):
            form = x["field-form"]
            if x["field-type"] not in f.TYPES:
                raise SchemaError(f"field {i}: unknown type {x['field-type']!r}")
            if form["form-type"] not in ("freeform", "categorical"):
                raise SchemaError(f"field {i}: unknown form {form['form-type']!r}")
            uniques = form["uniques"] if form["form-type"] == "categorical" else None
            if uniques is not None and (not isinstance(uniques, int) or isinstance(uniques, bool)):
                raise SchemaError(f"field {i}: uniques is not a whole number")
            out.append(SchemaField(x["field-type"], uniques))
    except (json.JSONDecodeError, KeyError, TypeError) as e:
        raise SchemaError(f"not a schema: {e}") from e
    return out


def schema_frame(spark: SparkSession, schema: list[SchemaField]) -> DataFrame:
    return spark.createDataFrame([(i, x.type, x.uniques) for i, x in enumerate(schema)], "pos int, field_type string, uniques bigint")


def struct_type(schema: list[SchemaField], names: list[str] | None = None) -> T.StructType:
    """The schema as Spark types, for readers."""
    return T.StructType([T.StructField(names[i] if names else f"field_{i}", SPARK_TYPES[x.type]) for i, x in enumerate(schema)])


def compatible_counts(looks: dict[str, Column]) -> dict[str, Column]:
    """Entries compatible with each type, from the counters of looks by short name (empty, integral, ...)."""
    return {t: sum((looks[x.removeprefix("looks-")] for x in s[1:]), looks[s[0].removeprefix("looks-")]) for t, s in f.INCLUDES.items()}


def histogram(profile: DataFrame) -> DataFrame:
    """(pos, one column a type): how many entries of a field are compatible with each type."""
    counts = compatible_counts({x.removeprefix("looks-"): F.col(x.removeprefix("looks-")) for x in f.LOOKS})
    return profile.select("pos", *[c.cast("bigint").alias(t.removesuffix("-field")) for t, c in counts.items()])


def normalised(hist: DataFrame, total: Column) -> DataFrame:
    """The histogram over the number of rows, bad ones included."""
    return hist.select("pos", *[(F.col(t.removesuffix("-field")) / total).alias(t.removesuffix("-field")) for t in f.TYPES])


def inferred_type(ratio: float = MATCH_RATIO) -> Column:
    """The least type that at least this share of entries is compatible with; text where several are least; null if none."""
    fits = {t: F.col(t) >= ratio for t in ("text", "boolean", "integral", "real")}
    return (
        F.when(fits["boolean"] & fits["real"], F.lit("text-field"))
        .when(fits["integral"], F.lit("integral-field"))
        .when(fits["real"], F.lit("real-field"))
        .when(fits["boolean"], F.lit("boolean-field"))
        .when(fits["text"], F.lit("text-field"))
    )


def candidates(ratio: float = MATCH_RATIO) -> Column:
    """All types that at least this share of entries is compatible with."""
    return F.filter(F.array(*[F.when(F.col(t.removesuffix("-field")) >= ratio, F.lit(t)) for t in f.TYPES]), lambda x: x.isNotNull())


def minima(types: Column) -> Column:
    """The members of an array of types that no other member is below."""
    return F.filter(types, lambda t: ~F.exists(types, lambda u: (u != t) & f.type_at_most(u, t)))


def check_counts(hist: DataFrame, total: int) -> None:
    """No rows, or a field with more compatible entries than there are rows, is an error."""
    if total == 0:
        raise InferenceError("no rows")
    short = [t.removesuffix("-field") for t in f.TYPES]
    over = [r["pos"] for r in hist.where(F.greatest(*short) > total).select("pos").orderBy("pos").collect()]  # one row a field
    if over:
        raise InferenceError(f"fields {over} have more compatible entries than the {total} rows")


def check_forms(forms: DataFrame) -> None:
    """A categorical field without a single value is an error."""
    none = [r["pos"] for r in forms.where("form = 'unique-text-count' and uniques = 0").select("pos").orderBy("pos").collect()]  # one row a field
    if none:
        raise InferenceError(f"no text counts for fields {none}")


def infer(profile: DataFrame, forms: DataFrame, total: int, threshold: int, ratio: float = MATCH_RATIO) -> DataFrame:
    """(pos, field_type, uniques) of a profile with look counters and its forms (pos, form, uniques)."""
    if total < threshold:
        raise InferenceError(f"{total} rows are too few to tell forms with a threshold of {threshold}")
    typed = normalised(histogram(profile), F.lit(total)).select("pos", inferred_type(ratio).alias("field_type"))
    return typed.join(F.broadcast(forms.select("pos", "uniques")), "pos").select("pos", "field_type", "uniques")


def collect_schema(inferred: DataFrame) -> list[SchemaField]:
    """The inferred rows as a schema; one row a field reaches the driver."""
    rows = inferred.orderBy("pos").collect()
    if not rows:
        raise InferenceError("no field counts")
    none = [r["pos"] for r in rows if r["field_type"] is None]
    if none:
        raise InferenceError(f"no type fits fields {none}: too many rows are bad or differ")
    return [SchemaField(r["field_type"], r["uniques"]) for r in rows]
