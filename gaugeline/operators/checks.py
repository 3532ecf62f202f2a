"""Rules over a profile.  A failure is a row: (ord, check, kind, pos, detail); no row means passed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gaugeline.functions import fields as f

FAILURE = "ord int, check string, kind string, pos int, detail string"
# The words of failures.
SANITY, ROW, SCHEMA, PII = "sanity check failed: ", "row check failed: ", "schema validation failed: ", "potential PII found: "


def _failure(order: int, check: str, kind: str, detail: Column, pos: Column | None = None) -> list[Column]:
    return [F.lit(order).alias("ord"), F.lit(check).alias("check"), F.lit(kind).alias("kind"), (F.lit(None) if pos is None else pos).cast("int").alias("pos"), detail.alias("detail")]


def width_failures(summary: DataFrame, schema: DataFrame) -> DataFrame:
    """The schema's number of fields against the observed one: a single failure in place of any by field."""
    n = schema.agg(F.count("*").alias("n"))
    met = summary.select(F.size("field_counts").alias("widths"), F.get("field_counts", F.lit(0)).alias("seen")).crossJoin(F.broadcast(n))  # one row each
    detail = F.format_string(SCHEMA + "Field count in schema differs from unique field observations. schema count is %d, observed %d", "n", "seen")
    return met.where("seen is not null and n <> seen").select(*_failure(1, "schema-types", "FieldCountObservationMismatch", detail))


def type_failures(profile: DataFrame, schema: DataFrame) -> DataFrame:
    """Fields with entries whose look the schema's type doesn't take in."""
    short = [x.removeprefix("looks-") for x in f.LOOKS]
    looks = F.array(*[F.struct(F.lit(full).alias("look"), F.col(s).cast("bigint").alias("n")) for full, s in zip(f.LOOKS, short, strict=True)])
    met = profile.join(F.broadcast(schema.select("pos", "field_type")), "pos")
    odd = met.withColumn("odd", F.filter(looks, lambda x: (x["n"] > 0) & ~f.type_includes(F.col("field_type"), x["look"])))
    said = F.concat_ws(", ", F.transform("odd", lambda x: F.format_string("%s: %d", x["look"], x["n"])))
    detail = F.concat(F.lit(SCHEMA + "Field characteristics differ from those specified in schema: "), F.format_string("field type (field %d): expected %s, saw %s", "pos", "field_type", said))
    return odd.where(F.size("odd") > 0).select(*_failure(1, "schema-types", "AnomalousType", detail, F.col("pos")))


def form_failures(forms: DataFrame, schema: DataFrame) -> DataFrame:
    """Categorical fields that turned out free or have more values than the schema says; free forms never fail."""
    met = forms.select("pos", "form", F.col("uniques").alias("seen")).join(F.broadcast(schema.where("uniques is not null").select("pos", "uniques")), "pos")
    said = F.when(F.col("form") == "looks-freeform", F.lit("above freeform threshold")).otherwise(F.format_string("%d uniques", "seen"))
    detail = F.concat(F.lit(SCHEMA + "Field characteristics differ from those specified in schema: "), F.format_string("categorical field form (field %d): expected %d, saw %s", F.col("pos"), F.col("uniques"), said))
    return met.where("form = 'looks-freeform' or seen > uniques").select(*_failure(2, "schema-forms", "AnomalousForm", detail, F.col("pos")))


def row_failures(summary: DataFrame) -> DataFrame:
    """Field counts, row count, bad rows.  An empty feed fails for having no rows twice: as a set of widths and as a count."""
    zero = F.lit(ROW + "no rows in xSV document")
    widths = F.array_join(F.transform("field_counts", lambda x: x.cast("string")), ", ")
    parts = [
        summary.where(F.size("field_counts") == 0).select(*_failure(3, "field-counts", "ZeroRows", zero)),
        summary.where(F.size("field_counts") > 1).select(*_failure(3, "field-counts", "FieldCountMismatch", F.concat(F.lit(ROW + "differing field counts: "), widths))),
        summary.where("total_rows <= 0").select(*_failure(4, "row-counts", "ZeroRows", zero)),
        summary.where("bad_rows > 0").select(*_failure(5, "bad-rows", "HasBadRows", F.format_string(ROW + "%d rows failed to parse", "bad_rows"))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def pii_failures(observed: DataFrame) -> DataFrame:
    """Any potential personal data is a failure; beyond the cap it isn't listed."""
    names = F.create_map(*[F.lit(x) for kv in f.PII_NAMES.items() for x in kv])
    listed = F.array_join(F.flatten(F.transform("found", lambda x: F.array_repeat(F.format_string("%s (field %d)", names[x["type"]], x["pos"]), x["n"].cast("int")))), ", ")
    detail = F.concat(F.lit(PII), F.when(F.col("too_many"), F.lit("Observation count exceeded threshold.")).otherwise(listed))
    return observed.where("observations > 0").select(*_failure(6, "pii", "PotentialPII", detail))


def file_failures(size: int, regular: bool) -> list[str]:
    """Of one file, by its status."""
    return [SANITY + "not a regular file"] * (not regular) + [SANITY + "file of zero size"] * (size <= 0)


def status(failures: DataFrame) -> DataFrame:
    """One row: passed, and the failures' details in order."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("ord", "pos", "detail"))), lambda x: x["detail"])
    return failures.agg((F.count("*") == 0).alias("passed"), listed.alias("failures"))
