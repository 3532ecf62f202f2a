"""Markers: JSON records of checks.  Writing one is the driver's work; reading many is Spark's.

Readers take every version from v1 to v5.  What older versions lack gets its default: no sampling, the quoted
format, no checks for personal data, no counts or summaries, no sample.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gaugeline.functions import fields as f

# Names and tags of the file format.
VERSION = "v5"
VERSIONS = ("v1", "v2", "v3", "v4", "v5")
RUN_PARAMS = "run-params"
DEFAULTS = {"sampling-type": {"type": "no-sampling"}, "file-format": "rfc4180", "pii-check-type": {"type": "no-pii-checks"}}
STATS = ("minimum", "maximum", "mean", "stddev", "median")
MISSING = "NA"


class MarkerError(ValueError):
    pass


# -- numbers of one field -----------------------------------------------------------------------------------------
def numeric_summary(row: dict[str, Any] | None) -> dict[str, Any]:
    """JSON of a field's summary from its statistics; nothing numeric seen is a summary of its own kind."""
    if not row or not row.get("n_numeric"):
        return {"type": "no-numeric-summary"}
    out: dict[str, Any] = {"type": "numeric-summary"}
    for name in STATS:
        v = row.get(name)
        out[name] = {"type": f"no-{name}"} if v is None else {"type": name, "value": v}
    sample = row.get("sample")
    out["sample"] = {"sample-type": "no-sample"} if sample is None else {"sample-type": "sample", "sample-values": list(sample)}
    return out


def statistics(summary: dict[str, Any]) -> dict[str, Any] | None:
    """The statistics of a summary's JSON, None for a field without numbers."""
    if summary["type"] == "no-numeric-summary":
        return None
    if summary["type"] != "numeric-summary":
        raise MarkerError(f"invalid summary type {summary['type']!r}")
    out = {}
    for name in STATS:
        got = summary[name]
        if got["type"] not in (name, f"no-{name}"):
            raise MarkerError(f"invalid {name} type {got['type']!r}")
        out[name] = got.get("value") if got["type"] == name else None
    out["sample"] = (summary.get("sample") or {}).get("sample-values")
    return out


def look_vector(counts: dict[str, int]) -> list[dict[str, Any]]:
    return [{"looks": name, "count": int(counts.get(name, 0))} for name in f.LOOKS]


def parse_look_vector(items: Iterable[dict[str, Any]]) -> dict[str, int]:
    """Counters by look; the order of the items is free, each look stands once."""
    out = {x["looks"]: int(x["count"]) for x in items}
    if set(out) != set(f.LOOKS):
        raise MarkerError(f"unexpected looks {sorted(out)}")
    return {name: out[name] for name in f.LOOKS}


def result(kind: str, failures: list[str]) -> dict[str, Any]:
    state: dict[str, Any] = {"status": "fail", "failure": failures} if failures else {"status": "pass"}
    return {"status": state, "description": "file-sanity-checks" if kind == "file" else "view-row-counts", "type": kind}


# -- reading and writing ------------------------------------------------------------------------------------------
def render(marker: dict[str, Any]) -> str:
    return json.dumps(marker, indent=4, sort_keys=True) + "\n"


def parse(text: str) -> dict[str, Any]:
    """A marker of any version, with defaults filled in."""
    try:
        data = json.loads(text)
    except json.JSONDecodeError as e:
        raise MarkerError(f"not JSON: {e}") from e
    if not isinstance(data, dict) or data.get("version") not in VERSIONS:
        raise MarkerError(f"unknown marker version {data.get('version') if isinstance(data, dict) else data!r}")
    # The run's parameters are the top-level object that has a run id, under whichever name it was written.
    name = next((k for k, v in data.items() if isinstance(v, dict) and "run-id" in v), None)
    if name is None or "results" not in data or "timestamp" not in data:
        raise MarkerError("marker lacks run parameters, results or a timestamp")
    data[RUN_PARAMS] = data.pop(name)
    if "metadata" in data:
        data["metadata"]["check-params"] = DEFAULTS | {k: v for k, v in data["metadata"]["check-params"].items() if v is not None or k == "schema-file"}
        counts = data["metadata"]["counts"]
        counts.setdefault("field-looks", None)
        counts.setdefault("text-counts", None)
        counts.setdefault("numeric-summaries", {"type": "no-numeric-field-summary"})
        if counts["field-looks"] is not None:
            counts["field-looks"] = [look_vector(parse_look_vector(x)) for x in counts["field-looks"]]
    return data


def read_text(spark: SparkSession, path: str) -> str:
    """A small file through the file system that Spark uses."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark._jsc.hadoopConfiguration()).open(p)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str, overwrite: bool = True) -> None:
    """Directories are made; an existing file is an error unless it may be overwritten."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(p) and not overwrite:
        raise MarkerError(f"{path} exists")
    stream = fs.create(p, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def write_lines(spark: SparkSession, path: str, lines: Iterable[str]) -> None:
    """A file of lines, written as they come."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    try:
        for line in lines:
            stream.write(bytearray((line + "\n").encode()))
    finally:
        stream.close()


# -- many markers, relationally -----------------------------------------------------------------------------------
# The shape of the file format.
_RESULT = "struct<status:struct<status:string,failure:array<string>>,description:string,type:string>"
_STAT = "struct<type:string,value:double>"
_SUMMARY = f"struct<type:string,minimum:{_STAT},maximum:{_STAT},mean:{_STAT},stddev:{_STAT},median:{_STAT},sample:struct<`sample-type`:string,`sample-values`:array<double>>>"
MARKER = (
    f"version string, view string, `view-file` string, timestamp string, results array<{_RESULT}>, metadata struct<`check-dates`:array<string>,`check-files`:array<string>,"
    "`check-params`:struct<separator:string,`freeform-text-threshold`:int,`file-format`:string,`line-bound`:int,`sampling-type`:struct<type:string,`reservoir-size`:int>,`pii-check-type`:struct<type:string,`max-pii-observations`:int>>,"
    "counts:struct<`bad-rows`:bigint,`total-rows`:bigint,`field-counts`:array<int>,`field-looks`:array<array<struct<looks:string,count:bigint>>>,"
    f"`text-counts`:array<struct<type:string,uniques:array<bigint>>>,`numeric-summaries`:struct<type:string,`field-summary`:array<{_SUMMARY}>>>>"
)


def read_markers(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One row a marker, with its path; what older versions lack has its default."""
    raw = spark.read.schema(MARKER).option("multiLine", True).json(paths).withColumn("path", F.col("_metadata.file_path"))
    return with_defaults(raw)


def with_defaults(found: DataFrame) -> DataFrame:
    params = F.col("metadata.check-params")
    counts = F.col("metadata.counts")
    none = F.from_json(F.lit(json.dumps({"type": "no-numeric-field-summary"})), found.schema["metadata"].dataType["counts"].dataType["numeric-summaries"].dataType)
    kind = {"sampling-type": "struct<type:string,`reservoir-size`:int>", "pii-check-type": "struct<type:string,`max-pii-observations`:int>"}
    filled = params.withField("`file-format`", F.coalesce(params["file-format"], F.lit(DEFAULTS["file-format"])))
    for name, shape in kind.items():
        filled = filled.withField(f"`{name}`", F.coalesce(params[name], F.from_json(F.lit(json.dumps(DEFAULTS[name])), shape)))
    whole = F.col("metadata").withField("`check-params`", filled).withField("counts", counts.withField("`numeric-summaries`", F.coalesce(counts["numeric-summaries"], none)))
    return found.withColumn("metadata", F.when(F.col("metadata").isNotNull(), whole))


def checked(found: DataFrame) -> DataFrame:
    """The markers, if all are of known versions; an error names the others."""
    odd = found.where(F.col("version").isNull() | ~F.col("version").isin(*VERSIONS)).select("path", "version").limit(10).collect()
    if odd:
        raise MarkerError("unknown marker versions: " + ", ".join(f"{r['path']} ({r['version']})" for r in odd))
    return found


def failed(markers: DataFrame) -> DataFrame:
    """Markers with any failed result."""
    return markers.where(F.exists("results", lambda r: r["status"]["status"] == "fail"))


def field_looks(markers: DataFrame) -> DataFrame:
    """(path, pos, and a counter a look) of all markers; a marker without looks gives nothing."""
    cells = markers.select("path", F.posexplode("metadata.counts.field-looks").alias("pos", "looks"))
    return cells.select("path", "pos", *[F.aggregate("looks", F.lit(0).cast("bigint"), _count(name)).alias(name.removeprefix("looks-")) for name in f.LOOKS])


def _count(name: str):
    return lambda acc, x: acc + F.when(x["looks"] == name, x["count"]).otherwise(F.lit(0).cast("bigint"))


def summed_looks(markers: DataFrame) -> DataFrame:
    return field_looks(markers).groupBy("pos").agg(*[F.sum(x.removeprefix("looks-")).alias(x.removeprefix("looks-")) for x in f.LOOKS])


def merged_forms(markers: DataFrame, threshold: int) -> DataFrame:
    """(pos, form, uniques): union of the markers' hashes; free text in one marker is free text in all."""
    cells = markers.select(F.posexplode("metadata.counts.text-counts").alias("pos", "t"))
    hashes = cells.select("pos", F.explode("t.uniques").alias("h")).distinct().groupBy("pos").agg(F.count("*").alias("n"))
    forms = cells.groupBy("pos").agg(F.max(F.col("t.type") == "looks-freeform").alias("free")).join(F.broadcast(hashes), "pos", "left")
    categorical = ~F.col("free") & (F.coalesce("n", F.lit(0)) < threshold)
    return forms.select("pos", F.when(categorical, F.lit("unique-text-count")).otherwise(F.lit("looks-freeform")).alias("form"), F.when(categorical, F.coalesce("n", F.lit(0))).alias("uniques"))


def validate(markers: DataFrame, use_failed: bool = False) -> dict[str, Any]:
    """View, widths, threshold and rows of markers that may be inferred from together."""
    r = checked(markers).agg(
        F.count("*").alias("n"),
        F.count_distinct("view").alias("views"),
        F.count_distinct(F.array_sort("metadata.counts.field-counts")).alias("widths"),
        F.count_distinct("metadata.check-params.freeform-text-threshold").alias("thresholds"),
        F.array_sort(F.collect_set(F.when(F.exists("results", lambda x: x["status"]["status"] == "fail"), F.col("path")))).alias("failed"),
        F.min("view").alias("view"),
        F.min("metadata.check-params.freeform-text-threshold").alias("threshold"),
        F.sum("metadata.counts.total-rows").alias("rows"),
        F.count("metadata.counts.field-looks").alias("with_looks"),
        F.count("metadata.counts.text-counts").alias("with_forms"),
    ).first()
    if not r["n"]:
        raise MarkerError("no markers")
    if not r["with_looks"]:
        raise MarkerError("no field counts in any marker")
    if not r["with_forms"]:
        raise MarkerError("no text counts in any marker")
    for name, what in (("views", "views"), ("widths", "field counts"), ("thresholds", "freeform thresholds")):
        if r[name] > 1:
            raise MarkerError(f"markers differ in their {what}")
    if r["failed"] and not use_failed:
        raise MarkerError("markers of failed checks: " + ", ".join(r["failed"]))
    return {"view": r["view"], "threshold": r["threshold"], "rows": r["rows"]}


def summaries(markers: DataFrame) -> DataFrame:
    """(path, view, first_date, last_date, pos, statistics, sample) of all fields of all markers."""
    dates = F.col("metadata.check-dates")
    base = markers.select("path", "view", F.array_min(dates).alias("first_date"), F.array_max(dates).alias("last_date"), F.posexplode("metadata.counts.numeric-summaries.field-summary").alias("pos", "s"))
    return base.select("path", "view", "first_date", "last_date", "pos", (F.col("s.type") == "numeric-summary").alias("numeric"), *[F.col(f"s.{n}.value").alias(n) for n in STATS], F.col("s.sample.sample-values").alias("sample"))


def validate_summaries(cells: DataFrame, same_view: bool = True) -> None:
    """The same fields must be numeric in every marker; for reports the view must agree too."""
    r = cells.groupBy("path").agg(F.min("view").alias("view"), F.array_sort(F.collect_list(F.struct("pos", "numeric"))).alias("p")).agg(F.count_distinct("p").alias("patterns"), F.count_distinct("view").alias("views"), F.count("*").alias("n")).first()
    if not r["n"]:
        raise MarkerError("no numeric summaries")
    if r["patterns"] > 1:
        raise MarkerError("numeric fields differ between markers")
    if same_view and r["views"] > 1:
        raise MarkerError("views differ between markers")


def _number(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(MISSING))


def summary_report(cells: DataFrame) -> DataFrame:
    """(pos, start-date, ... median): one row a marker and numeric field, missing values as NA."""
    kept = cells.where("numeric")
    return kept.select(
        "pos",
        F.coalesce("first_date", F.lit(MISSING)).alias("start-date"),
        F.coalesce("last_date", F.lit(MISSING)).alias("end-date"),
        _number(F.col("minimum")).alias("minimum"),
        _number(F.col("maximum")).alias("maximum"),
        _number(F.col("mean")).alias("mean"),
        _number(F.col("stddev")).alias("std-dev"),
        _number(F.col("median")).alias("median"),
    )


def sample_columns(cells: DataFrame) -> DataFrame:
    """Samples of the numeric fields side by side, one column a field; shorter ones end in nulls.  Samples have a fixed size."""
    joined = cells.where("numeric").groupBy("pos").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("path", F.coalesce("sample", F.array().cast("array<double>")).alias("v")))), lambda x: x["v"])).alias("values"))
    positions = [r["pos"] for r in joined.select("pos").orderBy("pos").collect()]
    long = joined.select("pos", F.posexplode("values").alias("i", "value"))
    return long.groupBy("i").pivot("pos", positions).agg(F.first("value")).orderBy("i").drop("i") if positions else long.select("value").limit(0)
