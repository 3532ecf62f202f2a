"""Whole runs: check a view or a file, infer a schema, extract samples and reports."""

from __future__ import annotations

import os
import re
import uuid
from dataclasses import dataclass, field
from datetime import datetime, timezone
from itertools import chain, groupby
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

from gaugeline.functions import fields as f
from gaugeline.operators import checks, markers, profile, schema as sch
from gaugeline.sources import text, views


@dataclass(frozen=True)
class CheckParams:
    """Options of a check, with their defaults."""

    separator: str = "|"
    file_format: str = "delimited-text"
    line_bound: int = text.LINE_BOUND
    freeform_threshold: int = profile.FREEFORM
    schema_file: str | None = None
    reservoir_size: int | None = None
    max_pii: int | None = profile.MAX_PII
    include_dot_files: bool = False
    force: bool = False
    exit_on_failure: bool = False
    verbose: bool = False

    def as_json(self) -> dict[str, Any]:
        # Names and tags of the file format.
        return {
            "separator": self.separator,
            "line-bound": self.line_bound,
            "verbosity": "verbose" if self.verbose else "quiet",
            "force": "force" if self.force else "no-force",
            "schema-file": self.schema_file,
            "freeform-text-threshold": self.freeform_threshold,
            "exit-type": "check-status-exit" if self.exit_on_failure else "no-check-status-exit",
            "include-dot-files": "include-dot-files" if self.include_dot_files else "no-include-dot-files",
            "sampling-type": {"type": "no-sampling"} if self.reservoir_size is None else {"type": "reservoir-sampling", "reservoir-size": self.reservoir_size},
            "file-format": self.file_format,
            "pii-check-type": {"type": "no-pii-checks"} if self.max_pii is None else {"type": "pii-checks", "max-pii-observations": self.max_pii},
        }


@dataclass
class Outcome:
    """What a check found; ``results`` are (kind, file, failures), the rows' result first."""

    results: list[tuple[str, str, list[str]]]
    marker: dict[str, Any] = field(default_factory=dict)
    marker_path: str = ""

    @property
    def passed(self) -> bool:
        return not any(x[2] for x in self.results)

    def lines(self) -> list[str]:
        out = []
        for kind, name, failures in self.results:
            out.append(f"file {name}: file-sanity-checks" if kind == "file" else "row: view-row-counts")
            out += ["failed: ", *failures] if failures else ["passed"]
        return out


def _run_params() -> dict[str, Any]:
    return {"tool-version": "1", "num-caps": os.cpu_count() or 1, "run-id": uuid.uuid4().hex[:16]}


def _now() -> str:
    return datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M:%S")


def sanity(spark: SparkSession, files: list[views.ViewFile], params: CheckParams, write: bool = True) -> list[tuple[str, str, list[str]]]:
    """File checks, each with a marker beside the file; an existing marker is an error unless forced."""
    out = []
    for v in files:
        s = views.status(spark, v.path)
        failures = checks.file_failures(s.size, s.regular)
        out.append(("file", v.path, failures))
        if write:
            marker = {"version": markers.VERSION, markers.RUN_PARAMS: _run_params(), "view-file": v.path, "timestamp": _now(), "results": [markers.result("file", failures)]}
            markers.write_text(spark, views.file_marker_path(v.path), markers.render(marker), overwrite=params.force)
    return out


def profile_rows(rows: DataFrame, params: CheckParams, schema: list[sch.SchemaField] | None = None) -> tuple[list[str], dict[str, Any]]:
    """Failures and the counts of a marker.

    The rows are read once for their widths, once for all fields' looks, numbers and personal data, twice for distinct
    values, the first time for a slice of them, and once for samples, which look at few rows.  Nothing is cached: at
    scale a second read costs less than keeping parsed rows.
    """
    spark = rows.sparkSession
    summary = profile.row_summary(rows)
    (s,) = summary.collect()
    cells = profile.exploded(rows)
    pii = F.lit(None).cast("string") if params.max_pii is None else f.pii_type(F.col("value"))
    by_position = profile.annotated(cells).withColumn("pii", pii).groupBy("pos").agg(*profile.look_counts(), *profile.numeric_stats(), *profile.pii_counts())
    by_field = by_position.orderBy("pos").collect()
    forms = {r["pos"]: r for r in profile.distinct_hashes(cells, params.freeform_threshold).collect()}
    samples = {}
    if params.reservoir_size is not None:
        drawn = profile.reservoir(profile.with_draw(rows), params.reservoir_size, {r["pos"]: r["n_numeric"] for r in by_field})
        samples = {r["pos"]: r for r in drawn.select("pos", "sample", profile.sample_median(F.col("sample")).alias("median")).collect()}
    # From here on tables have one row, or one a field.
    one = spark.createDataFrame([s], summary.schema)
    fields_ = spark.createDataFrame(by_field, by_position.schema)
    failures = []
    if schema is not None:
        wanted = sch.schema_frame(spark, schema)
        wrong = checks.width_failures(one, wanted)
        if wrong.isEmpty():
            wrong = checks.type_failures(fields_, wanted)
        kinds = spark.createDataFrame([(p, r["form"], r["uniques"]) for p, r in forms.items()], "pos int, form string, uniques bigint")
        failures += _details(wrong.unionByName(checks.form_failures(kinds, wanted)))
    failures += _details(checks.row_failures(one))
    if params.max_pii is not None:
        failures += _details(checks.pii_failures(profile.observations_of(fields_, params.max_pii)))
    counts: dict[str, Any] = {"bad-rows": s["bad_rows"], "total-rows": s["total_rows"], "field-counts": list(s["field_counts"])}
    if by_field:
        rank = {r["pos"]: r.asDict() | {"sample": samples[r["pos"]]["sample"] if r["pos"] in samples else None, "median": samples[r["pos"]]["median"] if r["pos"] in samples else None} for r in by_field}
        counts["field-looks"] = [markers.look_vector({f"looks-{k}": r[k] for k in ("empty", "integral", "real", "text", "boolean")}) for r in by_field]
        counts["text-counts"] = [{"type": "looks-freeform"} if forms[r["pos"]]["form"] == "looks-freeform" else {"type": "unique-text-count", "uniques": list(forms[r["pos"]]["hashes"])} for r in by_field]
        counts["numeric-summaries"] = {"type": "numeric-field-summary", "field-summary": [markers.numeric_summary(rank[r["pos"]]) for r in by_field]}
    else:
        counts["numeric-summaries"] = {"type": "no-numeric-field-summary"}
    return failures, counts


def _details(failures: DataFrame) -> list[str]:
    return [r["detail"] for r in failures.orderBy("ord", "pos").collect()]


def check_files(spark: SparkSession, view: str, files: list[views.ViewFile], params: CheckParams, markers_at: str | None = None) -> Outcome:
    """File checks, then one profile over all files, then a marker of the view."""
    schema = sch.parse_schema(markers.read_text(spark, params.schema_file)) if params.schema_file else None
    by_file = sanity(spark, files, params)
    rows = text.read_files(spark, [v.path for v in files], params.file_format, params.separator, params.line_bound)
    failures, counts = profile_rows(rows, params, schema)
    dates = sorted({v.date for v in files if v.date})
    marker = {
        "version": markers.VERSION,
        markers.RUN_PARAMS: _run_params(),
        "view": view,
        "timestamp": _now(),
        "results": [markers.result("row", failures), *(markers.result("file", x[2]) for x in by_file)],
        "metadata": {"check-dates": dates, "check-files": [v.path for v in files], "check-params": params.as_json(), "counts": counts},
    }
    out = Outcome([("row", view, failures), *by_file], marker)
    if markers_at:
        out.marker_path = views.view_marker_path(markers_at, view, (dates[0], dates[-1]) if dates else None, marker["timestamp"][:10], marker[markers.RUN_PARAMS]["run-id"])
        markers.write_text(spark, out.marker_path, markers.render(marker))
    return out


def check(spark: SparkSession, view: str, params: CheckParams = CheckParams(), markers_at: str | None = None) -> Outcome:  # noqa: B008  frozen
    return check_files(spark, view, views.traverse(spark, view, params.include_dot_files), params, markers_at)


def check_file(spark: SparkSession, path: str, params: CheckParams = CheckParams(), markers_at: str | None = None) -> Outcome:  # noqa: B008
    """One file by itself: its directory is the view."""
    path = os.path.abspath(path) if "://" not in path else path
    found = views.parse_view_file(path)
    folder, _, name = path.rpartition("/")
    return check_files(spark, folder, [found or _Loose(folder, "", name)], params, markers_at)


class _Loose(views.ViewFile):
    """A file outside the layout."""

    @property
    def path(self) -> str:
        return f"{self.view}/{self.part}"


def infer(spark: SparkSession, marker_paths: list[str], ratio: float = sch.MATCH_RATIO, use_failed: bool = False, say=None) -> list[sch.SchemaField]:
    """A schema from markers of the same view; ``say`` gets the fields' histograms of types as lines."""
    found = markers.read_markers(spark, marker_paths)
    known = markers.validate(found, use_failed)
    looks, forms = markers.summed_looks(found), markers.merged_forms(found, known["threshold"])
    hist = sch.histogram(looks)
    if say is not None:
        for r in hist.orderBy("pos").collect():  # one row a field
            say(f"{r['pos']}: " + ", ".join(f"{t}: {r[t.removesuffix('-field')]}" for t in f.TYPES))
    inferred = sch.infer(looks, forms, known["rows"], known["threshold"], ratio)
    sch.check_forms(forms)
    sch.check_counts(hist, known["rows"])
    return sch.collect_schema(inferred)


def extract_samples(spark: SparkSession, marker_paths: list[str], out: str) -> None:
    """Samples of all numeric fields as CSV without a header; no markers, no output."""
    if marker_paths:
        cells = markers.summaries(markers.checked(markers.read_markers(spark, marker_paths)))
        markers.validate_summaries(cells, same_view=False)
        markers.sample_columns(cells).coalesce(1).write.mode("overwrite").csv(out)


def summarise(spark: SparkSession, marker_paths: list[str], folder: str = ".") -> list[str]:
    """A report of each numeric field as a CSV file with a header, named for view and field.

    One job sorts the report of all fields; its rows, one a marker and field, are written as they arrive.
    """
    if not marker_paths:
        return []
    cells = markers.summaries(markers.checked(markers.read_markers(spark, marker_paths)))
    markers.validate_summaries(cells)
    view = cells.select("view").first()["view"]
    stem = f"{folder}/summary_{re.sub(r'[^A-Za-z0-9._-]+', '_', view.strip('/'))}"
    report = markers.summary_report(cells)
    header = [c for c in report.columns if c != "pos"]
    written: list[str] = []
    for pos, rows in groupby(report.orderBy("pos", "start-date", "end-date").toLocalIterator(), key=lambda r: r["pos"]):
        written.append(f"{stem}_{pos}.csv")
        markers.write_lines(spark, written[-1], chain([",".join(header)], (",".join(r[c] for c in header) for r in rows)))
    return written
