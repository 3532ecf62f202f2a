"""Whole runs on files: golden outcomes, layouts, markers, inference, samples, the command line, streams."""

import io
import json
import os

import pytest
from pyspark.sql import functions as F

from gaugeline import catalog, cli
from gaugeline.operators import markers, profile, schema as sch
from gaugeline.plans import feeds
from gaugeline.sources import generate, tables, text, views
from gaugeline.streaming import profiles

DAY = "year=2016/month=03/day=24"
QUOTED = feeds.CheckParams(file_format="rfc4180", freeform_threshold=10)


def put(root, name, data, day=DAY):
    path = root / day / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data)
    return str(path)


def row_failures(outcome):
    return outcome.results[0][2]


# Small feeds, and the words that checks must say about them.
@pytest.mark.parametrize(
    ("data", "params", "schema", "want"),
    [
        (b'"foo"|"bar"|"baz"\nfoo|baz\nbar|"123"\n', QUOTED, None, ["row check failed: differing field counts: 2, 3"]),
        (b'1,2\n3,foo\n"bar",96\n\n', QUOTED, [sch.SchemaField("integral-field")] * 2, ["schema validation failed: Field count in schema differs from unique field observations. schema count is 2, observed 1"]),
        (b"foo|bob@example.com\n", QUOTED, None, ["potential PII found: email address (field 1)"]),
        (b"0412 345 678|bar\n", QUOTED, None, ["potential PII found: phone number (field 0)"]),
        (b"", QUOTED, None, ["row check failed: no rows in xSV document"] * 2),
        (b"a|b\n\xff|b\nc|d\n", QUOTED, None, ["row check failed: 1 rows failed to parse"]),
        (b"a|1\nb|2\n", QUOTED, None, []),
        (b"x|1\ny|two\n", QUOTED, [sch.SchemaField("text-field", 1), sch.SchemaField("real-field")], ["schema validation failed: Field characteristics differ from those specified in schema: field type (field 1): expected real-field, saw looks-text: 1", "schema validation failed: Field characteristics differ from those specified in schema: categorical field form (field 0): expected 1, saw 2 uniques"]),
        (b"a@b.cd\n" * 3, feeds.CheckParams(max_pii=2), None, ["potential PII found: Observation count exceeded threshold."]),
        (b"a@b.cd\n", feeds.CheckParams(max_pii=None), None, []),
    ],
)
def test_golden_outcomes(spark, tmp_path, data, params, schema, want):
    put(tmp_path, "f", data)
    if schema is not None:
        path = str(tmp_path / "_schema.json")
        markers.write_text(spark, path, sch.render_schema(schema))
        params = feeds.CheckParams(**{**params.__dict__, "schema_file": path})
    got = feeds.check(spark, str(tmp_path), params)
    assert row_failures(got) == want
    assert got.results[1][2] == (["sanity check failed: file of zero size"] if not data else [])


def test_ragged_feed(spark, tmp_path):
    """A blank line hides nothing: every position of every good row is profiled."""
    put(tmp_path, "f", b"a|bob@example.com|5\n\nb|eve@example.com|7|x\n\xff|q|r\n")
    got = feeds.check(spark, str(tmp_path))
    assert row_failures(got) == ["row check failed: differing field counts: 1, 3, 4", "row check failed: 1 rows failed to parse", "potential PII found: email address (field 1), email address (field 1)"]
    counts = got.marker["metadata"]["counts"]
    looks = [{x["looks"]: x["count"] for x in f if x["count"]} for f in counts["field-looks"]]
    assert looks == [{"looks-empty": 1, "looks-text": 2}, {"looks-text": 2}, {"looks-integral": 2}, {"looks-text": 1}]
    assert [len(t["uniques"]) for t in counts["text-counts"]] == [3, 2, 2, 1]
    assert [s["type"] for s in counts["numeric-summaries"]["field-summary"]].count("numeric-summary") == 1


def test_reservoir_of_repeated_rows(spark, tmp_path):
    """Rows of equal content are drawn apart: the sample's spread is the feed's."""
    path = put(tmp_path, "f", b"".join(b"%d|%d\n" % (i % 10, i) for i in range(5000)))
    rows = text.read_files(spark, [path]).repartition(3)
    for drawn in (profile.with_draw(rows), profile.with_draw(rows.withColumn("k", F.get("fields", F.lit(1))), ["k"])):
        found = {r["pos"]: r["sample"] for r in profile.reservoir(drawn, 1000).collect()}
        assert {p: len(x) for p, x in found.items()} == {0: 1000, 1: 1000} and len(set(found[1])) == 1000
        assert all(60 <= found[0].count(v) <= 145 for v in range(10)) and abs(sum(found[0]) / 1000 - 4.5) < 0.4
        assert abs(profile_median(found[1]) - 2499.5) < 300
    keyed = lambda n: sorted(profile.reservoir(profile.with_draw(rows.repartition(n).withColumn("k", F.get("fields", F.lit(1))), ["k"], seed=3), 50).collect())
    assert keyed(1) == keyed(5)
    assert {r["pos"]: len(r["sample"]) for r in profile.reservoir(profile.with_draw(rows), 10_000).collect()} == {0: 5000, 1: 5000}
    # A field that comes out short below its cut is drawn from all of its rows.
    few = profile.reservoir(profile.with_draw(rows), 2, {0: 5_000_000, 1: 5000}).collect()
    assert sorted(len(r["sample"]) for r in few) == [2, 2]
    assert profile.reservoir(profile.with_draw(rows.where("false")), 5).count() == 0


def profile_median(values):
    v = sorted(values)
    return (v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2


@pytest.mark.parametrize(("accuracy", "at_once"), [(10_000, 2_000_000), (20, 10)])
def test_exact_medians(spark, monkeypatch, accuracy, at_once):
    """Also where bounds have to be narrowed before they are sorted, and where one number fills them."""
    import random

    monkeypatch.setattr(profile, "ACCURACY", accuracy)
    monkeypatch.setattr(profile, "SORTED_AT_ONCE", at_once)
    rnd = random.Random(2)
    groups = {0: [rnd.gauss(0, 9) for _ in range(2001)], 1: [float(rnd.randrange(5)) for _ in range(3000)], 2: [7.0] * 500, 3: [1.0, 2.0], 4: [3.0], 5: [None, None], 6: [1.0] * 400 + [2.0] * 400}
    cells = spark.createDataFrame([(g, x) for g, xs in groups.items() for x in xs], "pos int, num double").repartition(4)
    got = {r["pos"]: r["median"] for r in profile.exact_medians(cells).collect()}
    assert got == {g: (None if g in (4, 5) else profile_median(xs)) for g, xs in groups.items()}
    assert profile.exact_medians(cells.where("false")).count() == 0


def test_medians_of_signs_infinities_and_null_groups(spark, monkeypatch):
    """Buckets keep the order of numbers of any sign and size; a group without a name is one too."""
    inf = float("inf")
    groups = {None: [1.0, 5.0, 9.0], 1: [-inf, -1e300, -5e-324, 0.0, 5e-324, 1e300, inf], 2: [-3.5] * 5 + [-3.25] * 5, 3: [inf] * 9 + [1.0], 4: [1e15 + i for i in range(101)], 5: [-(2.0**53) + i for i in range(100)]}
    cells = spark.createDataFrame([(g, x) for g, xs in groups.items() for x in xs], "pos int, num double").repartition(3)
    for at_once in (2_000_000, 1):
        monkeypatch.setattr(profile, "SORTED_AT_ONCE", at_once)
        got = {r["pos"]: r["median"] for r in profile.exact_medians(cells).collect()}
        assert got == {g: profile_median(xs) for g, xs in groups.items()}


def test_medians_sort_only_the_middle(spark):
    """The rows that reach the sort are a bucket's, of the open groups alone."""
    cells = spark.range(100_000).select((F.col("id") % 2).cast("int").alias("pos"), F.when(F.col("id") % 2 == 0, F.col("id")).otherwise(F.lit(7)).cast("double").alias("num"))
    done, left = profile._middles(cells.withColumnsRenamed({"pos": "g", "num": "x"}).groupBy("g", profile._octaves(F.col("x")).alias("k")).agg(F.count("x").alias("c"), F.min("x").alias("a"), F.max("x").alias("b")).withColumns({"n": F.lit(50_000).cast("bigint"), "below": F.lit(0).cast("bigint")}))
    assert done == {1: 7.0} and list(left) == [0] and left[0][-1] < 200
    assert {r["pos"]: r["median"] for r in profile.exact_medians(cells).collect()} == {0: 49_999.0, 1: 7.0}


def test_number_cells_are_the_numbers_of_the_text(spark):
    """Numbers straight from a table's columns are those that its fields' text holds."""
    doubles = [0.0, -0.0, 0.00005, 1.00005, -2.5, 1234.56785, 1e20, -1e-9, None, 0.1 + 0.2, 123456789.98765]
    table = spark.createDataFrame([(x, None if x is None else i, 2**62 + i, str(x), None if x is None else i % 2 == 0, "2016-03-04") for i, x in enumerate(doubles)], "d double, i int, l bigint, s string, b boolean, t string")
    table = table.withColumns({"f": F.col("d").try_cast("float"), "t": F.col("t").cast("timestamp"), "day": F.col("t").cast("date"), "dec": F.lit("12.50").cast("decimal(9,2)")})
    want = profile.annotated(profile.exploded(tables.rows_of(table))).select("pos", "num").collect()
    got = tables.number_cells(table).collect()
    key = lambda rows: sorted(map(str, rows))
    assert key(got) == key(want) and len(got) == len(doubles) * len(table.columns)


def test_old_markers_and_errors(spark, tmp_path):
    def marker(name, version="v1", looks=((60, 0, 0, 0, 0),), uniques=(1,), rows=60, **counts):
        data = {"version": version, "view": "/v", "timestamp": "2016-01-01 00:00:00", "results": [], "metadata": {"check-dates": ["2016-01-01"], "check-files": [], "check-params": {"separator": "|", "freeform-text-threshold": 50}, "counts": {"bad-rows": 0, "total-rows": rows, "field-counts": [1], **({"field-looks": [markers.look_vector(dict(zip(("looks-empty", "looks-integral", "looks-real", "looks-text", "looks-boolean"), x, strict=True))) for x in looks], "text-counts": [{"type": "unique-text-count", "uniques": list(uniques)}]} if looks else {}), **counts}}}
        path = tmp_path / name
        path.write_text(json.dumps(data))
        return str(path)

    (r,) = markers.read_markers(spark, [marker("a")]).selectExpr("metadata.`check-params` p", "metadata.counts.`numeric-summaries`.type t").collect()
    assert r["p"]["file-format"] == "rfc4180" and r["p"]["sampling-type"]["type"] == "no-sampling" and r["p"]["pii-check-type"]["type"] == "no-pii-checks" and r["t"] == "no-numeric-field-summary"
    assert feeds.infer(spark, [marker("a"), marker("b", looks=(), rows=0)]) == [sch.SchemaField("text-field", 1)]
    for bad, error, why in (([marker("c", version="v9")], markers.MarkerError, "versions"), ([marker("d", looks=())], markers.MarkerError, "no field counts"), ([marker("e", uniques=())], sch.InferenceError, "no text counts"), ([marker("f", looks=((500, 0, 0, 0, 0),))], sch.InferenceError, "more compatible"), ([marker("g", rows=0)], sch.InferenceError, "too few")):
        with pytest.raises(error, match=why):
            feeds.infer(spark, bad)
    said = []
    feeds.infer(spark, [marker("h", looks=((1, 59, 0, 0, 0),))], say=said.append)
    assert said == ["0: text-field: 60, boolean-field: 1, integral-field: 60, real-field: 60"]


def test_layout(spark, tmp_path):
    put(tmp_path, "a/b", b"x\n")
    put(tmp_path, ".dot", b"y\n")
    put(tmp_path, "_skipped", b"z\n")
    (tmp_path / "_dir").mkdir()
    (tmp_path / "_dir" / "stray").write_text("no")
    os.symlink(tmp_path / DAY / "a/b", tmp_path / DAY / "link")
    assert [v.part for v in views.traverse(spark, str(tmp_path))] == ["a/b"]
    both = views.traverse(spark, str(tmp_path), include_dot_files=True)
    assert {v.part for v in both} == {"a/b", ".dot"}
    assert text.read_files(spark, [v.path for v in both]).count() == 2
    assert not views.status(spark, str(tmp_path / DAY / "link")).regular
    (tmp_path / "2015").mkdir()
    (tmp_path / "2015" / "bad").write_text("no")
    with pytest.raises(views.ViewError, match="outside"):
        views.traverse(spark, str(tmp_path))
    (tmp_path / "empty").mkdir()
    with pytest.raises(views.ViewError, match="no files"):
        views.traverse(spark, str(tmp_path / "empty"))
    deep = tmp_path / "deep" / "/".join("abcdefg")
    deep.mkdir(parents=True)
    with pytest.raises(views.ViewError, match="depth"):
        views.traverse(spark, str(tmp_path / "deep"))


@pytest.mark.parametrize(("table", "days"), [("orders", ("2016-03-24", "2016-03-25")), ("customer", ("2016-03-24",))])
def test_feed_of_a_table_whose_first_split_has_no_rows(spark, tmp_path, table, days):
    """A row group belongs to the split that holds its middle, so the first of several splits may be without rows."""
    size = os.path.getsize(f"/root/testdata/sf0.001/{table}.parquet")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size // 8)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        lines = catalog.table_lines(spark, "/root/testdata/sf0.001", table)
        assert not lines.where(F.spark_partition_id() == 0).count()
        root = catalog.write_feed(spark, lines, days)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    got = feeds.check(spark, root, feeds.CheckParams(max_pii=None))
    assert got.passed and got.marker["metadata"]["check-dates"] == list(days)
    assert got.marker["metadata"]["counts"]["total-rows"] == lines.count()


def test_feed_without_lines_keeps_an_empty_file(spark):
    root = catalog.write_feed(spark, spark.createDataFrame([], "value string"))
    got = feeds.check(spark, root, feeds.CheckParams(max_pii=None))
    assert got.results[1][2] == ["sanity check failed: file of zero size"]


def test_marker_paths():
    p = "/v/year=2015/month=04/day=04/x/bar"
    assert views.file_marker_path(p) == "/v/year=2015/month=04/day=04/x/_bar.marker"
    assert views.marked_file(views.file_marker_path(p)) == p and views.marked_file(p) is None
    assert views.parse_view_file("/v/year=2015/month=04/day=04/") is None
    assert views.parse_view_file(p).path == p


def test_trip(spark, tmp_path):
    """A generated view passes, its marker gives a schema, and the view passes with that schema."""
    root = str(tmp_path / "v")
    n = generate.generate_view(spark, root, lines=2000, files=3, seed=5)
    assert text.read_files(spark, [v.path for v in views.traverse(spark, root)]).select(F.size("fields")).distinct().collect() == [(n,)]
    params = feeds.CheckParams(reservoir_size=50, max_pii=None, force=True)
    first = feeds.check(spark, root, params, str(tmp_path / "m"))
    assert first.passed
    schema = feeds.infer(spark, [first.marker_path])
    assert len(schema) == n
    path = str(tmp_path / "schema.json")
    markers.write_text(spark, path, sch.render_schema(schema))
    assert sch.parse_schema(markers.read_text(spark, path)) == schema
    again = feeds.check(spark, root, feeds.CheckParams(max_pii=None, force=True, schema_file=path), str(tmp_path / "m"))
    assert again.passed
    with pytest.raises(markers.MarkerError, match="exists"):
        feeds.check(spark, root, feeds.CheckParams(max_pii=None))
    got = markers.parse(markers.read_text(spark, first.marker_path))
    assert got["metadata"]["counts"]["total-rows"] == 2000
    summaries = got["metadata"]["counts"]["numeric-summaries"]["field-summary"]
    for x in map(markers.statistics, summaries):
        if x:
            assert len(x["sample"]) == 50 and min(x["sample"]) >= x["minimum"] and x["median"] is not None
    feeds.extract_samples(spark, [first.marker_path], str(tmp_path / "samples"))
    numeric = sum(x["type"] == "numeric-summary" for x in summaries)
    assert spark.read.csv(str(tmp_path / "samples")).count() == 50
    reports = feeds.summarise(spark, [first.marker_path], str(tmp_path))
    assert len(reports) == numeric
    (r,) = spark.read.option("header", True).csv(reports[0]).collect()
    assert r["start-date"] == got["metadata"]["check-dates"][0] and r["end-date"] == got["metadata"]["check-dates"][-1]
    # Two markers: the fields' samples follow one another; no markers: nothing is written.
    feeds.extract_samples(spark, [], str(tmp_path / "none"))
    assert not (tmp_path / "none").exists() and feeds.summarise(spark, []) == []


def test_inference_rules(spark, tmp_path):
    def marker(name, looks, view="/v", threshold=50, failed=False, widths=(1,)):
        counts = {"bad-rows": 0, "total-rows": sum(looks), "field-counts": list(widths), "field-looks": [[{"looks": n, "count": c} for n, c in zip(reversed(("looks-empty", "looks-integral", "looks-real", "looks-text", "looks-boolean")), reversed(looks), strict=True)]], "text-counts": [{"type": "unique-text-count", "uniques": [1]}]}
        data = {"version": "v1", "the-params": {"run-id": "a", "num-caps": 1}, "view": view, "timestamp": "2016-01-01 00:00:00", "results": [markers.result("row", ["x"] if failed else [])], "metadata": {"check-dates": ["2016-01-01"], "check-files": [], "check-params": {"separator": "|", "freeform-text-threshold": threshold}, "counts": counts}}
        path = tmp_path / name
        path.write_text(json.dumps(data))
        return str(path)

    assert feeds.infer(spark, [marker("e", [60, 0, 0, 0, 0])]) == [sch.SchemaField("text-field", 1)]
    assert feeds.infer(spark, [marker("i", [5, 95, 0, 0, 0]), marker("j", [0, 60, 0, 0, 0])]) == [sch.SchemaField("integral-field", 1)]
    assert feeds.infer(spark, [marker("r", [0, 50, 45, 5, 0])]) == [sch.SchemaField("real-field", 1)]
    assert feeds.infer(spark, [marker("b", [0, 0, 0, 0, 60])]) == [sch.SchemaField("boolean-field", 1)]
    for bad, why in (([marker("x", [60, 0, 0, 0, 0]), marker("y", [60, 0, 0, 0, 0], view="/w")], "views"), ([marker("x", [60, 0, 0, 0, 0]), marker("z", [60, 0, 0, 0, 0], threshold=9)], "thresholds"), ([marker("x", [60, 0, 0, 0, 0]), marker("w", [60, 0, 0, 0, 0], widths=(2,))], "field counts"), ([marker("f", [60, 0, 0, 0, 0], failed=True)], "failed")):
        with pytest.raises(markers.MarkerError, match=why):
            feeds.infer(spark, bad)
    assert feeds.infer(spark, [marker("f", [60, 0, 0, 0, 0], failed=True)], use_failed=True)
    with pytest.raises(sch.InferenceError, match="too few"):
        feeds.infer(spark, [marker("s", [3, 0, 0, 0, 0])])
    old = markers.parse((tmp_path / "i").read_text())
    assert old["metadata"]["check-params"]["file-format"] == "rfc4180" and old["metadata"]["check-params"]["sampling-type"] == {"type": "no-sampling"}
    assert old["metadata"]["counts"]["field-looks"][0][0] == {"looks": "looks-empty", "count": 5}
    for text_ in ("{", "[]", '{"version": "v9"}', '{"version": "v1", "results": []}'):
        with pytest.raises(markers.MarkerError):
            markers.parse(text_)


def test_schema_json():
    good = [sch.SchemaField("integral-field"), sch.SchemaField("text-field", 6)]
    assert sch.parse_schema(sch.render_schema(good)) == good
    for bad in ('{"version": "v2", "fields": []}', '{"version": "v1", "fields": [{"field-type": "text-field", "field-form": {"form-type": "categorical"}}]}', '{"version": "v1", "fields": [{"field-type": "date", "field-form": {"form-type": "freeform"}}]}', "x"):
        with pytest.raises(sch.SchemaError):
            sch.parse_schema(bad)


def test_command_line(spark, tmp_path):
    put(tmp_path, "f", b"a|0412 345 678\n")
    out = io.StringIO()
    m = str(tmp_path / "_m")
    assert cli.run(spark, ["check", str(tmp_path), "--markers", m], out) == 0
    assert cli.run(spark, ["check", str(tmp_path), "--markers", m, "-x", "--force"], out) == 1
    assert cli.run(spark, ["check", str(tmp_path), "--markers", m], out) == 1  # a file marker is there
    assert "potential PII found: phone number (field 1)" in out.getvalue()
    assert cli.run(spark, ["check-file", str(tmp_path / DAY / "f"), "--markers", m, "--force", "--no-pii", "-x"], out) == 0
    assert cli.run(spark, ["sanity", str(tmp_path), "--force"], out) == 0
    found = [str(p) for p in (tmp_path / "_m").rglob("*.marker")]
    out = io.StringIO()
    assert cli.run(spark, ["marker", "failed", *found], out) == 0 and len(out.getvalue().splitlines()) == 2
    (tmp_path / "s.json").write_text("{}")
    assert cli.run(spark, ["schema", "validate", str(tmp_path / "s.json")], out) == 1
    out = io.StringIO()
    assert cli.run(spark, ["--dry-run", "check", str(tmp_path), "-d", "-e", "--exit-check-status", "-b", "9"], out) == 0
    assert "exit_status=True" in out.getvalue() and "include_dot_files=True" in out.getvalue() and "line_bound=9" in out.getvalue()
    with pytest.raises(SystemExit):
        cli.run(spark, ["check", str(tmp_path), "-s", "ab"], out)


def test_line_bound_and_returns(spark, tmp_path):
    path = put(tmp_path, "f", b"abc|d\r\n\nlong|" + b"x" * 100 + b"\n")
    rows = text.read_files(spark, [path], line_bound=50).collect()
    assert [(r["bad"], r["fields"]) for r in rows] == [(False, ["abc", "d\r"]), (False, [""]), (True, None)]


def test_stream_equals_batch(spark, tmp_path):
    root = str(tmp_path / "v")
    generate.generate_view(spark, root, lines=500, files=3, seed=8)
    q = profiles.stream_field_profile(profiles.stream_rows(spark, root, files_per_trigger=1)).writeStream.outputMode("complete").format("memory").queryName("stream_profile").start()
    q.processAllAvailable()
    q.stop()
    rows = text.read_files(spark, [v.path for v in views.traverse(spark, root)])
    key = lambda df: sorted((r["pos"], r["empty"], r["integral"], r["real"], r["text"], r["boolean"], r["n_numeric"], r["minimum"], r["maximum"], str(round(r["mean"] or 0, 6)), str(round(r["stddev"] or 0, 6))) for r in df.collect())
    assert key(spark.table("stream_profile")) == key(profile.field_profile(rows))
