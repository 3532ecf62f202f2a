"""Every pipeline stage and operator on empty tables, nulls, repeated rows, one very long text and clashing names."""

import pytest

import corpus_pipeline
from gaugeline.llm import queries

CLASHING = "y int, fold int, cands string, part string, kind int, length string, cid string, score double, next_text string, `_b` int, edited string, value string, text_ string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("odd")
    extra = (1, 2, "c", "p", 3, "l", "i", 0.5, "n", 4, "e", "v", "t")
    long = " ".join(f"w{i % 5000}" for i in range(60_000)) + " a@b.co " + "x" * 30_000
    texts = [None, "", " \n", "one", "one", "One", "two words", long, "😀 é", "\x00", "</article> <p>"]
    rows = [(i, t, None if i % 2 else "en", None if i % 3 else "s", None, *extra) for i, t in enumerate(texts)]
    rows += [rows[3], rows[7], (None, "no id", "en", "s", 5, *extra), (None, None, None, None, None, *(None,) * len(extra))]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}")
    docs.write.parquet(f"{root}/full/documents.parquet")
    docs.limit(0).write.parquet(f"{root}/empty/documents.parquet")
    labels = spark.createDataFrame([(1, 1, 0), (3, None, 1), (None, 0, 0), (77, 0, 1)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{root}/full/labels.parquet")
    labels.limit(0).write.parquet(f"{root}/empty/labels.parquet")
    pages = spark.createDataFrame([(1, None, None), (1, "http://a/b", ""), (None, "x", "<p>t"), (2, "http://a/c", "<div>" * 2000 + "z")], "page_id long, url string, html string").selectExpr("*", "'h' as host", "'t' as tree", "1 as text")
    pages.write.parquet(f"{root}/full/pages.parquet")
    pages.limit(0).write.parquet(f"{root}/empty/pages.parquet")
    return str(root)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_operators(spark, folder, name):
    run = queries.queries()[name]
    table = "pages" if "html" in name else "documents"
    assert run(spark, f"{folder}/empty").count() == 0
    got = run(spark, f"{folder}/full").collect()
    n = spark.read.parquet(f"{folder}/full/{table}.parquet").count()
    assert len(got) >= n if "packing" in name else len(got) == n


def test_stages(spark, folder):
    for size in ("empty", "full"):
        docs = spark.read.parquet(f"{folder}/{size}/documents.parquet")
        columns = docs.columns
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, f"{folder}/{size}")
            out.write.parquet(f"{folder}/{size}/stage{k}")
            docs = spark.read.parquet(f"{folder}/{size}/stage{k}")
            if k < len(corpus_pipeline.STAGES) - 1:
                assert docs.columns == columns
        assert (docs.count() == 0) == (size == "empty")
    kept = spark.read.parquet(f"{folder}/full/stage1")
    # One of each group of equal words; texts without words and rows without an id stay.
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1) for r in kept.collect()) == [-1, -1, 0, 1, 2, 3, 6, 7, 8, 9, 10]
