"""Sketches against exact shingle sets; edited texts against plain slicing."""

import hashlib
import random

from pyspark.sql import functions as F

from gaugeline.llm import fingerprint as fp


def shingles(t):
    w = t.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def jaccard(a, b):
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def test_contract_rows(spark, monkeypatch):
    monkeypatch.setattr(fp, "ROWS_PER_BUCKET", 16)
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(400)] + ["é", "😀"]
    docs = []
    for i in rnd.sample(range(-50, 10_000), 150):
        docs.append((i, " ".join(rnd.choice(words) for _ in range(rnd.choice([0, 1, 3, 4, 5, 6, 40, 120, 600])))))
    docs[7] = (docs[7][0], None)
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, a string").repartition(4)
    rows = {r["doc_id"]: r for r in fp.fingerprint_documents(df).collect()}
    assert len(rows) == len(docs)
    order = [(d, t or "") for d, t in sorted(docs)]
    off = []
    by_text = {}
    for (d, t), (_, following) in zip(order, order[1:] + order[:1], strict=True):
        q = len(t) // 4
        edited = t[: len(t) - q] + following[:q]
        r = rows[d]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        for name, other in (("near_edited", edited), ("near_next", following)):
            exact = jaccard(shingles(t), shingles(other))
            off.append(abs(r[name] - exact))
            if len(shingles(t) | shingles(other)) <= fp.K:
                assert abs(r[name] - exact) < 1e-12
        n = len(shingles(t))
        assert abs(r["n_shingles_estimate"] - n) <= max(0, 0.4 * n if n >= fp.K else 0)
        assert by_text.setdefault(t, r["fingerprint"]) == r["fingerprint"]
    assert max(off) < 0.2 and sum(off) / len(off) < 0.02


def test_cases(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert fp.fingerprint_documents(df).count() == 0
    one = spark.createDataFrame([(1, "abcd efgh")], "doc_id long, text string")
    (r,) = fp.fingerprint_documents(one).collect()
    assert r["edited_sha256"] == hashlib.sha256(b"abcd efab").hexdigest() and r["near_next"] == 1.0
    same = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c"), (2, "")], "doc_id long, text string")
    assert fp.fingerprint_documents(same).count() == 4


def test_parts_merge(spark):
    words = [f"x{i}" for i in range(900)]
    whole = " ".join(words)
    parts = [(1, " ".join(words[i : i + 304])) for i in range(0, 900, 300)] + [(2, "one two")]
    df = spark.createDataFrame(parts, "k int, t string").select("k", fp.sketch(F.col("t")).alias("sketch"))
    merged = {r["k"]: r["sketch"] for r in fp.merge_parts(df, "k").collect()}
    want = spark.createDataFrame([(1, whole), (2, "one two")], "k int, t string").select("k", fp.sketch(F.col("t")).alias("s"))
    assert merged == {r["k"]: r["s"] for r in want.collect()}
    a, b = fp.sketch(F.lit(" ".join(words[:400]))), fp.sketch(F.lit(whole))
    r = spark.range(1).select(fp.containment(a, b).alias("c"), fp.resemblance(a, b).alias("r")).first()
    assert r["c"] > 0.8 and 0.25 < r["r"] < 0.65


def test_many_rows_of_one_id(spark, monkeypatch):
    """Rows of one id are dealt to many buckets; each has exactly one successor, and all form one ring."""
    monkeypatch.setattr(fp, "ROWS_PER_BUCKET", 4)
    docs = [(None if i % 3 else 7, f"text {i} " * 3) for i in range(120)] + [(i, f"other {i}") for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    ahead = fp.with_next(df)
    assert len(ahead.columns) == 3
    rows = [(r["text"], r["next_text"]) for r in ahead.collect()]
    following = dict(rows)
    assert len(rows) == len(docs) and sorted(following.values()) == sorted(t for _, t in docs)
    at, seen = docs[0][1], 0
    while seen == 0 or at != docs[0][1]:
        at, seen = following[at], seen + 1
    assert seen == len(docs)
