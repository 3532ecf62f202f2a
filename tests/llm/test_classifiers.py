"""Held-out accuracy on planted labels, the numerics against plain forms, and odd inputs."""

import random

import numpy as np
from pyspark.sql import functions as F

from gaugeline.llm import boosting, quality, sampling, toxicity

BAD = ["idiot", "scum", "zzrak", "zzrakon", "zzrakel", "zzraktu"]


def corpus(n, seed):
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdefghijklmnoprstu") for _ in range(rnd.randint(2, 9))) for _ in range(700)]
    docs, labels = [], []
    for i in range(n):
        w = [rnd.choice(vocabulary) for _ in range(rnd.randint(20, 200))]
        toxic, junk = i % 5 == 1, i % 7 == 2
        if toxic:
            for _ in range(max(3, len(w) // 20)):
                w.insert(rnd.randrange(len(w)), rnd.choice(BAD))
        if junk:
            w = [rnd.choice((x.upper() + "!!", x + "###", w[0])) for x in w] if i % 2 else [x for x in w[:12] for _ in range(10)]
        docs.append((i, " ".join(w)))
        labels.append((i, int(not junk), int(toxic)))
    return docs, labels


def frames(spark, docs, labels):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out(spark):
    docs, labels = corpus(1500, 1)
    docs += [(5000, None), (5001, ""), (5002, "w"), (5002, "w"), (5003, "long " * 30000)]
    d, l = frames(spark, docs, labels)  # noqa: E741
    truth = {x[0]: x for x in labels}
    for f, column, cut in ((quality.score_documents, 1, 0.7), (toxicity.score_documents, 2, 0.5)):
        rows = f(d, l).collect()
        assert len(rows) == len(docs)
        held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
        assert 150 < len(held) < 600
        assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= cut) for r in rows)
        wrong = sum(r["predicted"] != truth[r["doc_id"]][column] for r in held)
        assert wrong <= 0.03 * len(held)
        assert len({r["score"] for r in rows if r["doc_id"] == 5002}) == 1
        # The same text scores the same under another id, so labels and ids play no part.
        again = f(d.withColumn("doc_id", F.col("doc_id") + 0).union(spark.createDataFrame([(777777, docs[3][1])], d.schema)), l).where("doc_id in (3, 777777)").collect()
        assert len({round(r["score"], 12) for r in again}) == 1


def test_without_labels(spark):
    docs, _ = corpus(30, 2)
    d, l = frames(spark, [*docs, (99, "idiot scum moron idiot scum moron")], [])  # noqa: E741
    assert quality.score_documents(d, l).count() == 31
    t = {r["doc_id"]: r["predicted"] for r in toxicity.score_documents(d, l).collect()}
    assert t[99] == 1 and t[0] == 0
    one = spark.createDataFrame([(1, 1, None), (2, 5, 0), (None, 1, 1), (3, 1, 1), (3, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality.score_documents(d, one).count() == 31 and toxicity.score_documents(d, one).count() == 31
    assert quality.score_documents(d.limit(0), l).count() == 0 and toxicity.score_documents(d.limit(0), l).count() == 0


def test_sample_is_bounded_and_stable(spark):
    docs, labels = corpus(900, 3)
    d, l = frames(spark, docs, labels)  # noqa: E741
    take = lambda parts: {r["doc_id"] for r in sampling.labelled_sample(d.repartition(parts), l.repartition(parts), "toxic", F.lit(True), 100).collect()}
    assert take(2) == take(7) and 60 < len(take(3)) < 150


def test_gaussian_is_the_density():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, len(quality.NAMES))) @ rng.normal(size=(len(quality.NAMES),) * 2)
    g = quality.gaussian(x, x.var(0))
    cov = np.linalg.inv(g.factor.T @ g.factor)
    z = x - g.mean
    want = -0.5 * np.einsum("ij,jk,ik->i", z, np.linalg.inv(cov), z) - 0.5 * np.linalg.slogdet(cov)[1]
    assert np.allclose(g.log_density(x), want)


def test_trees_and_isotonic():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    m = boosting.fit_trees(x[:2000], y[:2000])
    assert ((m.margin(x[2000:]) > 0) == (y[2000:] > 0.5)).mean() > 0.95
    s = rng.normal(size=500)
    t = (rng.random(500) < 1 / (1 + np.exp(-2 * s))).astype(float)
    xs, ps = boosting.fit_isotonic(s, t)
    assert (np.diff(xs) >= 0).all() and (np.diff(ps) >= -1e-12).all()
    # Against the minimax form of isotonic regression.
    order = np.argsort(s, kind="stable")
    v = t[order]
    c = np.concatenate([[0], np.cumsum(v)])
    i = 200
    exact = max(min((c[b + 1] - c[a]) / (b + 1 - a) for b in range(i, 500)) for a in range(i + 1))
    assert abs(np.interp(s[order][i], xs, ps) - exact) < 0.03
