"""The pipeline on a small planted corpus, each stage against plain Python."""

import hashlib
import random
import re

import corpus_pipeline
from gaugeline.llm import packing

from .test_substring_dedup import brute

BAD = "idiot moron scum worthless trash pathetic".split()


def plant(spark, folder):
    rnd = random.Random(9)
    vocabulary = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(2, 8))) for _ in range(900)]
    prose = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    passage = prose(60)
    docs, labels, toxic = [], [], set()
    for i in range(240):
        w = prose(rnd.randint(30, 200))
        if i % 6 == 0:
            toxic.add(i)
            for _ in range(max(4, len(w) // 8)):
                w.insert(rnd.randrange(len(w)), rnd.choice(BAD))
        elif i % 6 == 1:
            w[10:10] = passage
        elif i % 6 == 2:
            w.insert(5, "ann.lee@example.org")
        docs.append((i, " ".join(w), "en", "s", 0))
        if i % 5:
            labels.append((i, 1, int(i in toxic)))
    docs.append((900, docs[3][1] + " extra", "en", "s", 0))
    docs.append((901, docs[4][1], "en", "s", 0))
    docs += [(902, "", "en", "s", 0), (903, None, None, None, None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return {d[0]: d[1] for d in docs}, toxic, " ".join(passage)


def test_stages(spark, tmp_path):
    texts, toxic, passage = plant(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    seen = []
    for k, (_name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/out{k}")
        docs = spark.read.parquet(f"{tmp_path}/out{k}")
        seen.append(docs.collect())
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    kept = {r["doc_id"] for r in seen[0]}
    assert kept == set(texts) - toxic
    unique = {r["doc_id"] for r in seen[1]}
    assert unique == kept - {900, 901}
    deduped = {r["doc_id"]: r["text"] for r in seen[2]}
    assert sum(passage in (t or "") for t in deduped.values()) == 1
    want = brute([(r["doc_id"], r["text"]) for r in seen[1]])
    for doc, total, gone, sha in want:
        if gone:
            assert hashlib.sha256(deduped[doc].encode()).hexdigest() == sha and len(deduped[doc].split()) == total - gone
        else:
            assert deduped[doc] == texts[doc]
    masked = {r["doc_id"]: r for r in seen[3]}
    for i, t in deduped.items():
        assert masked[i]["text"] == (t and re.sub(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "[EMAIL]", t))
        assert masked[i]["n_chars"] == (None if t is None else len(masked[i]["text"]))
    whole = packing.default_encoder()
    assert {r["doc_id"]: r["length"] for r in seen[4]} == {i: len(whole.ids(r["text"] or "")) + 1 for i, r in masked.items()}
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == sorted(masked)
