"""Every word's fate against a dictionary of all windows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from gaugeline.llm import substring_dedup as sd, wordhash

W = sd.WINDOW


def brute(docs):
    seen, out = {}, []
    for doc, text in docs:
        words = (text or "").encode().split()
        for s in range(len(words) - W + 1):
            k = tuple(words[s : s + W])
            seen[k] = min(seen.get(k, (doc, s)), (doc, s))
    for doc, text in docs:
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for s in range(len(words) - W + 1):
            if seen[tuple(words[s : s + W])] < (doc, s):
                gone[s : s + W] = [True] * W
        kept = [w for w, g in zip(words, gone, strict=True) if not g]
        out.append((doc, len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out)


def corpus(seed, n):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["é", "😀", "x"]
    passage = [rnd.choice(vocabulary) for _ in range(60)]
    texts = []
    for i in range(n):
        words = [rnd.choice(vocabulary) for _ in range(rnd.randint(0, 120))]
        if i % 3 == 0:
            at = rnd.randint(0, len(words))
            lo = rnd.randint(0, 30)
            words[at:at] = passage[lo : lo + rnd.randint(19, 30)]
        if i % 11 == 0 and texts:
            words = texts[rnd.randrange(len(texts))].split()
        if i % 17 == 0:
            words += ["again"] * rnd.randint(18, 60)
        if i % 19 == 0:
            words += ["a", "b", "c"] * 15
        texts.append(rnd.choice([" ", "\n", " \t "]).join(words))
    return texts + [None, "", " \n ", "one two", "\x0b".join(passage), " ".join(passage)]


def test_against_all_windows(spark):
    texts = corpus(4, 400)
    docs = list(zip(random.Random(2).sample(range(100000), len(texts)), texts, strict=True))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = sorted(tuple(r) for r in sd.dedup_digest(df).collect())
    assert got == brute(docs)
    assert sum(x[2] for x in got) > 1000


@pytest.mark.parametrize("hot", [0, 2])
def test_long_texts_and_lengthened_prefixes(spark, monkeypatch, hot):
    """Texts that are cut into parts, groups of few suffixes, prefixes that are lengthened, and a short memory of sent nodes."""
    for name, value in (("HOT_RUNS", hot), ("GROUP_RUNS", 5), ("PART_WORDS", 37), ("REMEMBERED", 50), ("FLUSH_BYTES", 2000)):
        monkeypatch.setattr(sd, name, value)
    monkeypatch.setattr(wordhash, "HASHED_AT_ONCE", 16)
    texts = corpus(9, 150) + [" ".join(corpus(3, 30)[:30:2]), "w " * 300 + "long" * 50]
    docs = [(i * 7 % 1009, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    # Workers get the values with the functions' globals only where the module is theirs, so the parts are run here.
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([d for d, _ in docs]), "__key": pa.array(range(len(docs)), pa.int64()), "text": pa.array([t for _, t in docs])})
    digits = 6
    sent = [r for i in range(0, len(docs), 40) for b in sd._prefix_rows(digits)(iter([batch.select(["text"]).slice(i, 40)])) for r in b.to_pylist()]
    counts = Counter()
    for r in sent:
        n = len(r["payload"]) // 5
        for x, times in zip(memoryview(r["payload"][: 4 * n]).cast("I"), r["payload"][4 * n :], strict=True):
            counts[r["bucket"] << 32 | x] += times
    bitmaps = []
    for least in (1, hot):
        bits = bytearray(1 << (sd.MAP_BITS - 3))
        for x, n in counts.items():
            if n > least:
                at = x >> (digits + 32 - sd.MAP_BITS)
                bits[at >> 3] |= 128 >> (at & 7)
        bitmaps.append(bytes(bits))

    class Shared:
        value = tuple(bitmaps)

    rows = [r for i in range(0, len(docs), 40) for b in sd._suffix_rows(digits, Shared)(iter([batch.slice(i, 20), batch.slice(i + 20, 20)])) for r in b.to_pylist()]
    spans = {}
    for bucket in {r["bucket"] for r in rows}:
        mine = [r for r in rows if r["bucket"] == bucket]
        table = pa.table({"bucket": pa.array([bucket] * len(mine), pa.int32()), "kind": pa.array([r["kind"] for r in mine], pa.int32()), "payload": pa.array([r["payload"] for r in mine], pa.binary())})
        for m in sd._marks((pa.scalar(bucket),), table).to_pylist():
            spans.setdefault((m["__id"], m["__key"]), []).append(m["__spans"])
    whole = pa.RecordBatch.from_pydict({"text": batch.column(2), "__spans": pa.array([spans.get((d, i)) for i, (d, _) in enumerate(docs)], pa.list_(pa.binary()))})
    got = sorted((d, n, gone, hashlib.sha256(kept).hexdigest()) for (d, _), (n, gone, kept) in zip(docs, sd.kept_words(whole, "text", "__spans"), strict=True))
    assert got == brute(docs)
    monkeypatch.undo()
    assert sorted(tuple(r) for r in sd.dedup_digest(df).collect()) == got


def test_nodes_are_equal_for_equal_words():
    words = ("a b c " * 20 + "é " * 30 + "a b c " * 10).encode()
    starts = np.arange(0, 101)
    node = sd.nodes_of([words[:60], words[60:]], starts)
    split = words.split()
    assert {(x, y) for x in range(101) for y in range(101) if node[x] == node[y]} == {(x, y) for x in range(101) for y in range(101) if split[x : x + W] == split[y : y + W]}


def test_columns_stay_and_cases(spark):
    long = " ".join(f"z{i}" for i in range(30))
    rows = [(1, long, "en", 5), (2, "start " + long + " end", "x", None), (2, "start " + long + " end", "x", None), (3, "short  text", None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _starts string, n int").withColumnRenamed("_starts", "bucket")
    out = sorted(sd.dedup_texts(df).collect(), key=lambda r: (r["doc_id"], r["text"]))
    assert [r["text"] for r in out] == [long, "start end", "start end", "short  text"]
    assert out[1]["bucket"] == "x" and len(out[0]) == 4
    assert sd.dedup_texts(df.limit(0)).count() == 0
