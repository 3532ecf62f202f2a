"""Packing: every token placed once, no sequence too long or with gaps, near the lower bound."""

import random
from collections import Counter, defaultdict

import numpy as np

from gaugeline.llm import packing


def check(rows, capacity):
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
        by_doc[r["doc_id"]].append((r["piece"], r["start"], r["length"]))
    for spans in by_sequence.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at and n > 0
            at += n
        assert at <= capacity
    for spans in by_doc.values():
        at = 0
        for k, (piece, start, n) in enumerate(sorted(spans)):
            assert (piece, start) == (k, at)
            at += n
    return len(by_sequence)


def test_documents(spark):
    rnd = random.Random(1)
    texts = [" ".join(rnd.choice(["the", "cat", "<|endoftext|>", "é", "日本", "a" * 30, "  ", "\n", "1,000"]) for _ in range(int(rnd.paretovariate(0.6)) % 6000)) for _ in range(400)]
    texts += [None, "", " " * 3000, "x" * 5000, "  　", "\n \t" * 900]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 as piece", "2 as length")
    rows = packing.pack_documents(df.repartition(3)).collect()
    used = check(rows, packing.CAPACITY)
    assert used <= -(-sum(r["length"] for r in rows) // packing.CAPACITY) + 2
    whole = packing.default_encoder().whole
    total = Counter()
    for r in rows:
        total[r["doc_id"]] += r["length"]
    for i, t in enumerate(texts):
        ids = whole.encode(t or "", add_special_tokens=False).ids
        assert list(packing.default_encoder().ids(t or "")) == ids
        assert total[i] == len(ids) + 1
    assert len({r["ids_crc32"] for r in rows if r["doc_id"] in (400, 401)}) == 1


def test_empty_and_repeated(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack_documents(df).count() == 0
    same = spark.createDataFrame([(7, "one two three")] * 50, "doc_id long, text string")
    rows = packing.pack_documents(same).collect()
    assert len(rows) == 50 and len({r["sequence_id"] for r in rows}) == 1
    assert sorted(r["offset"] for r in rows) == list(range(0, 200, 4))


def test_plan_covers_histogram():
    rng = np.random.default_rng(3)
    for many in (1, 40, 3000):
        lengths = np.minimum(64, rng.geometric(0.06, many))
        histogram = Counter(lengths.tolist())
        groups = packing.plan(histogram, capacity=64)
        placed = Counter()
        for n, items in groups:
            assert sum(items) <= 64
            for x in items:
                placed[x] += n
        assert placed == histogram
        assert sum(n for n, _ in groups) <= max(-(-sum(lengths) // 64), sum(lengths > 32)) * 1.01 + 1


def test_lumpy_lengths_take_the_program_whole():
    """Few lengths: the program's sequences are taken as they are."""
    for histogram, best in (({1025: 1000, 1023: 700, 700: 900, 600: 900}, 1500), ({1024: 999}, 500), ({683: 3000, 682: 1500, 1366: 700}, 2200)):
        groups = packing.plan(histogram)
        placed = Counter()
        for n, items in groups:
            assert sum(items) <= packing.CAPACITY
            for x in items:
                placed[x] += n
        assert placed == histogram and sum(n for n, _ in groups) == best


def test_ids_of_common_characters():
    """The faster library is used only where it gives the named tokenizer's ids: every character that it may see, in every
    neighbourhood of kinds, and runs at the bound."""
    enc = packing.default_encoder()
    whole = lambda t: enc.whole.encode(t, add_special_tokens=False).ids
    common = [chr(i) for i in np.flatnonzero(packing._COMMON)]
    rnd = random.Random(8)
    texts = [a + c + b for c in common for a in ("", "a", " ", "1", ".", "\n", "é") for b in ("", "b", " ", "2", "'s", "\t\n")]
    texts += ["".join(rnd.choices(common, k=rnd.randint(1, 60))) for _ in range(20_000)]
    texts += [c * n for c in " \na1.'é" for n in (packing.LONG_RUN - 1, packing.LONG_RUN, packing.LONG_RUN + 1)]
    assert sum(map(enc.plain, texts)) > 0.99 * len(texts)
    for t in texts:
        assert list(enc.ids(t)) == whole(t), t
