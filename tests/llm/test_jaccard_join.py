"""Components and set sizes against all pairs of sets."""

import random
import re

import pytest

from gaugeline.llm import components as components_module, jaccard_join as jj
from gaugeline.llm.components import components


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(docs):
    sets = [(d, shingles(t)) for d, t in docs]
    parent = {d: d for d, _ in docs}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[i + 1 :]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                ra, rb = sorted((find(a), find(b)))
                parent[rb] = ra
    return sorted((d, len(s), find(d)) for d, s in sets)


def edit(rnd, words, share):
    out = list(words)
    for _ in range(int(len(out) * share) + rnd.randint(0, 1)):
        if out:
            i = rnd.randrange(len(out))
            r = rnd.random()
            if r < 0.4:
                out[i] = f"e{rnd.randrange(10**6)}"
            elif r < 0.7:
                del out[i]
            else:
                out.insert(i, f"i{rnd.randrange(10**6)}")
    return out


def corpus(seed, n):
    rnd = random.Random(seed)
    word = lambda: f"w{int(rnd.paretovariate(0.7)) % 2000}"
    base = [word() for _ in range(150)]
    common = [word() for _ in range(40)]
    texts = []
    for i in range(n):
        r = rnd.random()
        if r < 0.35:  # one large group of near copies, around the threshold
            w = edit(rnd, base, rnd.choice([0, 0.005, 0.01, 0.02, 0.03, 0.04, 0.06]))
            if rnd.random() < 0.3:
                w = w[: int(len(w) * rnd.uniform(0.6, 1))]
        elif r < 0.55 and texts:
            w = edit(rnd, rnd.choice(texts).split(), rnd.choice([0, 0.01, 0.03]))
        else:
            w = [word() for _ in range(rnd.choice([0, 1, 3, 5, 6, 20, 80]))]
            if rnd.random() < 0.4:
                w += common
        if rnd.random() < 0.05:
            w = [x.upper() for x in w]
        texts.append(rnd.choice([" ", "\n"]).join(w))
    return texts + [None, "", "  ", "É é", "é É", "one TWO", "One two"]


def test_against_all_pairs(spark):
    for seed in (1, 2):
        texts = corpus(seed, 500)
        docs = list(zip(random.Random(seed).sample(range(10**6), len(texts)), texts, strict=True))
        df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
        got = sorted(tuple(r) for r in jj.document_components(df).collect())
        assert got == brute(docs)


def test_copies_of_a_passage_that_longer_documents_hold(spark):
    rnd = random.Random(5)
    words = lambda n: [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    common, texts = words(300), []
    for _ in range(6):
        passage = words(100)
        for _ in range(12):
            at = rnd.randrange(100)
            texts.append(passage[:at] + words(1) + passage[at + 1 :])
        # The passage is rarer than the rest of these, so it is in their prefixes too; none is like the passage alone.
        texts += [passage + words(1) + common for _ in range(20)]
    docs = [(i, " ".join(t)) for i, t in enumerate(texts)]
    got = sorted(tuple(r) for r in jj.document_components(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect())
    assert got == brute(docs)


def _class_of(text):
    (one,) = jj._sets(jj.block_of([text.encode()]))
    return jj._class_of(one)


def test_a_pivot_that_is_linked_with_none_of_its_list(spark):
    """A long text that holds both passages has the least class, so it is the pivot of the lists of both."""
    x, z = [f"x{i}" for i in range(200)], [f"z{i}" for i in range(600)]
    near = [" ".join([*x[:i], f"c{i}", *x[i + 1 :]]) for i in range(3, 195, 16)]
    alike = [" ".join([*z[:i], f"d{i}", *z[i + 1 :]]) for i in range(5, 595, 20)]
    least = min(map(_class_of, near))
    both = next(t for t in (" ".join([*x, *z, f"tail{k}"]) for k in range(10_000)) if _class_of(t) < least)
    docs = list(enumerate([*near, *alike, both]))
    got = sorted(tuple(r) for r in jj.document_components(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect())
    assert got == brute(docs)
    assert {c for d, _, c in got if d < len(near)} == {0}


@pytest.mark.parametrize("rows", [3, 7])
def test_lists_in_blocks(spark, monkeypatch, rows):
    """Lists that are dealt to many blocks of askers and members give the same links."""
    monkeypatch.setattr(jj, "ROWS_PER_BLOCK", rows)
    texts = corpus(11, 250)
    docs = list(zip(random.Random(11).sample(range(10**6), len(texts)), texts, strict=True))
    got = sorted(tuple(r) for r in jj.document_components(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect())
    assert got == brute(docs)


def test_cases(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert jj.document_components(df).count() == 0
    rows = [(5, "a b c", "x"), (5, "a b c", "x"), (3, "A b  c", "y"), (9, None, "z"), (1, "", "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, cid string")
    assert sorted(tuple(r) for r in jj.document_components(df).collect()) == [(1, 0, 1), (3, 1, 3), (5, 1, 3), (5, 1, 3), (9, 0, 9)]
    kept = sorted(tuple(r) for r in jj.one_of_each(df).collect())
    assert kept == [(1, "", "q"), (3, "A b  c", "y"), (9, None, "z")]


def test_components_with_hot_keys(spark, monkeypatch):
    """Stars whose centres are hot, chains between them, links that repeat and loops."""
    monkeypatch.setattr(components_module, "HOT_ROWS", 3)
    rnd = random.Random(4)
    links = [(c, 1000 * (i + 1) + k) for i, c in enumerate((5, 900_000, 77)) for k in range(40)] + [(1039, 2000), (2039, 900_000), (8, 8), (500_000, 500_001), (None, 3)]
    links += rnd.sample(links, 20)
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for u, v in links:
        if u is not None and u != v:
            a, b = sorted((find(u), find(v)))
            parent[b] = a
    got = {tuple(r) for r in components(spark.createDataFrame(links, "u long, v long").repartition(3)).collect()}
    assert got == {(x, find(x)) for x in list(parent)}


def test_components_settle_or_fail(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(60)], "u long, v long")
    assert {tuple(r) for r in components(path).collect()} == {(i, 0) for i in range(61)}
    with pytest.raises(RuntimeError):
        components(path, most_rounds=2)
