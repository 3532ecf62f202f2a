"""Ids against the library's, the Viterbi fold against all segmentations, and round trips."""

import hashlib
import itertools
import random
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece

from gaugeline.llm import sentencepiece_lattice as sl

LIBRARY = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def texts(seed, n):
    rnd = random.Random(seed)
    syllables = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve é ü ß ción ñ".split()
    marks = [" ", " ", " ", "  ", "    ", "\n", "\t", ". ", ", ", "!!", "-", "(", '"', "1999", "😀", "日本", "\x00", " ", "▁", "</s>", "<0x0A>", "é"]
    out = []
    for _ in range(n):
        t = ""
        for _ in range(rnd.randint(0, 30)):
            t += "".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 6)))
            t = t.title() if rnd.random() < 0.02 else t
            t += rnd.choice(marks)
        out.append(t)
    return [*out, "", " ", "     ", "\n", "a" * 300, "ab" * 200, " " * 70 + "x", "Internationalization internationalization"]


def test_library_ids(spark):
    given = texts(1, 700)
    v = sl.default_vocabulary()
    got = v.encode(given)
    for t, ids in zip(given, got, strict=True):
        assert ids.tolist() == LIBRARY.encode(t), repr(t)
        assert v.decode(ids) == LIBRARY.decode(ids.tolist()) == t.replace("▁", " ")
    df = spark.createDataFrame([*enumerate(given), (9999, None)], "doc_id long, text string").repartition(3)
    for r in sl.encode_documents(df).collect():
        t = given[r["doc_id"]] if r["doc_id"] < 9999 else ""
        assert r["ids"] == LIBRARY.encode(t) and r["n_tokens"] == len(r["ids"])
        assert r["decoded_sha256"] == hashlib.sha256(t.replace("▁", " ").encode()).hexdigest()
    assert sl.encode_documents(df.limit(0)).count() == 0


def test_all_pieces_that_merges_reach():
    v = sl.default_vocabulary()
    units = [p for p in v.ids if not p.startswith("▁▁")]
    assert v.encode_units(units) == [v.by_merges(u) for u in units]


def test_memory_forgets(monkeypatch):
    monkeypatch.setattr(sl, "REMEMBERED", 50)
    v, memory = sl.default_vocabulary(), sl.Memory()
    for seed in range(4):
        given = texts(seed, 20)
        assert [x.tolist() for x in v.encode(given, memory)] == LIBRARY.encode(given)


def test_lattice_looks_only_at_pieces_that_end_there(monkeypatch):
    """Units of all kinds of pieces get the ids that merges give; once pairs are known, no substring is looked up."""
    v, rnd = sl.default_vocabulary(), random.Random(8)
    pieces = [p for p in v.ids if not p.startswith("▁▁")]
    units = ["".join(rnd.choices(pieces, k=rnd.randint(1, 4))) for _ in range(3000)] + ["▁ofblendon", "▁▁x", "é", "日本", "x" * 41, "\x00"]
    assert v.encode_units(units) == [v.by_merges(u) for u in units]
    probes, get = [], sl.HashTable.get
    monkeypatch.setattr(sl.HashTable, "get", lambda self, keys: probes.append(len(keys)) or get(self, keys))
    assert len(v.encode_units(units)) == len(units)
    assert sum(probes) < sum(map(len, units)) / 4


def test_only_merged_units_are_remembered():
    v, memory = sl.default_vocabulary(), sl.Memory()
    given = ["one two  three", "a" * 60 + " b", "z" * 300 + " snow☃︎"] * 2
    assert [x.tolist() for x in v.encode(given, memory)] == LIBRARY.encode(given)
    assert all((len(u) > sl.LONGEST or u.startswith("▁▁") or not v.chars.issuperset(u)) and len(u) < 300 for u in memory.now) and len(memory.now) >= 2


def test_long_units_that_repeat_are_merged_once_a_batch(monkeypatch):
    v, merged = sl.default_vocabulary(), []
    monkeypatch.setattr(sl.Vocabulary, "by_merges", lambda self, u, f=sl.Vocabulary.by_merges: merged.append(u) or f(self, u))
    given = ["-" * 150 + "\n" + "-" * 150] * 20
    assert [x.tolist() for x in v.encode(given)] == LIBRARY.encode(given)
    assert sorted(merged) == ["\n", "-" * 150, "▁" + "-" * 150]


def test_decoding_in_stretches():
    v = sl.default_vocabulary()
    for t in texts(9, 40):
        ids = np.array(LIBRARY.encode(t), dtype=np.int32)
        assert v._bytes_of(ids, 7) == v._bytes_of(ids) and v.decode(ids) == LIBRARY.decode(ids.tolist())


def test_merges_by_a_fold_over_edges(spark):
    """The relational form gives the library's pieces for every word of known characters."""
    v = sl.default_vocabulary()
    units = {u.replace(" ", sl.SPACE) for t in texts(5, 400) for u in sl.UNITS.findall(" " + t)}
    units |= {p for i, p in enumerate(sorted(v.ids)) if i % 40 == 0} | {"▁" + "ab" * 20, "a" * 40, "x"}
    plain = {u for u in units if len(u) <= 60}
    rows = {r["word"]: r["ids"] for r in sl.merged_words(spark.createDataFrame([(u,) for u in plain], "word string"), sl.piece_table(spark, v), v.longest).collect()}
    assert rows == {u: v.by_merges(u) for u in plain if v.chars.issuperset(u)} and len(rows) > 800


def test_units_are_counted(spark):
    given = [*texts(6, 200), None]
    df = spark.createDataFrame([(t,) for t in given], "text string").repartition(3)
    want = Counter(u.replace(" ", sl.SPACE) for t in given if t for u in sl.UNITS.findall(" " + t.replace(sl.SPACE, " ")))
    assert {r["word"]: r["n"] for r in sl.unit_counts(df).collect()} == want
    for most in (0, 5, 40, 10**6):
        got = {r["word"]: r["n"] for r in sl.frequent_units(df, most).collect()}
        assert len(got) <= most and all(want[w] == n for w, n in got.items())
        assert not got or min(got.values()) >= max((n for w, n in want.items() if w not in got and 0 < len(w) <= sl.LONGEST and not w.startswith(sl.SPACE * 2)), default=0)


def test_frequent_units_change_nothing(spark):
    df = spark.createDataFrame([*enumerate(texts(7, 60))], "doc_id long, text string")
    key = lambda frequent: sorted((r["doc_id"], r["ids"], r["decoded_sha256"]) for r in sl.encode_documents(df, frequent=frequent).collect())
    assert key(0) == key(30) == key(100_000)


def test_viterbi_of_unigram_scores(spark):
    rnd = random.Random(2)
    pieces = sorted({"".join(p) for n in (1, 2, 3) for p in itertools.product("abc", repeat=n) if n == 1 or rnd.random() < 0.5})
    scores = [round(-rnd.random() * len(p) ** 0.5 * 3, 4) for p in pieces]
    v = sl.Vocabulary(pieces, scores, {}, [True] * len(pieces), 0, merges=False)
    score = dict(zip(pieces, scores, strict=True))

    def best(u):
        return max((sum(score[u[a:b]] for a, b in itertools.pairwise([0, *cuts, len(u)])) for k in range(len(u)) for cuts in itertools.combinations(range(1, len(u)), k) if all(u[a:b] in score for a, b in itertools.pairwise([0, *cuts, len(u)]))))

    units = ["".join(rnd.choice("abc") for _ in range(rnd.randint(1, 8))) for _ in range(60)]
    for u, ids in zip(units, v.lattice(units), strict=True):
        assert "".join(pieces[i] for i in ids) == u
        assert np.isclose(sum(scores[i] for i in ids), best(u))
    words = spark.createDataFrame([(u,) for u in {*units, "abcz"}], "word string")
    table = spark.createDataFrame([(p, i, s) for i, (p, s) in enumerate(zip(pieces, scores, strict=True))], "piece string, id long, score double")
    rows = {r["word"]: r["ids"] for r in sl.viterbi_words(words, table, 3).collect()}
    assert rows["abcz"] is None
    for u in units:
        assert "".join(pieces[i] for i in rows[u]) == u and np.isclose(sum(scores[i] for i in rows[u]), best(u))
