"""Toxicity: boosted trees over dense features of a text, with isotonic calibration.

Features are densities of lexicon words and stems, closeness of second-person words to them, capitals,
punctuation and obfuscation.  The lexicon is a short list of English words plus the words and stems that the fitting
sample uses far more often where the label is set.  The sample is dealt to three folds, at every size alike: a row's
features for fitting come from a lexicon learnt without its fold, and the calibration from margins of trees that have
not seen its fold either.

Defined cases: a null or empty text is scored by its (zero) features; with fewer than five usable labels of
either class a text is toxic if one word in a hundred is in the lexicon; repeated rows are scored alike; the score
depends on the text alone.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .boosting import Trees, fit_isotonic, fit_trees
from .common import crc_mod, ready
from .sampling import SAMPLE_ROWS, labelled_sample

# Fixed values.
SEED_WORDS = frozenset("idiot idiots stupid moron morons scum trash worthless pathetic disgusting loser losers clown clowns dumb filthy vermin".split())
SECOND_PERSON = frozenset("you your yours yourself youre u ya tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch euer usted ustedes ti tuyo vosotros".split())
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»¡¿…–—“”„‘’"
LOOKALIKES = str.maketrans("013457@$!*", "oieastasi*")
STEMS = (4, 5, 6, 7)
NEAR = 6
LEXICON_SIZE = 3000
#: Rows of either class below which there is nothing to learn from.
LEAST_OF_CLASS = 5
NAMES = (
    "log_words word_hits log_word_hits distinct_hits stem_hits log_stem_hits top_weight mean_weight second_person second_near_hit "
    "capitals shouted exclamations questions other_marks obfuscated unmasked_hits stretched digits word_length"
).split()

_TO_SPACE = str.maketrans(dict.fromkeys(PUNCTUATION, " "))
_STRETCHED = re.compile(r"([^\W\d_])\1{3,}")


@dataclass
class Lexicon:
    words: dict[str, float]
    stems: dict[str, float]


_NOTHING = (0.0, 0.0)


class _Weights(dict):
    """Weight of a token, remembered; the memory is emptied when it has grown to a fixed size."""

    LIMIT = 150_000

    def __init__(self, lexicon: Lexicon):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, token: str) -> tuple[float, float]:
        w = self.lexicon.words.get(token, 0.0)
        s = max((self.lexicon.stems.get(token[:n], 0.0) for n in STEMS if len(token) > n), default=0.0)
        if len(self) >= self.LIMIT:
            self.clear()
        self[token] = (w, s) if w or s else _NOTHING
        return self[token]


def tokens(text: str) -> list[str]:
    return text.lower().translate(_TO_SPACE).split()


def features(texts: list[str], lexicon: Lexicon, memory: _Weights | None = None) -> np.ndarray:
    memory = _Weights(lexicon) if memory is None else memory
    out = np.zeros((len(texts), len(NAMES)))
    for i, text in enumerate(texts):
        toks = tokens(text)
        n = len(toks)
        chars = max(1, len(text))
        hits = [(j, w, s) for j, (w, s) in enumerate(map(memory.__getitem__, toks)) if w or s]
        words = [j for j, w, _ in hits if w]
        stems = [j for j, _, s in hits if s]
        second = [j for j, t in enumerate(toks) if t in SECOND_PERSON]
        marked = np.zeros(n + 1, dtype=bool)
        marked[second] = True
        upper = len(text) - len(text.translate(_NO_CAPITALS))
        odd = _masked(text)
        unmasked = sum(memory[t.lower().translate(LOOKALIKES).strip(PUNCTUATION)][0] > 0 for t in odd)
        out[i] = (
            math.log1p(n),
            len(words) / max(1, n),
            math.log1p(len(words)),
            math.log1p(len({toks[j] for j in words})),
            len(stems) / max(1, n),
            math.log1p(len(stems)),
            max((max(w, s) for _, w, s in hits), default=0.0),
            sum(max(w, s) for _, w, s in hits) / max(1, n),
            len(second) / max(1, n),
            sum(marked[max(0, j - NEAR) : j + NEAR + 1].any() for j, _, _ in hits) / max(1, len(hits)),
            upper / chars,
            sum(map(str.isupper, text.split())) / max(1, n) if upper * 4 > chars else 0.0,
            text.count("!") / chars,
            text.count("?") / chars,
            sum(map(text.count, "#$%&*|")) / chars,
            len(odd) / max(1, n),
            math.log1p(unmasked),
            math.log1p(len(_STRETCHED.findall(text))),
            sum(map(text.count, "0123456789")) / chars,
            sum(map(len, toks)) / max(1, n),
        )
    return out


_NO_CAPITALS = {c: None for c in [*range(65, 91), *range(0xC0, 0xD7), *range(0xD8, 0xDF)]}
_INSIDE = re.compile(r"[^\W\d_][0-9@$*!]+(?=[^\W\d_])")


_BLANK = re.compile(r"\s")


def _masked(text: str) -> list[str]:
    """Words with digits or signs between letters, whole, each once."""
    found, seen = [], 0
    m = _INSIDE.search(text)
    while m:
        # The word begins behind the last white space since the word before.
        lo = max(text.rfind(c, seen, m.start()) for c in " \n\t\r\x0b\x0c")
        end = _BLANK.search(text, m.end())
        hi = end.start() if end else len(text)
        found.append(text[max(lo + 1, seen) : hi].split()[-1])
        seen = hi
        m = _INSIDE.search(text, hi)
    return found


FOLDS = 3


def learn_lexicons(sample: DataFrame, least: int = 4, odds: float = 2.5) -> list[Lexicon]:
    """One lexicon of all rows of (text, y, fold), then one without each fold: words and stems that go with the label, by log
    odds over their uses; at most LEXICON_SIZE of each."""

    def vocabulary(batches):
        for b in batches:
            rows: list[tuple[int, str, int, int, int]] = []
            for text, y, fold in zip(*(b.column(c).to_pylist() for c in ("text", "y", "fold")), strict=True):
                once = Counter(tokens(text or ""))
                rows += [(0, t, fold, y, k) for t, k in once.items()]
                for n in STEMS:
                    some: Counter[str] = Counter()
                    for t, k in once.items():
                        if len(t) > n:
                            some[t[:n]] += k
                    rows += [(n, t, fold, y, k) for t, k in some.items()]
            kinds, terms, folds, ys, times = zip(*rows, strict=True) if rows else ((),) * 5
            yield pa.RecordBatch.from_pydict({"kind": pa.array(kinds, pa.int32()), "term": pa.array(terms, pa.string()), "fold": pa.array(folds, pa.int32()), "y": pa.array(ys, pa.int64()), "times": pa.array(times, pa.int64())})

    size = {(r["fold"], r["y"]): r["count"] for r in sample.groupBy("fold", "y").count().collect()}
    folds = range(FOLDS)
    rows = {y: [size.get((f, y), 0) for f in folds] for y in (0, 1)}
    bad, good = F.col("y") * F.col("times"), (1 - F.col("y")) * F.col("times")
    of = lambda value, f: F.sum(F.when(F.col("fold") == f, value).otherwise(0))
    counted = (
        sample.select("text", "y", "fold")
        .mapInArrow(vocabulary, "kind int, term string, fold int, y bigint, times bigint")
        .groupBy("kind", "term")
        .agg(F.array(*[of(F.col("y"), f) for f in folds]).alias("pos"), F.array(*[of(bad, f) for f in folds]).alias("bad"), F.array(*[of(good, f) for f in folds]).alias("good"))
    )
    total = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x)
    # A stem stands for many words, so it needs more evidence than a word does.
    counted = counted.withColumn("all", total("pos")).where(F.col("all") >= F.when(F.col("kind") == 0, least).otherwise(2 * least)).where(F.log((total("bad") + 0.25) / (total("good") + 0.25)) >= odds - 1 + math.log((sum(rows[1]) + 0.5) / (sum(rows[0]) + 0.5)))
    top = [r for words in (True, False) for r in counted.where((F.col("kind") == 0) == words).orderBy(F.desc("all"), "kind", "term").limit(2 * LEXICON_SIZE).collect()]
    out = []
    for left_out in (None, *folds):
        use = [f for f in folds if f != left_out]
        n0, n1 = (sum(rows[y][f] for f in use) for y in (0, 1))
        lexicon = Lexicon(dict.fromkeys(SEED_WORDS, 8.0), {})
        found: tuple[list, list] = ([], [])
        for r in top if n0 and n1 else ():
            pos, b, g = (sum(r[c][f] for f in use) for c in ("pos", "bad", "good"))
            weight = math.log((b + 0.25) / (n1 + 0.5)) - math.log((g + 0.25) / (n0 + 0.5))
            # Evidence in proportion to the rows that are left.
            if pos >= (least if r["kind"] == 0 else 2 * least) * len(use) / FOLDS and weight >= odds:
                found[r["kind"] > 0].append((-pos, r["term"], weight))
        for table, terms in ((lexicon.words, found[0]), (lexicon.stems, found[1])):
            table.update({t: w for _, t, w in sorted(terms)[:LEXICON_SIZE]})
        out.append(lexicon)
    return out


@dataclass
class Model:
    lexicon: Lexicon
    trees: Trees
    knots: tuple[np.ndarray, np.ndarray]

    def score(self, texts: list[str], memory: _Weights | None = None) -> np.ndarray:
        z = self.trees.margin(features(texts, self.lexicon, memory))
        return np.clip(np.interp(z, *self.knots), 0.0, 1.0)


def fit(docs: DataFrame, labels: DataFrame, usable: Column, rows: int = SAMPLE_ROWS) -> Model:
    """``usable`` says which labelled ids may be learnt from."""
    sample = labelled_sample(docs, labels, "toxic", usable, rows).cache()
    whole, *without = learn_lexicons(sample)
    held = _featured(sample, without)
    sample.unpersist()
    x = np.array([r["x"] for r in held]).reshape(len(held), len(NAMES))
    y, fold = np.array([r["y"] for r in held], dtype=float), np.array([r["fold"] for r in held])
    trees = fit_trees(x, y)
    if min((y == 0).sum(), (y == 1).sum()) < LEAST_OF_CLASS:
        return Model(whole, trees, _by_hand(trees))
    unseen = np.concatenate([fit_trees(x[fold != k], y[fold != k]).margin(x[fold == k]) for k in range(FOLDS)])
    return Model(whole, trees, fit_isotonic(unseen, np.concatenate([y[fold == k] for k in range(FOLDS)])))


def _featured(sample: DataFrame, lexicons: list[Lexicon]):
    """(doc_id, y, fold, x): features of each row by the lexicon of its fold."""

    def run(batches):
        memories = [_Weights(x) for x in lexicons]
        for b in batches:
            made = [features([t or ""], lexicons[f], memories[f])[0] for t, f in zip(b.column("text").to_pylist(), b.column("fold").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "y": b.column("y"), "fold": b.column("fold"), "x": pa.array(made, pa.list_(pa.float64()))})

    return sample.select("doc_id", "y", "fold", "text").mapInArrow(run, "doc_id bigint, y int, fold int, x array<double>").orderBy("doc_id").collect()


def _by_hand(trees: Trees) -> tuple[np.ndarray, np.ndarray]:
    """With hardly a label to learn from: dense use of the lexicon counts as toxic, as one tree says."""
    j = NAMES.index("word_hits")
    inner = 2**trees.depth - 1
    trees.feature, trees.threshold = [np.full(inner, j)], [np.full(inner, 0.01)]
    trees.value, trees.base = [np.concatenate([np.full((inner + 1) // 2, -3.0), np.full((inner + 1) // 2, 3.0)])], 0.0
    return np.array([-3.0, 3.0]), np.array([0.02, 0.9])


def add_score(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """The kept columns and ``_score``."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by LEXICON_SIZE and the number of trees

    def run(batches):
        m = shared.value
        memory = _Weights(m.lexicon)
        names = [*keep, "_score"]
        for b in batches:
            score = m.score([t or "" for t in b.column("_text").to_pylist()], memory)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.array(score, pa.float64())], names=names)

    given = ready(docs).select(*keep, F.col(text).alias("_text"))
    schema = StructType([*(f for f in given.schema.fields if f.name != "_text"), StructField("_score", DoubleType())])
    return given.mapInArrow(run, schema)


def reject(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows, with all their columns, that score below ``least``."""
    shared = ready(docs).sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def run(batches):
        m = shared.value
        memory = _Weights(m.lexicon)
        for b in batches:
            score = m.score([t or "" for t in b.column(names.index("text")).to_pylist()], memory)
            yield b.filter(pa.array(score < least))

    return docs.mapInArrow(run, docs.schema)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's rows; rows whose crc32(doc_id) mod 5 is 0 are never learnt from."""
    model = fit(docs, labels, crc_mod(F.col("doc_id"), 5) != 0)
    scored = add_score(docs, model, ["doc_id"])
    return scored.select(
        "doc_id",
        F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"),
        F.col("_score").alias("score"),
        (F.col("_score") >= 0.5).cast("int").alias("predicted"),
    )
