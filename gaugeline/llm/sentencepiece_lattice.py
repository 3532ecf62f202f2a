"""SentencePiece encoding and decoding over a lattice of pieces.

A text falls into units that no piece spans: a run of spaces with the word after it, or a line end.  The units of all
texts are counted.  Those that are used most often, FREQUENT of them, are encoded relationally: their substrings of
bounded length are exploded and joined to the piece table, the matches grouped by unit as the edges of its lattice, and a
higher-order aggregate folds the edges into pieces (``merged_words``).  Their ids, a table of bounded size, are handed to
the tasks that encode the texts; these make the other units' ids from the same lattice held in arrays.

For unigram vocabularies the fold is Viterbi: the best sum of scores (``viterbi_words``).  For merge (BPE) vocabularies a
best sum is not what the library computes.  There the fold starts with a boundary at every character and, step by step,
takes the edge of the best rank that spans exactly two parts, until none does.  The array form keeps, at each end
position, the piece that can stand after the last piece of the position where it starts: two pieces can stand side by side
unless, on the way there, a part that ends the left one and a part that starts the right one would have been merged with
each other first.  For every position exactly one piece qualifies; an automaton over the vocabulary names the pieces that end
there, longest first.  Units with runs of spaces, very long ones and ones with
characters outside the vocabulary take the merges themselves, by a priority queue.

Defined cases: null and empty texts have no ids and decode to the empty text; U+2581 is a space, as in the library;
characters outside the vocabulary become byte pieces; rows that repeat are encoded alike.
"""

from __future__ import annotations

import heapq
import re
import uuid
from array import array
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import materialise, ready

SPACE = "▁"
UNITS = re.compile(r" *[^ \n\t\r]+| +|[\n\t\r]")
#: Longest unit that the lattice takes, and most units at once.
LONGEST, AT_ONCE = 40, 20_000
#: Units that are encoded relationally, at most: their ids are broadcast.
FREQUENT = 1 << 18
#: Units of up to so many characters whose merges a worker remembers: so many that it has met lately, and as many from before that.
LONGEST_KEPT, REMEMBERED = 100, 250_000
#: Pairs of pieces whose standing side by side a worker remembers, as a power of two.
CACHE_BITS = 21
_NONE = np.int64(1 << 40)


class HashTable:
    """Open addressing over 64-bit keys, for whole arrays at a time; absent keys give -1."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.shift = np.uint64(64 - max(4, int(len(keys) * 4).bit_length()))
        size = 1 << (64 - int(self.shift))
        self.mask = size - 1
        self.keys, self.values = np.zeros(size, dtype=np.uint64), np.full(size, -1, dtype=np.int64)
        left = np.arange(len(keys))
        at = self._slot(keys)
        while len(left):
            free = self.values[at[left]] < 0
            first = np.zeros(len(left), dtype=bool)
            first[np.unique(at[left], return_index=True)[1]] = True
            put = free & first
            self.keys[at[left[put]]], self.values[at[left[put]]] = keys[left[put]], values[left[put]]
            left = left[~put]
            # A place that has just been filled is looked at again by the others, then passed.
            at[left] = (at[left] + (self.values[at[left]] >= 0)) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0xD6E8FEB86659FD93)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        out = self.values[at].copy()
        wrong = np.flatnonzero((self.keys[at] != keys) & (out >= 0))
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & self.mask
            out[wrong] = self.values[at[wrong]]
            wrong = wrong[(self.keys[at[wrong]] != keys[wrong]) & (out[wrong] >= 0)]
        return out


class Memory:
    """Ids of units: of those in ``fixed``, and of those that took the merges lately, in two generations: what is met again stays,
    what isn't is forgotten with its generation.  Other units take less time in the lattice than in a memory."""

    def __init__(self, fixed: dict[str, bytes] | None = None):
        self.fixed = fixed or {}
        self.now: dict[str, bytes] = {}
        self.past: dict[str, bytes] = {}

    def merged(self, unit: str, merges: Callable[[str], list[int]]) -> bytes:
        if unit in self.now:
            return self.now[unit]
        ids = self.past.get(unit)
        if ids is None:
            ids = array("i", merges(unit)).tobytes()
        if len(unit) <= LONGEST_KEPT:
            if len(self.now) >= REMEMBERED:
                self.past, self.now = self.now, {}
            self.now[unit] = ids
        return ids


class Vocabulary:
    """The piece table of a model, and what the fold needs to know about each piece."""

    def __init__(self, pieces: list[str], scores: list[float], byte_ids: dict[int, int], normal: list[bool], unknown: int, merges: bool = True):
        self.pieces, self.byte_ids, self.unknown, self.merges = pieces, byte_ids, unknown, merges
        self.scores = np.array(scores, dtype=float)
        self.ids = {p: i for i, (p, ok) in enumerate(zip(pieces, normal, strict=True)) if ok}
        order = np.unique(-self.scores, return_inverse=True)[1]
        self.rank = order.reshape(-1).astype(np.int64)
        self.longest = max(map(len, self.ids), default=1)
        self.size = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        self.chars = frozenset(p for p in self.ids if len(p) == 1)
        self.of_byte = {i: b for b, i in byte_ids.items()}
        if merges:
            self._derive()
        self._automaton({p: i for p, i in self.ids.items() if not merges or self.reached[i]})

    @classmethod
    def load(cls, path: str, merges: bool = True) -> Vocabulary:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        normal = [not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) for i in range(n)]
        return cls(pieces, [sp.get_score(i) for i in range(n)], {int(p[3:5], 16): i for i, p in enumerate(pieces) if sp.is_byte(i)}, normal, sp.unk_id(), merges)

    def _automaton(self, usable: dict[str, int]) -> None:
        """States are the beginnings of pieces: the longest one that a text ends with.  ``longest_at`` is the longest piece that a
        text in a state ends with, ``shorter`` the longest one that a piece ends with besides itself.

        Characters of pieces of two and more have columns; any other leads to the empty beginning, state 0.
        """
        self.char_id = np.full(0x110000, -1, dtype=np.int32)
        for p, i in self.ids.items():
            if len(p) == 1:
                self.char_id[ord(p)] = i
        column = {c: k for k, c in enumerate(sorted({c for p in usable if len(p) > 1 for c in p}), 1)}
        self.column = np.zeros(0x110000, dtype=np.int32)
        for c, k in column.items():
            self.column[ord(c)] = k
        at = {p: k for k, p in enumerate(sorted({p[:k] for p in usable if p[0] in column for k in range(len(p) + 1)} | {""}, key=len))}
        names = list(at)
        depth = np.fromiter(map(len, names), dtype=np.int64, count=len(names))
        before = np.array([at[p[:-1]] for p in names])
        by = np.array([column[p[-1]] if p else 0 for p in names])
        own = np.array([usable.get(p, -1) for p in names])
        self.step = np.zeros((len(names), len(column) + 1), dtype=np.min_scalar_type(len(names)))
        rest = np.zeros(len(names), dtype=np.int64)  # the longest state that a state ends with besides itself
        self.longest_at, self.shorter = np.full(len(names), -1, dtype=np.int32), np.full(len(self.pieces), -1, dtype=np.int32)
        for d in range(int(depth[-1]) + 1):
            here, below = np.flatnonzero(depth == d), np.flatnonzero(depth == d + 1)
            if d > 1:
                rest[here] = self.step[rest[before[here]], by[here]]
            if d:
                self.step[here] = self.step[rest[here]]
            self.step[before[below], by[below]] = below
            less = self.longest_at[rest[here]]
            self.longest_at[here] = np.where(own[here] < 0, less, own[here])
            self.shorter[own[here][own[here] >= 0]] = less[own[here] >= 0]

    # -- merges, one unit at a time ------------------------------------------------------------------------------
    def merge(self, unit: str, trace: list | None = None) -> list[str]:
        """Symbols of a unit after all merges: the pair with the best piece first, the leftmost of equals."""
        sym: list[str | None] = list(unit)
        n = len(sym)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda: list[tuple[int, int, int, int]] = []

        def offer(i: int, j: int) -> None:
            p = self.ids.get(sym[i] + sym[j])
            if p is not None:
                heapq.heappush(agenda, (int(self.rank[p]), i, j, len(sym[i]) + len(sym[j])))

        for i in range(n - 1):
            offer(i, i + 1)
        while agenda:
            _, i, j, size = heapq.heappop(agenda)
            if sym[i] is None or sym[j] is None or after[i] != j or len(sym[i]) + len(sym[j]) != size:
                continue
            if trace is not None:
                trace.append((sym[i], sym[j]))
            sym[i], sym[j] = sym[i] + sym[j], None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                offer(i, after[i])
            if before[i] >= 0:
                offer(before[i], i)
        return [s for s in sym if s is not None]

    def by_merges(self, unit: str) -> list[int]:
        out: list[int] = []
        for s in self.merge(unit):
            i = self.ids.get(s)
            if i is not None:
                out.append(i)
            elif self.byte_ids:
                out += [self.byte_ids[b] for b in s.encode()]
            else:
                out.append(self.unknown)
        return out

    def _derive(self) -> None:
        """For each piece the parts that end and that start it on its way through the merges, with the rank at which each is used up."""
        n = len(self.pieces)
        self.reached = np.zeros(n, dtype=bool)
        parts: dict[int, tuple[int, int]] = {}
        for p, i in self.ids.items():
            trace: list = []
            self.reached[i] = len(p) == 1 or self.merge(p, trace) == [p]
            if self.reached[i] and trace:
                parts[i] = (self.ids[trace[-1][0]], self.ids[trace[-1][1]])
        sides = []
        for side in (1, 0):
            rows: list[list[tuple[int, int]]] = []
            for i in range(n):
                row, limit, at = [], int(_NONE), i
                while True:
                    row.append((at, limit))
                    if at not in parts:
                        break
                    limit, at = int(self.rank[at]), parts[at][side]
                rows.append(row)
            depth = max(map(len, rows))
            a = np.full((n + 1, depth), -1, dtype=np.int64)  # the last row is for the start of a unit, where any piece can stand
            b = np.full((n + 1, depth), -1, dtype=np.int64)
            for i, row in enumerate(rows):
                a[i, : len(row)], b[i, : len(row)] = zip(*row, strict=True)
            sides += [a, b]
        self.ends, self.ends_limit, self.starts, self.starts_limit = sides
        keys, ranks = [], []
        for p, i in self.ids.items():
            for k in range(1, len(p)):
                left, right = self.ids.get(p[:k]), self.ids.get(p[k:])
                if left is not None and right is not None:
                    keys.append(left * n + right + 1)
                    ranks.append(int(self.rank[i]))
        self.cached = np.zeros(1 << CACHE_BITS, dtype=np.int64)
        self.pairs = HashTable(np.array(keys, dtype=np.uint64), np.array(ranks, dtype=np.int64))

    def side_by_side(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether the merges of the two pieces' text leave them as they are; answers are kept in a cache of fixed size."""
        key = (left * np.int64(len(self.pieces)) + right + 1) << 1
        slot = ((key.view(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - CACHE_BITS)).view(np.int64)
        known = self.cached[slot]
        ok = known > key  # the answer is the lowest bit
        missed = np.flatnonzero(known >> 1 != key >> 1)
        if len(missed):
            _, first, back = np.unique(key[missed], return_index=True, return_inverse=True)
            some = missed[first]
            found = self._side_by_side(left[some], right[some])
            self.cached[slot[some]] = key[some] + found
            ok[missed] = found[back.reshape(-1)]
        return ok

    def _side_by_side(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        ok = np.ones(len(left), dtype=bool)
        n = np.int64(len(self.pieces))
        for i in range(self.ends.shape[1]):
            for j in range(self.starts.shape[1]):
                live = np.flatnonzero(ok & (self.ends[left, i] >= 0) & (self.starts[right, j] >= 0))
                if not len(live):
                    break
                a, b = left[live], right[live]
                r = self.pairs.get((self.ends[a, i] * n + self.starts[b, j] + 1).astype(np.uint64))
                # The pair merges before either part is used up; of equal ranks the left merge comes first.
                ok[live[(r >= 0) & (r < self.ends_limit[a, i]) & (r <= self.starts_limit[b, j])]] = False
        return ok

    # -- the lattice, many units at once -------------------------------------------------------------------------
    def lattice(self, units: list[str]) -> list[list[int]]:
        """Ids of units of known characters."""
        sizes = np.fromiter(map(len, units), dtype=np.int64, count=len(units))
        flat, counts = self._lattice(np.frombuffer("".join(units).encode("utf-32-le"), dtype="<u4"), np.cumsum(sizes) - sizes, sizes)
        return [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])]

    def _lattice(self, text: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units of known characters, one after the other, and how many each has."""
        order = np.argsort(-sizes, kind="stable")
        starts, longest_first, n = starts[order], sizes[order], len(sizes)
        width = int(longest_first[0])
        # The units that reach a position come first.
        reach = np.searchsorted(-longest_first, -np.arange(width + 1), side="right")
        state = np.zeros(n, dtype=np.int64)
        last = np.zeros((width + 1, n), dtype=np.int32)
        last[0] = len(self.pieces)
        best = np.zeros((width + 1, n if not self.merges else 0))
        for j in range(1, width + 1):
            m = int(reach[j])
            char = text[starts[:m] + (j - 1)]
            state = self.step[state[:m], self.column[char]].astype(np.int64)
            piece = self.longest_at[state]
            piece = np.where(state > 0, piece, self.char_id[char])
            row = np.arange(m)
            top = np.full(m, -np.inf)
            while len(row):
                start = (j - self.size[piece]) * n + row
                if self.merges:
                    fits = self.side_by_side(last.ravel()[start].astype(np.int64), piece)
                    last[j, row[fits]] = piece[fits]
                    row, piece = row[~fits], self.shorter[piece[~fits]]
                else:
                    total = best.ravel()[start] + self.scores[piece]
                    better = total > top[row]
                    top[row[better]], last[j, row[better]] = total[better], piece[better]
                    piece = self.shorter[piece]
                row, piece = row[piece >= 0], piece[piece >= 0]
            if not self.merges:
                best[j, :m] = top
        used = np.zeros((n, width + 1), dtype=bool)
        row, at = np.arange(n), longest_first
        while len(row):
            used[row, at] = True
            at = at - self.size[last[at, row]]
            row, at = row[at > 0], at[at > 0]
        back = np.empty(n, dtype=np.int64)
        back[order] = np.arange(n)
        used, last = used[back], last.T[back]
        return last[used], used.sum(axis=1)

    def encode_units(self, units: list[str]) -> list[list[int]]:
        """Ids of distinct units, spaces written as U+2581."""
        return [np.frombuffer(x, dtype=np.int32).tolist() for x in self.unit_ids(units)]

    def unit_ids(self, units: list[str], memory: Memory | None = None) -> list[bytes]:
        """Ids of units as 32-bit numbers, spaces written as such or as U+2581."""
        memory = Memory() if memory is None else memory
        out = [b""] * len(units)
        sizes = np.fromiter(map(len, units), dtype=np.int64, count=len(units))
        short = sizes <= LONGEST
        text = np.frombuffer("".join(units if short.all() else [u for u in units if len(u) <= LONGEST]).encode("utf-32-le"), dtype="<u4").copy()
        text[text == ord(" ")] = ord(SPACE)
        ends = np.cumsum(np.where(short, sizes, 0))
        starts = ends - sizes
        unknown = np.concatenate([[0], np.cumsum(self.char_id[text] < 0)])
        plain = short & (sizes > 0)
        plain[plain] = unknown[ends[plain]] == unknown[starts[plain]]
        two = np.flatnonzero(plain & (sizes > 1))
        plain[two] = (text[starts[two]] != ord(SPACE)) | (text[starts[two] + 1] != ord(SPACE))
        others = np.flatnonzero(~plain).tolist()
        found = {u: memory.merged(u.replace(" ", SPACE), self.by_merges) for u in {units[i] for i in others}}
        for i in others:
            out[i] = found[units[i]]
        taken = np.flatnonzero(plain)
        taken = taken[np.argsort(sizes[taken], kind="stable")]
        for lo in range(0, len(taken), AT_ONCE):
            some = taken[lo : lo + AT_ONCE]
            flat, counts = self._lattice(text, starts[some], sizes[some])
            data, at = flat.tobytes(), [0, *(4 * np.cumsum(counts)).tolist()]
            for i, x, y in zip(some.tolist(), at, at[1:], strict=False):
                out[i] = data[x:y]
        return out

    def encode(self, texts: list[str], memory: Memory | None = None) -> list[np.ndarray]:
        """Ids of each text; ``memory`` holds ids of units seen before."""
        memory = Memory() if memory is None else memory
        split = [UNITS.findall(" " + t.replace(SPACE, " ")) if t else [] for t in texts]
        units = [u for some in split for u in some]
        ids = list(map(memory.fixed.get, units))
        absent = [i for i, x in enumerate(ids) if x is None]
        for lo in range(0, len(absent), 10 * AT_ONCE):
            some = absent[lo : lo + 10 * AT_ONCE]
            for i, x in zip(some, self.unit_ids([units[i] for i in some], memory), strict=True):
                ids[i] = x
        at = [0, *accumulate(map(len, split))]
        return [np.frombuffer(b"".join(ids[x:y]), dtype=np.int32) for x, y in zip(at, at[1:], strict=False)]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; byte pieces that aren't UTF-8 become U+FFFD."""
        return self._bytes_of(ids).decode("utf-8", "replace").replace(SPACE, " ").removeprefix(" ")

    def _bytes_of(self, ids: np.ndarray, at_once: int = 1 << 18) -> bytes:
        if not hasattr(self, "_raw"):
            raw = [bytes([self.of_byte[i]]) if i in self.of_byte else p.encode() if p in self.ids else b"" for i, p in enumerate(self.pieces)]
            self._raw_size = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
            self._raw_start, self._raw = np.cumsum(self._raw_size) - self._raw_size, np.frombuffer(b"".join(raw), dtype=np.uint8)
        out = []
        for lo in range(0, len(ids), at_once):
            some = ids[lo : lo + at_once]
            size = self._raw_size[some]
            end = np.cumsum(size)
            out.append(self._raw[np.repeat(self._raw_start[some] - end + size, size) + np.arange(end[-1])].tobytes())
        return b"".join(out)


# -- the same lattice as rows, for tables of distinct words and unigram scores -------------------------------------
def lattice_edges(words: DataFrame, pieces: DataFrame, longest: int) -> DataFrame:
    """(word, s, e, id, score): every substring of up to ``longest`` characters that is a piece.

    ``pieces`` (piece, id, score) is a vocabulary, whose size is fixed, so it is the broadcast side.
    """
    n = F.length("word")
    starts = words.select("word", F.explode(F.sequence(F.lit(0), n - 1)).alias("s")).where(n > 0)
    spans = starts.select("word", "s", F.explode(F.sequence(F.col("s") + 1, F.least(F.length("word"), F.col("s") + longest))).alias("e"))
    cut = spans.withColumn("piece", F.substring(F.col("word"), F.col("s") + 1, F.col("e") - F.col("s")))
    return cut.join(F.broadcast(pieces), "piece").select("word", "s", "e", "id", "score")


_MERGES = """
aggregate(sequence(1, n), shiftleft(CAST(1 AS BIGINT), n + 1) - 1, (cuts, i) -> element_at(transform(array(array_min(filter(edges, x ->
    x.e - x.s > 1 AND bit_get(cuts, x.s) = 1 AND bit_get(cuts, x.e) = 1 AND bit_count(shiftright(cuts, x.s + 1) & (shiftleft(CAST(1 AS BIGINT), x.e - x.s - 1) - 1)) = 1))),
    best -> IF(best IS NULL, cuts, cuts ^ shiftleft(shiftright(cuts, best.s + 1) & (shiftleft(CAST(1 AS BIGINT), best.e - best.s - 1) - 1), best.s + 1))), 1))
"""
_PIECES = "transform(filter(sequence(0, n - 1), s -> bit_get(cuts, s) = 1), s -> element_at(filter(edges, x -> x.s = s AND x.e = s + 1 + bit_count((shiftright(cuts, s + 1) ^ (shiftright(cuts, s + 1) - 1))) - 1), 1).id)"


def merged_words(words: DataFrame, pieces: DataFrame, longest: int) -> DataFrame:
    """(word, ids): the pieces that merges leave of each distinct word of 1 to 60 characters; words with a character that is no
    piece are left out.  ``pieces`` has (piece, id, score), the least score merged first.

    Two parts side by side can be merged if together they are a piece, so the edges of a word's lattice are all that its merges
    can make.  The fold's state is the set of boundaries as bits of a number: each step takes the edge with the least
    (score, start) that has exactly one boundary inside, and removes that boundary.
    """
    n = F.length("word")
    edges = lattice_edges(words.where(n.between(1, 60)), pieces, longest)
    grouped = edges.groupBy("word").agg(F.collect_list(F.struct("score", "s", "e", "id")).alias("edges")).withColumn("n", n)
    known = grouped.where(F.size(F.filter("edges", lambda x: x["e"] - x["s"] == 1)) == F.col("n"))
    return known.withColumn("cuts", F.expr(_MERGES)).select("word", F.expr(_PIECES).alias("ids"))


def unit_counts(docs: DataFrame, chars: int = 4_000_000) -> DataFrame:
    """(word, n): how often each unit of the texts is used, spaces written as U+2581.  Counted by stretches of texts before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        size = 0

        def counted() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"word": pa.array([u.replace(" ", SPACE) for u in seen], pa.string()), "n": pa.array(list(seen.values()), pa.int64())})

        for b in batches:
            for t in b.column(0).to_pylist():
                if t:
                    given = " " + t.replace(SPACE, " ")
                    seen.update(UNITS.findall(given) if len(t) < chars else (m[0] for m in UNITS.finditer(given)))
                    size += len(t)
                if size >= chars:
                    yield counted()
                    seen, size = Counter(), 0
        if seen:
            yield counted()

    return ready(docs).select("text").mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_units(docs: DataFrame, most: int) -> DataFrame:
    """(word, n) of units that the lattice takes, used twice or more: all that are used at least so often that no more than ``most`` are."""
    plain = F.col("n").between(2, 2**62) & F.length("word").between(1, LONGEST) & ~F.startswith(F.col("word"), F.lit(SPACE * 2))
    counted = materialise(unit_counts(docs).where(plain), "units")
    # How many units are used how often: as many rows as there are different counts, of which the largest are few.
    by_count = counted.groupBy("n").agg(F.count("*").alias("units")).withColumn("upto", F.sum("units").over(Window.orderBy(F.desc("n"))))
    least = by_count.where(F.col("upto") <= most).agg(F.min("n")).first()[0]
    return counted.where(F.col("n") >= (2**62 if least is None else least))


def viterbi_words(words: DataFrame, pieces: DataFrame, longest: int) -> DataFrame:
    """(word, ids): the segmentation of each distinct, non-empty word with the best sum of scores; null if there is none.

    The edges of a word come together in order of their ends and a higher-order aggregate folds them: the state holds, for
    each position, the best sum up to it and the edge that reached it.
    """
    grouped = lattice_edges(words, pieces, longest).groupBy("word").agg(F.array_sort(F.collect_list(F.struct("e", "s", "id", "score"))).alias("edges"))
    n = F.length("word")
    start = F.transform(F.sequence(F.lit(0), n), lambda i: F.struct(F.when(i == 0, 0.0).otherwise(float("-inf")).alias("best"), F.lit(-1).alias("back"), F.lit(-1).cast("bigint").alias("id")))

    def step(acc, x):
        total = F.get(acc, x["s"])["best"] + x["score"]
        taken = F.struct(total.alias("best"), x["s"].alias("back"), x["id"].cast("bigint").alias("id"))
        return F.when(total > F.get(acc, x["e"])["best"], F.transform(acc, lambda a, i: F.when(i == x["e"], taken).otherwise(a))).otherwise(acc)

    def walk(path):
        first = F.struct(F.length("word").alias("at"), F.array().cast("array<bigint>").alias("ids"))

        def back(b, _):
            here = F.get(path, b["at"])
            return F.when(b["at"] <= 0, b).otherwise(F.struct(here["back"].alias("at"), F.concat(F.array(here["id"]), b["ids"]).alias("ids")))

        return F.aggregate(F.sequence(F.lit(1), F.length("word")), first, back, lambda b: F.when(b["at"] == 0, b["ids"]))

    folded = grouped.withColumn("path", F.aggregate("edges", start, step))
    return folded.select("word", F.when(F.get("path", F.length("word"))["best"] > float("-inf"), walk(F.col("path"))).alias("ids"))


@cache
def default_vocabulary() -> Vocabulary:
    """The merge vocabulary installed with the library of public tokenizers; one per Python worker."""
    import public_tokenizers

    return Vocabulary.load(public_tokenizers.path("piece_bpe_32k.model"))


def piece_table(spark: SparkSession, vocabulary: Vocabulary) -> DataFrame:
    """(piece, id, score): pieces that merges can make, with the rank of each as score."""
    return spark.createDataFrame([(p, i, float(vocabulary.rank[i])) for p, i in vocabulary.ids.items()], "piece string, id bigint, score double")


def encode_documents(docs: DataFrame, vocabulary=default_vocabulary, chars: int = 1_500_000, frequent: int | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256): ids of every whole text and a digest of the text that they decode to."""
    spark = ready(docs).sparkSession
    v = vocabulary()
    units = merged_words(frequent_units(docs.select("text"), FREQUENT if frequent is None else frequent).select("word"), piece_table(spark, v), v.longest)
    found = units.select(F.translate("word", SPACE, " ").alias("word"), F.col("ids").cast("array<int>").alias("ids")).toArrow()  # at most FREQUENT
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, found.schema) as out:
        out.write_table(found)
    shared, name = spark.sparkContext.broadcast(sink.getvalue().to_pybytes()), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        v = vocabulary()
        memory = Memory(_known(name, shared))
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            lo = 0
            while lo < len(texts):
                hi, size = lo, 0
                while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= chars):
                    size += len(texts[hi])
                    hi += 1
                ids = v.encode(texts[lo:hi], memory)
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                sha = [hashlib.sha256(v.decode(x).encode()).hexdigest() for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), pa.array(np.diff(offsets), pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids), pa.int32())), pa.array(sha, pa.string())],
                    names=["doc_id", "n_tokens", "ids", "decoded_sha256"],
                )
                lo = hi

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, n_tokens bigint, ids array<int>, decoded_sha256 string")


_units: dict[str, dict[str, bytes]] = {}


def _known(name: str, shared) -> dict[str, bytes]:
    """The broadcast table as a dictionary, made once in a worker."""
    if name not in _units:
        _units.clear()
        table = pa.ipc.open_stream(shared.value).read_all()
        ids = table.column("ids").combine_chunks()
        flat, at = ids.values.to_numpy().astype(np.int32).tobytes(), ids.offsets.to_numpy().tolist()
        _units[name] = {w: flat[4 * x : 4 * y] for w, x, y in zip(table.column("word").to_pylist(), at, at[1:], strict=False)}
    return _units[name]
