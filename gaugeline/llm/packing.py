"""Best-fit packing by a configuration linear program.

Documents become token ids plus an end id; longer ones than a sequence are cut.  The histogram of piece lengths,
whose size is that of a sequence at most, decides everything else on the driver: multiplicative weights solve the
configuration program over length classes, with knapsack dynamic programming pricing the next configuration; its
solution is rounded down to whole sequences, and what is left over goes to the fullest sequence that it fits.
Several roundings are made, over classes of lengths and, where lengths are few, over the lengths themselves; the one
with the fewest sequences is the plan.
The plan is a list of (number of sequences, lengths in each), so its size doesn't follow the number of pieces.
Pieces take the plan's slots by their rank among pieces of equal length, counted in salted groups.

Defined cases: a null text counts as empty and packs its end id alone; an empty table packs to nothing; rows that
repeat (equal ids) are packed as pieces of their own; ties between equal lengths go by id, piece and content.
"""

from __future__ import annotations

import base64
import sys
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import materialise, ready

CAPACITY = 2048
END_ID = 0
#: Rows of one length and salt that are ranked together, about.
ROWS_PER_RANK = 20_000
#: Lengths are rounded up to this many tokens in the linear program.
GRAIN = 8
#: Shares of the program's sequences that rounding may take over; the others' pieces fill what those leave open.
SURELY = (0.85, 1.0)
#: Distinct lengths up to which the program is solved over the lengths themselves, and pieces from which on what is left of
#: such a program is solved again.
EXACT_LENGTHS, SOLVED_AGAIN = 64, 200
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"

#: Code points whose class (letter, space, other) no version of Unicode or of a pattern library disputes.
_COMMON = np.zeros(0x250, dtype=bool)
_COMMON[[9, 10, 13, *range(0x20, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x250)]] = True
_COMMON_ASCII = bytes(np.flatnonzero(_COMMON[:128]).astype(np.uint8))
LONG_RUN = 1000


class Encoder:
    """Ids of the byte-level vocabulary.

    The rank file of the same vocabulary gives the same ids several times faster.  It is used for texts of common
    characters without very long runs; others, and any that spell a special token, take the reference library.
    """

    def __init__(self, tokenizer_path: str, ranks_path: str | None, pattern: str | None):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(tokenizer_path)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks_path and pattern:
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def plain(self, text: str) -> bool:
        if text.isascii():
            if text.encode().translate(None, _COMMON_ASCII):
                return False
        else:
            points = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
            if points.max() >= len(_COMMON) or not _COMMON[points].all():
                return False
        if any(s in text for s in self.special):
            return False
        if len(text) < LONG_RUN:
            return True
        sizes = list(map(len, text.split()))
        return max(sizes, default=0) < LONG_RUN and len(text) - sum(sizes) - len(sizes) < LONG_RUN

    def ids(self, text: str) -> array:
        if self.fast is not None and self.plain(text):
            return array("I", self.fast.encode_ordinary(text))
        return array("I", self.whole.encode(text, add_special_tokens=False).ids)


@cache
def default_encoder() -> Encoder:
    """The vocabulary installed with the library of public tokenizers; one per Python worker."""
    import public_tokenizers

    return Encoder(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; only the first may be short of a full sequence."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    return ([(0, first)] if first else []) + [(s, capacity) for s in range(first, n, capacity)]


def pieces_of(docs: DataFrame, encoder=default_encoder, capacity: int = CAPACITY) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder()
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = enc.ids(text or "")
                ids.append(END_ID)
                raw = ids.tobytes() if sys.byteorder == "little" else np.array(ids, dtype="<u4").tobytes()
                for k, (s, n) in enumerate(cut(len(ids), capacity)):
                    for col, v in zip(out, (doc, k, s, n, zlib.crc32(raw[4 * s : 4 * (s + n)])), strict=True):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), *(pa.array(c, pa.int64()) for c in out[2:])], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return ready(docs).select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, PIECES)


def best_configuration(prices: np.ndarray, sizes: np.ndarray, room: int) -> dict[int, int]:
    """Unbounded knapsack by dynamic programming: class -> copies, of the highest total price within ``room``."""
    value = np.zeros(room + 1)
    took = np.full(room + 1, -1)
    order = np.argsort(sizes)
    s, p = sizes[order], prices[order]
    upto = np.searchsorted(s, np.arange(room + 1), side="right")
    for c in range(1, room + 1):
        k = upto[c]
        value[c] = value[c - 1]
        if k:
            v = p[:k] + value[c - s[:k]]
            j = int(v.argmax())
            if v[j] > value[c]:
                value[c], took[c] = v[j], order[j]
    found: dict[int, int] = {}
    c = room
    while c > 0:
        if took[c] < 0:
            c -= 1
            continue
        found[int(took[c])] = found.get(int(took[c]), 0) + 1
        c -= int(sizes[took[c]])
    return found


def solve_program(need: np.ndarray, sizes: np.ndarray, room: int, step: float = 0.1, most: int = 6000) -> dict[tuple[tuple[int, int], ...], float]:
    """Fractional numbers of sequences by configuration that hold as much as ``need``: multiplicative weights.

    The price of a class falls exponentially with how far it has been covered.  Each round adds as much of the
    best-priced configuration as covers ``step`` of its scarcest class.
    """
    done = np.zeros(len(need))
    used: dict[tuple[tuple[int, int], ...], float] = {}
    for _ in range(most):
        share = done / need
        prices = np.exp(-(share - share.min()) / step * 2) / need
        # Pieces of equal standing are worth their size, so full configurations win ties.
        found = best_configuration(prices * sizes, sizes, room)
        key = tuple(sorted(found.items()))
        amount = step * min(need[c] / k for c, k in key)
        used[key] = used.get(key, 0.0) + amount
        for c, k in key:
            done[c] += amount * k
        if (done / need).min() >= 4:
            break
    cover = (done * sizes).sum() / (need * sizes).sum()
    return {k: v / cover for k, v in used.items()}


def best_fit(left: dict[int, int], groups: list[tuple[int, tuple[int, ...]]], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Longest pieces first into the fullest sequence with room; whole groups of equal sequences at a time."""
    by_room: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
    for n, items in groups:
        by_room.setdefault(capacity - sum(items), []).append((n, items))
    for length in sorted(left, reverse=True):
        n = left[length]
        while n > 0:
            room = min((r for r in by_room if r >= length and by_room[r]), default=None)
            if room is None:
                each = capacity // length
                many, rest = divmod(n, each)
                for count, k in ((many, each), (1 if rest else 0, rest)):
                    if count:
                        by_room.setdefault(capacity - k * length, []).append((count, (length,) * k))
                break
            count, items = by_room[room].pop()
            take = min(n, count)
            if count > take:
                by_room[room].append((count - take, items))
            by_room.setdefault(room - length, []).append((take, (*items, length)))
            n -= take
    return [g for some in by_room.values() for g in some]


def _taken(program: dict, left: dict[int, int], sizes: np.ndarray, lengths_of: list[list[int]], surely: float, open_last: bool) -> tuple[dict[int, int], list[tuple[int, tuple[int, ...]]]]:
    """The program's configurations in whole numbers, with actual lengths; what is left, and the sequences.

    Full configurations come first, as often as the program says and the pieces last.  With ``open_last`` a configuration's
    last place stays open: what rounding lengths up to classes has hidden there shows only with actual lengths, by best fit.
    """
    left = dict(left)
    opened: list[tuple[int, tuple[int, ...]]] = []
    for key, amount in sorted(program.items(), key=lambda kv: (-sum(sizes[c] * k for c, k in kv[0]), -kv[1], kv[0])):
        many = int(amount * surely + 1e-9)
        small = min((c for c, _ in key), key=lambda c: sizes[c])
        wanted = [(c, k - (c == small)) for c, k in key] if open_last and sum(k for _, k in key) > 1 else list(key)
        while many > 0:
            # Lengths of each class from its longest that is left, for as many sequences as nothing runs out in.
            items, uses, short = [], {}, False
            for c, k in wanted:
                for length in lengths_of[c]:
                    if got := min(k, left.get(length, 0)):
                        items += [length] * got
                        uses[length] = got
                        k -= got
                short = short or k > 0
            if short or not items:
                break
            times = min(many, *(left[x] // u for x, u in uses.items()))
            for x, u in uses.items():
                left[x] -= u * times
            opened.append((times, tuple(items)))
            many -= times
    return {k: v for k, v in left.items() if v}, opened


def _classes(left: dict[int, int], grain: int, room: int) -> tuple[np.ndarray, np.ndarray, list[list[int]]]:
    """Need, size and lengths (longest first) of each class; a class that rounds up past the room still fits a sequence alone."""
    by_class: dict[int, list[int]] = {}
    for length in sorted(left, reverse=True):
        by_class.setdefault(-(-length // grain), []).append(length)
    classes = sorted(by_class)
    return np.array([sum(left[x] for x in by_class[c]) for c in classes], dtype=float), np.array([min(c, room) for c in classes]), [by_class[c] for c in classes]


def _sequences(groups: list[tuple[int, tuple[int, ...]]]) -> int:
    return sum(n for n, _ in groups)


def plan(histogram: dict[int, int], capacity: int = CAPACITY, grain: int = GRAIN) -> list[tuple[int, tuple[int, ...]]]:
    """(number of sequences, lengths in each) for all pieces of the histogram: the best of several roundings of the program."""
    left = {k: v for k, v in histogram.items() if v > 0}
    groups: list[tuple[int, tuple[int, ...]]] = []
    if full := left.pop(capacity, 0):
        groups.append((full, (capacity,)))
    if not left:
        return groups
    plans = [best_fit(left, [], capacity)]
    if len(left) <= EXACT_LENGTHS:
        plans.append(_solved_again(left, capacity))
    grain = max(1, min(grain, capacity // 64))
    room = capacity // grain
    need, sizes, lengths_of = _classes(left, grain, room)
    program = solve_program(need, sizes, room)
    for surely in SURELY:
        for open_last in (True, False):
            rest, opened = _taken(program, left, sizes, lengths_of, surely, open_last)
            plans.append(best_fit(rest, opened, capacity))
    return groups + min(plans, key=_sequences)


def _solved_again(left: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """The program over the lengths themselves, whose units are their greatest common divisor; whole sequences are taken and the
    program of what is left is solved again, until little is left."""
    unit = int(np.gcd.reduce([*left]))
    room = capacity // unit
    opened: list[tuple[int, tuple[int, ...]]] = []
    best: list[tuple[int, tuple[int, ...]]] | None = None
    while left:
        need, sizes, lengths_of = _classes(left, unit, room)
        rest, more = _taken(solve_program(need, sizes, room, most=1500), left, sizes, lengths_of, 1.0, False)
        done = best_fit(left, list(opened), capacity)
        best = done if best is None or _sequences(done) < _sequences(best) else best
        opened += more
        if not more or sum(rest.values()) < SOLVED_AGAIN:
            left = rest
            break
        left = rest
    done = best_fit(left, opened, capacity)
    return done if best is None or _sequences(done) < _sequences(best) else best


def slots_of(groups: list[tuple[int, tuple[int, ...]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys (length, first rank) of the plan's slots, each with its first sequence and its offset."""
    taken: dict[int, int] = {}
    rows, base = [], 0
    for count, items in groups:
        at = 0
        for length in items:
            first = taken.get(length, 0)
            rows.append((length, first, base, at))
            taken[length] = first + count
            at += length
        base += count
    rows.sort()
    a = np.array(rows, dtype=np.int64).reshape(len(rows), 4)
    return (a[:, 0] << 48) + a[:, 1], a[:, 2], a[:, 3]


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset; ``pieces`` should be a stored table, for it is read twice."""
    histogram = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    keys, first, offset = slots_of(plan(histogram, capacity))
    salts = max(1, -(-sum(histogram.values()) // ROWS_PER_RANK))
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    counts = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("_n")).drop("_n")
    rank = F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32", "start"))
    ranked = salted.withColumn("_rank", rank).join(before, ["length", "_salt"]).withColumn("_rank", F.col("_rank") - 1 + F.col("_before"))
    shared = pieces.sparkSession.sparkContext.broadcast((keys, first, offset))  # bounded by the capacity, not by the rows
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, f, o = shared.value
        for b in batches:
            length, r = b.column("length").to_numpy(), b.column("_rank").to_numpy()
            key = (length << 48) + r
            at = np.searchsorted(k, key, side="right") - 1
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(f[at] + key - k[at]), pa.array(o[at])], names=[*names, "sequence_id", "offset"])

    return ranked.select(*names, F.col("_rank").cast("bigint")).mapInArrow(place, f"{PIECES}, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, encoder=default_encoder, capacity: int = CAPACITY) -> DataFrame:
    return pack_pieces(materialise(pieces_of(docs, encoder, capacity), "pieces"), capacity)
