"""N-gram Jaccard join: all links between sets of five-word shingles with similarity 0.75 or more, by set relations.

1. Every text becomes its set of shingle hashes; equal sets form a class, and everything below is about classes.
   A sketch of fixed size estimates how frequent each shingle is, and orders shingles from rare to frequent.
   Any order is right; this one keeps common passages out of the prefixes.
2. Two linked sets share shingles among the first n - ceil(0.75 n) + 1 of each in that order.  Those prefixes go
   to index lists.  A short list is joined by itself, where blocks of sizes and positions that can't reach the
   overlap needed are skipped; a long list joins every set with one pivot.  Pairs whose prefixes can't share as
   many shingles as linked sets' must are dropped.
3. Every set is compared with its likeliest partner, and links give components.  Of the other pairs only those
   that are still apart are compared.
4. Two sets of one long list that are still apart are related through their pivot: their overlaps with it bound,
   from both sides, the overlap of the two (answers derived from a similar set's answers).  What the bounds leave
   open, an index over the list's sets answers.  Components again, over all links.

Nothing is sampled or capped: a pair is left out only if a bound excludes it or both sets are in one component
already.  Sets are compared by 48 bits of each shingle hash.

Defined cases: null and blank texts have no set and no links; texts of one to four words have one shingle; equal
texts and equal sets are linked; rows that repeat an id are one document; extra columns are ignored or kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import folded_slices, materialise, ready
from .components import components, join_hot
from .substring_dedup import _pack, _unpack, buckets_for
from .wordhash import Block, block_of, blocks, mix

SHINGLE = 5
#: Least similarity, as a fraction.
PART, WHOLE = 75, 100
#: Cells of the frequency sketch, and bits of the map of classes that have candidates; both of fixed size.
CELL_BITS, MAP_BITS = 20, 25
_SLICE_BITS = 4
#: Longest list that is joined by itself.
SHORT_LIST = 8
#: Shingles by which counts may fall short, should two of a set share their 38 bits in the index.
SLACK = 2
#: Members of a list that one task asks, and that ask there.
ROWS_PER_BLOCK = 2_000


def _sets(block: Block) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    runs = block.runs(SHINGLE)
    out = []
    for lo, hi in zip(block.first[:-1].tolist(), block.first[1:].tolist(), strict=True):
        if hi - lo >= SHINGLE:
            out.append(np.unique(runs[lo : hi - SHINGLE + 1]))
        elif hi > lo:
            out.append(block.between(np.array([lo]), np.array([hi])))
        else:
            out.append(runs[:0])
    return out


def _class_of(s: np.ndarray) -> int:
    """Class id: a hash of the set."""
    total = int(mix(s).sum(dtype=np.uint64)) ^ (len(s) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    return int(mix(np.array([total], dtype=np.uint64))[0].view(np.int64))


def _text_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for rows, texts in blocks(batches):
        yield rows, _sets(block_of([t.lower() for t in texts]))


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Class and size of each text; after a task's last text, its part of the frequency sketch."""
    counts = np.zeros(1 << CELL_BITS, dtype=np.uint32)
    width = 1 << (CELL_BITS - _SLICE_BITS)
    any_text = False
    for rows, sets in _text_sets(batches):
        any_text = True
        counts += np.bincount((np.concatenate(sets) >> np.uint64(64 - CELL_BITS)).astype(np.int64), minlength=len(counts)).astype(np.uint32)
        nothing = pa.nulls(len(sets))
        yield pa.RecordBatch.from_pydict(
            {
                "doc_id": rows.column(0),
                "n": pa.array(list(map(len, sets)), pa.int64()),
                "cid": pa.array([_class_of(s) for s in sets], pa.int64()),
                "part": nothing.cast(pa.int32()),
                "counts": nothing.cast(pa.binary()),
            }
        )
    if any_text:
        seen = np.minimum(counts, 255).astype(np.uint8).reshape(-1, width)
        m = len(seen)
        yield pa.RecordBatch.from_pydict({"doc_id": pa.nulls(m).cast(pa.int64()), "n": pa.nulls(m).cast(pa.int64()), "cid": pa.nulls(m).cast(pa.int64()), "part": pa.array(range(m), pa.int32()), "counts": pa.array([x.tobytes() for x in seen], pa.binary())})


def _levels(profile: DataFrame) -> bytes:
    """One byte a cell: how frequent its shingles are, in quarters of powers of two."""
    sums = folded_slices(profile.where("part is not null").select("part", F.col("counts").alias("data")), np.add, "<u1", "<i8", 1 << _SLICE_BITS, 8 << (CELL_BITS - _SLICE_BITS))
    return np.minimum(255, 4 * np.log2(1 + np.frombuffer(sums, dtype="<i8"))).astype(np.uint8).tobytes()


_TYPES = ("<i8", "<u4", "<u4", "<u4", "<u4")


def _prefix_rows(digits: int, shared):
    """Per block and index partition: classes with their sizes, and the (shingle, position) entries of their prefixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = np.frombuffer(shared.value, dtype=np.uint8)
        for _, sets in _text_sets(batches):
            once = {_class_of(s): s for s in sets if len(s)}
            if not once:
                continue
            tokens = []
            for s in once.values():
                ranked = np.sort((levels[(s >> np.uint64(64 - CELL_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (s >> np.uint64(8)))
                tokens.append(ranked[: len(s) - -(-PART * len(s) // WHOLE) + 1])
            lengths = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
            every = np.concatenate(tokens)
            owner = np.repeat(np.arange(len(tokens)), lengths)
            position = np.arange(len(every)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            part = ((every >> np.uint64(56 - digits)) & np.uint64((1 << digits) - 1)).astype(np.uint16)
            rest = ((every >> np.uint64(24 - digits)) & np.uint64(0xFFFFFFFF)).astype("<u4")
            cids, sizes = np.array(list(once), dtype=np.int64), np.fromiter(map(len, once.values()), dtype="<u4", count=len(once))
            order = np.argsort(part, kind="stable")
            part, rest, owner, position = part[order], rest[order], owner[order], position[order].astype("<u4")
            edges = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]])
            ids, payload = [], []
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                own, counts = np.unique(owner[lo:hi], return_counts=True)
                ids.append(int(part[lo]))
                payload.append(_pack(cids[own], sizes[own], counts.astype("<u4"), rest[lo:hi], position[lo:hi]))
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(ids, pa.int32()), "payload": pa.array(payload, pa.binary())})

    return run


def needed(na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Least overlap that links two sets of these sizes."""
    return -(-(PART * (na + nb)) // (PART + WHOLE))


def needed_in_prefixes(na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Least number of shingles that the prefixes of two linked sets share.

    At most n - overlap of a set's prefix are missing from the other set, and of the two prefixes' shared shingles
    all in the one that ends first in the order are in the other prefix too.
    """
    overlap = needed(na, nb)
    return overlap + 1 + np.minimum(-PART * na // WHOLE, -PART * nb // WHOLE)


_PAIR_TYPES = ("<i8", "<i8", "<u4", "<u4", "<u4", "<u4")


def _by_part(part_of: np.ndarray, parts: int, columns: list[np.ndarray], types: tuple[str, ...]) -> tuple[list[int], list[bytes]]:
    """Rows of the columns as one packed row for each partition of ``part_of``'s ids."""
    part = _part(part_of, parts)
    order = np.argsort(part, kind="stable")
    edges = np.searchsorted(part[order], np.arange(parts + 1))
    ids = np.flatnonzero(np.diff(edges)).tolist()
    return ids, [_pack(*(np.ascontiguousarray(c[order[edges[i] : edges[i + 1]]].astype(t)) for c, t in zip(columns, types, strict=True))) for i in ids]


def _part(ids: np.ndarray, parts: int) -> np.ndarray:
    return ((ids.view(np.uint64) >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)


def _index_lists(parts: int):
    """Per index partition: pairs of classes with the number of shingles they were met by, packed by the later class.

    Short lists give all pairs that sizes and positions allow, long ones each member with the list's least class.
    A pair (b, b) carries the number of long lists that b is in.
    """

    def run(key, table):
        cids, sizes, tokens, places = [], [], [], []
        for data in table.column("payload").to_pylist():
            c, n, k, t, p = _unpack(data, _TYPES)
            cids.append(np.repeat(c, k))
            sizes.append(np.repeat(n, k))
            tokens.append(t)
            places.append(p)
        c, n, t, p = np.concatenate(cids), np.concatenate(sizes).astype(np.int64), np.concatenate(tokens), np.concatenate(places).astype(np.int64)
        order = np.lexsort((c, t))
        c, n, t, p = c[order], n[order], t[order], p[order]
        keep = np.ones(len(c), dtype=bool)
        keep[1:] = (t[1:] != t[:-1]) | (c[1:] != c[:-1])
        c, n, t, p = c[keep], n[keep], t[keep], p[keep]
        edges = np.concatenate([[0], np.flatnonzero(np.diff(t)) + 1, [len(t)]])
        length = np.diff(edges)
        size_of = np.repeat(length, length)
        head = np.repeat(edges[:-1], length)
        found = []
        for gap in range(1, SHORT_LIST):
            i = np.flatnonzero((size_of[:-gap] <= SHORT_LIST) & (head[gap:] == head[:-gap])) if len(c) > gap else np.zeros(0, dtype=np.int64)
            j = i + gap
            least = needed(n[i], n[j])
            # What the two can share: as much as lies before the shingle in either, and as much as lies from it on.
            fits = (np.minimum(n[i], n[j]) >= least) & (np.minimum(p[i], p[j]) + np.minimum(n[i] - p[i], n[j] - p[j]) >= least)
            found.append((i[fits], j[fits], 0))
        long = np.flatnonzero(size_of > SHORT_LIST)
        found.append((head[long], long, 1))
        found.append((long, long, 1))
        i, j = (np.concatenate([x[k] for x in found]).astype(np.int64) for k in (0, 1))
        star = np.concatenate([np.full(len(x[0]), x[2]) for x in found])
        a, b, na, nb = c[i], c[j], n[i], n[j]
        order = np.lexsort((a, b))
        a, b, na, nb, star = (x[order] for x in (a, b, na, nb, star))
        first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, dtype=np.int64)
        times = np.diff(np.concatenate([first, [len(a)]])) if len(a) else first
        star = np.maximum.reduceat(star, first) if len(a) else star
        ids, payload = _by_part(b[first], parts, [a[first], b[first], na[first], nb[first], star, times], _PAIR_TYPES)
        return pa.table({"part": pa.array(ids, pa.int32()), "payload": pa.array(payload, pa.binary())})

    return run


_CANDIDATES = "kind int, a bigint, b bigint, na bigint, nb bigint, star int, part int, payload binary"


def _candidates(parts: int):
    """All pairs of a partition's later classes that can be linked: the likeliest of each class as a row (kind 1), the rest packed by the earlier class (kind 0)."""

    def run(key, table):
        columns = [np.concatenate(x) for x in zip(*(_unpack(d, _PAIR_TYPES) for d in table.column("payload").to_pylist()), strict=True)]
        a, b = columns[0], columns[1]
        na, nb, star, times = (x.astype(np.int64) for x in columns[2:])
        order = np.lexsort((a, b))
        a, b, na, nb, star, times = (x[order] for x in (a, b, na, nb, star, times))
        first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        star, times = np.maximum.reduceat(star, first), np.add.reduceat(times, first)
        a, b, na, nb = a[first], b[first], na[first], nb[first]
        # Shingles that a pair may share unseen lie in long lists of the later class.
        own = a == b
        lists_of = np.zeros(len(b), dtype=np.int64)
        group = np.cumsum(np.concatenate([[True], b[1:] != b[:-1]])) - 1
        unseen = np.bincount(group[own], times[own], minlength=group[-1] + 1).astype(np.int64)
        lists_of = unseen[group]
        possible = ~own & (np.minimum(na, nb) >= needed(na, nb)) & (times + lists_of + SLACK >= needed_in_prefixes(na, nb))
        # Members of long lists stay for relating them, whether or not the pivot itself can be linked to them.
        keep = np.flatnonzero(~own & (possible | (star == 1)))
        a, b, na, nb, star, times, possible, group = (x[keep] for x in (a, b, na, nb, star, times, possible, group))
        rank = np.lexsort((a, -times, ~possible, group))
        best = np.zeros(len(a), dtype=bool)
        if len(rank):
            best[rank[np.concatenate([[True], np.diff(group[rank]) != 0])]] = True
        best &= possible
        flags = star + 2 * best + 4 * possible
        ids, payload = _by_part(a, parts, [a, b, na, nb, flags, times], _PAIR_TYPES)
        m, k = int(best.sum()), len(ids)
        rows = {"kind": [1] * m + [0] * k}
        for name, x in (("a", a), ("b", b), ("na", na), ("nb", nb), ("star", star)):
            rows[name] = [*x[best].tolist(), *[None] * k]
        rows |= {"part": [None] * m + ids, "payload": [None] * m + payload}
        types = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
        return pa.table({n: pa.array(v, t) for (n, v), t in zip(rows.items(), types, strict=True)})

    return run


def _unpacked(table) -> list[np.ndarray]:
    parts = [_unpack(d, _PAIR_TYPES) for d in table.column("payload").to_pylist()]
    return [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, dtype=t) for t in _PAIR_TYPES]


def _roots_of(ids: np.ndarray, table) -> np.ndarray:
    """Root of each id; an id without one is its own."""
    node, root = table.column("node").to_numpy(), table.column("root").to_numpy()
    order = np.argsort(node)
    node, root = node[order], root[order]
    if not len(node):
        return ids
    at = np.minimum(np.searchsorted(node, ids), len(node) - 1)
    return np.where(node[at] == ids, root[at], ids)


def _apart(packed: DataFrame, roots: DataFrame, parts: int) -> DataFrame:
    """Candidate pairs, not yet compared, whose classes have different roots: looked up packed, first for a, then for b."""
    types = (*_PAIR_TYPES[:5], "<i8")

    def first(key, left, right):
        a, b, na, nb, flags, _ = _unpacked(left)
        live = (flags & 6) == 4
        a, b, na, nb, flags = (x[live] for x in (a, b, na, nb, flags))
        ids, payload = _by_part(b, parts, [a, b, na, nb, flags, _roots_of(a, right)], types)
        return pa.table({"part": pa.array(ids, pa.int32()), "payload": pa.array(payload, pa.binary())})

    def second(key, left, right):
        got = [_unpack(d, types) for d in left.column("payload").to_pylist()]
        a, b, na, nb, flags, home = (np.concatenate(x) for x in zip(*got, strict=True)) if got else [np.zeros(0, dtype=t) for t in types]
        cross = home != _roots_of(b, right)
        return pa.table({n: pa.array(x[cross], t) for n, x, t in (("a", a, pa.int64()), ("b", b, pa.int64()), ("na", na, pa.int64()), ("nb", nb, pa.int64()), ("star", flags & 1, pa.int32()))})

    by_part = _with_part(roots, "node", parts)
    carried = packed.groupBy("part").cogroup(by_part.groupBy("part")).applyInArrow(first, "part int, payload binary")
    return carried.groupBy("part").cogroup(by_part.groupBy("part")).applyInArrow(second, "a bigint, b bigint, na bigint, nb bigint, star int")


def _with_part(df: DataFrame, column: str, parts: int) -> DataFrame:
    """The partition that _part gives, by a column of 64-bit ids."""
    return df.withColumn("part", F.pmod(F.shiftrightunsigned(F.col(column), 20), F.lit(parts)).cast("int"))


def _pivots(packed: DataFrame, roots: DataFrame, parts: int) -> DataFrame:
    """Pivots (a) of long lists whose members have different roots, whether or not a member was compared with the pivot."""

    def by_member(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, _, _, flags, _ = _unpacked(batch)
            star = (flags & 1) == 1
            ids, payload = _by_part(b[star], parts, [a[star], b[star]], ("<i8", "<i8"))
            yield pa.RecordBatch.from_pydict({"part": pa.array(ids, pa.int32()), "payload": pa.array(payload, pa.binary())})

    def extremes(key, left, right):
        got = [_unpack(d, ("<i8", "<i8")) for d in left.column("payload").to_pylist()]
        a, b = (np.concatenate(x) for x in zip(*got, strict=True)) if got else (np.zeros(0, dtype="<i8"),) * 2
        root = _roots_of(b, right)
        order = np.lexsort((root, a))
        a, root = a[order], root[order]
        edge = np.flatnonzero(a[1:] != a[:-1])
        low, high = (np.concatenate([[0], edge + 1]), np.concatenate([edge, [len(a) - 1]])) if len(a) else (np.zeros(0, dtype=np.int64),) * 2
        return pa.table({"a": pa.array(a[low], pa.int64()), "low": pa.array(root[low], pa.int64()), "high": pa.array(root[high], pa.int64())})

    carried = packed.mapInArrow(by_member, "part int, payload binary")
    found = carried.groupBy("part").cogroup(_with_part(roots, "node", parts).groupBy("part")).applyInArrow(extremes, "a bigint, low bigint, high bigint")
    return found.groupBy("a").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low <> high").select("a")


def _members(packed: DataFrame, pivots: DataFrame, parts: int) -> DataFrame:
    """All members of long lists with these pivots (a)."""

    def run(key, left, right):
        a, b, na, nb, flags, _ = _unpacked(left)
        live = ((flags & 1) == 1) & np.isin(a, right.column("a").to_numpy())
        return pa.table({n: pa.array(x[live], t) for n, x, t in (("a", a, pa.int64()), ("b", b, pa.int64()), ("na", na, pa.int64()), ("nb", nb, pa.int64()), ("star", flags & 1, pa.int32()))})

    return packed.groupBy("part").cogroup(_with_part(pivots.select("a"), "a", parts).groupBy("part")).applyInArrow(run, "a bigint, b bigint, na bigint, nb bigint, star int")


def _bitmap(ids: DataFrame) -> bytes:
    """Bitmap over the first MAP_BITS bits of the ids: a filter of fixed size that lets some others pass."""
    width = 1 << (MAP_BITS - _SLICE_BITS - 3)

    def put(batches):
        bits = np.zeros(1 << MAP_BITS, dtype=bool)
        any_id = False
        for b in batches:
            any_id = any_id or len(b) > 0
            bits[b.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - MAP_BITS)] = True
        if any_id:
            packed = np.packbits(bits).reshape(-1, width)
            some = [i for i, x in enumerate(packed) if x.any()]
            yield pa.RecordBatch.from_pydict({"part": pa.array(some, pa.int32()), "data": pa.array([packed[i].tobytes() for i in some], pa.binary())})

    return folded_slices(ids.mapInArrow(put, "part int, data binary"), np.bitwise_or, "<u1", "<u1", 1 << _SLICE_BITS, width)


def _six_bytes(s: np.ndarray) -> bytes:
    """Sorted 48-bit hashes."""
    return np.ascontiguousarray((s >> np.uint64(16)).astype("<u8")[:, None].view(np.uint8)[:, :6]).tobytes()


def _from_six(data: bytes) -> np.ndarray:
    six = np.frombuffer(data, dtype=np.uint8).reshape(-1, 6)
    out = np.zeros((len(six), 8), dtype=np.uint8)
    out[:, :6] = six
    return out.view("<u8")[:, 0]


def _chosen_sets(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(shared.value, dtype=np.uint8)
        for _, sets in _text_sets(batches):
            out: dict[int, bytes] = {}
            for s in sets:
                if len(s):
                    c = _class_of(s)
                    at = (c & (1 << 64) - 1) >> (64 - MAP_BITS)
                    if bits[at >> 3] >> (7 - (at & 7)) & 1 and c not in out:
                        out[c] = _six_bytes(s)
            if out:
                yield pa.RecordBatch.from_pydict({"cid": pa.array(list(out), pa.int64()), "s": pa.array(list(out.values()), pa.binary())})

    return run


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["a", "b", "na", "nb", "star"]
    last, left = None, None
    for batch in batches:
        out = []
        for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
            x, y = x.as_py(), y.as_py()
            if x != last:
                last, left = x, _from_six(x)
            right = _from_six(y)
            p, q = (left, right) if len(left) <= len(right) else (right, left)
            at = np.searchsorted(q, p)
            at[at == len(q)] = 0
            out.append(int((q[at] == p).sum()))
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(out, pa.int64())], names=[*names, "o"])


def _sets_of(text: DataFrame, ids: DataFrame) -> DataFrame:
    """(cid, s): sets of these classes, and of a few others, made from the texts again."""
    mapped = text.sparkSession.sparkContext.broadcast(_bitmap(ids))
    return text.mapInArrow(_chosen_sets(mapped), "cid bigint, s binary").groupBy("cid").agg(F.first("s").alias("s"))


def _compare(text: DataFrame, pairs: DataFrame, label: str) -> DataFrame:
    """Pairs with the size of their overlap, o."""
    sets = _sets_of(text, pairs.select(F.explode(F.array("a", "b")).alias("cid")))
    left = sets.select(F.col("cid").alias("a"), F.col("s").alias("sa"))
    right = sets.select(F.col("cid").alias("b"), F.col("s").alias("sb"))
    met = pairs.join(right, "b").join(left, "a").select("a", "b", "na", "nb", "star", "sa", "sb")
    return materialise(met.mapInArrow(_overlaps, "a bigint, b bigint, na bigint, nb bigint, star int, o bigint"), label)


def _linked(compared: DataFrame) -> DataFrame:
    return compared.where(F.col("o") * WHOLE >= (F.col("na") + F.col("nb") - F.col("o")) * PART).select(F.col("a").alias("u"), F.col("b").alias("v"))


def _relate(key, table):
    """Links that join components: one block of a list's askers against one block of its members.

    For members x and y with overlaps ox and oy with a pivot of size np, the overlap of x and y is at least
    ox + oy - np and at most min(ox, oy) + min(nx - ox, ny - oy).  What the bounds leave open an index of the
    members' shingles answers, for one asker against all members at a time.  Members that a link has joined are not
    related any further.
    """
    x, n, code = (table.column(c).to_numpy().copy() for c in ("b", "n", "root"))
    inside, asks, answers = (table.column(c).to_numpy(zero_copy_only=False) for c in ("inside", "asks", "answers"))
    sets = [_from_six(d) for d in table.column("s").to_pylist()]
    tokens = np.concatenate(sets)
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], np.repeat(np.arange(len(x)), [len(s) for s in sets])[order]

    def overlaps(i: int) -> np.ndarray:
        lo, hi = np.searchsorted(tokens, sets[i], side="left"), np.searchsorted(tokens, sets[i], side="right")
        many = hi - lo
        at = np.repeat(lo - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        return np.bincount(owner[at], minlength=len(x))

    centre = int(np.flatnonzero(x == key[0].as_py())[0])
    o, size = overlaps(centre), int(n[centre])
    links: list[tuple[int, int]] = []

    def join(i: int, others: np.ndarray) -> None:
        for j in others[np.unique(code[others], return_index=True)[1]].tolist():
            links.append((int(x[i]), int(x[j])))
            code[code == code[j]] = code[i]

    for i in np.flatnonzero(asks).tolist():
        # Members of the pivot's component ask nobody; of two others the greater asks.
        others = np.flatnonzero(answers & (inside | (x < x[i])) & (code != code[i]))
        least = needed(n[i], n[others])
        high = np.minimum(o[i], o[others]) + np.minimum(n[i] - o[i], n[others] - o[others])
        open_ = (high >= least) & (np.minimum(n[i], n[others]) >= least)
        others, least = others[open_], least[open_]
        join(i, others[o[i] + o[others] - size >= least])
        apart = code[others] != code[i]
        if apart.any():
            others, least = others[apart], least[apart]
            join(i, others[overlaps(i)[others] >= least])
    u, v = zip(*links, strict=True) if links else ((), ())
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def _needed_lists(members: DataFrame) -> DataFrame:
    """Members (a, b, na, nb) without pivots whose members all belong to one larger pivot too: they are related there."""
    sizes = members.groupBy("a").agg(F.count("*").alias("m"))
    homes = members.join(sizes, "a").groupBy("b").agg(F.max_by("a", F.struct("m", "a")).alias("h"))
    held = members.join(homes, "b").groupBy("a").agg(F.min("h").alias("low"), F.max("h").alias("high"))
    return members.join(held.where("low <> high or low = a").select("a"), "a", "left_semi")


def _links_of_pivots(text: DataFrame, members: DataFrame, roots: DataFrame) -> DataFrame:
    """Links among the members (a, b, na, nb) of pivots a whose members are in several components.

    A pivot's askers (members outside its component) and its members are dealt to blocks of ROWS_PER_BLOCK; every pair
    of blocks is a group of its own, so no task holds a whole list, however long.
    """
    members = materialise(_needed_lists(members), "lists")
    own = members.groupBy("a").agg(F.first("na").alias("n"))
    every = members.select("a", "b", F.col("nb").alias("n")).unionByName(own.select("a", F.col("a").alias("b"), "n"))
    rooted = materialise(_rooted(every, roots).withColumn("inside", F.col("root") == F.col("home")), "rooted")
    blocks_of = lambda n: F.greatest(F.lit(1), F.ceil(n / ROWS_PER_BLOCK)).cast("int")
    counts = rooted.groupBy("a").agg(blocks_of(F.count_if(~F.col("inside"))).alias("ask_blocks"), blocks_of(F.count("*")).alias("blocks"))
    dealt = rooted.join(counts, "a")
    mine = lambda many: F.pmod(F.xxhash64("b"), F.col(many)).cast("int")
    pivot = F.col("a") == F.col("b")
    # The pivot, which bounds are taken from, is everywhere.
    places = F.flatten(F.transform(F.sequence(F.lit(0), F.col("ask_blocks") - 1), lambda i: F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(i.alias("i"), j.alias("j")))))
    placed = dealt.withColumn("at", F.explode(F.filter(places, lambda p: pivot | (p["j"] == mine("blocks")) | (~F.col("inside") & (p["i"] == mine("ask_blocks"))))))
    asks = ~F.col("inside") & (F.col("at.i") == mine("ask_blocks"))
    answers = F.col("at.j") == mine("blocks")
    placed = materialise(placed.select("a", "b", "n", "root", "inside", F.col("at.i").alias("i"), F.col("at.j").alias("j"), asks.alias("asks"), answers.alias("answers")), "members")
    met = placed.join(_sets_of(text, placed.select(F.col("b").alias("cid"))).withColumnRenamed("cid", "b"), "b")
    return materialise(met.groupBy("a", "i", "j").applyInArrow(_relate, "u bigint, v bigint").distinct(), "links")


def _rooted(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs with ``home``, the root of a, and ``root``, that of b."""
    pairs = pairs.join(roots.select(F.col("node").alias("b"), "root"), "b", "left").withColumn("root", F.coalesce("root", "b"))
    return pairs.join(roots.select(F.col("node").alias("a"), F.col("root").alias("home")), "a", "left").withColumn("home", F.coalesce("home", "a"))


def linked_classes(docs: DataFrame, profile: DataFrame) -> DataFrame:
    """(node, root) of classes that have links to other classes."""
    digits = buckets_for(docs)
    parts = 1 << digits
    text = docs.select("text")
    levels = docs.sparkSession.sparkContext.broadcast(_levels(profile))
    sent = text.mapInArrow(_prefix_rows(digits, levels), "bucket int, payload binary")
    met = sent.groupBy("bucket").applyInArrow(_index_lists(parts), "part int, payload binary")
    found = materialise(met.groupBy("part").applyInArrow(_candidates(parts), _CANDIDATES), "candidates")
    levels.unpersist()
    packed = found.where("kind = 0").select("part", "payload")
    # The likeliest partner of each class first: that alone joins most of a group of near copies.
    compared = _compare(text, found.where("kind = 1").select("a", "b", "na", "nb", "star"), "compared")
    links = _linked(compared)
    roots = materialise(components(links), "roots")
    rest = materialise(_apart(packed, roots, parts), "pairs")
    if not rest.isEmpty():
        compared = compared.unionByName(_compare(text, rest, "compared"))
        links = _linked(compared)
        roots = materialise(components(links), "roots")
    # Long lists whose members are still apart: they are related to each other.
    pivots = materialise(_pivots(packed, roots, parts), "pivots")
    if pivots.isEmpty():
        return roots
    more = _links_of_pivots(text, _members(packed, pivots, parts), roots)
    return roots if more.isEmpty() else materialise(components(links.unionByName(more)), "roots")


def document_components(docs: DataFrame) -> DataFrame:
    """The contract's rows: doc_id, n_shingles, component_id."""
    given = ready(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    profile = materialise(given.mapInArrow(_profile, "doc_id bigint, n bigint, cid bigint, part int, counts binary"), "profile")
    own = profile.where("part is null").select("doc_id", "n", "cid")
    roots = linked_classes(docs, profile)
    some = own.where("n > 0")
    classes = some.groupBy("cid").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    # Classes with links, each with its root; a root may stand for a large share of them, and a class for one of the rows.
    rooted = materialise(roots.select(F.col("node").alias("cid"), "root").join(classes.drop("copies"), "cid"), "rooted")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("degree"))
    linked = join_hot(rooted.select("cid", "root"), least, "root", rooted.count(), "degree").select("cid", F.col("component_id").alias("joined"))
    by_class = materialise(classes.join(linked, "cid", "left").select("cid", F.coalesce("joined", "least").alias("component_id"), "copies"), "classes")
    found = join_hot(some, by_class, "cid", own.count(), "copies").select("doc_id", "n", "component_id")
    # Texts without a set are linked with nothing.
    alone = own.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return found.unionByName(alone).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """All columns of the documents that stand for their component: the one with the least id (of rows that repeat it, one)."""
    chosen = document_components(docs.where("doc_id is not null")).where("doc_id = component_id").select("doc_id").distinct()
    once = docs.withColumn("__rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text")))).where("__rank = 1").drop("__rank")
    return once.join(chosen, "doc_id", "left_semi").unionByName(docs.where("doc_id is null")).select(*docs.columns)
