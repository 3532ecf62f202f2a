"""Substring dedup: words of repeated 20-word windows go, except where the window occurs first.

The windows are the suffixes of the texts' word sequences cut at depth 20, the leaves of a suffix tree that is
partitioned by prefixes of variable length.

1. Every window is found by the least of its 8-word runs; one place in seven is such a prefix.  A prefix that
   occurs once leads to leaves only: no window that it stands for repeats, and its suffixes are never sent.
2. The suffixes of the other prefixes go to groups by the hash of the prefix.  How many groups there are follows
   from how many suffixes there are (GROUP_RUNS a group), which step 1 has counted.  A prefix with more than
   HOT_RUNS of them is lengthened to the whole 20 words, so its suffixes spread over all groups.  A task sends a
   node whose prefix was lengthened once and afterwards only where an earlier place turns up, so a node gets one
   suffix a task at most in id order.
3. Each group builds its subtree from the words themselves: nodes of depth 1, 2, 4, 8, 16 and 20 are numbered
   level by level, equal numbers for equal words.  A node of depth 20 with two or more leaves is inner to the
   whole tree; all its leaves but the first by (doc_id, start) are marked, and marks that touch become one span:
   the maximal repeats.

Which prefixes repeat, and which are lengthened, travels as two bitmaps of fixed size; where they are full, more
suffixes are sent or lengthened than need be, and the result is the same.  Within a block of texts, windows of equal
hash are told apart by the hashes of their words; across blocks, by the words.

Defined cases: a null text counts as empty; texts of under 20 words lose nothing; rows that repeat an id count as
one document, whose windows at the same start don't count as earlier than one another; rows without an id lose
nothing and make nothing repeat; extra columns stay.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import ready
from .wordhash import Block, block_of, blocks, mix, spaced

WINDOW = 20
PREFIX = 8
#: Bits of the maps of prefixes that repeat and of those that are lengthened: 8 MB each, whatever the corpus.
MAP_BITS = 26
#: Runs of suffixes that a group holds, about, and runs from which on a prefix is lengthened.  A run has some 26 words.
GROUP_RUNS, HOT_RUNS = 50_000, 10_000
#: Windows of one text that are looked at together.
PART_WORDS = 500_000
#: Bytes of words that a task gathers before it sends them.
FLUSH_BYTES = 8 << 20
#: Nodes of lengthened prefixes that a task remembers.
REMEMBERED = 200_000
_REACH = WINDOW - PREFIX + 1


def buckets_for(df: DataFrame) -> int:
    """Binary digits of the number of partitions of suffixes: grows with the input's own partitions."""
    wanted = max(64, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * df.rdd.getNumPartitions())
    return min(20, (wanted - 1).bit_length())


def _sliding(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Least or greatest of each ``width`` consecutive entries, by doubling."""
    f = np.minimum if least else np.maximum
    have, out = 1, x
    while 2 * have <= width:
        out = f(out[:-have], out[have:])
        have *= 2
    gap = width - have
    return f(out[:-gap], out[gap:]) if gap else out


def _windows(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """First words of all windows, and the least prefix hash of each."""
    g = block.runs(PREFIX)
    starts = np.concatenate([np.arange(lo, hi - WINDOW + 1) for lo, hi in zip(block.first[:-1], block.first[1:], strict=True) if hi - lo >= WINDOW] or [np.zeros(0, dtype=np.int64)])
    if not len(starts):
        return starts, np.zeros(0, dtype=np.uint64)
    return starts, _sliding(g, _REACH, True)[starts]


def _anchors(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Distinct prefix hashes that stand for windows here, and how many different stretches of words they stand in: two at
    least where more than one place has them, 255 at most."""
    starts, least = _windows(block)
    if not len(starts):
        return least, np.zeros(0, dtype=np.uint8)
    g = block.runs(PREFIX)
    top = np.zeros(len(g) + _REACH - 1, dtype=np.uint64)
    top[starts + _REACH - 1] = least
    # A place is chosen if some window over it has it as its least: the greatest least of those windows.
    place = np.flatnonzero(_sliding(top, _REACH, False)[: len(g)] == g)
    text = np.searchsorted(block.first, place, side="right") - 1
    around = block.between(np.maximum(place - (WINDOW - PREFIX), block.first[text]), np.minimum(place + WINDOW, block.first[text + 1]))
    # Least hashes are small numbers; mixed once more they spread over partitions and bitmaps.
    value = mix(g[place])
    order = np.lexsort((around, value))
    value, around = value[order], around[order]
    lo = np.flatnonzero(_heads(value))
    places = np.diff(np.concatenate([lo, [len(value)]]))
    kinds = np.add.reduceat(_heads(value, around).astype(np.int64), lo)
    return value[lo], np.clip(kinds, np.minimum(places, 2), 255).astype(np.uint8)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Block, int]]:
    """Blocks of texts; of a text that is very long, parts that share WINDOW - 1 words, with the number of words before each."""
    for rows, texts in blocks(batches):
        block = block_of(texts)
        if len(texts) > 1 or len(block.hashes) <= PART_WORDS:
            yield rows, block, 0
        else:
            for lo in range(0, len(block.hashes) - WINDOW + 1, PART_WORDS):
                yield rows, block.part(lo, lo + PART_WORDS + WINDOW - 1), lo


def _prefix_rows(digits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, block, _ in _parts(batches):
            values, times = _anchors(block)
            bucket = (values >> np.uint64(64 - digits)).astype(np.int64)
            rest = ((values << np.uint64(digits)) >> np.uint64(32)).astype("<u4")
            edges = np.concatenate([np.flatnonzero(np.diff(bucket, prepend=-1)), [len(bucket)]])
            ids, payload = [], []
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                ids.append(int(bucket[lo]))
                payload.append(rest[lo:hi].tobytes() + times[lo:hi].tobytes())
            if ids:
                yield pa.RecordBatch.from_pydict({"bucket": pa.array(ids, pa.int32()), "payload": pa.array(payload, pa.binary())})

    return run


def extending_prefixes(docs: DataFrame, digits: int) -> tuple[bytes, bytes, int]:
    """Bitmaps over the first MAP_BITS bits of a prefix hash: set where two or more suffixes share the prefix, and where more
    than HOT_RUNS do; and how many runs of suffixes have the former."""
    sent = docs.select("text").mapInArrow(_prefix_rows(digits), "bucket int, payload binary")
    below = MAP_BITS - digits
    hot_runs = HOT_RUNS

    def several(key, table):
        data = table.column("payload").to_pylist()
        x = np.concatenate([np.frombuffer(d, dtype="<u4", count=len(d) // 5) for d in data])
        n = np.concatenate([np.frombuffer(d, dtype="u1", offset=len(d) // 5 * 4) for d in data]).astype(np.int64)
        order = np.argsort(x, kind="stable")
        x = x[order]
        lo = np.flatnonzero(_heads(x))
        times = np.add.reduceat(n[order], lo)
        out = []
        for least in (1, hot_runs):
            bits = np.zeros(1 << below, dtype=bool)
            bits[x[lo[times > least]] >> np.uint32(32 - below)] = True
            out.append(np.packbits(bits).tobytes())
        total = int(times[times > 1].sum())
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array(out[:1], pa.binary()), "hot": pa.array(out[1:] if total > hot_runs else [None], pa.binary()), "n": pa.array([total], pa.int64())})

    whole, hot, total = bytearray(1 << (MAP_BITS - 3)), bytearray(1 << (MAP_BITS - 3)), 0
    width = 1 << (below - 3)
    for r in sent.groupBy("bucket").applyInArrow(several, "bucket int, bits binary, hot binary, n bigint").collect():
        at = slice(r["bucket"] * width, (r["bucket"] + 1) * width)
        whole[at] = r["bits"]
        if r["hot"] is not None:
            hot[at] = r["hot"]
        total += r["n"]
    return bytes(whole), bytes(hot), total


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of equal width in a row, compressed: sorted ids and starts become differences first."""
    raw = b"".join(np.int64(c.nbytes).tobytes() + c.tobytes() for c in columns)
    return np.int64(len(raw)).tobytes() + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(data: bytes, types: tuple[str, ...]) -> list[np.ndarray]:
    raw = pa.decompress(data[8:], decompressed_size=int(np.frombuffer(data[:8], dtype=np.int64)[0]), codec="zstd", asbytes=True)
    at, out = 0, []
    for t in types:
        n = int(np.frombuffer(raw[at : at + 8], dtype=np.int64)[0])
        out.append(np.frombuffer(raw[at + 8 : at + 8 + n], dtype=t))
        at += 8 + n
    return out


#: Of runs of windows: document and row key of each text, its number of runs; starts as differences within a text, windows of each run, words.
_RUN_TYPES = ("<i8", "<i8", "<u4", "<u4", "<u4", "<u1")
#: Of spans: document and row key of each text, its number of spans; first and last word of each.
_SPAN_TYPES = ("<i8", "<i8", "<u4", "<u4", "<u4")


def _is_set(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes >> np.uint64(64 - MAP_BITS)
    return (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (7 - (at & np.uint64(7))).astype(np.uint8)) & 1 == 1


def _heads(*columns: np.ndarray) -> np.ndarray:
    """Where any of the columns differs from the entry before."""
    out = np.ones(len(columns[0]), dtype=bool)
    if len(out):
        out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return out


def _spans(text: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, end) of the stretches that windows, sorted by text and place, cover."""
    head = np.ones(len(text), dtype=bool)
    head[1:] = (text[1:] != text[:-1]) | (place[1:] > place[:-1] + WINDOW)
    lo = np.flatnonzero(head)
    hi = np.concatenate([lo[1:], [len(text)]]) - 1 if len(lo) else lo
    return text[lo], place[lo], place[hi] + WINDOW


def _counted(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    lo = np.flatnonzero(_heads(text))
    return text[lo], np.diff(np.concatenate([lo, [len(text)]])).astype("<u4")


class _Seen:
    """Nodes of lengthened prefixes that this task has sent, with a second hash of their words and their first place."""

    def __init__(self):
        self.nodes: dict[int, tuple[int, int, int]] = {}

    def late(self, node: int, check: int, doc: int, place: int) -> bool:
        known = self.nodes.get(node)
        if known is not None and known[0] == check and known[1:] <= (doc, place):
            return known[1:] != (doc, place)
        if len(self.nodes) >= REMEMBERED:
            self.nodes.clear()
        self.nodes[node] = (check, doc, place)
        return False


def _suffix_rows(digits: int, shared):
    """Per task and group: runs of suffixes (kind 0) that share a prefix; per text, spans of those that repeat within the task (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeats, hot = (np.frombuffer(x, dtype=np.uint8) for x in shared.value)
        any_hot = bool(hot.any())
        seen = _Seen()
        waiting: dict[tuple[int, int], list[list]] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            keys = sorted(waiting)
            data = []
            for bucket, kind in keys:
                cols = [[c[i] for c in waiting[bucket, kind]] for i in range(len(waiting[bucket, kind][0]))]
                data.append(_pack(*(np.concatenate(c) if i < 5 else np.frombuffer(b"".join(c), dtype=np.uint8) for i, c in enumerate(cols))))
            waiting.clear()
            return pa.RecordBatch.from_pydict({"bucket": pa.array([b for b, _ in keys], pa.int32()), "kind": pa.array([k for _, k in keys], pa.int32()), "payload": pa.array(data, pa.binary())})

        for rows, block, offset in _parts(batches):
            starts, least = _windows(block)
            least = mix(least)
            keep = _is_set(repeats, least)
            starts, least = starts[keep], least[keep]
            if not len(starts):
                continue
            ids = rows.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            keys = rows.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            text = np.searchsorted(block.first, starts, side="right") - 1
            place = starts - block.first[text] + offset
            nodes = block.runs(WINDOW)[starts]
            order = np.lexsort((place, ids[text], nodes))
            fresh = _heads(nodes[order])
            lead = np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))
            differs = np.zeros(len(order), dtype=bool)
            a, b = starts[order], starts[order[lead]]
            for k in range(WINDOW):
                differs |= block.hashes[a + k] != block.hashes[b + k]
            late = np.zeros(len(order), dtype=bool)
            late[order] = ~differs & ((ids[text[order]] != ids[text[order[lead]]]) | (place[order] != place[order[lead]]))
            send = ~late
            lengthened = _is_set(hot, least) if any_hot else np.zeros(len(starts), dtype=bool)
            again = np.flatnonzero(send & lengthened)
            if len(again):
                check = np.zeros(len(again), dtype=np.uint64)
                for k in range(WINDOW):
                    check = mix(check + block.hashes[starts[again] + k])
                known = np.fromiter(map(seen.late, nodes[again].tolist(), check.tolist(), ids[text[again]].tolist(), place[again].tolist()), dtype=bool, count=len(again))
                late[again[known]], send[again[known]] = True, False
            # Runs of consecutive windows of one prefix; a lengthened prefix has runs of one window.
            w = np.flatnonzero(send)
            head = _heads(text[w], least[w]) | lengthened[w]
            head[1:] |= starts[w][1:] != starts[w][:-1] + 1
            lo = w[head]
            many = np.diff(np.concatenate([np.flatnonzero(head), [len(w)]]))
            bucket = (np.where(lengthened[lo], nodes[lo], least[lo]) >> np.uint64(64 - digits)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            lo, many, bucket = lo[order], many[order], bucket[order]
            begin, end = block.at[starts[lo]], block.at[starts[lo] + many + WINDOW - 1]
            data = block.data.tobytes()
            edges = np.concatenate([np.flatnonzero(_heads(bucket)), [len(bucket)]])
            for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                own, counts = _counted(text[lo[i:j]])
                step = np.diff(place[lo[i:j]], prepend=0)
                first = np.flatnonzero(_heads(text[lo[i:j]]))
                step[first] = place[lo[i:j]][first]
                words = b"".join([data[x:y] for x, y in zip(begin[i:j].tolist(), end[i:j].tolist(), strict=True)])
                size += len(words)
                waiting.setdefault((int(bucket[i]), 0), []).append([ids[own], keys[own], counts, step.astype("<u4"), many[i:j].astype("<u4"), words])
            marked = np.flatnonzero(late)
            if len(marked):
                t, p, e = _spans(text[marked], place[marked])
                to = (keys[t].view(np.uint64) >> np.uint64(64 - digits)).astype(np.int64)
                order = np.argsort(to, kind="stable")
                t, p, e, to = t[order], p[order], e[order], to[order]
                edges = np.concatenate([np.flatnonzero(_heads(to)), [len(to)]])
                for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                    own, counts = _counted(t[i:j])
                    waiting.setdefault((int(to[i]), 1), []).append([ids[own], keys[own], counts, p[i:j].astype("<u4"), e[i:j].astype("<u4")])
                    size += 12 * (j - i)
            if size >= FLUSH_BYTES:
                yield flush()
                size = 0
        if waiting:
            yield flush()

    return run


def _places(counts: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Starts from their differences, which begin anew with each text."""
    total = np.cumsum(step.astype(np.int64))
    heads = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)
    return total - np.repeat(total[heads] - step[heads], counts)


def _numbered(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One number for each distinct pair."""
    return pd.factorize(a.astype(np.int64) * (int(b.max()) + 1) + b)[0].astype(np.int32)


def nodes_of(words: list[bytes], starts: np.ndarray) -> np.ndarray:
    """Nodes of depth WINDOW of the suffixes at ``starts`` of a sequence of words, given as texts of words each followed by a space.

    Level by level: a node of depth 2d is a pair of nodes of depth d.  Each level is made only where a deeper one needs it.
    """
    parts = [pc.split_pattern(pa.array([x.decode()[:-1]], pa.large_string()), " ").values.dictionary_encode() for x in words]
    level = pa.chunked_array(parts).unify_dictionaries()
    level = np.concatenate([c.indices.to_numpy(zero_copy_only=False) for c in level.chunks])
    wanted = {1: None, 2: range(0, WINDOW, 2), 4: range(0, WINDOW, 4), 8: (0, 8), 16: (0,)}
    four = level
    for depth in (2, 4, 8, 16):
        need = np.zeros(len(level), dtype=bool)
        for k in wanted[depth]:
            need[starts + k] = True
        at = np.flatnonzero(need)
        made = np.zeros(len(level), dtype=np.int32)
        made[at] = _numbered(level[at], level[at + depth // 2])
        level = made
        four = made if depth == 4 else four
    return _numbered(level[starts], four[starts + 16])


def _marks(key, table):
    """Spans of a group's suffixes that aren't first in their nodes, by text; those marked before pass through."""
    ids, keys, firsts, ends = [], [], [], []
    run_ids, run_keys, run_places, run_many, words = [], [], [], [], []
    for kind, data in zip(table.column("kind").to_pylist(), table.column("payload").to_pylist(), strict=True):
        if kind == 1:
            i, k, c, lo, hi = _unpack(data, _SPAN_TYPES)
            ids.append(np.repeat(i, c))
            keys.append(np.repeat(k, c))
            firsts.append(lo.astype(np.int64))
            ends.append(hi.astype(np.int64))
        else:
            i, k, c, step, many, text = _unpack(data, _RUN_TYPES)
            c = c.astype(np.int64)
            run_ids.append(np.repeat(i, c))
            run_keys.append(np.repeat(k, c))
            run_places.append(_places(c, step))
            run_many.append(many.astype(np.int64))
            words.append(text.tobytes())
    if words:
        i, k, p, many = map(np.concatenate, (run_ids, run_keys, run_places, run_many))
        within = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        length = many + WINDOW - 1
        starts = np.repeat(np.cumsum(length) - length, many) + within
        i, k, p = np.repeat(i, many), np.repeat(k, many), np.repeat(p, many) + within
        node = nodes_of(words, starts)
        order = np.lexsort((p, i, node))
        lead = order[np.maximum.accumulate(np.where(_heads(node[order]), np.arange(len(order)), 0))]
        late = order[(i[order] != i[lead]) | (p[order] != p[lead])]
        i, k, p = i[late], k[late], p[late]
        order = np.lexsort((p, k, i))
        i, k, p = i[order], k[order], p[order]
        text = np.cumsum(_heads(i, k)) - 1
        own = np.flatnonzero(_heads(text))
        t, lo, hi = _spans(text, p)
        if len(own):
            ids.append(i[own][t])
            keys.append(k[own][t])
            firsts.append(lo)
            ends.append(hi)
    i, k, lo, hi = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (ids, keys, firsts, ends))
    order = np.lexsort((lo, k, i))
    i, k = i[order], k[order]
    pairs = np.stack([lo[order], hi[order]], axis=1).astype("<u4")
    edges = np.concatenate([np.flatnonzero(_heads(i, k)), [len(i)]]).astype(np.int64)
    return pa.table(
        {
            "__id": pa.array(i[edges[:-1]], pa.int64()),
            "__key": pa.array(k[edges[:-1]], pa.int64()),
            "__spans": pa.array([pairs[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.binary()),
        }
    )


def _row_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def marked_spans(docs: DataFrame) -> DataFrame:
    """(__id, __key, __spans): by row, the stretches of words that windows which occurred earlier cover, as lists of little-endian
    pairs (first word, end)."""
    repeats, hot, suffixes = extending_prefixes(docs, buckets_for(docs))
    digits = min(20, max(6, (suffixes // GROUP_RUNS).bit_length()))
    shared = docs.sparkSession.sparkContext.broadcast((repeats, hot))
    given = docs.select(F.col("doc_id").cast("bigint"), _row_key(F.col("text")).alias("__key"), "text").where(F.col("doc_id").isNotNull())
    sent = given.mapInArrow(_suffix_rows(digits, shared), "bucket int, kind int, payload binary")
    found = sent.groupBy("bucket").applyInArrow(_marks, "__id bigint, __key bigint, __spans binary")
    return found.groupBy("__id", "__key").agg(F.collect_list("__spans").alias("__spans"))


def _united(spans: list[bytes]) -> list[tuple[int, int]]:
    """Spans of one text, in order, without overlap."""
    pairs = np.frombuffer(b"".join(spans), dtype="<u4").reshape(-1, 2).astype(np.int64)
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    top = np.maximum.accumulate(pairs[:, 1])
    head = np.ones(len(pairs), dtype=bool)
    head[1:] = pairs[1:, 0] > top[:-1]
    lo = np.flatnonzero(head)
    return list(zip(pairs[lo, 0].tolist(), top[np.concatenate([lo[1:], [len(pairs)]]) - 1].tolist(), strict=True))


def kept_words(batch: pa.RecordBatch, text: str, spans: str) -> Iterator[tuple[int, int, bytes | None]]:
    """Of each row: number of words, number removed, and the words that stay, joined by one space."""
    at_spans = batch.schema.get_field_index(spans)
    for rows, texts in blocks(iter([batch]), text):
        data, at, first = spaced(texts)
        for t, marks in enumerate(rows.column(at_spans).to_pylist()):
            lo, hi = int(first[t]), int(first[t + 1])
            gone = [x for x in _united(marks) if x[1] <= hi - lo] if marks else []
            edges = [lo, *(lo + x for pair in gone for x in pair), hi]
            kept = b"".join(data[at[a] : at[b]].tobytes() for a, b in zip(edges[::2], edges[1::2], strict=True))
            yield hi - lo, sum(b - a for a, b in gone), kept[:-1]


def _joined(docs: DataFrame) -> DataFrame:
    """The rows with the marks of their words; only a row's own text and marks ever meet."""
    marks = marked_spans(ready(docs))
    keyed = docs.withColumns({"__id": F.col("doc_id").cast("bigint"), "__key": _row_key(F.col("text"))})
    return keyed.join(marks, ["__id", "__key"], "left").drop("__id", "__key")


def dedup_digest(docs: DataFrame) -> DataFrame:
    """The contract's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, gone, sha = [], [], []
            for total, removed, kept in kept_words(b, "text", "__spans"):
                n.append(total)
                gone.append(removed)
                sha.append(hashlib.sha256(kept).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    given = _joined(docs.select("doc_id", "text")).select("doc_id", "text", "__spans")
    schema = StructType([given.schema["doc_id"], StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept_sha256", StringType())])
    return given.mapInArrow(run, schema)


def dedup_texts(docs: DataFrame) -> DataFrame:
    """All columns of the input; texts that lose words hold the others joined by one space, the rest stay as they are."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = names.index("text")
            old = b.column(at)
            new = [kept.decode() if removed else t for t, (_, removed, kept) in zip(old.to_pylist(), kept_words(b, "text", "__spans"), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if i == at else b.column(i) for i in range(len(names))], names=names)

    given = _joined(docs).select(*names, "__spans")
    return given.mapInArrow(run, docs.schema)
