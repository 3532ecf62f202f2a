"""Distances between numeric rows, and nearest rows by distance."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from gaugeline.functions.vectors import euclidean, feature_vector


def features(rows: DataFrame, indexes: list[int], keep: list[str]) -> DataFrame:
    """Kept columns and ``vector``; rows with a missing or non-numeric field have no vector and go."""
    return rows.select(*keep, feature_vector(F.col("fields"), indexes).alias("vector")).where("vector is not null")


def dimension(vectors: DataFrame, column: str = "vector") -> DataFrame:
    """One row: the common dimension, null if vectors differ or there are none."""
    sizes = vectors.agg(F.min(F.size(column)).alias("lo"), F.max(F.size(column)).alias("hi"))
    return sizes.select(F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("dimension"))


def distances(pairs: DataFrame, a: str, b: str) -> DataFrame:
    return pairs.withColumn("distance", euclidean(F.col(a), F.col(b)))


def matrix(vectors: DataFrame, order: str, column: str = "vector") -> np.ndarray:
    """The vectors as rows of one matrix on the driver, in order of a column; vectors of different sizes are an error.

    A matrix is a local value: this is for as many rows as the caller wants in memory, MATRIX_CELLS cells at most.
    """
    d = dimension(vectors, column).first()["dimension"]
    n = vectors.where(F.col(column).isNotNull()).count()
    if d is None and n:
        raise ValueError("vectors differ in their dimension")
    if n * (d or 0) > MATRIX_CELLS:
        raise ValueError(f"{n} rows of {d} are more than {MATRIX_CELLS} cells")
    rows = vectors.where(F.col(column).isNotNull()).orderBy(order).select(F.col(column).cast("array<double>").alias("v")).collect()
    return np.array([r["v"] for r in rows], dtype=float).reshape(n, d or 0)


MATRIX_CELLS = 50_000_000
#: Queries that are held against a batch of rows at once, and numbers in all queries that one scan of the rows serves.
QUERY_BLOCK, QUERY_CELLS = 256, 8_000_000


def nearest(vectors: DataFrame, queries: DataFrame, k: int, key: str, column: str = "vector") -> DataFrame:
    """(query, neighbour, distance, rank): the k nearest rows of each query, itself left out; ties go to the lesser key.

    The queries are a stated set, held against all rows in blocks.  One scan serves QUERY_CELLS numbers of queries: their
    count and size are checked first, and more of them take more scans, each of a range of keys.  Each batch of rows
    gives at most k candidates a query, so what is shuffled grows with the number of batches and not with the pairs.
    """
    asked = queries.select(F.col(key).cast("bigint").alias("key"), F.col(column).cast("array<double>").alias("v")).where("key is not null and v is not null")
    size = asked.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("v")), F.lit(0)).alias("cells")).first()
    scans = max(1, -(-size["cells"] // QUERY_CELLS))
    cuts = sorted(set(asked.agg(F.percentile_approx("key", [i / scans for i in range(1, scans)], 100 * scans)).first()[0])) if scans > 1 else []
    out = None
    for lo, hi in zip([None, *cuts], [*cuts, None], strict=True):
        part = asked.where((F.lit(True) if lo is None else F.col("key") > lo) & (F.lit(True) if hi is None else F.col("key") <= hi))
        got = _nearest_of(vectors, part.orderBy("key").collect(), k, key, column)  # about QUERY_CELLS numbers
        out = got if out is None else out.unionByName(got)
    ranked = out.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("d", "neighbour"))).where(F.col("rank") <= k)
    return ranked.select("query", "neighbour", F.sqrt("d").alias("distance"), "rank")


def _nearest_of(vectors: DataFrame, asked: list, k: int, key: str, column: str) -> DataFrame:
    by_size: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for d in {len(r["v"]) for r in asked}:
        mine = [r for r in asked if len(r["v"]) == d]
        by_size[d] = np.array([r["key"] for r in mine], dtype=np.int64), np.array([r["v"] for r in mine], dtype=float).reshape(len(mine), d)
    shared = vectors.sparkSession.sparkContext.broadcast(by_size)

    def run(batches):
        for b in batches:
            keys, rows = b.column(0).to_numpy(zero_copy_only=False), b.column(1)
            sizes = np.array([-1 if n is None else n for n in pc.list_value_length(rows).to_pylist()])
            found = []
            for d, (ids, points) in shared.value.items():
                mine = np.flatnonzero(sizes == d)
                if not len(mine):
                    continue
                x = rows.take(pa.array(mine)).flatten().to_numpy(zero_copy_only=False).reshape(len(mine), d)
                own = keys[mine].astype(np.int64)
                for lo in range(0, len(ids), QUERY_BLOCK):
                    found += _block(own, x, ids[lo : lo + QUERY_BLOCK], points[lo : lo + QUERY_BLOCK], k)
            cols = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["query", "neighbour", "d"])

    given = vectors.select(F.col(key).cast("bigint").alias("key"), F.col(column).cast("array<double>").alias("v")).where("key is not null")
    return given.mapInArrow(run, "query bigint, neighbour bigint, d double")


def _block(keys: np.ndarray, x: np.ndarray, ids: np.ndarray, points: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Candidates of each query: a matrix product finds those that may be among the k nearest, differences give their distances."""
    xx, pp = (x * x).sum(1), (points * points).sum(1)
    rough = xx[None, :] - 2 * (points @ x.T) + pp[:, None]
    itself = ids[:, None] == keys[None, :]
    rough[itself] = np.inf
    out = []
    for i in range(len(ids)):
        top = min(k, len(keys)) - 1
        # The product is off by a few units in the last place of the squares that it subtracts.
        slack = 1e-9 * (pp[i] + xx.max()) + 1e-300
        near = np.flatnonzero((rough[i] <= np.partition(rough[i], top)[top] + slack) & ~itself[i])
        d = ((x[near] - points[i]) ** 2).sum(1)
        order = np.lexsort((keys[near], d))[:k]
        out.append((np.full(len(order), ids[i], dtype=np.int64), keys[near][order], d[order]))
    return out
