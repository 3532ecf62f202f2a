"""Labelled rows for fitting: a bounded sample, the same at every run and whatever the partitioning."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import ready

#: Labelled rows that a classifier is fitted on, about; all of them where there are fewer.
SAMPLE_ROWS = 12_000


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, usable: Column, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, text, y, fold) of about ``rows`` labelled rows.

    Rows are taken by a hash of the id below rows / n, so no sort and no per-partition limit is involved.  Labels
    that are null or neither 0 nor 1, rows without an id and ids labelled both ways are left out; of documents that
    repeat an id the least text stands for it.
    """
    mine = labels.select("doc_id", F.col(target).cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & usable)
    n = mine.count()
    share = min(1.0, rows / max(1, n))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1_000_003))
    few = mine.where(draw < int(share * 1_000_003) + 1).groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("other")).where(F.col("y") == F.col("other"))
    fold = F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(3)).cast("int").alias("fold")
    # At most about ``rows`` ids: a size known here, so the large side needs no shuffle.
    met = ready(docs).select("doc_id", "text").join(F.broadcast(few.drop("other")), "doc_id")
    return met.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y")).select("doc_id", "text", "y", fold)


def by_batch(f: Callable[[list[str]], dict[str, np.ndarray]], text: str = "text"):
    """A function for mapInArrow that replaces the text column by the columns that ``f`` makes of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = {n: batch.column(i) for i, n in enumerate(batch.schema.names) if n != text}
            made = f([t or "" for t in batch.column(text).to_pylist()])
            yield pa.RecordBatch.from_pydict(kept | {k: pa.array(v) for k, v in made.items()})

    return run
