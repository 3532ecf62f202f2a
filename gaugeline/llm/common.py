"""Shared pieces of the training-data operators: inputs, shared storage, word rules.

Tables are read by Spark only, so any store that Spark reads will do.  Intermediate tables go to the
folder that ``spark.checkpoint.dir`` names, which all executors share; they are plain Parquet files, so a
lost executor costs a re-read and never a wrong result.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: White space that separates words everywhere in this subpackage: space and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]+"
NO_ID = -(2**63)
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
ROWS_PER_BATCH = 2000


def ship_code(spark: SparkSession) -> None:
    """Ready a session: batches of a size for texts, and this package on executors whose environment lacks it."""
    if int(spark.conf.get(BATCH_ROWS)) > ROWS_PER_BATCH:
        # Texts are long rows: Spark's default of 10,000 would put tens of MB into each batch on both sides.
        spark.conf.set(BATCH_ROWS, str(ROWS_PER_BATCH))
    root = Path(__file__).resolve().parents[2]
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    if is_local(spark):
        # Workers are children of this process: they see what PYTHONPATH and the working directory show.
        known = {Path(p).resolve() for p in [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()] if p}
        if root in known:
            return
    _shipped.add(sc.applicationId)
    package = Path(tempfile.mkdtemp(prefix="gaugeline-code-")) / "gaugeline.zip"
    with zipfile.ZipFile(package, "w") as z:
        for f in sorted((root / "gaugeline").rglob("*.py")):
            z.write(f, f.relative_to(root))
    sc.addPyFile(str(package))


def is_local(spark: SparkSession) -> bool:
    """Whether all runs in this machine's one process."""
    return spark.sparkContext.master.split("[")[0] == "local"


def ready(df: DataFrame) -> DataFrame:
    """The same rows, once executors have this package: functions take note of shipped code when they are handed to Spark,
    so every operator that runs Python begins with this."""
    ship_code(df.sparkSession)
    return df


_shipped: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_code(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; a temporary one only where the setting is absent and all runs on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not is_local(spark):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="gaugeline-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here, and retries re-read files.

    The table goes when the driver ends; until then lazy results may still read it.
    """
    spark = df.sparkSession
    ship_code(spark)
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def folded_slices(parts: DataFrame, fold, sent: str, dtype: str, slices: int, slice_bytes: int, fan: int = 64) -> bytes:
    """All tasks' slices (part, data) of one array of type ``sent`` folded (np.add, np.bitwise_or) into the array of ``dtype``.

    The fold is a tree: ``fan`` tasks at a time, twice, before the rest meet, so no group holds a slice of every task.
    Slices that no task has sent are zero.
    """
    import numpy as np
    import pyarrow as pa

    def folded(key, table, kind):
        total = None
        for x in table.column("data"):
            got = np.frombuffer(x.as_buffer(), dtype=kind)
            total = got.astype(dtype) if total is None else fold(total, got, out=total)
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "task": pa.array([(key[1].as_py() if len(key) > 1 else 0) // fan], pa.int32()), "data": pa.array([total.tobytes()], pa.binary())})

    def at_level(kind):
        return lambda key, table: folded(key, table, kind)

    shape = "part int, task int, data binary"
    level = parts.select("part", (F.spark_partition_id() / fan).cast("int").alias("task"), "data")
    for kind in (sent, dtype):
        level = level.groupBy("part", "task").applyInArrow(at_level(kind), shape)
    got = {r["part"]: bytes(r["data"]) for r in level.groupBy("part").applyInArrow(at_level(dtype), shape).collect()}
    return b"".join(got.get(i, bytes(slice_bytes)) for i in range(slices))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``; Catalyst would otherwise repeat a shared expression."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The array of words of a text; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id written as text, modulo n."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n))
