"""The same profile over a stream of files: every aggregate of it merges, so each batch adds to what is held.

State is one row a position, so no watermark is needed.  Distinct counts and samples are batch work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gaugeline.operators.profile import annotated, look_counts, numeric_stats
from gaugeline.sources.text import LINE_BOUND, parse_lines


def stream_rows(spark: SparkSession, folder: str, file_format: str = "delimited-text", separator: str = "|", line_bound: int = LINE_BOUND, files_per_trigger: int = 100) -> DataFrame:
    """Rows of the text files that arrive in a directory."""
    lines = spark.readStream.option("lineSep", "\n").option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_trigger).text(folder)
    return parse_lines(lines, file_format, separator, line_bound)


def stream_field_profile(rows: DataFrame) -> DataFrame:
    """One row a position, as in the batch profile; write it in complete or update mode."""
    cells = rows.where(~F.col("bad")).select(F.posexplode("fields").alias("pos", "value"))
    return annotated(cells).groupBy("pos").agg(*look_counts(), *numeric_stats())


def stream_row_summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy().agg(F.count("*").alias("total_rows"), F.count_if("bad").alias("bad_rows"), F.array_sort(F.collect_set(F.when(~F.col("bad"), F.size("fields")))).alias("field_counts"))
