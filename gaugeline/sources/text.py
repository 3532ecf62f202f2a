"""Delimited text as rows of positional fields.

A record is a line; only line feeds end one, so a carriage return stays in the last field.  Two formats: plain
delimited text, where the separator splits and nothing escapes it, and quoted text.  A quoted field runs to the
first single quote mark that no second one follows; doubled ones stay doubled, one closing mark is dropped, and an
open quote takes the rest of the line.  After a field only a separator continues the record: anything else ends it and
the rest of the line is dropped.  Rows that aren't UTF-8, or are longer than the line bound, are bad rows.

The result of the readers has the columns ``file``, ``bad`` and ``fields``, the array of texts (null for bad rows).
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

LINE_BOUND = 65_536
FORMATS = ("delimited-text", "rfc4180")


def _literal(separator: str) -> str:
    return re.sub(r"([^A-Za-z0-9])", r"\\\1", separator)


def check_separator(separator: str) -> str:
    """One printable ASCII character, or a tab, also written \\t."""
    separator = "\t" if separator == "\\t" else separator
    if len(separator) != 1 or not (32 <= ord(separator) < 127 or separator == "\t"):
        raise ValueError(f"not a separator: {separator!r}")
    return separator


def split_delimited(line: Column, separator: str = "|") -> Column:
    """All fields, empty ones at the end included; a blank line is one empty field."""
    return F.split(line, _literal(check_separator(separator)), -1)


def split_quoted(line: Column, separator: str = "|") -> Column:
    """Fields of a line of quoted text; possessive quantifiers keep long lines linear."""
    s = _literal(check_separator(separator))
    piece = rf'\G{s}(?:"(?:[^"]|"")*+"?+|[^{s}"]*+)'
    raw = F.regexp_extract_all(F.concat(F.lit(separator), line), F.lit(piece), F.lit(0))
    return F.transform(raw, lambda x: F.when(F.substring(x, 2, 1) == '"', F.regexp_replace(F.substring(x, 3, 1 << 30), r'"\z', "")).otherwise(F.substring(x, 2, 1 << 30)))


def split_fields(line: Column, file_format: str = "delimited-text", separator: str = "|") -> Column:
    if file_format not in FORMATS:
        raise ValueError(f"unknown format {file_format!r}")
    return split_delimited(line, separator) if file_format == "delimited-text" else split_quoted(line, separator)


def parse_lines(lines: DataFrame, file_format: str = "delimited-text", separator: str = "|", line_bound: int = LINE_BOUND) -> DataFrame:
    """Rows from a column ``value`` of raw lines; other columns stay."""
    bad = ~F.is_valid_utf8(F.col("value")) | (F.octet_length("value") > line_bound)
    rest = [c for c in lines.columns if c != "value"]
    return lines.select(*rest, bad.alias("bad"), F.when(~bad, split_fields(F.col("value"), file_format, separator)).alias("fields"))


def read_files(spark: SparkSession, paths: list[str], file_format: str = "delimited-text", separator: str = "|", line_bound: int = LINE_BOUND) -> DataFrame:
    """Rows of explicit files.  Spark's sources pass over names that start with a dot; those are copied under plain names first."""
    hidden = {p for p in paths if p.rpartition("/")[2].startswith(".")}
    copies = _plain_copies(spark, sorted(hidden)) if hidden else {}
    lines = spark.read.option("lineSep", "\n").text([copies.get(p, p) for p in paths]).select(F.col("_metadata.file_path").alias("file"), "value")
    if copies:
        names = F.create_map(*[F.lit(x) for p, c in copies.items() for x in (c.rpartition("/")[2], p)])
        lines = lines.withColumn("file", F.coalesce(names[F.substring_index("file", "/", -1)], F.col("file")))
    return parse_lines(lines, file_format, separator, line_bound)


def _plain_copies(spark: SparkSession, paths: list[str]) -> dict[str, str]:
    """Copies of dot-files, streamed from file system to file system, in the folder that all executors share; they go when the driver ends."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    folder = f"{shared_folder(spark)}/plain-{uuid.uuid4().hex}"
    out = {}
    for i, p in enumerate(paths):
        src, dst = jvm.org.apache.hadoop.fs.Path(p), jvm.org.apache.hadoop.fs.Path(f"{folder}/{i}-{p.rpartition('/')[2].lstrip('.') or 'file'}")
        if not jvm.org.apache.hadoop.fs.FileUtil.copy(src.getFileSystem(conf), src, dst.getFileSystem(conf), dst, False, conf):
            raise OSError(f"{p} can't be copied")
        out[p] = dst.toString()
    place = jvm.org.apache.hadoop.fs.Path(folder)
    place.getFileSystem(conf).deleteOnExit(place)
    return out


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one where it is unset and all runs on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="gaugeline-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder
