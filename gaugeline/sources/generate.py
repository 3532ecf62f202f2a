"""Synthetic views, the same for a seed however many partitions write them."""

from __future__ import annotations

import random

from pyspark.sql import SparkSession, functions as F


def generate_view(spark: SparkSession, root: str, lines: int = 1_000_000, fields: int | None = None, files: int = 4, long_lines: bool = False, seed: int = 0, separator: str = "|") -> int:
    """Write a valid view of text files and return the number of fields: at least two, mixed in kind."""
    rnd = random.Random(seed)
    n = fields or rnd.randint(2, 12)
    width = 10_000 if long_lines else 20
    kinds = [rnd.choice(("integral", "real", "boolean", "text", "category")) for _ in range(n)]
    days = sorted({(rnd.randint(2010, 2020), rnd.randint(1, 12), rnd.randint(1, 28)) for _ in range(files)})
    row = spark.range(lines).withColumn("h", F.xxhash64("id", F.lit(seed)))

    def value(i: int, kind: str):
        h = F.xxhash64("id", F.lit(seed), F.lit(i))
        return {
            "integral": F.pmod(h, F.lit(100_000)).cast("string"),
            "real": F.format_string("%d.%02d", F.pmod(h, F.lit(1000)), F.pmod(F.shiftright(h, 20), F.lit(100))),
            "boolean": F.when(h % 2 == 0, "true").otherwise("f"),
            "text": F.substring(F.repeat(F.md5(h.cast("string")), width // 32 + 1), F.lit(1), (F.pmod(h, F.lit(width)) + 1).cast("int")),
            "category": F.concat(F.lit("c"), F.pmod(h, F.lit(7)).cast("string")),
        }[kind]

    line = F.concat_ws(separator, *[value(i, k) for i, k in enumerate(kinds)]).alias("value")
    for j, (y, m, d) in enumerate(days):
        path = f"{root}/year={y:04d}/month={m:02d}/day={d:02d}"
        row.where(F.pmod("h", F.lit(len(days))) == j).select(line).coalesce(1 if lines < 1_000_000 else 8).write.mode("overwrite").option("lineSep", "\n").text(path)
    return n
