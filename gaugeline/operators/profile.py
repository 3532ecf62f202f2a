"""The profile of a feed: one aggregation over rows, one over (position, field), both with partial sums on the map side.

Rows have ``bad`` and ``fields`` (sources.text, sources.tables).  Good rows of different widths are profiled at every
position that any of them has; a row that lacks a position leaves no trace there.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from gaugeline.functions import fields as f

#: Distinct values from which on a field counts as free text.
FREEFORM = 50
MAX_PII = 1000
#: Distinct values are first counted in this share of the hash space; fields that reach the threshold there are done.
SLICES = 64


def row_summary(rows: DataFrame) -> DataFrame:
    """One row: total_rows, bad_rows, field_counts (the distinct widths of good rows, ascending)."""
    width = F.when(~F.col("bad"), F.size("fields"))
    return rows.agg(F.count("*").alias("total_rows"), F.count_if("bad").alias("bad_rows"), F.array_sort(F.collect_set(width)).alias("field_counts"))


def date_summary(rows: DataFrame, date: Column) -> DataFrame:
    """First and last date, and the rendered range; 'no-dates' where there is none."""
    span = rows.agg(F.min(date).alias("first_date"), F.max(date).alias("last_date"))
    rendered = F.concat(F.date_format("first_date", "yyyy-MM-dd"), F.lit("_"), F.date_format("last_date", "yyyy-MM-dd"))
    return span.withColumn("date_range", F.coalesce(rendered, F.lit("no-dates")))


def exploded(rows: DataFrame) -> DataFrame:
    """(pos, value) of all fields of good rows."""
    return rows.where(~F.col("bad")).select(F.posexplode("fields").alias("pos", "value"))


def look_counts() -> list[Column]:
    """Counters of the five looks, from a column ``look``."""
    return [F.count_if(F.col("look") == name).alias(name.removeprefix("looks-")) for name in f.LOOKS]


def numeric_stats() -> list[Column]:
    """Count and moments of a column ``num``; other values leave no trace.  The deviation divides by the count."""
    return [F.count("num").alias("n_numeric"), F.min("num").alias("minimum"), F.max("num").alias("maximum"), F.avg("num").alias("mean"), F.stddev_pop("num").alias("stddev")]


def annotated(cells: DataFrame) -> DataFrame:
    """Cells with look and number; the number is parsed only where the look says so."""
    look = cells.withColumn("look", f.looks(F.col("value")))
    return look.withColumn("num", F.when(f.looks_numeric(F.col("look")), F.col("value").try_cast("double")))


def field_profile(rows: DataFrame) -> DataFrame:
    """One row a position: look counters and numeric summary."""
    return annotated(exploded(rows)).groupBy("pos").agg(*look_counts(), *numeric_stats())


def free_fields(cells: DataFrame, threshold: int = FREEFORM, slices: int = SLICES) -> DataFrame:
    """(pos, free): fields that reach the threshold within one slice of the hash space, so that they are free text for certain."""
    one = _hashed(cells).where(F.pmod("h", F.lit(slices)) == 0).distinct().groupBy("pos").agg(F.count("*").alias("n"))
    return one.where(F.col("n") >= threshold).select("pos", F.lit(True).alias("free"))


def _hashed(cells: DataFrame) -> DataFrame:
    return cells.select("pos", f.text_hash(F.coalesce("value", F.lit(""))).alias("h"))


def _classified(counted: DataFrame, threshold: int) -> DataFrame:
    """Adds uniques and form from n, the distinct values; null for fields known to be free."""
    categorical = F.coalesce(F.col("n") < threshold, F.lit(False))
    return counted.withColumns({"uniques": F.when(categorical, F.col("n")), "form": F.when(categorical, F.lit("unique-text-count")).otherwise(F.lit("looks-freeform"))})


def capped_distinct(cells: DataFrame, threshold: int = FREEFORM, slices: int = SLICES) -> DataFrame:
    """(pos, uniques, form): exact distinct counts below the threshold; from it on 'looks-freeform' and no count.

    Free text is found in one slice of the hash space, so its values are never shuffled: only fields that might be
    categorical are counted in full.
    """
    free = free_fields(cells, threshold, slices)
    # One row a field on the broadcast side: bounded by the width of a record.  The slice is scanned once, its exchange is reused.
    rest = _hashed(cells).join(F.broadcast(free), "pos", "left_anti").distinct().groupBy("pos").agg(F.count("*").alias("n"))
    counted = rest.unionByName(free.select("pos", F.lit(None).cast("bigint").alias("n")))
    return _classified(counted, threshold).select("pos", "uniques", "form")


def distinct_hashes(cells: DataFrame, threshold: int = FREEFORM) -> DataFrame:
    """(pos, form, uniques, hashes): with the sorted hashes of fields below the threshold, null for free text.

    Counted and listed in one pass: distinct hashes are numbered within their field and those from the threshold on go
    before any are listed, so a list has at most ``threshold``.
    """
    free = free_fields(cells, threshold)
    once = _hashed(cells).join(F.broadcast(free), "pos", "left_anti").distinct()
    few = once.withColumn("r", F.row_number().over(Window.partitionBy("pos").orderBy("h"))).where(F.col("r") <= threshold)
    listed = few.groupBy("pos").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("h")).alias("hashes"))
    counted = listed.unionByName(free.select("pos", F.lit(None).cast("bigint").alias("n"), F.lit(None).cast("array<bigint>").alias("hashes")))
    return _classified(counted, threshold).select("pos", "form", "uniques", F.when(F.col("uniques").isNotNull(), F.col("hashes")).alias("hashes"))


def pii_observations(cells: DataFrame, most: int = MAX_PII) -> DataFrame:
    """One row: how many observations, whether they are too many, and otherwise (type, pos, n) sorted.

    Observations are counted by kind and position before they meet, so the list is as long as there are kinds and
    positions, however many cells match.
    """
    found = cells.select("pos", f.pii_type(F.col("value")).alias("type")).where("type is not null").groupBy("type", "pos").agg(F.count("*").alias("n"))
    listed = found.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("observations"), F.array_sort(F.collect_list(F.struct("type", "pos", "n"))).alias("found"))
    return listed.select("observations", (F.col("observations") > most).alias("too_many"), F.when(F.col("observations") <= most, F.col("found")).alias("found"))


def pii_counts() -> list[Column]:
    """Counters of the kinds of personal data, from a column ``pii``: the observations of a profile without a pass of their own."""
    return [F.count_if(F.col("pii") == k).alias(f"pii_{k}") for k in f.PII_NAMES]


def observations_of(profiled: DataFrame, most: int = MAX_PII) -> DataFrame:
    """The row of ``pii_observations`` from a profile with the counters of ``pii_counts``."""
    kinds = F.array(*[F.struct(F.lit(k).alias("type"), F.col("pos").cast("int").alias("pos"), F.col(f"pii_{k}").cast("bigint").alias("n")) for k in f.PII_NAMES])
    found = profiled.select(F.explode(F.filter(kinds, lambda x: x["n"] > 0)).alias("x"))
    listed = found.agg(F.coalesce(F.sum("x.n"), F.lit(0)).alias("observations"), F.array_sort(F.collect_list("x")).alias("found"))
    return listed.select("observations", (F.col("observations") > most).alias("too_many"), F.when(F.col("observations") <= most, F.col("found")).alias("found"))


def pii_by_field(cells: DataFrame) -> DataFrame:
    """(pos, type, n): potential personal data by field and kind."""
    return cells.select("pos", f.pii_type(F.col("value")).alias("type")).where("type is not null").groupBy("pos", "type").agg(F.count("*").alias("n"))


#: Hexadecimal digits of a row's draw.
DRAW_DIGITS = 15


def with_draw(rows: DataFrame, key: list[str] | None = None, seed: int = 0) -> DataFrame:
    """Good rows with ``draw``, a uniform hexadecimal number.

    It comes from the columns of a unique key, and then doesn't depend on partitions; without a key from the place
    that the row is read at, so that rows of equal content are drawn apart.
    """
    places = [F.monotonically_increasing_id().alias("__place")] if key is None else []
    placed = rows.select("*", *places).where(~F.col("bad"))
    names = [F.col(k).cast("string") for k in key] if key else [F.col("__place").cast("string")]
    return placed.withColumn("draw", F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *names)), 1, DRAW_DIGITS)).drop("__place")


def _cut(share: float) -> str:
    """The draw below which this share of rows lies."""
    return f"{min(16**DRAW_DIGITS - 1, int(share * 16**DRAW_DIGITS)):0{DRAW_DIGITS}x}"


def reservoir(drawn: DataFrame, size: int, numbers: dict[int, int] | None = None) -> DataFrame:
    """(pos, sample): ``size`` numbers of each numeric field, uniformly: those of the rows with the least draws.

    ``numbers`` says how many numbers a field has, as a profile knows; without it they are counted first.  From the count
    follows a draw that all of the sample lie below but for one case in a thousand million, so hardly a row is looked
    at; a field that comes out short all the same is drawn from all of its rows.
    """
    if numbers is None:
        numbers = {r["pos"]: r["n"] for r in annotated(exploded(drawn)).groupBy("pos").agg(F.count("num").alias("n")).collect()}
    numbers = {p: n for p, n in numbers.items() if n}
    share = {p: min(1.0, (size + 6 * size**0.5 + 20) / n) for p, n in numbers.items()}
    first = _drawn(drawn, size, share)
    if all(x == 1.0 for x in share.values()):
        return first
    got = {r["pos"]: r["sample"] for r in first.collect()}  # at most ``size`` numbers a field
    short = {p: 1.0 for p, n in numbers.items() if len(got.get(p, ())) < min(size, n)}
    again = {r["pos"]: r["sample"] for r in _drawn(drawn, size, short).collect()} if short else {}
    return drawn.sparkSession.createDataFrame(sorted((got | again).items()), "pos int, sample array<double>")


def _drawn(drawn: DataFrame, size: int, share: dict[int, float]) -> DataFrame:
    whole = any(x == 1.0 for x in share.values())
    rows = drawn if whole or not share else drawn.where(F.col("draw") <= _cut(max(share.values())))
    cuts = F.create_map(*[F.lit(x) for p, s in share.items() for x in (p, "g" if s == 1.0 else _cut(s))]) if share else F.create_map().cast("map<int,string>")
    cells = rows.select("draw", F.posexplode("fields").alias("pos", "value")).where(F.col("draw") <= cuts[F.col("pos")])
    found = cells.select("pos", "draw", f.numeric_value(F.col("value")).alias("num")).where("num is not null")
    ranked = found.withColumn("r", F.row_number().over(Window.partitionBy("pos").orderBy("draw", "num"))).where(F.col("r") <= size)
    return ranked.groupBy("pos").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "num"))), lambda x: x["num"]).alias("sample"))


def sample_median(sample: Column) -> Column:
    """Middle of the sorted sample, the mean of two for an even size; null below two values."""
    return F.transform(
        F.array(F.array_sort(sample)),
        lambda s: F.when(F.size(s) < 2, F.lit(None)).when(F.size(s) % 2 == 1, F.get(s, (F.size(s) / 2).cast("int"))).otherwise((F.get(s, (F.size(s) / 2).cast("int") - 1) + F.get(s, (F.size(s) / 2).cast("int"))) / 2),
    )[0]


#: Buckets that numbers are first counted by, for each doubling, and numbers of a group that are sorted in one place.
ACCURACY, SORTED_AT_ONCE = 1_000, 2_000_000
#: Open groups up to which other groups' cells are passed over before their numbers are made.
LISTED = 100


def exact_medians(cells: DataFrame, group: str = "pos", num: str = "num") -> DataFrame:
    """(group, median): the exact median of each group's numbers, null below two; null numbers don't count.

    Numbers are counted by buckets that follow their order, so the counts say which bucket has the middle.  If a single
    number fills it, or the middle lies between two buckets, the buckets' ends give the median.  Else only the distinct
    numbers of that bucket are sorted, after finer buckets where it holds more than SORTED_AT_ONCE, so no task holds a
    group, however large.
    """
    given = cells.select(F.col(group).alias("g"), F.col(num).cast("double").alias("x"))
    ends = [F.count("x").alias("c"), F.min("x").alias("a"), F.max("x").alias("b")]
    counted = given.groupBy("g", _octaves(F.col("x")).alias("k")).agg(*ends)
    done, left = _middles(counted.withColumns({"n": F.sum("c").over(Window.partitionBy("g")), "below": F.lit(0).cast("bigint")}))
    while any(x[-1] > SORTED_AT_ONCE for x in left.values()):
        finer = F.floor((F.col("x") - F.col("a")) / (F.col("b") - F.col("a")) * ACCURACY)
        more, open_ = _middles(_within(given, left).groupBy("g", finer.alias("k"), "n", "below").agg(*ends))
        shrunk = len(open_) < len(left) or any(x[-1] < left[g][-1] for g, x in open_.items())
        done, left = done | more, open_
        if not shrunk:  # infinite numbers, which no finer buckets part
            break
    found = given.sparkSession.createDataFrame(list(done.items()), T.StructType([given.schema["g"], T.StructField("median", T.DoubleType())]))
    if left:
        once = _within(given, left).groupBy("g", "x", "n", "below").agg(F.count("*").alias("c"))
        upto = once.withColumn("upto", F.col("below") + F.sum("c").over(Window.partitionBy("g").orderBy("x")))
        lower, upper = (F.min_by("x", F.when(F.col("upto") > rank, F.col("upto"))) for rank in _ranks())
        found = found.unionByName(upto.groupBy("g").agg(((lower + upper) / 2).alias("median")))
    return found.withColumnRenamed("g", group)


def _ranks() -> list[Column]:
    """How many of a group's ``n`` numbers come before each of the two in the middle."""
    return [F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)]


def _octaves(x: Column) -> Column:
    """A whole number that never falls as x rises, ACCURACY of them for each doubling; null for null.

    Spark's logarithm is semi-monotonic by its definition (StrictMath); infinities and NaN come after all numbers.
    """
    place = F.floor(F.least(F.log(F.abs(x)), F.lit(711.0)) * (ACCURACY / math.log(2))) + 1100 * ACCURACY
    return F.when(x == 0, F.lit(0)).when(x > 0, place).when(x < 0, -place)


def _middles(counted: DataFrame) -> tuple[dict, dict]:
    """From counts ``c`` and ends ``a``, ``b`` by bucket: the medians that they decide, and for each other group its count, how
    many of its numbers are below the bucket of the middle, that bucket's ends, and how many it holds."""
    upto = counted.withColumn("upto", F.col("below") + F.sum("c").over(Window.partitionBy("g").orderBy(F.col("k").asc_nulls_first())))
    bucket = F.struct("a", "b", (F.col("upto") - F.col("c")).alias("below"), F.col("c").alias("held"))
    lower, upper = (F.min_by(bucket, F.when(F.col("upto") > rank, F.col("upto"))) for rank in _ranks())
    done, left = {}, {}
    for r in upto.groupBy("g").agg(F.max("n").alias("n"), lower.alias("lower"), upper.alias("upper")).collect():  # one row a group
        at, then = r["lower"], r["upper"]
        if r["n"] < 2:
            done[r["g"]] = None
        elif at["below"] != then["below"]:
            done[r["g"]] = (at["b"] + then["a"]) / 2
        elif at["a"] == at["b"]:
            done[r["g"]] = at["a"]
        else:
            left[r["g"]] = (r["n"], at["below"], at["a"], at["b"], at["held"])
    return done, left


def _within(given: DataFrame, left: dict) -> DataFrame:
    """The numbers of the open groups' buckets, with ``n``, ``below`` and the ends."""
    kind, whole, real = given.schema["g"].dataType, T.LongType(), T.DoubleType()
    shape = T.StructType([T.StructField("h", kind), T.StructField("n", whole), T.StructField("below", whole), T.StructField("a", real), T.StructField("b", real)])
    frame = given.sparkSession.createDataFrame([(g, *x[:-1]) for g, x in left.items()], shape)
    if len(left) <= LISTED:
        given = given.where(F.col("g").isin([g for g in left if g is not None]) | (F.col("g").isNull() if None in left else F.lit(False)))
    # The condition is false, not null, for no number: else Spark would make each number twice, once to see whether it is there.
    here = F.coalesce((F.col("x") >= F.col("a")) & (F.col("x") <= F.col("b")), F.lit(False))
    return given.join(F.broadcast(frame), F.col("g").eqNullSafe(F.col("h")) & here).drop("h")  # one row a group
