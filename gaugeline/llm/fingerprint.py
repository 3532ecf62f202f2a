"""Document fingerprints: a bottom-k sketch of five-word shingle hashes, in DataFrame functions only.

A sketch is the ascending array of the k smallest distinct 64-bit hashes of a text's shingles.  Sketches of
parts merge into the sketch of the whole (``merge``), and two sketches estimate resemblance, containment and
the number of distinct shingles.  Sets of fewer than k shingles are held whole, so their figures are exact.

Defined cases: a null text counts as empty; a text of one to four words is one shingle; an empty text has the
empty sketch; two empty sketches resemble each other with 1.0, an empty and a non-empty one with 0.0; equal
texts have equal sketches; rows that repeat are kept, each with its own result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import NO_ID, let, words

WORDS_PER_SHINGLE = 5
#: Sketch size: the standard error of a resemblance r is sqrt(r (1 - r) / k), at most 0.045.
K = 128
#: Rows that one window group holds, about, and ids that are looked at for each bound between groups.  Bounds travel with the
#: plan; beyond MOST_BUCKETS groups hold more rows, which windows sort on disk.
ROWS_PER_BUCKET, IDS_PER_BOUND = 2048, 20
MOST_BUCKETS = 100_000


def _paired(a: Column, b: Column, gap: int) -> Column:
    """Hash of a[i] with b[i + gap], as far as both reach."""
    n = F.least(F.size(a), F.size(b) - gap)
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1 + gap), n), lambda x, y: F.xxhash64(x, y))


def shingle_hashes(text: Column) -> Column:
    """One hash per position of a five-word shingle of the lower-cased words.

    Built from hashes of words, pairs and fours: three cheap passes over longs, no slice per shingle.
    """
    return let(
        words(F.lower(text)),
        lambda w: F.when(F.size(w) == 0, F.array().cast("array<bigint>"))
        .when(F.size(w) <= WORDS_PER_SHINGLE, F.array(F.xxhash64(w)))
        .otherwise(
            let(
                F.transform(w, lambda x: F.xxhash64(x)),
                lambda h: let(_paired(h, h, 1), lambda two: let(_paired(two, two, 2), lambda four: _paired(four, h, 4))),
            )
        ),
    )


def bottom(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def sketch(text: Column, k: int = K) -> Column:
    return bottom(shingle_hashes(text), k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union of the two shingle sets."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_parts(parts: DataFrame, key: str, sketch_col: str = "sketch", k: int = K) -> DataFrame:
    """One sketch per key from sketches of its parts.

    The hashes are ranked per key and salt first, so a key with very many parts is cut to k hashes per salt
    before its salts meet in one group.
    """
    one = parts.select(key, F.explode(sketch_col).alias("h")).distinct()
    salted = Window.partitionBy(key, F.pmod(F.col("h"), F.lit(64))).orderBy("h")
    few = one.withColumn("r", F.row_number().over(salted)).where(F.col("r") <= k)
    return few.groupBy(key).agg(F.slice(F.sort_array(F.collect_list("h")), 1, k).alias(sketch_col))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity of two shingle sets."""
    return F.when(a == b, F.lit(1.0)).otherwise(
        let(merge(a, b, k), lambda u: F.when(F.size(u) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(F.array_intersect(u, a), b)) / F.size(u)))
    )


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below k, else (k - 1) over the k-th smallest hash's rank in the range."""
    reach = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / reach)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has."""
    whole = distinct_count(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), resemblance(a, b, k) * whole / distinct_count(a, k)))


def render(a: Column) -> Column:
    """Sketch as text: the hashes in hexadecimal, joined by dots."""
    return F.concat_ws(".", F.transform(a, lambda x: F.lower(F.hex(x))))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", derived: dict[str, Column] | None = None) -> DataFrame:
    """Each row with ``next_<text_col>``, the text of the next row by id; the first row's follows the last.

    ``derived`` names columns made from a row once it has been dealt out; they are led as well.

    Rows are in order of id, then of a hash of the text, so many rows of one id fall into many buckets.  The bounds between
    buckets are places of rows, from a sample of bounded size, so each bucket's first row is known beforehand and goes to
    the bucket before it too.  One shuffle of the texts, no global sort, no group of unbounded size.  A null id sorts first.
    """
    key, mark = F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)), F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    placed = docs.withColumns({"_k": key, "_h": mark})
    stats = placed.agg(F.count("*").alias("n"), F.min(F.struct("_k", "_h")).alias("first")).first()
    n, first = stats["n"], stats["first"]
    buckets = max(1, min(MOST_BUCKETS, -(-n // ROWS_PER_BUCKET)))
    bounds: list[tuple[int, int]] = []
    if buckets > 1:
        # One row in so many, by its hash: about IDS_PER_BOUND for each bucket reach the driver.
        every = max(1, n // (buckets * IDS_PER_BOUND))
        sample = placed.where(F.pmod(F.xxhash64("_k", "_h", F.lit(5)), F.lit(every)) == 0).select("_k", "_h").distinct()
        seen = sorted((r["_k"], r["_h"]) for r in sample.collect())
        bounds = [x for x in seen[IDS_PER_BOUND // 2 :: max(1, len(seen) // buckets)] if x > tuple(first)]
    cut = {c: F.from_json(F.lit(str([x[i] for x in bounds])), "array<bigint>") for i, c in enumerate(("_k", "_h"))}
    at = lambda c, i: F.get(cut[c], i)
    # Binary search for the number of bounds at or below the row's place.
    low = F.lit(0)
    if bounds:
        low = F.aggregate(
            F.array(*[F.lit(1 << s) for s in range(len(bounds).bit_length() - 1, -1, -1)]),
            F.lit(0),
            lambda lo, step: F.when((lo + step <= len(bounds)) & ((at("_k", lo + step - 1) < F.col("_k")) | ((at("_k", lo + step - 1) == F.col("_k")) & (at("_h", lo + step - 1) <= F.col("_h")))), lo + step).otherwise(lo),
        )
    placed = placed.withColumn("_b", low)
    opens = (at("_k", F.col("_b") - 1) == F.col("_k")) & (at("_h", F.col("_b") - 1) == F.col("_h")) if bounds else F.lit(False)
    starts = (F.col("_k") == first["_k"]) & (F.col("_h") == first["_h"]) if first else F.lit(False)
    places = F.array(
        F.struct(F.col("_b").alias("b"), F.lit(0).alias("copy")),
        F.when((F.col("_b") > 0) & opens, F.struct((F.col("_b") - 1).alias("b"), F.lit(1).alias("copy"))),
        F.when(starts, F.struct(F.lit(len(bounds)).alias("b"), F.lit(1).alias("copy"))),
    )
    spread = placed.withColumn("_at", F.explode(F.filter(places, lambda x: x.isNotNull())))
    spread = spread.withColumns({"_b": F.col("_at.b"), "_copy": F.col("_at.copy")}).drop("_at").repartition("_b")
    spread = spread.withColumns(derived or {})
    order = Window.partitionBy("_b").orderBy("_copy", "_k", "_h", text_col)
    ahead = spread.withColumns({f"next_{c}": F.lead(c).over(order) for c in (text_col, *(derived or {}))})
    return ahead.where(F.col("_copy") == 0).drop("_b", "_copy", "_k", "_h")


def edited(text: Column, following: Column) -> Column:
    """The text with its last quarter of code points replaced by the start of the following text."""
    n = F.length(text)
    quarter = F.floor(n / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - quarter), F.substring(following, F.lit(1), quarter))


def fingerprint_documents(docs: DataFrame, k: int = K) -> DataFrame:
    """The contract's rows: every text, its edited form and the next text, sketched and compared."""
    rows = with_next(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), derived={"a": sketch(F.col("text"), k)})
    rows = rows.withColumn("edited", edited(F.col("text"), F.col("next_text")))
    rows = rows.select(
        "doc_id",
        F.length("text").cast("bigint").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        "a",
        sketch(F.col("edited"), k).alias("e"),
        F.col("next_a").alias("x"),
    )
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        render(F.col("a")).alias("fingerprint"),
        render(F.col("e")).alias("edited_fingerprint"),
        resemblance(F.col("a"), F.col("e"), k).alias("near_edited"),
        resemblance(F.col("a"), F.col("x"), k).alias("near_next"),
        distinct_count(F.col("a"), k).alias("n_shingles_estimate"),
        containment(F.col("a"), F.col("e"), k).alias("contained_in_edited"),
    )
