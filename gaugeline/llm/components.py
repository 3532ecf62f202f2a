"""Connected components of a graph of links, with DataFrames only: alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import materialise


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]


#: A key is hot that has more rows than this, and than one in HOT_KEYS of all rows; so there are at most HOT_KEYS of them.
HOT_ROWS, HOT_KEYS = 1000, 10_000


def join_hot(rows: DataFrame, one: DataFrame, key: str, n: int, degree: str) -> DataFrame:
    """Inner join of ``rows``, n of them, with a table of one row a key that knows each key's number of rows (``degree``).

    Rows of hot keys meet their key's row by broadcast, where they are; HOT_KEYS bounds that side.  Only the others are shuffled.
    """
    hot = F.col(degree) > max(HOT_ROWS, n // HOT_KEYS)
    some = one.where(hot)
    rest = rows.join(F.broadcast(some.select(key)), key, "left_anti").join(one.where(~hot), key)
    return rest.unionByName(rows.join(F.broadcast(some), key)).drop(degree)


def components(links: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(node, root) for every node of ``links`` (u, v): root is the least node that it reaches.

    Each round's edges are a stored table, so a lost executor costs one round.  Least neighbours are aggregated
    before they are shuffled, and the edges of a large star's centre aren't shuffled by it.  Edges that haven't settled when
    the rounds run out are an error.  Null nodes have no links; links that repeat or that join a node to itself are fine.
    """
    edges = materialise(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = _state(edges)
    for _ in range(most_rounds):
        if not state[0]:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree")).select("u", F.least("u", "m").alias("m"), "degree")
        large = join_hot(both, least, "u", 2 * state[0], "degree").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        edges = materialise(small.where("u <> v").distinct(), "edges")
        now = _state(edges)
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components haven't settled in {most_rounds} rounds")
    roots = edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
