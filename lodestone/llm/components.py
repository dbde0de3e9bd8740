"""Connected components of a large edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


#: A key of more rows than this, and than one row in so many, is hot.
HOT, MANY = 1000, 1000


def hot_from(total: int) -> float:
    """The rows of a key from which on it is hot among ``total`` rows."""
    return max(HOT, total / MANY)


def spread_join(rows: DataFrame, keyed: DataFrame, key: str, limit: float | None) -> DataFrame:
    """``rows`` with the columns of ``keyed``, which has a row for each key and in ``n`` how many rows have it.

    Rows of keys with more than ``limit`` stay where they are: by :func:`hot_from` MANY keys at most can be hot, and those are
    broadcast. A ``limit`` of None says that there is none.
    """
    if limit is None:
        return rows.join(keyed.drop("n"), key)
    hot, rest = F.broadcast(keyed.filter(F.col("n") > limit).drop("n")), keyed.filter(F.col("n") <= limit).drop("n")
    return rows.join(hot, key).unionByName(rows.join(hot, key, "left_anti").join(rest, key))


def _star(edges: DataFrame, limit: float | None) -> DataFrame:
    """Edges (u, v) with each u's least neighbour or itself as m. The minimum is summed up before its shuffle."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    return spread_join(edges, least.select("u", F.least("u", "m").alias("m"), "n"), "u", limit)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): each node of an edge and the least node that it is connected to.

    Rounds alternate a large star (greater neighbours move to the least) with a small star (lesser ones and the node do),
    until the edges stay as they are. Every round ends in a written table, so lineage stays short and nothing is computed
    twice. Nodes are of any type that has an order. Self loops and null ends make no edges; their nodes are in no component.
    """
    now = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct(), "edges")
    mark, n = None, now.count()
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # No node has more edges of one side in either star than it has here.
        most = both.groupBy("u").count().agg(F.max("count")).first()[0] or 0
        limit = hot_from(n) if most > hot_from(n) else None
        large = _star(both, limit).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        small = _star(large, limit)
        moved = small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        now = written(moved.filter("u > v").distinct(), "edges")
        seen = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if seen == mark:
            break
        mark, n = seen, seen[0]
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
