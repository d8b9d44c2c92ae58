"""Connected components of an edge table, by DataFrame operations only.

Alternates two steps until the table stands still: every vertex points its larger neighbours at its
smallest one, then its smaller neighbours. Rows never increase, a hub's minimum is a partial
aggregate, and the join that hands it back to the hub's rows is an ordinary equi-join, which Spark
splits where a hub is hot. Each step is written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from slotwise.llm.common import kept


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _point(pairs: DataFrame, keep) -> DataFrame:
    """pairs (v, u) -> edges from each kept u to the smallest of v and its neighbours."""
    least = pairs.groupBy(F.col("v").alias("w")).agg(F.min("u").alias("m"))
    least = least.select("w", F.least("w", "m").alias("m"))
    joined = pairs.join(least, pairs.v == least.w)
    return joined.where(keep).select(F.greatest("u", "m").alias("a"), F.least("u", "m").alias("b")).where("a <> b")


def components(edges: DataFrame, purpose: str) -> DataFrame:
    """``edges`` has columns a and b of one sortable type, nulls not allowed; returns (vertex, component) for all
    vertices that have an edge, where component is the smallest vertex reachable."""
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    edges = kept(edges, f"{purpose}-edges")
    before = _state(edges)
    while before[0]:
        both = edges.select(F.col("a").alias("v"), F.col("b").alias("u")).union(edges.select(F.col("b").alias("v"), F.col("a").alias("u")))
        large = kept(_point(both, F.col("u") > F.col("v")).distinct(), f"{purpose}-large")
        down = large.select(F.col("a").alias("v"), F.col("b").alias("u"))
        own = down.groupBy("v").agg(F.min("u").alias("u")).select(F.col("v").alias("a"), F.col("u").alias("b"))
        small = kept(_point(down, F.lit(True)).union(own).distinct(), f"{purpose}-small")
        after = _state(small)
        edges = small
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("vertex"), F.col("b").alias("component")).union(
        edges.select(F.col("b").alias("vertex"), F.col("b").alias("component")).distinct()
    )
