"""Greedy routes over distance matrices given as edges ``matrix, src, dst, km``."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def exclude_places(edges: DataFrame, names: list[str]) -> DataFrame:
    """Remove places from rows and columns of the matrices."""
    return edges.where(~F.col("src").isin(names) & ~F.col("dst").isin(names))


def nearest_neighbour_routes(edges: DataFrame) -> DataFrame:
    """From every origin, always on to the nearest place not visited yet (name breaks ties).

    A distance matrix is the square of its places by nature, so one matrix is
    the unit of work; matrices and origins are spread over the cluster. Each
    place carries its neighbours in order of distance, and a step takes the first
    one not on the route.
    """
    neighbours = edges.where(F.col("src") != F.col("dst")).groupBy("matrix", "src").agg(
        F.sort_array(F.collect_list(F.struct("km", "dst"))).alias("near")
    )
    maps = neighbours.groupBy("matrix").agg(
        F.map_from_entries(F.collect_list(F.struct("src", "near"))).alias("near")
    )
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    starts = maps.withColumn("origin", F.explode(F.map_keys("near"))).repartition(parts, "matrix", "origin")

    def step(state, _):
        here = F.element_at(state["route"], -1)
        options = F.filter(
            F.coalesce(F.try_element_at(F.col("near"), here), F.expr("array()").cast("array<struct<km:double,dst:string>>")),
            lambda e: ~F.array_contains(state["route"], e["dst"]),
        )
        nearest = F.get(options, F.lit(0))
        return F.when(nearest.isNull(), state).otherwise(F.struct(
            F.concat(state["route"], F.array(nearest["dst"])).alias("route"),
            (state["km"] + nearest["km"]).alias("km"),
        ))

    begin = F.struct(F.array("origin").alias("route"), F.lit(0.0).alias("km"))
    walk = F.aggregate(F.sequence(F.lit(1), F.size("near")), begin, step)
    return starts.withColumn("walk", walk).select("matrix", "origin", "walk.route", "walk.km")


def best_origin(routes: DataFrame) -> DataFrame:
    """Per matrix the origin with the shortest greedy route."""
    return routes.groupBy("matrix").agg(
        F.min_by(F.struct("origin", "route", "km"), F.struct("km", "origin")).alias("b")
    ).select("matrix", "b.*")
