"""Points, polygons and map layers. Coordinates are plain doubles, rings are arrays of structs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from slotwise.constants import DISTRICT_PALETTE

# --- fixed values: ellipsoid and grid of the source coordinates (GRS80, UTM zone 31 north)
SEMI_MAJOR = 6378137.0
FLATTENING = 1 / 298.257222101
SCALE, FALSE_EASTING, CENTRAL_MERIDIAN = 0.9996, 500000.0, 3.0

# --- fixed values: hull enlargement and map markers
HULL_SCALE = 1.12
CIRCLE_RADIUS = 300.0


def point(lon: Column, lat: Column) -> Column:
    return F.struct(lon.cast("double").alias("lon"), lat.cast("double").alias("lat"))


# ---------------------------------------------------------------- projection
# Inverse transverse Mercator series in the third flattening.
_N = FLATTENING / (2 - FLATTENING)
RADIUS = SEMI_MAJOR / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)


def utm_to_geographic(easting: Column, northing: Column, meridian: float = CENTRAL_MERIDIAN) -> Column:
    """UTM north metres -> struct(lon, lat) in degrees."""
    xi, eta = northing / (SCALE * RADIUS), (easting - FALSE_EASTING) / (SCALE * RADIUS)
    xi_c, eta_c = xi, eta
    for j, b in enumerate(BETA, start=1):
        xi_c = xi_c - F.lit(b) * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        eta_c = eta_c - F.lit(b) * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    conformal = F.asin(F.sin(xi_c) / F.cosh(eta_c))
    lat = conformal
    for j, d in enumerate(DELTA, start=1):
        lat = lat + F.lit(d) * F.sin(2 * j * conformal)
    lon = F.lit(meridian) + F.degrees(F.atan2(F.sinh(eta_c), F.cos(xi_c)))
    return point(lon, F.degrees(lat))


def reproject_rings(rings: Column, meridian: float = CENTRAL_MERIDIAN) -> Column:
    """Rings of ``(x, y)`` metres -> rings of ``(lon, lat)`` degrees."""
    return F.transform(rings, lambda ring: F.transform(
        ring, lambda p: utm_to_geographic(p["x"], p["y"], meridian)
    ))


# ---------------------------------------------------------------- containment
def ring_edges(rings: Column) -> Column:
    """All edges of all rings as structs (x1, y1, x2, y2); rings may be open or closed."""
    return F.flatten(F.transform(rings, lambda ring: F.zip_with(
        ring,
        F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1)),
        lambda a, b: F.struct(a["lon"].alias("x1"), a["lat"].alias("y1"), b["lon"].alias("x2"), b["lat"].alias("y2")),
    )))


def within(lon: Column, lat: Column, edges: Column) -> Column:
    """Point strictly inside the polygon given by its edges; holes count by the even-odd rule.

    Points on the boundary are outside.
    """
    cross = lambda e: (e["x2"] - e["x1"]) * (lat - e["y1"]) - (e["y2"] - e["y1"]) * (lon - e["x1"])
    on_edge = lambda e: (
        (cross(e) == 0)
        & lon.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"]))
        & lat.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]))
    )
    crosses = lambda e: ((e["y1"] > lat) != (e["y2"] > lat)) & (
        lon < (e["x2"] - e["x1"]) * (lat - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"]
    )
    inside = F.size(F.filter(edges, crosses)) % 2 == 1
    return inside & ~F.exists(edges, on_edge)


def _cell(value: Column, size: float) -> Column:
    return F.floor(value / size)


def within_left_join(points: DataFrame, polygons: DataFrame, cell: float = 0.01) -> DataFrame:
    """Each point with the attributes of the polygons that contain it; unmatched points stay, with NULLs.

    Points need ``lon, lat``; polygons ``rings`` plus attributes. Polygons are cut
    into the grid cells of their bounding box, so candidates meet by an equi-join
    on the cell and only they are tested. Choose ``cell`` near the polygon size.
    """
    edged = polygons.withColumn("_edges", ring_edges(F.col("rings"))).drop("rings")
    bound = lambda pick, axis: pick(F.transform("_edges", lambda e: e[axis]))
    span = lambda axis: F.sequence(_cell(bound(F.array_min, axis), cell), _cell(bound(F.array_max, axis), cell))
    cells = edged.withColumn("_cx", F.explode(span("x1"))).withColumn("_cy", F.explode(span("y1")))
    left, right = points.alias("p"), cells.alias("q")
    lon, lat = F.col("p.lon"), F.col("p.lat")
    match = (
        (_cell(lon, cell) == F.col("q._cx")) & (_cell(lat, cell) == F.col("q._cy"))
        & within(lon, lat, F.col("q._edges"))
    )
    return left.join(right, match, "left").drop("_edges", "_cx", "_cy")


# ---------------------------------------------------------------- hulls and centres
def hull_points(df: DataFrame, group: str, spread: int = 32) -> DataFrame:
    """Hull vertices (group, position, lon, lat), counter-clockwise from the leftmost.

    Every Arrow batch is reduced to the hulls of its groups where it is read; only those
    vertices are shuffled, first to hash parts of a group and then to the group, so
    no task ever holds a large group.
    """
    schema = f"{group} {df.schema[group].dataType.simpleString()}, part int, position int, lon double, lat double"

    # Defined here so that it travels to the workers by value.
    def hull(pdf: pd.DataFrame) -> pd.DataFrame:
        def chain(points):
            out = []
            for p in points:
                while len(out) >= 2:
                    u, v = out[-1] - out[-2], p - out[-2]
                    if u[0] * v[1] - u[1] * v[0] > 0:
                        break
                    out.pop()
                out.append(p)
            return out[:-1]

        pts = np.unique(pdf[["lon", "lat"]].to_numpy(), axis=0)
        vertices = pts if len(pts) < 3 else np.array(chain(pts) + chain(pts[::-1]))
        return pd.DataFrame({
            group: pdf[group].iloc[0], "part": pdf["part"].iloc[0], "position": np.arange(len(vertices)),
            "lon": vertices[:, 0], "lat": vertices[:, 1],
        })

    def shrink(batches):
        for pdf in batches:
            for _, rows in pdf.groupby(group):
                yield hull(rows.assign(part=0))[[group, "lon", "lat"]]

    points = df.select(group, F.col("lon").cast("double"), F.col("lat").cast("double")).na.drop()
    outer = points.mapInPandas(shrink, points.schema)
    parts = outer.withColumn("part", F.pmod(F.xxhash64("lon", "lat"), F.lit(spread)).cast("int"))
    partial = parts.groupBy(group, "part").applyInPandas(hull, schema)
    merged = partial.withColumn("part", F.lit(0)).groupBy(group, "part").applyInPandas(hull, schema)
    return merged.drop("part")


def hulls(df: DataFrame, group: str, scale: float = HULL_SCALE) -> DataFrame:
    """Map zone per group: closed hull ring scaled about the mean of its vertices.

    Groups with fewer than three points become a circle around their centre.
    """
    sizes = df.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), F.avg("lon").alias("c_lon"), F.avg("lat").alias("c_lat")
    )
    rings = hull_points(df, group).groupBy(group).agg(
        F.avg("lon").alias("h_lon"), F.avg("lat").alias("h_lat"),
        F.sort_array(F.collect_list(F.struct("position", "lon", "lat"))).alias("v"),
    )
    moved = F.transform("v", lambda p: F.struct(
        (F.col("h_lon") + (p["lon"] - F.col("h_lon")) * scale).alias("lon"),
        (F.col("h_lat") + (p["lat"] - F.col("h_lat")) * scale).alias("lat"),
    ))
    closed = F.concat(moved, F.slice(moved, 1, 1))
    polygon = F.col("n") >= 3
    return sizes.join(rings, group).select(
        group, "n",
        F.when(polygon, "polygon").otherwise("circle").alias("shape"),
        F.when(polygon, closed).alias("ring"),
        "c_lon", "c_lat",
        F.when(~polygon, F.lit(CIRCLE_RADIUS)).alias("radius"),
    )


def centroids(df: DataFrame, group: str) -> DataFrame:
    """Mean position per group."""
    return df.groupBy(group).agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))


def palette_colour(position: Column) -> Column:
    """Colour of the n-th group (from 0), repeating after the palette ends."""
    colours = F.array(*[F.lit(c) for c in DISTRICT_PALETTE])
    return F.get(colours, F.pmod(position, F.lit(len(DISTRICT_PALETTE))).cast("int"))
