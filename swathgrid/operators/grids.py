"""Equal-area grids generated as rows: squares and hexagons whose corners survive a projection round trip."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import projection as P

HALF_WIDTH = P.A * math.pi
HALF_HEIGHT = 10001965.729


def _round_trip(ring: Column, tolerance: float) -> Column:
    def ok(p: Column) -> Column:
        ll = P.sinusoidal_inverse(p["x"], p["y"])
        back = P.sinusoidal(ll["x"], ll["y"])
        return (F.abs(ll["x"]) <= 180) & (F.abs(ll["y"]) <= 90) & (F.hypot(back["x"] - p["x"], back["y"] - p["y"]) < tolerance)

    return F.coalesce(F.forall(ring, ok), F.lit(False))


def _numbered(cells: DataFrame, name: str) -> DataFrame:
    """Ids in row order, x fastest: a count per row of cells, then a running sum over the rows (few, by construction)."""
    per_row = cells.groupBy("row").agg(F.count("*").alias("n"))
    base = per_row.select("row", (F.sum("n").over(W.orderBy("row").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")).alias("base"))
    at = F.row_number().over(W.partitionBy("row").orderBy("col")) - 1
    return cells.join(F.broadcast(base), "row").select((F.col("base") + at).cast("long").alias(name), "row", "col", "ring")


def square_grid(spark: SparkSession, size_m: float, name: str = "cell_id") -> DataFrame:
    """``name, row, col, ring`` of squares of size_m in sinusoidal metres, wholly on the globe."""
    nx, ny = math.ceil(HALF_WIDTH / size_m), math.ceil(HALF_HEIGHT / size_m)
    rows = spark.range(-ny, ny).withColumnRenamed("id", "row").select("row", F.explode(F.sequence(F.lit(-nx), F.lit(nx - 1))).alias("col"))
    x, y = F.col("col") * size_m, F.col("row") * size_m
    ring = F.array(*[F.struct((x + dx * size_m).alias("x"), (y + dy * size_m).alias("y")) for dx, dy in ((0, 0), (1, 0), (1, 1), (0, 1))])
    return _numbered(rows.select("row", "col", ring.alias("ring")).where(_round_trip(F.col("ring"), math.ceil(size_m * math.sqrt(2)))), name)


def hex_side(area: float) -> float:
    return math.sqrt(2 * area / (3 * math.sqrt(3)))


def hex_grid(spark: SparkSession, size_m: float, shift_x: float = 0.0, shift_y: float = 0.0, name: str = "hex_id") -> DataFrame:
    """``name, row, col, ring`` of pointed-top hexagons with the area of a size_m square; odd rows stand half a width over."""
    a = hex_side(size_m**2)
    width, up = math.sqrt(3) * a, 1.5 * a
    nx, ny = math.ceil(HALF_WIDTH / width) + 1, math.ceil(HALF_HEIGHT / up) + 1
    rows = spark.range(-ny, ny + 1).withColumnRenamed("id", "row").select("row", F.explode(F.sequence(F.lit(-nx), F.lit(nx))).alias("col"))
    cx = F.col("col") * width + F.pmod(F.col("row"), F.lit(2)) * (width / 2) + shift_x
    cy = F.col("row") * up + shift_y
    corner = [(a * math.cos(math.radians(90 + 60 * k)), a * math.sin(math.radians(90 + 60 * k))) for k in range(6)]
    ring = F.array(*[F.struct((cx + dx).alias("x"), (cy + dy).alias("y")) for dx, dy in corner])
    return _numbered(rows.select("row", "col", ring.alias("ring")).where(_round_trip(F.col("ring"), math.ceil(size_m * math.sqrt(2)))), name)


def buffer_widths(land_km: float, water_km: float) -> tuple[float, float, float]:
    """(inner, outer, coastal) distances in metres: a ring of 1 km round the shore line and what is left of the water."""
    middle = (water_km - land_km) * 500.0
    if middle < 500:
        raise ValueError("the inner distance must not shrink the land")
    return middle - 500, middle + 500, water_km * 1000.0 - (middle + 500)


def island_class(area_km2: Column, land_km: float) -> Column:
    small = math.pi * land_km**2
    return F.when(area_km2 > small**2, "large").when(area_km2 > small, "mid").otherwise("small")


def coastal_flags(cells: DataFrame, leak_km: float = 4.0, cap_km: float = 50.0) -> DataFrame:
    """cells with ``dist_km, is_land, is_coast`` from ``line_km`` and ``island_km`` (distances to coast line and small
    islands, either null), ``on_land``, ``coastal`` (meets the coast strip) and ``at_zero`` (counts as the shore itself).

    A strip cell further than leak_km from any shore is land; land and shore cells have distance 0, others cap_km at most.
    """
    near = F.least("line_km", "island_km")
    land = F.col("on_land") | (F.col("coastal") & (near > leak_km))
    land = F.coalesce(land, F.col("on_land"))
    dist = F.when(land | F.col("at_zero"), 0.0).otherwise(F.least(near, F.lit(cap_km)))
    return cells.select("*", F.when(near.isNull() & ~land & ~F.col("at_zero"), F.lit(None)).otherwise(dist).alias("dist_km"), land.alias("is_land"), (F.col("coastal") & ~land).alias("is_coast"))


def ocean_mask(cells: DataFrame, land_hits: DataFrame, coast_hits: DataFrame, key: str) -> DataFrame:
    """Cells that meet no land or meet the coast: two existence joins."""
    land, coast = land_hits.select(key).distinct(), coast_hits.select(key).distinct()
    return cells.join(land, key, "left_anti").unionByName(cells.join(land, key, "left_semi").join(coast, key, "left_semi"))
