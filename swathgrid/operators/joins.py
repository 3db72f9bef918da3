"""Joins in time and space. Each is an equi-join on buckets or tiles with an exact residual, so none is a nested loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.timeparts import circular_seconds, epoch, seconds_of_day


def asof(left: DataFrame, right: DataFrame, on: list[str], left_at: str, right_at: str, tolerance: float | None = None, forward: bool = False) -> DataFrame:
    """Every left row with the nearest right row at or before it (forward: at or after it), null beyond the tolerance (s).

    right's other columns must not be named like left's. One sort over the union of both sides, no join. Of right rows at the
    same time the last by all columns counts.
    """
    carried = [c for c in right.columns if c not in on]
    lefts = left.select(*on, F.struct(*left.columns).alias("l"), F.lit(None).cast(right.select(F.struct(*carried).alias("r")).schema["r"].dataType).alias("r"), epoch(left_at).alias("t"))
    rights = right.select(*on, F.lit(None).cast(left.select(F.struct(*left.columns).alias("l")).schema["l"].dataType).alias("l"), F.struct(*carried).alias("r"), epoch(right_at).alias("t"))
    side = F.when(F.col("l").isNull(), 0).otherwise(1)
    order = [F.col("t").desc() if forward else F.col("t").asc(), side, F.col("r").asc_nulls_last()]
    near = F.last("r", ignorenulls=True).over(W.partitionBy(*on).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    rows = lefts.unionByName(rights).withColumn("m", near).where("l is not null")
    ok = F.col("m").isNotNull() if tolerance is None else F.abs(F.col("t") - epoch(F.col(f"m.{right_at}"))) <= tolerance
    return rows.select("l.*", *[F.when(ok, F.col(f"m.{c}")).alias(c) for c in carried])


def asof_both(left: DataFrame, right: DataFrame, on: list[str], left_at: str, right_at: str, tolerance: float, left_id: str, right_id: str) -> DataFrame:
    """Both directions merged, each pair of ids once; unmatched left rows stay with nulls."""
    both = asof(left, right, on, left_at, right_at, tolerance).unionByName(asof(left, right, on, left_at, right_at, tolerance, forward=True))
    return both.dropDuplicates([*on, left_id, right_id])


def band(left: DataFrame, right: DataFrame, on: list[str], left_at: str, right_at: str, seconds: float) -> DataFrame:
    """All pairs of equal ``on`` whose times differ by at most seconds (inclusive).

    Buckets as wide as the window: left rows meet the bucket of their time and its neighbours, right rows one bucket.
    """
    width = max(seconds, 1e-6)
    b = F.floor(epoch(left_at) / width)
    lefts = left.withColumn("__b", F.explode(F.array(b - 1, b, b + 1)))
    rights = right.withColumn("__b", F.floor(epoch(right_at) / width)).withColumnsRenamed({c: f"__{c}" for c in on})
    same = [F.col(c) == F.col(f"__{c}") for c in on]
    rights = rights.withColumnRenamed("__b", "__rb")
    joined = lefts.join(rights, [*same, F.col("__b") == F.col("__rb")])
    return joined.where(F.abs(epoch(left_at) - epoch(right_at)) <= seconds).drop("__b", "__rb", *[f"__{c}" for c in on])


def near_time_of_day(a: str, b: str, hours: float) -> Column:
    return circular_seconds(seconds_of_day(a), seconds_of_day(b)) < hours * 3600


def existence(left: DataFrame, right: DataFrame, on: list[str], name: str) -> DataFrame:
    """left with a boolean: is the key among right's?"""
    keys = right.select(*on).distinct().withColumn("__there", F.lit(True))
    return left.join(keys, on, "left").withColumn(name, F.coalesce("__there", F.lit(False))).drop("__there")


def dim_left(dim: DataFrame, facts: DataFrame, key: str, fill: dict[str, float] | None = None) -> DataFrame:
    """Every dimension row with its aggregate; missing numbers filled."""
    out = dim.join(facts, key, "left")
    return out.fillna(fill) if fill else out


#: Tiles that one ring may meet: more means that ``size`` is in another unit than the rings.
MOST_TILES = 10_000
BOX = "struct<x0:double,y0:double,x1:double,y1:double>"


def tiles(box: str | Column, size: float) -> Column:
    """Keys of the tiles that bounds meet; an error where they are more than ``MOST_TILES``."""
    box = F.col(box) if isinstance(box, str) else box
    tile = lambda c: F.floor(box[c] / size).cast("long")
    n = (tile("x1") - tile("x0") + 1) * (tile("y1") - tile("y0") + 1)
    cells = lambda low, high: F.sequence(tile(low), tile(high))
    keys = F.flatten(F.transform(cells("x0", "x1"), lambda x: F.transform(cells("y0", "y1"), lambda y: F.struct(x.alias("x"), y.alias("y")))))
    return F.when(n > MOST_TILES, F.raise_error(F.lit(f"a ring meets over {MOST_TILES} tiles of size {size}: choose a size near that of the cells"))).otherwise(keys)


def _tile_pairs(left: DataFrame, right: DataFrame, left_key: str, right_key: str, left_ring: str, right_ring: str, size: float, left_with: dict[str, Column] | None = None, right_with: dict[str, Column] | None = None) -> DataFrame:
    """Candidate pairs, each once, with ``ra, rb, ba, bb`` (rings and bounds) and the columns asked for: only the tile that
    holds the lower corner of the boxes' overlap reports a pair.

    A ring that is an axis-aligned box travels as its bounds alone (its ring is null).
    """

    def side(df: DataFrame, key: str, ring: str, r: str, b: str, more: dict[str, Column] | None) -> DataFrame:
        names = list(more or {})
        # bounds and the test are bound once, in one expression, however often filters repeat it
        both = F.transform(F.array(G.bounds(ring)), lambda x: F.struct(*[x[c].alias(c) for c in ("x0", "y0", "x1", "y1")], G.is_box(ring, x).alias("is")))
        own = df.select(key, *[c.alias(n) for n, c in (more or {}).items()], F.col(ring).alias(r), F.get(both, F.lit(0)).alias(b))
        own = own.select(key, *names, F.when(~F.col(f"{b}.is"), F.col(r)).alias(r), b)
        return own.withColumn("tile", F.explode(tiles(b, size)))

    joined = side(left, left_key, left_ring, "ra", "ba", left_with).join(side(right, right_key, right_ring, "rb", "bb", right_with), "tile")
    x, y = F.greatest("ba.x0", "bb.x0"), F.greatest("ba.y0", "bb.y0")
    meets = (x <= F.least("ba.x1", "bb.x1")) & (y <= F.least("ba.y1", "bb.y1"))
    own = (F.floor(x / size) == F.col("tile.x")) & (F.floor(y / size) == F.col("tile.y"))
    return joined.where(meets & own).drop("tile")


def _ring_of(r: str, b: str) -> Column:
    return F.coalesce(F.col(r), G.box(F.col(f"{b}.x0"), F.col(f"{b}.y0"), F.col(f"{b}.x1"), F.col(f"{b}.y1")))


def overlay(left: DataFrame, right: DataFrame, left_key: str, right_key: str, left_ring: str = "ring", right_ring: str = "ring", size: float = 1.0, left_with: dict[str, Column] | None = None, right_with: dict[str, Column] | None = None) -> DataFrame:
    """``left_key, right_key, overlap`` (the intersection's ring) ``, overlap_box`` (its bounds where both are boxes, else
    null) ``, overlap_area`` of pairs that share area, and the columns ``left_with`` and ``right_with`` of either side,
    computed before rows are dealt to tiles.

    The right rings must be convex, as grid cells are. Two boxes are cut by expressions; other pairs in Arrow batches.
    """
    pairs = _tile_pairs(left, right, left_key, right_key, left_ring, right_ring, size, left_with, right_with)
    boxes = F.col("ba.is") & F.col("bb.is")
    names = [left_key, right_key, *(left_with or {}), *(right_with or {})]
    x0, y0, x1, y1 = F.greatest("ba.x0", "bb.x0"), F.greatest("ba.y0", "bb.y0"), F.least("ba.x1", "bb.x1"), F.least("ba.y1", "bb.y1")
    box = F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))
    plain = pairs.where(boxes).select(*names, G.box(x0, y0, x1, y1).alias("overlap"), box.alias("overlap_box"), ((x1 - x0) * (y1 - y0)).alias("overlap_area"))
    # no row of two boxes reaches the Python worker
    cut = pairs.where(~boxes).select(*names, G.clip(_ring_of("ra", "ba"), _ring_of("rb", "bb")).alias("overlap"), F.lit(None).cast(BOX).alias("overlap_box"))
    return plain.unionByName(cut.withColumn("overlap_area", G.area("overlap"))).where("overlap_area > 0")


def intersects(left: DataFrame, right: DataFrame, left_key: str, right_key: str, left_ring: str = "ring", right_ring: str = "ring", size: float = 1.0, keep_left: bool = False) -> DataFrame:
    """Key pairs of rings that touch or overlap (right ones convex); keep_left adds unmatched left keys with null."""
    found = _tile_pairs(left, right, left_key, right_key, left_ring, right_ring, size)  # of two boxes the bounds meet
    boxes = F.col("ba.is") & F.col("bb.is")
    pairs = found.where(boxes | G.touches(F.when(~boxes, _ring_of("ra", "ba")), F.when(~boxes, _ring_of("rb", "bb")))).select(left_key, right_key)
    return left.select(left_key).join(pairs, left_key, "left") if keep_left else pairs


def points_in(points: DataFrame, areas: DataFrame, point_key: str, area_key: str, x: str = "x", y: str = "y", ring: str = "ring", size: float = 1.0) -> DataFrame:
    """Key pairs of points within areas (boundary included), through the tile of the point."""
    a = points.select(point_key, F.col(x).alias("__x"), F.col(y).alias("__y"), F.struct(F.floor(F.col(x) / size).alias("x"), F.floor(F.col(y) / size).alias("y")).alias("tile"))
    b = areas.select(area_key, F.col(ring).alias("__ring"), G.bounds(ring).alias("__b")).select(area_key, "__ring", F.explode(tiles("__b", size)).alias("tile"))
    return a.join(b, "tile").where(G.contains(F.col("__ring"), F.col("__x"), F.col("__y"))).select(point_key, area_key)


def nearest(left: DataFrame, right: DataFrame, left_key: str, right_key: str, limit: float, ties: bool = False) -> DataFrame:
    """``left_key, right_key, dist``: the nearest right point (columns x, y) within limit; ties: the lowest id, or all.

    Tiles as wide as the limit: a left point meets its own and the eight neighbouring tiles.
    """
    fx, fy = F.floor(F.col("x") / limit), F.floor(F.col("y") / limit)
    around = F.array(*[F.struct((fx + i).alias("x"), (fy + j).alias("y")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    a = left.select(left_key, F.col("x").alias("ax"), F.col("y").alias("ay"), F.explode(around).alias("tile"))
    b = right.select(right_key, F.col("x").alias("bx"), F.col("y").alias("by"), F.struct(fx.alias("x"), fy.alias("y")).alias("tile"))
    near = a.join(b, "tile").select(left_key, right_key, F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")).alias("dist")).where(F.col("dist") <= limit)
    best = near.groupBy(left_key).agg(F.min(F.struct("dist", right_key)).alias("b"))
    if not ties:
        return best.select(left_key, f"b.{right_key}", "b.dist")
    return near.join(best.select(left_key, F.col("b.dist").alias("__d")), left_key).where(F.col("dist") == F.col("__d")).drop("__d")


def _cut(df: DataFrame) -> DataFrame:
    """df evaluated once: in the session's checkpoint folder, which executors share, or held where it names none."""
    named = df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined()
    return df.checkpoint() if named else df.persist()


def nearest_area(left: DataFrame, right: DataFrame, left_key: str, right_key: str, start: float, limit: float | None = None, ties: bool = False) -> DataFrame:
    """``left_key, right_key, dist``: the right polygon nearest to each left one by their boundaries (0 where they meet), to
    nine digits; right ones are convex.

    Without a limit every left row finds one, unless right is empty. Tiles are searched in rounds, each over the rows still
    without a neighbour and four times as wide as the last, from ``start``; ties: the lowest id, or all.
    """
    out, rest, reach = None, left.select(left_key, F.col("ring").alias("ra")), float(start)
    b = right.select(right_key, F.col("ring").alias("rb"))
    box = G.bounds("ring")
    both = right.select(box.alias("b")).union(left.select(box.alias("b")))
    span = both.agg((F.max("b.x1") - F.min("b.x0") + F.max("b.y1") - F.min("b.y0")).alias("s"), F.count("*")).first()
    furthest = min(limit, span.s or 0.0) if limit is not None else (span.s or 0.0)
    while True:
        reach = min(reach, furthest) if furthest > 0 else reach
        e = G.bounds("ra")
        wide = G.box(e["x0"] - reach, e["y0"] - reach, e["x1"] + reach, e["y1"] + reach)
        size = max(reach, float(start))
        near = _tile_pairs(rest.withColumn("wide", wide), b, left_key, right_key, "wide", "rb", size, {"own": F.col("ra")}, {"other": F.col("rb")})
        found = near.select(left_key, right_key, F.round(G.distance("own", "other"), 9).alias("dist")).where(F.col("dist") <= reach)
        best = found.groupBy(left_key).agg(F.min("dist").alias("__d"))
        hits = found.join(best, left_key).where(F.col("dist") == F.col("__d")).drop("__d")
        hits = _cut(hits if ties else hits.groupBy(left_key).agg(F.min(right_key).alias(right_key), F.min("dist").alias("dist")))
        out = hits if out is None else out.unionByName(hits)
        if reach >= furthest:
            return out
        rest = _cut(rest.join(hits.select(left_key).distinct(), left_key, "left_anti"))
        if rest.isEmpty():
            return out
        reach *= 4


def first_only(pairs: DataFrame, key: str, group: str) -> DataFrame:
    """Each key once, with the first group in ascending order that it belongs to: later groups do not see it again."""
    return pairs.groupBy(key).agg(F.min(group).alias(group))


def within_any(points: DataFrame, layers: list[DataFrame], point_key: str, area_key: str, size: float = 1.0) -> DataFrame:
    """Distinct keys of points within an area of any layer."""
    found = [points_in(points, layer, point_key, area_key, size=size).select(point_key) for layer in layers]
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out.distinct()


def distance_to_lines(points: DataFrame, lines: DataFrame, point_key: str, step: float, limit: float) -> DataFrame:
    """``point_key, dist`` to the nearest of the lines' corners, densified to step; points beyond limit are absent."""
    corners = lines.select(F.explode(G.segmentize("ring", step)).alias("p")).select("p.x", "p.y").withColumn("__c", F.xxhash64("x", "y"))
    return nearest(points, corners, point_key, "__c", limit).select(point_key, "dist")


def outside(points: DataFrame, region: list[tuple[float, float]]) -> DataFrame:
    """Points (x, y) that are not within a constant region."""
    return points.where(~G.contains(G.constant(region), F.col("x"), F.col("y")))


def assign(left: DataFrame, right: DataFrame, left_key: str, right_key: str, limit: float | None = None, size: float = 1.0, closest: bool = True) -> DataFrame:
    """Each left polygon's right id: the largest overlap (ties: lowest id), else the nearest by boundary distance (within
    ``limit`` if given; ties: lowest id), else -1. Without ``closest`` only overlaps count."""
    shared = overlay(left, right, left_key, right_key, size=size).withColumn("__o", F.round("overlap_area", 9))
    shared = shared.groupBy(left_key).agg(F.max_by(right_key, F.struct("__o", -F.col(right_key))).alias("__a"))
    out = left.select(left_key).join(shared, left_key, "left")
    if not closest:
        return out.select(left_key, F.coalesce("__a", F.lit(-1)).alias(right_key))
    rest = left.join(shared, left_key, "left_anti")
    near = nearest_area(rest, right, left_key, right_key, size, limit).select(left_key, F.col(right_key).alias("__n"))
    return out.join(near, left_key, "left").select(left_key, F.coalesce("__a", "__n", F.lit(-1)).alias(right_key))
