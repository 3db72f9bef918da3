"""The named analyses: functions from typed tables to results, built of the operators and predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import bins, geometry, tides
from ..functions.predicates import Closed, all_of, base, in_season, in_year, near_shore, null_audit, valid, within
from ..functions.timeparts import day, fiscal_year, month_start, seconds_of_day, solar_time
from ..operators import gaps, joins, rollup


# -- counts and coverage ------------------------------------------------------------------------------------------------
def counts(samples: DataFrame, *conditions: Column | None, name: str = "sample_count") -> DataFrame:
    return samples.where(all_of(*conditions)).groupBy("grid_id").agg(F.count("*").alias(name))


def hex_counts(samples: DataFrame, dims: DataFrame, start: str, end: str, valid_only: bool, closed: Closed = Closed.NEITHER) -> DataFrame:
    """Counts per cell, 0 where there is none, rolled up to hexes; a hex without any sample has a null total."""
    own = counts(samples, base(), within("acquired", start, end, closed), valid() if valid_only else None)
    full = joins.dim_left(dims.select("grid_id", "hex_id"), own, "grid_id", {"sample_count": 0})
    out = rollup.to_hex(full, {"median_count": ("sample_count", "median"), "max_count": ("sample_count", "max"), "total": ("sample_count", "sum")})
    return out.withColumn("total", F.nullif("total", F.lit(0)))


def yearly_counts(samples: DataFrame, dims: DataFrame, first: int, last: int) -> DataFrame:
    """Hex medians per year for all and valid samples in one pass over the table instead of two queries a year.

    A year's window includes its end, so a sample at midnight of New Year counts in both years.
    """
    rows = samples.where(all_of(base(), within("acquired", f"{first}-01-01", f"{last + 1}-01-01"))).select("grid_id", F.coalesce(valid(), F.lit(False)).alias("ok"), F.explode(_years_of("acquired")).alias("year"))
    tagged = rows.where(F.col("year").between(first, last)).select("grid_id", "year", F.explode(F.when(F.col("ok"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))).alias("valid"))
    n = tagged.groupBy("grid_id", "year", "valid").agg(F.count("*").alias("n"))
    flags = F.explode(F.array(F.lit(False), F.lit(True))).alias("valid")
    spine = dims.select("grid_id", "hex_id").crossJoin(F.broadcast(rollup.years(samples.sparkSession, first, last).select("year", flags)))
    full = rollup.reindex(n, spine, ["grid_id", "year", "valid"], {"n": 0})
    return rollup.to_hex(full, {"median_count": ("n", "median"), "total": ("n", "sum")}, by=("year", "valid"))


SEASONS = {"winter": (12, 1, 2), "spring": (3, 4, 5), "summer": (6, 7, 8), "autumn": (9, 10, 11)}


def seasonal_counts(samples: DataFrame, dims: DataFrame, start: str, end: str, valid_only: bool) -> DataFrame:
    season = F.coalesce(*[F.when(in_season("acquired", m), n) for n, m in SEASONS.items()])
    n = samples.where(all_of(base(), within("acquired", start, end), valid() if valid_only else None)).groupBy("grid_id", season.alias("season")).agg(F.count("*").alias("n"))
    spine = dims.select("grid_id", "hex_id", F.explode(F.array(*[F.lit(s) for s in SEASONS])).alias("season"))
    full = rollup.reindex(n, spine, ["grid_id", "season"], {"n": 0})
    return rollup.to_hex(full, {"median_count": ("n", "median"), "max_count": ("n", "max"), "total": ("n", "sum")}, by=("season",))


def reach(samples: DataFrame, dims: DataFrame, item_type: str, least: tuple[int, ...] = (1, 5, 100)) -> DataFrame:
    """One row: share of cells, in percent, with at least so many samples of an item type."""
    own = counts(samples, F.col("item_type") == item_type)
    full = joins.dim_left(dims.select("grid_id"), own, "grid_id", {"sample_count": 0})
    return rollup.share_where(full, **{f"pct_ge_{k}": F.col("sample_count") >= k for k in least})


# -- revisit gaps --------------------------------------------------------------------------------------------------------
def gap_percentiles(samples: DataFrame, year: int, pct: int, valid_only: bool, extra: Column | None = None, clear: float = 75.0) -> DataFrame:
    return gaps.day_gap_percentile(gaps.solar_day_gaps(samples, year, valid_only, extra, clear), pct)


def hex_gaps(samples: DataFrame, dims: DataFrame, year: int, pct: int, valid_only: bool, extra: Column | None = None, clear: float = 75.0) -> DataFrame:
    """Hex medians of cells' gap percentiles; cells with fewer than two samples have none."""
    p = gap_percentiles(samples, year, pct, valid_only, extra, clear).select("grid_id", F.when(F.col("sample_count") >= 2, F.col(f"p{pct}_days_between")).alias("p"))
    return rollup.to_hex(joins.dim_left(dims.select("grid_id", "hex_id"), p, "grid_id"), {"median_gap": ("p", "median")})


def _years_of(at: str) -> Column:
    """The years in whose closed windows a time falls: two for midnight of New Year."""
    year = F.year(at)
    at_end = F.col(at) == F.make_timestamp_ntz(year, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    return F.when(at_end, F.array(year - 1, year)).otherwise(F.array(year))


def gaps_by_year(samples: DataFrame, first: int, last: int, pct: int, valid_only: bool) -> DataFrame:
    """``grid_id, year, gap, sample_count`` of every year's closed window in one plan, not a query a year."""
    rows = samples.where(all_of(base(), within("solar_time", f"{first}-01-01", f"{last + 1}-01-01"), valid() if valid_only else None))
    days = rows.select("grid_id", day("solar_time").alias("ts"), F.explode(_years_of("solar_time")).alias("year")).where(F.col("year").between(first, last))
    g = gaps.day_gaps(days, ["grid_id", "year"], "ts", *[F.make_date(F.col("year") + k, F.lit(1), F.lit(1)) for k in (0, 1)])
    return g.groupBy("grid_id", "year", "sample_count").agg(F.percentile("gap", F.lit(pct / 100)).alias("gap"))


def multi_year_median(samples: DataFrame, first: int, last: int, pct: int, valid_only: bool) -> DataFrame:
    """Per cell the median over years of its gap percentile; years with fewer than two samples do not count."""
    p = gaps_by_year(samples, first, last, pct, valid_only).select("grid_id", F.when(F.col("sample_count") >= 2, F.col("gap")).alias("gap"))
    return p.groupBy("grid_id").agg(F.median("gap").alias("median_gap"))


def cumulative(histogram: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """A histogram's running share in percent per group, over its few bins."""
    w = W.partitionBy(*by)
    return histogram.withColumn("cum_pct", 100.0 * F.sum("n").over(w.orderBy("upper")) / F.sum("n").over(w))


def gaps_by_clear(samples: DataFrame, dims: DataFrame, year: int, pct: int, thresholds: tuple[float, ...] = (0, 25, 50, 75, 100)) -> DataFrame:
    """``clear, grid_id, gap`` for each threshold (inclusive) in one plan: samples are exploded to the thresholds they
    reach; cells without a value have 365 days."""
    ok = samples.where(all_of(base(), in_year("solar_time", year), valid(None)))
    reached = F.filter(F.array(*[F.lit(float(t)) for t in thresholds]), lambda t: F.col("clear_percent") >= t)
    days = ok.select("grid_id", day("solar_time").alias("ts"), F.explode(reached).alias("clear"))
    g = gaps.day_gaps(days, ["grid_id", "clear"], "ts", F.lit(f"{year}-01-01").cast("date"), F.lit(f"{year + 1}-01-01").cast("date"))
    p = g.groupBy("grid_id", "clear").agg(F.percentile("gap", F.lit(pct / 100)).alias("gap"))
    spine = dims.select("grid_id", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("clear"))
    return rollup.reindex(p, spine, ["grid_id", "clear"], {"gap": 365.0})


# -- local time ----------------------------------------------------------------------------------------------------------
def offset_hours(at: str = "solar_time") -> Column:
    return seconds_of_day(at) / F.lit(3600.0)


def local_time_quantiles(samples: DataFrame, ids: DataFrame, by: Column, name: str) -> DataFrame:
    rows = samples.where(base()).join(ids.select("grid_id"), "grid_id").select(by.alias(name), "instrument", offset_hours().alias("h"))
    return rows.groupBy(name, "instrument").agg(F.avg("h").alias("mean"), F.median("h").alias("median"), F.percentile("h", F.lit(0.25)).alias("q25"), F.percentile("h", F.lit(0.75)).alias("q75"), F.count("*").alias("n"))


def by_fiscal_year(samples: DataFrame, ids: DataFrame) -> DataFrame:
    return local_time_quantiles(samples, ids, fiscal_year("acquired"), "fiscal_year")


def by_month(samples: DataFrame, ids: DataFrame) -> DataFrame:
    return local_time_quantiles(samples, ids, month_start("acquired"), "month")


def local_time_spread(samples: DataFrame, dims: DataFrame) -> DataFrame:
    """Hex medians of cells' median local time and of its standard deviation plus a minute, in minutes."""
    g = samples.where(base()).groupBy("grid_id").agg(F.median(offset_hours() * 60).alias("m"), F.stddev_samp(offset_hours() * 60).alias("s"))
    return rollup.to_hex(dims.select("grid_id", "hex_id").join(g, "grid_id").withColumn("s", F.col("s") + 1), {"median_minutes": ("m", "median"), "std_minutes": ("s", "median")})


def local_time_density(samples: DataFrame, year: int, low: float, high: float, n: int) -> DataFrame:
    """``instrument, density``: smoothed share of captures per bin of local time."""
    edges = bins.linspace(low, high, n + 1)
    rows = samples.where(all_of(base(), in_year("acquired", year, Closed.LEFT)))
    h = bins.histogram(rows, offset_hours(), edges[1:], by=("instrument",)).where(F.col("upper") <= high)
    packed = h.groupBy("instrument").agg(F.array_sort(F.collect_list(F.struct("upper", "n"))).alias("b"))
    return packed.select("instrument", bins.smooth(F.transform("b", lambda s: s["n"])).alias("density"))


# -- dataset statistics --------------------------------------------------------------------------------------------------
def dataset_stats(samples: DataFrame, approximate: bool = False) -> DataFrame:
    """Distinct scenes by bands and first and last dates; exact counts group by scene once instead of expanding rows."""
    has8, at = F.col("has_8_channel"), F.col("acquired")
    dates = [F.min(F.when(has8, at)).alias("first_8_date"), F.max(F.when(~has8, at)).alias("last_4_date"), F.min(at).alias("first_sample_date"), F.max(at).alias("last_sample_date")]
    rows = samples.where(base(coverage=None))
    if approximate:
        distinct = F.approx_count_distinct
        return rows.agg(distinct(F.when(~has8, F.col("id"))).alias("count_4_channel"), distinct(F.when(has8, F.col("id"))).alias("count_8_channel"), distinct("id").alias("sample_count"), *dates)
    one = rows.groupBy("id").agg(F.bool_or(has8).alias("is8"), F.bool_or(~has8).alias("is4"), *dates)
    n = lambda c: F.count_if(F.col("id").isNotNull() & c)
    return one.agg(n(F.col("is4")).alias("count_4_channel"), n(F.col("is8")).alias("count_8_channel"), F.count("id").alias("sample_count"), F.min("first_8_date").alias("first_8_date"), F.max("last_4_date").alias("last_4_date"), F.min("first_sample_date").alias("first_sample_date"), F.max("last_sample_date").alias("last_sample_date"))


def first_majority_month(samples: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """First month in which more than half of the scenes have eight bands."""
    m = samples.where(base(coverage=None)).groupBy(*by, month_start("acquired").alias("month")).agg(F.count_distinct(F.when(F.col("has_8_channel"), F.col("id"))).alias("n8"), F.count_distinct(F.when(~F.col("has_8_channel"), F.col("id"))).alias("n4"))
    return m.groupBy(*by).agg(F.min(F.when(F.col("n8") > F.col("n4"), F.col("month"))).alias("month"))


def quality_shares(samples: DataFrame, approximate: bool = False) -> DataFrame:
    """Distinct images and samples: all, valid, valid and clear."""
    ok, clear, rows = F.coalesce(valid(None), F.lit(False)), F.coalesce(valid(), F.lit(False)), samples.where(base(coverage=None))
    if approximate:
        distinct = F.approx_count_distinct
        return rows.agg(distinct("id").alias("images"), distinct(F.when(ok, F.col("id"))).alias("valid_images"), distinct(F.when(clear, F.col("id"))).alias("clear_images"), F.count("*").alias("samples"), F.count_if(ok).alias("valid_samples"), F.count_if(clear).alias("clear_samples"))
    one = rows.groupBy("id").agg(F.count("*").alias("n"), F.count_if(ok).alias("n_ok"), F.count_if(clear).alias("n_clear"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return one.agg(F.count("id").alias("images"), F.count_if(F.col("id").isNotNull() & (F.col("n_ok") > 0)).alias("valid_images"), F.count_if(F.col("id").isNotNull() & (F.col("n_clear") > 0)).alias("clear_images"), total("n").alias("samples"), total("n_ok").alias("valid_samples"), total("n_clear").alias("clear_samples"))


def eight_band_start(samples: DataFrame, dims: DataFrame, before: str, today: Column | None = None) -> DataFrame:
    """Hex maximum of the first month in which a cell's samples are mostly eight-band.

    A cell's months run from its first with eight bands to its last with four (or its last at all); cells that never had
    eight bands wait in the current month with no samples, which is no majority and so drops out.
    """
    ok = samples.where(all_of(base(), valid(None, sr=False), F.col("acquired") < F.lit(before).cast("timestamp_ntz")))
    b = ok.groupBy("grid_id").agg(F.min(F.when(F.col("has_8_channel"), month_start("acquired"))).alias("first8"), F.max(F.when(~F.col("has_8_channel"), month_start("acquired"))).alias("last4"), F.max(month_start("acquired")).alias("last"))
    b = b.select("grid_id", F.coalesce("first8", F.trunc(today if today is not None else F.current_date(), "month")).alias("start"), F.coalesce("last4", "last").alias("stop"), F.col("first8").isNull().alias("waits"))
    m = ok.select("grid_id", month_start("acquired").alias("month"), "has_8_channel").join(b, "grid_id").where(F.col("month").between(F.col("start"), F.col("stop")))
    monthly = m.groupBy("grid_id", "month").agg(F.count("*").alias("n"), F.count_if("has_8_channel").alias("n8"))
    waiting = b.where("waits").select("grid_id", F.col("start").alias("month"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("n8"))
    first = monthly.unionByName(waiting).where(F.try_divide("n8", "n") > 0.5).groupBy("grid_id").agg(F.min("month").alias("month"))
    return rollup.to_hex(dims.select("grid_id", "hex_id").join(first, "grid_id", "left"), {"month": ("month", "max")})


# -- tides ---------------------------------------------------------------------------------------------------------------
def tide_coverage(samples: DataFrame, dims: DataFrame, year: int) -> DataFrame:
    """Hex minimum, maximum and median of the share of the tide range seen and of the missed heights at either end."""
    seen = samples.where(all_of(base(), in_year("acquired", year, Closed.LEFT), valid())).groupBy("grid_id").agg(F.min("tide_height").alias("lo"), F.max("tide_height").alias("hi"))
    full = joins.dim_left(dims, seen, "grid_id").select("hex_id", F.try_divide(F.col("hi") - F.col("lo"), F.col("tide_range")).alias("coverage"), (F.col("tide_max") - F.col("hi")).alias("high_offset"), (F.col("lo") - F.col("tide_min")).alias("low_offset"))
    return rollup.to_hex(full, {f"{how}_{c}": (c, how) for c in ("coverage", "high_offset", "low_offset") for how in ("min", "max", "median")})


def flagged_records(samples: DataFrame, ids: list[int], keep: Column) -> DataFrame:
    """All records of some cells, flagged where (cell, time) is among those that pass the filter."""
    own = samples.where(F.col("grid_id").isin(ids)).select("id", "grid_id", "acquired", "tide_height", F.coalesce(keep, F.lit(False)).alias("__keep"))
    return joins.existence(own.drop("__keep"), own.where("__keep"), ["grid_id", "acquired"], "passes")


# -- further counts ------------------------------------------------------------------------------------------------------
def daily_satellites_by_hex(samples: DataFrame, hexes: DataFrame, since: str, approximate: bool = False) -> DataFrame:
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    rows = samples.where(all_of(F.col("acquired") >= F.lit(since).cast("timestamp_ntz"), base(coverage=None), F.col("clear_percent") > 75.0))
    n = rows.groupBy("hex_id", day("acquired").alias("day")).agg(distinct("satellite_id").alias("n")).groupBy("hex_id").agg(F.sum("n").alias("sample_count"))
    return joins.dim_left(hexes, n, "hex_id", {"sample_count": 0})


def by_distance(samples: DataFrame, dims: DataFrame, start: str, end: str, km: int = 60) -> DataFrame:
    """Quartiles of cells' counts per 1-km bin (k, k + 1] from the shore, empty bins too."""
    own = counts(samples, base(), within("acquired", start, end, Closed.NEITHER), valid())
    full = joins.dim_left(dims.select("grid_id", "dist_km"), own, "grid_id", {"sample_count": 0}).withColumn("bin", bins.km_bin(F.col("dist_km")))
    n = F.col("sample_count")
    stats = full.where("bin is not null").groupBy("bin").agg(F.percentile(n, F.lit(0.25)).alias("q25"), F.median(n).alias("median"), F.percentile(n, F.lit(0.75)).alias("q75"), F.count("*").alias("n"))
    spine = samples.sparkSession.range(km).select(F.col("id").cast("int").alias("bin"))
    return rollup.reindex(stats, spine, ["bin"], {"n": 0}).withColumn("centre_km", F.col("bin") + 0.5)


def distance_share(samples: DataFrame, dims: DataFrame, start: str, end: str) -> DataFrame:
    own = counts(samples, base(), within("acquired", start, end, Closed.NEITHER), valid())
    full = joins.dim_left(dims.select("grid_id", "dist_km"), own, "grid_id", {"sample_count": 0})
    return rollup.running_share(full, "dist_km", "sample_count")


def missing_by_year(flags: DataFrame, names: tuple[str, ...]) -> DataFrame:
    return flags.groupBy(F.trunc(F.to_date("acquired"), "year").alias("year"), "item_type").agg(*[F.count_if(~F.col(n)).alias(f"count_{n}") for n in names])


def shore_counts(samples: DataFrame, dims: DataFrame, year: int, km: float = 3.0) -> DataFrame:
    tidal = dims.where(((F.col("dist_km") < km) | F.col("is_coast")) & F.col("tide_range").isNotNull())
    own = counts(samples, base(), in_year("acquired", year, Closed.LEFT), valid())
    return joins.dim_left(tidal.select("grid_id", "hex_id", "dist_km"), own, "grid_id", {"sample_count": 0})


def numeric_histogram(samples: DataFrame, column: str, n: int) -> DataFrame:
    """``upper, n`` over about n nice bins between the column's extremes (one row of bounds comes to the driver)."""
    low, high = samples.agg(F.min(column), F.max(column)).first()
    if low is None:
        return samples.sparkSession.createDataFrame([], "upper double, n long")
    return bins.histogram(samples, F.col(column), bins.nice_edges(float(low), float(high), n))


def shares_true(samples: DataFrame, column: str) -> DataFrame:
    return samples.groupBy("grid_id").agg(F.avg(F.col(column).cast("double")).alias("share"))


def audit(samples: DataFrame, columns: list[str]) -> DataFrame:
    return samples.agg(F.count("*").alias("n_rows"), *null_audit(columns))


# -- pairing -------------------------------------------------------------------------------------------------------------
def pair_asof(doves: DataFrame, skysats: DataFrame, on: list[str], tolerance: float, hours: float) -> DataFrame:
    """As-of pairs in both directions, within the hours on the clock as well; unmatched rows fall to that filter."""
    both = joins.asof_both(doves, skysats, on, "acquired", "acquired_s", tolerance, "id", "id_s")
    return both.where(joins.near_time_of_day("acquired", "acquired_s", hours))


def pair_overlapping(pairs: DataFrame, left_ring: str, right_ring: str) -> DataFrame:
    """Pairs whose footprints share area, with it: ``overlap_area`` (the right ring convex)."""
    cut = pairs.withColumn("__cut", geometry.clip(left_ring, right_ring))
    return cut.withColumn("overlap_area", geometry.area("__cut")).where("overlap_area > 0").drop("__cut")


def pair_band(doves: DataFrame, skysats: DataFrame, on: list[str], hours: float) -> DataFrame:
    return joins.band(doves, skysats, on, "acquired", "acquired_s", hours * 3600)


def best_overlap(pairs: DataFrame, key: str, order: str, tie: str) -> DataFrame:
    return rollup.best_first(pairs, [key], [F.col(order).desc()], tie)


# -- enrichment ----------------------------------------------------------------------------------------------------------
def enrich(scenes: DataFrame, cells: DataFrame, scene_key: str, cell_key: str, of_cell: bool, size: float = 1.0) -> DataFrame:
    """Scene x cell rows with the share of the cell's area (coastal tables) or of the scene's (hex tables) they share, and
    whether the shared part holds the cell's centre."""
    middle, whole = geometry.centroid("ring"), {"whole": geometry.area("ring")}
    centre = {"cx": middle["x"], "cy": middle["y"]}
    shared = joins.overlay(scenes, cells, scene_key, cell_key, size=size, left_with=None if of_cell else whole, right_with={**centre, **(whole if of_cell else {})})
    box = F.col("overlap_box")
    held = F.when(box.isNotNull(), F.col("cx").between(box["x0"], box["x1"]) & F.col("cy").between(box["y0"], box["y1"])).otherwise(geometry.contains("overlap", F.col("cx"), F.col("cy")))
    return shared.select(scene_key, cell_key, F.try_divide("overlap_area", "whole").alias("coverage_pct"), held.alias("intersects_centroid"))


def enrich_fully(scenes: DataFrame, cells: DataFrame, nodes: DataFrame, scene_key: str, cell_key: str, mid: float, size: float = 1.0) -> DataFrame:
    """The coastal table: scene x cell rows with coverage, centre hit, tide height, mid-tide flag, whether the cell has tide
    data, and local solar time at the cell's centre (column x as degrees of longitude).

    scenes: key, ``acquired``, ``ring``; nodes: tide constituents of cells (``amp, speed, phase``).
    """
    shared = enrich(scenes, cells, scene_key, cell_key, True, size)
    lon = cells.select(cell_key, geometry.centroid("ring")["x"].alias("lon"))
    rows = shared.join(scenes.select(scene_key, "acquired"), scene_key).join(lon, cell_key)
    with_tide = tides.with_elevation(rows, nodes, cell_key, "acquired")
    height = F.col("tide_height")
    return with_tide.select(
        scene_key, cell_key, "acquired", "coverage_pct", "intersects_centroid", "tide_height", F.coalesce(tides.is_mid_tide(height, mid), F.lit(False)).alias("is_mid_tide"), height.isNotNull().alias("has_tide_data"), solar_time("acquired", F.col("lon")).alias("solar_time")
    )


def colour_bins(df: DataFrame, column: str, n: int = 7, log: bool = False) -> DataFrame:
    """Bounds and edges of n colour bins; logarithmic ones drop what is not positive. One row, nulls where empty."""
    x = F.col(column).cast("double")
    own = df.where(x.isNotNull() & ~F.isnan(x) & (x > 0 if log else F.lit(True)))
    b = own.agg(F.min(x).alias("low"), F.max(x).alias("high"))
    f, g = (F.ln, F.exp) if log else (lambda c: c, lambda c: c)
    edges = F.transform(F.sequence(F.lit(0), F.lit(n)), lambda k: g(f(F.col("low")) + (f(F.col("high")) - f(F.col("low"))) * k / n))
    return b.select("low", "high", F.when(F.col("low").isNotNull(), edges).alias("edges"))


def selected_near_shore(dims: DataFrame, km: float) -> DataFrame:
    return dims.where(near_shore(km)).select("grid_id")
