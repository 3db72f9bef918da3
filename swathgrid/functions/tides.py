"""Tide elevation by harmonic synthesis, tide bins and the overpass simulation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.rollup import circular_gaps
from .timeparts import epoch

#: Overpass of each constellation: hour of local solar time and every how many days.
OVERPASSES = {"planet": (11.0, 1), "sentinel": (10.5, 5), "landsat": (10.0, 8)}
FULL_DAY_MINUTES = 1439


def elevation(at: Column, constituents: Column) -> Column:
    """Height at seconds ``at`` from an array of struct<amp, speed (degrees/hour), phase (degrees)>; null without any."""
    hours = at / 3600.0
    total = F.aggregate(constituents, F.lit(0.0), lambda a, c: a + c["amp"] * F.cos(F.radians(c["speed"] * hours - c["phase"])))
    return F.when(F.size(constituents) > 0, total)


def with_elevation(samples: DataFrame, nodes: DataFrame, key: str, at: str) -> DataFrame:
    """samples with ``tide_height`` from nodes (key, amp, speed, phase): one array per node, joined on the key."""
    packed = nodes.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("speed", "amp", "phase"))).alias("__c"))
    return samples.join(packed, key, "left").withColumn("tide_height", elevation(epoch(at), F.col("__c"))).drop("__c")


def is_mid_tide(height: Column, delta: float, mean: Column | None = None, strict: bool = True) -> Column:
    d = F.abs(height if mean is None else height - mean)
    return d < delta if strict else d <= delta


def minutes(cells: DataFrame, start: str, end: str) -> DataFrame:
    """cells at every minute of [start, end): exploded day by day, so that no array is long."""
    days = F.sequence(F.lit(start).cast("date"), F.date_sub(F.lit(end).cast("date"), 1))
    by_day = cells.select("*", F.explode(days).alias("__d"))
    minute = by_day.select("*", F.explode(F.sequence(F.lit(0), F.lit(1439))).alias("__m"))
    return minute.withColumn("acquired", F.col("__d").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("__m"))).drop("__d", "__m")


def heuristics(heights: DataFrame, key: str, edges: int = 10) -> DataFrame:
    """``tide_min, tide_max, tide_mean, tide_std, tide_median, tide_p95, tide_range, tide_iqr`` and quantile edges, widened."""
    q = F.percentile("tide_height", F.array(*[F.lit(k / edges) for k in range(edges + 1)]))
    out = heights.groupBy(key).agg(
        F.min("tide_height").alias("tide_min"), F.max("tide_height").alias("tide_max"), F.avg("tide_height").alias("tide_mean"), F.stddev_samp("tide_height").alias("tide_std"), F.median("tide_height").alias("tide_median"),
        F.percentile("tide_height", F.lit(0.95)).alias("tide_p95"), (F.percentile("tide_height", F.lit(0.75)) - F.percentile("tide_height", F.lit(0.25))).alias("tide_iqr"), q.alias("__q"),
    )
    edge = [F.get("__q", F.lit(k)) + (-1e-6 if k == 0 else 1e-6 if k == edges else 0.0) for k in range(edges + 1)]
    return out.select("*", (F.col("tide_max") - F.col("tide_min")).alias("tide_range"), *[e.alias(f"height_edge_{k}") for k, e in enumerate(edge)]).drop("__q")


def overpass_samples(series: DataFrame, key: str, solar_at: str, hour: float, every: int) -> DataFrame:
    """Of each whole solar day the minute nearest the overpass (first on ties), of these every k-th day."""
    day, offset = F.to_date(solar_at), epoch(solar_at) - epoch(F.to_date(solar_at).cast("timestamp_ntz"))
    rows = series.withColumn("__day", day).withColumn("__off", F.abs(offset - hour * 3600))
    best = rows.groupBy(key, "__day").agg(F.count("*").alias("__n"), F.min_by(F.struct(*series.columns), F.struct("__off", solar_at)).alias("b")).where(F.col("__n") >= FULL_DAY_MINUTES)
    at = F.row_number().over(W.partitionBy(key).orderBy("__day"))
    return best.withColumn("__r", at).where((F.col("__r") - 1) % every == 0).select(F.col("b.*"))


def observed_stats(sampled: DataFrame, heur: DataFrame, key: str, sat: str, mid: float, period_days: float, low: str = "height_edge_1", high: str = "height_edge_9") -> DataFrame:
    """Wide statistics of one constellation's samples: range, offsets from the real extremes, gaps of low, high and mid tides."""
    rows = sampled.join(heur, key)
    agg = rows.groupBy(key).agg(F.min("tide_height").alias("lo"), F.max("tide_height").alias("hi"), F.first("tide_min").alias("tmin"), F.first("tide_max").alias("tmax"))
    width = F.col("tmax") - F.col("tmin")
    out = agg.select(
        key, F.col("lo").alias(f"{sat}_min_observed_height"), F.col("hi").alias(f"{sat}_max_observed_height"), (F.col("hi") - F.col("lo")).alias(f"{sat}_observed_tide_range"), F.try_divide(F.col("hi") - F.col("lo"), width).alias(f"{sat}_observed_spread"),
        (F.col("lo") - F.col("tmin")).alias(f"{sat}_observed_low_tide_offset"), (F.col("tmax") - F.col("hi")).alias(f"{sat}_observed_high_tide_offset"),
        F.try_divide(F.col("lo") - F.col("tmin"), width).alias(f"{sat}_observed_low_tide_offset_rel"), F.try_divide(F.col("tmax") - F.col("hi"), width).alias(f"{sat}_observed_high_tide_offset_rel"),
    )
    kinds = {"low": F.col("tide_height") <= F.col(low), "high": F.col("tide_height") >= F.col(high), "mid": is_mid_tide(F.col("tide_height"), mid, F.col("tide_mean"), strict=False)}
    tagged = rows.select(key, (epoch("acquired") / 86400.0).alias("__at"), F.explode(F.array(*[F.when(c, F.lit(k)) for k, c in kinds.items()])).alias("__kind")).where("__kind is not null")
    gaps = circular_gaps(tagged, [key, "__kind"], "__at", period_days)
    stats = gaps.groupBy(key).pivot("__kind", list(kinds)).agg(F.percentile("gap", F.lit(0.5)).alias("days_between_p50"), F.percentile("gap", F.lit(0.95)).alias("days_between_p95"), F.count("gap").alias("count"))
    named = {f"{k}_{m}": f"{sat}_{k}_{m}" for k in kinds for m in ("days_between_p50", "days_between_p95", "count")}
    return out.join(stats.withColumnsRenamed(named), key, "left").fillna(0, [f"{sat}_{k}_count" for k in kinds])


def simulate(series: DataFrame, key: str, solar_at: str, mid: float, period_days: float) -> tuple[DataFrame, DataFrame]:
    """(heuristics per cell, statistics of all constellations) from 1-minute heights with their solar time."""
    heur = heuristics(series, key)
    stats = None
    for sat, (hour, every) in OVERPASSES.items():
        own = observed_stats(overpass_samples(series, key, solar_at, hour, every), heur, key, sat, mid, period_days)
        stats = own if stats is None else stats.join(own, key, "full")
    return heur, stats
