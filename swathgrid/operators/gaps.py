"""Revisit gaps between samples of a cell, with markers at both ends of the window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import bins
from ..functions.predicates import Closed, all_of, base, in_year, valid
from ..functions.timeparts import DAY, day, epoch


def with_markers(rows: DataFrame, key: str, at: str, start: Column, end: Column) -> DataFrame:
    """rows (key, at) plus one row per key at either end: the keys are exploded once, not read twice."""
    marks = rows.select(key).distinct().select(key, F.explode(F.array(start, end)).alias(at))
    return rows.select(key, at).unionByName(marks)


def _selected(samples: DataFrame, column: str, year: int, valid_only: bool, extra: Column | None, clear: float = 75.0) -> DataFrame:
    return samples.where(all_of(base(), in_year(column, year, Closed.BOTH), valid(clear) if valid_only else None, extra))


def day_gaps(days: DataFrame, keys: list[str], at: str, start: Column, end: Column) -> DataFrame:
    """``keys, sample_count, gap`` between a key's distinct days of one window, its ends included.

    A window has a bounded number of days, so a key's days fit one array: one shuffle, no window sort, no self-join.
    """
    sets = days.groupBy(*keys).agg(F.array_sort(F.collect_set(at)).alias("d"))
    line = F.concat(F.array(start), F.col("d"), F.array(end))
    gaps = F.zip_with(F.slice(line, 2, F.size(line) - 1), F.slice(line, 1, F.size(line) - 1), lambda b, a: F.datediff(b, a).cast("double"))
    return sets.select(*keys, F.size("d").cast("long").alias("sample_count"), F.explode(gaps).alias("gap"))


def solar_day_gaps(samples: DataFrame, year: int, valid_only: bool = False, extra: Column | None = None, clear: float = 75.0) -> DataFrame:
    """``grid_id, sample_count, gap``: days between a cell's distinct solar days in a year, window ends included."""
    days = _selected(samples, "solar_time", year, valid_only, extra, clear).select("grid_id", day("solar_time").alias("ts"))
    return day_gaps(days, ["grid_id"], "ts", F.lit(f"{year}-01-01").cast("date"), F.lit(f"{year + 1}-01-01").cast("date"))


def day_gap_percentile(gaps: DataFrame, pct: int) -> DataFrame:
    """``grid_id, p{pct}_days_between, sample_count``; the gaps stand together already, so nothing is shuffled."""
    return gaps.groupBy("grid_id", "sample_count").agg(F.percentile("gap", F.lit(pct / 100)).alias(f"p{pct}_days_between")).select("grid_id", f"p{pct}_days_between", "sample_count")


def epoch_gaps(samples: DataFrame, year: int, valid_only: bool = False, hours: float = 0, extra: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(gaps in days between all of a cell's samples that reach ``hours``, window ends included; the samples)."""
    rows = _selected(samples, "acquired", year, valid_only, extra).select("grid_id", epoch("acquired").alias("ts"))
    ends = [epoch(F.lit(f"{y}-01-01").cast("timestamp_ntz")) for y in (year, year + 1)]
    marked = with_markers(rows, "grid_id", "ts", *ends)
    gap = (F.col("ts") - F.lag("ts").over(W.partitionBy("grid_id").orderBy("ts"))) / float(DAY)
    return marked.select("grid_id", gap.alias("gap")).where(F.col("gap") >= round(hours / 24.0, 3)), rows


def gap_percentile(gaps: DataFrame, samples: DataFrame, pct: int) -> DataFrame:
    """``grid_id, p{pct}_days_between, sample_count``; one row per cell that has a gap."""
    p = gaps.groupBy("grid_id").agg(F.percentile("gap", F.lit(pct / 100)).alias(f"p{pct}_days_between"))
    return p.join(samples.groupBy("grid_id").agg(F.count("*").alias("sample_count")), "grid_id")


def gap_histogram(gaps: DataFrame, edges: list[float]) -> DataFrame:
    return bins.histogram(gaps, F.col("gap"), edges)


def close_captures(samples: DataFrame, year: int, minutes: float, valid_only: bool = False) -> DataFrame:
    """``grid_id, high_freq_count``: samples that follow another of their cell within the minutes."""
    rows = samples.where(all_of(base(), in_year("acquired", year, Closed.LEFT), valid() if valid_only else None)).select("grid_id", epoch("acquired").alias("ts"))
    gap = (F.col("ts") - F.lag("ts").over(W.partitionBy("grid_id").orderBy("ts"))) / float(DAY)
    return rows.select("grid_id", gap.alias("gap")).where(F.col("gap") <= minutes / 1440).groupBy("grid_id").agg(F.count("*").alias("high_freq_count"))


def within_day_gaps(samples: DataFrame, ids: DataFrame, year: int, valid_only: bool = False) -> DataFrame:
    """Gaps in days between the first captures of different satellites on one solar day, on the cells of ids."""
    rows = samples.where(all_of(base(), in_year("acquired", year, Closed.LEFT), valid() if valid_only else None)).join(ids.select("grid_id"), "grid_id")
    first = rows.groupBy("grid_id", "satellite_id", day("solar_time").alias("day")).agg(F.min(epoch("acquired")).alias("ts"))
    gap = (F.col("ts") - F.lag("ts").over(W.partitionBy("grid_id", "day").orderBy("ts"))) / float(DAY)
    return first.select("grid_id", "day", gap.alias("gap")).where("gap is not null")
