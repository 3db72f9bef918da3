"""Capture-level operators: gap sessions, best capture per session, multi-capture days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.predicates import Closed, all_of, base, in_year, valid
from ..functions.timeparts import day, epoch


def sessions(df: DataFrame, keys: list[str], at: str, hours: float, name: str = "session") -> DataFrame:
    """df with the number of its session: a new one starts at the first row and after a gap of more than hours."""
    w = W.partitionBy(*keys).orderBy(at)
    gap = epoch(at) - epoch(F.lag(at).over(w))
    starts = df.withColumn("__new", F.when(gap.isNull() | (gap > hours * 3600), 1).otherwise(0))
    return starts.withColumn(name, F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("__new")


def stage_rank(stage: Column) -> Column:
    return F.when(stage == "finalized", 0).when(stage == "standard", 1).when(stage == "preview", 2).otherwise(3)


def best_captures(df: DataFrame, keys: list[str], hours: float, at: str = "acquired", ident: str = "id") -> DataFrame:
    """One row per session: standard quality first, then publishing stage, then the clearest, ties by id."""
    grouped = sessions(df, keys, at, hours, "__s")
    rank = F.struct((F.when(F.col("quality_category") == "standard", 0).otherwise(1)).alias("q"), stage_rank(F.col("publishing_stage")).alias("p"), (-F.coalesce(F.col("clear_percent").cast("double"), F.lit(-1.0))).alias("c"), F.col(ident).alias("i"))
    best = grouped.groupBy(*keys, "__s").agg(F.min_by(F.struct(*[c for c in df.columns if c not in keys]), rank).alias("b"))
    return best.select(*keys, "b.*").select(*df.columns)


def daily_satellites(samples: DataFrame, ids: DataFrame, start_year: int, end_year: int, clear: float = 75.0) -> DataFrame:
    """``grid_id, year, solar_day, satellites`` of valid captures on the cells of ids."""
    rows = samples.where(all_of(base(), F.col("acquired") >= F.lit(f"{start_year}-01-01").cast("timestamp_ntz"), F.col("acquired") < F.lit(f"{end_year}-01-01").cast("timestamp_ntz"), valid(clear), F.col("satellite_id").isNotNull()))
    rows = rows.join(ids.select("grid_id").distinct(), "grid_id", "left_semi")
    return rows.groupBy("grid_id", F.year("acquired").alias("year"), day("solar_time").alias("solar_day")).agg(F.count_distinct("satellite_id").alias("satellites"))


def multi_capture_summary(daily: DataFrame, ids: DataFrame, start_year: int, end_year: int) -> DataFrame:
    """One row per year of the calendar spine and one "overall" row, with shares in percent (null on an empty base).

    ids: the eligible cells, counted within the plan.
    """
    spark = daily.sparkSession
    spine = spark.range(start_year, end_year).select(F.col("id").cast("int").alias("year"))
    days = F.datediff(F.make_date(F.col("year") + 1, F.lit(1), F.lit(1)), F.make_date(F.col("year"), F.lit(1), F.lit(1)))
    counts = daily.groupBy("year").agg(F.count("*").alias("captured"), F.count_if(F.col("satellites") > 1).alias("multi"))
    full = spine.join(counts, "year", "left").select("year", F.coalesce("captured", F.lit(0)).alias("captured"), F.coalesce("multi", F.lit(0)).alias("multi"), days.alias("days"))
    rolled = full.rollup("year").agg(F.sum("captured").alias("captured_grid_days"), F.sum("multi").alias("multi_capture_grid_days"), F.sum("days").alias("calendar_days"), F.grouping("year").alias("__all"))
    every = F.col("calendar_days") * F.col("eligible")
    counted = rolled.join(F.broadcast(ids.agg(F.count("*").alias("eligible"))))  # one row
    return counted.select(
        F.when(F.col("__all") == 1, "overall").otherwise(F.col("year").cast("string")).alias("year"), "captured_grid_days", "multi_capture_grid_days", F.col("eligible").alias("eligible_grids"), "calendar_days", every.alias("all_eligible_grid_days"),
        (100 * F.try_divide("multi_capture_grid_days", "captured_grid_days")).alias("multi_capture_pct_of_captured"), (100 * F.try_divide(F.col("multi_capture_grid_days"), every)).alias("multi_capture_pct_of_all_eligible"),
    )


def multi_capture_distribution(daily: DataFrame) -> DataFrame:
    """``satellites, grid_days, pct``: the share window runs over the few distinct counts only."""
    counts = daily.groupBy("satellites").agg(F.count("*").alias("grid_days"))
    return counts.withColumn("pct", 100 * F.try_divide(F.col("grid_days"), F.sum("grid_days").over(W.partitionBy())))


def multi_capture_days(samples: DataFrame, year: int, valid_only: bool = False, approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct if approximate else F.count_distinct
    rows = samples.where(all_of(base(), in_year("acquired", year, Closed.LEFT), valid() if valid_only else None))
    days = rows.groupBy("grid_id", day("solar_time").alias("day")).agg(count("satellite_id").alias("n")).where("n > 1")
    return days.groupBy("grid_id").agg(F.count("*").alias("multi_capture_days"))


def max_daily_captures(samples: DataFrame, year: int, valid_only: bool = False) -> DataFrame:
    rows = samples.where(all_of(base(), in_year("acquired", year, Closed.LEFT), valid() if valid_only else None))
    return rows.groupBy("grid_id", day("solar_time").alias("day")).agg(F.count("*").alias("n")).groupBy("grid_id").agg(F.max("n").alias("max_daily_captures"))
