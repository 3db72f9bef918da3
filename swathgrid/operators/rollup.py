"""Roll-ups, spines, shares and reshaping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

AGGREGATES = {"median": lambda c: F.median(c), "max": F.max, "min": F.min, "sum": F.sum, "mean": F.avg}


def to_hex(cells: DataFrame, metrics: dict[str, tuple[str, str]], by: tuple[str, ...] = ()) -> DataFrame:
    """``hex_id`` roll-up of grid metrics {name: (column, median|max|min|sum|mean)}; cells without a hex (-1) drop out."""
    return cells.where("hex_id >= 0").groupBy("hex_id", *by).agg(*[AGGREGATES[how](F.col(c)).alias(n) for n, (c, how) in metrics.items()])


def with_geometry(hexes: DataFrame, hex_dim: DataFrame) -> DataFrame:
    return hex_dim.join(hexes, "hex_id")


def reindex(df: DataFrame, spine: DataFrame, on: list[str], fill: dict | None = None) -> DataFrame:
    out = spine.join(df, on, "left")
    return out.fillna(fill) if fill else out


def years(spark, first: int, last: int, name: str = "year") -> DataFrame:
    return spark.range(first, last + 1).select(F.col("id").cast("int").alias(name))


def cross_tab(df: DataFrame, rows: str, columns: str, values: list, what: Column, fill=0) -> DataFrame:
    """Pivot with a fixed column order."""
    return df.groupBy(rows).pivot(columns, values).agg(what).fillna(fill)


def running_share(df: DataFrame, order: str, amount: str, name: str = "cum_pct", ranges: int = 1024) -> DataFrame:
    """Cumulative percentage of a total along a numeric ``order``, summed by distinct value first.

    Values fall into equal ranges between the extremes, a function of the value alone; the ranges' totals are summed over
    few rows, then each range adds up its own. Null values stand in no order and drop out.
    """
    small = df.where(F.col(order).isNotNull()).groupBy(order).agg(F.sum(amount).alias("__n"))
    ends = small.agg(F.min(order).cast("double").alias("__lo"), F.max(order).cast("double").alias("__hi"))
    at = F.coalesce(F.try_divide((F.col(order) - F.col("__lo")) * ranges, F.col("__hi") - F.col("__lo")), F.lit(0.0))
    part = small.join(F.broadcast(ends)).withColumn("__p", F.floor(at).cast("int")).drop("__lo", "__hi")  # one row
    inner = part.withColumn("__in", F.sum("__n").over(W.partitionBy("__p").orderBy(order)))
    totals = part.groupBy("__p").agg(F.sum("__n").alias("__t"))
    before = totals.select("__p", (F.sum("__t").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, 0)) - F.col("__t")).alias("__b"), F.sum("__t").over(W.partitionBy()).alias("__all"))
    return inner.join(F.broadcast(before), "__p").select(order, F.col("__n").alias(amount), (100.0 * (F.col("__in") + F.col("__b")) / F.col("__all")).alias(name))


def share_where(df: DataFrame, **conditions: Column) -> DataFrame:
    """One row: the percentage of rows that meet each condition (nulls do not)."""
    return df.agg(*[(100 * F.avg(F.coalesce(c, F.lit(False)).cast("double"))).alias(n) for n, c in conditions.items()])


def best_first(df: DataFrame, keys: list[str], order: list[Column], tie: str) -> DataFrame:
    """First row per key by the order, ties by the smallest ``tie``."""
    return df.withColumn("__r", F.row_number().over(W.partitionBy(*keys).orderBy(*order, F.col(tie)))).where("__r = 1").drop("__r")


def every_kth(df: DataFrame, keys: list[str], order: str, k: int) -> DataFrame:
    return df.withColumn("__r", F.row_number().over(W.partitionBy(*keys).orderBy(order))).where((F.col("__r") - 1) % k == 0).drop("__r")


def circular_gaps(df: DataFrame, keys: list[str], at: str, period: float, name: str = "gap") -> DataFrame:
    """Gap to the next row round a period; a single row has the whole period."""
    w = W.partitionBy(*keys).orderBy(at)
    first = F.first(at).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return df.withColumn(name, F.coalesce(F.lead(at).over(w), first + period) - F.col(at))
