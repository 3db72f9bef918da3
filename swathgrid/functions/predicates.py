"""Reusable predicates as columns; extra filters are columns too, never strings."""

from __future__ import annotations

from enum import Enum
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


class Closed(Enum):
    """Which ends belong to a time window. The three are kept apart: queries differ in them on purpose."""

    BOTH = "both"
    LEFT = "left"
    NEITHER = "neither"


def valid(clear: float | None = 75.0, at_least: bool = False, sr: bool = True) -> Column:
    """Finalized, standard quality, ground-controlled and clear; with a surface-reflectance asset unless sr is False."""
    out = (F.col("publishing_stage") == "finalized") & (F.col("quality_category") == "standard") & F.col("ground_control")
    if clear is not None:
        out &= F.col("clear_percent") >= clear if at_least else F.col("clear_percent") > clear
    return out & F.col("has_sr_asset") if sr else out


def base(item_type: str = "PSScene", coverage: float | None = 0.5) -> Column:
    out = F.col("item_type") == item_type
    return out if coverage is None else out & (F.col("coverage_pct") > coverage)


def within(column: str, start: str, end: str, closed: Closed = Closed.BOTH) -> Column:
    c, a, b = F.col(column), F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    low = c > a if closed is Closed.NEITHER else c >= a
    return low & (c <= b if closed is Closed.BOTH else c < b)


def in_year(column: str, year: int, closed: Closed = Closed.BOTH) -> Column:
    return within(column, f"{year}-01-01", f"{year + 1}-01-01", closed)


def in_season(column: str, months: tuple[int, ...]) -> Column:
    return F.month(column).isin(*months)


def near_shore(km: float, null_land_is_land: bool = True) -> Column:
    land = F.coalesce("is_land", F.lit(True)) if null_land_is_land else F.col("is_land")
    return ~land & F.col("dist_km").isNotNull() & (F.col("dist_km") < km)


def tidal(km: float = 3.0) -> Column:
    return ((F.col("dist_km") < km) | F.col("is_coast")) & F.col("tide_range").isNotNull()


def lat_band(column: str, low: float, high: float) -> Column:
    return (F.col(column) >= low) & (F.col(column) <= high)


def all_of(*conditions: Column | None) -> Column:
    return reduce(lambda a, b: a & b, [c for c in conditions if c is not None], F.lit(True))


def null_audit(columns: list[str]) -> list[Column]:
    return [F.count_if(F.col(c).isNull()).alias(c) for c in columns]
