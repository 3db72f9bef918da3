"""Bins and histograms; the closures differ by query and are kept apart."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def right_closed(x: Column, edges: list[float]) -> Column:
    """Upper edge of x's bin (previous, edge]; below the first edge: the first; above the last: infinity; null: null."""
    out = F.lit(math.inf)
    for e in reversed(edges):
        out = F.when(x <= e, F.lit(float(e))).otherwise(out)
    return F.when(x.isNotNull(), out)


def _packed(df: DataFrame, bin_of: Column, by: tuple[str, ...]) -> DataFrame:
    """``by, m``: one map of counts per group, in a single pass over df; a group has as many entries as bins."""
    counts = df.groupBy(*by, bin_of.alias("bin")).agg(F.count("*").alias("n"))
    entries = F.collect_list(F.when(F.col("bin").isNotNull(), F.struct("bin", "n")))
    return counts.groupBy(*by).agg(F.map_from_entries(entries).alias("m"))


def histogram(df: DataFrame, x: Column, edges: list[float], by: tuple[str, ...] = ()) -> DataFrame:
    """``by, upper, n``: right-closed counts, every edge present and infinity only where something lies beyond."""
    packed = _packed(df.where(x.isNotNull()), right_closed(x, edges), by).where(F.size("m") > 0)
    full = F.transform(F.array(*[F.lit(float(e)) for e in edges]), lambda e: F.struct(e.alias("upper"), F.coalesce(F.try_element_at("m", e), F.lit(0).cast("long")).alias("n")))
    beyond = F.lit(math.inf)
    last = F.when(F.map_contains_key("m", beyond), F.array(F.struct(beyond.alias("upper"), F.try_element_at("m", beyond).alias("n")))).otherwise(F.slice(full, 1, 0))
    return packed.select(*by, F.explode(F.concat(full, last)).alias("e")).select(*by, "e.upper", "e.n")


def histogram_map(df: DataFrame, x: Column, edges: list[float]) -> DataFrame:
    """The same as one MAP<upper edge, count>; null when there is nothing to count."""
    rows = histogram(df, x, edges)
    return rows.agg(F.expr("map_from_entries(array_sort(collect_list(struct(upper, n))))").alias("bucket")).select(F.when(F.size("bucket") > 0, F.col("bucket")).alias("bucket"))


def left_closed(df: DataFrame, x: Column, edges: list[float], by: tuple[str, ...] = ()) -> DataFrame:
    """``by, bin, n``: bins [a, b), the last closed; what lies outside, nulls and NaN are ignored; empty bins count 0."""
    n = len(edges) - 1
    at = F.lit(None).cast("int")
    for k in reversed(range(n)):
        at = F.when((x >= edges[k]) & ((x < edges[k + 1]) if k < n - 1 else (x <= edges[k + 1])), F.lit(k)).otherwise(at)
    packed = _packed(df, F.when(~F.isnan(x.cast("double")), at), by)
    full = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.struct(k.alias("bin"), F.coalesce(F.try_element_at("m", k), F.lit(0).cast("long")).alias("n")))
    return packed.select(*by, F.explode(full).alias("e")).select(*by, "e.bin", "e.n")


def nice_edges(low: float, high: float, bins: int) -> list[float]:
    """Right edges of about ``bins`` bins with steps of 1, 2 or 5 times a power of ten that reach high."""
    step = (high - low) / bins or 1.0
    power = 10 ** math.floor(math.log10(step))
    step = next(m * power for m in (1, 2, 5, 10) if m * power >= step * (1 - 1e-9))
    first = math.floor(low / step) * step
    out = [first + step]
    while out[-1] < high:
        out.append(out[-1] + step)
    return out


def km_bin(x: Column) -> Column:
    """1-km bins (k, k + 1]; 0 km belongs to none."""
    return F.when(x > 0, (F.ceil(x) - 1).cast("int"))


def left_index(h: Column, edges: Column) -> Column:
    """Number of edges at or below h, less 1; -1 without edges or height."""
    return F.coalesce(F.aggregate(edges, F.lit(0), lambda a, e: a + F.when(e.isNotNull() & (h >= e), 1).otherwise(0)) - 1, F.lit(-1))


def linspace(low: float, high: float, n: int) -> list[float]:
    return [low + (high - low) * k / (n - 1) for k in range(n)] if n > 1 else [low]


def logspace(low: float, high: float, n: int) -> list[float]:
    a, b = math.log10(low), math.log10(high)
    return [10 ** x for x in linspace(a, b, n)]


def smooth(counts: Column, taps: int = 31, half_width: float = 3.0) -> Column:
    """Gaussian smoothing of an array of counts, scaled to unit sum."""
    xs = linspace(-half_width, half_width, taps)
    w = [math.exp(-x * x / 2) for x in xs]
    total = sum(w)
    kernel = F.array(*[F.lit(v / total) for v in w])
    mid = taps // 2

    def at(i: Column) -> Column:
        terms = F.transform(F.sequence(F.lit(0), F.lit(taps - 1)), lambda k: F.coalesce(F.get(counts, i + k - mid).cast("double"), F.lit(0.0)) * F.get(kernel, k))
        return F.aggregate(terms, F.lit(0.0), lambda a, v: a + v)

    raw = F.transform(F.sequence(F.lit(0), F.size(counts) - 1), at)
    sum_of = F.aggregate(raw, F.lit(0.0), lambda a, v: a + v)
    return F.transform(raw, lambda v: v / F.when(sum_of > 0, sum_of))
