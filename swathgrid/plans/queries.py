"""Registered queries over the test tables, each beside the same question in SQL for an independent engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bins, geometry, tides, timeparts
from ..functions.predicates import Closed, all_of, base, in_year, near_shore, valid
from ..operators import captures as C
from ..operators import gaps as G
from ..operators import joins, rollup
from ..sources.sinks import hex_path
from . import analyses as A
from .shapes import CAPTURES, FOOTPRINTS, GRIDS, SAMPLES, captures, cell_boxes, footprints, grids, read, samples

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None, *ctes: str):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = ("with " + ",\n".join(ctes) + "\n" if ctes else "") + sql
        return f

    return put


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


BASE = "item_type = 'PSScene' and coverage_pct > 0.5"
OK = "publishing_stage = 'finalized' and quality_category = 'standard' and ground_control"
VALID = f"{OK} and has_sr_asset and clear_percent > "
Y = "between timestamp '1998-01-01' and timestamp '1999-01-01'"


def _gaps(where: str, day: str = "solar_time", source: str = "samples") -> str:
    """CTEs for gaps between distinct days of 1998, markers included."""
    return f"""d as (select distinct grid_id, cast({day} as date) as t from {source} where {where}),
  m as (select grid_id, t from d union all select distinct grid_id, x.t from d, (values (date '1998-01-01'), (date '1999-01-01')) as x(t)),
  g as (select grid_id, cast(t - lag(t) over (partition by grid_id order by t) as double) as gap from m),
  p as (select grid_id, count(*) as sample_count from d group by grid_id)"""


@query("q01_solar_gap_p90", "select g.grid_id, round(quantile_cont(gap, 0.9), 6) as p90_days_between, any_value(sample_count) as sample_count from g join p using (grid_id) where gap is not null group by g.grid_id", SAMPLES, _gaps(f"{BASE} and {VALID} 25 and solar_time {Y}"))
def q01(spark, d):
    return A.gap_percentiles(samples(spark, d), 1998, 90, True, clear=25.0).select("grid_id", r6("p90_days_between").alias("p90_days_between"), "sample_count")


@query("q01b_solar_gap_p50_all", "select g.grid_id, round(quantile_cont(gap, 0.5), 6) as p50_days_between, any_value(sample_count) as sample_count from g join p using (grid_id) where gap is not null group by g.grid_id", SAMPLES, _gaps(f"{BASE} and solar_time {Y}"))
def q01b(spark, d):
    return A.gap_percentiles(samples(spark, d), 1998, 50, False).select("grid_id", r6("p50_days_between").alias("p50_days_between"), "sample_count")


EDGES = [1.0, 2.0, 3.0, 5.0, 7.0, 14.0, 30.0, 60.0]


def _hist(source: str, x: str, edges: list[float], by: str = "") -> str:
    """Right-closed counts with all edges and infinity only where it occurs, in plain SQL."""
    pick = "case " + " ".join(f"when {x} <= {e} then {e}" for e in edges) + " else 'infinity'::double end"
    b, k = (f"{by}, ", f"{by} = k.{by} and ") if by else ("", "")
    keys = f"(select distinct {by} from {source} where {x} is not null) as k, " if by else ""
    have = f" where exists (select 1 from {source} where {x} is not null)" if not by else ""
    values = ", ".join(f"({e}::double)" for e in edges)
    left = f"select {'k.' + by + ', ' if by else ''}e.upper, (select count(*) from {source} as s where {'s.' + k if by else ''}{x} is not null and {pick} = e.upper) as n from {keys}(values {values}) as e(upper){have}"
    return f"{left} union all select {b}upper, n from (select {b}{pick} as upper, count(*) as n from {source} where {x} is not null group by all) where upper = 'infinity'::double"


@query("q02_solar_gap_hist", _hist("g", "gap", EDGES), SAMPLES, _gaps(f"{BASE} and {VALID} 25 and solar_time {Y}"))
def q02(spark, d):
    return G.gap_histogram(G.solar_day_gaps(samples(spark, d), 1998, True, clear=25.0), EDGES)


EVENT_GAPS = f"""r as (select grid_id, epoch(acquired) as t from captures where {BASE} and acquired between timestamp '2024-01-01' and timestamp '2025-01-01'),
  m as (select * from r union all select distinct grid_id, x.t from r, (values (epoch(timestamp '2024-01-01')), (epoch(timestamp '2025-01-01'))) as x(t)),
  g as (select grid_id, (t - lag(t) over (partition by grid_id order by t)) / 86400 as gap from m)"""


@query("q03_epoch_gap_p50", "select g.grid_id, round(quantile_cont(gap, 0.5), 6) as p50_days_between, any_value(c.n) as sample_count from g join (select grid_id, count(*) as n from r group by grid_id) as c using (grid_id) where gap >= 0.042 group by g.grid_id", CAPTURES, EVENT_GAPS)
def q03(spark, d):
    return G.gap_percentile(*G.epoch_gaps(captures(spark, d), 2024, hours=1), 50).select("grid_id", r6("p50_days_between").alias("p50_days_between"), "sample_count")


SHORT = [0.05, 0.1, 0.25, 0.5, 1.0]


@query("q04_epoch_gap_hist", _hist("(select gap from g where gap >= 0.042)", "gap", SHORT), CAPTURES, EVENT_GAPS)
def q04(spark, d):
    return G.gap_histogram(G.epoch_gaps(captures(spark, d), 2024, hours=1)[0], SHORT)


YEAR24 = "acquired >= timestamp '2024-01-01' and acquired < timestamp '2025-01-01'"


@query("q05_multi_capture_days", f"select grid_id, count(*) as multi_capture_days from (select grid_id, cast(solar_time as date) as day from captures where {BASE} and {YEAR24} and {VALID} 75 group by all having count(distinct satellite_id) > 1) group by grid_id", CAPTURES)
def q05(spark, d):
    return C.multi_capture_days(captures(spark, d), 2024, True)


@query("q06_close_captures", f"select grid_id, count(*) as high_freq_count from (select grid_id, epoch(acquired) - lag(epoch(acquired)) over (partition by grid_id order by acquired) as s from captures where {BASE} and {YEAR24}) where s <= 1800 group by grid_id", CAPTURES)
def q06(spark, d):
    return G.close_captures(captures(spark, d), 2024, 30)


@query("q07_max_daily_captures", f"select grid_id, max(n) as max_daily_captures from (select grid_id, cast(solar_time as date) as day, count(*) as n from captures where {BASE} and {YEAR24} group by all) group by grid_id", CAPTURES)
def q07(spark, d):
    return C.max_daily_captures(captures(spark, d), 2024)


NEAR = "ids as (select grid_id from dims where not is_land and dist_km < 20)"


@query("q08_within_day_hist", _hist("g", "gap", SHORT), GRIDS, NEAR, CAPTURES, f"f as (select grid_id, satellite_id, cast(solar_time as date) as day, min(epoch(acquired)) as t from captures join ids using (grid_id) where {BASE} and {YEAR24} group by all), g as (select (t - lag(t) over (partition by grid_id, day order by t)) / 86400 as gap from f)")
def q08(spark, d):
    return G.gap_histogram(G.within_day_gaps(captures(spark, d), A.selected_near_shore(grids(spark, d), 20), 2024), SHORT)


DAILY = f"daily as (select grid_id, year(acquired) as y, cast(solar_time as date) as day, count(distinct satellite_id) as satellites from captures semi join ids using (grid_id) where {BASE} and acquired >= timestamp '2023-01-01' and acquired < timestamp '2026-01-01' and {VALID} 20 and satellite_id is not null group by all)"


@query(
    "q09_multi_capture_rate",
    """, a as (select y.y, coalesce(sum(1) filter (satellites is not null), 0) as c, coalesce(sum(1) filter (satellites > 1), 0) as m, any_value(case when y.y = 2024 then 366 else 365 end) as days from (values (2023), (2024), (2025)) as y(y) left join daily using (y) group by y.y),
  b as (select cast(y as varchar) as year, c, m, days from a union all select 'overall', sum(c), sum(m), sum(days) from a), n as (select count(*) as k from ids)
select year, cast(c as bigint) as captured_grid_days, cast(m as bigint) as multi_capture_grid_days, k as eligible_grids, cast(days as bigint) as calendar_days, cast(days * k as bigint) as all_eligible_grid_days,
  round(100.0::double * m / nullif(c, 0), 6) as multi_capture_pct_of_captured, round(100.0::double * m / (days * k), 6) as multi_capture_pct_of_all_eligible from b, n""",
    GRIDS, NEAR, CAPTURES, DAILY,
)
def q09(spark, d):
    ids = A.selected_near_shore(grids(spark, d), 20)
    daily = C.daily_satellites(captures(spark, d), ids, 2023, 2026, clear=20.0)
    out = C.multi_capture_summary(daily, ids, 2023, 2026)
    return out.withColumns({c: r6(c) for c in ("multi_capture_pct_of_captured", "multi_capture_pct_of_all_eligible")})


@query("q09b_multi_capture_distribution", "select satellites, count(*) as grid_days, round(100.0::double * count(*) / sum(count(*)) over (), 6) as pct from daily group by satellites", GRIDS, NEAR, CAPTURES, DAILY)
def q09b(spark, d):
    daily = C.daily_satellites(captures(spark, d), A.selected_near_shore(grids(spark, d), 20), 2023, 2026, clear=20.0)
    return C.multi_capture_distribution(daily).withColumn("pct", r6("pct"))


@query(
    "q10_hex_counts",
    f"select hex_id, round(median(n), 6) as median_count, max(n) as max_count, cast(nullif(sum(n), 0) as bigint) as total from (select grid_id, hex_id, coalesce(n, 0) as n from dims left join (select grid_id, count(*) as n from samples where {BASE} and {VALID} 75 and acquired > timestamp '1995-01-01' and acquired < timestamp '2002-01-01' group by grid_id) using (grid_id)) where hex_id >= 0 group by hex_id",
    SAMPLES, GRIDS,
)
def q10(spark, d):
    return A.hex_counts(samples(spark, d), grids(spark, d), "1995-01-01", "2002-01-01", True).withColumn("median_count", r6("median_count"))


@query(
    "q11_yearly_counts",
    f"""select hex_id, year, valid, round(median(coalesce(n, 0)), 6) as median_count, cast(sum(coalesce(n, 0)) as bigint) as total from dims cross join (select unnest(range(1996, 2001))::int as year) as y cross join (values (true), (false)) as v(valid)
  left join (select grid_id, year, valid, count(*) as n from (select s.*, y.year, v.valid from samples as s, (select unnest(range(1996, 2001))::int as year) as y, (values (true), (false)) as v(valid) where {BASE} and acquired between make_timestamp(y.year::bigint, 1::bigint, 1::bigint, 0::bigint, 0::bigint, 0::double) and make_timestamp(y.year::bigint + 1, 1::bigint, 1::bigint, 0::bigint, 0::bigint, 0::double) and (not v.valid or ({VALID} 75))) group by all) as c using (grid_id, year, valid) where hex_id >= 0 group by hex_id, year, valid""",
    SAMPLES, GRIDS,
)
def q11(spark, d):
    return A.yearly_counts(samples(spark, d), grids(spark, d), 1996, 2000).withColumn("median_count", r6("median_count"))


@query(
    "q12_seasonal_counts",
    f"""select hex_id, s.season, round(median(coalesce(n, 0)), 6) as median_count, max(coalesce(n, 0)) as max_count, cast(sum(coalesce(n, 0)) as bigint) as total from dims, (values ('winter'), ('spring'), ('summer'), ('autumn')) as s(season)
  left join (select grid_id, case when month(acquired) in (12, 1, 2) then 'winter' when month(acquired) <= 5 then 'spring' when month(acquired) <= 8 then 'summer' else 'autumn' end as season, count(*) as n from samples where {BASE} and acquired between timestamp '1996-01-01' and timestamp '2000-01-01' group by all) as c on dims.grid_id = c.grid_id and s.season = c.season where hex_id >= 0 group by all""",
    SAMPLES, GRIDS,
)
def q12(spark, d):
    return A.seasonal_counts(samples(spark, d), grids(spark, d), "1996-01-01", "2000-01-01", False).withColumn("median_count", r6("median_count"))


@query("q13_reach", "select " + ", ".join(f"round(100 * avg(case when coalesce(n, 0) >= {k} then 1.0::double else 0 end), 6) as pct_ge_{k}" for k in (1, 5, 100)) + " from dims left join (select grid_id, count(*) as n from samples where item_type = 'SkySatCollect' group by grid_id) using (grid_id)", SAMPLES, GRIDS)
def q13(spark, d):
    out = A.reach(samples(spark, d), grids(spark, d), "SkySatCollect")
    return out.select(*[r6(c).alias(c) for c in out.columns])


HEXGAP = "select hex_id, round(median(x), 6) as median_gap from (select hex_id, x from dims left join (select g.grid_id, case when any_value(sample_count) >= 2 then quantile_cont(gap, {p}) end as x from g join p using (grid_id) where gap is not null group by g.grid_id) as q using (grid_id)) where hex_id >= 0 group by hex_id"


@query("q14_hex_gaps", HEXGAP.format(p=0.9), SAMPLES, GRIDS, _gaps(f"{BASE} and solar_time {Y}"))
def q14(spark, d):
    return A.hex_gaps(samples(spark, d), grids(spark, d), 1998, 90, False).withColumn("median_gap", r6("median_gap"))


@query("q14b_gap_bins_left_closed", "select b as bin, (select count(*) from h where h.x >= b * 10 and (h.x < b * 10 + 10 or (b = 9 and h.x <= 100))) as n from (select unnest(range(10))::int as b), (select 1) where true", SAMPLES, _gaps(f"{BASE} and solar_time {Y}"), "h as (select quantile_cont(gap, 0.9) as x from g where gap is not null group by grid_id)")
def q14b(spark, d):
    p = A.gap_percentiles(samples(spark, d), 1998, 90, False)
    return bins.left_closed(p, F.col("p90_days_between"), [10.0 * k for k in range(11)])


@query(
    "q15_gaps_by_clear",
    f"""select dims.grid_id, c.clear, round(coalesce(x, 365), 6) as gap from dims, (values (0.0::double), (25), (50), (75), (100)) as c(clear) left join (select grid_id, clear, quantile_cont(gap, 0.9) as x from g where gap is not null group by all) as q on dims.grid_id = q.grid_id and c.clear = q.clear""",
    SAMPLES, GRIDS,
    f"""d as (select distinct grid_id, clear, cast(solar_time as date) as t from samples, (values (0.0::double), (25), (50), (75), (100)) as c(clear) where {BASE} and {OK} and has_sr_asset and clear_percent >= clear and solar_time {Y}),
  m as (select * from d union all select distinct grid_id, clear, x.t from d, (values (date '1998-01-01'), (date '1999-01-01')) as x(t)), g as (select grid_id, clear, cast(t - lag(t) over (partition by grid_id, clear order by t) as double) as gap from m)""",
)
def q15(spark, d):
    return A.gaps_by_clear(samples(spark, d), grids(spark, d), 1998, 90).select("grid_id", "clear", r6("gap").alias("gap"))


LOCAL = "h as (select s.*, (hour(solar_time) * 3600 + minute(solar_time) * 60 + second(solar_time)) / 3600::double as h from samples as s where " + BASE + ")"
QUART = "round(avg(h), 6) as mean, round(median(h), 6) as median, round(quantile_cont(h, 0.25), 6) as q25, round(quantile_cont(h, 0.75), 6) as q75, count(*) as n"


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: r6(n) for n in names})


@query("q16_local_time_by_fiscal_year", f"select cast(year(acquired) + case when month(acquired) = 12 then 1 else 0 end as int) as fiscal_year, instrument, {QUART} from h join ids using (grid_id) group by all", SAMPLES, GRIDS, NEAR, LOCAL)
def q16(spark, d):
    return _rounded(A.by_fiscal_year(samples(spark, d), A.selected_near_shore(grids(spark, d), 20)), "mean", "median", "q25", "q75")


@query("q17_local_time_by_month", f"select cast(date_trunc('month', acquired) as date) as month, instrument, {QUART} from h join ids using (grid_id) group by all", SAMPLES, GRIDS, NEAR, LOCAL)
def q17(spark, d):
    return _rounded(A.by_month(samples(spark, d), A.selected_near_shore(grids(spark, d), 20)), "mean", "median", "q25", "q75")


@query("q18_local_time_spread", "select hex_id, round(median(m), 6) as median_minutes, round(median(s), 6) as std_minutes from (select grid_id, median(h * 60) as m, stddev_samp(h * 60) + 1 as s from h group by grid_id) join dims using (grid_id) where dims.hex_id >= 0 group by hex_id", SAMPLES, GRIDS, LOCAL)
def q18(spark, d):
    return _rounded(A.local_time_spread(samples(spark, d), grids(spark, d)), "median_minutes", "std_minutes")


HOURS = [2.0 * k for k in range(1, 13)]


@query("q19_local_time_hist", _hist("(select instrument, h from h where acquired >= timestamp '1998-01-01' and acquired < timestamp '1999-01-01')", "h", HOURS, "instrument"), SAMPLES, LOCAL)
def q19(spark, d):
    return bins.histogram(samples(spark, d).where(all_of(base(), in_year("acquired", 1998, Closed.LEFT))), A.offset_hours(), HOURS, by=("instrument",))


@query(
    "q19b_local_time_density",
    """select instrument, bin, round(raw / sum(raw) over (partition by instrument), 9) as density from
  (select i.instrument, i.bin, sum(coalesce(c.n, 0) * exp(-x * x / 2)) as raw from (select instrument, bin from (select distinct instrument from s), (select unnest(range(0, 48)) as bin)) as i, (select k, (-3 + 6 * k / 30.0::double) as x from (select unnest(range(0, 31)) as k))
    left join (select instrument, bin, count(*) as n from s group by all) as c on c.instrument = i.instrument and c.bin = i.bin + k - 15 group by i.instrument, i.bin)""",
    SAMPLES,
    f"s as (select instrument, greatest(ceil((hour(solar_time) * 3600 + minute(solar_time) * 60 + second(solar_time)) / 1800.0::double), 1)::bigint - 1 as bin from samples where {BASE} and solar_time is not null and acquired >= timestamp '1998-01-01' and acquired < timestamp '1999-01-01')",
)
def q19b(spark, d):
    found = A.local_time_density(samples(spark, d), 1998, 0.0, 24.0, 48).select("instrument", F.posexplode("density").alias("bin", "density"))
    return found.select("instrument", F.col("bin").cast("long").alias("bin"), F.round("density", 9).alias("density"))


@query("q20_dataset_stats", "select count(distinct case when not has_8_channel then id end) as count_4_channel, count(distinct case when has_8_channel then id end) as count_8_channel, count(distinct id) as sample_count, min(case when has_8_channel then acquired end) as first_8_date, max(case when not has_8_channel then acquired end) as last_4_date, min(acquired) as first_sample_date, max(acquired) as last_sample_date from samples where item_type = 'PSScene'", SAMPLES)
def q20(spark, d):
    return A.dataset_stats(samples(spark, d))


@query("q20b_first_majority_month", "select min(month) as month from (select cast(date_trunc('month', acquired) as date) as month from samples where item_type = 'PSScene' group by 1 having count(distinct case when has_8_channel then id end) > count(distinct case when not has_8_channel then id end))", SAMPLES)
def q20b(spark, d):
    return A.first_majority_month(samples(spark, d))


@query("q21_quality_shares", f"select count(distinct id) as images, count(distinct case when {OK} and has_sr_asset then id end) as valid_images, count(distinct case when {VALID} 75 then id end) as clear_images, count(*) as samples, count_if({OK} and has_sr_asset) as valid_samples, count_if({VALID} 75) as clear_samples from samples where item_type = 'PSScene'", SAMPLES)
def q21(spark, d):
    return A.quality_shares(samples(spark, d))


@query("q22_yearly_by_satellite", "select year(acquired)::int as year, " + ", ".join(f"count(distinct case when satellite_id % 4 = {k} then id end) as s{k}" for k in range(4)) + " from samples where item_type = 'SkySatCollect' group by 1", SAMPLES)
def q22(spark, d):
    rows = samples(spark, d).where("item_type = 'SkySatCollect'").select("id", F.year("acquired").alias("year"), F.concat(F.lit("s"), F.col("satellite_id") % 4).alias("sat"))
    return rollup.cross_tab(rows, "year", "sat", ["s0", "s1", "s2", "s3"], F.count_distinct("id"))


@query(
    "q23_eight_band_start",
    f"""select hex_id, max(month) as month from (select grid_id, min(month) as month from (select r.grid_id, r.month from r join b using (grid_id) where r.month between coalesce(f8, date '2002-01-01') and coalesce(l4, l) group by r.grid_id, r.month having count_if(has_8_channel) > 0.5 * count(*)) group by grid_id) right join dims using (grid_id) where hex_id >= 0 group by hex_id""",
    SAMPLES, GRIDS,
    f"r as (select grid_id, cast(date_trunc('month', acquired) as date) as month, has_8_channel from samples where {BASE} and {OK} and clear_percent is not null and acquired < timestamp '2001-12-01'), b as (select grid_id, min(case when has_8_channel then month end) as f8, max(case when not has_8_channel then month end) as l4, max(month) as l from r group by grid_id)",
)
def q23(spark, d):
    return A.eight_band_start(samples(spark, d), grids(spark, d), "2001-12-01", F.lit("2002-01-01").cast("date"))


@query(
    "q24_tide_coverage",
    "select hex_id, " + ", ".join(f"round({how}({c}), 6) as {how}_{c}" for c in ("coverage", "high_offset", "low_offset") for how in ("min", "max", "median")) + f" from (select hex_id, (hi - lo) / tide_range as coverage, tide_max - hi as high_offset, lo - tide_min as low_offset from dims left join (select grid_id, min(tide_height) as lo, max(tide_height) as hi from samples where {BASE} and {VALID} 75 and acquired >= timestamp '1998-01-01' and acquired < timestamp '1999-01-01' group by grid_id) using (grid_id)) where hex_id >= 0 group by hex_id",
    SAMPLES, GRIDS,
)
def q24(spark, d):
    out = A.tide_coverage(samples(spark, d), grids(spark, d), 1998)
    return _rounded(out, *[c for c in out.columns if c != "hex_id"])


@query("q25_mid_tide_gaps", HEXGAP.format(p=0.5), SAMPLES, GRIDS, _gaps(f"{BASE} and abs(tide_height) < 0.5 and solar_time {Y}"))
def q25(spark, d):
    return A.hex_gaps(samples(spark, d), grids(spark, d), 1998, 50, False, extra=tides.is_mid_tide(F.col("tide_height"), 0.5)).withColumn("median_gap", r6("median_gap"))


@query("q26_flagged_records", f"select id, grid_id, acquired, round(tide_height, 6) as tide_height, (grid_id, acquired) in (select (grid_id, acquired) from samples where {BASE} and grid_id in (3, 17, 42)) as passes from samples where grid_id in (3, 17, 42)", SAMPLES)
def q26(spark, d):
    return A.flagged_records(samples(spark, d), [3, 17, 42], base()).select("id", "grid_id", "acquired", r6("tide_height").alias("tide_height"), "passes")


@query("q27_daily_satellites_by_hex", "select hex_id, cast(coalesce(n, 0) as bigint) as sample_count from (select distinct hex_id from dims where hex_id >= 0) left join (select hex_id, sum(k) as n from (select hex_id, cast(acquired as date) as day, count(distinct satellite_id) as k from samples where item_type = 'PSScene' and clear_percent > 75 and acquired >= timestamp '1998-01-01' group by all) group by hex_id) using (hex_id)", SAMPLES, GRIDS)
def q27(spark, d):
    hexes = grids(spark, d).where("hex_id >= 0").select("hex_id").distinct()
    return A.daily_satellites_by_hex(samples(spark, d), hexes, "1998-01-01")


COUNTED = f"k as (select dims.grid_id, dist_km, coalesce(n, 0) as n from dims left join (select grid_id, count(*) as n from samples where {BASE} and {VALID} 75 and acquired > timestamp '1995-06-01' and acquired < timestamp '2001-06-01' group by grid_id) as c using (grid_id))"


@query("q28_by_distance", "select b.bin::int as bin, round(quantile_cont(n, 0.25), 6) as q25, round(median(n), 6) as median, round(quantile_cont(n, 0.75), 6) as q75, count(n) as n, b.bin + 0.5::double as centre_km from (select unnest(range(60)) as bin) as b left join k on k.dist_km > b.bin and k.dist_km <= b.bin + 1 group by b.bin", SAMPLES, GRIDS, COUNTED)
def q28(spark, d):
    return _rounded(A.by_distance(samples(spark, d), grids(spark, d), "1995-06-01", "2001-06-01"), "q25", "median", "q75")


@query("q28b_distance_share", "select dist_km, cast(sum(n) as bigint) as sample_count, round(100.0::double * sum(sum(n)) over (order by dist_km) / sum(sum(n)) over (), 6) as cum_pct from k group by dist_km", SAMPLES, GRIDS, COUNTED)
def q28b(spark, d):
    return _rounded(A.distance_share(samples(spark, d), grids(spark, d), "1995-06-01", "2001-06-01"), "cum_pct")


FLAGS = ("has_sr_asset", "ground_control", "has_8_channel")


@query("q29_missing_by_year", "select cast(date_trunc('year', acquired) as date) as year, item_type, " + ", ".join(f"count(*) filter (where not {c}) as count_{c}" for c in FLAGS) + " from samples group by 1, 2", SAMPLES)
def q29(spark, d):
    return A.missing_by_year(samples(spark, d), FLAGS)


PAIRED = """dv as (select event_id as id, user_id, cast(ts as timestamp) as acquired from events where event_type = 'view'), sk as (select event_id as id_s, user_id, cast(ts as timestamp) as acquired_s from events where event_type = 'purchase'),
  pairs as (select dv.id, id_s, dv.user_id, acquired, acquired_s from dv join sk on dv.user_id = sk.user_id and abs(epoch(acquired) - epoch(acquired_s)) <= 21600)"""


def _doves(spark, d):
    e = read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    return e.where("event_type = 'view'").select(F.col("event_id").alias("id"), "user_id", F.col("ts").alias("acquired")), e.where("event_type = 'purchase'").select(F.col("event_id").alias("id_s"), "user_id", F.col("ts").alias("acquired_s"))


@query("q30_pairs_by_cell", "select user_id % 50 as grid_id, count(*) as pairs, count(distinct (id, id_s)) as distinct_pairs, count(distinct id) as doves from pairs group by 1", PAIRED)
def q30(spark, d):
    p = A.pair_band(*_doves(spark, d), ["user_id"], 6)
    return p.groupBy((F.col("user_id") % 50).alias("grid_id")).agg(F.count("*").alias("pairs"), F.count_distinct(F.struct("id", "id_s")).alias("distinct_pairs"), F.count_distinct("id").alias("doves"))


@query("q30b_pairs_by_month", "select cast(date_trunc('month', acquired) as date) as month, count(distinct id) as doves from pairs group by 1", PAIRED)
def q30b(spark, d):
    p = A.pair_band(*_doves(spark, d), ["user_id"], 6)
    return p.groupBy(timeparts.month_start("acquired").alias("month")).agg(F.count_distinct("id").alias("doves"))


@query("q31_shore_counts", f"select grid_id, hex_id, dist_km, coalesce(n, 0) as sample_count from dims left join (select grid_id, count(*) as n from samples where {BASE} and {VALID} 75 and acquired >= timestamp '1998-01-01' and acquired < timestamp '1999-01-01' group by grid_id) using (grid_id) where (dist_km < 3 or is_coast) and tide_range is not null", SAMPLES, GRIDS)
def q31(spark, d):
    return A.shore_counts(samples(spark, d), grids(spark, d), 1998)


@query("q32_daily_by_stage", "select cast(acquired as date) as day, count(distinct case when publishing_stage = 'preview' then id end) as preview, count(distinct case when publishing_stage = 'finalized' then id end) as finalized, count(distinct case when publishing_stage = 'standard' then id end) as standard from samples group by 1", SAMPLES)
def q32(spark, d):
    rows = samples(spark, d).select("id", timeparts.day("acquired").alias("day"), "publishing_stage")
    return rollup.cross_tab(rows, "day", "publishing_stage", ["preview", "finalized", "standard"], F.count_distinct("id"))


@query("q32b_monthly_distinct", "select cast(date_trunc('month', acquired) as date) as month, count(distinct id) as n from samples group by 1", SAMPLES)
def q32b(spark, d):
    return samples(spark, d).groupBy(timeparts.month_start("acquired").alias("month")).agg(F.count_distinct("id").alias("n"))


@query("q33_clear_histogram", _hist("samples", "clear_percent", [20.0 * k for k in range(1, 6)]), SAMPLES)
def q33(spark, d):
    return A.numeric_histogram(samples(spark, d), "clear_percent", 5)


@query("q33b_extremes", "select min(clear_percent) as low, max(clear_percent) as high, count(*) as n_rows from samples", SAMPLES)
def q33b(spark, d):
    return samples(spark, d).agg(F.min("clear_percent").alias("low"), F.max("clear_percent").alias("high"), F.count("*").alias("n_rows"))


@query("q34_share_true", "select grid_id, round(avg(case when has_8_channel then 1.0::double else 0 end), 6) as share from samples group by grid_id", SAMPLES)
def q34(spark, d):
    return _rounded(A.shares_true(samples(spark, d), "has_8_channel"), "share")


AUDITED = ("id", "acquired", "grid_id", "instrument", "coverage_pct", "tide_height")


@query("q35_null_audit", "select count(*) as n_rows, " + ", ".join(f"count_if({c} is null) as {c}" for c in AUDITED) + " from samples", SAMPLES)
def q35(spark, d):
    return A.audit(samples(spark, d), list(AUDITED))


@query("q35b_domains", "select distinct item_type, instrument, quality_category, publishing_stage from samples", SAMPLES)
def q35b(spark, d):
    return samples(spark, d).select("item_type", "instrument", "quality_category", "publishing_stage").distinct()


@query(
    "q36_pair_asof",
    """select id, user_id, id_s, round(abs(epoch(acquired) - epoch(acquired_s)), 3) as delta_sec from
  (select dv.id, dv.user_id, dv.acquired, sk.id_s, sk.acquired_s from dv asof join sk on dv.user_id = sk.user_id and dv.acquired >= sk.acquired_s union select dv.id, dv.user_id, dv.acquired, sk.id_s, sk.acquired_s from dv asof join sk on dv.user_id = sk.user_id and dv.acquired <= sk.acquired_s)
  where abs(epoch(acquired) - epoch(acquired_s)) <= 172800 and least(abs(s1(acquired) - s1(acquired_s)), 86400 - abs(s1(acquired) - s1(acquired_s))) < 7200""".replace("s1(acquired_s)", "(hour(acquired_s) * 3600 + minute(acquired_s) * 60 + second(acquired_s))").replace("s1(acquired)", "(hour(acquired) * 3600 + minute(acquired) * 60 + second(acquired))"),
    PAIRED,
)
def q36(spark, d):
    p = A.pair_asof(*_doves(spark, d), ["user_id"], 172800.0, 2.0)
    return p.select("id", "user_id", "id_s", F.round(F.abs(timeparts.epoch("acquired") - timeparts.epoch("acquired_s")), 3).alias("delta_sec"))


@query("q37_pair_band", "select id, id_s, user_id, round((epoch(acquired_s) - epoch(acquired)) / 3600, 6) as acquired_delta_hours from pairs", PAIRED)
def q37(spark, d):
    p = A.pair_band(*_doves(spark, d), ["user_id"], 6)
    return p.select("id", "id_s", "user_id", r6((timeparts.epoch("acquired_s") - timeparts.epoch("acquired")) / 3600).alias("acquired_delta_hours"))


@query(
    "q38_best_captures",
    """select grid_id, id from (select *, row_number() over (partition by grid_id, s order by case when publishing_stage = 'finalized' then 0 else 2 end, clear_percent desc, id) as r from
  (select *, sum(new) over (partition by grid_id order by acquired rows unbounded preceding) as s from (select *, case when epoch(acquired) - lag(epoch(acquired)) over (partition by grid_id order by acquired) <= 14400 then 0 else 1 end as new from captures))) where r = 1""",
    CAPTURES,
)
def q38(spark, d):
    return C.best_captures(captures(spark, d), ["grid_id"], 4).select("grid_id", "id")


@query("q39_coastal_enrichment", "select id, grid_id, round(w * h, 6) as coverage_pct, (bx + 0.5 between greatest(x0, bx) and least(x1, bx + 1)) and (gy0 + 0.5 between greatest(y0, gy0) and least(y1, gy0 + 1)) as intersects_centroid from (select l.*, feet.x0, feet.x1, feet.y0, feet.y1, (grid_id % 20)::double as bx, floor(grid_id / 20)::double as gy0 from laps as l join feet using (id))", GRIDS, FOOTPRINTS)
def q39(spark, d):
    return _rounded(A.enrich(footprints(spark, d), cell_boxes(spark, d), "id", "grid_id", True), "coverage_pct")


@query("q40_hex_enrichment", "select id, grid_id, round(w * h / own, 6) as coverage_pct from laps", GRIDS, FOOTPRINTS)
def q40(spark, d):
    return _rounded(A.enrich(footprints(spark, d), cell_boxes(spark, d), "id", "grid_id", False), "coverage_pct").drop("intersects_centroid")


@query("q40b_overlap_filter", "select id, grid_id from laps where round(w * h / own, 9) > 0.25", GRIDS, FOOTPRINTS)
def q40b(spark, d):
    return A.enrich(footprints(spark, d), cell_boxes(spark, d), "id", "grid_id", False).where("round(coverage_pct, 9) > 0.25").select("id", "grid_id")


def _series(spark, d):
    """Two constituents per cell, ten days of minutes."""
    cells = read(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("cell_id"))
    rows = tides.minutes(cells, "2024-01-01", "2024-01-11")
    t = timeparts.epoch("acquired") / 3600 - F.lit(473352.0)
    h = (1 + F.col("cell_id") / 4) * F.cos(F.radians(28.984104 * t)) + 0.5 * F.cos(F.radians(30.0 * t - 40))
    return rows.select("cell_id", "acquired", F.col("acquired").alias("solar_time"), h.alias("tide_height"))


SERIES = "series as (select r_regionkey as cell_id, a as acquired, (1 + r_regionkey::double / 4) * cos(radians(28.984104::double * (epoch(a) / 3600 - 473352))) + 0.5::double * cos(radians(30.0::double * (epoch(a) / 3600 - 473352) - 40)) as tide_height from region, (select unnest(range(timestamp '2024-01-01', timestamp '2024-01-11', interval 1 minute)) as a))"


@query("q41_tide_heuristics", "select cell_id, round(min(tide_height), 5) as tide_min, round(max(tide_height), 5) as tide_max, round(avg(tide_height), 5) as tide_mean, round(stddev_samp(tide_height), 5) as tide_std, round(median(tide_height), 5) as tide_median, round(quantile_cont(tide_height, 0.95), 5) as tide_p95, round(quantile_cont(tide_height, 0.75) - quantile_cont(tide_height, 0.25), 5) as tide_iqr, round(max(tide_height) - min(tide_height), 5) as tide_range, round(quantile_cont(tide_height, 0) - 0.000001, 5) as height_edge_0, round(quantile_cont(tide_height, 0.3), 5) as height_edge_3, round(quantile_cont(tide_height, 1) + 0.000001, 5) as height_edge_10 from series group by cell_id", SERIES)
def q41(spark, d):
    out = tides.heuristics(_series(spark, d), "cell_id")
    names = ("tide_min", "tide_max", "tide_mean", "tide_std", "tide_median", "tide_p95", "tide_iqr", "tide_range", "height_edge_0", "height_edge_3", "height_edge_10")
    return out.select("cell_id", *[F.round(n, 5).alias(n) for n in names])


@query("q41b_overpasses", "select cell_id, acquired, round(tide_height, 5) as tide_height from series where (hour(acquired), minute(acquired)) = (10, 30) and cast(acquired as date) in (date '2024-01-01', date '2024-01-06')", SERIES)
def q41b(spark, d):
    return tides.overpass_samples(_series(spark, d), "cell_id", "solar_time", *tides.OVERPASSES["sentinel"]).select("cell_id", "acquired", F.round("tide_height", 5).alias("tide_height"))


@query("q41c_tide_simulation")
def q41c(spark, d):
    """All constellations' statistics, tested against numpy."""
    return tides.simulate(_series(spark, d), "cell_id", "solar_time", 0.25, 10.0)[1]


@query("q42_assignment", "select id, coalesce((select arg_max(grid_id, (round(w * h, 9), -grid_id)) from laps where laps.id = feet.id), -1) as grid_id from feet", GRIDS, FOOTPRINTS)
def q42(spark, d):
    return joins.assign(footprints(spark, d), cell_boxes(spark, d), "id", "grid_id", closest=False)


SIM = "sim as (select hex_id, case when grid_id % 9 > 0 then (grid_id * 13 % 150)::double end as gap from dims)"


@query("q43_simulated_summary", "select hex_id, round(median(gap), 6) as median_gap, max(gap) as max_gap, round(100 * avg(case when gap > 100 then 1.0::double else 0 end), 6) as pct_over_100, round(100 * avg(case when gap is null then 1.0::double else 0 end), 6) as pct_none from sim where hex_id >= 0 group by hex_id", GRIDS, SIM)
def q43(spark, d):
    i = F.col("grid_id")
    sim = grids(spark, d).select("hex_id", F.when(i % 9 > 0, (i * 13 % 150).cast("double")).alias("gap"), F.coalesce(i * 13 % 150 > 100, F.lit(False)).alias("x"))
    sim = sim.withColumn("over", F.when(F.col("gap") > 100, 100.0).otherwise(0.0)).withColumn("none", F.when(F.col("gap").isNull(), 100.0).otherwise(0.0))
    return _rounded(rollup.to_hex(sim, {"median_gap": ("gap", "median"), "max_gap": ("gap", "max"), "pct_over_100": ("over", "mean"), "pct_none": ("none", "mean")}), "median_gap", "pct_over_100", "pct_none")


@query("q44_cells_per_hex", "select hex_id, count(*) as n from dims group by hex_id", GRIDS)
def q44(spark, d):
    return grids(spark, d).groupBy("hex_id").agg(F.count("*").alias("n"))


@query("q45_best_overlap", "select id, grid_id, round(o, 6) as overlap_area from (select id, grid_id, round(w * h, 9) as o, row_number() over (partition by id order by round(w * h, 9) desc, grid_id) as r from laps) where r = 1", GRIDS, FOOTPRINTS)
def q45(spark, d):
    shared = joins.overlay(footprints(spark, d), cell_boxes(spark, d), "id", "grid_id").withColumn("overlap_area", F.round("overlap_area", 9))
    return A.best_overlap(shared, "id", "overlap_area", "grid_id").select("id", "grid_id", r6("overlap_area").alias("overlap_area"))


@query("q45b_close_pairs", "select user_id, count(*) as n from pairs where abs(epoch(acquired) - epoch(acquired_s)) < 600 group by user_id", PAIRED)
def q45b(spark, d):
    p = A.pair_band(*_doves(spark, d), ["user_id"], 6)
    return p.where(F.abs(timeparts.epoch("acquired") - timeparts.epoch("acquired_s")) < 600).groupBy("user_id").agg(F.count("*").alias("n"))


@query("q46_daily_high_tides", "select cell_id, hour(acquired)::int as hour, count(*) as n from (select *, row_number() over (partition by cell_id, cast(acquired as date) order by tide_height desc, acquired) as r from (select cell_id, acquired, round(tide_height, 7) as tide_height from series)) where r = 1 group by 1, 2", SERIES)
def q46(spark, d):
    s = _series(spark, d).withColumn("tide_height", F.round("tide_height", 7))
    best = s.groupBy("cell_id", timeparts.day("acquired").alias("day")).agg(F.min_by("acquired", F.struct(-F.col("tide_height"), "acquired")).alias("at"))
    return best.groupBy("cell_id", F.hour("at").alias("hour")).agg(F.count("*").alias("n"))


@query("q47_colour_bins", "select low, high, round(low + (high - low) * 3 / 7, 6) as edge_3 from (select min(tide_height) as low, max(tide_height) as high from samples)", SAMPLES)
def q47(spark, d):
    return A.colour_bins(samples(spark, d), "tide_height").select("low", "high", r6(F.get("edges", F.lit(3))).alias("edge_3"))


# -- operators that no named analysis shows alone -------------------------------------------------------------------------
@query("op_hex_path", "select distinct grid_id, substr(lower(printf('%06X', grid_id)), 1, 2) as d1, substr(lower(printf('%06X', grid_id)), 3, 2) as d2, substr(lower(printf('%06X', grid_id)), 5, 2) as d3 from dims", GRIDS)
def op_hex_path(spark, d):
    return grids(spark, d).select("grid_id", *hex_path(F.col("grid_id")))


@query("op_sessions", "select grid_id, max(s) as sessions from (select grid_id, sum(new) over (partition by grid_id order by acquired rows unbounded preceding) as s from (select grid_id, acquired, case when epoch(acquired) - lag(epoch(acquired)) over (partition by grid_id order by acquired) <= 14400 then 0 else 1 end as new from captures)) group by grid_id", CAPTURES)
def op_sessions(spark, d):
    return C.sessions(captures(spark, d), ["grid_id"], "acquired", 4).groupBy("grid_id").agg(F.max("session").alias("sessions"))


@query("op_stride", "select cell_id, acquired from (select *, row_number() over (partition by cell_id order by acquired) as r from series) where (r - 1) % 720 = 0", SERIES)
def op_stride(spark, d):
    return rollup.every_kth(_series(spark, d), ["cell_id"], "acquired", 720).select("cell_id", "acquired")


@query("op_circular_gaps", "select grid_id, day, coalesce(lead(day) over (partition by grid_id order by day), first(day) over (partition by grid_id order by day) + 366) - day as gap from (select distinct grid_id, dayofyear(acquired)::bigint as day from samples where clear_percent > 90)", SAMPLES)
def op_circular(spark, d):
    days = samples(spark, d).where("clear_percent > 90").select("grid_id", F.dayofyear("acquired").cast("long").alias("day")).distinct()
    return rollup.circular_gaps(days, ["grid_id"], "day", 366)


@query("op_left_index", "select id, case when grid_id % 9 = 0 then -1 else cast(tide_height >= -1.5 as int) + cast(tide_height >= -0.5 as int) + cast(tide_height >= 0.5 as int) + cast(tide_height >= 1.5 as int) - 1 end as tide_height_bin from samples", SAMPLES)
def op_left_index(spark, d):
    edges = F.when(F.col("grid_id") % 9 != 0, F.array(*[F.lit(e) for e in (-1.5, -0.5, 0.5, 1.5)]))
    return samples(spark, d).select("id", bins.left_index(F.col("tide_height"), edges).alias("tide_height_bin"))


@query("op_nearest_cell", "select id, arg_min(grid_id, (round(sqrt((cx - gx) ** 2 + (cy - gy) ** 2), 9), grid_id)) as grid_id, round(min(sqrt((cx - gx) ** 2 + (cy - gy) ** 2)), 6) as dist from (select id, (x0 + x1) / 2 as cx, (y0 + y1) / 2 as cy from feet), (select grid_id, bx + 0.5 as gx, gy0 + 0.5 as gy from boxes) where sqrt((cx - gx) ** 2 + (cy - gy) ** 2) <= 1.5 group by id", GRIDS, FOOTPRINTS)
def op_nearest(spark, d):
    middle = lambda df, k: df.select(k, F.round(geometry.centroid("ring")["x"], 9).alias("x"), F.round(geometry.centroid("ring")["y"], 9).alias("y"))
    return joins.nearest(middle(footprints(spark, d), "id"), middle(cell_boxes(spark, d), "grid_id"), "id", "grid_id", 1.5).withColumn("dist", r6("dist"))


@query("op_points_in_cells", "select id, grid_id from (select id, (x0 + x1) / 2 as cx, (y0 + y1) / 2 as cy from feet) join boxes on cx between bx and bx + 1 and cy between gy0 and gy0 + 1", GRIDS, FOOTPRINTS)
def op_points(spark, d):
    pts = footprints(spark, d).select("id", geometry.bounds("ring").alias("b")).select("id", ((F.col("b.x0") + F.col("b.x1")) / 2).alias("x"), ((F.col("b.y0") + F.col("b.y1")) / 2).alias("y"))
    return joins.points_in(pts, cell_boxes(spark, d), "id", "grid_id")


@query("op_near_shore_filter", "select grid_id from dims where not is_land and dist_km < 20", GRIDS)
def op_near_shore(spark, d):
    return grids(spark, d).where(near_shore(20)).select("grid_id")


@query("op_solar_seconds", "select id, hour(solar_time) * 3600 + minute(solar_time) * 60 + second(solar_time) as s, strftime(solar_time, '%Y-%m-%dT%H:%M:%S') as iso from samples", SAMPLES)
def op_solar_seconds(spark, d):
    return samples(spark, d).select("id", timeparts.seconds_of_day("solar_time").cast("long").alias("s"), F.substring(timeparts.iso_utc("solar_time"), 1, 19).alias("iso"))


@query("op_valid_variants", f"select grid_id, count_if({VALID} 75) as strict, count_if({OK} and has_sr_asset and clear_percent >= 50) as inclusive, count_if({OK} and clear_percent > 75) as without_sr from samples group by grid_id", SAMPLES)
def op_valid(spark, d):
    return samples(spark, d).groupBy("grid_id").agg(F.count_if(valid()).alias("strict"), F.count_if(valid(50.0, at_least=True)).alias("inclusive"), F.count_if(valid(sr=False)).alias("without_sr"))


@query(
    "q14c_multi_year_median",
    "select grid_id, round(median(case when k >= 2 then x end), 6) as median_gap from (select grid_id, y, quantile_cont(gap, 0.9) as x, count(*) - 1 as k from g where gap is not null group by all) group by grid_id",
    SAMPLES,
    f"""d as (select distinct grid_id, y.y, cast(solar_time as date) as t from samples, (select unnest(range(1996, 2000)) as y) as y where {BASE} and solar_time between make_timestamp(y.y, 1, 1, 0, 0, 0) and make_timestamp(y.y + 1, 1, 1, 0, 0, 0)),
  m as (select * from d union all select distinct grid_id, y, make_date(y::bigint + e, 1, 1) from d, (values (0), (1)) as e(e)), g as (select grid_id, y, cast(t - lag(t) over (partition by grid_id, y order by t) as double) as gap from m)""",
)
def q14c(spark, d):
    return _rounded(A.multi_year_median(samples(spark, d), 1996, 1999, 90, False), "median_gap")


@query("q14d_gap_cdf", "select upper, n, round(100.0::double * sum(n) over (order by upper) / sum(n) over (), 6) as cum_pct from (" + _hist("g", "gap", EDGES) + ")", SAMPLES, _gaps(f"{BASE} and {VALID} 25 and solar_time {Y}"))
def q14d(spark, d):
    return _rounded(A.cumulative(q02(spark, d)), "cum_pct")


@query("op_hourly_counts", "select grid_id, date_trunc('hour', acquired) as hour, count(*) as n from captures group by all", CAPTURES)
def op_hourly(spark, d):
    return captures(spark, d).groupBy("grid_id", F.window("acquired", "1 hour").alias("w")).agg(F.count("*").alias("n")).select("grid_id", F.col("w.start").cast("timestamp_ntz").alias("hour"), "n")


@query("op_scaled_by_bounds", "select id, round((clear_percent - low) / (high - low), 6) as scaled from samples, (select min(clear_percent) as low, max(clear_percent) as high from samples)", SAMPLES)
def op_scaled(spark, d):
    s = samples(spark, d)
    b = s.agg(F.min("clear_percent").alias("low"), F.max("clear_percent").alias("high"))
    return s.crossJoin(F.broadcast(b)).select("id", r6(F.try_divide(F.col("clear_percent") - F.col("low"), F.col("high") - F.col("low"))).alias("scaled"))


@query("op_ocean_mask", "select grid_id from dims where grid_id not in (select grid_id from dims where is_land) or grid_id in (select grid_id from dims where is_coast)", GRIDS)
def op_mask(spark, d):
    from ..operators.grids import ocean_mask

    g = grids(spark, d)
    return ocean_mask(g, g.where("is_land"), g.where("is_coast"), "grid_id").select("grid_id")


@query("op_stage_then_clear_order", "select grid_id, id from (select *, row_number() over (partition by grid_id order by clear_percent desc, id) as r from captures) where r = 1", CAPTURES)
def op_top(spark, d):
    return rollup.best_first(captures(spark, d), ["grid_id"], [F.col("clear_percent").desc()], "id").select("grid_id", "id")


@query("q37b_pair_overlap", "select id, id_s, round(least(id % 7 + 2, id_s % 5 + 1.5::double) - greatest(id % 7, id_s % 5), 6) as overlap_area from pairs where least(id % 7 + 2, id_s % 5 + 1.5::double) > greatest(id % 7, id_s % 5)", PAIRED)
def q37b(spark, d):
    one, x, y = F.lit(1), F.col("id") % 7, F.col("id_s") % 5
    p = A.pair_band(*_doves(spark, d), ["user_id"], 6).withColumns({"a": geometry.box(x, one - 1, x + 2, one), "b": geometry.box(y, one - 1, y + 1.5, one)})
    return A.pair_overlapping(p, "a", "b").select("id", "id_s", r6("overlap_area").alias("overlap_area"))


def _scenes(spark, d):
    """Footprints with the time at which they were taken."""
    at = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), (F.abs(F.split("id", "-")[0].cast("long")) % 500000).cast("int"))
    return footprints(spark, d).withColumn("acquired", at)


_H = "(epoch(acquired) / 3600.0::double)"
_EOT = "229.18::double * (0.000075::double + 0.001868::double * cos(b) - 0.032077::double * sin(b) - 0.014615::double * cos(2 * b) - 0.040849::double * sin(2 * b))"
_B = "2 * 3.141592653589793::double * (dayofyear({0}) - 1 + (hour({0}) - 12) / 24.0::double) / 365"


@query(
    "q39c_full_enrichment",
    f"""select id, grid_id, acquired, coverage_pct, intersects_centroid, round(tide_height, 5) as tide_height, coalesce(abs(tide_height) < 0.5, false) as is_mid_tide, tide_height is not null as has_tide_data,
  round(({_EOT} / 60 + (grid_id % 20 + 0.5::double) / 15) * 3600, 2) as solar_offset from (select *, case when grid_id % 5 <> 0 then (1 + (grid_id % 4)::double / 4) * cos(radians(28.984104::double * {_H} - 10)) + 0.5::double * cos(radians(30.0::double * {_H} - 40)) end as tide_height, {_B.format('acquired')} as b
  from (select id, grid_id, timestamp '2024-01-01' + to_minutes(split_part(id, '-', 1)::bigint % 500000) as acquired, round(w * h, 6) as coverage_pct, (bx + 0.5 between greatest(x0, bx) and least(x1, bx + 1)) and (gy0 + 0.5 between greatest(y0, gy0) and least(y1, gy0 + 1)) as intersects_centroid
  from (select l.*, feet.x0, feet.x1, feet.y0, feet.y1, (grid_id % 20)::double as bx, floor(grid_id / 20)::double as gy0 from laps as l join feet using (id))))""",
    GRIDS, FOOTPRINTS,
)
def q39c(spark, d):
    own = grids(spark, d).where("grid_id % 5 <> 0")
    nodes = own.select("grid_id", (1 + F.col("grid_id") % 4 / 4).alias("amp"), F.lit(28.984104).alias("speed"), F.lit(10.0).alias("phase")).union(own.select("grid_id", F.lit(0.5), F.lit(30.0), F.lit(40.0)))
    out = A.enrich_fully(_scenes(spark, d), cell_boxes(spark, d), nodes, "id", "grid_id", 0.5)
    return out.select("id", "grid_id", "acquired", r6("coverage_pct").alias("coverage_pct"), "intersects_centroid", F.round("tide_height", 5).alias("tide_height"), "is_mid_tide", "has_tide_data", F.round(timeparts.epoch("solar_time") - timeparts.epoch("acquired"), 2).alias("solar_offset"))


@query("q41d_observed_tides", "select cell_id, round(min(h), 4) as low, round(max(h), 4) as high, round((max(h) - min(h)) / any_value(tmax - tmin), 4) as spread, round(min(h) - any_value(tmin), 4) as low_offset from (select cell_id, tide_height as h from series where (hour(acquired), minute(acquired)) = (10, 30) and cast(acquired as date) in (date '2024-01-01', date '2024-01-06')) join (select cell_id, min(tide_height) as tmin, max(tide_height) as tmax from series group by cell_id) using (cell_id) group by cell_id", SERIES)
def q41d(spark, d):
    names = {"sentinel_min_observed_height": "low", "sentinel_max_observed_height": "high", "sentinel_observed_spread": "spread", "sentinel_observed_low_tide_offset": "low_offset"}
    return tides.simulate(_series(spark, d), "cell_id", "solar_time", 0.25, 10.0)[1].select("cell_id", *[F.round(c, 4).alias(n) for c, n in names.items()])


@query("op_assign_nearest", "select id, coalesce((select arg_max(grid_id, (round(w * h, 9), -grid_id)) from laps where laps.id = feet.id and grid_id % 7 = 0), (select arg_min(grid_id, (round(sqrt(greatest(0, bx - x1, x0 - bx - 1) ** 2 + greatest(0, gy0 - y1, y0 - gy0 - 1) ** 2), 9), grid_id)) from boxes where grid_id % 7 = 0)) as grid_id from feet", GRIDS, FOOTPRINTS)
def op_assign(spark, d):
    return joins.assign(footprints(spark, d), cell_boxes(spark, d).where("grid_id % 7 = 0"), "id", "grid_id")


@query("op_nearest_areas", "select a.grid_id, b.grid_id as near_id, round(e, 6) as dist from (select a.grid_id, b.grid_id as near, round(sqrt(greatest(0, b.bx - a.bx - 1, a.bx - b.bx - 1) ** 2 + greatest(0, b.gy0 - a.gy0 - 1, a.gy0 - b.gy0 - 1) ** 2), 9) as e, min(e) over (partition by a.grid_id) as least from boxes as a, boxes as b where a.grid_id % 11 = 0 and b.grid_id % 23 = 3) as x, (select grid_id from boxes) as a, (select grid_id from boxes) as b where a.grid_id = x.grid_id and b.grid_id = near and e = least", GRIDS, FOOTPRINTS)
def op_nearest_areas(spark, d):
    cells = cell_boxes(spark, d)
    right = cells.where("grid_id % 23 = 3").select(F.col("grid_id").alias("near_id"), "ring")
    return joins.nearest_area(cells.where("grid_id % 11 = 0"), right, "grid_id", "near_id", 1.0, ties=True).withColumn("dist", r6("dist"))


@query("op_first_cell", "select id, min(grid_id) as grid_id from laps group by id", GRIDS, FOOTPRINTS)
def op_first(spark, d):
    return joins.first_only(joins.overlay(footprints(spark, d), cell_boxes(spark, d), "id", "grid_id").select("id", "grid_id"), "id", "grid_id")


@query("op_remaining", "select grid_id from dims where grid_id not in (select grid_id from captures)", GRIDS, CAPTURES)
def op_remaining(spark, d):
    from ..sources.sinks import remaining

    return remaining(grids(spark, d).select("grid_id"), captures(spark, d), ["grid_id"])


@query("op_intersects", "select feet.id, grid_id from feet left join (select * from boxes where grid_id % 3 = 0) as b on greatest(x0, bx) <= least(x1, bx + 1) and greatest(y0, gy0) <= least(y1, gy0 + 1)", GRIDS, FOOTPRINTS)
def op_intersects(spark, d):
    return joins.intersects(footprints(spark, d), cell_boxes(spark, d).where("grid_id % 3 = 0"), "id", "grid_id", keep_left=True)


def _middles(spark, d):
    b = geometry.bounds("ring")
    return footprints(spark, d).select("id", ((b["x0"] + b["x1"]) / 2).alias("x"), ((b["y0"] + b["y1"]) / 2).alias("y"))


@query("op_within_layers", "select distinct id from feet, boxes join dims using (grid_id) where (is_land or is_coast or grid_id % 13 = 0) and (x0 + x1) / 2 between bx and bx + 1 and (y0 + y1) / 2 between gy0 and gy0 + 1", GRIDS, FOOTPRINTS)
def op_within_layers(spark, d):
    cells = cell_boxes(spark, d).join(grids(spark, d).select("grid_id", "is_land", "is_coast"), "grid_id")
    return joins.within_any(_middles(spark, d), [cells.where("is_land"), cells.where("is_coast"), cells.where("grid_id % 13 = 0")], "id", "grid_id")


@query("op_outside", "select id from feet where not ((x0 + x1) / 2 between 2 and 10 and (y0 + y1) / 2 between 1 and 5)", GRIDS, FOOTPRINTS)
def op_outside(spark, d):
    return joins.outside(_middles(spark, d), [(2, 1), (10, 1), (10, 5), (2, 5)]).select("id")


@query("op_coast_distance", "select grid_id, round(min(sqrt((bx + 0.5 - px) ** 2 + (gy0 + 0.5 - py) ** 2)), 6) as dist from boxes, (select bx + k / 4.0::double as px, gy0 + s as py from coast, (values (0), (1)) as s(s) union all select bx + s, gy0 + k / 4.0::double from coast, (values (0), (1)) as s(s)) where sqrt((bx + 0.5 - px) ** 2 + (gy0 + 0.5 - py) ** 2) <= 1.5 group by grid_id", GRIDS, FOOTPRINTS, "coast as (select bx, gy0, k from boxes join dims using (grid_id), (select unnest(range(0, 5)) as k) where is_coast)")
def op_coast_distance(spark, d):
    cells = cell_boxes(spark, d)
    points = cells.select("grid_id", geometry.centroid("ring").alias("c")).select("grid_id", F.round("c.x", 9).alias("x"), F.round("c.y", 9).alias("y"))
    coast = cells.join(grids(spark, d).where("is_coast").select("grid_id"), "grid_id", "left_semi")
    return joins.distance_to_lines(points, coast, "grid_id", 0.25, 1.5).withColumn("dist", r6("dist"))


@query("op_lat_band", "select grid_id from dims where dist_km between 10 and 30", GRIDS)
def op_lat_band(spark, d):
    from ..functions.predicates import lat_band

    return grids(spark, d).where(lat_band("dist_km", 10.0, 30.0)).select("grid_id")


@query("op_coastal_flags", """select grid_id, case when near is null and not land and not at_zero then null when land or at_zero then 0.0 else least(near, 50.0) end as dist_km, land as is_land, coastal and not land as is_coast from
  (select *, coalesce(is_land or (is_coast and near > 4), is_land) as land, is_coast as coastal from (select grid_id, is_land, is_coast, grid_id % 17 = 0 as at_zero, least(case when grid_id % 13 <> 0 then dist_km end, case when grid_id % 7 <> 0 then (grid_id * 3 % 50)::double end) as near from dims))""", GRIDS)
def op_coastal_flags(spark, d):
    from ..operators.grids import coastal_flags

    i = F.col("grid_id")
    cells = grids(spark, d).select("grid_id", F.when(i % 13 != 0, F.col("dist_km")).alias("line_km"), F.when(i % 7 != 0, (i * 3 % 50).cast("double")).alias("island_km"), F.col("is_land").alias("on_land"), F.col("is_coast").alias("coastal"), (i % 17 == 0).alias("at_zero"))
    return coastal_flags(cells).select("grid_id", "dist_km", "is_land", "is_coast")


@query("op_equation_of_time", f"select id, round({_EOT}, 6) as minutes from (select id, {_B.format('acquired')} as b from captures)", CAPTURES)
def op_equation_of_time(spark, d):
    return captures(spark, d).select("id", r6(timeparts.equation_of_time("acquired")).alias("minutes"))


@query("op_iso_text", "select id, strftime(acquired, '%Y-%m-%dT%H:%M:%S') || printf('.%06dZ', microsecond(acquired) % 1000000) as iso, acquired from captures", CAPTURES)
def op_iso_text(spark, d):
    text = captures(spark, d).select("id", timeparts.iso_utc("acquired").alias("iso"))
    return text.withColumn("acquired", timeparts.parse_iso("iso"))


@query("op_catalogue_items", "select id, id::bigint % 3 = 0 as has_8_channel, id::bigint % 2 = 0 as has_sr_asset, case when id::bigint % 5 = 0 then 100 - (id::bigint % 4) * 25 else id::bigint % 90 end as clear_percent, case when id::bigint % 7 = 0 then 'SkySat' else 'PS2' end as instrument, id::bigint % 11 <> 0 or id::bigint % 13 = 0 as ground_control from captures", CAPTURES)
def op_catalogue_items(spark, d):
    """Raw catalogue items as JSON, read back with the defaults of absent attributes."""
    from ..sources.catalogue import items_to_scenes

    i = F.col("id").cast("long")
    assets = F.map_filter(F.create_map(F.lit("basic_analytic_8b"), F.when(i % 3 == 0, "x"), F.lit("ortho_analytic_sr"), F.when(i % 2 == 0, "x")), lambda k, v: v.isNotNull())
    properties = F.struct(timeparts.iso_utc("acquired").alias("acquired"), F.lit("PSScene").alias("item_type"), F.when(i % 5 != 0, (i % 90).cast("double")).alias("clear_percent"), F.when(i % 5 == 0, (i % 4) / 4.0).alias("cloud_cover"), F.when(i % 7 != 0, "PS2").alias("instrument"), F.when(i % 13 != 0, i % 11 != 0).alias("ground_control"))
    raw = captures(spark, d).select(F.lit(1).cast("long").alias("cell_id"), F.to_json(F.struct("id", F.transform_values(assets, lambda k, v: F.struct(v.alias("location"))).alias("assets"), properties.alias("properties"))).alias("item"))
    return items_to_scenes(raw).select("id", "has_8_channel", "has_sr_asset", "clear_percent", "instrument", "ground_control")


@query("op_valid_rings", "select id, split_part(id, '-', 2)::bigint % 4 <> 0 as valid from feet", GRIDS, FOOTPRINTS)
def op_valid_rings(spark, d):
    """Rings of which every fourth is folded into a line."""
    flat = F.split("id", "-")[1].cast("long") % 4 == 0
    rings = footprints(spark, d).select("id", F.when(flat, F.transform("ring", lambda p: F.struct(p["x"].alias("x"), F.lit(0.0).alias("y")))).otherwise(F.col("ring")).alias("ring"))
    return rings.select("id", geometry.valid_ring("ring").alias("valid"))


@query("op_wkb_round_trip", "select id, round(x0, 6) as x0, round(y0, 6) as y0, round(x1, 6) as x1, round(y1, 6) as y1 from feet", GRIDS, FOOTPRINTS)
def op_wkb(spark, d):
    back = footprints(spark, d).select("id", geometry.to_wkb("ring").alias("wkb")).select("id", geometry.from_wkb("wkb").alias("ring"))
    return back.select("id", geometry.bounds("ring").alias("b")).select("id", *[r6(F.col(f"b.{c}")).alias(c) for c in ("x0", "y0", "x1", "y1")])


@query("op_segmentize", "select id, (2 * greatest(ceil(abs(x1 - x0) / 0.5), 1) + 2 * greatest(ceil(abs(y1 - y0) / 0.5), 1))::bigint as corners from feet", GRIDS, FOOTPRINTS)
def op_segmentize(spark, d):
    return footprints(spark, d).select("id", F.size(geometry.segmentize("ring", 0.5)).cast("long").alias("corners"))
