"""The engine's tables derived from the star-schema test tables: the same expressions in Spark and in the oracle's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import box


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _minutes(n):
    return F.make_dt_interval(F.lit(0), F.lit(0), n.cast("int"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day-grained samples of line items."""
    li = read(spark, sf_dir, "lineitem")
    grid = F.col("l_partkey") % 200
    at = F.col("l_shipdate").cast("timestamp_ntz")
    return li.select(
        F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("id"),
        at.alias("acquired"),
        (at + _minutes((F.col("l_suppkey") * 37 + F.col("l_partkey") * 11) % 1440)).alias("solar_time"),
        F.when(F.col("l_returnflag") == "N", "SkySatCollect").otherwise("PSScene").alias("item_type"),
        F.col("l_suppkey").alias("satellite_id"),
        grid.alias("grid_id"),
        F.when(grid % 37 == 0, -1).otherwise(grid % 20).cast("long").alias("hex_id"),
        F.element_at(F.array(F.lit("PS2"), F.lit("PS2.SD"), F.lit("PSB.SD")), (F.col("l_linenumber") % 3 + 1).cast("int")).alias("instrument"),
        (F.col("l_discount") * 10).alias("coverage_pct"),
        (F.col("l_quantity") * 2).alias("clear_percent"),
        F.when(F.col("l_linestatus") == "F", "finalized").otherwise("standard").alias("publishing_stage"),
        F.when(F.col("l_linenumber") == 6, "test").otherwise("standard").alias("quality_category"),
        (F.col("l_tax") < 0.07).alias("has_sr_asset"),
        (F.col("l_linenumber") != 7).alias("ground_control"),
        ((at >= F.lit("1998-07-01").cast("timestamp_ntz")) | (F.col("l_suppkey") % 5 == 0)).alias("has_8_channel"),
        (F.col("l_extendedprice") % 1000 / 250 - 2).alias("tide_height"),
    )


SAMPLES = """samples as (select concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) as id, cast(l_shipdate as timestamp) as acquired,
  cast(l_shipdate as timestamp) + to_minutes(cast((l_suppkey * 37 + l_partkey * 11) % 1440 as bigint)) as solar_time,
  case when l_returnflag = 'N' then 'SkySatCollect' else 'PSScene' end as item_type, l_suppkey as satellite_id, l_partkey % 200 as grid_id,
  case when l_partkey % 200 % 37 = 0 then -1 else l_partkey % 200 % 20 end as hex_id,
  case l_linenumber % 3 when 0 then 'PS2' when 1 then 'PS2.SD' else 'PSB.SD' end as instrument, l_discount * 10 as coverage_pct, l_quantity * 2 as clear_percent,
  case when l_linestatus = 'F' then 'finalized' else 'standard' end as publishing_stage, case when l_linenumber = 6 then 'test' else 'standard' end as quality_category,
  l_tax < 0.07 as has_sr_asset, l_linenumber <> 7 as ground_control, (l_shipdate >= timestamp '1998-07-01' or l_suppkey % 5 = 0) as has_8_channel,
  l_extendedprice % 1000 / 250 - 2 as tide_height from lineitem)"""


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sub-day captures of events, all of good quality but for some."""
    e = read(spark, sf_dir, "events")
    at = F.col("ts").cast("timestamp_ntz")
    return e.select(
        F.col("event_id").cast("string").alias("id"), at.alias("acquired"), (at + _minutes(F.col("user_id") * 7 % 1440)).alias("solar_time"), F.lit("PSScene").alias("item_type"), F.col("event_type").alias("satellite_id"),
        (F.col("user_id") % 50).alias("grid_id"), F.lit(1.0).alias("coverage_pct"), (F.col("event_id") % 101).cast("double").alias("clear_percent"), F.when(F.col("event_id") % 7 == 0, "preview").otherwise("finalized").alias("publishing_stage"),
        F.lit("standard").alias("quality_category"), (F.col("event_id") % 10 != 0).alias("has_sr_asset"), F.lit(True).alias("ground_control"),
    )


CAPTURES = """captures as (select cast(event_id as varchar) as id, cast(ts as timestamp) as acquired, cast(ts as timestamp) + to_minutes(cast(user_id * 7 % 1440 as bigint)) as solar_time,
  'PSScene' as item_type, event_type as satellite_id, user_id % 50 as grid_id, 1.0 as coverage_pct, event_id % 101 as clear_percent,
  case when event_id % 7 = 0 then 'preview' else 'finalized' end as publishing_stage, 'standard' as quality_category, event_id % 10 <> 0 as has_sr_asset, true as ground_control from events)"""


def grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = read(spark, sf_dir, "part").select((F.col("p_partkey") % 200).cast("long").alias("grid_id")).distinct()
    i = F.col("grid_id")
    tide_min, tide_max = -2.0 - (i % 3) / 10, 2.0 + (i % 4) / 10
    return g.select("grid_id", F.when(i % 37 == 0, -1).otherwise(i % 20).cast("long").alias("hex_id"), (i * 7 % 60).cast("double").alias("dist_km"), (i % 11 == 0).alias("is_land"), (i % 5 == 0).alias("is_coast"), tide_min.alias("tide_min"), tide_max.alias("tide_max"), (tide_max - tide_min).alias("tide_range"))


GRIDS = """grids as (select distinct p_partkey % 200 as grid_id from part), dims as (select grid_id, case when grid_id % 37 = 0 then -1 else grid_id % 20 end as hex_id, cast(grid_id * 7 % 60 as double) as dist_km,
  grid_id % 11 = 0 as is_land, grid_id % 5 = 0 as is_coast, -2.0 - (grid_id % 3)::double / 10 as tide_min, 2.0 + (grid_id % 4)::double / 10 as tide_max,
  (2.0 + (grid_id % 4)::double / 10) - (-2.0 - (grid_id % 3)::double / 10) as tide_range from grids)"""


def cell_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit boxes of the cells."""
    x, y = F.col("grid_id") % 20, F.floor(F.col("grid_id") / 20)
    return grids(spark, sf_dir).select("grid_id", "hex_id", box(x, y, x + 1, y + 1).alias("ring"))


def footprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Axis-aligned footprints of the line items of early orders."""
    li = read(spark, sf_dir, "lineitem").where("l_linenumber = 1")
    x0, y0 = F.col("l_partkey") % 1900 / 100.0, F.col("l_suppkey") % 90 / 10.0
    ident = F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey")
    return li.select(ident.alias("id"), x0.alias("x0"), y0.alias("y0"), (x0 + 0.25 + F.col("l_quantity") / 40).alias("x1"), (y0 + 0.25 + F.col("l_discount") * 5).alias("y1")).distinct().select("id", box(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).alias("ring"))


FOOTPRINTS = """feet as (select distinct * from (select concat_ws('-', l_orderkey, l_partkey, l_suppkey) as id, (l_partkey % 1900) / 100.0::double as x0, (l_suppkey % 90) / 10.0::double as y0,
  (l_partkey % 1900) / 100.0::double + 0.25 + l_quantity / 40 as x1, (l_suppkey % 90) / 10.0::double + 0.25 + l_discount * 5 as y1 from lineitem where l_linenumber = 1)),
  boxes as (select grid_id, hex_id, (grid_id % 20)::double as bx, floor(grid_id / 20)::double as gy0 from dims),
  laps as (select id, grid_id, hex_id, least(x1, bx + 1) - greatest(x0, bx) as w, least(y1, gy0 + 1) - greatest(y0, gy0) as h, (x1 - x0) * (y1 - y0) as own from feet, boxes where greatest(x0, bx) < least(x1, bx + 1) and greatest(y0, gy0) < least(y1, gy0 + 1))"""
