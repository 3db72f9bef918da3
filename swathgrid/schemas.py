"""Typed tables: scenes, enriched samples, pairs, presence flags. All timestamps are naive UTC."""

from __future__ import annotations

from pyspark.sql import types as T

# Closed string domains of the catalogue.
ITEM_TYPES = ("PSScene", "SkySatCollect")
INSTRUMENTS = ("PS2", "PS2.SD", "PSB.SD", "SkySat")
QUALITIES = ("test", "standard")
STAGES = ("preview", "standard", "finalized")
DOMAINS = {"item_type": ITEM_TYPES, "instrument": INSTRUMENTS, "quality_category": QUALITIES, "publishing_stage": STAGES}


def _struct(text: str) -> T.StructType:
    kinds = {"s": T.StringType(), "t": T.TimestampNTZType(), "l": T.LongType(), "f": T.FloatType(), "i": T.IntegerType(), "b": T.BooleanType(), "d": T.DoubleType(), "x": T.BinaryType()}
    return T.StructType([T.StructField(name, kinds[kind]) for name, kind in (part.split(":") for part in text.split())])


_SCENE = "id:s acquired:t item_type:s satellite_id:s instrument:s cell_id:l has_8_channel:b has_sr_asset:b clear_percent:f quality_category:s ground_control:b publishing_stage:s satellite_azimuth:f sun_azimuth:f sun_elevation:f view_angle:f"
SCENES = _struct(_SCENE + " geometry_wkb:x")
COASTAL_SAMPLES = _struct(_SCENE + " query_cell_id:l grid_id:l intersects_grid_centroid:b coverage_pct:f tide_height:f tide_height_bin:i is_mid_tide:b has_tide_data:b solar_time:t solar_time_offset_seconds:f")
HEX_SAMPLES = _struct(_SCENE.replace("cell_id:l ", "") + " query_cell_id:l hex_id:l coverage_pct:f")
PAIRS = _struct("dove_id:s skysat_id:s grid_id:l cell_id:l overlap_area:f geometry_wkb:x dove_acquired:t skysat_acquired:t time_of_day_delta_sec:f acquired_delta_sec:f has_8_channel:b")
MISSING = _struct("acquired:t item_type:s instrument:b clear_percent:b cloud_cover:b ground_control:b publishing_stage:b assets:b")
GRIDS = _struct("grid_id:l cell_id:l hex_id:l dist_km:d is_land:b is_coast:b")


def checked(df, domains: dict[str, tuple[str, ...]] = DOMAINS):
    """df, failing at run time on a value outside its domain (nulls pass)."""
    from pyspark.sql import functions as F

    for name, values in domains.items():
        if name in df.columns:
            bad = F.col(name).isNotNull() & ~F.col(name).isin(*values)
            df = df.withColumn(name, F.when(bad, F.raise_error(F.concat(F.lit(f"{name} outside its domain: "), F.col(name)))).otherwise(F.col(name)))
    return df
