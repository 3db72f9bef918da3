"""Sources, sinks and streaming on files made here."""

import datetime as dt
import glob
import json
import os
import sqlite3
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from swathgrid import schemas, sources, streaming
from swathgrid.functions import geometry
from swathgrid.sources import catalogue, files


def item(ident, **properties):
    base = {"acquired": "2023-05-01T10:00:00.25Z", "item_type": "PSScene", "satellite_id": "s1", "quality_category": "standard", "satellite_azimuth": 1.0, "sun_azimuth": 2.0, "sun_elevation": 3.0, "view_angle": 4.0}
    return {"id": ident, "assets": {"ortho_analytic_sr": {}}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}, "properties": {**base, **properties}}


def test_catalogue(spark, tmp_path):
    full = item("a", clear_percent=80, cloud_cover=0.1, instrument="PS2", ground_control=False, publishing_stage="preview")
    full["assets"]["basic_analytic_8b"] = {}
    (tmp_path / "7.json").write_text("\n".join(json.dumps(x) for x in (full, item("b", cloud_cover=0.257), item("c", acquired="2024-01-01T00:00:00Z"), item("d", quality_category="test"))))
    (tmp_path / "9.json").write_text("\n".join(["{broken", json.dumps(item("e", cloud_cover=0.5)), "}"]))
    spark.dataSource.register(sources.CatalogueSource)
    conditions = catalogue.search_filter("2023-01-01", "2024-01-01", item_types=("PSScene",))
    raw = spark.read.format("scene_catalogue").option("responses", json.dumps({"7": f"{tmp_path}/7.json", "8": f"{tmp_path}/none.json", "9": f"{tmp_path}/9.json"})).option("filter", json.dumps(conditions)).option("broken", "report").load()
    assert sorted((r.cell_id, r.line) for r in catalogue.failures(raw).collect()) == [(8, None), (9, 1), (9, 3)]
    with pytest.raises(Exception, match="9.json, line 1"):
        spark.read.format("scene_catalogue").option("responses", json.dumps({"9": f"{tmp_path}/9.json"})).load().collect()
    got = {r.id: r for r in schemas.checked(sources.items_to_scenes(raw)).collect()}
    assert set(got) == {"a", "b", "e"} and raw.rdd.getNumPartitions() == 3
    assert (got["a"].clear_percent, got["a"].instrument, got["a"].ground_control, got["a"].publishing_stage, got["a"].has_8_channel, got["a"].has_sr_asset) == (80.0, "PS2", False, "preview", True, True)
    assert (got["b"].clear_percent, got["b"].instrument, got["b"].ground_control, got["b"].publishing_stage, got["b"].has_8_channel) == (75.0, "SkySat", True, "finalized", False)
    assert got["a"].acquired == dt.datetime(2023, 5, 1, 10, 0, 0, 250000) and got["a"].cell_id == 7
    flags = sources.missing_attributes(raw).collect()
    assert len(flags) == 2 and all(not f.instrument and f.cloud_cover and f.assets for f in flags)
    with pytest.raises(Exception, match="outside its domain"):
        schemas.checked(spark.createDataFrame([("Other",)], "item_type string")).collect()
    assert catalogue.asset_name("PSScene", "ortho") == "ortho_analytic_4b"
    with pytest.raises(ValueError):
        catalogue.asset_name("PSScene", "ortho_pansharpened")


def test_feature_pages(spark, tmp_path):
    for k in (0, 2):
        (tmp_path / f"{k}.json").write_text(json.dumps({"features": [{"id": k}, {"id": k + 1}]}))
    spark.dataSource.register(sources.FeaturePages)
    pages = [["land", k, f"{tmp_path}/{k}.json"] for k in catalogue.page_offsets(4, 2)]
    rows = spark.read.format("feature_pages").option("pages", json.dumps(pages)).load().collect()
    assert sorted((r.collection, r.offset, json.loads(r.feature)["id"]) for r in rows) == [("land", 0, 0), ("land", 0, 1), ("land", 2, 2), ("land", 2, 3)]


def test_geopackage(spark, tmp_path):
    path = f"{tmp_path}/cells.gpkg"
    ring = np.array([(0, 0), (2, 0), (2, 1)], float)
    blob = b"GP\x00\x03" + struct.pack("<i4d", 4326, 0, 2, 0, 1) + geometry.wkb_bytes(ring)
    with sqlite3.connect(path) as db:
        db.execute("create table gpkg_geometry_columns (table_name text, column_name text)")
        db.execute("insert into gpkg_geometry_columns values ('cells', 'geom')")
        db.execute("create table cells (cell_id integer primary key, name text, size real, land boolean, geom blob)")
        db.executemany("insert into cells values (?, ?, ?, ?, ?)", [(1, "a", 1.5, 1, blob), (250, None, None, None, None)])
    spark.dataSource.register(sources.GeoPackageSource)
    df = spark.read.format("geopackage").option("path", path).option("table", "cells").option("rows", "100").load()
    rows = {r.cell_id: r for r in df.select("cell_id", "name", "size", "land", geometry.from_wkb("geom").alias("ring")).collect()}
    assert (rows[1].name, rows[1].size, rows[1].land) == ("a", 1.5, True) and [(p.x, p.y) for p in rows[1].ring] == [tuple(p) for p in ring] and rows[250].ring is None


def test_geojson_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, dt.datetime(2023, 1, 2, 3, 4, 5, 600))], "id long, at timestamp_ntz").withColumn("ring", geometry.box(F.lit(0), F.lit(0), F.lit(1), F.lit(2)))
    sources.write_geojson(df, f"file://{tmp_path}/g")
    (name,) = glob.glob(f"{tmp_path}/g/part*")
    assert json.load(open(name))["features"][0]["properties"] == {"id": 1, "at": "2023-01-02T03:04:05.000600Z"}
    back = files.geojson_features(spark, f"file://{tmp_path}/g", "id:bigint,at:string").first()
    assert back.id == 1 and [(p.x, p.y) for p in back.ring] == [(0, 0), (1, 0), (1, 2), (0, 2), (0, 0)]
    sources.write_geojson(df.limit(0), f"file://{tmp_path}/e")
    (name,) = glob.glob(f"{tmp_path}/e/part*")
    assert json.load(open(name)) == {"type": "FeatureCollection", "features": []}


def test_cell_tables(spark, tmp_path):
    base = f"file://{tmp_path}/cells"
    df = spark.range(5).select((F.col("id") * 70000).alias("cell_id"), F.lit(1.25).alias("v"))
    sources.write_cells(df, base, "cell_id")
    assert os.path.isdir(f"{tmp_path}/cells/d1=01/d2=11/d3=70")
    done = sources.scan(spark, base)
    assert done.count() == 5 and sources.remaining(spark.range(6).select((F.col("id") * 70000).alias("cell_id")), done, ["cell_id"]).first().cell_id == 350000
    assert "d3=70" in files.containing(done, "cell_id", 70000).first().file
    sources.write_csv(df, f"file://{tmp_path}/csv")
    text = "".join(open(p).read() for p in glob.glob(f"{tmp_path}/csv/part*"))
    assert "1.25000000" in text
    one = f"{tmp_path}/one.csv"
    open(one, "w").write("a,b\n1,2.5\n")
    assert files.table_by_suffix(spark, f"file://{one}").first().b == 2.5


def test_years_and_unions(spark, tmp_path):
    for year in (2021, 2022):
        spark.createDataFrame([(year, 1)] if year == 2021 else [(year, 1, 2.0)], "id long, a int" + ("" if year == 2021 else ", b double")).write.parquet(f"file://{tmp_path}/t/year={year}")
    union = sources.scan_union(spark, f"file://{tmp_path}/t")
    assert set(union.columns) == {"id", "a", "b", "year"} and union.count() == 2
    recent = sources.scan_years(spark, f"file://{tmp_path}/t", 2022)
    assert recent.count() == 1 and "PartitionFilters: [isnotnull(year" in recent._jdf.queryExecution().executedPlan().toString()


def test_bad_files(spark, tmp_path):
    spark.range(3).coalesce(1).write.parquet(f"file://{tmp_path}/ok")
    good = glob.glob(f"{tmp_path}/ok/*.parquet")
    (tmp_path / "bad.parquet").write_bytes(b"PAR1 no")
    rows = sources.bad_files(spark, [*good, f"{tmp_path}/bad.parquet", f"{tmp_path}/missing.parquet"]).collect()
    assert sorted(os.path.basename(r.path) for r in rows) == ["bad.parquet", "missing.parquet"]


def test_streams(spark, tmp_path):
    rows = [(k, "a" if k % 3 else "b", dt.datetime(2023, 1, 1, k // 4, 15 * (k % 4))) for k in range(12)]
    df = spark.createDataFrame(rows, "id long, k string, at timestamp_ntz")
    df.coalesce(1).write.parquet(f"file://{tmp_path}/in")
    stream = streaming.scene_stream(spark, f"file://{tmp_path}/in", df.schema)
    q = streaming.hourly_counts(stream, "k", "at").writeStream.format("memory").queryName("hours").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sum(r.n for r in spark.table("hours").collect()) == 12 and spark.table("hours").count() == 6
    q = streaming.sessions(stream, "k", "at", "20 minutes").writeStream.format("memory").queryName("visits").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.k, r.n) for r in spark.table("visits").collect()) == [("a", 2)] * 4 + [("b", 1)] * 4
    for _ in range(2):  # the second run finds nothing new
        streaming.ingest(streaming.scene_stream(spark, f"file://{tmp_path}/in", df.schema), f"file://{tmp_path}/out", f"file://{tmp_path}/cp", ["id"], ["k"]).awaitTermination(120)
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == 12


def test_geopackage_sink_round_trip(spark, tmp_path):
    from pyspark.sql import functions as F

    from swathgrid.functions import geometry
    from swathgrid.sources import sinks

    ring = geometry.box(F.col("id") * 1.0, F.lit(0.0), F.col("id") + 1.5, F.lit(2.0))
    cells = spark.range(50).repartition(3).select(F.col("id").alias("cell"), (F.col("id") % 2 == 0).alias("even"), (F.col("id") / 4).alias("share"), F.concat(F.lit("n"), "id").alias("name"), ring.alias("ring"))
    files_made = sinks.write_geopackage(cells, f"{tmp_path}/out", "cells").collect()
    assert sum(r.n for r in files_made) == 50
    spark.dataSource.register(sources.GeoPackageSource)
    back = []
    for r in files_made:
        df = spark.read.format("geopackage").option("path", r.file).option("table", "cells").load()
        back += df.select("cell", "even", "share", "name", geometry.bounds(geometry.from_wkb("geom")).alias("b")).collect()
    assert sorted((r.cell, r.even, r.share, r.name, r.b.x0, r.b.x1, r.b.y1) for r in back) == [(k, k % 2 == 0, k / 4, f"n{k}", k, k + 1.5, 2.0) for k in range(50)]
    assert sinks.write_geopackage(cells.limit(0), f"{tmp_path}/none", "cells").count() == 0
