"""Sinks: cell-partitioned Parquet with hex-coded paths, resume by manifest, CSV, GeoJSON and GeoPackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import to_wkb
from ..functions.timeparts import iso_utc


def hex_path(key: Column) -> list[Column]:
    """Three two-digit directories of an id's six hex digits."""
    digits = F.lpad(F.lower(F.hex(key)), 6, "0")
    return [F.substring(digits, 2 * k + 1, 2).alias(f"d{k + 1}") for k in range(3)]


def write_cells(df: DataFrame, path: str, key: str, mode: str = "append") -> None:
    """Parquet below path/d1=aa/d2=bb/d3=cc; rows of a cell meet in one task, so that a cell has one file."""
    parts = dict(zip(("d1", "d2", "d3"), hex_path(F.col(key))))
    df.repartition(F.col(key)).withColumns(parts).write.partitionBy(*parts).option("partitionOverwriteMode", "dynamic").mode(mode).parquet(path)


def remaining(work: DataFrame, done: DataFrame, on: list[str]) -> DataFrame:
    """Work that no manifest row covers: cells with results and cells that were empty are both in it."""
    return work.join(done.select(*on).distinct(), on, "left_anti")


def write_csv(df: DataFrame, path: str, digits: int = 8) -> None:
    """CSV with a header; doubles and floats with a fixed number of digits."""
    fixed = [F.format_string(f"%.{digits}f", c).alias(c) if kind in ("double", "float") else F.col(c) for c, kind in df.dtypes]
    df.select(*fixed).write.mode("overwrite").option("header", True).csv(path)


def features(df: DataFrame, ring: str = "ring") -> DataFrame:
    """``feature``: one GeoJSON feature per row, timestamps as ISO text with microseconds and Z."""
    closed = F.concat(F.col(ring), F.slice(ring, 1, 1))
    points = F.transform(closed, lambda p: F.array(p["x"], p["y"]))
    properties = F.struct(*[iso_utc(c).alias(c) if kind.startswith("timestamp") else F.col(c) for c, kind in df.dtypes if c != ring])
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Polygon").alias("type"), F.array(points).alias("coordinates")).alias("geometry"), properties.alias("properties")), {"ignoreNullFields": "false"}).alias("feature"))


def write_geojson(df: DataFrame, path: str, ring: str = "ring", collection: bool = True) -> None:
    """One FeatureCollection (an empty one too), or line-delimited features, which have no size limit."""
    rows = features(df, ring)
    if not collection:
        rows.write.mode("overwrite").text(path)
        return
    one = rows.agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.collect_list("feature"), ","), F.lit("]}")).alias("value"))
    one.write.mode("overwrite").text(path)


def write_geopackage(df: DataFrame, folder: str, layer: str, ring: str = "ring", srs: int = 4326) -> DataFrame:
    """Polygons and their attributes as GeoPackage files, one for each partition that has rows; returns ``file, n``.

    A file is built in the task's own temporary folder and copied to ``folder`` (any URI that Arrow's file systems know)
    under a name of its attempt, so a retry leaves no half file and only returned files count. Booleans and integers are
    stored as such, timestamps as ISO text.
    """
    import pyarrow as pa

    kinds = {"boolean": "BOOLEAN", "tinyint": "INTEGER", "smallint": "INTEGER", "int": "INTEGER", "bigint": "INTEGER", "float": "REAL", "double": "REAL"}
    columns = [(c, kinds.get(k, "TEXT")) for c, k in df.dtypes if c != ring]
    own = [F.col(f"`{c}`") if kind != "TEXT" else (iso_utc(c) if dict(df.dtypes)[c].startswith("timestamp") else F.col(f"`{c}`").cast("string")).alias(c) for c, kind in columns]

    def put(batches):
        import os
        import shutil
        import tempfile
        import uuid

        from pyarrow import fs

        top = tempfile.mkdtemp()
        try:
            local, db, n = os.path.join(top, "part.gpkg"), None, 0
            for b in batches:
                if b.num_rows and db is None:
                    db = new_geopackage(local, layer, columns, srs)
                rows = zip(*[c.to_pylist() for c in b.columns]) if b.num_rows else ()
                names = ", ".join(['"geom"', *[f'"{c}"' for c, _ in columns]])
                made = ((geopackage_blob(r[0], srs), *r[1:]) for r in rows)
                if b.num_rows:
                    db.executemany(f'insert into "{layer}" ({names}) values ({", ".join("?" * (len(columns) + 1))})', made)
                n += b.num_rows
            if db is None:
                return
            db.commit()
            db.close()
            store, path = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
            store.create_dir(path, recursive=True)
            name = f"{layer}-{uuid.uuid4().hex}.gpkg"
            fs.copy_files(local, f"{path}/{name}", source_filesystem=fs.LocalFileSystem(), destination_filesystem=store)
            yield pa.RecordBatch.from_pydict({"file": [f"{folder}/{name}"], "n": pa.array([n], pa.int64())})
        finally:
            shutil.rmtree(top, ignore_errors=True)

    found = df.select(to_wkb(ring).alias("__wkb"), *own).mapInArrow(put, "file string, n long").collect()  # a row per file
    return df.sparkSession.createDataFrame([(r.file, r.n) for r in found], "file string, n long")


def geopackage_blob(wkb: bytes | None, srs: int) -> bytes | None:
    """A GeoPackage geometry: its header without an envelope, then the WKB."""
    return None if wkb is None else b"GP\x00\x01" + srs.to_bytes(4, "little") + bytes(wkb)


def new_geopackage(path: str, layer: str, columns: list[tuple[str, str]], srs: int):
    """An open sqlite3 database with the format's tables and one layer of polygons."""
    import sqlite3

    db = sqlite3.connect(path)
    db.executescript("""pragma application_id = 1196444487; pragma user_version = 10200;
create table gpkg_spatial_ref_sys (srs_name text not null, srs_id integer not null primary key, organization text not null, organization_coordsys_id integer not null, definition text not null, description text);
create table gpkg_contents (table_name text not null primary key, data_type text not null, identifier text unique, description text default '', last_change datetime not null default (strftime('%Y-%m-%dT%H:%M:%fZ','now')), min_x double, min_y double, max_x double, max_y double, srs_id integer);
create table gpkg_geometry_columns (table_name text not null, column_name text not null, geometry_type_name text not null, srs_id integer not null, z tinyint not null, m tinyint not null, primary key (table_name, column_name));""")
    db.executemany("insert into gpkg_spatial_ref_sys values (?, ?, ?, ?, 'undefined', null)", [("undefined", -1, "NONE", -1), ("undefined geographic", 0, "NONE", 0), (f"EPSG {srs}", srs, "EPSG", srs)])
    fields = ", ".join(f'"{c}" {kind}' for c, kind in columns)
    db.execute(f'create table "{layer}" (fid integer primary key autoincrement, "geom" polygon{", " + fields if fields else ""})')
    db.execute("insert into gpkg_contents (table_name, data_type, identifier, srs_id) values (?, 'features', ?, ?)", (layer, layer, srs))
    db.execute("insert into gpkg_geometry_columns values (?, 'geom', 'POLYGON', ?, 0, 0)", (layer, srs))
    return db
