"""File scans: globs with a declared or merged schema, year pruning, CSV or Parquet, GeoJSON, GeoPackage, integrity."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..functions.geometry import RING


def scan(spark: SparkSession, path: str | list[str], schema: StructType | None = None, view: str | None = None) -> DataFrame:
    """Parquet files of a glob, with a declared schema where there is one; ``view`` registers them for SQL."""
    reader = spark.read.schema(schema) if schema else spark.read
    df = reader.parquet(*([path] if isinstance(path, str) else path))
    if view:
        df.createOrReplaceTempView(view)
    return df


def scan_union(spark: SparkSession, path: str) -> DataFrame:
    """Union by name of files with different columns."""
    return spark.read.option("mergeSchema", True).parquet(path)


def scan_years(spark: SparkSession, base: str, first: int, schema: StructType | None = None) -> DataFrame:
    """A table partitioned by ``year=``; the filter prunes directories before any file is opened."""
    reader = spark.read.option("basePath", base)
    return (reader.schema(schema.add("year", "int")) if schema else reader).parquet(base).where(F.col("year") >= first)


def table_by_suffix(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    if path.endswith(".csv"):
        reader = spark.read.option("header", True)
        return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    return scan(spark, path, schema)


def geojson_features(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """Features of GeoJSON collections (polygons): their properties (a DDL struct body) and outer ring."""
    raw = spark.read.text(path, wholetext=True)
    kind = f"struct<features:array<struct<properties:struct<{properties}>,geometry:struct<type:string,coordinates:array<array<array<double>>>>>>>"
    rows = raw.select(F.explode(F.from_json("value", kind)["features"]).alias("f"))
    ring = F.transform(F.get("f.geometry.coordinates", F.lit(0)), lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y")))
    return rows.select("f.properties.*", ring.cast(RING).alias("ring"))


def bad_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Paths whose Parquet footer or data cannot be read, tried on the executors, one task per file.

    The files must be visible to executors through a mounted file system or an Arrow one.
    """
    import pyarrow as pa

    def tried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq
        from pyarrow import fs as afs

        for b in batches:
            for path in b.column(0).to_pylist():
                try:
                    store, local = afs.FileSystem.from_uri(path) if "://" in path else (afs.LocalFileSystem(), path)
                    with store.open_input_file(local) as f:
                        for _ in pq.ParquetFile(f).iter_batches():
                            pass
                except Exception as e:  # any unreadable file is the finding itself
                    yield pa.RecordBatch.from_pydict({"path": [path], "error": [f"{type(e).__name__}: {e}"[:300]]})

    return spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths))).mapInArrow(tried, "path string, error string")


def containing(df: DataFrame, key: str, value) -> DataFrame:
    """Files that hold a row with the key."""
    return df.where(F.col(key) == value).select(F.input_file_name().alias("file")).distinct()


class GeoPackageSource(DataSource):
    """``spark.read.format("geopackage").option("path", …).option("table", …)``: attributes and WKB by sqlite3.

    Register with ``spark.dataSource.register(GeoPackageSource)``. Rows are read by ranges of rowid.
    """

    @classmethod
    def name(cls) -> str:
        return "geopackage"

    def _open(self):
        import sqlite3

        return sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True)

    def schema(self) -> str:
        kinds = {"INTEGER": "bigint", "INT": "bigint", "MEDIUMINT": "bigint", "REAL": "double", "DOUBLE": "double", "FLOAT": "double", "BOOLEAN": "boolean", "TEXT": "string"}
        with self._open() as db:
            geometry = {r[0] for r in db.execute("select column_name from gpkg_geometry_columns where table_name = ?", (self.options["table"],))}
            found = db.execute(f'pragma table_info("{self.options["table"]}")').fetchall()
        return ", ".join(f"`{c[1]}` {'binary' if c[1] in geometry else kinds.get(c[2].split('(')[0].upper(), 'string')}" for c in found)

    def reader(self, schema: StructType) -> DataSourceReader:
        return _GeoPackageReader(dict(self.options), schema)


class _Rows(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class _GeoPackageReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.options, self.schema = options, schema

    def _open(self):
        import sqlite3

        return sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True)

    def partitions(self) -> list[InputPartition]:
        with self._open() as db:
            low, high = db.execute(f'select min(rowid), max(rowid) from "{self.options["table"]}"').fetchone()
        if low is None:
            return [_Rows(0, -1)]
        step = int(self.options.get("rows", 100_000))
        return [_Rows(k, min(k + step - 1, high)) for k in range(low, high + 1, step)]

    def read(self, part: _Rows):
        names = ", ".join(f'"{f.name}"' for f in self.schema.fields)
        binary = [f.dataType.typeName() == "binary" for f in self.schema.fields]
        truth = [f.dataType.typeName() == "boolean" for f in self.schema.fields]
        with self._open() as db:
            for row in db.execute(f'select {names} from "{self.options["table"]}" where rowid between ? and ?', (part.low, part.high)):
                yield tuple(wkb_of(v) if b else bool(v) if t and v is not None else v for v, b, t in zip(row, binary, truth))


def wkb_of(raw: bytes | None) -> bytes | None:
    """WKB behind a GeoPackage geometry's header."""
    if raw is None or raw[:2] != b"GP":
        return raw
    envelope = (0, 32, 48, 48, 64)[(raw[3] >> 1) & 7]
    return raw[8 + envelope :]
