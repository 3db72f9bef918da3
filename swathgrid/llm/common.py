"""Shared helpers: table access, shared working folder, materialised intermediates, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share.

    Only where the session names none (a local test run) a folder of our own is made.
    """
    global _own_dir
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _own_dir is None:
        _own_dir = "file://" + tempfile.mkdtemp(prefix="swathgrid-")
    return _own_dir


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def again(df: DataFrame) -> DataFrame:
    """A second handle on what ``written`` wrote, with columns of its own for joins with the first."""
    return df.sparkSession.read.schema(df.schema).parquet(df._written_at)


def forget(df: DataFrame) -> None:
    """Delete what ``written`` wrote; df must not be used afterwards."""
    spark, path = df.sparkSession, getattr(df, "_written_at", None)
    if path:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _bitmap(keys: DataFrame, key: str, max_bits: int) -> tuple[int, DataFrame]:
    """Number of bits, 16 a key up to ``max_bits``, and rows ``__m, __bits`` of 64 of them, where any is set."""
    bits = min(max_bits, max(1 << 15, 1 << (16 * max(1, keys.count()) - 1).bit_length()))
    place = F.pmod(F.xxhash64(key, F.lit(1)), F.lit(bits).cast("long"))
    words = keys.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("__m"))
    return bits, words.agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("__bits"))


def _there(df: DataFrame, keys: DataFrame, key: str, max_bits: int, how: str) -> tuple[DataFrame, Column]:
    """df joined with the keys' bitmap, and whether a row's key may be in keys."""
    bits, words = _bitmap(keys, key, max_bits)
    own = df.withColumn("__p", F.pmod(F.xxhash64(key, F.lit(1)), F.lit(bits).cast("long")))
    joined = own.join(F.broadcast(words), F.shiftright("__p", 6) == F.col("__m"), how)
    return joined, F.expr("getbit(__bits, cast(__p & 63 as int))") == 1


def maybe_in(df: DataFrame, keys: DataFrame, key: str, max_bits: int = 1 << 24) -> DataFrame:
    """df without most of the rows whose key is not in keys, by a broadcast bitmap: cheap before the shuffle of a join.

    The bitmap has 16 bits a key, up to ``max_bits`` (2**18 words of it), so what is broadcast is bounded; with more keys it
    lets more rows through, never fewer than it must.
    """
    joined, there = _there(df, keys, key, max_bits, "inner")
    return joined.where(there).select(*df.columns)


def marked(df: DataFrame, keys: DataFrame, key: str, name: str, max_bits: int = 1 << 24) -> DataFrame:
    """df with a column that is true for every row whose key is in keys, and for few others."""
    joined, there = _there(df, keys, key, max_bits, "left")
    return joined.select(*df.columns, F.coalesce(there, F.lit(False)).alias(name))


def _state(edges: DataFrame) -> tuple:
    """Row count and an order-free digest of an edge list."""
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).first()
    return row.n, row.h


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an undirected edge list ``a, b`` of any orderable type.

    Returns ``node, component`` for every node that has an edge to another one; ``component`` is the smallest node
    reachable. Alternating large-star and small-star rounds (Kiveris et al., 2014) in DataFrame operations only: each
    round is two aggregations and two joins over the edges and never holds a component in one task. Loops and repeated
    edges are ignored; an empty edge list gives an empty result. Each round is written to the shared folder.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = written(edges, "edges")
    seen = _state(edges)
    while seen[0]:
        # large star: each neighbour above u moves to the least of u and its neighbours
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b")).distinct()
        # small star: u and its neighbours below it move to the least of these
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low, "a")
        small = joined.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        small = written(small.select("e.a", "e.b").where("a <> b").distinct(), "edges")
        now = _state(small)
        forget(edges)
        edges = small
        if now == seen:
            break
        seen = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())
