"""The corpus pipeline: toxicity, line dedup, SimHash near-dedup, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; ``run`` writes each result as Parquet
in the shared folder and hands it to the next. Counted as part of subpackage llm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swathgrid.llm.common import table, written
from swathgrid.llm.decontaminate import decontaminate
from swathgrid.llm.line_dedup import dedup_lines
from swathgrid.llm.packing import pack
from swathgrid.llm.queries import PACKING, vocabulary
from swathgrid.llm.simhash import one_of_each
from swathgrid.llm.toxicity import THRESHOLD, labelled, score, train


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold; trained on the labelled ones among all documents."""
    model = train(*labelled(docs, table(spark, sf_dir, "labels"), "toxic", usable=lambda c: F.crc32(c.cast("string")) % 4 != 2))
    return score(docs, model, below=THRESHOLD)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dedup_lines(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, vocabulary("byte_bpe_50k.json"), end_id=0, limits=PACKING).withColumn("ids_crc32", F.crc32("ids")).drop("ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_benchmark),
    ("packing", pack_sequences),
]

#: Toxicity, MinHash, SimHash and tokenisation have no SQL form; tests hold run() against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
