"""The pipeline stage by stage against brute force on a small corpus, and as a whole on a small table."""

import itertools
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from swathgrid.llm.queries import QUERIES, vocabulary  # noqa: E402
from swathgrid.llm.simhash import fingerprint  # noqa: E402

STAGES = dict(corpus_pipeline.STAGES)


def docs_of(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def test_stage_names():
    assert list(STAGES) == ["toxicity", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "packing"] and corpus_pipeline.ORACLE_SQL is None


def test_each_stage_keeps_columns_and_its_decisions(spark, small):
    docs = docs_of(spark, small)
    columns = docs.columns
    tox = STAGES["toxicity"](spark, docs, small)
    assert tox.columns == columns
    scores = {r.doc_id: r.predicted for r in QUERIES["op9_toxicity"](spark, small).collect()}
    assert {r.doc_id for r in tox.collect()} == {d for d, p in scores.items() if p == 0}

    lines = STAGES["line_dedup"](spark, docs, small)
    assert lines.columns == columns
    kept = {}
    for r in QUERIES["op1_line_dedup"](spark, small).collect():
        kept.setdefault(r.doc_id, {})[r.line_no] = r.kept
    want = {}
    for r in docs.collect():
        own = kept.get(r.doc_id, {})
        text = "\n".join(x for k, x in enumerate((r.text or "").split("\n")) if own.get(k, True))
        if all(own.values()) or text.strip(" "):
            want[r.doc_id] = r.text if all(own.values()) else text
    assert {r.doc_id: r.text for r in lines.collect()} == want

    near = STAGES["simhash_near_dedup"](spark, docs, small)
    assert near.columns == columns
    ids = sorted(r.doc_id for r in docs.select("doc_id").collect())
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    fp = np.array([fingerprint(text[i].encode()) for i in ids], np.uint64)
    group = list(range(len(ids)))
    for a, b in itertools.combinations(range(len(ids)), 2):
        if int(fp[a] ^ fp[b]).bit_count() <= 4:
            low, high = sorted((group[a], group[b]))
            group = [low if g == high else g for g in group]
    assert {r.doc_id for r in near.collect()} == {ids[g] for g in group}

    clean = STAGES["benchmark_decontamination"](spark, docs, small)
    assert clean.columns == columns
    found = {r.doc_id: r for r in QUERIES["op8_decontaminate"](spark, small).collect()}
    left = {r.doc_id: r.text for r in clean.collect()}
    assert all((d in left) == (not f.contaminated) for d, f in found.items() if f.n_hit < f.n_words)
    assert all(left[d] == text[d] for d, f in found.items() if f.n_items == 0 and text[d])
    bench = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r["text"].lower()) for r in pq.read_table(f"{small}/benchmark.parquet").to_pylist()]
    windows = {tuple(w[k : k + 8]) for w in bench for k in range(len(w) - 7)}
    for d, f in found.items():
        if d in left and f.n_items:
            w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", left[d].lower())
            assert not any(tuple(w[k : k + 8]) in windows for k in range(len(w) - 7))


def test_the_whole_is_its_stages(spark, small):
    docs = docs_of(spark, small)
    for name, stage in list(STAGES.items())[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, small).collect(), docs.schema)
    got = corpus_pipeline.run(spark, small)
    total = {r.doc_id: r.n for r in got.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    ids = {r.doc_id: np.array(t.encode(r.text or "", add_special_tokens=False).ids + [0], "<u4") for r in docs.collect()}
    assert total == {d: len(x) for d, x in ids.items()}
    for r in got.collect():
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())


def test_stages_on_odd_rows(spark, small):
    rows = [(1, None, "en", "s", 0), (2, "", "en", "s", 0), (None, "a lone row", None, None, None), (3, "x " * 5000, "en", "s", 1), (3, "x " * 5000, "en", "s", 1)]
    schema = docs_of(spark, small).schema
    for frame in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for name, stage in STAGES.items():
            out = stage(spark, frame, small)
            assert out.count() <= max(1, frame.count()) * 20 and (name == "packing" or out.columns == frame.columns)
