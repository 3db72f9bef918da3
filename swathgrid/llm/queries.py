"""Queries of the training-data operators, each over its whole table, and their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .packing import Limits

#: The first tokens of a document bear no loss, and a sequence has room for loss on all but a few: all three limits bind.
PACKING = Limits(tokens=1024, segments=16, loss_tokens=1008, context=32)


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file; the same package is on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line that is not blank with the line kept of its component."""
    from .line_dedup import line_classes

    return line_classes(table(spark, sf_dir, "documents")).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "keep_doc_id", F.col("keep_line_no").cast("long").alias("keep_line_no"), "kept")


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vectors import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings with the value's digest instead of the value."""
    from .secrets import DICTIONARY, dictionary_of, scan_secrets

    words = {*DICTIONARY, *dictionary_of(vocabulary("byte_bpe_50k.json"))}
    found = scan_secrets(table(spark, sf_dir, "documents"), dictionary=words)
    return found.select("doc_id", "line_no", "kind", F.sha2("value", 256).alias("value_sha256"), "n", "score", "kept")


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import chain, format_paths, parse, reply_paths

    ok = "</s>[INST] ok [/INST]"
    more = spark.sql(f"select * from values (-7L, 0L, 'user', '{ok}'), (-7L, 1L, 'assistant', '{ok}') as t(conv_id, turn, role, text)")
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").union(more)
    back = parse(format_paths(reply_paths(chain(turns))))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars")
    )


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import read_tokens, write_tokens

    return read_tokens(spark, write_tokens(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=2, remember=1_200_000))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import find_contamination

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "text")
    found = find_contamination(docs, table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["last"] - s["first"] + 1)
    n = F.size("items").cast("long")
    return found.select(F.col("key").alias("doc_id"), "n_words", hit.alias("n_hit"), n.alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n >= 2).alias("contaminated"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import THRESHOLD, labelled, score, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    part = lambda c: F.crc32(c.cast("string")) % 4
    model = train(*labelled(docs, table(spark, sf_dir, "labels"), "toxic", usable=lambda c: part(c) != 2))
    return score(docs, model).select("doc_id", (part(F.col("doc_id")) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    found = pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=0, limits=PACKING, remember=1_200_000)
    return found.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_embedding_near_dedup, op3_license_scan, op4_secret_scan, op5_chat_format, op6_token_files, op7_simhash, op8_decontaminate, op9_toxicity, op10_pack, pipeline)}
_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_ESCAPED = "(length({0}) + length({0}) - length(replace({0}, chr(92), '')) + (length({0}) - length(replace({0}, '</s>', ''))) // 4 + (length({0}) - length(replace({0}, '<s>', ''))) // 3 + (length({0}) - length(replace({0}, '[INST]', ''))) // 6 + (length({0}) - length(replace({0}, '[/INST]', ''))) // 7)"

#: The same questions in SQL for an independent engine, for those that SQL can express.
ORACLE: dict[str, str] = {
    "op2_embedding_near_dedup": """with recursive v as (select vec_id, label, embedding::double[] as e from embeddings),
  l as (select a.vec_id as a, b.vec_id as b from v as a join v as b on a.label = b.label and a.vec_id <> b.vec_id and list_cosine_similarity(a.e, b.e) >= 0.98),
  r as (select vec_id as a, vec_id as b from v union select r.a, l.b from r join l on r.b = l.a)
select vec_id, (select count(*) from l where l.a = v.vec_id) as n_links, (select min(b) from r where r.a = v.vec_id) as component_id, vec_id = (select min(b) from r where r.a = v.vec_id) as kept from v""",
    "op5_chat_format": f"""with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars, sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(9 + case when role = 'user' then 15 else 0 end + {_ESCAPED.format('role')} + {_ESCAPED.format('text')} + length(role) - length(replace(role, chr(10), '')))::bigint as formatted_chars
from t group by conv_id""",
    "op8_decontaminate": f"""with d as (select doc_id, {_WORDS} as w from documents), b as (select item_id, {_WORDS} as w from benchmark where item_id is not null),
  bw as (select distinct item_id, n, array_to_string(w[k:k + n - 1], ' ') as g from (select *, least(8, len(w)) as n from b where len(w) > 0), unnest(range(1, len(w) - n + 2)) as x(k)),
  dw as (select doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') as g from d, (select distinct n from bw), unnest(range(1, len(w) - n + 2)) as x(k)),
  h as (select distinct doc_id, item_id, n, k from dw join bw using (n, g)),
  p as (select doc_id, count(distinct q) as n_hit from h, unnest(range(k, k + n)) as x(q) group by doc_id),
  i as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as items from h group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_items, 0) >= 2 as contaminated from d left join p using (doc_id) left join i using (doc_id)""",
}
