"""Benchmark decontamination: broadcast hash set of normalised n-grams, windowed scan, removal of spans or documents.

Words are the runs of ASCII letters, digits and non-ASCII characters after lower-casing A-Z. The benchmark streams through the
driver and is cut by its running bytes into blocks; a block's n-grams are broadcast, scanned for and released before the
next is built, so neither the driver nor a broadcast grows with the benchmark. Hits depend on a text alone and are merged by
128 bits of its hash, so the result is the same for every block size. After the first block only hits are written.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

WORDS_IN_WINDOW = 8
#: Bytes of benchmark text in one broadcast block; its index takes some forty times that in a worker.
BLOCK_BYTES = 4 << 20

_SEPARATORS = [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
#: Lower-cases A-Z and turns every ASCII character but letters and digits into a space, byte by byte.
_NORMAL = bytes(0x20 if b in _SEPARATORS else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))

#: A character that Python's str.strip leaves, for the same definition of blank in SQL.
_NOT_BLANK = r"[^\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"

_HITS = "n_words long, spans array<struct<first:long,last:long,char_first:long,char_end:long>>, items array<string>"


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(_NORMAL).split()


class Index:
    """Windows of a block of benchmark items: their vocabulary and, by length, the items of each window."""

    def __init__(self):
        self.vocabulary: set[bytes] = set()
        self.windows: dict[int, dict[bytes, list[str]]] = {}
        self.bytes = 0

    def add(self, item: str, words: list[bytes], n: int) -> None:
        size = min(n, len(words))
        own = self.windows.setdefault(size, {})
        for k in range(len(words) - size + 1):
            items = own.setdefault(b" ".join(words[k : k + size]), [])
            if item not in items:
                items.append(item)
        self.vocabulary.update(words)
        self.bytes += sum(map(len, words)) + len(words)


def blocks_of(rows: Iterator, n: int, block_bytes: int = BLOCK_BYTES) -> Iterator[Index]:
    """Indexes of at most about ``block_bytes`` of text each; items over a quarter of that are indexed in pieces.

    Pieces overlap by n - 1 words, so that each window lies whole in one. Rows with a null id or text, or without words, give
    nothing.
    """
    block = Index()
    for item, text in rows:
        words = words_of(text.encode()) if item is not None and text is not None else []
        at = 0
        while words and (at == 0 or at + n - 1 < len(words)):
            end, size = at, 0
            while end < len(words) and (size <= block_bytes // 4 or end - at < 2 * n):
                size += len(words[end]) + 1
                end += 1
            if block.bytes and block.bytes + size > block_bytes:
                yield block
                block = Index()
            block.add(str(item), words[at:end], n)
            at = end - n + 1 if end < len(words) else len(words)
    if block.bytes:
        yield block


def _hits(words: list[bytes], vocabulary: set, windows: dict) -> tuple[list[tuple[int, int]], set[str]]:
    """Merged spans of hit words (first, last) and the items whose windows occur."""
    if not words or not windows:
        return [], set()
    known = np.fromiter((w in vocabulary for w in words), bool, len(words))
    bound = np.flatnonzero(np.diff(np.concatenate(([0], known.view(np.int8), [0]))))
    spans: list[tuple[int, int]] = []
    items: set[str] = set()
    shortest = min(windows)
    for a, b in zip(bound[::2].tolist(), bound[1::2].tolist()):
        if b - a < shortest:
            continue
        found = []
        for size, own in windows.items():
            for k in range(a, b - size + 1):
                if (hit := own.get(b" ".join(words[k : k + size]))) is not None:
                    items.update(hit)
                    found.append((k, k + size - 1))
        for first, last in sorted(found):
            if spans and first <= spans[-1][1] + 1:
                spans[-1] = (spans[-1][0], max(spans[-1][1], last))
            else:
                spans.append((first, last))
    return spans, items


def _places(text: str, spans: list[tuple[int, int]]) -> list[dict]:
    """Spans of words with their character range in text."""
    normal = text.encode().translate(_NORMAL).decode()
    starts, ends, at = [], [], 0
    for w in normal.split(" "):
        if w:
            starts.append(at)
            ends.append(at + len(w))
        at += len(w) + 1
    return [{"first": a, "last": b, "char_first": starts[a], "char_end": ends[b]} for a, b in spans]


def _scan(rows: DataFrame, index: Index, hits_only: bool = False) -> tuple[DataFrame, Broadcast]:
    """rows with ``n_words, spans, items`` instead of ``text``, and what was broadcast for it."""
    held = rows.sparkSession.sparkContext.broadcast((index.vocabulary, index.windows))
    at = rows.columns.index("text")
    others = [f for f in rows.schema.fields if f.name != "text"]
    out = pa.schema([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([(f, pa.int64()) for f in ("first", "last", "char_first", "char_end")]))), ("items", pa.list_(pa.string()))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, windows = held.value
        for batch in batches:
            counts, all_spans, all_items = [], [], []
            for raw in batch.column(at).cast(pa.large_binary()).to_pylist():
                words = words_of(raw or b"")
                spans, items = _hits(words, vocabulary, windows)
                counts.append(len(words))
                all_spans.append(_places(raw.decode(), spans) if spans else [])
                all_items.append(sorted(items))
            kept = [k for k in range(len(batch.schema)) if k != at]
            found = pa.RecordBatch.from_arrays([*[batch.column(k) for k in kept], *[pa.array(x, f.type) for x, f in zip((counts, all_spans, all_items), out)]], names=[*[batch.schema.names[k] for k in kept], *out.names])
            yield found.filter(pa.array([bool(x) for x in all_items], pa.bool_())) if hits_only else found

    kinds = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in others], _HITS])
    return rows.mapInArrow(scan, kinds), held


#: Spans in order, those that overlap or touch as one.
_MERGED = """aggregate(s, cast(array() as array<struct<first:long,last:long,char_first:long,char_end:long>>), (a, x) ->
  if(size(a) > 0 and x.first <= element_at(a, -1).last + 1,
    concat(slice(a, 1, size(a) - 1), array(named_struct('first', element_at(a, -1).first, 'last', greatest(element_at(a, -1).last, x.last),
      'char_first', element_at(a, -1).char_first, 'char_end', greatest(element_at(a, -1).char_end, x.char_end)))),
    concat(a, array(x))))"""


def _rows_of(benchmark: DataFrame) -> Iterator[tuple]:
    return ((r.item_id, r.text) for r in benchmark.select("item_id", "text").toLocalIterator())


def _with_hits(rows: DataFrame, blocks: Iterator[Index]) -> DataFrame:
    """``rows`` (``text`` and others) with ``n_words, spans, items`` instead of the text, whatever the number of blocks."""
    this, after = next(blocks, None) or Index(), next(blocks, None)
    if after is None:
        return _scan(rows, this)[0]
    own = rows.columns
    hashed = rows.withColumns({"__h1": F.xxhash64("text"), "__h2": F.xxhash64(F.lit(1), "text")})
    scanned, held = _scan(hashed, this)
    first = written(scanned, "hits")
    held.destroy()
    found = []
    while after is not None:
        scanned, held = _scan(hashed.select("__h1", "__h2", "text"), after, hits_only=True)
        # copies of a text have the same hits: one row for each text before the shuffle
        once = scanned.groupBy("__h1", "__h2").agg(F.first("spans").alias("spans"), F.first("items").alias("items"))
        found.append(written(once, "hits"))
        held.destroy()
        after = next(blocks, None)
    more = found[0]
    for x in found[1:]:
        more = more.union(x)
    more = more.groupBy("__h1", "__h2").agg(F.flatten(F.collect_list("spans")).alias("s"), F.flatten(F.collect_list("items")).alias("i"))  # a row a block
    nothing = F.array()
    joined = first.join(more, ["__h1", "__h2"], "left")
    joined = joined.withColumns({"s": F.array_sort(F.concat("spans", F.coalesce("s", nothing))), "items": F.array_sort(F.array_distinct(F.concat("items", F.coalesce("i", nothing))))})
    return joined.select(*[c for c in own if c != "text"], "n_words", F.expr(_MERGED).alias("spans"), "items")


def find_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "key", n: int = WORDS_IN_WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document row: ``key, n_words, spans, items``.

    ``docs`` needs a long ``key`` column, which may repeat or be null; other columns do not travel. ``spans`` are the merged
    runs of hit words (by word and by character), ``items`` the sorted ids of benchmark items with an occurring window. A null
    or empty text has no words; benchmark rows with a null id or text, or no words, give no window; an empty benchmark hits
    nothing. Ties and repeated rows: each document row is judged alone, repeated item ids count once.
    """
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return _with_hits(rows, blocks_of(_rows_of(benchmark), n, block_bytes))


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = WORDS_IN_WINDOW, min_items: int = 2, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without documents that hold windows of ``min_items`` items or more; hit spans are cut from the others.

    The columns of docs are kept as they are. Documents without a hit come back unchanged, nulls and empty texts too; one
    of which nothing but white space (as ``str.strip`` has it) is left after the cut goes.
    """
    schema = docs.schema
    blocks = blocks_of(_rows_of(benchmark), n, block_bytes)
    this, after = next(blocks, None) or Index(), next(blocks, None)
    if after is not None:
        texts = docs.where("text is not null").select(F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"), "text")
        found = _with_hits(texts, chain([this, after], blocks)).where(F.size("items") > 0)
        found = written(found.groupBy("h1", "h2").agg(F.first("spans").alias("spans"), F.first("items").alias("items")), "found")
        packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").alias("text"))
        packed = packed.withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(1), "text")})
        joined = packed.join(found, ["h1", "h2"], "left").where(F.coalesce(F.size("items"), F.lit(0)) < min_items)
        cut = F.expr("aggregate(spans, named_struct('at', 0L, 'out', ''), (a, x) -> named_struct('at', x.char_end, 'out', concat(a.out, substring(text, cast(a.at + 1 as int), cast(x.char_first - a.at as int)))), a -> concat(a.out, substring(text, cast(a.at + 1 as int))))")
        left = joined.withColumn("left", F.when(F.col("items").isNotNull(), cut).otherwise(F.col("text"))).where(F.col("items").isNull() | F.col("left").rlike(_NOT_BLANK))
        return left.select(*[F.col("left").alias(c) if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])
    held = docs.sparkSession.sparkContext.broadcast((this.vocabulary, this.windows))
    at = docs.columns.index("text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, windows = held.value
        for batch in batches:
            keep, texts, changed = [], [], False
            for raw in batch.column(at).cast(pa.large_binary()).to_pylist():
                spans, items = _hits(words_of(raw or b""), vocabulary, windows)
                text = None if raw is None else raw.decode()
                if spans:
                    changed, left, done = True, [], 0
                    for s in _places(text, spans):
                        left.append(text[done : s["char_first"]])
                        done = s["char_end"]
                    text = "".join(left) + text[done:]
                keep.append(len(items) < min_items and (not spans or bool(text.strip())))
                texts.append(text)
            if changed:
                columns = batch.columns
                columns[at] = pa.array(texts, batch.schema.field(at).type)
                batch = pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(pa.array(keep))
            yield batch

    return docs.mapInArrow(scan, schema)
