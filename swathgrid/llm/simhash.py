"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within radius r share a variant within r/2 of both, so every distinct fingerprint emits its whole ball of
half the radius. A variant belongs to the slice that its top bits name: what is shuffled is the fingerprint once for each
slice that its ball meets, and the slice's task expands the rest of the ball, sorts it and verifies the owners of equal
variants. Each slice sends on a spanning forest of its verified links, so neither a row per variant nor all pairs of a
group ever leave a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import again, components, marked, written
from .encoding import release

BITS = 64
RADIUS = 4
SHINGLE_WORDS = 4
SEED = 42
#: Distinct fingerprints per slice that the number of slices aims at, and variants sorted at once in a task.
PER_SLICE = 800
SORTED_AT_ONCE = 1 << 21


def fingerprint(raw: bytes, size: int = SHINGLE_WORDS) -> int:
    """Fingerprint of UTF-8 text: per bit the strict majority of its shingles' XXH64; 0 without words."""
    import xxhash

    words = raw.lower().split()  # bytes: lower() and split() know ASCII only
    if not words:
        return 0
    joined = b" ".join(words)
    size = min(size, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    digest = xxhash.xxh64_intdigest
    n = len(words) - size + 1
    h = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[size - 1 :].tolist())), np.uint64, n)
    ones = np.zeros(BITS, np.int64)
    for k in range(0, n, 1 << 16):
        ones += np.unpackbits(h[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, size: int = SHINGLE_WORDS) -> DataFrame:
    """``doc_id, fp`` (signed 64-bit) of every row; a null or empty text has fingerprint 0."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(x or b"", size) for x in b.column(1).cast(pa.large_binary()).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])
        release()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, "doc_id long, fp long")


def flips(low_bits: int, weight: int) -> list[np.ndarray]:
    """XOR masks over the low bits, by number of bits set up to weight."""
    one = np.uint64(1) << np.arange(low_bits, dtype=np.uint64)
    out = [np.zeros(1, np.uint64)]
    for w in range(1, weight + 1):
        sets = np.array(list(combinations(range(low_bits), w)), np.int64).reshape(-1, w)
        out.append(np.bitwise_or.reduce(one[sets], axis=1) if len(sets) else np.zeros(0, np.uint64))
    return out


def forest(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Label of each of n nodes: the smallest node of its component under links u-v."""
    label = np.arange(n)
    while len(u):
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        while not np.array_equal(new[new], new):
            new = new[new]
        new = new[label]
        if np.array_equal(new, label):
            break
        label = new
        apart = label[u] != label[v]
        u, v = u[apart], v[apart]
    return label


def fingerprint_links(distinct: DataFrame, radius: int = RADIUS, per_slice: int = PER_SLICE) -> DataFrame:
    """Links ``a, b`` that connect all fingerprints within the radius; distinct has ``rep`` (a number each) and ``fp``."""
    n = distinct.count()
    top = min(24, max(4, (max(1, n) // per_slice).bit_length()))
    low = BITS - top
    # the unflipped masks and those that move a ball's part to a neighbouring slice, with the flips left there
    masks = [(int(m), radius // 2 - w) for w, ms in enumerate(flips(top, radius // 2)) for m in ms]
    table = F.array(*[F.struct(F.lit(m).alias("m"), F.lit(k).alias("left")) for m, k in masks])
    shared = distinct.select("rep", "fp", F.explode(table).alias("x")).select(F.shiftrightunsigned("fp", low).bitwiseXOR(F.col("x.m")).alias("slice"), "rep", "fp", F.col("x.m").alias("m"), F.col("x.left").alias("left"))

    def links(rows: pd.DataFrame) -> pd.DataFrame:
        if len(rows) < 2:
            return pd.DataFrame({"a": [], "b": []}, dtype=np.int64)
        rows = rows.sort_values("rep", kind="stable")
        rep, fp = rows["rep"].to_numpy(np.int64), rows["fp"].to_numpy(np.int64).view(np.uint64)
        moved = fp ^ (rows["m"].to_numpy(np.int64).astype(np.uint64) << np.uint64(low))
        # all of a slice share their moved top bits, so the low bits of moved and fp tell variants apart
        label = _labels(fp, moved, rows["left"].to_numpy(np.int64), low, radius)
        far = np.flatnonzero(label != np.arange(len(label)))
        return pd.DataFrame({"a": rep[far], "b": rep[label[far]]})

    return shared.groupBy("slice").applyInPandas(links, "a long, b long")


def _labels(fp: np.ndarray, moved: np.ndarray, left: np.ndarray, low: int, radius: int) -> np.ndarray:
    """Component label of each fingerprint of one slice.

    moved: the fingerprint with its top bits moved to the slice's; left: how many of the low bits may still be flipped.
    Variants are taken in as many rounds as keep their number bounded, whatever the slice holds.
    """
    masks = [np.concatenate(flips(low, k)) for k in range(radius // 2 + 1)]
    total = sum(int((left == k).sum()) * len(m) for k, m in enumerate(masks))
    rounds = 1 << max(0, -(-total // SORTED_AT_ONCE) - 1).bit_length()
    us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for r in range(rounds):
        variants, owners = [], []
        for k, m in enumerate(masks):
            own = np.flatnonzero(left == k)
            for at in range(0, len(own), 512):
                block = own[at : at + 512]
                x = (moved[block][:, None] ^ m[None, :]).ravel()
                o = np.repeat(block, len(m))
                if rounds > 1:
                    here = ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(rounds) == r
                    x, o = x[here], o[here]
                variants.append(x)
                owners.append(o)
        x, o = np.concatenate(variants), np.concatenate(owners)
        order = np.argsort(x)
        x, o = x[order], o[order]
        same = np.flatnonzero(x[1:] == x[:-1])
        a, b = o[same], o[same + 1]
        near = np.bitwise_count(fp[a] ^ fp[b]) <= radius
        pair = np.unique(np.minimum(a[near], b[near]) * len(fp) + np.maximum(a[near], b[near]))
        us.append(pair // len(fp))
        vs.append(pair % len(fp))
    return forest(len(fp), np.concatenate(us), np.concatenate(vs))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, size: int = SHINGLE_WORDS) -> DataFrame:
    """``doc_id, fp, component_id`` of every row; component_id is the smallest doc_id reachable by links.

    Rows that share a doc_id are told apart by their text only. A null doc_id never names a component: such a row gets
    that of the other rows with its fingerprint, else null. Other columns of docs play no part.
    """
    fps = written(fingerprints(docs, size), "fingerprints")
    distinct = written(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct")
    linked = written(fingerprint_links(distinct.where("rep is not null"), radius), "links")
    found = components(linked)
    labelled = distinct.join(found, F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return fps.join(labelled, "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, radius: int = RADIUS, size: int = SHINGLE_WORDS) -> DataFrame:
    """docs with only the smallest doc_id of each near-duplicate group; columns as they are.

    Repeated doc_ids: one of the rows stays. Rows with a null doc_id stay.
    """
    found = near_duplicates(docs, radius, size).where("doc_id is not null")
    # all but the doc_ids of which just one row is a group's smallest
    unlike = found.groupBy("doc_id").agg(F.count_if(F.col("doc_id") == F.col("component_id")).alias("n")).where("n <> 1")
    unlike = written(unlike.select(F.col("doc_id").alias("__gone"), "n"), "unlike")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    # only rows that may go are shuffled
    packed = marked(docs.select(row, F.col("doc_id").cast("long").alias("__id")).where("__id is not null"), again(unlike).where("n = 0").select(F.col("__gone").alias("__id")), "__id", "hit")
    stay = packed.where("hit").join(unlike.where("n = 0"), F.col("__id") == F.col("__gone"), "left_anti")
    out = packed.where("not hit").union(stay).select("row.*")
    if unlike.where("n > 1").limit(1).count():
        out = out.dropDuplicates(["doc_id"])
    return out.union(docs.where("doc_id is null"))
