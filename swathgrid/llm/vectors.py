"""Embedding near-dedup with an inverted multi-index (Babenko & Lempitsky, 2012).

Codebooks for the two halves of the unit vectors are fitted apart; their product is a grid of cells, and each vector is
indexed in the cell of its nearest centroids. A query visits cells in ascending order of the least squared distance that a
vector in them can have from it (sum over halves of the squared distance to the bisecting plane) until that exceeds a share,
``REACH``, of the radius of the cosine threshold: at 1 no link can be missed, and no cap is needed. Visits are verified by
the cosine itself, in blocks of bounded size; a block gives link counts and a spanning forest of its links, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import again, components, written
from .simhash import forest

THRESHOLD = 0.98
#: Vectors that the codebooks are fitted on at most (those with the least hash of their id).
SAMPLE = 16384
#: Distinct vectors of the largest label per cell that the codebooks' size aims at, and centroids of a half at most.
PER_CELL, CENTROIDS = 200, 1024
#: Planes of so many nearest centroids bound a distance.
PLANES = 24
#: Only a difference that points straight at a plane needs the whole radius; spread over 32 dimensions one reaches a fifth
#: of it. Links of 400 vectors of each of the check tool's tables needed 0.15 at most.
REACH = 0.5
#: Members and visitors compared in one block.
MEMBERS, VISITORS = 2048, 4096


def unit(rows: list | np.ndarray) -> np.ndarray:
    x = np.array([np.asarray(r, np.float64) for r in rows], np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def codebook(x: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """k-means centroids (Lloyd); fewer where there are fewer distinct points."""
    distinct = np.unique(x, axis=0)
    rng = np.random.default_rng(seed)
    c = distinct[rng.permutation(len(distinct))[:k]]
    for _ in range(rounds):
        near = ((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None, :]).argmin(1)
        for i in range(len(c)):
            if (own := near == i).any():
                c[i] = x[own].mean(0)
    return np.unique(c, axis=0)


def bounds(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid of each row and, per centroid, the least squared distance to any point of its cell."""
    sizes = (c * c).sum(1)
    d = np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + sizes[None, :], 0)
    apart = np.sqrt(np.maximum(sizes[:, None] - 2 * c @ c.T + sizes[None, :], 1e-30))
    low = np.zeros_like(d)
    rows = np.arange(len(x))
    for k in np.argsort(d, axis=1, kind="stable")[:, :PLANES].T:  # beyond the plane between k and i lies all of cell i
        low = np.maximum(low, (d - d[rows, k][:, None]) / (2 * apart[k]))
    return d.argmin(1), low * low


def visits(low1: np.ndarray, low2: np.ndarray, radius2: float) -> list[tuple[int, int]]:
    """Cells of one query in ascending order of their bound, up to the radius (multi-sequence traversal)."""
    import heapq

    o1, o2 = np.argsort(low1, kind="stable"), np.argsort(low2, kind="stable")
    a, b = low1[o1], low2[o2]
    out, heap, seen = [], [(a[0] + b[0], 0, 0)], {(0, 0)}
    while heap:
        bound, i, j = heapq.heappop(heap)
        if bound > radius2:
            break
        out.append((int(o1[i]), int(o2[j])))
        for p in ((i + 1, j), (i, j + 1)):
            if p[0] < len(a) and p[1] < len(b) and p not in seen:
                seen.add(p)
                heapq.heappush(heap, (a[p[0]] + b[p[1]], *p))
    return out


def fit(sample: list, n: int, per_cell: int = PER_CELL) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Codebooks by dimension; the grid has about n / per_cell cells."""
    k = int(np.clip(round(np.sqrt(max(1, n) / per_cell)), 1, CENTROIDS))
    books = {}
    for dim in {len(v) for v in sample}:
        x = unit([v for v in sample if len(v) == dim])
        half = dim // 2
        books[dim] = (codebook(x[:, :half], k) if half else np.zeros((1, 0)), codebook(x[:, half:], k))
    return books


def _usable(v: str) -> str:
    return f"{v} is not null and size({v}) > 0 and forall({v}, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists({v}, x -> x <> 0)"


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE, per_cell: int = PER_CELL, reach: float = REACH) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every vector of ``vec_id, embedding, label``.

    Vectors link when their labels are equal and not null and their cosine, in double precision, is at least the threshold.
    Null or zero vectors, those with null or non-finite components, and rows with a null label link with nothing; vectors
    of different length do not link. Equal vectors are indexed once, with their number. An empty table gives no rows.
    A row with a null vec_id links with nothing, has no component and is not kept; rows that share a vec_id but not the
    vector are one node. Other columns play no part. ``reach`` 1 visits every cell that can hold a link; less, fewer.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")
    good = F.expr(f"vec_id is not null and label is not null and {_usable('embedding')}")
    distinct = written(rows.where(good).groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "vectors")
    n = distinct.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    taken = distinct.orderBy(F.xxhash64("rep"), "rep").limit(sample).select("embedding").collect()  # bounded by the limit
    books = spark.sparkContext.broadcast(fit([r.embedding for r in taken], n, per_cell))  # at most 2 x CENTROIDS by dimension
    radius2 = (2 - 2 * threshold) * reach**2 + 1e-9

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            sizes = pdf["embedding"].map(len)
            for dim, own in pdf.groupby(sizes):
                x = unit(own["embedding"].tolist())
                book = books.value.get(dim) or (np.zeros((1, dim // 2)), np.zeros((1, dim - dim // 2)))
                (h1, l1), (h2, l2) = bounds(x[:, : dim // 2], book[0]), bounds(x[:, dim // 2 :], book[1])
                cells = [[f"{dim}/{i}/{j}" for i, j in visits(a, b, radius2)] for a, b in zip(l1, l2)]
                home = [f"{dim}/{i}/{j}" for i, j in zip(h1, h2)]
                out.append(own.assign(home=home, cells=cells))
            yield pd.concat(out) if out else pdf.assign(home="", cells=None)

    kind = distinct.schema["embedding"].dataType.simpleString()
    label = distinct.schema["label"].dataType.simpleString()
    placed = written(distinct.select("label", "embedding", "rep", "copies").mapInPandas(index, f"label {label}, embedding {kind}, rep long, copies long, home string, cells array<string>"), "placed")
    members = placed.groupBy("label", F.col("home").alias("cell")).agg(F.count("*").alias("m"))
    visitors = placed.select("label", F.explode("cells").alias("cell")).groupBy("label", "cell").agg(F.count("*").alias("v"))
    cuts = written(members.join(visitors, ["label", "cell"]).select("label", "cell", F.ceil(F.col("m") / MEMBERS).cast("int").alias("mc"), F.ceil(F.col("v") / VISITORS).cast("int").alias("vc")), "cuts")
    salt = lambda by, seed: F.pmod(F.xxhash64("rep", F.lit(seed)), F.col(by)).cast("int")
    left = placed.select("label", F.col("home").alias("cell"), "rep", "copies", "embedding").join(cuts, ["label", "cell"])
    left = left.select("label", "cell", salt("mc", 1).alias("i"), F.explode(F.sequence(F.lit(0), F.col("vc") - 1)).alias("j"), "rep", "copies", "embedding")
    right = again(placed).select("label", F.explode("cells").alias("cell"), "rep", "embedding").join(again(cuts), ["label", "cell"])
    right = right.select("label", "cell", F.explode(F.sequence(F.lit(0), F.col("mc") - 1)).alias("i"), salt("vc", 2).alias("j"), "rep", "embedding")
    keys = ["label", "cell", "i", "j"]

    def compare(m: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        if not len(m) or not len(v):
            return pd.DataFrame({"a": [], "b": [], "n": []}, dtype=np.int64)
        m, v = m.sort_values("rep"), v.sort_values("rep")
        xm, xv = unit(m["embedding"].tolist()), unit(v["embedding"].tolist())
        rm, rv, copies = m["rep"].to_numpy(), v["rep"].to_numpy(), m["copies"].to_numpy()
        ids = np.unique(np.concatenate([rm, rv]))
        counts, label = np.zeros(len(v), np.int64), np.arange(len(ids))
        at_m, at_v = np.searchsorted(ids, rm), np.searchsorted(ids, rv)
        for k in range(0, len(v), 512):
            near = (xv[k : k + 512] @ xm.T >= threshold) & (rv[k : k + 512, None] != rm[None, :])
            counts[k : k + 512] = near @ copies
            a, b = np.nonzero(near)
            label = forest(len(ids), np.concatenate([np.arange(len(ids)), at_v[k + a]]), np.concatenate([label, at_m[b]]))
        own = counts > 0
        far = np.flatnonzero(label != np.arange(len(ids)))
        return pd.DataFrame({"a": np.concatenate([rv[own], ids[far]]), "b": np.concatenate([rv[own], ids[label[far]]]), "n": np.concatenate([counts[own], np.zeros(len(far), np.int64)])})

    found = written(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(compare, "a long, b long, n long"), "links")
    counts = found.where("n > 0").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    linked = components(found.where("n = 0").select("a", "b"))
    known = distinct.join(counts, "rep", "left").join(linked, F.col("rep") == F.col("node"), "left")
    known = known.select("label", "embedding", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = rows.where(good).join(known, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    out = out.union(rows.where(~F.coalesce(good, F.lit(False))).select("vec_id", F.lit(0).cast("long"), "vec_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
