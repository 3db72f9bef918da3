"""Plane geometry on rings: arrays of struct<x,y>, closed or not, kept as columns.

Measures and point tests are column expressions; clipping, WKB and repair run in Arrow-batched pandas UDFs.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

RING = "array<struct<x:double,y:double>>"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Counter-clockwise ring of an axis-aligned box."""
    return F.array(*[F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))])


def constant(points: list[tuple[float, float]]) -> Column:
    """A literal ring."""
    return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in points])


def _next(ring: Column, i: Column) -> Column:
    return F.get(ring, (i + 1) % F.size(ring))


def _sum_edges(ring: Column, term) -> Column:
    i = F.sequence(F.lit(0), F.greatest(F.size(ring) - 1, F.lit(0)))
    return F.aggregate(i, F.lit(0.0), lambda a, k: a + term(F.get(ring, k), _next(ring, k)))


def signed_area(ring: str | Column) -> Column:
    r = _col(ring)
    return F.when(F.size(r) >= 3, _sum_edges(r, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]) / 2).otherwise(F.lit(0.0))


def area(ring: str | Column) -> Column:
    return F.abs(signed_area(ring))


def centroid(ring: str | Column) -> Column:
    r = _col(ring)
    a = signed_area(r) * 6
    cross = lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]
    x = _sum_edges(r, lambda p, q: (p["x"] + q["x"]) * cross(p, q))
    y = _sum_edges(r, lambda p, q: (p["y"] + q["y"]) * cross(p, q))
    return F.struct(F.try_divide(x, a).alias("x"), F.try_divide(y, a).alias("y"))


def bounds(ring: str | Column) -> Column:
    r = _col(ring)
    xs, ys = F.transform(r, lambda p: p["x"]), F.transform(r, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def is_box(ring: str | Column, b: str | Column) -> Column:
    """Is the ring an axis-aligned box, its bounds b? Four corners of the bounds, each once."""
    r, b = _col(ring), _col(b)
    corners = F.transform(r, lambda p: F.when((p["x"] == b["x0"]) & (p["y"] == b["y0"]), 1).when((p["x"] == b["x1"]) & (p["y"] == b["y0"]), 2).when((p["x"] == b["x1"]) & (p["y"] == b["y1"]), 3).when((p["x"] == b["x0"]) & (p["y"] == b["y1"]), 4).otherwise(0))
    way = F.array_join(corners.cast("array<string>"), "")
    return F.coalesce((b["x0"] < b["x1"]) & (b["y0"] < b["y1"]) & F.size(r).isin(4, 5) & F.lit("12341234 43214321").contains(way), F.lit(False))


def _edges(ring: Column) -> Column:
    i = F.sequence(F.lit(0), F.greatest(F.size(ring) - 1, F.lit(0)))
    return F.transform(i, lambda k: F.struct(F.get(ring, k).alias("p"), _next(ring, k).alias("q")))


def _to_edge(p: Column, e: Column) -> Column:
    """Squared distance of a point to an edge."""
    dx, dy = e["q"]["x"] - e["p"]["x"], e["q"]["y"] - e["p"]["y"]
    along = (p["x"] - e["p"]["x"]) * dx + (p["y"] - e["p"]["y"]) * dy
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(along, dx * dx + dy * dy), F.lit(0.0))))
    return F.pow(e["p"]["x"] + t * dx - p["x"], 2) + F.pow(e["p"]["y"] + t * dy - p["y"], 2)


def distance(a: str | Column, b: str | Column) -> Column:
    """Distance of two polygons: 0 where they meet or one holds the other (b convex), else that of their boundaries."""
    ra, rb = _col(a), _col(b)
    least = lambda points, edges: F.array_min(F.flatten(F.transform(points, lambda p: F.transform(edges, lambda e: _to_edge(p, e)))))
    apart = F.least(least(ra, _edges(rb)), least(rb, _edges(ra)))
    return F.when(touches(ra, rb), 0.0).otherwise(F.sqrt(apart))


def contains(ring: str | Column, x: Column, y: Column) -> Column:
    """Is the point in the ring or on its boundary? Ray casting, and a test of each edge."""
    r = _col(ring)
    i = F.sequence(F.lit(0), F.greatest(F.size(r) - 1, F.lit(0)))

    def on(k: Column) -> Column:
        p, q = F.get(r, k), _next(r, k)
        cross = (q["x"] - p["x"]) * (y - p["y"]) - (q["y"] - p["y"]) * (x - p["x"])
        return (F.abs(cross) <= 1e-12) & (x >= F.least(p["x"], q["x"])) & (x <= F.greatest(p["x"], q["x"])) & (y >= F.least(p["y"], q["y"])) & (y <= F.greatest(p["y"], q["y"]))

    def crossed(k: Column) -> Column:
        p, q = F.get(r, k), _next(r, k)
        return ((p["y"] > y) != (q["y"] > y)) & (x < p["x"] + F.try_divide((y - p["y"]) * (q["x"] - p["x"]), q["y"] - p["y"]))

    return F.exists(i, on) | (F.size(F.filter(i, crossed)) % 2 == 1)


def segmentize(ring: str | Column, step: float) -> Column:
    """The ring with points at most step apart."""
    r = _col(ring)

    def split(k: Column) -> Column:
        p, q = F.get(r, k), _next(r, k)
        n = F.greatest(F.ceil(F.hypot(q["x"] - p["x"], q["y"] - p["y"]) / step), F.lit(1)).cast("int")
        return F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.struct((p["x"] + (q["x"] - p["x"]) * j / n).alias("x"), (p["y"] + (q["y"] - p["y"]) * j / n).alias("y")))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(r) - 1), split))


def points_of(ring) -> np.ndarray:
    out = np.array([(p["x"], p["y"]) for p in ring], float).reshape(-1, 2) if ring is not None else np.zeros((0, 2))
    return out[:-1] if len(out) > 1 and (out[0] == out[-1]).all() else out


def rows_of(points: np.ndarray) -> list[dict]:
    return [{"x": float(x), "y": float(y)} for x, y in points]


def clip_ring(subject: np.ndarray, window: np.ndarray) -> np.ndarray:
    """Part of subject inside the convex window, edge by edge."""
    def turn(p, q):
        return p[0] * q[1] - p[1] * q[0]

    if len(subject) < 3 or len(window) < 3:
        return np.zeros((0, 2))
    if sum(turn(window[k - 1], window[k]) for k in range(len(window))) < 0:
        window = window[::-1]
    poly = [tuple(p) for p in subject]
    for k in range(len(window)):
        a, b = window[k - 1], window[k]
        side = [(b[0] - a[0]) * (y - a[1]) - (b[1] - a[1]) * (x - a[0]) for x, y in poly]
        out = []
        for j in range(len(poly)):
            s0, s1 = side[j - 1], side[j]
            if (s0 >= 0) != (s1 >= 0):
                t = s0 / (s0 - s1)
                (x0, y0), (x1, y1) = poly[j - 1], poly[j]
                out.append((x0 + t * (x1 - x0), y0 + t * (y1 - y0)))
            if s1 >= 0:
                out.append(poly[j])
        poly = out
        if not poly:
            break
    return np.array(poly, float).reshape(-1, 2)


def _padded(rings) -> tuple[np.ndarray, np.ndarray]:
    """Corners of an Arrow array of rings as (rows, corners, 2), padded, and their number; a closing corner is dropped."""
    n = np.array(rings.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    flat = rings.flatten()
    points = np.stack([flat.field(f).to_numpy(zero_copy_only=False) for f in ("x", "y")], 1) if len(flat) else np.zeros((0, 2))
    out = np.zeros((len(n), max(1, int(n.max(initial=0))), 2))
    out[np.arange(out.shape[1])[None, :] < n[:, None]] = points
    last = np.take_along_axis(out, np.maximum(n - 1, 0)[:, None, None], 1)[:, 0]
    return out, n - ((n > 1) & (last == out[:, 0]).all(1))


def clip_many(p: np.ndarray, n: np.ndarray, w: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``clip_ring`` of all rows at once, on padded corners: each step cuts every row by one edge of its window."""
    n, m = np.where((n >= 3) & (m >= 3), n, 0), np.where(n >= 3, m, 0)
    at = np.arange(w.shape[1])[None, :]
    nxt = np.take_along_axis(w, np.where(at + 1 < m[:, None], at + 1, 0)[:, :, None], 1)
    turn = np.where(at < m[:, None], w[:, :, 0] * nxt[:, :, 1] - nxt[:, :, 0] * w[:, :, 1], 0).sum(1)
    way = np.where(turn < 0, -1.0, 1.0)[:, None]
    for k in range(w.shape[1]):
        a, b, live = w[:, k, None], nxt[:, k, None], (k < m)[:, None]
        valid = np.arange(p.shape[1])[None, :] < n[:, None]
        side = way * ((b[:, :, 0] - a[:, :, 0]) * (p[:, :, 1] - a[:, :, 1]) - (b[:, :, 1] - a[:, :, 1]) * (p[:, :, 0] - a[:, :, 0]))
        j = np.arange(p.shape[1])[None, :]
        before = np.where(j > 0, j - 1, np.maximum(n - 1, 0)[:, None])
        q, s0 = np.take_along_axis(p, before[:, :, None], 1), np.take_along_axis(side, before, 1)
        inside, was = side >= 0, s0 >= 0
        cross = valid & live & (inside != was)
        t = np.where(cross, s0 / np.where(cross, s0 - side, 1.0), 0.0)[:, :, None]
        both = np.stack([q + t * (p - q), p], 2)
        keep = np.stack([cross, valid & (inside | ~live)], 2)
        n = keep.sum((1, 2))
        new = np.zeros((len(n), max(1, int(n.max(initial=0))), 2))
        new[np.arange(new.shape[1])[None, :] < n[:, None]] = both[keep]
        p = new
    return p, n


def clip(subject: str | Column, window: str | Column) -> Column:
    """The part of a ring inside a convex one; an empty ring where there is none."""
    @F.arrow_udf(RING)
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        p, n = clip_many(*_padded(a), *_padded(b))
        points = p[np.arange(p.shape[1])[None, :] < n[:, None]]
        corners = pa.StructArray.from_arrays([pa.array(points[:, 0]), pa.array(points[:, 1])], ["x", "y"])
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), corners)

    return run(_col(subject), _col(window))


def touches(a: str | Column, b: str | Column) -> Column:
    """Do two rings (b convex) share a point?"""
    @F.arrow_udf("boolean")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array(clip_many(*_padded(a), *_padded(b))[1] > 0)

    return run(_col(a), _col(b))


def wkb_bytes(points: np.ndarray) -> bytes:
    closed = np.vstack([points, points[:1]]) if len(points) else points
    return struct.pack("<BIII", 1, 3, 1, len(closed)) + closed.astype("<f8").tobytes()


def wkb_points(raw: bytes | None) -> np.ndarray | None:
    """Outer ring of a WKB polygon, or of a multipolygon's largest member; None for anything else."""
    if raw is None or len(raw) < 5:
        return None

    def at(o: int):
        e = "<" if raw[o] == 1 else ">"
        kind = struct.unpack_from(e + "I", raw, o + 1)[0]
        o += 9 if kind & 0x20000000 else 5
        return e, kind & 0xFF, o

    def polygon(e: str, o: int):
        n = struct.unpack_from(e + "I", raw, o)[0]
        o += 4
        first = None
        for _ in range(n):
            m = struct.unpack_from(e + "I", raw, o)[0]
            ring = np.frombuffer(raw, e + "f8", 2 * m, o + 4).reshape(-1, 2)
            o += 4 + 16 * m
            first = ring if first is None else first
        return first, o

    e, kind, o = at(0)
    if kind == 3:
        return polygon(e, o)[0]
    if kind == 6:
        n, o, best, most = struct.unpack_from(e + "I", raw, o)[0], o + 4, None, -1.0
        for _ in range(n):
            e2, _, o = at(o)
            ring, o = polygon(e2, o)
            size = abs(float((ring[:-1, 0] * ring[1:, 1] - ring[1:, 0] * ring[:-1, 1]).sum())) if ring is not None else 0
            if size > most:
                best, most = ring, size
        return best
    return None


def to_wkb(ring: str | Column) -> Column:
    @F.pandas_udf("binary")
    def run(rings: pd.Series) -> pd.Series:
        return pd.Series([None if r is None else wkb_bytes(points_of(r)) for r in rings])

    return run(_col(ring))


def from_wkb(raw: str | Column) -> Column:
    @F.pandas_udf(RING)
    def run(raws: pd.Series) -> pd.Series:
        found = [wkb_points(r) for r in raws]
        return pd.Series([None if p is None else rows_of(p[:-1] if len(p) > 1 and (p[0] == p[-1]).all() else p) for p in found])

    return run(_col(raw))


def is_simple(points: np.ndarray) -> bool:
    """At least three corners, some area, and no two edges that cross."""
    n = len(points)
    if n < 3 or not np.isfinite(points).all():
        return False
    area2 = sum(points[k - 1][0] * points[k][1] - points[k][0] * points[k - 1][1] for k in range(n))
    if area2 == 0:
        return False
    side = lambda a, b, c: np.sign((b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0]))
    for i in range(n):
        for j in range(i + 2, n):
            if i == 0 and j == n - 1:
                continue
            a, b, c, d = points[i], points[(i + 1) % n], points[j], points[(j + 1) % n]
            if side(a, b, c) * side(a, b, d) < 0 and side(c, d, a) * side(c, d, b) < 0:
                return False
    return True


def valid_ring(ring: str | Column) -> Column:
    @F.pandas_udf("boolean")
    def run(rings: pd.Series) -> pd.Series:
        return pd.Series([r is not None and is_simple(points_of(r)) for r in rings])

    return run(_col(ring))


def simplify_line(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas-Peucker with an explicit stack; both ends stay."""
    keep = np.zeros(len(points), bool)
    if len(points):
        keep[[0, -1]] = True
    todo = [(0, len(points) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        d = points[b] - points[a]
        n = float(np.hypot(*d))
        rel = points[a + 1 : b] - points[a]
        off = np.abs(d[0] * rel[:, 1] - d[1] * rel[:, 0]) / n if n else np.hypot(rel[:, 0], rel[:, 1])
        k = int(np.argmax(off))
        if off[k] > tolerance:
            keep[a + 1 + k] = True
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    return points[keep]
