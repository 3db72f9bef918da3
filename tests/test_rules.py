"""Edge rules on literal rows."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from swathgrid.functions import bins, geometry, predicates, projection, tides, timeparts
from swathgrid.operators import captures, gaps, grids, joins, rollup
from swathgrid.plans import analyses

XS = [-1.0, 0.0, 0.5, 1.0, 1.5, 2.0, 4.0, 9.0]


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def numbers(spark, xs, name="x"):
    return spark.createDataFrame([(x,) for x in xs], f"{name} double")


def t(text):
    return dt.datetime.fromisoformat(text)


def test_right_closed_histogram(spark):
    got = {r.upper: r.n for r in bins.histogram(numbers(spark, XS + [None]), F.col("x"), [0, 1, 2, 4]).collect()}
    assert got == {0.0: 2, 1.0: 2, 2.0: 2, 4.0: 1, math.inf: 1}
    assert bins.histogram_map(numbers(spark, XS), F.col("x"), [0, 1, 2, 4]).first().bucket == got
    assert bins.histogram_map(numbers(spark, []), F.col("x"), [0, 1]).first().bucket is None
    assert {r.upper: r.n for r in bins.histogram(numbers(spark, [0.5]), F.col("x"), [0, 1]).collect()} == {0.0: 0, 1.0: 1}


def test_left_closed_histogram(spark):
    rows = bins.left_closed(numbers(spark, XS + [None, float("nan")]), F.col("x"), [0, 1, 2, 4]).orderBy("bin").collect()
    assert [r.n for r in rows] == np.histogram(XS, [0, 1, 2, 4])[0].tolist()


def test_nice_edges_and_spaces():
    assert bins.nice_edges(0, 10.3, 5)[-1] >= 10.3 and len(bins.nice_edges(0, 100, 5)) == 5
    assert np.allclose(bins.linspace(0, 1, 5), np.linspace(0, 1, 5)) and np.allclose(bins.logspace(1, 100, 5), np.logspace(0, 2, 5))


def test_left_index_and_km_bin(spark):
    edges = F.array(F.lit(-1.0), F.lit(0.0), F.lit(1.0))
    at = lambda v, e=edges: bins.left_index(F.lit(v).cast("double"), e)
    r = one(spark, below=at(-2.0), on=at(0.0), top=at(5.0), null=at(None), no_edges=at(1.0, F.lit(None).cast("array<double>")), k0=bins.km_bin(F.lit(0.0)), k1=bins.km_bin(F.lit(1.0)), k2=bins.km_bin(F.lit(1.2)))
    assert tuple(r) == (-1, 1, 2, -1, -1, None, 0, 1)


def test_smoothing(spark):
    counts = [0, 0, 4, 0, 0, 2, 1] + [0] * 20
    got = one(spark, d=bins.smooth(F.array(*[F.lit(c) for c in counts]), taps=5)).d
    w = np.exp(-np.linspace(-3, 3, 5) ** 2 / 2)
    want = np.convolve(counts, w / w.sum(), mode="same")
    assert np.allclose(got, want / want.sum())


SCENE = "grid_id long, id string, satellite_id long, acquired timestamp_ntz, solar_time timestamp_ntz, item_type string, coverage_pct double, clear_percent double, publishing_stage string, quality_category string, has_sr_asset boolean, ground_control boolean"


def scenes(spark, *rows):
    return spark.createDataFrame([(g, i, s, t(a), t(a), "PSScene", 1.0, c, p, "standard", True, True) for g, i, s, a, c, p in rows], SCENE)


def test_gap_markers(spark):
    df = scenes(spark, (1, "a", 1, "2023-01-01T05:00", 90.0, "finalized"), (1, "b", 1, "2023-07-01T00:00", 90.0, "finalized"), (1, "c", 1, "2024-01-01T00:00", 90.0, "finalized"), (2, "d", 1, "2023-03-01T00:00", 90.0, "finalized"))
    g = gaps.solar_day_gaps(df, 2023)
    by = {}
    for r in g.collect():
        by.setdefault(r.grid_id, []).append(r.gap)
    assert sorted(by[1]) == [0.0, 0.0, 181.0, 184.0] and sum(by[2]) == 365.0
    p = {r.grid_id: r.sample_count for r in gaps.day_gap_percentile(g, 90).collect()}
    assert p == {1: 3, 2: 1}
    dims = spark.createDataFrame([(1, 7), (2, 8)], "grid_id long, hex_id long")
    assert {r.hex_id: r.median_gap for r in analyses.hex_gaps(df, dims, 2023, 50, False).collect()} == {7: 90.5, 8: None}


def test_closures(spark):
    ends = spark.createDataFrame([(t("2023-01-01"),), (t("2024-01-01"),)], "a timestamp_ntz")
    assert [ends.where(predicates.in_year("a", 2023, c)).count() for c in predicates.Closed] == [2, 1, 0]


def test_valid_and_null_land(spark):
    dims = spark.createDataFrame([(1, None, 3.0), (2, False, 3.0), (3, False, None), (4, True, 1.0), (5, False, 20.0)], "grid_id long, is_land boolean, dist_km double")
    assert [r.grid_id for r in dims.where(predicates.near_shore(20)).collect()] == [2]
    df = scenes(spark, (1, "a", 1, "2023-01-01", 75.0, "finalized"), (1, "b", 1, "2023-01-01", 76.0, "finalized"), (1, "c", 1, "2023-01-01", 76.0, "preview"))
    assert [r.id for r in df.where(predicates.valid()).collect()] == ["b"] and df.where(predicates.valid(75.0, at_least=True)).count() == 2


def test_sessions_and_best(spark):
    df = scenes(spark, (1, "a", 1, "2023-01-01T00:00", 10.0, "preview"), (1, "b", 1, "2023-01-01T04:00", 90.0, "standard"), (1, "c", 1, "2023-01-01T08:00:01", 50.0, "finalized"), (1, "d", 1, "2023-01-01T09:00", 60.0, "finalized"))
    assert {r.id: r.session for r in captures.sessions(df, ["grid_id"], "acquired", 4).collect()} == {"a": 1, "b": 1, "c": 2, "d": 2}
    assert sorted(r.id for r in captures.best_captures(df, ["grid_id"], 4).collect()) == ["b", "d"]


def test_asof(spark):
    left = spark.createDataFrame([(1, "l1", t("2023-01-01T10:00")), (1, "l2", t("2023-01-01T12:00")), (2, "l3", t("2023-01-01T10:00")), (1, "l4", t("2023-01-02T10:00"))], "k long, id string, acquired timestamp_ntz")
    right = spark.createDataFrame([(1, "r1", t("2023-01-01T09:30")), (1, "r2", t("2023-01-01T10:00")), (1, "r3", t("2023-01-01T12:30"))], "k long, id_s string, acquired_s timestamp_ntz")
    back = {r.id: r.id_s for r in joins.asof(left, right, ["k"], "acquired", "acquired_s", 7200).collect()}
    ahead = {r.id: r.id_s for r in joins.asof(left, right, ["k"], "acquired", "acquired_s", 7200, forward=True).collect()}
    assert back == {"l1": "r2", "l2": "r2", "l3": None, "l4": None} and ahead == {"l1": "r2", "l2": "r3", "l3": None, "l4": None}
    both = sorted((r.id, r.id_s or "") for r in joins.asof_both(left, right, ["k"], "acquired", "acquired_s", 7200, "id", "id_s").collect())
    assert both == [("l1", "r2"), ("l2", "r2"), ("l2", "r3"), ("l3", ""), ("l4", "")]
    exact = {(r.id, r.id_s) for r in joins.band(left, right, ["k"], "acquired", "acquired_s", 1800).collect()}
    assert exact == {("l1", "r1"), ("l1", "r2"), ("l2", "r3")}


def test_time_of_day(spark):
    row = spark.createDataFrame([(t("2023-01-01T23:59:30"), t("2023-01-02T00:00:30"))], "a timestamp_ntz, b timestamp_ntz")
    assert row.select(timeparts.circular_seconds(timeparts.seconds_of_day("a"), timeparts.seconds_of_day("b"))).first()[0] == 60
    r = row.select(timeparts.epoch("a"), timeparts.fiscal_year(F.lit("2023-12-01").cast("timestamp_ntz")), timeparts.iso_utc("a"), timeparts.parse_iso(F.lit("2023-01-01T10:00:00.5Z")), timeparts.parse_iso(F.lit("never"), lenient=True)).first()
    assert tuple(r) == (1672617570.0, 2024, "2023-01-01T23:59:30.000000Z", t("2023-01-01T10:00:00.500"), None)


def test_equation_of_time(spark):
    # Published equation of time at noon UTC, minutes.
    for day, minutes in (("2023-02-11", -14.2), ("2023-05-14", 3.7), ("2023-07-26", -6.5), ("2023-11-03", 16.4)):
        got = one(spark, m=timeparts.equation_of_time(F.lit(f"{day} 12:00:00").cast("timestamp_ntz"))).m
        assert abs(got - minutes) < 0.6
    at = one(spark, s=timeparts.solar_time(F.lit("2023-04-15 12:00:00").cast("timestamp_ntz"), F.lit(30.0))).s
    assert abs((at - t("2023-04-15T14:00")).total_seconds()) < 40


def boxes(spark, rows, key):
    df = spark.createDataFrame(rows, f"{key} long, a double, b double, c double, d double")
    return df.select(key, geometry.box(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("ring"))


def test_assignment(spark):
    cells = boxes(spark, [(5, 0.0, 0.0, 1.0, 1.0), (3, 1.0, 0.0, 2.0, 1.0), (9, 10.0, 10.0, 11.0, 11.0)], "cell")
    items = boxes(spark, [(1, 0.5, 0.0, 1.5, 1.0), (2, 0.2, 0.2, 1.1, 0.9), (3, 8.0, 10.0, 9.0, 11.0), (4, 50.0, 50.0, 51.0, 51.0)], "item")
    assert {r.item: r.cell for r in joins.assign(items, cells, "item", "cell", limit=3.0).collect()} == {1: 3, 2: 5, 3: 9, 4: -1}
    assert {r.item: r.cell for r in joins.intersects(items, cells, "item", "cell", keep_left=True).collect() if r.item > 2} == {3: None, 4: None}


def test_nearest_ties(spark):
    pts = lambda rows, k: spark.createDataFrame(rows, f"{k} long, x double, y double")
    left, right = pts([(1, 0.0, 0.0)], "a"), pts([(7, 1.0, 0.0), (4, 0.0, 1.0), (2, 9.0, 9.0)], "b")
    assert joins.nearest(left, right, "a", "b", 2.0).first().b == 4
    assert {r.b for r in joins.nearest(left, right, "a", "b", 2.0, ties=True).collect()} == {4, 7}


def test_layers_lines_and_regions(spark):
    pts = spark.createDataFrame([(1, 0.5, 0.5), (2, 5.5, 5.5), (3, 2.0, 0.2)], "id long, x double, y double")
    layers = [boxes(spark, [(1, 0.0, 0.0, 1.0, 1.0)], "k"), boxes(spark, [(2, 5.0, 5.0, 6.0, 6.0), (3, 0.0, 0.0, 0.6, 0.6)], "k")]
    assert sorted(r.id for r in joins.within_any(pts, layers, "id", "k").collect()) == [1, 2]
    near = {r.id: r.dist for r in joins.distance_to_lines(pts, layers[0], "id", 0.25, 2.0).collect()}
    assert set(near) == {1, 3} and near[1] == 0.5 and abs(near[3] - math.hypot(1.0, 0.05)) < 1e-9
    assert [r.id for r in joins.outside(pts, [(0, 0), (3, 0), (3, 3), (0, 3)]).collect()] == [2]


def test_clip_and_measures(spark):
    star = np.array([(0, 0), (4, 0), (4, 4), (2, 1), (0, 4)], float)
    got = geometry.clip_ring(star, np.array([(1, 0), (3, 0), (3, 3), (1, 3)], float))
    x, y = got[:, 0], got[:, 1]
    inside = abs((x * np.roll(y, -1) - np.roll(x, -1) * y).sum()) / 2
    assert abs(inside - 3.5) < 1e-9  # by integration of min(3, edge) between x = 1 and 3
    ring = F.array(*[F.struct(F.lit(float(a)).alias("x"), F.lit(float(b)).alias("y")) for a, b in star])
    r = one(spark, area=geometry.area(ring), inn=geometry.contains(ring, F.lit(0.5), F.lit(0.5)), out=geometry.contains(ring, F.lit(2.0), F.lit(3.0)), edge=geometry.contains(ring, F.lit(2.0), F.lit(0.0)), n=F.size(geometry.segmentize(ring, 1.0)))
    assert abs(r.area - 10) < 1e-9 and (r.inn, r.out, r.edge) == (True, False, True) and r.n > 12
    assert geometry.is_simple(star) and not geometry.is_simple(np.array([(0, 0), (1, 1), (1, 0), (0, 1)], float))
    assert (geometry.wkb_points(geometry.wkb_bytes(star))[:-1] == star).all()
    assert len(geometry.simplify_line(np.array([(k, 0.001 * (k % 2)) for k in range(20)], float), 0.01)) == 2
    df = boxes(spark, [(1, 0.0, 0.0, 2.0, 2.0)], "k").withColumn("back", geometry.from_wkb(geometry.to_wkb("ring"))).withColumn("ok", geometry.valid_ring("ring"))
    assert df.where("back = ring and ok").count() == 1


def test_clipping_many_equals_clipping_one():
    rng = np.random.default_rng(8)
    subjects = [rng.normal(size=(rng.integers(0, 8), 2)) for _ in range(300)]
    angles = [np.sort(rng.uniform(0, 2 * np.pi, rng.integers(2, 7)))[:: rng.choice([-1, 1])] for _ in range(300)]
    windows = [np.stack([np.cos(a), np.sin(a)], 1) * rng.uniform(0.2, 1.5) for a in angles]
    pad = lambda rings: (np.stack([np.vstack([r, np.zeros((8 - len(r), 2))]) for r in rings]), np.array([len(r) for r in rings]))
    got, n = geometry.clip_many(*pad(subjects), *pad(windows))
    for k, (a, b) in enumerate(zip(subjects, windows)):
        want = geometry.clip_ring(a, b)
        area = lambda r: abs((r[:, 0] * np.roll(r[:, 1], -1) - np.roll(r[:, 0], -1) * r[:, 1]).sum()) / 2
        assert abs(area(got[k, : n[k]]) - area(want)) < 1e-9


def test_projections(spark):
    lon, lat = F.lit(12.5), F.lit(41.9)
    r = one(spark, s=projection.sinusoidal(lon, lat), u=projection.utm(lon, lat), r=projection.robinson(F.lit(180.0), F.lit(0.0)))
    back = one(spark, b=projection.sinusoidal_inverse(F.lit(r.s.x), F.lit(r.s.y))).b
    assert abs(back.x - 12.5) < 1e-8 and abs(back.y - 41.9) < 1e-8
    assert abs(r.u.x - 292690) < 200 and abs(r.u.y - 4641870) < 400 and abs(r.r.x - 17005833) < 20


def test_grids(spark):
    g = grids.square_grid(spark, 2_000_000).orderBy("cell_id").collect()
    assert [r.cell_id for r in g] == list(range(len(g))) and [(r.row, r.col) for r in g] == sorted((r.row, r.col) for r in g)
    assert 0.6 < len(g) * 4e12 / 5.1e14 < 1.0
    h = grids.hex_grid(spark, 2_000_000).select(geometry.area("ring").alias("a")).collect()
    assert h and all(abs(r.a / 4e12 - 1) < 1e-9 for r in h)
    assert grids.buffer_widths(1, 5) == (1500.0, 2500.0, 2500.0)
    with pytest.raises(ValueError):
        grids.buffer_widths(5, 5)
    cells = spark.createDataFrame([(1, 9.0, None, False, True, False), (2, 2.0, 1.0, False, True, False), (3, 80.0, None, False, False, False), (4, 3.0, None, True, False, False)], "cell_id long, line_km double, island_km double, on_land boolean, coastal boolean, at_zero boolean")
    got = {r.cell_id: (r.dist_km, r.is_land, r.is_coast) for r in grids.coastal_flags(cells).collect()}
    assert got == {1: (0.0, True, False), 2: (1.0, False, True), 3: (50.0, False, False), 4: (0.0, True, False)}


def test_circular_gaps_and_strides(spark):
    df = spark.createDataFrame([(1, 0.0), (1, 3.0), (2, 5.0)], "k long, at double")
    assert sorted((r.k, r.gap) for r in rollup.circular_gaps(df, ["k"], "at", 10.0).collect()) == [(1, 3.0), (1, 7.0), (2, 10.0)]
    many = spark.range(10).select(F.lit(1).alias("k"), "id")
    assert [r.id for r in rollup.every_kth(many, ["k"], "id", 4).orderBy("id").collect()] == [0, 4, 8]
    shares = {r.d: r.cum_pct for r in rollup.running_share(spark.createDataFrame([(k, 1.0) for k in range(10)] + [(3, 10.0)], "d long, n double"), "d", "n").collect()}
    assert shares[2] == 15.0 and shares[3] == 70.0 and shares[9] == 100.0


def test_first_eight_band_month(spark):
    rows = [(1, "2020-01-05", False), (1, "2020-03-05", True), (2, "2020-01-05", True), (2, "2020-02-05", False), (2, "2020-02-06", True), (2, "2020-02-07", True), (3, "2020-01-01", False)]
    df = scenes(spark, *[(g, f"{k}", 1, a, 90.0, "finalized") for k, (g, a, _) in enumerate(rows)]).join(spark.createDataFrame([(f"{k}", b) for k, (_, _, b) in enumerate(rows)], "id string, has_8_channel boolean"), "id")
    dims = spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "grid_id long, hex_id long")
    got = {r.hex_id: r.month for r in analyses.eight_band_start(df, dims, "2022-05-04").collect()}
    assert got == {1: None, 2: dt.date(2020, 1, 1), 3: None}  # 1: its eight bands start after its last four-band month


def test_tides(spark):
    parts = F.array(F.struct(F.lit(1.5).alias("amp"), F.lit(30.0).alias("speed"), F.lit(40.0).alias("phase")))
    r = one(spark, h=tides.elevation(F.lit(7200.0), parts), none=tides.elevation(F.lit(0.0), F.slice(parts, 1, 0)))
    assert abs(r.h - 1.5 * math.cos(math.radians(20))) < 1e-12 and r.none is None
    assert tuple(one(spark, a=tides.is_mid_tide(F.lit(0.5), 0.5), b=tides.is_mid_tide(F.lit(0.5), 0.5, F.lit(0.0), strict=False))) == (False, True)


def test_tide_simulation(spark):
    days, base = 11, np.datetime64("2024-01-01")
    minutes = np.arange(days * 1440)
    height = np.cos(minutes / 745.2 * 2 * np.pi) + 0.3 * np.sin(minutes / 720 * 2 * np.pi)
    rows = [(1, t(str(base + np.timedelta64(int(m), "m"))), float(h)) for m, h in zip(minutes[:-720], height)]  # the last day is half
    series = spark.createDataFrame(rows, "cell_id long, acquired timestamp_ntz, tide_height double").withColumn("solar_time", F.col("acquired"))
    heur, stats = tides.simulate(series, "cell_id", "solar_time", 0.2, 11.0)
    h, s = heur.first(), stats.first()
    seen = height[: len(rows)]
    assert abs(h.tide_std - seen.std(ddof=1)) < 1e-9 and abs(h.height_edge_3 - np.quantile(seen, 0.3)) < 1e-9
    for sat, (hour, every) in tides.OVERPASSES.items():
        own = np.array([height[d * 1440 + int(hour * 60)] for d in range(0, days - 1, every)])
        assert abs(s[f"{sat}_min_observed_height"] - own.min()) < 1e-9 and abs(s[f"{sat}_observed_tide_range"] - np.ptp(own)) < 1e-9
        at = np.array([d + hour / 24 for d in range(0, days - 1, every)])[own <= np.quantile(seen, 0.1)]
        assert s[f"{sat}_low_count"] == len(at)
        if len(at):
            around = np.diff(np.append(at, at[0] + 11.0))
            assert abs(s[f"{sat}_low_days_between_p50"] - np.median(around)) < 1e-6


def test_colour_bins(spark):
    r = analyses.colour_bins(numbers(spark, [1.0, 100.0, -5.0, None, float("nan")]), "x", 2, log=True).first()
    assert (r.low, r.high) == (1.0, 100.0) and np.allclose(r.edges, [1, 10, 100])
