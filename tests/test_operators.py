"""Core operators against brute force and invariants."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from intervane.config import PeakConfig, PrepConfig
from intervane.errors import ArgumentError, BadCovariance, InvalidRegionBounds, NotARegion, RegionTooSmall
from intervane.functions import lengths as L
from intervane.functions.kernels import covariance
from intervane.functions.regions import read_region, region_column
from intervane.operators import annotation, coverage, deconvolution, density, fragments, packages, peaks, periods, range_join, tracks
from intervane.operators.shards import running_total, with_neighbours

INTERVALS = "interval_id BIGINT, seqname STRING, start_ BIGINT, end_ BIGINT"


def made_intervals(rng, n, span=400, first=0):
    out = []
    for i in range(n):
        s = rng.choice([rng.randint(-50, span), rng.randint(-50, span), None])
        out.append((first + i, rng.choice(["a", "b", None]), s, None if s is None else s + rng.randint(-3, 60)))
    return out


@pytest.mark.parametrize("width", [4, 64, 1 << 16])
def test_range_joins(spark, width):
    rng = random.Random(width)
    points = [(i, rng.choice(["a", "b", None]), rng.choice([rng.randint(-60, 460), None])) for i in range(200)]
    left, right = made_intervals(rng, 80), made_intervals(rng, 60, first=1000)
    p = spark.createDataFrame(points, "id BIGINT, seqname STRING, location BIGINT")
    a, b = spark.createDataFrame(left, INTERVALS), spark.createDataFrame(right, INTERVALS)
    inside = sorted((i, j) for i, q, x in points for j, r, s, e in left if q and q == r and None not in (x, s) and s <= x <= e)
    assert sorted((r["id"], r["i_interval_id"]) for r in range_join.points_in_intervals(p, a, width=width).collect()) == inside
    hit = {i for i, _ in inside}
    assert {r["id"] for r in range_join.points_in_intervals(p, a, how="left_anti", width=width).collect()} == {i for i, *_ in points} - hit
    assert {r["id"] for r in range_join.points_in_intervals(p, a, how="left_semi", width=width).collect()} == hit
    pairs = sorted((i, j) for i, q, s, e in left for j, r, t, u in right if q and q == r and None not in (s, t) and s <= e and t <= u and t < e and s <= u)
    assert sorted((r["interval_id"], r["r_interval_id"]) for r in range_join.overlapping_pairs(a, b, width=width).collect()) == pairs
    assert {r["interval_id"] for r in range_join.not_overlapping(a, b, width=width).collect()} == {i for i, *_ in left} - {i for i, _ in pairs}


def test_merge_and_extend(spark):
    rows = [(1, "a", 0, 10), (2, "a", 10, 20), (3, "a", 19, 30), (4, "a", 40, 50), (5, "b", 5, 6)]
    df = spark.createDataFrame([(*r, float(r[0])) for r in rows], INTERVALS + ", mean DOUBLE")
    got = sorted(tuple(r) for r in periods.merged(df).collect())
    assert got == [("a", 0, 10, 1, 1.0), ("a", 10, 30, 2, 2.5), ("a", 40, 50, 1, 4.0), ("b", 5, 6, 1, 5.0)]
    assert sorted(tuple(r) for r in periods.extended(df, padding=5).collect()) == [("a", 0, 35, 3), ("a", 35, 55, 1), ("b", 0, 11, 1)]
    holes = spark.createDataFrame([(6, "a", None, 900, 1.0), (7, "b", 3, None, 1.0)], df.schema)
    assert sorted(tuple(r) for r in periods.extended(df.unionByName(holes), padding=5).collect()) == [("a", 0, 35, 3), ("a", 35, 55, 1), ("b", 0, 11, 1)]
    assert tuple(periods.covered_fraction(periods.periods(df, ("seqname",))).first()) == (41, 56, 41 / 56)
    assert tuple(periods.covered_fraction(df.limit(0)).first()) == (None, None, None)


@pytest.mark.parametrize("width", [8, 1 << 20])
def test_running_total_and_neighbours(spark, width):
    rng = random.Random(1)
    spots = {k: sorted(rng.sample(range(-100, 400), 60)) for k in "ab"}
    rows = [(k, x, x % 7) for k in spots for x in spots[k]]
    df = spark.createDataFrame(rows, "k STRING, at BIGINT, v BIGINT")
    total = {(r["k"], r["at"]): r["t"] for r in running_total(df, ["k"], "at", "v", "t", width).collect()}
    near = {(r["k"], r["at"]): (r["before"], r["after"]) for r in with_neighbours(df, ["k"], "at", width).collect()}
    for k, xs in spots.items():
        for i, x in enumerate(xs):
            assert total[k, x] == sum(y % 7 for y in xs[: i + 1])
            assert near[k, x] == (xs[i - 1] if i else None, xs[i + 1] if i + 1 < len(xs) else None)


def test_depth_and_lanes(spark):
    rng = random.Random(2)
    rows = [(i, s, s + rng.randint(1, 50)) for i, s in enumerate(rng.choices(range(300), k=80))]
    df = spark.createDataFrame([("s", "a", *r) for r in rows], "sample STRING, seqname STRING, interval_id BIGINT, start_ BIGINT, end_ BIGINT")
    for r in coverage.depth(df, shard_width=16).collect():
        assert r["depth"] == sum(s <= r["location"] < e for _, s, e in rows)
    covered = sum(x["end_"] - x["start_"] for x in coverage.depth_segments(df).collect() for _ in range(x["depth"]))
    assert covered == sum(e - s for _, s, e in rows)
    for padding, shard in ((0, 100_000), (7, 25)):
        laned = {r["interval_id"]: r["lane"] for r in annotation.lanes(df, ["sample", "seqname"], padding, shard).collect()}
        ends, want = {}, {}
        for i, s, e in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
            lane = next(x for x in range(len(rows)) if ends.get(x, -1000) + padding < s)
            ends[lane], want[i] = e, -2 * lane
        assert laned == want
    assert annotation.lanes(df.limit(0), ["sample", "seqname"]).count() == 0


def test_quantile(spark):
    rng = random.Random(3)
    rows = [(k, rng.choice([rng.uniform(-5, 50), 3.0]), rng.randint(0, 4)) for k in "abc" for _ in range(200)] + [("one", 4.0, 1), ("none", None, 3)]
    df = spark.createDataFrame(rows, "k STRING, v DOUBLE, n BIGINT")
    for share in (0.0, 0.25, 0.731, 1.0):
        got = {r["k"]: r["quantile"] for r in coverage.weighted_quantile(df, ["k"], "v", "n", share).collect()}
        for k in ("a", "b", "c", "one"):
            values = [v for q, v, n in rows if q == k for _ in range(n)]
            assert got[k] == pytest.approx(np.quantile(values, share), abs=1e-12)
        assert "none" not in got


def test_density_and_dense_intervals(spark):
    rng = random.Random(4)
    rows = [("a", rng.randint(0, 3000), rng.choice(["c1", "c2"])) for _ in range(120)] + [("a", 9000, "c1"), ("a", None, "c1"), (None, 5, "c2"), ("b", 70, "c2")]
    df = spark.createDataFrame(rows, "seqname STRING, location BIGINT, track STRING")
    kernel = {"bandwidth": 50.0, "step": 10}
    near = {}
    for seq in "ab":
        xs = [x for s, x, _ in rows if s == seq and x is not None]
        for g in range(-250, 9300, 10):
            d = [g - x for x in xs if abs(g - x) <= 250]
            if d:
                near[seq, g] = sum(math.exp(-0.5 * (t / 50) ** 2) for t in d) * 100 / (50 * math.sqrt(2 * math.pi))
    got = {(r["seqname"], r["location"]): r["density"] for r in density.density(df, shard_width=512, **kernel).collect()}
    assert got.keys() == near.keys() and all(got[k] == pytest.approx(near[k]) for k in near)
    raw = density.two_densities(df, shard_width=512, smooth={"c2": 40}, **kernel).cache()
    both = density.with_intervals(raw, 10, 512).collect()
    assert {(r["seqname"], r["location"]) for r in both} == set(near)
    assert all(r["c1"] + r["c2"] == pytest.approx(near[r["seqname"], r["location"]]) for r in both)
    assert sum(r["n_c1"] + r["n_c2"] for r in both) == 122
    for r in both:
        assert r["interval_start"] <= r["location"] <= r["interval_end"]
        assert all((r["seqname"], g) in near for g in range(r["interval_start"], r["interval_end"] + 1, 10))
        assert (r["seqname"], r["interval_start"] - 10) not in near and (r["seqname"], r["interval_end"] + 10) not in near
    for width in (512, 1 << 20):
        ready = density.with_intervals(density.two_densities(df, shard_width=width, smooth={"c2": 40}, **kernel).cache(), 10, width)
        other = tracks.smoothed(ready.withColumnRenamed("c2_smooth", "whole"), ["seqname"], ["c2"], 40, 10).collect()
        assert len(other) == len(both) and all(r["c2_smooth"] == pytest.approx(r["whole"], abs=1e-9) for r in other)
    dense = density.dense_intervals(df, threshold=2.0, padding=40, **kernel).collect()
    for r in dense:
        chosen = [g for s, g in near if s == r["seqname"] and near[s, g] > 2.0 and r["start_"] <= g <= r["end_"]]
        assert 0 < len(chosen) <= r["n_positions"]  # the outermost are cut to the events
    assert sum(r["n_positions"] for r in dense) == sum(v > 2.0 for v in near.values())
    with pytest.raises(ValueError):
        density.dense_intervals(df, padding=0)


@pytest.mark.parametrize("width", [10, 60, 900])
def test_smoothing(spark, width):
    rng = random.Random(5)
    rows, values = [], {}
    for a, n in ((0, 30), (1000, 3), (5000, 200), (9000, 1)):
        values[a] = [rng.random() for _ in range(n)]
        rows += [("s", a, a + 10 * (n - 1), a + 10 * i, v, i) for i, v in enumerate(values[a])]
    df = spark.createDataFrame(rows, "seqname STRING, interval_start BIGINT, interval_end BIGINT, location BIGINT, v DOUBLE, extra INT")
    w = tracks.gaussian_weights(width // 10)
    reach = len(w) // 2
    got = {r["location"]: r for r in tracks.smoothed(df, ["seqname"], ["v"], width, 10, shard_width=256).collect()}
    assert len(got) == len(rows)
    for a, v in values.items():
        n = len(v)
        for i in range(n):
            total = 0.0
            for o in range(-reach, reach + 1):
                j = (i + o) % (2 * n)
                total += w[o + reach] * v[j if j < n else 2 * n - 1 - j]
            assert got[a + 10 * i]["v_smooth"] == pytest.approx(total)
    with pytest.raises(ArgumentError):
        tracks.smoothed(df, ["seqname"], ["v"], 5, 10)


def test_interpolation(spark):
    rows = [("s", 3, 1.0), ("s", 27, 7.0), ("s", 30, 4.0), ("s", 95, 0.0), ("t", 5, 2.0), ("u", 20, 9.0)]
    df = spark.createDataFrame(rows, "k STRING, location BIGINT, v DOUBLE")
    got = {(r["k"], r["location"]): r["v"] for r in tracks.interpolated(df, ["k"], "v", span=10).collect()}
    want = {("s", x): float(np.interp(x, [3, 27, 30, 95], [1, 7, 4, 0])) for x in range(10, 95, 10)} | {("u", 20): 9.0}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    assert sorted(x for k, x in {(r["k"], r["location"]) for r in tracks.interpolated(df, ["k"], "v", span=10, max_gap=30).collect()} if k == "s") == [10, 20, 30]


def test_islands_and_overlaps(spark):
    flags = [0, 1, 1, 0, 1, 0, 0, 1, 1, 1]
    value = [0, 5, 5, 1, 3, 0, 0, 1, 9, 2]
    df = spark.createDataFrame([("a", 10 * i, float(v), bool(f)) for i, (v, f) in enumerate(zip(value, flags))], "seqname STRING, location BIGINT, v DOUBLE, flag BOOLEAN")
    got = sorted(tuple(r) for r in peaks.islands(df, "v", F.col("flag")).collect())
    assert got == [("a", 5, 25, 5.0, 10, 20), ("a", 35, 45, 3.0, 40, 10), ("a", 65, 95, 4.0, 80, 30)]
    schema = "seqname STRING, start_ BIGINT, end_ BIGINT, mean DOUBLE, name STRING"
    c1 = spark.createDataFrame([("a", 0, 100, 1.0, "p"), ("a", 200, 300, 1.0, "q"), ("b", 0, 10, 1.0, "r")], schema)
    c2 = spark.createDataFrame([("a", 40, 100, 3.0, "x"), ("a", 290, 500, 3.0, "y"), ("a", 90, 120, 3.0, "z")], schema)
    a, b, both = peaks.filtered_overlaps(c1, c2)
    assert sorted(r["name"] for r in a.collect()) == ["q", "r"] and sorted(r["name"] for r in b.collect()) == ["y", "z"]
    assert [tuple(r) for r in both.collect()] == [("a", 0, 100, 2, 2.0)]
    track = spark.createDataFrame([("a", 10 * i, float(i), float(i % 3) + 1) for i in range(60)], "seqname STRING, location BIGINT, c1 DOUBLE, c2 DOUBLE")
    report = {(r["c1_name"], r["c2_name"]): r for r in peaks.overlap_report(c1, c2, track).collect()}
    assert set(report) == {("p", "x"), ("p", "z"), ("q", "y")}
    inside = [i for i in range(60) if 40 <= 10 * i < 100]
    r = report["p", "x"]
    assert r["mean_c1"] == pytest.approx(np.mean(inside)) and r["c1_fraction"] == 0.6 and r["c2_fraction"] == 1.0
    assert r["distance"] == pytest.approx(1 - np.corrcoef(inside, [i % 3 for i in inside])[0, 1])
    assert report["q", "y"]["distance"] is None


def walked_windows(at, n, low, high, overlap, max_cuts, max_locs):
    """Windows found location by location: (first, last, stitch start, stitch end, cuts, locations)."""
    inside = [x for x in at if x >= low + overlap]
    if not inside or at[-1] < low + 2 * overlap:
        return [(at[0], at[-1], low + overlap, max(high - overlap, low + overlap), sum(n), len(at))]
    out, begin, left = [], 0, inside[0]
    for i, c in enumerate(at):
        stop = next(x for x in at if x >= c - overlap)
        cuts, locs = sum(n[begin : i + 1]), i + 1 - begin
        if (2 * cuts >= max_cuts or locs >= max_locs) and stop - left >= overlap:
            out.append((at[begin], c, left, stop, cuts, locs))
            begin, left = next(j for j, x in enumerate(at) if x >= stop - overlap), stop
    return [*out, (at[begin], at[-1], left, max(high - overlap, left), sum(n[begin:]), len(at) - begin)]


@pytest.mark.parametrize(("seed", "width"), [(1, 1 << 22), (2, 1 << 15)])
def test_windows_against_a_walk(spark, seed, width):
    rng = random.Random(seed)
    places = [int(x) for x in np.cumsum([rng.choice([1, 1, 3, 9, 40, 400, 3000]) for _ in range(250)])]
    events = [(q, x) for q in ("a", "b") for x in places for _ in range(rng.choice([1, 1, 2, 30]))]
    regions = [("a", places[0] - 5, places[120]), ("a", places[121], places[-1] + 50), ("b", places[3], places[-9])]
    frame = spark.createDataFrame(events, "seqname STRING, location BIGINT")
    for overlap, max_cuts, max_locs in ((100, 120, 10_000), (60, 10_000, 30)):
        made = packages.work_packages(frame, spark.createDataFrame(regions, "seqname STRING, start_ BIGINT, end_ BIGINT"), overlap, max_cuts, max_locs, (50, 200), width)
        got = defaultdict(list)
        for r in sorted(made.collect(), key=lambda r: r["k"]):
            got[r["seqname"], r["interval"]].append((r["start_"], r["end_"], r["stitch_start"], r["stitch_end"], r["ncuts"], r["nlocs"]))
        for q, s, e in regions:
            at = sorted({x for p, x in events if p == q and s <= x <= e})
            n = [sum(1 for p, y in events if p == q and y == x) for x in at]
            first, last = s == min(x for p, x, _ in regions if p == q), e == max(x for p, _, x in regions if p == q)
            wide = int(1.5 * overlap)
            assert got[q, s] == walked_windows(at, n, s - wide * first, e + wide * last, overlap, max_cuts, max_locs)


def test_stitching_and_bounds(spark):
    rng = random.Random(9)
    events = [("a", rng.randint(0, 9000)) for _ in range(1500)]
    frame = spark.createDataFrame(events, "seqname STRING, location BIGINT")
    regions = spark.createDataFrame([("a", -10, 9010)], "seqname STRING, start_ BIGINT, end_ BIGINT")
    made = packages.work_packages(frame, regions, overlap=200, max_cuts=300, max_locs=100_000).cache()
    assert made.count() > 3
    inside = packages.in_packages(frame, made)
    assert inside.count() > 1500
    near = coverage.spine_counts(inside, 200, ("seqname", "interval", "k"))
    got = {r["location"]: (r["n_left"], r["n_right"]) for r in packages.stitched(near, made).collect()}
    whole = {r["location"]: (r["n_left"], r["n_right"]) for r in coverage.spine_counts(frame, 200, ("seqname",)).collect()}
    assert got == whole and packages.stitched(inside, made).count() == 1500
    assert packages.exclusive_coverage(made).first()["covered"] == 9010 + 300 - 200 - min(x for _, x in events if x >= -10 - 300 + 200)
    assert packages.check_bounds(frame, regions, 200).count() == 1
    with pytest.raises(RegionTooSmall):
        packages.check_bounds(frame, regions, 5000)
    with pytest.raises(InvalidRegionBounds):
        packages.check_bounds(frame.unionByName(spark.createDataFrame([("a", 20_000)], frame.schema)), regions, 200)
    empty = packages.work_packages(frame.limit(0), regions)
    assert empty.count() == 0


def test_packages(spark):
    rng = random.Random(6)
    events = [("a", rng.randint(0, 20_000)) for _ in range(3000)] + [("a", 50_000 + rng.randint(0, 500)) for _ in range(100)] + [("b", 7)] + [("a", 11_111)] * 500
    frame = spark.createDataFrame(events, "seqname STRING, location BIGINT")
    regions = [("a", -10, 20_010), ("a", 49_990, 50_600), ("b", 0, 20)]
    made = packages.work_packages(frame, spark.createDataFrame(regions, "seqname STRING, start_ BIGINT, end_ BIGINT"), overlap=300, max_cuts=800, max_locs=300, reaches=(50, 200))
    rows = made.collect()
    by = defaultdict(list)
    for r in rows:
        by[r["seqname"], r["interval"]].append(r)
    assert set(by) == {("a", -10), ("a", 49_990), ("b", 0)}
    for (seq, interval), windows in by.items():
        windows.sort(key=lambda r: r["k"])
        at = sorted({x for s, x in events if s == seq and any(q == seq and lo == interval and lo <= x <= hi for q, lo, hi in regions)})
        assert [w["k"] for w in windows] == list(range(len(windows)))
        assert windows[0]["start_"] == at[0] and windows[-1]["end_"] == at[-1]
        for a, b in zip(windows, windows[1:]):
            assert a["stitch_end"] == b["stitch_start"] and b["start_"] <= a["stitch_end"] - 0 <= a["end_"]
            assert a["stitch_end"] - a["stitch_start"] >= 300 and a["is_subdivide"]
        for w in windows:
            mine = np.array([x for x in at if w["start_"] <= x <= w["end_"]])
            assert w["nlocs"] == len(mine) and w["ncuts"] == sum(1 for s, x in events if s == seq and w["start_"] <= x <= w["end_"])
            assert w["nnz1"] == sum((abs(mine - x) < 50).sum() for x in mine)
    named = packages.package_names(made)
    assert named.select("name").distinct().count() == len(rows)
    chunked = packages.work_chunks(made.withColumn("memory", F.col("nlocs") / 1000.0), target=0.8)
    loads = {r["workchunk"]: r for r in packages.chunk_loads(chunked).collect()}
    assert sum(r["n_packages"] for r in loads.values()) == len(rows) > len(loads)
    assert all(r["load"] < 0.8 or r["n_packages"] == 1 for r in loads.values())
    assert {r["nlocs"] for r in packages.richest_package(made).collect()} <= {r["nlocs"] for r in rows}
    with pytest.raises(ArgumentError):
        packages.work_chunks(made, target=0.01)


def test_kernels_and_lengths():
    assert covariance("Matern32(500)").reach(1e-8) == 6217 and covariance("Matern32(2000)").reach(1e-8) == 24868
    assert covariance("2 * ExpQuad(10) + Exponential(5)")(0.0) == pytest.approx(3.0)
    both = covariance("2 * Matern52(7) * ExpQuad(10) ** 2 + 0.5 * Matern32(5) * 2")
    d = np.array([0.0, 3.0, -20.0])
    assert both(d) == pytest.approx(2 * covariance("Matern52(7)")(d) * covariance("ExpQuad(10)")(d) ** 2 + covariance("Matern32(5)")(d))
    assert both(both.reach(1e-8)) <= 1e-8 < both(both.reach(1e-8) - 1)
    assert covariance("RatQuad(2, 5)")(10.0) == pytest.approx((1 + 4 / 4) ** -2)
    with pytest.raises(BadCovariance):
        covariance("Matern32(5) + 1").reach()
    for bad in ("open('x')", "Matern32(0)", "Matern32(2, 5)", "Matern32(5) - 1", "Matern32(5, lengthscale=2)", "(lambda: 1)()", "Matern32(x)", "3", ""):
        with pytest.raises(BadCovariance):
            covariance(bad)
    x = np.linspace(1, 5000, 400_000)
    assert np.trapezoid(L.densities(x)[:, 0], x) == pytest.approx(1, abs=1e-3)
    assert x[L.densities(x)[:, 1].argmax()] == pytest.approx(200, abs=0.1)
    for call in (lambda: L.validate(L.MODES, L.MODEL_SDS, (1,)), lambda: L.validate(L.MODES, (0.1,), (1, 2)), lambda: PrepConfig(bandwidth=0), lambda: PeakConfig(fraction_in_peaks=1)):
        with pytest.raises(ArgumentError):
            call()


def test_fit_recovers_weights_and_flip_check(spark):
    rng = np.random.default_rng(7)
    truth = {"c1": [0.7, 0.2, 0.05, 0.05], "c2": [0.2, 0.6, 0.1, 0.1]}
    rows = []
    for chunk in range(6):
        for comp, w in truth.items():
            source = {"c1": "c2", "c2": "c1"}[comp] if chunk == 5 else comp
            k = rng.choice(4, 20_000, p=truth[source])
            mu = np.log(np.array(L.MODES)) + np.array(L.MODEL_SDS) ** 2
            found = Counter(np.maximum(1, np.exp(rng.normal(mu[k], np.array(L.MODEL_SDS)[k])).round()).astype(int).tolist())
            rows += [(str(chunk), comp, x, n) for x, n in found.items()]
    counts = spark.createDataFrame(rows, "workchunk STRING, comp STRING, length BIGINT, n BIGINT")
    fit = deconvolution.fit_length_weights(counts, iterations=60)
    for r in fit.filter("workchunk = '0'").collect():
        assert r["w"] == pytest.approx(truth[r["comp"]][r["k"]], abs=0.03)
    assert {r["workchunk"]: r["flipped"] for r in deconvolution.flip_check(fit).collect()} == {str(i): i == 5 for i in range(6)}
    kept = deconvolution.without_flipped(counts, deconvolution.flip_check(fit), "workchunk")
    assert kept.select("workchunk").distinct().count() == 5
    assert deconvolution.missing_chunks(spark.createDataFrame([("0",), ("9",)], "workchunk STRING"), fit).collect()[0][0] == "9"


def test_labels_and_regions(spark):
    rows = [(1, "s", "chr1", 5, 200, "n", "AAAACCCC", 195), (2, "s", "chr1", 5, 200, "m", "AAAACCCC", 195), (2, "s", "chr1", 5, 200, "m", "AAAACCCC", 195), (3, "s", None, 9, 1, None, None, -8), (4, "s", None, 9, 1, None, None, -8)]
    df = spark.createDataFrame(rows, "fragment_id BIGINT, sample STRING, seqname STRING, start_ BIGINT, end_ BIGINT, name STRING, barcode STRING, length BIGINT")
    assert sorted(r["fragment_id"] for r in fragments.deduplicated(df).collect()) == [1, 3]
    stats = fragments.duplicate_stats(df).first()
    assert (stats["n_fragments"], stats["n_distinct"], stats["n_removed"], stats["share_removed"]) == (4, 2, 2, 0.5)
    assert fragments.to_events(df).count() == 10
    one = df.limit(1).select(
        fragments.replaced_barcode(F.col("barcode"), "^(.{4}).*$").alias("a"), fragments.replaced_barcode(F.lit("xAAy"), "x(.*)y", extract=True).alias("b"),
        fragments.without_postfix(F.lit("chr1_alt_2")).alias("c"), fragments.read_type(F.lit(121)).alias("d"), fragments.long_type(F.lit(241)).alias("e"), fragments.long_type(F.lit(120)).alias("f"),
        region_column(F.lit("chr1:1,0_0-20 rest")).alias("g"), region_column(F.lit("chr1-5")).alias("h"), L.log_sum_exp(F.lit(1000.0), F.lit(1000.0)).alias("i"),
    ).first()
    assert (one["a"], one["b"], one["c"], one["d"], one["e"], one["f"]) == ("AAAA", "AA", "chr1", ">120", ">240", "≤120")
    assert tuple(one["g"]) == ("chr1", 100, 20) and one["h"] is None and one["i"] == pytest.approx(1000 + math.log(2))
    assert read_region("chr2:1,000-2_000") == ("chr2", 1000, 2000)
    with pytest.raises(NotARegion):
        read_region("gene")
    assert [tuple(r) for r in coverage.index_ranges(spark.createDataFrame([("a", x) for x in (3, 0, 1, 2, 5, 5)], "k STRING, n INT"), "k", "n").collect()] == [("a", "0-3,5")]
    features = spark.createDataFrame([("chr1", 10, 20, "g", "id1", "t1"), ("chr1", 30, 40, "g", "id1", "t2"), ("chr2", 1, 2, "t1", "id2", "t3")], "seqname STRING, start_ BIGINT, end_ BIGINT, gene_name STRING, gene_id STRING, transcript_id STRING")
    look = lambda x: [tuple(r) for r in annotation.resolved_feature(features, x, 1).collect()]
    assert look("g") == [("chr1", 9, 41, "gene_name")] and look("t1") == [("chr2", 0, 3, "gene_name")] and look("t2") == [("chr1", 29, 41, "transcript_id")]
    assert look("chr3:5-9") == [("chr3", 4, 10, "region")] and look("none") == []


def test_numbered_and_centred(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice("ab"), rng.choice(["c1", "c10", None]), rng.choice([None, 5, 2_000_000, *range(20)])) for i in range(300)]
    cuts = spark.createDataFrame(rows, "cut_id BIGINT, sample STRING, seqname STRING, location BIGINT").withColumn("n", F.lit(7))
    order = sorted((s, q, x, i) for i, s, q, x in rows if q and x is not None)
    got = sorted((r["number"], r["cut_id"], r["name"]) for r in coverage.numbered_events(cuts).collect())
    assert got == [(k, i, f"event_{k:03d}") for k, (*_, i) in enumerate(order)]
    assert coverage.numbered_events(cuts.limit(0)).count() == 0 and coverage.event_weights(cuts.limit(0)).count() == 0
    spans = spark.createDataFrame([(1, "c1", 0, 10), (2, "c1", 0, 11), (3, "c1", 9, 10), (4, "c1", 9, 11), (5, "c2", 7, 8), (6, None, 7, 8), (7, "c1", None, 8)], "id INT, seqname STRING, start_ BIGINT, end_ BIGINT")
    assert sorted(r["id"] for r in range_join.centred_in(spans, "c1", 5, 10).collect()) == [2, 3]


def test_histogram_and_widths(spark):
    df = spark.createDataFrame([("a", x) for x in (1, 10, 11, 25)] + [("b", 2), (None, 3)], "g STRING, length BIGINT")
    got = {(r["g"], r["length"]): r["count"] for r in coverage.length_histogram(df, "g").collect()}
    assert got == {("a", 5.5): 2, ("a", 15.5): 1, ("a", 25.5): 1, ("b", 5.5): 1, ("b", 15.5): 0, ("b", 25.5): 0}
    shares = [r["density"] for r in coverage.length_histogram(df, "g", prior=1.0).filter("g = 'a'").collect()]
    assert sum(shares) == pytest.approx(1)
    cuts = spark.createDataFrame([("s", "c", x) for x in (0, 4, 4, 10)] + [("s", "d", 3)], "sample STRING, seqname STRING, location BIGINT")
    widths = {(r["seqname"], r["location"]): (r["n"], r["rank"], r["width"]) for r in coverage.location_widths(cuts).collect()}
    assert widths == {("c", 0): (1, 0, 4.0), ("c", 4): (2, 1, 5.0), ("c", 10): (1, 2, 6.0), ("d", 3): (1, 0, 1.0)}
    assert {r["seqname"]: r["median_location"] for r in coverage.location_medians(cuts).collect()} == {"c": 4, "d": 3}
    weights = {(r["seqname"], r["location"]): r["weight"] for r in coverage.event_weights(cuts).collect()}
    assert weights == {("c", 0): 2.0, ("c", 4): 2.5, ("c", 10): 3.0, ("d", 3): 1.0}
    spine = {(r["seqname"], r["location"]): (r["n_left"], r["n_right"]) for r in coverage.spine_counts(cuts, 5, shard_width=8).collect()}
    assert spine == {("c", 0): (0, 1), ("c", 4): (1, 0), ("c", 10): (0, 0), ("d", 3): (0, 0)}


@pytest.mark.parametrize("n", [1, 2, 7, 8, 100])
def test_thinning(spark, n):
    df = spark.createDataFrame([("s", 3 * i, i) for i in range(n)], "k STRING, location BIGINT, v INT")
    got = sorted(r["v"] for r in tracks.thinned(df, ["k"], 7).collect())
    assert got == sorted({j * (n - 1) // 6 for j in range(7)}) if n > 7 else got == list(range(n))


def test_group_order(spark):
    df = spark.createDataFrame([("a", 5.0), ("a", 7.0), ("b", 6.0), ("c", 1.0), ("c", None)], "g STRING, v DOUBLE")
    assert sorted(tuple(r) for r in coverage.group_order(df, "g", "v").collect()) == [("a", 6.0, 2), ("b", 6.0, 2), ("c", 1.0, 1)]
    assert [r["g"] for r in coverage.ambiguous_groups(df, "g", "v").collect()] == ["a"]


def test_exons_labels_priors_and_sizes(spark):
    rows = [("c", "exon", 0, 10, "g", "t1"), ("c", "exon", 5, 20, "g", "t2"), ("c", "exon", 30, 31, "g", "t1"), ("c", "gene", 0, 99, "g", None), ("c", "exon", 3, 3, "g", "t1"), ("c", "exon", 1, 2, None, "t9")]
    features = spark.createDataFrame(rows, "seqname STRING, feature STRING, start_ BIGINT, end_ BIGINT, gene_name STRING, transcript_id STRING")
    got = sorted((r["start_"], r["end_"], r["depth"], r["scaled"]) for r in annotation.exon_depth(features, height=0.8).collect())
    assert got == [(0, 5, 1, 0.4), (5, 10, 2, 0.8), (10, 20, 1, 0.4), (30, 31, 1, 0.4)]
    by = annotation.exon_depth(features, ("gene_name", "transcript_id")).filter("transcript_id = 't1'")
    assert sorted((r["start_"], r["end_"], r["depth"]) for r in by.collect()) == [(0, 10, 1), (30, 31, 1)]
    label = spark.range(1).select(fragments.facet_label(F.lit("a"), F.lit(None).cast("string"), F.lit(">120"))).first()[0]
    assert label == "a >120"
    modes = spark.createDataFrame([("c1", 0, 10.9), ("c1", 1, 2.0), ("c2", 0, 7.5)], "comp STRING, k INT, cuts DOUBLE")
    checked = spark.createDataFrame([("x", 0.2, True), ("y", 0.99, False)], "workchunk STRING, correlation DOUBLE, flipped BOOLEAN")
    assert sorted(tuple(r) for r in deconvolution.suggested_priors(modes, checked).collect()) == [("x", "c1", 0, 10), ("x", "c1", 1, 2), ("x", "c2", 0, 7)]
    bins = spark.createDataFrame([("c", 0, 10, 1.0), ("c", 10, 20, 2.0), ("c", 20, 30, 3.0), ("d", 0, 10, 4.0)], "seqname STRING, start_ BIGINT, end_ BIGINT, value DOUBLE")
    sizes = spark.createDataFrame([("c", 25)], "seqname STRING, size_ BIGINT")
    assert sorted(r["value"] for r in tracks.within_sizes(bins, sizes).collect()) == [1.0, 2.0]
    assert [r["value"] for r in tracks.within_sizes(bins, sizes, ("c", 11, 15)).collect()] == [2.0]


def test_a_pile_up_is_numbered_over_partitions(spark):
    rows = spark.range(5000).selectExpr("5000 - id AS cut_id", "'s' AS sample", "'c' AS seqname", "7L AS location")
    got = sorted((r["number"], r["cut_id"]) for r in coverage.numbered_events(rows).collect())
    assert got == [(i, i + 1) for i in range(5000)]
