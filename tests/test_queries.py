"""Registered queries against brute force, with the settings they are to run with."""

import math
import random

import numpy as np
import pytest

from intervane.plans.interval_queries import QUERIES

FRAGMENTS = "fragment_id BIGINT, loaded_at TIMESTAMP, sample STRING, seqname STRING, start_ BIGINT, end_ BIGINT, name STRING, barcode STRING, length BIGINT"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path, rng, rows = str(tmp_path_factory.mktemp("tables")), random.Random(5), []
    for i in range(900):
        start = rng.choice([20_000, 24_000, 31_000, 90_000]) + int(rng.gauss(0, 900))
        length = rng.choice([60, 150, 200, 310])
        rows.append((i, None, "s", rng.choice(["chr1", "chr2"]), start, start + length, f"n{i}", f"b{i}", length))
    spark.createDataFrame(rows, FRAGMENTS).write.parquet(f"{path}/fragments.parquet")
    return path


def smoothed_over(values, width, span=10):
    sigma = width // span
    offsets = np.arange(-4 * sigma, 4 * sigma + 1)
    weights = np.exp(-0.5 * (offsets / sigma) ** 2)
    mirrored, n = np.concatenate([values, values[::-1]]), len(values)
    return np.array([(mirrored[(i + offsets) % (2 * n)] * weights).sum() for i in range(n)]) / weights.sum()


def test_c2_is_smoothed_over_2000_bases(spark, folder):
    track = QUERIES["two_tracks"](spark, folder).toPandas().sort_values(["seqname", "location"], ignore_index=True)
    track["smooth"] = 0.0
    for _, part in track.groupby(["seqname", "interval_start"]):
        track.loc[part.index, "smooth"] = smoothed_over(part["c2"].to_numpy(), 2000)
    got = QUERIES["gaussian_smooth"](spark, folder).toPandas().merge(track, on=["seqname", "location"])
    assert len(got) == len(track) and np.allclose(got["c2_smooth"], got["smooth"], atol=1e-5)

    cuts = track["n_c1"] + track["n_c2"]
    share = (track["n_c2"].sum() + cuts.sum() / 2) / (2 * cuts.sum()) * 0.5
    bound = np.quantile(np.repeat(track["c2"], cuts), 1 - share)
    flagged = track[((track["c2"] + track["smooth"]) / 2 > bound) | (track["smooth"] > bound)]
    runs = (flagged["location"].diff().ne(10) | flagged["seqname"].ne(flagged["seqname"].shift())).cumsum()
    peaks = [(p["seqname"].iloc[0], p["location"].min() - 5, p["location"].max() + 5) for _, p in flagged.groupby(runs)]
    found = QUERIES["peak_islands"](spark, folder).filter("track = 'c2'").collect()
    assert peaks and sorted((r["seqname"], r["start_"], r["end_"]) for r in found) == sorted(p for p in peaks if p[2] - p[1] > 400)


def test_tracks_bridge_long_gaps(spark, tmp_path):
    places = [137, 950, 9_050, 9_210, 34_480, 34_890]
    cuts = [(i, "s", "chr1", x) for i, x in enumerate(p for p in places for _ in range(p % 7 + 1))]
    spark.createDataFrame(cuts, "cut_id BIGINT, sample STRING, seqname STRING, location BIGINT").write.parquet(f"{tmp_path}/cuts.parquet")
    at = [p // 100 * 100 + 37 for p in places]
    grid = np.arange(-(-at[0] // 50) * 50, at[-1] + 1, 50)
    value = np.interp(grid, at, [p % 7 + 1 for p in places])
    got = sorted((r["location"], r["value"]) for r in QUERIES["interp_track"](spark, str(tmp_path)).collect())
    assert [x for x, _ in got] == grid.tolist() and np.allclose([v for _, v in got], value, atol=1e-5)
    bins = {r["start_"]: r["value"] for r in QUERIES["binned_track"](spark, str(tmp_path)).collect()}
    assert bins.keys() == set((grid // 500 * 500).tolist())
    assert all(math.isclose(v, value[grid // 500 * 500 == b].mean() * 100, abs_tol=1e-5) for b, v in bins.items())


def test_kde_intervals_are_padded_by_10000(spark, folder):
    dens = QUERIES["kde_density"](spark, folder).filter("density > 2").toPandas().sort_values(["seqname", "location"])
    ends = spark.read.parquet(f"{folder}/fragments.parquet").groupBy("seqname").agg({"start_": "min", "end_": "max"}).toPandas().set_index("seqname")
    want = []
    for name, part in dens.groupby("seqname"):
        low, high = ends.loc[name, "min(start_)"] - 1, ends.loc[name, "max(end_)"] + 1
        for _, run in part.groupby((part["location"].diff() > 20_000).cumsum()):
            a, b = run["location"].min(), run["location"].max()
            want.append((name, max(low, a - 10_000), min(high, b + 10_000 - 1), len(run)))
    got = [(r["seqname"], r["start_"], r["end_"], r["n_positions"]) for r in QUERIES["kde_intervals"](spark, folder).collect()]
    assert sorted(got) == sorted(want)
