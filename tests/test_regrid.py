"""Regular series against a direct reading of the definition."""

import random

import pytest

from intervane.operators.regrid import regular_series

CUTS = "cut_id BIGINT, sample STRING, seqname STRING, location BIGINT, n INT, k INT"
TRACKS = "track_id BIGINT, sample STRING, seqname STRING, grid_start BIGINT, grid_end BIGINT, step BIGINT, value INT"


def slope(knots, i, reach):
    k, v = knots[i]
    left = i > 0 and k - knots[i - 1][0] <= reach
    right = i + 1 < len(knots) and knots[i + 1][0] - k <= reach
    d0 = (v - knots[i - 1][1]) / (k - knots[i - 1][0]) if left else None
    d1 = (knots[i + 1][1] - v) / (knots[i + 1][0] - k) if right else None
    if left and right:
        if d0 * d1 <= 0:
            return 0.0
        h0, h1 = k - knots[i - 1][0], knots[i + 1][0] - k
        return (3 * h0 + 3 * h1) / ((2 * h1 + h0) / d0 + (h1 + 2 * h0) / d1)
    return d0 if left else d1 if right else 0.0


def brute(cuts, tracks, max_fill):
    out = {}
    for track, sample, seqname, lo, hi, step, _ in set(tracks):
        if None in (lo, hi, step) or step < 1 or hi <= lo:
            continue
        seen = {}
        for cut, s, q, at, *_ in cuts:
            if None not in (s, q, at) and (s, q) == (sample, seqname) and lo <= at < hi:
                seen.setdefault((at - lo) // step, set()).add(cut)
        knots = sorted((k, float(len(x))) for k, x in seen.items())
        for k in range((hi - lo) // step):
            at = lo + k * step
            if k in seen:
                out[track, at] = (len(seen[k]), float(len(seen[k])), "observed")
                continue
            i = max((i for i, x in enumerate(knots) if x[0] < k), default=None)
            if i is None or i + 1 == len(knots) or knots[i + 1][0] - knots[i][0] > max_fill + 1:
                out[track, at] = (0, None, "missing")
                continue
            (a, va), (b, vb) = knots[i], knots[i + 1]
            h, t = b - a, (k - a) / (b - a)
            m0, m1 = slope(knots, i, max_fill + 1), slope(knots, i + 1, max_fill + 1)
            y = (1 + 2 * t) * (1 - t) ** 2 * va + t * (1 - t) ** 2 * h * m0 + t * t * (3 - 2 * t) * vb + t * t * (t - 1) * h * m1
            assert min(va, vb) - 1e-9 <= y <= max(va, vb) + 1e-9
            out[track, at] = (0, y, "filled")
    return out


@pytest.mark.parametrize(("seed", "max_fill", "shard"), [(1, 3, 4), (2, 3, 4096), (3, 0, 2), (4, 5, 7)])
def test_series(spark, seed, max_fill, shard):
    rng = random.Random(seed)
    tracks = [(i, f"s{i}", "chr1", -7, -7 + 40 * 5, 5, 0) for i in range(5)] + [(9, "s0", "chr2", 3, 53, 10, 0), (10, "s0", None, 0, 10, 5, 0), (11, "s1", "chr1", 0, None, 5, 0), (12, "s1", "chr1", 0, 50, 0, 0)]
    cuts = [(i, rng.choice(["s0", "s1", "s2", None]), rng.choice(["chr1", "chr1", "chr2", None]), rng.choice([rng.randint(-20, 60), rng.randint(-20, 260), None]), 1, 1) for i in range(160)]
    cuts += cuts[:40] + [(1000 + i, "s3", "chr1", 33, 1, 1) for i in range(30)] + [(None, "s4", "chr1", 20, 1, 1)]
    frame = regular_series(spark.createDataFrame(cuts, CUTS), spark.createDataFrame(tracks + tracks[:1], TRACKS), max_fill, shard)
    got = {(r["track_id"], r["bin_start"]): (r["n_cuts"], r["value"], r["state"]) for r in frame.collect()}
    want = brute(cuts, tracks, max_fill)
    assert got.keys() == want.keys()
    for key in want:
        assert got[key][::2] == want[key][::2], key
        assert got[key][1] == (want[key][1] if want[key][1] is None else pytest.approx(want[key][1]))


def test_empty(spark):
    cuts, tracks = spark.createDataFrame([], CUTS), spark.createDataFrame([(1, "a", "b", 0, 20, 5, 0)], TRACKS)
    assert {r["state"] for r in regular_series(cuts, tracks).collect()} == {"missing"}
    assert regular_series(cuts, tracks.limit(0)).count() == 0
    with pytest.raises(ValueError):
        regular_series(cuts, tracks, max_fill=9, shard_bins=9)
