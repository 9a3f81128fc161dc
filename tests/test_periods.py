"""Periods and gaps against a sweep over sorted intervals."""

import random

import pytest

from intervane.operators.periods import periods_and_gaps

SCHEMA = "sample STRING, seqname STRING, start_ BIGINT, end_ BIGINT, kind STRING, shard INT"


def brute(rows):
    groups = {}
    for sample, seqname, s, e, *_ in rows:
        if None not in (sample, seqname, s, e) and s < e:
            groups.setdefault((sample, seqname), []).append((s, e))
    out = []
    for key, spans in groups.items():
        merged = []
        for s, e in sorted(spans):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        out += [("period", *key, s, e) for s, e in merged]
        out += [("gap", *key, a[1], b[0]) for a, b in zip(merged, merged[1:])]
    return sorted(out)


@pytest.mark.parametrize("width", [1, 8, 10, 1 << 20])
@pytest.mark.parametrize("seed", range(3))
def test_periods(spark, width, seed):
    rng = random.Random(seed)
    pick = lambda *x: rng.choice(x)
    rows = []
    for _ in range(400):
        s = rng.randint(-60, 400) if seed else rng.randint(0, 3000)
        rows.append((pick("a", "a", "b", None), pick("x", "x", "y", None), pick(s, s, s, None), pick(s + rng.randint(-2, 12), s + rng.randint(1, 90), None), "k", 1))
    rows += rows[:50]
    got = sorted(tuple(r) for r in periods_and_gaps(spark.createDataFrame(rows, SCHEMA), shard_width=width).collect())
    assert got == brute(rows)


def test_edges(spark):
    make = lambda rows: periods_and_gaps(spark.createDataFrame(rows, SCHEMA), shard_width=16)
    assert make([]).collect() == []
    rows = [("a", "x", 0, 10**12, "", 1), ("a", "x", 50, 60, "", 1), ("a", "x", 10**12, 10**12 + 1, "", 1), ("a", "x", 10**12 + 2, 10**12 + 3, "", 1), ("a", "x", 5, 5, "", 1)]
    assert sorted(tuple(r) for r in make(rows).collect()) == brute(rows)
