"""Runs against a walk over the sorted events."""

import random

import numpy as np
import pytest

from intervane.llm.runs import agglomerate, collapsed_runs, repeated_events

SCHEMA = "cut_id BIGINT, sample STRING, seqname STRING, location BIGINT, run STRING, k0 INT, at INT"


def brute(rows, max_gap):
    groups = {}
    for cut, sample, seqname, at, *_ in set(rows):
        if None not in (cut, sample, seqname, at):
            groups.setdefault((sample, seqname), []).append((at, cut))
    runs = []
    for key, events in groups.items():
        run = []
        for event in sorted(events):
            if run and event[0] - run[-1][0] > max_gap:
                runs.append((key, run))
                run = []
            run.append(event)
        runs.append((key, run))
    found = {(min(c for _, c in run), c) for _, run in runs for _, c in run}
    return sorted(x for x in found if x[0] < x[1]), sorted((*key, min(c for _, c in run), len(run), run[0][0], run[-1][0], run[-1][0] - run[0][0] + 1) for key, run in runs)


@pytest.mark.parametrize(("seed", "max_gap", "width", "span"), [(1, 2, 1 << 20, 300), (2, 2, 4, 300), (3, 0, 4, 60), (4, 3, 1, 300), (5, 2, 7, 5000), (6, 40, 8, 3000)])
def test_runs(spark, seed, max_gap, width, span):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["a", "a", "b", None]), rng.choice(["x", "y", None]), rng.choice([rng.randint(-span, span), 17, rng.randint(-span, span), None]), "r", 1, 1) for i in rng.sample(range(9999), 700)]
    rows += rows[:60]
    events = spark.createDataFrame(rows, SCHEMA)
    found, runs = brute(rows, max_gap)
    assert sorted(tuple(r) for r in repeated_events(events, max_gap=max_gap, shard_width=width).collect()) == found
    assert sorted(tuple(r) for r in collapsed_runs(events, max_gap=max_gap, shard_width=width).collect()) == runs


def test_similarity_and_edges(spark):
    rows = [(1, "a", "x", 0, "", 1, 1), (2, "a", "x", 1, "", 1, 1), (3, "a", "x", 3, "", 1, 1), (3, "a", "x", 3, "", 1, 1)]
    events = spark.createDataFrame(rows, SCHEMA)
    assert [tuple(r) for r in repeated_events(events, min_similarity=0.5).collect()] == [(1, 2)]
    assert repeated_events(spark.createDataFrame(rows[2:], SCHEMA)).collect() == []
    assert repeated_events(events.limit(0)).collect() == [] == collapsed_runs(events.limit(0)).collect()
    with pytest.raises(ValueError):
        repeated_events(events, max_gap=-1)


def test_one_long_run_over_many_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        events = spark.range(3000).selectExpr("id AS cut_id", "'a' AS sample", "'x' AS seqname", "id * 2 + CASE WHEN id >= 1500 THEN 9 ELSE 0 END AS location")
        got = sorted((r["first_id"], r["n_events"]) for r in collapsed_runs(events, shard_width=1024).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == [(0, 1500), (1500, 1500)]


def test_agglomerate():
    at, breaks = np.array([1, 2, 9, 10, 10, 30]), np.array([True, False, False, False, True, False])
    assert agglomerate(at, breaks, 2, 0.0).tolist() == [0, 0, 2, 2, 4, 5]
    assert agglomerate(at[:0], breaks[:0], 2, 0.0).tolist() == []
