"""Packing: every token once, no overfull container, little waste."""

import random
from collections import Counter, defaultdict

import pytest

from intervane.llm.packing import balanced_groups, context_tiers, pack_tiers, pack_usage, packed, packing_faults

SCHEMA = "doc_id BIGINT, n_tokens BIGINT, piece STRING, pack_name STRING"


def check(rows, sizes, capacities):
    by_pack = defaultdict(list)
    for r in rows:
        by_pack[r["pack_name"]].append(r)
    for name, capacity in capacities.items():
        want = Counter()
        for doc, n in sizes:
            if n is not None:
                for i in range(max(1, -(-n // capacity))):
                    want[doc, i, min(capacity, n - i * capacity)] += 1
        assert Counter((r["doc_id"], r["piece"], r["n_tokens"]) for r in by_pack[name]) == want
        inside = defaultdict(list)
        for r in by_pack[name]:
            assert (r["container_id"] is None) == (r["n_tokens"] == 0)
            if r["n_tokens"]:
                inside[r["container_id"]].append((r["offset"], r["n_tokens"]))
        for spans in inside.values():
            at = 0
            for offset, n in sorted(spans):
                assert offset == at
                at += n
            assert at <= capacity


@pytest.mark.parametrize(("seed", "shard"), [(1, 20_000), (2, 100)])
def test_packed(spark, seed, shard):
    rng = random.Random(seed)
    sizes = [(i, rng.choice([rng.randint(0, 40), rng.randint(1, 700), 64, None, 0])) for i in range(600)] + [(None, 30), (5, 9), (5, 9)]
    capacities = {"short": 16, "medium": 64, "long": 256}
    source = spark.createDataFrame([(*x, "p", "q") for x in sizes], SCHEMA)
    frame = packed(source, capacities, shard_items=shard, group_size=4).cache()
    rows = frame.collect()
    check(rows, sizes, capacities)
    faults = packing_faults(frame, source, capacities).collect()
    assert {r["pack_name"] for r in faults} == set(capacities) and all(r["n_lost"] == r["n_overfull"] == r["n_divided"] == 0 for r in faults)
    for r in pack_usage(frame, capacities).collect():
        assert r["fill"] > (0.99 if shard > 1000 else 0.9)
        assert r["n_tokens"] == sum(n or 0 for _, n in sizes)
    cost, members = Counter(), defaultdict(set)
    for r in rows:
        if r["pack_name"] == "long" and r["container_id"] is not None:
            cost[r["step_group"]] += r["n_tokens"] ** 2
            members[r["step_group"]].add(r["container_id"])
    assert all(len(x) <= 4 for x in members.values())


def test_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert packed(empty, {"a": 5}).count() == 0
    assert packed(spark.createDataFrame([(1, 3, "", "")], SCHEMA), {}).count() == 0
    with pytest.raises(ValueError):
        packed(empty, {"a": 0})


def test_pack_tiers_against_lower_bound():
    rng = random.Random(3)
    for _ in range(30):
        capacity = rng.randint(5, 200)
        sizes = [rng.randint(1, capacity) for _ in range(rng.randint(0, 300))]
        where, offset, tier = pack_tiers(sizes, capacity, [capacity // 4, capacity // 2, capacity, capacity * 4])
        load, spans = Counter(), defaultdict(list)
        for s, c, o, t in zip(sizes, where, offset, tier):
            load[c] += s
            spans[c].append((o, s))
            assert s <= t and t in (capacity // 4, capacity // 2, capacity) and not any(s <= x < t for x in (capacity // 4, capacity // 2))
        for c, inside in spans.items():
            inside.sort()
            assert [o for o, _ in inside] == [sum(s for _, s in inside[:i]) for i in range(len(inside))]
        assert all(x <= capacity for x in load.values())
        assert sorted(load) == list(range(len(load)))
        # no two containers could be one
        light = sorted(load.values())[:2]
        assert len(light) < 2 or sum(light) > capacity


def test_tiers_shape_the_containers():
    """Short texts fill windows of their own size, which go into containers whole; texts of long windows are completed from shorter tiers."""
    rng = random.Random(8)
    sizes = [rng.randint(1, 8) for _ in range(4000)]
    assert context_tiers(64, 4, 4) == [64, 16, 4]
    where, offset, tier = pack_tiers(sizes, 64, [64, 16])
    assert (where, offset) != pack_tiers(sizes, 64, [])[:2] and set(tier) == {16}
    crossing = sum(o // 16 != (o + s - 1) // 16 for o, s in zip(offset, sizes))
    plain = pack_tiers(sizes, 64, [])
    assert crossing < 0.02 * len(sizes) < sum(o // 16 != (o + s - 1) // 16 for o, s in zip(plain[1], sizes))
    long = [rng.randint(40, 63) for _ in range(100)]
    where, _, tier = pack_tiers([*sizes, *long], 64, [64, 16])
    load = Counter()
    for c, s in zip(where, [*sizes, *long]):
        load[c] += s
    assert tier[4000:] == [64] * 100 and all(load[c] == 64 for c in where[4000:])
    assert len(load) == -(-sum(load.values()) // 64)


def test_balanced_groups():
    costs = [float(x) for x in range(40)]
    groups = balanced_groups(costs, 10)
    totals = Counter()
    for g, c in zip(groups, costs):
        totals[g] += c
    assert set(Counter(groups).values()) == {10}
    assert max(totals.values()) - min(totals.values()) <= 10
    assert balanced_groups([], 5) == []
