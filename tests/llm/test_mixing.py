"""Mixes against budgets worked out by hand."""

import random
from collections import defaultdict

import pytest

from intervane.llm.mixing import mix_shares, mixed, prefix_sums

SIZES = "doc_id BIGINT, source STRING, n_tokens BIGINT, copies INT, mix_name STRING"
TARGETS = "mix_name STRING, source STRING, target_share DOUBLE, max_repeats INT, n_tokens INT"


def test_mixes(spark):
    rng = random.Random(5)
    docs = [(i, rng.choice(["big", "big", "big", "big", "mid", "small", None]), rng.choice([0, rng.randint(1, 900), rng.randint(1, 90)]), 1, "m") for i in range(4000)]
    targets = [("a", "big", 0.5, 1, 1), ("a", "mid", 0.3, 2, 1), ("a", "small", 0.2, 3, 1), ("b", "big", 0.4, 1, 1), ("b", "none", 0.4, 2, 1), ("b", "small", 0.2, 4, 1), ("c", "none", 1.0, 1, 1)]
    sizes, wanted = spark.createDataFrame(docs, SIZES), spark.createDataFrame(targets, TARGETS)
    available = defaultdict(int)
    for _, source, n, *_ in docs:
        available[source] += n
    for bits in (1, 12):
        mix = mixed(sizes, wanted, bucket_bits=bits)
        rows = mix.collect()
        limits = {(m, s): r for m, s, _, r, _ in targets}
        assert all(1 <= r["copies"] <= limits[r["mix_name"], r["source"]] for r in rows)
        shares = {(r["mix_name"], r["source"]): r for r in mix_shares(mix, sizes, wanted).collect()}
        assert len(shares) == len(targets)
        for name, live in (("a", {"big": 0.5, "mid": 0.3, "small": 0.2}), ("b", {"big": 2 / 3, "small": 1 / 3})):
            total = min(limits[name, s] * available[s] / w for s, w in live.items())
            for source, w in live.items():
                got = shares[name, source]
                assert abs(got["tokens"] - w * total) <= 450
                assert got["share"] == pytest.approx(w, abs=0.005)
                taken = [r for r in rows if (r["mix_name"], r["source"]) == (name, source)]
                assert sum(r["copies"] * r["n_tokens"] for r in taken) == got["tokens"]
                assert max(r["copies"] for r in taken) - min(r["copies"] for r in taken) <= 1
        assert shares["b", "none"]["tokens"] == 0
        assert shares["c", "none"]["share"] is None
    # a total that one source cannot give its share of
    total = 4 * available["small"] / 0.2
    capped = {(r["mix_name"], r["source"]): r for r in mix_shares(mixed(sizes, wanted, total=int(total)), sizes, wanted, total=int(total)).collect()}
    small = capped["a", "small"]
    assert small["tokens"] == 3 * available["small"] and abs(small["shortfall"] - available["small"]) <= 1
    assert abs(capped["b", "small"]["tokens"] - min(4 * available["small"], total / 3)) <= 450
    tiny = {r["source"]: r for r in mix_shares(mixed(sizes, wanted, total=9000), sizes, wanted, total=9000).filter("mix_name = 'a'").collect()}
    assert all(r["shortfall"] == 0 for r in tiny.values()) and sum(r["tokens"] for r in tiny.values()) == pytest.approx(9000, abs=1350)
    assert mixed(sizes.limit(0), wanted).count() == 0 == mixed(sizes, wanted.limit(0)).count()


def test_prefix_sums(spark):
    docs = [(i % 97 if i % 5 else None, "ab"[i % 3 == 0], i % 11 + 1, 1, "m") for i in range(500)]
    for bits in (1, 5):
        rows = prefix_sums(spark.createDataFrame(docs, SIZES).select("doc_id", "source", "n_tokens"), bucket_bits=bits).collect()
        for source in "ab":
            at = 0
            mine = sorted((r["before"], r["n_tokens"]) for r in rows if r["source"] == source)
            for before, n in mine:
                assert before == at
                at += n
