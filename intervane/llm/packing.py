"""Texts packed into containers of fixed capacities."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ASSIGNED = "pack_name STRING, container_id BIGINT, step_group BIGINT, tier BIGINT, doc_id BIGINT, piece INT, n_tokens BIGINT, offset BIGINT"


class _Open:
    """Containers by the space they have left, one bit per space, so a best fit costs a few word operations however many there are."""

    def __init__(self, capacity: int):
        self.by_space: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.spaces = 0  # bit s: some container has s left

    def take(self, size: int) -> tuple[int, int] | None:
        """The fullest container with room for ``size`` and the space it has; it is no longer open."""
        fitting = self.spaces >> size
        if not fitting:
            return None
        space = size + (fitting & -fitting).bit_length() - 1
        container = self.by_space[space].pop()
        if not self.by_space[space]:
            self.spaces &= ~(1 << space)
        return container, space

    def put(self, container: int, space: int) -> None:
        if space > 0:
            self.by_space[space].append(container)
            self.spaces |= 1 << space


def _windows(items: Sequence[int], sizes: Sequence[int], window: int) -> list[tuple[int, list[int]]]:
    """The items of a tier packed into windows of its own size, largest first, each into the fullest with room: (load, items)."""
    open_, loads, members = _Open(window), [], []
    for item in items:
        found = open_.take(sizes[item])
        at, space = found if found else (len(loads), window)
        if not found:
            loads.append(0)
            members.append([])
        loads[at] += sizes[item]
        members[at].append(item)
        open_.put(at, space - sizes[item])
    return list(zip(loads, members, strict=True))


def context_tiers(capacity: int, ratio: int = 4, least: int = 32) -> list[int]:
    """Context sizes from the capacity down, each a ``ratio``-th of the one before, none below ``least``."""
    out = [capacity]
    while out[-1] // ratio >= least:
        out.append(out[-1] // ratio)
    return out


def pack_tiers(sizes: Sequence[int], capacity: int, tiers: Sequence[int], spare: int = 5) -> tuple[list[int], list[int], list[int]]:
    """Container, offset and tier of every item, by hierarchical multi-length packing.

    Items are routed to the smallest tier (context size) that holds them, and every
    tier is packed by itself into windows of its own size. From the longest tier down,
    a tier then fills what longer tiers left in the containers: windows, the least full
    and of those the ones of small items first, are opened until their items could fill all of those gaps ``spare`` times (a
    choice of items makes for a close fit), and so is any window with space left, which
    it would take along. Their items go one by one into the fullest container with room;
    the other windows go whole, several to a container.
    """
    bounds = sorted({t for t in tiers if t < capacity} | {capacity})
    routed: list[list[int]] = [[] for _ in bounds]
    for item, size in enumerate(sizes):
        routed[bisect_left(bounds, size)].append(item)
    where, offset, tier_of = [0] * len(sizes), [0] * len(sizes), [0] * len(sizes)
    open_, n, gaps = _Open(capacity), 0, 0
    for window, items in zip(reversed(bounds), reversed(routed), strict=True):
        items.sort(key=lambda i: (-sizes[i], i))
        loose, whole, opened = [], [], 0
        for load, members in sorted(_windows(items, sizes, window), key=lambda w: (w[0], sizes[w[1][0]], w[1][0])):
            if opened < spare * gaps or load < window:
                loose += [(sizes[i], [i]) for i in members]
                opened += load
            else:
                whole.append((load, members))
        for load, members in sorted(loose, key=lambda w: (-w[0], w[1][0])) + whole[::-1]:
            found = open_.take(load)
            container, space = found if found else (n, capacity)
            n += not found
            gaps += (0 if found else capacity) - load
            at = capacity - space
            for item in members:
                where[item], offset[item], tier_of[item] = container, at, window
                at += sizes[item]
            open_.put(container, space - load)
    return where, offset, tier_of


def balanced_groups(costs: Sequence[float], group_size: int) -> list[int]:
    """Group of every container: dealt back and forth over the groups in order of cost."""
    groups = max(1, -(-len(costs) // group_size))
    out = [0] * len(costs)
    for turn, container in enumerate(sorted(range(len(costs)), key=lambda c: (-costs[c], c))):
        lap, seat = divmod(turn, groups)
        out[container] = seat if lap % 2 == 0 else groups - 1 - seat
    return out


def packed(sizes: DataFrame, capacities: Mapping[str, int], shard_items: int = 20_000, group_size: int = 64) -> DataFrame:
    """Every text assigned to containers of every capacity.

    ``sizes``: doc_id, n_tokens, read several times (write it before if it is
    dear). ``capacities``: name of a pack to its capacity, a handful of settings.
    Result: pack_name, container_id, step_group, tier, doc_id, piece (from 0),
    n_tokens and offset of the piece within its container.

    For each pack all texts are packed by themselves. A text longer than the
    capacity is divided into full pieces, which fill containers alone, and a rest;
    no other text is divided. Pieces are routed to the context sizes of
    :func:`context_tiers`, packed tier by tier, and gaps of longer windows are filled from
    shorter tiers (see :func:`pack_tiers`); ``tier`` is the context size of a piece.
    Containers are then dealt to step groups of ``group_size`` so that the groups of a
    shard cost about the same and mix the tiers alike, the cost of a container being
    the sum of its squared text lengths (attention within texts).

    Items are spread over shards of about ``shard_items`` by a hash of the
    document and the piece, and every shard is packed by one task, so memory is
    bounded by the shard and only the last containers of a shard stay unfilled.

    Defined cases: a text without tokens (null or empty) takes no space and comes
    out with a null container; repeated rows are packed as often as they occur; a
    null size is left out; extra columns are ignored; empty tables give empty
    results; a capacity below 1 is an error.
    """
    if any(c < 1 for c in capacities.values()):
        raise ValueError("capacities must be positive")
    sizes = sizes.select("doc_id", F.col("n_tokens").cast("bigint").alias("n_tokens")).filter("n_tokens >= 0")
    if not capacities:
        return sizes.sparkSession.createDataFrame([], _ASSIGNED)
    pieces = sizes.agg(*(F.sum(F.expr(f"(n_tokens + {c - 1}) div {c}")).alias(f"n{i}") for i, c in enumerate(capacities.values()))).first()
    packs = F.array(
        *(
            F.struct(F.lit(name).alias("pack_name"), F.lit(c).cast("bigint").alias("capacity"), F.lit(max(1, -(-(pieces[i] or 0) // shard_items))).cast("bigint").alias("shards"))
            for i, (name, c) in enumerate(capacities.items())
        )
    )
    wanted = sizes.select("doc_id", "n_tokens", F.explode(packs).alias("pack")).select("doc_id", F.col("n_tokens").alias("whole"), "pack.*")
    items = (
        wanted.filter("whole > 0")
        .select("pack_name", "capacity", "shards", "doc_id", "whole", F.posexplode(F.expr("sequence(0L, whole - 1, capacity)")).alias("piece", "begin"))
        .select("pack_name", "capacity", F.expr("pmod(xxhash64(doc_id, piece, 7), shards)").alias("shard"), "doc_id", "piece", F.expr("least(capacity, whole - begin)").alias("size"))
    )

    def pack(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["size", "doc_id", "piece"], ascending=[False, True, True], kind="stable", ignore_index=True)
        capacity = int(frame["capacity"].iloc[0])
        frame["local"], frame["offset"], frame["tier"] = pack_tiers(frame["size"].tolist(), capacity, context_tiers(capacity))
        costs = (frame["size"].astype("float64") ** 2).groupby(frame["local"]).sum()
        groups = pd.Series(balanced_groups(costs.tolist(), group_size), index=costs.index)
        base = int(key[1]) << 32
        return pd.DataFrame(
            {
                "pack_name": frame["pack_name"],
                "container_id": frame["local"] + base,
                "step_group": frame["local"].map(groups) + base,
                "tier": frame["tier"],
                "doc_id": frame["doc_id"],
                "piece": frame["piece"],
                "n_tokens": frame["size"],
                "offset": frame["offset"],
            }
        )

    assigned = items.groupBy("pack_name", "shard").applyInPandas(pack, _ASSIGNED)
    none = F.lit(None).cast("bigint")
    empty = wanted.filter("whole = 0").select(
        "pack_name", none.alias("container_id"), none.alias("step_group"), none.alias("tier"), "doc_id", F.lit(0).alias("piece"), F.col("whole").alias("n_tokens"), F.lit(0).cast("bigint").alias("offset")
    )
    return assigned.unionByName(empty)


def pack_usage(assigned: DataFrame, capacities: Mapping[str, int]) -> DataFrame:
    """Per pack: containers, pieces, tokens, and the share of the capacity that is used."""
    piece = assigned.filter("container_id IS NOT NULL")
    containers = piece.groupBy("pack_name", "container_id").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("pieces"))
    capacity = F.create_map(*(F.lit(x) for pair in capacities.items() for x in pair))[F.col("pack_name")]
    return (
        containers.groupBy("pack_name")
        .agg(F.count("*").alias("n_containers"), F.sum("pieces").alias("n_pieces"), F.sum("tokens").alias("n_tokens"))
        .withColumn("fill", F.col("n_tokens") / (F.col("n_containers") * capacity))
    )


def packing_faults(assigned: DataFrame, sizes: DataFrame, capacities: Mapping[str, int]) -> DataFrame:
    """What must not happen, per pack: pack_name, n_texts, n_lost (tokens missing or twice), n_overfull (containers whose pieces overlap or
    do not fit), n_divided (texts in more pieces than their size needs)."""
    capacity = F.create_map(*(F.lit(x) for pair in capacities.items() for x in pair))[F.col("pack_name")]
    pieces = assigned.select("pack_name", "doc_id", "n_tokens", "container_id", "offset")
    wanted = sizes.filter("n_tokens >= 0").select(F.explode(F.array(*(F.lit(n) for n in capacities))).alias("pack_name"), "doc_id", "n_tokens")
    needs = F.greatest(F.ceil(F.col("n_tokens") / capacity), F.lit(1))
    texts = wanted.groupBy("pack_name", "doc_id").agg(F.sum("n_tokens").alias("tokens"), F.sum(needs).alias("pieces"), F.count("*").alias("texts"))
    got = pieces.groupBy("pack_name", F.col("doc_id").alias("of")).agg(F.sum("n_tokens").alias("got"), F.count("*").alias("n"))
    both = texts.join(got.withColumnRenamed("pack_name", "in_pack"), (F.col("pack_name") == F.col("in_pack")) & F.col("doc_id").eqNullSafe(F.col("of")), "full")
    by_text = both.groupBy(F.coalesce("pack_name", "in_pack").alias("pack_name")).agg(
        F.coalesce(F.sum("texts"), F.lit(0)).alias("n_texts"),
        F.sum(F.abs(F.coalesce("tokens", F.lit(0)) - F.coalesce("got", F.lit(0)))).alias("n_lost"),
        F.sum((F.coalesce("n", F.lit(0)) != F.coalesce("pieces", F.lit(0))).cast("bigint")).alias("n_divided"),
    )
    # in a sound container the last piece ends where the sum of the sizes does
    loads = pieces.filter("container_id IS NOT NULL").groupBy("pack_name", "container_id").agg(F.sum("n_tokens").alias("load"), F.max(F.col("offset") + F.col("n_tokens")).alias("end"))
    bad = loads.groupBy("pack_name").agg(F.sum(((F.col("load") > capacity) | (F.col("load") != F.col("end"))).cast("bigint")).alias("n_overfull"))
    return by_text.join(bad, "pack_name", "left").select("pack_name", "n_texts", "n_lost", F.coalesce("n_overfull", F.lit(0)).alias("n_overfull"), "n_divided")
