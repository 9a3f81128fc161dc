"""Splitting ordered entities into position shards and carrying state between them.

One entity (a sequence of a sample, a track) may hold a third of all rows, so
no window or Python group here spans an entity. Rows are first reduced to one
per position, cut into shards of a fixed number of positions - a shard then
holds at most that many rows - and what earlier shards pass on is computed on
one row per shard.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from intervane.session import written


def shard_of(position: Column | str, width: int) -> Column:
    """Number of the shard that holds ``position``."""
    position = F.col(position) if isinstance(position, str) else position
    return F.floor(position / F.lit(width)).cast("bigint") if width & (width - 1) else F.shiftright(position, width.bit_length() - 1)


def running_before(per_shard: DataFrame, keys: list[str], shard: str, value: Column, name: str) -> DataFrame:
    """``per_shard`` (one row per entity and shard) with ``value`` aggregated over the entity's earlier shards."""
    earlier = Window.partitionBy(*keys).orderBy(shard).rowsBetween(Window.unboundedPreceding, -1)
    return per_shard.withColumn(name, value.over(earlier))


def running_totals(rows: DataFrame, keys: list[str], position: str, values: Mapping[str, str], width: int = 1 << 20) -> DataFrame:
    """``rows`` (one per entity and position) with sums up to each position: new column name to summed column.

    Prefix sums within shards, shifted by the sums of the shards before, which are
    worked out on one row per shard.
    """
    rows = rows.withColumn("__shard", shard_of(position, width))
    inside = Window.partitionBy(*keys, "__shard").orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    shifts = rows.groupBy(*keys, "__shard").agg(*(F.sum(v).alias(f"__{n}") for n, v in values.items()))
    for n in values:
        shifts = running_before(shifts, keys, "__shard", F.sum(f"__{n}"), f"__before_{n}")
    out = rows.withColumns({n: F.sum(v).over(inside) for n, v in values.items()}).join(shifts.drop(*(f"__{n}" for n in values)), [*keys, "__shard"])
    return out.withColumns({n: F.col(n) + F.coalesce(f"__before_{n}", F.lit(0)) for n in values}).drop("__shard", *(f"__before_{n}" for n in values))


def running_total(rows: DataFrame, keys: list[str], position: str, value: str, name: str, width: int = 1 << 20) -> DataFrame:
    """``rows`` (one per entity and position) with ``name``: the sum of ``value`` up to each position."""
    return running_totals(rows, keys, position, {name: value}, width)


def numbered(rows: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """``rows`` with their number (from 0) in the order of the columns ``order``.

    Rows are range-partitioned over all of the order, so that an entity, or a
    position with any number of rows, is spread over tasks; places within the
    sorted partitions are written once and shifted by the sizes of the partitions
    before, one row each. Equal rows are numbered in any order.
    """
    placed = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__place", F.monotonically_increasing_id()))
    part = F.shiftright("__place", 33).alias("__part")
    sizes = placed.groupBy(part).agg(F.count("*").alias("__n"))
    sizes = sizes.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__ahead"))
    inside = F.col("__place").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("__part", part).join(sizes, "__part").withColumn(name, F.col("__ahead") + inside).drop("__part", "__place", "__ahead")


def in_rounds(rows: DataFrame, keys: Sequence[str], turn: str, step: Callable[[tuple, pa.Table, pa.Table], pa.Table], schema: str, last_state: bool = False) -> DataFrame:
    """Results of a sequential pass over the shards of every group; ``turn`` numbers the shards of a group from 0.

    ``step(key, shard, state)`` gets the rows of one shard (none if the group has
    none there) and what the step on the shard before left for the next one; its
    rows have the columns of ``schema``, and those with ``is_state`` true are that
    state. Round r is one Spark job over shard r of all groups, and state passes
    through a written table, so a task holds one shard of one group however long the
    group is; groups of one shard are done in the first round. The number of rounds
    is that of the shards of the longest group. With ``last_state`` the state that
    is left at the end is part of the result.
    """
    last = rows.agg(F.max(turn)).first()[0]
    spark = rows.sparkSession
    done, state = [], spark.createDataFrame([], schema)
    for r in range(0 if last is None else last + 1):
        made = written(rows.filter(F.col(turn) == r).groupBy(*keys).cogroup(state.groupBy(*keys)).applyInArrow(step, schema))
        done.append(made.filter("NOT is_state"))
        state = made.filter("is_state")
    done += [state] if last_state else []
    return reduce(DataFrame.unionByName, done, spark.createDataFrame([], schema)).drop("is_state")


def with_neighbours(rows: DataFrame, keys: list[str], position: str, width: int = 1 << 20) -> DataFrame:
    """``rows`` (one per entity and position) with ``before`` and ``after``: the nearest positions of the entity.

    Within a shard they are the neighbouring rows; at its edges the last position
    of the occupied shard before and the first of the one after.
    """
    rows = rows.withColumn("__shard", shard_of(position, width))
    inside = Window.partitionBy(*keys, "__shard").orderBy(position)
    order = Window.partitionBy(*keys).orderBy("__shard")
    edges = rows.groupBy(*keys, "__shard").agg(F.min(position).alias("__first"), F.max(position).alias("__last"))
    edges = edges.select(*keys, "__shard", F.lag("__last").over(order).alias("__left"), F.lead("__first").over(order).alias("__right"))
    return (
        rows.join(edges, [*keys, "__shard"])
        .withColumn("before", F.coalesce(F.lag(position).over(inside), F.col("__left")))
        .withColumn("after", F.coalesce(F.lead(position).over(inside), F.col("__right")))
        .drop("__shard", "__left", "__right")
    )


def with_halo(rows: DataFrame, position: str, reach: int, width: int = 1 << 20) -> DataFrame:
    """``rows`` in every shard within ``reach`` of them: ``shard``, and ``own`` for the one they belong to."""
    lowest, highest = shard_of(F.col(position) - reach, width), shard_of(F.col(position) + reach, width)
    return rows.withColumn("shard", F.explode(F.sequence(lowest, highest))).withColumn("own", F.col("shard") == shard_of(position, width))
