"""Joins of points and intervals by position.

Spark has no range join, so positions are binned and joined on (keys, bin) with
the exact predicate on top. Only intervals are multiplied (by the bins they
touch), points never, and a pair of intervals is reported in the one bin where the
later of the two begins. Spark may broadcast a small side by its size; otherwise both
sides are shuffled by bin, where adaptive execution splits dense bins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from intervane.operators.shards import shard_of

BIN = 1 << 16


def _binned(intervals: DataFrame, start: str, end: str, width: int) -> DataFrame:
    """Intervals once per bin they touch (``end`` taken as inclusive)."""
    usable = intervals.filter(F.col(start).isNotNull() & (F.col(end) >= F.col(start)))
    return usable.withColumn("__bin", F.explode(F.sequence(shard_of(start, width), shard_of(end, width))))


def _renamed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*(F.col(c).alias(prefix + c) for c in df.columns))


def _equal(keys: Sequence[str], prefix: str) -> Column:
    condition = F.col("__bin") == F.col(f"{prefix}__bin")
    for k in keys:
        condition = condition & (F.col(k) == F.col(prefix + k))
    return condition


def points_in_intervals(points: DataFrame, intervals: DataFrame, keys: Sequence[str] = ("seqname",), location: str = "location", how: str = "inner", width: int = BIN) -> DataFrame:
    """Points with the intervals that contain them, both ends inclusive.

    ``how``: ``inner`` (one row per containing interval, its columns prefixed
    ``i_``), ``left_semi`` or ``left_anti`` (points within any or none). Points with a
    null key or location are in no interval; reversed intervals contain nothing.
    """
    right = _renamed(_binned(intervals, "start_", "end_", width), "i_")
    left = points.withColumn("__bin", shard_of(location, width))
    within = (F.col("i_start_") <= F.col(location)) & (F.col(location) <= F.col("i_end_"))
    return left.join(right, _equal(keys, "i_") & within, how).drop("__bin", "i___bin")


def overlapping_pairs(left: DataFrame, right: DataFrame, keys: Sequence[str] = ("seqname",), width: int = BIN) -> DataFrame:
    """Pairs with ``right.start < left.end`` and ``left.start <= right.end``; right columns are prefixed ``r_``.

    A left interval may end where the right one starts only by overlap, but may
    start exactly where the right one ends. Each pair comes once.
    """
    a, b = _binned(left, "start_", "end_", width), _renamed(_binned(right, "start_", "end_", width), "r_")
    met = (F.col("r_start_") < F.col("end_")) & (F.col("start_") <= F.col("r_end_"))
    once = F.col("__bin") == shard_of(F.greatest("start_", "r_start_"), width)
    return a.join(b, _equal(keys, "r_") & met & once).drop("__bin", "r___bin")


def not_overlapping(left: DataFrame, right: DataFrame, keys: Sequence[str] = ("seqname",), width: int = BIN) -> DataFrame:
    """Left intervals that overlap no right one (see :func:`overlapping_pairs`); needs a unique column ``interval_id``."""
    hit = overlapping_pairs(left, right, keys, width).select("interval_id").distinct()
    return left.join(hit, "interval_id", "left_anti")


def centred_in(rows: DataFrame, seqname: str, low: int, high: int) -> DataFrame:
    """Intervals of one sequence whose midpoint lies strictly between ``low`` and ``high``."""
    twice = F.col("start_") + F.col("end_")
    return rows.filter((F.col("seqname") == seqname) & (twice > 2 * low) & (twice < 2 * high))


def region(rows: DataFrame, seqname: str, low: int, high: int) -> DataFrame:
    """Intervals of one sequence that reach into ``low..high``; pushed down to the scan."""
    return rows.filter((F.col("seqname") == seqname) & (F.col("end_") >= low) & (F.col("start_") <= high))
