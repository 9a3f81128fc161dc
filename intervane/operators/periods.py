"""Continuous periods of overlapping intervals, and the gaps between them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from intervane.operators.shards import running_before, shard_of
from intervane.session import written


def periods(
    intervals: DataFrame,
    keys: Sequence[str] = ("sample", "seqname"),
    start: str = "start_",
    end: str = "end_",
    touching: bool = True,
    sums: Sequence[str] = (),
    tops: Sequence[str] = (),
    shard_width: int = 1 << 20,
) -> DataFrame:
    """Maximal stretches covered by the intervals of each entity: the keys, ``start_``, ``end_``, ``reach``, ``n``, the ``sums`` and the ``tops``.

    Half-open intervals of one entity are sorted by start; an interval opens a
    period when it starts after the running maximum of all earlier ends (at or
    after it, unless ``touching`` intervals continue a period). Openings are
    counted cumulatively to label the periods, which are then aggregated.
    ``reach`` is where the period before ended (null for the first), ``n`` the
    number of intervals, a column of ``sums`` is added up over them, and of one of
    ``tops`` the largest value is kept.

    An entity is cut into shards of ``shard_width`` start positions. Intervals
    with equal starts are first reduced to one row with the largest end (partial
    aggregation before the shuffle), which bounds a shard's rows by its width. What a
    shard makes of its own intervals is written once, so the input is read, and
    whatever computes it runs, only once; the running maximum and the label of the last
    opening pass between shards through one row per shard.

    A null key or coordinate and an empty or reversed interval are left out.
    """
    cells = [f"k{i}" for i in range(len(keys))]
    totals, largest = [f"t{i}" for i in range(len(sums))], [f"x{i}" for i in range(len(tops))]
    add = [*(F.sum(c).alias(c) for c in ("n", *totals)), *(F.max(c).alias(c) for c in largest)]
    spots = (
        intervals.select(
            *(F.col(k).alias(c) for k, c in zip(keys, cells, strict=True)),
            F.col(start).cast("bigint").alias("s"),
            F.col(end).cast("bigint").alias("e"),
            F.lit(1).cast("bigint").alias("n"),
            *(F.col(c).alias(t) for c, t in zip((*sums, *tops), (*totals, *largest), strict=True)),
        )
        .dropna(subset=[*cells, "s", "e"])
        .filter("s < e")
        .groupBy(*cells, shard_of("s", shard_width).alias("shard"), "s")
        .agg(F.max("e").alias("e"), *add)
    )
    inside = Window.partitionBy(*cells, "shard").orderBy("s")

    def opens(reach: Column) -> Column:
        return reach.isNull() | (F.col("s") > reach if touching else F.col("s") >= reach)

    local = (
        spots.withColumn("reach", F.max("e").over(inside.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("label", F.sum(opens(F.col("reach")).cast("bigint")).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*cells, "shard", "label")
        .agg(F.min("s").alias("s"), F.max("e").alias("e"), F.min_by("reach", "s").alias("reach"), *add)
    )
    pieces = written(local.drop("label"))
    shards = pieces.groupBy(*cells, "shard").agg(F.max("e").alias("top"), F.max("s").alias("s"))
    shards = running_before(shards, cells, "shard", F.max("top"), "carried").withColumn("opening", F.when(opens(F.col("carried")), F.col("s")))
    shards = running_before(shards, cells, "shard", F.max("opening"), "open").select(*cells, "shard", "carried", "open")
    fresh = opens(F.col("carried"))
    labelled = (
        pieces.join(shards, [*cells, "shard"])
        .withColumn("label", F.when(fresh, F.col("s")).otherwise(F.col("open")))
        .withColumn("reach", F.when(fresh, F.greatest("reach", "carried")))
        .groupBy(*cells, "label")
        .agg(F.min("s").alias("s"), F.max("e").alias("e"), F.max("reach").alias("reach"), *add)
    )
    names = [F.col(c).alias(k) for k, c in zip(keys, cells, strict=True)]
    return labelled.select(*names, F.col("s").alias("start_"), F.col("e").alias("end_"), "reach", "n", *(F.col(t).alias(c) for c, t in zip((*sums, *tops), (*totals, *largest), strict=True)))


def periods_and_gaps(intervals: DataFrame, keys: Sequence[str] = ("sample", "seqname"), start: str = "start_", end: str = "end_", shard_width: int = 1 << 20) -> DataFrame:
    """Rows ``kind`` ('period' or 'gap'), the keys, ``start_``, ``end_``: see :func:`periods`.

    The gap before a period lies between the running maximum of all earlier ends
    and the start of the period.

    Defined cases: a null key or coordinate and an empty or reversed interval
    are left out; repeated rows change nothing; extra columns are ignored;
    an empty input gives an empty result.
    """
    both = F.array(
        F.struct(F.lit("period").alias("kind"), F.col("start_").alias("s"), F.col("end_").alias("e")),
        F.struct(F.lit("gap").alias("kind"), F.col("reach").alias("s"), F.col("start_").alias("e")),
    )
    rows = periods(intervals, keys, start, end, shard_width=shard_width).select(*keys, F.explode(both).alias("x")).filter("x.s IS NOT NULL")
    return rows.select(F.col("x.kind").alias("kind"), *keys, F.col("x.s").alias("start_"), F.col("x.e").alias("end_"))


def extended(intervals: DataFrame, keys: Sequence[str] = ("seqname",), padding: int = 10_000) -> DataFrame:
    """Intervals widened by ``padding`` on both sides, cut at 0, and merged where they then overlap (touching ones stay apart); those with a null end are left out."""
    wide = intervals.dropna(subset=["start_", "end_"]).select(*keys, F.greatest(F.col("start_") - padding, F.lit(0)).alias("start_"), (F.col("end_") + padding).alias("end_"))
    return periods(wide, keys, touching=False).select(*keys, "start_", "end_", F.col("n").alias("n_merged"))


def merged(intervals: DataFrame, keys: Sequence[str] = ("seqname",), mean: str = "mean") -> DataFrame:
    """Overlapping intervals (touching ones stay apart) as one, with the average of their ``mean``."""
    rows = intervals.select(*keys, "start_", "end_", F.col(mean).alias("total"), F.col(mean).isNotNull().cast("bigint").alias("known"))
    return periods(rows, keys, touching=False, sums=("total", "known")).select(
        *keys, "start_", "end_", F.col("n").alias("n_merged"), F.try_divide("total", "known").alias("mean")
    )


def covered_fraction(intervals: DataFrame) -> DataFrame:
    """One row: summed interval lengths, summed reach of the sequences (largest end of each), and their ratio."""
    per_sequence = intervals.groupBy("seqname").agg(F.sum(F.col("end_") - F.col("start_")).alias("length"), F.max("end_").alias("reach"))
    return per_sequence.agg(F.sum("length").alias("covered"), F.sum("reach").alias("reach")).withColumn("fraction", F.try_divide("covered", "reach"))
