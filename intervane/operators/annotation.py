"""Features by region or name, and lanes for drawing intervals."""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from intervane.errors import NotARegion
from intervane.functions.regions import read_region
from intervane.operators.coverage import depth_segments
from intervane.operators.periods import periods
from intervane.operators.range_join import points_in_intervals
from intervane.operators.shards import in_rounds, numbered

_LOOKUPS = ("gene_name", "gene_id", "transcript_id")


def stranded(features: DataFrame) -> DataFrame:
    """``features`` with ``stranded_start`` and ``stranded_end``: exchanged on the minus strand."""
    minus = F.col("strand") == "-"
    return features.withColumn("stranded_start", F.when(minus, F.col("end_")).otherwise(F.col("start_"))).withColumn("stranded_end", F.when(minus, F.col("start_")).otherwise(F.col("end_")))


def resolved_feature(features: DataFrame, feature: str, padding: int = 0) -> DataFrame:
    """Where ``feature`` lies: at most one row seqname, start_, end_, found_as.

    A region string is taken as it is; else the features of that gene name, or
    failing that gene id, or transcript id, from the first start to the last end. One
    filtered scan that reads six columns.
    """
    try:
        seqname, low, high = read_region(feature)
    except NotARegion:
        level = F.lit(None).cast("int")
        for i, c in reversed(list(enumerate(_LOOKUPS))):
            level = F.when(F.col(c) == feature, i).otherwise(level)
        hits = features.withColumn("level", level).filter("level IS NOT NULL")
        spans = hits.groupBy("level", "seqname").agg(F.min("start_").alias("start_"), F.max("end_").alias("end_"))
        first = spans.groupBy().agg(F.min(F.struct("level", "seqname", "start_", "end_")).alias("x")).filter("x IS NOT NULL")
        names = F.array(*(F.lit(c) for c in _LOOKUPS))
        return first.select("x.seqname", (F.col("x.start_") - padding).alias("start_"), (F.col("x.end_") + padding).alias("end_"), F.get(names, F.col("x.level")).alias("found_as"))
    return features.sparkSession.range(1).select(
        F.lit(seqname).alias("seqname"), F.lit(low - padding).cast("bigint").alias("start_"), F.lit(high + padding).cast("bigint").alias("end_"), F.lit("region").alias("found_as")
    )


def place_in_lanes(starts: list[int], ends: list[int], padding: int, busy: list[tuple[int, int]]) -> list[int]:
    """Lane (0, 1, 2, ...) of every interval, taken in order; ``busy``, a heap of (end, lane), is brought up to date.

    Lanes are freed as starts pass them, and the lowest free one is taken from a heap.
    """
    taken = {lane for _, lane in busy}
    free = [lane for lane in range(max(taken, default=-1) + 1) if lane not in taken]
    lanes_used, out = len(free) + len(taken), []
    for start, end in zip(starts, ends, strict=True):
        while busy and busy[0][0] + padding < start:
            heapq.heappush(free, heapq.heappop(busy)[1])
        if free:
            lane = heapq.heappop(free)
        else:
            lane, lanes_used = lanes_used, lanes_used + 1
        heapq.heappush(busy, (end, lane))
        out.append(lane)
    return out


def lanes(intervals: DataFrame, keys: list[str], padding: int = 0, shard_rows: int = 100_000) -> DataFrame:
    """``intervals`` with ``lane``: the lowest of the levels 0, -2, -4, ... that is free from its start on.

    ``intervals``: the keys, start_, end_, interval_id, taken in order of start, end
    and id. A lane is free once the end of the interval on it lies more than ``padding``
    before the start. Intervals farther apart need not know of each other, so the rows
    are cut into stretches; a stretch is cut into shards of ``shard_rows`` intervals,
    and what goes from one shard to the next are the busy lanes (see
    :func:`intervane.operators.shards.in_rounds`). Rows with a null and empty or reversed
    intervals are left out.
    """
    rows = intervals.select(*keys, "start_", "end_", "interval_id").dropna().filter("start_ < end_")
    wide = rows.withColumn("end_", F.col("end_") + padding)
    groups = periods(wide, keys).select(*keys, "start_", (F.col("end_") - 1).alias("end_"))
    located = points_in_intervals(rows, groups, keys, location="start_").drop("i_end_", *(f"i_{k}" for k in keys))
    stretch = [*keys, "i_start_"]
    ordered = numbered(located, [*stretch, "start_", "end_", "interval_id"], "number")
    first = ordered.groupBy(*stretch).agg(F.min("number").alias("first"), F.count("*").alias("size"))
    ordered = ordered.join(first, stretch).withColumn("turn", F.expr(f"(number - first) div {shard_rows}")).drop("first")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in located.schema) + ", lane INT, busy_end BIGINT, is_state BOOLEAN"
    names = located.columns

    def step(key: tuple, shard: pa.Table, left: pa.Table) -> pa.Table:
        shard = shard.sort_by("number")
        busy = sorted(zip(left["busy_end"].to_pylist(), left["lane"].to_pylist(), strict=True))
        placed = place_in_lanes(shard["start_"].to_pylist(), shard["end_"].to_pylist(), padding, busy)
        out = shard.select(names)
        added = {"lane": pa.array([-2 * x for x in placed], pa.int32()), "busy_end": pa.nulls(len(placed), pa.int64()), "is_state": pa.repeat(False, len(placed))}
        for name, values in added.items():
            out = out.append_column(name, values)
        if (shard["turn"][0].as_py() + 1) * shard_rows >= shard["size"][0].as_py():
            return out
        state = dict(zip(stretch, (k.as_py() for k in key), strict=True)) | {"is_state": True}
        return pa.concat_tables([out, pa.Table.from_pylist([state | {"busy_end": e, "lane": x} for e, x in busy], schema=out.schema)])

    return in_rounds(ordered, stretch, "turn", step, schema).drop("i_start_", "busy_end")


def exon_depth(features: DataFrame, keys: Sequence[str] = ("gene_name",), height: float | None = None) -> DataFrame:
    """Segments of overlapping exons of each gene or transcript: seqname, the keys, start_, end_, depth and, with ``height``, ``scaled``.

    ``features``: seqname, feature, start_, end_ and the keys. Segments without an exon are
    left out. ``scaled`` is the depth as a share of the largest of its keys, times
    ``height``. Rows with a null and empty exons are left out.
    """
    exons = features.filter("feature = 'exon' AND start_ < end_").dropna(subset=list(keys))
    segments = depth_segments(exons, ("seqname", *keys))
    if height is None:
        return segments
    top = segments.groupBy(*keys).agg(F.max("depth").alias("top"))
    return segments.join(top, list(keys)).withColumn("scaled", F.col("depth") * F.lit(height) / F.col("top")).drop("top")


def features_in(features: DataFrame, bounds: DataFrame) -> DataFrame:
    """Features that overlap the one row of ``bounds``, with how many of them there are per sequence."""
    found = features.join(bounds.select(F.col("seqname").alias("on"), F.col("start_").alias("low"), F.col("end_").alias("high")), F.col("seqname") == F.col("on"))
    found = found.filter((F.col("end_") > F.col("low")) & (F.col("start_") < F.col("high"))).drop("on", "low", "high")
    return found.withColumn("n_features", F.count("*").over(Window.partitionBy("seqname")))
