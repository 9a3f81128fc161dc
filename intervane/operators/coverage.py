"""Depth of coverage, length histograms, and location statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from intervane.operators.shards import numbered, running_total, with_halo, with_neighbours
from intervane.session import written


def depth(intervals: DataFrame, keys: Sequence[str] = ("sample", "seqname"), shard_width: int = 1 << 20) -> DataFrame:
    """Depth of coverage where it changes: the keys, ``location``, ``delta``, ``depth``.

    A fragment adds 1 at its start and takes 1 away at its end. Deltas are summed
    per location before they are accumulated, so ties leave no order to chance.
    """
    rows = intervals.dropna(subset=[*keys, "start_", "end_"])
    steps = F.array(F.struct(F.col("start_").alias("location"), F.lit(1).alias("delta")), F.struct(F.col("end_").alias("location"), F.lit(-1).alias("delta")))
    deltas = rows.select(*keys, F.explode(steps).alias("x")).groupBy(*keys, F.col("x.location").alias("location")).agg(F.sum("x.delta").alias("delta"))
    return running_total(deltas, list(keys), "location", "delta", "depth", shard_width)


def depth_ribbon(intervals: DataFrame, keys: Sequence[str] = ("sample", "seqname")) -> DataFrame:
    """Depth as a step line: at each change the depth before (``side`` 0) and after (``side`` 1)."""
    sides = F.array(F.struct(F.lit(0).alias("side"), (F.col("depth") - F.col("delta")).alias("depth")), F.struct(F.lit(1).alias("side"), F.col("depth")))
    return depth(intervals, keys).select(*keys, "location", F.explode(sides).alias("x")).select(*keys, "location", "x.side", "x.depth")


def depth_segments(intervals: DataFrame, keys: Sequence[str] = ("sample", "seqname")) -> DataFrame:
    """Covered segments of constant depth: the keys, ``start_``, ``end_``, ``depth`` (over 0)."""
    changes = with_neighbours(depth(intervals, keys), list(keys), "location")
    return changes.filter("depth > 0").select(*keys, F.col("location").alias("start_"), F.col("after").alias("end_"), "depth")


def length_histogram(rows: DataFrame, group: str, value: str = "length", width: int = 10, prior: float = 0.0, normalise: bool = True) -> DataFrame:
    """Histogram over ``(edge, edge + width]`` from .5 up to the largest value: group, ``length`` (mid-point), ``count``, ``density``.

    Empty bins are rows too; ``prior`` is added to every bin. Values of at most .5
    are in no bin. ``density`` is the share of the group, or the count if not normalised.
    """
    binned = rows.filter(F.col(group).isNotNull() & (F.col(value) > 0.5)).groupBy(group, F.ceil((F.col(value) - 0.5) / width - 1).cast("bigint").alias("bin")).agg(F.count("*").alias("n"))
    last = binned.agg(F.max("bin")).scalar()
    bins = binned.select(group).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    filled = bins.join(binned, [group, "bin"], "left").withColumn("count", F.coalesce(F.col("n").cast("double"), F.lit(0.0)) + prior)
    share = F.try_divide("count", F.sum("count").over(Window.partitionBy(group))) if normalise else F.col("count")
    return filled.withColumn("density", share).select(group, (F.col("bin") * width + 0.5 + width / 2).alias("length"), "count", "density")


def location_widths(events: DataFrame, keys: Sequence[str] = ("sample", "seqname")) -> DataFrame:
    """Unique locations with their number of events, dense rank from 0, and quadrature width: the keys, location, n, rank, width, log_width.

    A location stands for half the way to either neighbour, the outermost for the
    whole way to their only one, and a single location for one position.
    """
    keys = list(keys)
    spots = events.dropna(subset=[*keys, "location"]).groupBy(*keys, "location").agg(F.count("*").alias("n"))
    spots = running_total(spots.withColumn("one", F.lit(1).cast("bigint")), keys, "location", "one", "rank").drop("one")
    spots = with_neighbours(spots.withColumn("rank", F.col("rank") - 1), keys, "location")
    left, right = F.col("location") - F.col("before"), F.col("after") - F.col("location")
    width = F.coalesce((left + right) / 2, left.cast("double"), right.cast("double"), F.lit(1.0))
    return spots.withColumn("width", width).withColumn("log_width", F.ln("width")).drop("before", "after")


def event_weights(events: DataFrame, keys: Sequence[str] = ("sample", "seqname")) -> DataFrame:
    """Unique locations with the weight of each of their events: the keys, location, n, weight.

    The stretch from half way to the one neighbour to half way to the other is
    shared by the events of the location; outermost locations have only the
    inner half, and a single location stands for one position.
    """
    keys = list(keys)
    spots = events.dropna(subset=[*keys, "location"]).groupBy(*keys, "location").agg(F.count("*").alias("n"))
    spots = with_neighbours(spots, keys, "location")
    stretch = (F.coalesce("after", "location") - F.coalesce("before", "location")) / 2
    alone = F.col("before").isNull() & F.col("after").isNull()
    return spots.select(*keys, "location", "n", (F.when(alone, 1.0).otherwise(stretch) / F.col("n")).alias("weight"))


def numbered_events(events: DataFrame, keys: Sequence[str] = ("sample", "seqname"), event_id: str = "cut_id") -> DataFrame:
    """Events with a name by their place in the order of keys, location and id: the id, ``number`` (from 0) and ``name``.

    Names are ``event_`` and the number, padded to as many digits as the last
    one needs. Rows are range-partitioned over the whole order (see
    :func:`intervane.operators.shards.numbered`), so neither an entity nor a pile-up is
    the work of one task. Events with a null key or location have no place and are
    left out; ids are expected to be unique.
    """
    keys = list(keys)
    rows = numbered(events.select(*keys, "location", event_id).dropna(subset=[*keys, "location"]), [*keys, "location", event_id], "number")
    digits = F.length(rows.agg(F.max("number")).scalar().cast("string"))
    return rows.select(event_id, "number", F.concat(F.lit("event_"), F.lpad(F.col("number").cast("string"), digits, F.lit("0"))).alias("name"))


def location_medians(events: DataFrame, keys: Sequence[str] = ("sample", "seqname")) -> DataFrame:
    """Median of the unique locations of each entity, as an integer: the shift that centres them.

    Found by rank, so the locations of an entity are never gathered.
    """
    keys = list(keys)
    ranked = location_widths(events, keys).select(*keys, "location", "rank")
    totals = ranked.groupBy(*keys).agg(F.count("*").alias("n_locations"))
    middle = F.col("rank").isin(F.expr("(n_locations - 1) div 2"), F.expr("n_locations div 2"))
    return ranked.join(totals, keys).filter(middle).groupBy(*keys, "n_locations").agg(F.avg("location").cast("bigint").alias("median_location"))


def _near_rank(counts: DataFrame, keys: list[str], bucket: Column, ranks: DataFrame | None = None, share: float | DataFrame = 0.0) -> DataFrame:
    """Rows of ``counts`` in the buckets that hold the ranks next to the wanted one, with ``rank`` and ``ahead``, the weight before these rows.

    ``ranks`` has both for rows that are already a part; without it they are worked out
    from all of the counts and the ``share``. One row per bucket is ordered, no more.
    """
    buckets = counts.groupBy(*keys, bucket.alias("bucket")).agg(F.sum("n").alias("inside"))
    if ranks is None:
        buckets = buckets.join(share, keys) if isinstance(share, DataFrame) else buckets.withColumn("share", F.lit(share))
        total = F.sum("inside").over(Window.partitionBy(*keys))
        buckets = buckets.withColumns({"rank": (total - 1) * F.col("share"), "ahead": F.lit(0).cast("bigint")})
    else:
        buckets = buckets.join(ranks, keys)
    order = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    buckets = buckets.withColumn("upto", F.col("ahead") + F.sum("inside").over(order))
    held = buckets.filter((F.col("upto") > F.floor("rank")) & (F.col("upto") - F.col("inside") <= F.ceil("rank")))
    held = held.select(*keys, "bucket", "rank", F.min(F.col("upto") - F.col("inside")).over(Window.partitionBy(*keys)).alias("ahead"))
    return written(counts.withColumn("bucket", bucket).join(held, [*keys, "bucket"]).drop("bucket"))


def weighted_quantile(rows: DataFrame, keys: Sequence[str], value: str, weight: str, share: float | DataFrame) -> DataFrame:
    """Exact linearly interpolated quantile per entity: the keys and ``quantile``.

    A row counts ``weight`` times; ``share`` is one for all or a table of the keys and
    ``share``. Equal values are added up and written once, values are put into monotone
    buckets (1024 per doubling), and the few buckets that hold the wanted ranks into 4096
    even slices; only slices that hold them are looked into, so no entity is gathered
    or sorted as a whole.
    """
    keys = list(keys)
    counts = written(rows.dropna(subset=[*keys, value, weight]).groupBy(*keys, F.col(value).cast("double").alias("value")).agg(F.sum(weight).alias("n")).filter("n > 0"))
    near = _near_rank(counts, keys, F.floor(F.signum("value") * F.log2(1 + F.abs("value")) * 1024), share=share)
    ends = near.groupBy(*keys, "rank", "ahead").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    spread = near.drop("rank", "ahead").join(ends.select(*keys, "low", "high"), keys)
    slice_ = F.floor(F.coalesce(F.try_divide(F.col("value") - F.col("low"), F.col("high") - F.col("low")), F.lit(0.0)) * 4096)
    near = _near_rank(spread, keys, slice_, ranks=ends.select(*keys, "rank", "ahead"))
    upto = F.col("ahead") + F.sum("n").over(Window.partitionBy(*keys).orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    near = near.withColumn("upto", upto)
    low = F.min(F.when(F.col("upto") > F.floor("rank"), F.col("value")))
    high = F.min(F.when(F.col("upto") > F.ceil("rank"), F.col("value")))
    return near.groupBy(*keys, "rank").agg(low.alias("a"), high.alias("b")).select(*keys, (F.col("a") + (F.col("rank") - F.floor("rank")) * (F.col("b") - F.col("a"))).alias("quantile"))


def group_order(rows: DataFrame, group: str, sort_by: str) -> DataFrame:
    """Groups in the order of their median ``sort_by``: group, ``median``, ``place`` from 1, equal medians sharing a place.

    Medians are found by rank; only the list of groups, one row each, is ordered.
    """
    medians = weighted_quantile(rows.withColumn("__one", F.lit(1)), [group], sort_by, "__one", 0.5)
    return medians.select(group, F.col("quantile").alias("median"), F.dense_rank().over(Window.orderBy("quantile")).alias("place"))


def ambiguous_groups(rows: DataFrame, group: str, label: str) -> DataFrame:
    """Groups with more than one ``label``, which a drawing with one colour per group cannot show."""
    return rows.groupBy(group).agg(F.count_distinct(label).alias("n_labels")).filter("n_labels > 1")


def spine_counts(events: DataFrame, reach: int, keys: Sequence[str] = ("sample", "seqname"), shard_width: int = 1 << 20) -> DataFrame:
    """Unique locations with the number of others at a distance below ``reach`` to the left and right: the keys, location, n_left, n_right.

    Frames look ``reach`` far, so shards get a halo of that size.
    """
    spots = events.dropna(subset=[*keys, "location"]).select(*keys, "location").distinct()
    order = Window.partitionBy(*keys, "shard").orderBy("location")
    counted = (
        with_halo(spots, "location", reach, shard_width)
        .withColumn("n_left", F.count("*").over(order.rangeBetween(-(reach - 1), 0)) - 1)
        .withColumn("n_right", F.count("*").over(order.rangeBetween(0, reach - 1)) - 1)
    )
    return counted.filter("own").select(*keys, "location", "n_left", "n_right")


def index_ranges(rows: DataFrame, key: str, number: str) -> DataFrame:
    """Distinct numbers of each key as text: consecutive ones as ``first-last``, the rest by themselves.

    Runs are formed before they are gathered; meant for short lists such as chunk ids.
    """
    order = Window.partitionBy(key).orderBy(number)
    runs = (
        rows.select(key, number)
        .dropna()
        .distinct()
        .withColumn("run", F.col(number) - F.row_number().over(order))
        .groupBy(key, "run")
        .agg(F.min(number).alias("a"), F.max(number).alias("b"))
    )
    text = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat_ws("-", "a", "b"))
    listed = runs.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("a", text.alias("text")))).alias("x"))
    return listed.select(key, F.array_join("x.text", ",").alias("ranges"))
