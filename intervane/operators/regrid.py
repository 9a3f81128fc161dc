"""Irregular point readings onto regular grids, with gaps filled or marked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from intervane.operators.range_join import points_in_intervals
from intervane.session import written

#: Positions of a sequence that are one join key.
_REACH = 1 << 24


def bin_counts(cuts: DataFrame, tracks: DataFrame) -> DataFrame:
    """Distinct cuts per track and occupied bin: track_id, k (bin number), n.

    Cuts meet tracks by sample, sequence and stretches of ``_REACH`` positions, so a hot
    sequence is many join keys. Counting distinct ids pre-aggregates on (track, bin,
    cut) before its shuffle, so a pile-up is spread by cut id; rows delivered twice
    count once.
    """
    wanted = tracks.select("track_id", "sample", "seqname", F.col("grid_start").alias("start_"), (F.col("grid_end") - 1).alias("end_"), "step")
    held = points_in_intervals(cuts.select("cut_id", "sample", "seqname", "location").dropna(subset=["sample", "seqname", "location"]), wanted, ("sample", "seqname"), width=_REACH)
    return (
        held.select(F.col("i_track_id").alias("track_id"), F.expr("(location - i_start_) div i_step").alias("k"), "cut_id")
        .groupBy("track_id", "k")
        .agg(F.count_distinct(F.coalesce("cut_id", F.lit(-1))).alias("n"))
    )


def _slope(here: Column, prev: Column, nxt: Column) -> Column:
    """Shape-preserving slope at a knot: weighted harmonic mean of the secants, 0 at a turn, one-sided at an end."""
    h0, h1 = (here["k"] - prev["k"]).cast("double"), (nxt["k"] - here["k"]).cast("double")
    d0, d1 = (here["v"] - prev["v"]) / h0, (nxt["v"] - here["v"]) / h1
    w0, w1 = 2 * h1 + h0, h1 + 2 * h0
    both = F.when(d0 * d1 > 0, (w0 + w1) / (w0 / d0 + w1 / d1)).otherwise(0.0)
    return F.coalesce(F.when(prev.isNotNull() & nxt.isNotNull(), both), d0, d1, F.lit(0.0))


def _between(k: Column, a: Column, b: Column) -> Column:
    """Cubic Hermite value at ``k`` between the knots ``a`` and ``b`` (fields k, v, m)."""
    h = (b["k"] - a["k"]).cast("double")
    t = (k - a["k"]) / h
    return (
        (1 + 2 * t) * (1 - t) * (1 - t) * a["v"] + t * (1 - t) * (1 - t) * h * a["m"] + t * t * (3 - 2 * t) * b["v"] + t * t * (t - 1) * h * b["m"]
    )


def _halos(knots: DataFrame, knot: Column) -> DataFrame:
    """Per occupied shard the nearest knot of the shards before (``left``) and after (``right``) it."""
    edges = knots.groupBy("track_id", "shard").agg(F.min(knot).alias("first"), F.max(knot).alias("last"))
    order = Window.partitionBy("track_id").orderBy("shard")
    return edges.select("track_id", "shard", F.lag("last").over(order).alias("left"), F.lead("first").over(order).alias("right"))


def regular_series(cuts: DataFrame, tracks: DataFrame, max_fill: int = 5, shard_bins: int = 4096) -> DataFrame:
    """Every bin of every track once: track_id, sample, seqname, bin_start, n_cuts, value, state.

    ``state`` is ``observed`` (cuts fell into the bin, ``value`` is their
    number), ``filled`` (none did, but the run of empty bins is at most
    ``max_fill`` long and lies between observed bins: ``value`` is the
    shape-preserving monotone cubic through the observed bins of the segment) or
    ``missing`` (a longer gap, or an edge: ``value`` is null). Long gaps end a
    segment, so slopes never look across them.

    A track is cut into shards of ``shard_bins`` bins (more than ``max_fill``);
    each shard works with its own bins and the nearest knot of its neighbours,
    exchanged through one row per occupied shard, so the work of no task grows
    with the length of a track.

    Defined cases: cuts with null sample, sequence or location do not count, a
    null cut id counts as one more cut per bin; a row delivered twice counts
    once; a track with null bounds or a step below 1 has no bins; several tracks
    of one sample and sequence are independent; repeated track rows count once;
    extra columns are ignored; without cuts every bin is missing.
    """
    if not 0 <= max_fill < shard_bins:
        raise ValueError("max_fill must be smaller than shard_bins")
    tracks = tracks.select("track_id", "sample", "seqname", "grid_start", "grid_end", "step").filter("step >= 1 AND grid_end > grid_start").distinct()
    inside = Window.partitionBy("track_id", "shard").orderBy("k")
    near = lambda a, b: b["k"] - a["k"] <= max_fill + 1
    shard = F.expr(f"k div {shard_bins}")
    # one row per occupied bin, written once: knots, halos and the grid all come from it
    knots = written(bin_counts(cuts, tracks)).select("track_id", shard.alias("shard"), "k", F.struct("k", F.col("n").cast("double").alias("v")).alias("at"))
    here = F.col("at")
    prev = F.coalesce(F.lag("at").over(inside), F.col("left"))
    nxt = F.coalesce(F.lead("at").over(inside), F.col("right"))
    knots = (
        knots.join(_halos(knots, here), ["track_id", "shard"])
        .select("track_id", "shard", "k", "at", prev.alias("prev"), nxt.alias("nxt"))
        .withColumn("prev", F.when(near(F.col("prev"), here), F.col("prev")))
        .withColumn("nxt", F.when(near(here, F.col("nxt")), F.col("nxt")))
        .select("track_id", "shard", "k", F.struct("at.k", "at.v", _slope(here, F.col("prev"), F.col("nxt")).alias("m")).alias("knot"))
    )
    bins = F.expr("(grid_end - grid_start) div step")
    grid = (
        tracks.select("track_id", "sample", "seqname", "grid_start", "step", bins.alias("n_bins"))
        .withColumn("shard", F.explode(F.expr(f"sequence(0L, (n_bins - 1) div {shard_bins})")))
        .withColumn("k", F.explode(F.expr(f"sequence(shard * {shard_bins}, least((shard + 1) * {shard_bins}, n_bins) - 1)")))
        .join(knots, ["track_id", "shard", "k"], "left")
        .join(_halos(knots, F.col("knot")), ["track_id", "shard"], "left")
        .withColumn("a", F.coalesce(F.last("knot", True).over(inside.rowsBetween(Window.unboundedPreceding, 0)), F.col("left")))
        .withColumn("b", F.coalesce(F.first("knot", True).over(inside.rowsBetween(0, Window.unboundedFollowing)), F.col("right")))
    )
    a, b = F.col("a"), F.col("b")
    state = F.when(F.col("knot").isNotNull(), "observed").when(near(a, b), "filled").otherwise("missing")
    value = F.when(F.col("state") == "observed", F.col("knot.v")).when(F.col("state") == "filled", _between(F.col("k"), a, b))
    return grid.withColumn("state", state).select(
        "track_id",
        "sample",
        "seqname",
        (F.col("grid_start") + F.col("k") * F.col("step")).alias("bin_start"),
        F.coalesce(F.col("knot.v").cast("bigint"), F.lit(0).cast("bigint")).alias("n_cuts"),
        value.alias("value"),
        "state",
    )
