"""Peaks of two tracks: bounds, flags, islands, overlaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from intervane.operators.coverage import weighted_quantile
from intervane.operators.periods import merged, periods
from intervane.operators.range_join import overlapping_pairs, points_in_intervals


def target_fractions(totals: DataFrame, fraction_in_peaks: float = 0.5) -> DataFrame:
    """Share of the cuts of each track that is to lie in its peaks: track, n_cuts, raw_share, fraction.

    ``totals``: track, n_cuts. Raw shares of all cuts are shrunk towards equal ones,
    as by half of all cuts seen in advance for each, and scaled by ``fraction_in_peaks``.
    """
    all_cuts = F.sum("n_cuts").over(Window.partitionBy())
    return totals.select(
        "track",
        "n_cuts",
        F.try_divide(F.col("n_cuts").cast("double"), all_cuts).alias("raw_share"),
        (F.try_divide(F.col("n_cuts") + all_cuts / 2, 2 * all_cuts) * fraction_in_peaks).alias("fraction"),
    )


def signal_bounds(signal: DataFrame, fractions: DataFrame) -> DataFrame:
    """Per track the value that the wanted share of all cuts exceeds: track, ``quantile``.

    ``signal``: track, value, n_cuts. ``fractions``: track, fraction.
    """
    shares = fractions.select("track", (1 - F.col("fraction")).alias("share"))
    return weighted_quantile(signal.filter("n_cuts > 0"), ["track"], "value", "n_cuts", shares).select("track", "quantile")


def selected_shares(marked: DataFrame) -> DataFrame:
    """Per track the grid positions, those in peaks and their share: track, n_positions, n_selected, share."""
    both = F.array(*(F.struct(F.lit(c).alias("track"), F.col(f"{c}_peak").cast("bigint").alias("flag")) for c in ("c1", "c2")))
    sums = marked.select(F.explode(both).alias("x")).groupBy("x.track").agg(F.count("*").alias("n_positions"), F.sum("x.flag").alias("n_selected"))
    return sums.withColumn("share", F.try_divide("n_selected", "n_positions"))


def peak_flag(raw: Column, bound: Column, smooth: Column | None = None) -> Column:
    """Whether a position is in a peak: the raw signal above the bound, or with smoothing the mean of both or the smooth one."""
    return raw > bound if smooth is None else ((raw + smooth) / 2 > bound) | (smooth > bound)


def islands(track: DataFrame, value: str, flag: Column, keys: Sequence[str] = ("seqname",), step: int = 10) -> DataFrame:
    """Peaks of flagged neighbouring positions: the keys, start_, end_, mean, summit, length.

    A peak reaches half a step (rounded towards 0) beyond its outer positions;
    ``summit`` is the first position of its largest value.
    """
    half = step // 2
    best = F.struct(F.col(value).alias("v"), (-F.col("location")).alias("back"))
    marked = track.filter(flag).select(*keys, "location", (F.col("location") + step).alias("end_"), F.col(value).alias("total"), best.alias("best"))
    found = periods(marked, keys, start="location", end="end_", sums=("total",), tops=("best",))
    start, end = F.col("start_") - half, F.col("end_") - step + half
    mean = F.col("total") / F.col("n")
    return found.select(*keys, start.alias("start_"), end.alias("end_"), mean.alias("mean"), (-F.col("best.back")).alias("summit"), (end - start).alias("length"))


def named(peaks: DataFrame, prefix: Column, keys: Sequence[str] = ("seqname",)) -> DataFrame:
    """``peaks`` with ``name``: prefix, sequence and start, which no other peak of the track shares."""
    return peaks.withColumn("name", F.concat_ws("_", prefix, *keys, F.col("start_").cast("string")))


def with_auc(peaks: DataFrame) -> DataFrame:
    """``peaks`` with ``auc``: mean times length."""
    return peaks.withColumn("auc", F.col("mean") * F.col("length"))


def summits(peaks: DataFrame) -> DataFrame:
    """One-position intervals at the summits, with the mean as signal."""
    return peaks.select("seqname", F.col("summit").alias("start_"), (F.col("summit") + 1).alias("end_"), "name", F.col("mean").alias("signal"))


def overlap_report(c1: DataFrame, c2: DataFrame, track: DataFrame, corrected: Column | float = 1.0) -> DataFrame:
    """Every overlapping pair of a c1 and a c2 peak, with what the tracks do in the overlap.

    Columns: seqname, c1_name, c2_name, start_, end_, mean_c1, mean_c2, c1_fraction
    and c2_fraction (share of each peak), distance (cosine distance of the centred
    signals, 1 - Pearson's r; null for fewer than two positions or a constant one),
    log_ratio, log_ratio_corrected, callability (the larger absolute log ratio), ambiguous (below 1).
    """
    pairs = overlapping_pairs(c1.select("seqname", "start_", "end_", "name"), c2.select("seqname", "start_", "end_", "name"))
    start, end = F.greatest("start_", "r_start_"), F.least("end_", "r_end_")
    overlap = pairs.select(
        "seqname",
        F.col("name").alias("c1_name"),
        F.col("r_name").alias("c2_name"),
        start.alias("start_"),
        end.alias("end_"),
        F.try_divide((end - start).cast("double"), F.col("end_") - F.col("start_")).alias("c1_fraction"),
        F.try_divide((end - start).cast("double"), F.col("r_end_") - F.col("r_start_")).alias("c2_fraction"),
    ).filter("start_ < end_")
    inside = points_in_intervals(track.select("seqname", "location", "c1", "c2"), overlap).filter("location < i_end_")
    # variances decide where the correlation is defined; engines differ on constants
    varies = (F.stddev_pop("c1") > 1e-12) & (F.stddev_pop("c2") > 1e-12) & (F.count("*") > 1)
    stats = inside.groupBy(*(f"i_{c}" for c in overlap.columns)).agg(
        F.avg("c1").alias("mean_c1"), F.avg("c2").alias("mean_c2"), F.when(varies, 1 - F.corr("c1", "c2")).alias("distance")
    )
    ratio = F.ln(F.try_divide("mean_c1", "mean_c2"))
    out = stats.select(*(F.col(f"i_{c}").alias(c) for c in overlap.columns), "mean_c1", "mean_c2", "distance", ratio.alias("log_ratio"))
    out = out.withColumn("log_ratio_corrected", F.col("log_ratio") - F.ln(F.lit(corrected).cast("double") if isinstance(corrected, float) else corrected))
    out = out.withColumn("callability", F.greatest(F.abs("log_ratio"), F.abs("log_ratio_corrected")))
    return out.withColumn("ambiguous", F.col("callability") < 1)


def filtered_overlaps(c1: DataFrame, c2: DataFrame, min_fraction: float = 0.5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(c1, c2, overlaps)``: peaks that overlap the other track by more than ``min_fraction`` of their length leave their track and are merged."""
    columns = ["seqname", "start_", "end_", "name", "mean"]
    a, b = c1.select(*columns), c2.select(*columns)

    def shared(left: DataFrame, right: DataFrame) -> DataFrame:
        pairs = overlapping_pairs(left, right)
        length = F.least("end_", "r_end_") - F.greatest("start_", "r_start_")
        share = F.sum(F.try_divide(length.cast("double"), F.col("end_") - F.col("start_")))
        return pairs.groupBy("name").agg(share.alias("shared")).filter(F.col("shared") > min_fraction).select("name")

    bad1, bad2 = shared(a, b), shared(b, a)
    both = a.join(bad1, "name", "left_semi").unionByName(b.join(bad2, "name", "left_semi"))
    return c1.join(bad1, "name", "left_anti"), c2.join(bad2, "name", "left_anti"), merged(both)
