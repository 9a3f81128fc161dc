"""The pipelines: preparation of work packages, and peak calling on two tracks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from intervane.config import PeakConfig, PrepConfig
from intervane.functions.kernels import covariance
from intervane.operators import deconvolution
from intervane.operators import density as kde
from intervane.operators import fragments as frag
from intervane.operators import packages as pack
from intervane.operators import peaks as pk
from intervane.operators.periods import extended
from intervane.operators.range_join import points_in_intervals
from intervane.operators.tracks import binned, smoothed, within_sizes
from intervane.session import cut_lineage, written


def prepared_events(fragments: DataFrame, blacklist: DataFrame, cfg: PrepConfig) -> DataFrame:
    """Events of the fragments: copies dropped, barcodes and sequence names rewritten, excluded sequences and blacklisted places left out."""
    rows = fragments.filter("seqname IS NOT NULL AND start_ IS NOT NULL AND end_ IS NOT NULL")
    if cfg.barcode_pattern:
        rows = rows.withColumn("barcode", frag.replaced_barcode(F.col("barcode"), cfg.barcode_pattern))
    if not cfg.keep_duplicates:
        rows = frag.deduplicated(rows)
    if cfg.omit_postfix:
        rows = rows.withColumn("seqname", frag.without_postfix(F.col("seqname")))
    events = frag.to_events(frag.outside_sequences(rows, cfg.excluded_sequences))
    return points_in_intervals(events, blacklist, how="left_anti")


def dense_regions(events: DataFrame, cfg: PrepConfig) -> DataFrame:
    """Dense regions of the events, widened and merged: seqname, start_, end_."""
    return extended(kde.dense_intervals(events, threshold=cfg.threshold, padding=cfg.selection_padding, bandwidth=cfg.bandwidth), padding=cfg.region_padding)


def divided_regions(events: DataFrame, cfg: PrepConfig, selection: DataFrame | None = None) -> DataFrame:
    """Work packages of the dense regions of the ``events`` or, if given, of the intervals of a ``selection``, widened and merged."""
    regions = cut_lineage(dense_regions(events, cfg) if selection is None else extended(selection, padding=cfg.region_padding))
    reaches = tuple(covariance(c).reach(cfg.sparsity_threshold) for c in (cfg.c1_cov, cfg.c2_cov))
    return pack.work_packages(events, regions, cfg.interval_overlap, cfg.max_cuts, cfg.max_locs, reaches)


def prepare(fragments: DataFrame, blacklist: DataFrame, cfg: PrepConfig | None = None, selection: DataFrame | None = None) -> DataFrame:
    """Work packages with their memory and chunk: dense regions, or a ``selection``, widened, merged, divided and packed."""
    cfg = cfg or PrepConfig()
    events = written(prepared_events(fragments, blacklist, cfg).select("seqname", "location"))
    return pack.work_chunks(cut_lineage(divided_regions(events, cfg, selection)), cfg.memory_target, cfg.seed)


def signal(events: DataFrame, cfg: PeakConfig | None = None, smooth: bool = True) -> DataFrame:
    """Signal of two targets on a shared grid, smoothed as the settings say, written once: see :func:`density.two_densities`."""
    cfg = cfg or PeakConfig()
    return written(kde.two_densities(events, cfg.bandwidth, cfg.span, smooth=cfg.smooth if smooth else None))


def two_tracks(events: DataFrame, cfg: PeakConfig | None = None) -> DataFrame:
    """Signal of two targets on a shared grid: seqname, location, interval_start, interval_end, c1, c2, n_c1, n_c2.

    ``events``: seqname, location, track ('c1' or 'c2'). A target without events
    near a grid position is 0 there. An interval is a stretch of the grid without
    holes; n_c1 and n_c2 are the cuts at or after a position and before the next.
    """
    cfg = cfg or PeakConfig()
    return kde.with_intervals(signal(events, cfg, smooth=False), cfg.span)


def smooth_tracks(tracks: DataFrame, cfg: PeakConfig | None = None) -> DataFrame:
    """``tracks`` of any origin with ``c1_smooth`` and ``c2_smooth`` where the settings smooth a track."""
    cfg = cfg or PeakConfig()
    out = tracks
    for c in ("c1", "c2"):
        if cfg.smooth[c]:
            out = smoothed(out, ["seqname"], [c], cfg.smooth[c], cfg.span)
    return out


def cut_signals(signal: DataFrame) -> DataFrame:
    """Signal of either track at the grid positions that hold cuts: track, value, n_cuts."""
    both = F.array(*(F.struct(F.lit(c).alias("track"), F.col(c).alias("value")) for c in ("c1", "c2")))
    held = signal.select("c1", "c2", (F.col("n_c1") + F.col("n_c2")).alias("n_cuts")).filter("n_cuts > 0")
    return held.select("n_cuts", F.explode(both).alias("x")).select("x.track", "x.value", "n_cuts")


def marked_tracks(signal: DataFrame, cfg: PeakConfig | None = None) -> DataFrame:
    """``signal`` with ``c1_peak`` and ``c2_peak``: positions above the bound that the wanted share of the cuts exceeds.

    Both bounds come from one pass over the positions that hold cuts, and are two rows.
    """
    cfg = cfg or PeakConfig()
    totals = signal.agg(F.sum("n_c1").alias("c1"), F.sum("n_c2").alias("c2")).selectExpr("stack(2, 'c1', c1, 'c2', c2) AS (track, n_cuts)")
    wanted = pk.target_fractions(totals, cfg.fraction_in_peaks).select("track", F.coalesce("fraction", F.lit(0.0)).alias("fraction"))
    bounds = cut_lineage(pk.signal_bounds(cut_signals(signal), wanted))
    flags = {}
    for c in ("c1", "c2"):
        bound = bounds.filter(F.col("track") == c).select("quantile").scalar()
        flags[f"{c}_peak"] = pk.peak_flag(F.col(c), bound, F.col(f"{c}_smooth") if cfg.smooth[c] else None)
    return signal.withColumns(flags)


def called_peaks(marked: DataFrame, cfg: PeakConfig | None = None) -> DataFrame:
    """Peaks of both tracks longer than their least size: track, seqname, start_, end_, mean, summit, length, name, auc."""
    cfg = cfg or PeakConfig()
    both = F.array(*(F.when(F.col(f"{c}_peak"), F.struct(F.lit(c).alias("track"), F.col(c).alias("value"))) for c in ("c1", "c2")))
    flagged = marked.filter("c1_peak OR c2_peak").select("seqname", "location", F.explode(F.array_compact(both)).alias("x")).select("x.track", "seqname", "location", "x.value")
    least = F.when(F.col("track") == "c1", cfg.min_size["c1"]).otherwise(cfg.min_size["c2"])
    found = pk.islands(flagged, "value", F.lit(True), ("track", "seqname"), cfg.span).filter(F.col("length") > least)
    return pk.with_auc(pk.named(found, F.col("track")))


def events_of_targets(fragments: DataFrame) -> DataFrame:
    """Events of two targets from one set of fragments: short ones (read type of 120 bases) as c1, longer ones as c2."""
    rows = frag.deduplicated(fragments.filter("seqname IS NOT NULL"))
    track = F.when(F.abs("length") > 120, "c2").otherwise("c1")
    return frag.to_events(rows.withColumn("track", track).select("fragment_id", "seqname", "start_", "end_", "track"))


def event_likelihoods(fragments: DataFrame, peaks: DataFrame, cfg: PeakConfig | None = None, exclude_flipped: bool = False) -> tuple[DataFrame, DataFrame]:
    """``(cuts, likelihoods)``: the cuts of the fragments and their likelihood under either target.

    ``fragments``: fragment_id, sample, seqname, start_, end_, barcode, length. ``peaks``:
    seqname, start_, end_, track, called from all samples. Lengths are fitted per
    sample; with ``exclude_flipped`` samples whose targets seem exchanged are left out.
    """
    number = F.when(F.col("variable") == "start", 0).otherwise(1)
    cuts = frag.to_events(fragments).withColumn("cut_id", 2 * F.col("fragment_id") + number)
    counts = cut_lineage(deconvolution.length_counts(deconvolution.cuts_by_target(cuts, peaks, ("seqname",))))
    weights = cut_lineage(deconvolution.fit_length_weights(counts))
    if exclude_flipped:
        cuts = deconvolution.without_flipped(cuts, deconvolution.flip_check(weights))
    return cuts, deconvolution.cut_likelihoods(cuts, two_tracks(events_of_targets(fragments), cfg), weights)


def binned_tracks(signal: DataFrame, sizes: DataFrame, unit: int = 100, region: tuple[str, int, int] | None = None) -> dict[str, DataFrame]:
    """Mean signal of either target per bin of ``unit`` positions, within the sizes of the sequences and the region: seqname, start_, end_, the signal."""
    return {c: within_sizes(binned(signal, ["seqname"], c, unit, F.lit(0).cast("bigint")), sizes, region) for c in ("c1", "c2")}
