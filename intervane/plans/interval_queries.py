"""Registered queries on fragments, cuts, intervals, tracks and peaks, each over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from intervane.config import PeakConfig, PrepConfig
from intervane.functions import lengths as L
from intervane.functions.kernels import covariance
from intervane.functions.regions import read_region, region_column
from intervane.operators import annotation, coverage, deconvolution, density, fragments, packages, peaks, periods, range_join, tracks
from intervane.plans import interval_sql, pipelines
from intervane.session import cut_lineage, table, written

QUERIES = {}

#: Peak calling of the queries: the usual settings.
PEAKS = PeakConfig()
#: The settings the SQL is written for: the second track smoothed over 200 bases.
NARROW_PEAKS = PeakConfig(smooth={"c1": 0, "c2": 200})
#: Preparation: the usual settings, and small limits that divide small tables too.
PREP = PrepConfig()
NARROW_PREP = PrepConfig(selection_padding=1000, region_padding=500, interval_overlap=1000, max_locs=2000, max_cuts=8000, memory_target=1.0)
#: Limits so small that most intervals of even a small table are divided.
DIVIDED_PREP = PrepConfig(selection_padding=1000, region_padding=500, interval_overlap=200, max_locs=30, max_cuts=40, memory_target=0.5)
REGION = "chr1:20,000,000-60_000_000"


def query(build):
    """Register a query under its name."""
    QUERIES[build.__name__] = build
    return build


def narrow(build, **settings):
    """Register a query once more as ``<name>_narrow``, with the settings of its SQL where those are not the usual ones."""
    QUERIES[f"{build.__name__}_narrow"] = lambda spark, folder: build(spark, folder, **settings)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Doubles rounded to 6 digits, so that engines that add in another order agree."""
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query
def fragments_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return fragments.deduplicated(table(spark, folder, "fragments"))


@query
def dup_stats(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(fragments.duplicate_stats(table(spark, folder, "fragments")), "share_removed")


@query
def events_melt(spark: SparkSession, folder: str) -> DataFrame:
    return fragments.to_events(table(spark, folder, "fragments").select("fragment_id", "sample", "seqname", "barcode", "length", "start_", "end_"))


@query
def read_type_counts(spark: SparkSession, folder: str) -> DataFrame:
    length = fragments.fragment_length(signed=False)
    types = (fragments.read_type(length).alias("read_type"), fragments.long_type(length).alias("long_type"))
    return table(spark, folder, "fragments").groupBy("sample", *types).agg(F.count("*").alias("n"), F.sum(length).alias("bases"))


@query
def barcode_replace(spark: SparkSession, folder: str) -> DataFrame:
    cell = fragments.replaced_barcode(F.col("barcode"), "^([A-Z]{8})[A-Z]*$")
    return table(spark, folder, "fragments").groupBy(cell.alias("cell")).agg(F.count("*").alias("n"))


@query
def seq_postfix(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "fragments").groupBy(fragments.without_postfix(F.col("seqname")).alias("sequence")).agg(F.count("*").alias("n"))


@query
def seq_blacklist(spark: SparkSession, folder: str) -> DataFrame:
    rows = fragments.outside_sequences(table(spark, folder, "fragments"), PrepConfig().excluded_sequences)
    return rows.groupBy("sample", "seqname").agg(F.count("*").alias("n"))


@query
def frequent_barcodes(spark: SparkSession, folder: str) -> DataFrame:
    rows = fragments.frequent_groups(table(spark, folder, "fragments"), ["sample", "barcode"], 100)
    return rows.select("fragment_id", "sample", "barcode").distinct()


@query
def blacklist_antijoin(spark: SparkSession, folder: str) -> DataFrame:
    kept = range_join.points_in_intervals(table(spark, folder, "cuts"), table(spark, folder, "blacklist"), how="left_anti")
    return kept.select("cut_id", "seqname", "location").distinct()


@query
def peaks_off_blacklist(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "peaks").select(F.col("peak_id").alias("interval_id"), "seqname", "start_", "end_").filter("start_ < end_").distinct()
    return range_join.not_overlapping(rows, table(spark, folder, "blacklist").select("seqname", "start_", "end_"))


@query
def cuts_in_intervals(spark: SparkSession, folder: str) -> DataFrame:
    wanted = table(spark, folder, "peaks").select("peak_id", "sample", "seqname", "start_", "end_").distinct()
    hits = range_join.points_in_intervals(table(spark, folder, "cuts").select("cut_id", "sample", "seqname", "location"), wanted, ("sample", "seqname"))
    return hits.groupBy(F.col("i_peak_id").alias("peak_id")).agg(F.count_distinct("cut_id").alias("n_cuts"))


def _tracks_of_peaks(spark: SparkSession, folder: str) -> list[DataFrame]:
    rows = table(spark, folder, "peaks").select("peak_id", "sample", "track", "seqname", "start_", "end_").filter("start_ < end_").distinct()
    return [rows.filter(F.col("track") == c).drop("track") for c in ("c1", "c2")]


@query
def interval_overlap_join(spark: SparkSession, folder: str) -> DataFrame:
    pairs = range_join.overlapping_pairs(*_tracks_of_peaks(spark, folder), ("sample", "seqname"))
    shared = F.least("end_", "r_end_") - F.greatest("start_", "r_start_")
    return pairs.select("peak_id", F.col("r_peak_id").alias("other_id"), shared.alias("shared"))


@query
def region_parse(spark: SparkSession, folder: str) -> DataFrame:
    text = F.concat(F.col("seqname"), F.lit(":"), F.format_number("start_", 0), F.lit("-"), F.col("end_").cast("string"))
    return table(spark, folder, "peaks").select("peak_id", region_column(text).alias("r")).select("peak_id", "r.*").distinct()


@query
def exon_depth(spark: SparkSession, folder: str) -> DataFrame:
    """Depth of the peaks of a sample, taken as the exons of a gene, scaled for drawing."""
    rows = table(spark, folder, "peaks").select("peak_id", "seqname", "start_", "end_", F.col("sample").alias("gene_name"), F.lit("exon").alias("feature")).distinct()
    return rounded(annotation.exon_depth(rows.dropna(), height=0.8), "scaled")


@query
def facet_counts(spark: SparkSession, folder: str) -> DataFrame:
    label = fragments.facet_label(F.col("sample"), fragments.read_type(fragments.fragment_length(signed=False)))
    return table(spark, folder, "fragments").groupBy(label.alias("facet")).agg(F.count("*").alias("n"))


@query
def region_fragments(spark: SparkSession, folder: str) -> DataFrame:
    found = range_join.region(table(spark, folder, "fragments"), *read_region(REGION))
    return fragments.to_events(found.select("fragment_id", "sample", "seqname", "start_", "end_").distinct())


@query
def peaks_centred(spark: SparkSession, folder: str) -> DataFrame:
    found = range_join.centred_in(table(spark, folder, "peaks"), *read_region(REGION))
    return found.select("peak_id", "sample", "track", "seqname", "start_", "end_").distinct()


@query
def feature_lookup(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "peaks").dropna(subset=["seqname", "start_", "end_"])
    features = rows.select("seqname", "start_", "end_", F.col("name").alias("gene_name"), F.col("sample").alias("gene_id"), F.col("peak_id").cast("string").alias("transcript_id"))
    return annotation.features_in(rows.select("peak_id", "seqname", "start_", "end_").distinct(), annotation.resolved_feature(features, "S00000", padding=1000))


@query
def length_hist(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "fragments").select("sample", F.abs("length").alias("length"))
    return rounded(coverage.length_histogram(rows, "sample", width=10, prior=1.0), "density")


@query
def quadrature_widths(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "cuts").select("cut_id", "sample", "seqname", "location").distinct()
    return rounded(coverage.location_widths(rows), "width", "log_width")


@query
def event_weights(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "cuts").select("cut_id", "sample", "seqname", "location").distinct()
    return rounded(coverage.event_weights(rows), "weight")


@query
def event_names(spark: SparkSession, folder: str) -> DataFrame:
    return coverage.numbered_events(table(spark, folder, "cuts").select("cut_id", "sample", "seqname", "location").distinct())


@query
def location_shift(spark: SparkSession, folder: str) -> DataFrame:
    return coverage.location_medians(table(spark, folder, "cuts"))


@query
def spine_counts(spark: SparkSession, folder: str) -> DataFrame:
    return coverage.spine_counts(table(spark, folder, "cuts"), covariance(PrepConfig().c1_cov).reach())


@query
def coverage_depth(spark: SparkSession, folder: str) -> DataFrame:
    return coverage.depth(table(spark, folder, "fragments").select("fragment_id", "sample", "seqname", "start_", "end_").distinct())


@query
def coverage_ribbon(spark: SparkSession, folder: str) -> DataFrame:
    return coverage.depth_ribbon(table(spark, folder, "peaks").select("peak_id", "sample", "seqname", "start_", "end_").distinct().filter("start_ < end_"))


@query
def peak_depth(spark: SparkSession, folder: str) -> DataFrame:
    return coverage.depth_segments(table(spark, folder, "peaks").select("peak_id", "sample", "seqname", "start_", "end_").distinct().filter("start_ < end_"))


@query
def extend_intervals(spark: SparkSession, folder: str) -> DataFrame:
    return periods.extended(table(spark, folder, "peaks").select("peak_id", "sample", "seqname", "start_", "end_").distinct(), ("sample", "seqname"), 500)


@query
def merge_intervals(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "peaks").select("peak_id", "sample", "seqname", "start_", "end_", "auc").distinct()
    return rounded(periods.merged(rows, ("sample", "seqname"), "auc"), "mean")


@query
def coverage_fraction(spark: SparkSession, folder: str) -> DataFrame:
    rows = periods.periods(table(spark, folder, "peaks"), ("seqname",))
    return rounded(periods.covered_fraction(rows), "fraction")


@query
def sequence_ranges(spark: SparkSession, folder: str) -> DataFrame:
    number = F.regexp_extract("seqname", "^chr([0-9]+)$", 1).try_cast("int")
    return coverage.index_ranges(table(spark, folder, "tracks").select("sample", number.alias("number")), "sample", "number")


@query
def peak_lanes(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "peaks").select("sample", "seqname", "start_", "end_", F.col("peak_id").alias("interval_id")).distinct()
    return annotation.lanes(rows, ["sample", "seqname"], padding=100)


def _events(spark: SparkSession, folder: str) -> DataFrame:
    return pipelines.events_of_targets(table(spark, folder, "fragments"))


def _signal(spark: SparkSession, folder: str, cfg: PeakConfig) -> DataFrame:
    return pipelines.signal(_events(spark, folder), cfg)


def _marked(spark: SparkSession, folder: str, cfg: PeakConfig) -> DataFrame:
    return pipelines.marked_tracks(_signal(spark, folder, cfg), cfg)


def _peaks(marked: DataFrame, cfg: PeakConfig) -> tuple[DataFrame, DataFrame]:
    called = cut_lineage(pipelines.called_peaks(marked, cfg))
    return called.filter("track = 'c1'"), called.filter("track = 'c2'")


@query
def kde_density(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(density.density(_events(spark, folder)), "density")


@query
def kde_intervals(spark: SparkSession, folder: str, padding: int = PrepConfig().selection_padding) -> DataFrame:
    return density.dense_intervals(_events(spark, folder), padding=padding)


narrow(kde_intervals, padding=1000)


@query
def target_fractions(spark: SparkSession, folder: str) -> DataFrame:
    totals = _events(spark, folder).groupBy("track").agg(F.count("*").alias("n_cuts"))
    return rounded(peaks.target_fractions(totals), "raw_share", "fraction")


@query
def two_tracks(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(pipelines.two_tracks(_events(spark, folder), PEAKS), "c1", "c2")


@query
def peak_shares(spark: SparkSession, folder: str, cfg: PeakConfig = PEAKS) -> DataFrame:
    return rounded(peaks.selected_shares(_marked(spark, folder, cfg)), "share")


@query
def quantile_bounds(spark: SparkSession, folder: str) -> DataFrame:
    rows = pipelines.cut_signals(pipelines.signal(_events(spark, folder), PEAKS, smooth=False))
    fractions = spark.createDataFrame([("c1", 0.25), ("c2", 0.25)], "track STRING, fraction DOUBLE")
    return rounded(peaks.signal_bounds(rows, fractions), "quantile")


@query
def gaussian_smooth(spark: SparkSession, folder: str, cfg: PeakConfig = PEAKS) -> DataFrame:
    rows = pipelines.smooth_tracks(pipelines.two_tracks(_events(spark, folder), cfg), cfg)
    return rounded(rows.select("seqname", "location", "c2_smooth"), "c2_smooth")


@query
def peak_flags(spark: SparkSession, folder: str, cfg: PeakConfig = PEAKS) -> DataFrame:
    return _marked(spark, folder, cfg).select("seqname", "location", "c1_peak", "c2_peak")


@query
def peak_islands(spark: SparkSession, folder: str, cfg: PeakConfig = PEAKS) -> DataFrame:
    return rounded(pipelines.called_peaks(_marked(spark, folder, cfg), cfg), "mean", "auc")


@query
def peak_summits(spark: SparkSession, folder: str, cfg: PeakConfig = PEAKS) -> DataFrame:
    return rounded(peaks.summits(pipelines.called_peaks(_marked(spark, folder, cfg), cfg)), "signal")


@query
def overlap_report(spark: SparkSession, folder: str, cfg: PeakConfig = PEAKS) -> DataFrame:
    marked = _marked(spark, folder, cfg)
    # every grid position of a peak is flagged, so positions of an overlap are flagged in both tracks
    report = peaks.overlap_report(*_peaks(marked, cfg), marked.filter("c1_peak AND c2_peak"))
    return rounded(report, "c1_fraction", "c2_fraction", "mean_c1", "mean_c2", "distance", "log_ratio", "log_ratio_corrected", "callability")


@query
def filter_overlaps(spark: SparkSession, folder: str, cfg: PeakConfig = PEAKS) -> DataFrame:
    c1, c2, both = peaks.filtered_overlaps(*_peaks(_marked(spark, folder, cfg), cfg), cfg.fraction_overlap)
    parts = [df.select(F.lit(kind).alias("kind"), "seqname", "start_", "end_", "mean") for kind, df in (("c1", c1), ("c2", c2), ("overlap", both))]
    return rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]), "mean")


for build in (gaussian_smooth, peak_flags, peak_islands, peak_summits, overlap_report, filter_overlaps, peak_shares):
    narrow(build, cfg=NARROW_PEAKS)


def _counts_of_bins(spark: SparkSession, folder: str) -> DataFrame:
    """Cuts per sample, sequence and occupied place of 100 bases: an irregular track."""
    cuts = table(spark, folder, "cuts").dropna(subset=["seqname", "location"])
    place = (F.floor(F.col("location") / 100) * 100 + 37).alias("location")
    return cuts.groupBy("sample", "seqname", place).agg(F.count_distinct("cut_id").cast("double").alias("value"))


@query
def interp_track(spark: SparkSession, folder: str, max_gap: int | None = None) -> DataFrame:
    return rounded(tracks.interpolated(_counts_of_bins(spark, folder), ["sample", "seqname"], "value", span=50, max_gap=max_gap), "value")


@query
def binned_track(spark: SparkSession, folder: str, max_gap: int | None = None) -> DataFrame:
    points = tracks.interpolated(_counts_of_bins(spark, folder), ["sample", "seqname"], "value", span=50, max_gap=max_gap)
    return rounded(tracks.binned(points, ["sample", "seqname"], "value", 500, F.lit(0).cast("bigint"), unit=100.0), "value")


for build in (interp_track, binned_track):
    narrow(build, max_gap=2000)


@query
def sized_track(spark: SparkSession, folder: str) -> DataFrame:
    """Bins of the cuts that end within their sequence and reach into a region."""
    cuts = table(spark, folder, "cuts").dropna(subset=["seqname", "location"]).select("cut_id", "seqname", "location").distinct()
    begin = (F.floor(F.col("location") / 1000) * 1000).alias("start_")
    bins = cuts.groupBy("seqname", begin).agg(F.count("*").alias("n_cuts")).withColumn("end_", F.col("start_") + 1000)
    return tracks.within_sizes(bins, table(spark, folder, "chrom_sizes"), read_region(REGION))


@query
def thinned_track(spark: SparkSession, folder: str) -> DataFrame:
    return tracks.thinned(_counts_of_bins(spark, folder), ["sample", "seqname"], 20).withColumn("value", tracks.at_least(F.col("value"), 2.0))


@query
def sample_order(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "fragments").select("fragment_id", "sample", F.col("length").cast("double").alias("length")).distinct()
    return coverage.group_order(rows, "sample", "length")


@query
def shared_barcodes(spark: SparkSession, folder: str) -> DataFrame:
    return coverage.ambiguous_groups(table(spark, folder, "fragments").filter("barcode IS NOT NULL"), "barcode", "sample")


def _targeted(spark: SparkSession, folder: str) -> DataFrame:
    return deconvolution.cuts_by_target(table(spark, folder, "cuts"), table(spark, folder, "peaks"))


def _fit(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    counts = cut_lineage(deconvolution.length_counts(_targeted(spark, folder)))
    return counts, cut_lineage(deconvolution.fit_length_weights(counts))


@query
def fit_weights(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(_fit(spark, folder)[1], "w")


@query
def mode_weights(spark: SparkSession, folder: str) -> DataFrame:
    counts, weights = _fit(spark, folder)
    return deconvolution.mode_weights(weights, counts).withColumn("cuts", F.round("cuts", 4))


@query
def length_posterior_grid(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(deconvolution.length_grid(_fit(spark, folder)[1]), "length", "density")


@query
def flip_check(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(deconvolution.flip_check(_fit(spark, folder)[1]), "correlation")


@query
def flip_check_planted(spark: SparkSession, folder: str) -> DataFrame:
    """The check where the targets of the last chunk were exchanged on purpose."""
    fit = _fit(spark, folder)[1]
    last = fit.select(F.max("workchunk")).scalar()
    other = F.when(F.col("comp") == "c1", "c2").otherwise("c1")
    return rounded(deconvolution.flip_check(fit.withColumn("comp", F.when(F.col("workchunk") == last, other).otherwise(F.col("comp")))), "correlation")


@query
def unflipped_cuts(spark: SparkSession, folder: str) -> DataFrame:
    """Cuts per sample, without the one whose targets were exchanged on purpose."""
    cuts = table(spark, folder, "cuts")
    kept = deconvolution.without_flipped(cuts.select("cut_id", "sample").distinct(), flip_check_planted(spark, folder))
    return kept.groupBy("sample").agg(F.count("*").alias("n_cuts"))


@query
def suggested_priors(spark: SparkSession, folder: str) -> DataFrame:
    """Priors to fit again the chunk whose targets were exchanged on purpose."""
    counts, fit = _fit(spark, folder)
    last = fit.select(F.max("workchunk")).scalar()
    other = F.when(F.col("comp") == "c1", "c2").otherwise("c1")
    exchanged = fit.withColumn("comp", F.when(F.col("workchunk") == last, other).otherwise(F.col("comp")))
    modes = deconvolution.mode_weights(fit, counts)
    return deconvolution.suggested_priors(modes, deconvolution.flip_check(exchanged))


@query
def missing_chunks_planted(spark: SparkSession, folder: str) -> DataFrame:
    """The missing chunks where the first one lost the fit of a target on purpose."""
    fit = _fit(spark, folder)[1]
    lost = (F.col("workchunk") == fit.select(F.min("workchunk")).scalar()) & (F.col("comp") == "c2")
    return deconvolution.missing_chunks(table(spark, folder, "cuts").select(F.col("sample").alias("workchunk")), fit.filter(~lost))


@query
def missing_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return deconvolution.missing_chunks(table(spark, folder, "cuts").select(F.col("sample").alias("workchunk")), _fit(spark, folder)[1])


@query
def length_mixture_logpdf(spark: SparkSession, folder: str) -> DataFrame:
    prior = [F.lit(a / sum(L.PRIORS["c1"])) for a in L.PRIORS["c1"]]
    value = L.log_mixture(F.abs("length"), prior)
    return rounded(table(spark, folder, "fragments").select("fragment_id", value.alias("logpdf")).distinct(), "logpdf")


@query
def cut_likelihoods(spark: SparkSession, folder: str) -> DataFrame:
    cuts = table(spark, folder, "cuts").select("cut_id", "sample", "seqname", "location", "length").distinct()
    found = deconvolution.cut_likelihoods(cuts, pipelines.two_tracks(_events(spark, folder), PEAKS), _fit(spark, folder)[1])
    return rounded(found, "log_c1", "log_c2", "marginal_c1", "marginal_c2", "log_total")


def _packages(spark: SparkSession, folder: str, cfg: PrepConfig, selection: DataFrame | None = None) -> DataFrame:
    return cut_lineage(pipelines.prepare(table(spark, folder, "fragments"), table(spark, folder, "blacklist"), cfg, selection))


@query
def work_packages(spark: SparkSession, folder: str, cfg: PrepConfig = PREP) -> DataFrame:
    return packages.package_names(_packages(spark, folder, cfg))


@query
def chunk_loads(spark: SparkSession, folder: str, cfg: PrepConfig = PREP) -> DataFrame:
    return packages.chunk_loads(_packages(spark, folder, cfg))


@query
def richest_packages(spark: SparkSession, folder: str, cfg: PrepConfig = PREP) -> DataFrame:
    return packages.richest_package(_packages(spark, folder, cfg))


for build in (work_packages, chunk_loads, richest_packages):
    narrow(build, cfg=NARROW_PREP)


def _divided(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The prepared events, and their packages under limits that divide most intervals."""
    events = written(pipelines.prepared_events(table(spark, folder, "fragments"), table(spark, folder, "blacklist"), DIVIDED_PREP).select("seqname", "location"))
    return events, cut_lineage(pipelines.divided_regions(events, DIVIDED_PREP))


@query
def divided_packages(spark: SparkSession, folder: str) -> DataFrame:
    return packages.package_names(_divided(spark, folder)[1]).withColumn("memory", F.round("memory", 9))


@query
def divided_richest(spark: SparkSession, folder: str) -> DataFrame:
    return packages.richest_package(_divided(spark, folder)[1])


@query
def divided_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Packages put into chunks, and chunks beyond their limit that hold more than one."""
    made = packages.work_chunks(_divided(spark, folder)[1], DIVIDED_PREP.memory_target, DIVIDED_PREP.seed)
    over = (F.col("load") >= DIVIDED_PREP.memory_target) & (F.col("n_packages") > 1)
    sums = packages.chunk_loads(made).agg(F.sum("n_packages").alias("n_packages"), F.sum("ncuts").alias("ncuts"), F.sum("nlocs").alias("nlocs"), F.sum(over.cast("bigint")).alias("n_over"))
    return sums


@query
def package_coverage(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(packages.exclusive_coverage(_divided(spark, folder)[1]), "fraction")


@query
def stitched_spines(spark: SparkSession, folder: str) -> DataFrame:
    """Neighbours within an overlap, counted package by package and put together from the exclusive parts."""
    events, made = _divided(spark, folder)
    near = coverage.spine_counts(packages.in_packages(events, made), DIVIDED_PREP.interval_overlap, ("seqname", "interval", "k"))
    return packages.stitched(near, made).drop("k")


@query
def selected_packages(spark: SparkSession, folder: str) -> DataFrame:
    """Packages of a selection (the peaks of the first track) in place of the dense regions."""
    selection = table(spark, folder, "peaks").filter("track = 'c1'").select("seqname", "start_", "end_")
    events = written(pipelines.prepared_events(table(spark, folder, "fragments"), table(spark, folder, "blacklist"), DIVIDED_PREP).select("seqname", "location"))
    return pipelines.divided_regions(events, DIVIDED_PREP, selection).withColumn("memory", F.round("memory", 9))


#: SQL by query; where it is written for narrower settings, that of the query registered with those.
SQL = {f"{name}_narrow" if f"{name}_narrow" in QUERIES else name: text for name, text in interval_sql.SQL.items()}
SQL |= interval_sql.USUAL
