"""Command line: the pipelines over files."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from intervane.config import PeakConfig, PrepConfig
from intervane.functions.regions import read_region
from intervane.operators import fragments as frag
from intervane.operators import peaks as pk
from intervane.operators.tracks import binned
from intervane.plans import pipelines
from intervane.session import cut_lineage, written
from intervane.sources import interval_files as files
from intervane.sources import interval_sinks as sinks


def _arguments(arguments: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="intervane", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    prep = commands.add_parser("prep", help="divide the dense regions of fragment files into work packages")
    prep.add_argument("beds", nargs="+")
    prep.add_argument("--out", default="work_packages")
    prep.add_argument("--columns", type=int, default=4, choices=(3, 4))
    prep.add_argument("--barcode", help="pattern in the barcode that its first group replaces")
    prep.add_argument("--bc-from-file", help="pattern in the file name whose first group is the barcode of all its fragments; other files are left out")
    prep.add_argument("--selection-bed", help="intervals to divide in place of the dense regions")
    prep.add_argument("--omit-seqname-postfix", action="store_true")
    prep.add_argument("--keep-duplicates", action="store_true")
    prep.add_argument("--blacklist")
    prep.add_argument("--blacklisted-seqs", nargs="*", default=PrepConfig.excluded_sequences)
    prep.add_argument("--c1-cov", default=PrepConfig.c1_cov)
    prep.add_argument("--c2-cov", default=PrepConfig.c2_cov)
    for name in ("bandwidth", "threshold", "selection-padding", "region-padding", "interval-overlap", "max-locs", "max-cuts", "memory-target", "sparsity-threshold", "seed"):
        default = getattr(PrepConfig, name.replace("-", "_"))
        prep.add_argument(f"--{name}", type=type(default), default=default)
    two = commands.add_parser("peaks", help="peaks, summits, overlaps and tracks of two targets with a file each")
    two.add_argument("c1")
    two.add_argument("c2")
    two.add_argument("out")
    two.add_argument("--columns", type=int, default=4, choices=(3, 4))
    two.add_argument("--blacklisted-seqs", nargs="*", default=["chrM"])
    two.add_argument("--unit", type=int, default=100, help="bases per bin of the tracks")
    for c, size, smooth in (("c1", 100, 0), ("c2", 400, 2000)):
        two.add_argument(f"--{c}-min-peak-size", type=int, default=size)
        two.add_argument(f"--{c}-smooth", type=int, default=smooth)
    for name in ("fraction-in-peaks", "fraction-overlap", "span", "bandwidth"):
        default = getattr(PeakConfig, name.replace("-", "_"))
        two.add_argument(f"--{name}", type=type(default), default=default)
    events = commands.add_parser("events", help="likelihood of every cut under either target, given the peaks that the command peaks wrote")
    events.add_argument("beds", nargs="+", help="one file per sample")
    events.add_argument("peaks", help="folder written by the command peaks")
    events.add_argument("out")
    events.add_argument("--columns", type=int, default=4, choices=(3, 4))
    events.add_argument("--exclude-flipped", action="store_true")
    binned = commands.add_parser("tracks", help="binned tracks of two targets with a file each, as bedGraph")
    for name in ("c1", "c2", "chrom_sizes", "out"):
        binned.add_argument(name)
    binned.add_argument("--columns", type=int, default=4, choices=(3, 4))
    binned.add_argument("--unit", type=int, default=100, help="bases per bin")
    binned.add_argument("--region", help="such as chr1:1,000-2,000")
    binned.add_argument("--bandwidth", type=float, default=PeakConfig.bandwidth)
    binned.add_argument("--span", type=int, default=PeakConfig.span)
    return parser.parse_args(arguments)


def prep(spark: SparkSession, a: argparse.Namespace) -> None:
    """Read fragment files and write their work packages, partitioned by chunk."""
    names = ("bandwidth", "threshold", "selection_padding", "region_padding", "interval_overlap", "max_locs", "max_cuts", "memory_target", "sparsity_threshold", "seed", "c1_cov", "c2_cov", "keep_duplicates")
    cfg = PrepConfig(**{n: getattr(a, n) for n in names}, excluded_sequences=tuple(a.blacklisted_seqs), barcode_pattern=a.barcode, omit_postfix=a.omit_seqname_postfix)
    rows = files.read_fragments(spark, a.beds, a.columns, barcode=a.bc_from_file)
    rows = rows.withColumn("barcode", F.col("sample" if a.bc_from_file else "name")).withColumn("fragment_id", F.monotonically_increasing_id())
    blacklist = files.read_blacklist(spark, a.blacklist) if a.blacklist else spark.createDataFrame([], "seqname STRING, start_ BIGINT, end_ BIGINT, type_ STRING")
    selection = files.read_intervals(spark, a.selection_bed) if a.selection_bed else None
    chunks = sinks.write_packages(cut_lineage(pipelines.prepare(rows, blacklist, cfg, selection)), a.out)
    print(f"{chunks} chunks in {a.out}")


def _target_events(spark: SparkSession, a: argparse.Namespace, excluded: list[str]) -> DataFrame:
    """Events of two fragment files, one per target."""
    parts = [files.read_fragments(spark, path, a.columns).withColumn("track", F.lit(c)) for c, path in (("c1", a.c1), ("c2", a.c2))]
    return frag.to_events(frag.outside_sequences(parts[0].unionByName(parts[1]), excluded))


def peaks(spark: SparkSession, a: argparse.Namespace) -> None:
    """Call peaks of two fragment files and write peaks, summits, overlaps and binned tracks."""
    cfg = PeakConfig(
        min_size={"c1": a.c1_min_peak_size, "c2": a.c2_min_peak_size},
        smooth={"c1": a.c1_smooth, "c2": a.c2_smooth},
        fraction_in_peaks=a.fraction_in_peaks,
        fraction_overlap=a.fraction_overlap,
        span=a.span,
        bandwidth=a.bandwidth,
    )
    signal = pipelines.signal(_target_events(spark, a, a.blacklisted_seqs), cfg)
    called = cut_lineage(pipelines.called_peaks(pipelines.marked_tracks(signal, cfg), cfg))
    c1, c2, both = pk.filtered_overlaps(called.filter("track = 'c1'"), called.filter("track = 'c2'"), cfg.fraction_overlap)
    sinks.write_peaks(c1.unionByName(c2), both, a.out)
    for c in ("c1", "c2"):
        sinks.write_bedgraph(binned(signal, ["seqname"], c, a.unit, F.lit(0).cast("bigint")), f"{a.out}/{c}.bedgraph", c)


def events(spark: SparkSession, a: argparse.Namespace) -> None:
    """Write the likelihood of every cut of fragment files under either target."""
    rows = files.read_fragments(spark, a.beds, a.columns).withColumn("barcode", F.col("name"))
    rows = written(rows.withColumn("fragment_id", F.monotonically_increasing_id()))
    parts = [files.read_intervals(spark, f"{a.peaks}/{c}_peaks.bed", named=False).withColumn("track", F.lit(c)) for c in ("c1", "c2")]
    cuts, likelihoods = pipelines.event_likelihoods(rows, parts[0].unionByName(parts[1]), exclude_flipped=a.exclude_flipped)
    sinks.write_events(likelihoods, cuts, a.out)


def tracks(spark: SparkSession, a: argparse.Namespace) -> None:
    """Write binned tracks of two fragment files, within the sizes of their sequences."""
    signal = pipelines.signal(_target_events(spark, a, []), PeakConfig(span=a.span, bandwidth=a.bandwidth), smooth=False)
    made = pipelines.binned_tracks(signal, files.read_chrom_sizes(spark, a.chrom_sizes, signal), a.unit, read_region(a.region) if a.region else None)
    for c, track in made.items():
        sinks.write_bedgraph(track, f"{a.out}/{c}.bedgraph", c)


def main(arguments: list[str] | None = None) -> None:
    """Run the command on the session of the cluster, or a local one."""
    a = _arguments(arguments)
    spark = SparkSession.builder.appName("intervane").getOrCreate()
    {"prep": prep, "peaks": peaks, "events": events, "tracks": tracks}[a.command](spark, a)


if __name__ == "__main__":
    main()
