"""Writers: interval text files, and partitioned Parquet between stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from intervane.errors import MissingData, NoData


def write_bed(df: DataFrame, path: str, *columns: str) -> None:
    """Tab-separated text without a header, written in parallel to the folder ``path``."""
    df.select(*columns).write.mode("overwrite").csv(path, sep="\t", header=False, quote="")


def write_peaks(called: DataFrame, overlaps: DataFrame, folder: str) -> None:
    """Peaks and summits of both tracks, and the merged overlaps, as five outputs under ``folder``."""
    for c in ("c1", "c2"):
        mine = called.filter(F.col("track") == c)
        write_bed(mine.orderBy("seqname", "start_"), f"{folder}/{c}_peaks.bed", "seqname", "start_", "end_", "name", "auc")
        spots = mine.withColumns({"at": F.col("summit"), "after": F.col("summit") + 1})
        write_bed(spots.orderBy("seqname", "at"), f"{folder}/{c}_summits.bed", "seqname", "at", "after", "name", "mean")
    named = overlaps.withColumn("name", F.concat_ws("_", F.lit("overlap"), "seqname", F.col("start_").cast("string")))
    write_bed(named.orderBy("seqname", "start_"), f"{folder}/overlaps.bed", "seqname", "start_", "end_", "name", "mean")


def write_events(likelihoods: DataFrame, cuts: DataFrame, folder: str) -> None:
    """Per target, every cut as a one-base interval with its barcode, log-likelihood and marginal."""
    rows = cuts.join(likelihoods, "cut_id").withColumn("after", F.col("location") + 1)
    for c in ("c1", "c2"):
        write_bed(rows, f"{folder}/events_{c}.bed", "seqname", "location", "after", "barcode", f"log_{c}", f"marginal_{c}")


def write_bedgraph(track: DataFrame, path: str, value: str) -> None:
    """A binned track as bedGraph, sorted within the parts (bigWig is a step outside Spark)."""
    sorted_parts = track.repartitionByRange("seqname", "start_").sortWithinPartitions("seqname", "start_")
    write_bed(sorted_parts, path, "seqname", "start_", "end_", value)


def write_packages(packages: DataFrame, path: str) -> int:
    """Work packages as Parquet partitioned by chunk; the number of chunks, kept beside them as well."""
    packages.write.mode("overwrite").partitionBy("workchunk").parquet(f"{path}/packages")
    chunks = packages.select("workchunk").distinct()
    chunks.agg(F.count("*").alias("n_chunks")).write.mode("overwrite").parquet(f"{path}/n_chunks")
    return chunks.count()


def read_packages(spark: SparkSession, path: str, workchunk: int | None = None) -> DataFrame:
    """Work packages, of one chunk by partition pruning; :class:`NoData` if there are none."""
    rows = spark.read.parquet(f"{path}/packages")
    rows = rows if workchunk is None else rows.filter(F.col("workchunk") == workchunk)
    if rows.limit(1).count() == 0:
        raise NoData(f"no work packages in {path}")
    return rows


def write_fit(weights: DataFrame, path: str, settings: str = "{}") -> None:
    """Fitted weights with the settings they were fitted under (JSON), appended per chunk."""
    weights.withColumn("settings", F.lit(settings)).write.mode("append").partitionBy("workchunk").parquet(path)


def read_fit(spark: SparkSession, path: str, wanted: DataFrame | None = None) -> DataFrame:
    """Fitted weights; :class:`MissingData` if a ``wanted`` chunk has none."""
    fit = spark.read.schema("comp STRING, k INT, w DOUBLE, settings STRING, workchunk STRING").parquet(path)
    if wanted is not None:
        absent = wanted.select(F.col("workchunk").cast("string")).distinct().join(fit.select("workchunk").distinct(), "workchunk", "left_anti")
        first = [r["workchunk"] for r in absent.limit(5).collect()]
        if first:
            raise MissingData(f"no fit for chunks such as {', '.join(first)}")
    return fit
