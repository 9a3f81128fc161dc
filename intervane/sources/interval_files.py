"""Readers of interval files, as lazy scans with explicit schemas.

Files may be plain, ``.gz`` or ``.bz2``; Spark picks the codec by the suffix.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from intervane.errors import BarcodeError, BEDFormatError
from intervane.operators.rejects import is_data_line

_PATH = "_metadata.file_path"


def file_barcode(path: Column, pattern: str = r"([^/]+?)(?:\.bed)?(?:\.gz|\.bz2)?$") -> Column:
    """First group of ``pattern`` in a path; null where it does not match."""
    found = F.regexp_extract(path, pattern, 1)
    return F.when(found != "", found)


def read_fragments(spark: SparkSession, paths: str | Sequence[str], n_columns: int = 4, barcode: str | None = None, comment: str = "#") -> DataFrame:
    """Fragments of interval files: sample, seqname, start_, end_, name, length.

    The sample is taken from the file name (with ``barcode`` as pattern; files that
    do not match are left out). With three columns every line gets a name of its
    own. Comment lines may stand anywhere. A line that does not have the columns
    fails the query; use the reject operator to keep such lines apart.
    """
    if n_columns not in (3, 4):
        raise BEDFormatError("fragment files have 3 or 4 columns")
    columns = ["seqname STRING", "start_ BIGINT", "end_ BIGINT", "name STRING"][:n_columns]
    rows = spark.read.csv(paths, sep="\t", comment=comment, schema=", ".join(columns), mode="FAILFAST")
    sample = file_barcode(F.col(_PATH), barcode) if barcode else file_barcode(F.col(_PATH))
    name = F.col("name") if n_columns == 4 else F.concat(F.lit("read-"), F.monotonically_increasing_id().cast("string"))
    rows = rows.select(sample.alias("sample"), "seqname", "start_", "end_", name.alias("name")).filter("sample IS NOT NULL")
    return rows.withColumn("length", F.col("end_") - F.col("start_"))


def read_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Raw lines of interval files for the reject operator: line_id, file_name, line_no (null), line_text.

    Ids are unique within one reading of the files; their order says nothing.
    """
    name = F.regexp_extract(_PATH, "([^/]+)$", 1)
    lines = spark.read.text(paths).select(name.alias("file_name"), F.col("value").alias("line_text"))
    return lines.select(F.monotonically_increasing_id().alias("line_id"), "file_name", F.lit(None).cast("int").alias("line_no"), "line_text")


def require_barcodes(fragments: DataFrame, pattern: str) -> DataFrame:
    """Fragments, or :class:`BarcodeError` if no barcode matches ``pattern``."""
    if fragments.filter(F.col("barcode").rlike(pattern)).limit(1).count() == 0:
        raise BarcodeError(f"no barcode matches {pattern!r}")
    return fragments


def read_intervals(spark: SparkSession, paths: str | Sequence[str], named: bool = True) -> DataFrame:
    """Intervals of a selection file: seqname, start_, end_ and, if ``named``, the fourth column (null where there is none)."""
    rows = spark.read.csv(paths, sep="\t", comment="#", schema="seqname STRING, start_ BIGINT, end_ BIGINT, name STRING")
    return rows if named else rows.drop("name")


def read_blacklist(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Blacklist of exactly four columns: seqname, start_, end_, type_; other lines fail the query."""
    return spark.read.csv(paths, sep="\t", comment="#", schema="seqname STRING, start_ BIGINT, end_ BIGINT, type_ STRING", mode="FAILFAST")


def read_bedgraph(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Values on intervals: seqname, start_, end_, value; header, track and comment lines are skipped."""
    lines = spark.read.text(paths).filter(is_data_line(F.col("value")))
    row = F.from_csv("value", "seqname STRING, start_ BIGINT, end_ BIGINT, value DOUBLE", {"sep": "\t"})
    return lines.select(row.alias("r")).select("r.*").filter("start_ IS NOT NULL")


def read_chrom_sizes(spark: SparkSession, paths: str | Sequence[str], used: DataFrame | None = None) -> DataFrame:
    """Sequence sizes, separated by any blanks, ordered by name; only those ``used`` has, if given."""
    part = F.split(F.trim("value"), r"\s+")
    sizes = spark.read.text(paths).filter("trim(value) != ''").select(part[0].alias("seqname"), part[1].cast("bigint").alias("size_"))
    if used is not None:
        sizes = sizes.join(used.select("seqname").distinct(), "seqname", "left_semi")
    return sizes.orderBy("seqname")


def read_annotation(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Gene annotation: seqname (with ``chr``), feature, start_, end_, strand, gene_name, gene_id, transcript_id, stranded_start, stranded_end."""
    from intervane.functions.regions import with_chr
    from intervane.operators.annotation import stranded

    schema = "seqname STRING, source STRING, feature STRING, start_ BIGINT, end_ BIGINT, score STRING, strand STRING, frame STRING, attributes STRING"
    rows = spark.read.csv(paths, sep="\t", comment="#", schema=schema, quote="")
    found = lambda key: F.regexp_extract("attributes", rf'{key} "([^"]*)"', 1)
    names = [F.when(found(k) != "", found(k)).alias(k) for k in ("gene_name", "gene_id", "transcript_id")]
    return stranded(rows.select(with_chr(F.col("seqname")).alias("seqname"), "feature", "start_", "end_", "strand", *names))


def region_scan(fragments: DataFrame, seqname: str, low: int, high: int, nucleosome: int = 120) -> DataFrame:
    """Fragments that reach into a region, with absolute length, read_type and long_type; the filter is pushed down to the scan."""
    from intervane.operators.fragments import fragment_length, long_type, read_type
    from intervane.operators.range_join import region

    length = fragment_length(signed=False)
    return region(fragments, seqname, low, high).withColumns({"length": length, "read_type": read_type(length, nucleosome), "long_type": long_type(length, nucleosome)})
