"""Fragments: copies, cuts, labels of reads, barcodes and sequences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FRAGMENT = ("fragment_id", "sample", "seqname", "start_", "end_", "name", "barcode", "length")
COPY_KEY = ("barcode", "seqname", "start_", "end_")


def deduplicated(fragments: DataFrame, key: Sequence[str] = COPY_KEY, order: str = "fragment_id") -> DataFrame:
    """One fragment per ``key``: the first in ``order``.

    Amplification copies have the same coordinates and barcode. Written as an
    aggregation of the smallest row, so copies are dropped before the shuffle and
    a barcode with a large share of the rows costs nothing. Nulls in the key are
    equal to each other; a fragment delivered twice counts once.
    """
    rest = [c for c in FRAGMENT if c in fragments.columns and c not in key and c != order]
    best = fragments.groupBy(*key).agg(F.min(F.struct(order, *rest)).alias("best"))
    return best.select(*key, f"best.{order}", *(f"best.{c}" for c in rest)).select(*(c for c in FRAGMENT if c in fragments.columns))


def duplicate_stats(fragments: DataFrame, key: Sequence[str] = COPY_KEY) -> DataFrame:
    """Per sample: fragments, distinct fragments, and the number and share of removed copies."""
    per_key = fragments.groupBy("sample", *key).agg(F.count_distinct("fragment_id").alias("n"))
    return (
        per_key.groupBy("sample")
        .agg(F.sum("n").alias("n_fragments"), F.count("*").alias("n_distinct"))
        .withColumn("n_removed", F.col("n_fragments") - F.col("n_distinct"))
        .withColumn("share_removed", F.try_divide("n_removed", "n_fragments"))
    )


def to_events(fragments: DataFrame) -> DataFrame:
    """Both ends of every fragment as point events: ``variable`` ('start' or 'end') and ``location``."""
    kept = [c for c in fragments.columns if c not in ("start_", "end_")]
    ends = F.array(*(F.struct(F.lit(v).alias("variable"), F.col(c).alias("location")) for v, c in (("start", "start_"), ("end", "end_"))))
    return fragments.select(*kept, F.explode(ends).alias("cut")).select(*kept, "cut.variable", "cut.location")


def fragment_length(signed: bool = True) -> Column:
    """``end - start``, signed as loaded or absolute as in region scans."""
    length = F.col("end_") - F.col("start_")
    return length if signed else F.abs(length)


def read_type(length: Column, nucleosome: int = 120) -> Column:
    """``>120`` or ``≤120``."""
    return F.when(length > nucleosome, f">{nucleosome}").otherwise(f"≤{nucleosome}")


def long_type(length: Column, nucleosome: int = 120) -> Column:
    """``>240``, ``>120`` or ``≤120``."""
    return F.when(length > 2 * nucleosome, f">{2 * nucleosome}").otherwise(read_type(length, nucleosome))


def facet_label(*parts: Column) -> Column:
    """Label of a facet: the parts that are not null, with a blank between."""
    return F.concat_ws(" ", *parts)


def replaced_barcode(barcode: Column, pattern: str, extract: bool = False) -> Column:
    """The part of ``barcode`` that matches ``pattern`` replaced by its first group, or only that group."""
    return F.regexp_extract(barcode, pattern, 1) if extract else F.regexp_replace(barcode, pattern, "$1")


def without_postfix(seqname: Column) -> Column:
    """Sequence name up to its first underscore."""
    return F.regexp_replace(seqname, "_.*", "")


def outside_sequences(rows: DataFrame, excluded: Sequence[str]) -> DataFrame:
    """Rows on none of the ``excluded`` sequences (exact names); a null sequence stays out."""
    return rows.filter(~F.col("seqname").isin(*excluded)) if excluded else rows.filter("seqname IS NOT NULL")


def frequent_groups(rows: DataFrame, group: Sequence[str], min_count: int) -> DataFrame:
    """Rows of groups with at least ``min_count`` rows; groups are counted before the join, so no group is gathered."""
    counts = rows.groupBy(*group).agg(F.count("*").alias("group_size")).filter(F.col("group_size") >= min_count)
    same = [F.col(g).eqNullSafe(F.col(f"of_{g}")) for g in group]
    counts = counts.select(*(F.col(g).alias(f"of_{g}") for g in group))
    condition = same[0]
    for s in same[1:]:
        condition = condition & s
    return rows.join(counts, condition, "left_semi")
