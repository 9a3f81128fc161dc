"""Loading raw fragment lines while keeping the lines that fail to parse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Stands for a well-formed quoted stretch while a line is inspected.
_MARK = "\x01"
_COUNTS = (3, 4)
_CSV = {
    "sep": "\t",
    "quote": '"',
    "escape": '"',
    "mode": "PERMISSIVE",
    "columnNameOfCorruptRecord": "raw",
    "maxCharsPerColumn": "-1",
}


def is_data_line(line: Column) -> Column:
    """False for null, blank, comment, ``track`` and ``browser`` lines."""
    aside = line.isNull() | line.rlike(r"^[ \t]*(#|\z)") | line.startswith("track ") | line.startswith("browser ")
    return ~aside


_NAMES = ("seqname", "start", "end", "name")


def _with_strict(rows: DataFrame) -> DataFrame:
    """``rows`` with ``strict``: the fields of the lines that were not read, by the exact quoting rule.

    Quoted stretches are cut out by one left-to-right replacement, so that the
    cost stays linear for lines of any length. Steps are columns of their own,
    which Spark then works out once.
    """
    line = F.col("line")
    odd = F.col("read").isNull()
    hide = lambda piece, i: F.when(i % 2 == 1, F.translate(piece, "\t", " ")).otherwise(piece)
    rows = rows.withColumn("masked", F.when(odd, F.regexp_replace(F.translate(line, _MARK, "x"), '"[^"]*"', _MARK)))
    rows = rows.withColumn("hidden", F.when(odd, F.array_join(F.transform(F.split(line, '"', -1), hide), '"')))
    rows = rows.withColumn("widths", F.transform(F.slice(F.split("hidden", "\t", -1), 1, 4), F.length))
    masked, widths = F.col("masked"), F.col("widths")

    def field(i: int) -> Column:
        before = F.lit(1 + i)
        for j in range(i):
            before = before + F.coalesce(F.get(widths, F.lit(j)), F.lit(0))
        value = F.substring(line, before, F.get(widths, F.lit(i)))
        inside = F.replace(F.substring(value, F.lit(2), F.length(value) - 2), F.lit('""'), F.lit('"'))
        return F.when(value.startswith('"'), inside).otherwise(value)

    strict = F.struct(
        (masked.contains('"') | masked.rlike(f"[^\t{_MARK}]{_MARK}|{_MARK}[^\t{_MARK}]")).alias("bad_quote"),
        (F.length(masked) - F.length(F.replace(masked, F.lit("\t"), F.lit(""))) + 1).cast("int").alias("n_fields"),
        *(field(i).alias(name) for i, name in enumerate(_NAMES)),
    )
    return rows.withColumn("strict", F.when(odd, strict)).drop("masked", "hidden", "widths")


def _with_permissive(rows: DataFrame) -> DataFrame:
    """``rows`` with ``read``: the fields of the lines read permissively without loss.

    A line is read under the explicit schema of its file. It counts as read
    without loss when the reader kept no corrupt text, no quote stands in it and
    its typed fields spell the line again; every other line goes to the exact rule.
    A line whose number of separators is not that of the schema is corrupt whatever
    they separate; it is not given to the reader, which ends a query over a line of
    more fields than it has room for.
    """
    line = F.col("line")
    separators = F.length(line) - F.length(F.replace(line, F.lit("\t"), F.lit("")))
    for n in _COUNTS:
        fourth = ", name STRING" * (n == 4)
        fit = (F.col("n_columns") == n) & (separators == n - 1)
        rows = rows.withColumn(f"row{n}", F.from_csv(F.when(fit, line), f"seqname STRING, start BIGINT, end BIGINT{fourth}, raw STRING", _CSV))
    reads = []
    for n in _COUNTS:
        row = F.col(f"row{n}")
        typed = [row["seqname"], row["start"].cast("string"), row["end"].cast("string"), *([row["name"]] if n == 4 else [])]
        whole = row.isNotNull() & row["raw"].isNull() & ~line.contains('"') & (row["start"] >= 0) & (row["end"] >= 0) & (F.concat_ws("\t", *typed) == line)
        for value in typed:
            whole = whole & value.isNotNull()
        name = row["name"] if n == 4 else F.lit(None).cast("string")
        read = F.struct(F.lit(False).alias("bad_quote"), F.lit(n).alias("n_fields"), *(v.alias(k) for v, k in zip((*typed[:3], name), _NAMES, strict=True)))
        reads.append(F.when(whole, read))
    return rows.withColumn("read", F.coalesce(*reads)).drop(*(f"row{n}" for n in _COUNTS))


def _number(digits: Column) -> Column:
    """Value of a digit string; 10**18, beyond any sequence, where it has over 18 digits."""
    short = F.regexp_replace(digits, "^0+(?=[0-9])", "")
    return F.when(F.length(short) <= 18, short.try_cast("bigint")).otherwise(F.lit(10**18))


def parse_lines(lines: DataFrame, files: DataFrame, chrom_sizes: DataFrame) -> DataFrame:
    """Every data line with its fields and, where it cannot be loaded, the reason.

    ``lines``: line_id, file_name, line_no, line_text. ``files``: file_name,
    sample, n_columns. ``chrom_sizes``: seqname, size_. Other columns are
    ignored, whatever their names. Each line is read permissively under the
    explicit schema of its file; lines the reader marks corrupt or does not
    spell again exactly are reclassified from the raw text, in the order
    ``quoting``, ``column_count``, ``seqname``, ``start``, ``end``, ``bounds``.

    Defined cases: null text is no data line; a line of an unlisted file (or of
    a null file name) may have 3 or 4 columns and has a null sample; numbers
    may have leading zeros and any length; a sequence without a size fails as
    ``seqname``; a row delivered twice stays twice here. Empty inputs give
    empty results.

    Result: line_id, file_name, line_no, sample, seqname, start_, end_, name,
    line_text, reason (null for a loaded line). A three-column line is named
    ``read-<line_no>``.
    """
    files = files.groupBy("file_name").agg(F.max("sample").alias("sample"), F.max("n_columns").alias("n_columns"))
    sizes = chrom_sizes.groupBy(F.col("seqname").alias("known")).agg(F.max("size_").alias("size_"))
    line = F.regexp_replace("line_text", r"\r\z", "")
    rows = (
        lines.select("line_id", "file_name", "line_no", "line_text", line.alias("line"))
        .filter(is_data_line(F.col("line")))
        .join(files, "file_name", "left")
    )
    wanted = F.col("n_columns")
    rows = _with_strict(_with_permissive(rows)).withColumn("f", F.coalesce("read", "strict")).drop("read", "strict")
    rows = rows.withColumn("seq", F.col("f.seqname")).join(sizes, F.col("seq") == F.col("known"), "left")
    digits = "^[0-9]+\\z"
    start, end = _number(F.col("f.start")), _number(F.col("f.end"))
    fits = F.when(wanted.isNull(), F.col("f.n_fields").isin(*_COUNTS)).otherwise(F.col("f.n_fields") == wanted)
    reason = (
        F.when(F.col("f.bad_quote"), "quoting")
        .when(~fits, "column_count")
        .when(F.col("size_").isNull(), "seqname")
        .when(~F.col("f.start").rlike(digits), "start")
        .when(~F.col("f.end").rlike(digits), "end")
        .when((end <= start) | (end > F.col("size_")), "bounds")
    )
    named = F.when(F.col("f.n_fields") == 3, F.concat(F.lit("read-"), F.col("line_no").cast("string"))).otherwise(F.col("f.name"))
    loaded = reason.isNull()
    return rows.select(
        "line_id",
        "file_name",
        "line_no",
        "sample",
        F.when(loaded, F.col("seq")).alias("seqname"),
        F.when(loaded, start).alias("start_"),
        F.when(loaded, end).alias("end_"),
        F.when(loaded, named).alias("name"),
        "line_text",
        reason.alias("reason"),
    )


def split_lines(lines: DataFrame, files: DataFrame, chrom_sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(fragments, rejects)`` of :func:`parse_lines`, each delivered line once.

    Deliveries are equal but for the delivery time, so a line is identified by
    its id and content. ``fragments`` carries the signed length.
    """
    parsed = parse_lines(lines, files, chrom_sizes)
    fragments = (
        parsed.filter(F.col("reason").isNull())
        .select("line_id", "sample", "seqname", "start_", "end_", "name", (F.col("end_") - F.col("start_")).alias("length"))
        .distinct()
    )
    rejects = parsed.filter(F.col("reason").isNotNull()).select("line_id", "file_name", "line_no", "line_text", "reason").distinct()
    return fragments, rejects
