"""Registered queries that write whole tables as interval files and read them back, with the SQL of the same tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from intervane.plans import interval_queries, interval_sql, pipelines
from intervane.plans.interval_queries import NARROW_PEAKS, rounded
from intervane.session import scratch, table
from intervane.sources import interval_files as files
from intervane.sources import interval_sinks as sinks

QUERIES = {}


def query(build):
    """Register a query under its name."""
    QUERIES[build.__name__] = build
    return build


def _placed(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return table(spark, folder, name).dropna(subset=["seqname", "start_", "end_"])


@query
def fragment_files(spark: SparkSession, folder: str) -> DataFrame:
    """Fragments of every sequence after a way through four-column files."""
    path = scratch(spark)
    sinks.write_bed(_placed(spark, folder, "fragments"), path, "seqname", "start_", "end_", "name")
    rows = files.read_fragments(spark, path)
    return rows.groupBy("seqname").agg(F.count("*").alias("n"), F.count_distinct("name").alias("n_names"), F.sum("start_").alias("starts"), F.sum("length").alias("bases"))


@query
def unnamed_files(spark: SparkSession, folder: str) -> DataFrame:
    """Fragments of every sequence after a way through three-column files: every line has a name of its own."""
    path = scratch(spark)
    sinks.write_bed(_placed(spark, folder, "fragments"), path, "seqname", "start_", "end_")
    rows = files.read_fragments(spark, path, 3)
    return rows.groupBy("seqname").agg(F.count("*").alias("n"), F.count_distinct("name").alias("n_names"), F.sum("length").alias("bases"))


@query
def files_by_sample(spark: SparkSession, folder: str) -> DataFrame:
    """Fragments per sample, which is read from the names of the folders the files lie in."""
    path = scratch(spark)
    _placed(spark, folder, "fragments").select("sample", "seqname", "start_", "end_", "name").write.partitionBy("sample").csv(path, sep="\t", quote="")
    rows = files.read_fragments(spark, f"{path}/*", barcode="/sample=([^/]+)/")
    return rows.groupBy("sample").agg(F.count("*").alias("n"), F.sum("end_").alias("ends"))


@query
def line_files(spark: SparkSession, folder: str) -> DataFrame:
    """Raw lines by their first character after a way through text files."""
    path = scratch(spark)
    text = table(spark, folder, "bed_lines").filter(r"line_text IS NOT NULL AND NOT line_text RLIKE '[\r\n]'")
    text.select("line_text").write.text(path)
    return files.read_lines(spark, path).groupBy(F.substring("line_text", 1, 1).alias("first")).agg(F.count_distinct("line_id").alias("n"), F.sum(F.length("line_text")).alias("chars"))


@query
def blacklist_files(spark: SparkSession, folder: str) -> DataFrame:
    """The blacklist after a way through files, as one and as a selection."""
    path = scratch(spark)
    sinks.write_bed(table(spark, folder, "blacklist"), path, "seqname", "start_", "end_", "type_")
    return files.read_blacklist(spark, path).unionByName(files.read_intervals(spark, path, named=False).withColumn("type_", F.lit("selection")))


@query
def size_files(spark: SparkSession, folder: str) -> DataFrame:
    """Sizes of the sequences that the tracks use after a way through text."""
    path = scratch(spark)
    table(spark, folder, "chrom_sizes").select(F.concat_ws("  ", "seqname", "size_")).write.text(path)
    return files.read_chrom_sizes(spark, path, table(spark, folder, "tracks"))


@query
def bedgraph_files(spark: SparkSession, folder: str) -> DataFrame:
    """Areas of the peaks after a way through bedGraph files."""
    path = scratch(spark)
    sinks.write_bedgraph(_placed(spark, folder, "peaks").dropna(subset=["auc"]), path, "auc")
    return rounded(files.read_bedgraph(spark, path).groupBy("seqname").agg(F.count("*").alias("n"), F.sum("end_").alias("ends"), F.sum("value").alias("area")), "area")


@query
def annotation_files(spark: SparkSession, folder: str) -> DataFrame:
    """Peaks as exons of a gene annotation, with strands, after a way through its text format."""
    path = scratch(spark)
    strand = F.when(F.col("track") == "c1", "+").otherwise("-")
    rows = _placed(spark, folder, "peaks").dropna(subset=["sample", "track"])
    attributes = F.concat(F.lit('gene_id "'), "sample", F.lit('"; transcript_id "'), F.col("peak_id").cast("string"), F.lit('";'))
    dot = F.lit(".")
    rows.select(F.concat_ws("\t", F.regexp_replace("seqname", "^chr", ""), F.lit("made"), F.lit("exon"), F.col("start_"), F.col("end_"), dot, strand, dot, attributes)).write.text(path)
    made = files.read_annotation(spark, path).select("seqname", "gene_name", "gene_id", "transcript_id", "strand", "stranded_start", "stranded_end")
    return made.distinct()


@query
def peak_files(spark: SparkSession, folder: str) -> DataFrame:
    """Peaks and summits of both tracks after a way through files."""
    path, marked = scratch(spark), interval_queries._marked(spark, folder, NARROW_PEAKS)
    c1, c2 = interval_queries._peaks(marked, NARROW_PEAKS)
    sinks.write_peaks(c1.unionByName(c2), c1.select("seqname", "start_", "end_", "mean"), path)
    parts = [files.read_intervals(spark, f"{path}/{c}_{kind}.bed").withColumn("kind", F.lit(kind)) for c in ("c1", "c2") for kind in ("peaks", "summits")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query
def fit_files(spark: SparkSession, folder: str) -> DataFrame:
    """Fitted weights after a way through the folder of fits, which must hold every chunk."""
    path, weights = scratch(spark), interval_queries._fit(spark, folder)[1]
    sinks.write_fit(weights, path, "{}")
    return rounded(sinks.read_fit(spark, path, weights.select("workchunk")).select("workchunk", "comp", "k", "w"), "w")


@query
def package_files(spark: SparkSession, folder: str) -> DataFrame:
    """Packages after a way through the folder of chunks, and the number of chunks that was kept beside them."""
    path, cfg = scratch(spark), interval_queries.DIVIDED_PREP
    made = pipelines.pack.work_chunks(interval_queries._divided(spark, folder)[1], cfg.memory_target, cfg.seed)
    sinks.write_packages(made, path)
    kept = spark.read.parquet(f"{path}/n_chunks").select("n_chunks").scalar()
    found = sinks.read_packages(spark, path).agg(F.count("*").alias("n_packages"), F.sum("ncuts").alias("ncuts"), F.count_distinct("workchunk").alias("chunks"))
    return found.select("n_packages", "ncuts", (F.col("chunks") == kept).alias("all_chunks"))


_PLACED = "seqname IS NOT NULL AND start_ IS NOT NULL AND end_ IS NOT NULL"
SQL = {
    "fragment_files": f"""
SELECT seqname, count(*) AS n, count(DISTINCT name) AS n_names, CAST(sum(start_) AS BIGINT) AS starts, CAST(sum(end_ - start_) AS BIGINT) AS bases
FROM fragments WHERE {_PLACED} GROUP BY seqname""",
    "unnamed_files": f"SELECT seqname, count(*) AS n, count(*) AS n_names, CAST(sum(end_ - start_) AS BIGINT) AS bases FROM fragments WHERE {_PLACED} GROUP BY seqname",
    "files_by_sample": f"SELECT sample, count(*) AS n, CAST(sum(end_) AS BIGINT) AS ends FROM fragments WHERE {_PLACED} AND sample IS NOT NULL GROUP BY sample",
    "line_files": r"""
SELECT substring(line_text, 1, 1) AS first, count(*) AS n, CAST(sum(length(line_text)) AS BIGINT) AS chars
FROM bed_lines WHERE line_text IS NOT NULL AND NOT regexp_matches(line_text, '[\r\n]') GROUP BY first""",
    "blacklist_files": "SELECT seqname, start_, end_, type_ FROM blacklist UNION ALL SELECT seqname, start_, end_, 'selection' FROM blacklist",
    "size_files": "SELECT seqname, size_ FROM chrom_sizes WHERE seqname IN (SELECT seqname FROM tracks)",
    "bedgraph_files": f"""
SELECT seqname, count(*) AS n, CAST(sum(end_) AS BIGINT) AS ends, round(sum(auc), 6) AS area FROM peaks WHERE {_PLACED} AND auc IS NOT NULL GROUP BY seqname""",
    "annotation_files": f"""
SELECT DISTINCT CASE WHEN starts_with(seqname, 'chr') THEN seqname ELSE 'chr' || seqname END AS seqname, CAST(NULL AS VARCHAR) AS gene_name, sample AS gene_id,
       CAST(peak_id AS VARCHAR) AS transcript_id, CASE WHEN track = 'c1' THEN '+' ELSE '-' END AS strand,
       CASE WHEN track = 'c1' THEN start_ ELSE end_ END AS stranded_start, CASE WHEN track = 'c1' THEN end_ ELSE start_ END AS stranded_end
FROM peaks WHERE {_PLACED} AND sample IS NOT NULL AND track IS NOT NULL""",
    "peak_files": interval_sql._PEAKS
    + "SELECT 'peaks' AS kind, seqname, start_, end_, name FROM called UNION ALL SELECT 'summits', seqname, summit, summit + 1, name FROM called",
    "fit_files": interval_sql.SQL["fit_weights"],
    "package_files": interval_sql._DIVIDED + "SELECT count(*) AS n_packages, CAST(sum(ncuts) AS BIGINT) AS ncuts, true AS all_chunks FROM made",
}
