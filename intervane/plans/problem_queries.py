"""Registered queries of the core training-data operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from intervane.operators.periods import periods_and_gaps
from intervane.operators.regrid import regular_series
from intervane.operators.rejects import split_lines
from intervane.session import table


def _split(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return split_lines(*(table(spark, folder, name) for name in ("bed_lines", "bed_files", "chrom_sizes")))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Data lines that fail to load, with the reason."""
    return _split(spark, folder)[1].select("line_id", "reason").distinct()


def p1_fragments(spark: SparkSession, folder: str) -> DataFrame:
    """The fragments of the lines that load."""
    return _split(spark, folder)[0]


def p1_reject_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Failing lines per file and reason."""
    return _split(spark, folder)[1].groupBy("file_name", "reason").agg(F.count_distinct("line_id").alias("n_lines"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Periods and gaps of the peaks of each sample and sequence."""
    return periods_and_gaps(table(spark, folder, "peaks"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Grid bins without any cut."""
    series = regular_series(table(spark, folder, "cuts"), table(spark, folder, "tracks"))
    return series.filter("state != 'observed'").select("sample", "seqname", "bin_start")


def p4_series(spark: SparkSession, folder: str) -> DataFrame:
    """Every grid bin with its cuts, its value and whether it was observed, filled or missing."""
    series = regular_series(table(spark, folder, "cuts"), table(spark, folder, "tracks"))
    return series.withColumn("value", F.round("value", 6))


QUERIES = {f.__name__: f for f in (p1_found, p1_fragments, p1_reject_rates, p2_found, p4_found, p4_series)}

_FIELD = r'(?:"(?:[^"]|"")*"|[^\t"]*)'
_LINES = rf"""
WITH texts AS (
  SELECT DISTINCT line_id, file_name, line_no,
         CASE WHEN line_text LIKE '%' || chr(13) THEN left(line_text, length(line_text) - 1) ELSE line_text END AS line
  FROM bed_lines),
fields AS (
  SELECT t.*, f.sample, f.n_columns,
         regexp_full_match(line, '{_FIELD}(\t{_FIELD})*') AS quoted_well,
         length(regexp_replace(line, '"[^"]*"', 'q', 'g')) - length(replace(regexp_replace(line, '"[^"]*"', 'q', 'g'), chr(9), '')) + 1 AS n_fields,
         regexp_extract(line, '^({_FIELD})\t({_FIELD})\t({_FIELD})(?:\t({_FIELD}))?$', ['a', 'b', 'c', 'd']) AS p
  FROM texts t LEFT JOIN bed_files f USING (file_name)
  WHERE line IS NOT NULL AND NOT regexp_matches(line, '^[ \t]*(#|$)')
    AND NOT starts_with(line, 'track ') AND NOT starts_with(line, 'browser ')),
plain AS (
  SELECT *, CASE WHEN starts_with(p.a, '"') THEN replace(p.a[2:length(p.a)-1], '""', '"') ELSE p.a END AS a,
            CASE WHEN starts_with(p.b, '"') THEN replace(p.b[2:length(p.b)-1], '""', '"') ELSE p.b END AS b,
            CASE WHEN starts_with(p.c, '"') THEN replace(p.c[2:length(p.c)-1], '""', '"') ELSE p.c END AS c,
            CASE WHEN starts_with(p.d, '"') THEN replace(p.d[2:length(p.d)-1], '""', '"') ELSE p.d END AS d
  FROM fields),
judged AS (
  SELECT line_id, file_name, line_no, sample, a, b, c, n_fields, d,
         CASE WHEN NOT quoted_well THEN 'quoting'
              WHEN n_fields <> n_columns THEN 'column_count'
              WHEN size_ IS NULL THEN 'seqname'
              WHEN NOT regexp_full_match(b, '[0-9]+') THEN 'start'
              WHEN NOT regexp_full_match(c, '[0-9]+') THEN 'end'
              WHEN CAST(c AS HUGEINT) <= CAST(b AS HUGEINT) OR CAST(c AS HUGEINT) > size_ THEN 'bounds' END AS reason
  FROM plain LEFT JOIN chrom_sizes ON a = seqname)
"""
_BINS = """
WITH once AS (SELECT DISTINCT cut_id, sample, seqname, location FROM cuts WHERE location IS NOT NULL),
counts AS (
  SELECT t.track_id, (c.location - t.grid_start) // t.step AS k, count(DISTINCT cut_id) AS n
  FROM once c JOIN tracks t ON c.sample = t.sample AND c.seqname = t.seqname
   AND c.location >= t.grid_start AND c.location < t.grid_end
  GROUP BY ALL),
bins AS (
  SELECT t.track_id, t.sample, t.seqname, t.grid_start, t.step, k
  FROM tracks t, unnest(range(0, (t.grid_end - t.grid_start) // t.step)) AS u(k)),
grid AS (SELECT b.*, n FROM bins b LEFT JOIN counts c ON b.track_id = c.track_id AND b.k = c.k)
"""
SQL = {
    "p1_found": _LINES + "SELECT DISTINCT line_id, reason FROM judged WHERE reason IS NOT NULL",
    "p1_fragments": _LINES
    + """SELECT DISTINCT line_id, sample, a AS seqname, CAST(b AS BIGINT) AS start_, CAST(c AS BIGINT) AS end_,
         CASE WHEN n_fields = 3 THEN 'read-' || line_no ELSE d END AS name, CAST(c AS BIGINT) - CAST(b AS BIGINT) AS length
         FROM judged WHERE reason IS NULL""",
    "p1_reject_rates": _LINES + "SELECT file_name, reason, count(DISTINCT line_id) AS n_lines FROM judged WHERE reason IS NOT NULL GROUP BY ALL",
    "p2_found": """
WITH good AS (SELECT DISTINCT sample, seqname, start_, end_ FROM peaks
              WHERE sample IS NOT NULL AND seqname IS NOT NULL AND start_ < end_),
reached AS (SELECT *, max(end_) OVER (PARTITION BY sample, seqname ORDER BY start_, end_
                                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM good),
labelled AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_ > reach THEN 1 ELSE 0 END)
                       OVER (PARTITION BY sample, seqname ORDER BY start_, end_ ROWS UNBOUNDED PRECEDING) AS label FROM reached),
periods AS (SELECT sample, seqname, label, min(start_) AS start_, max(end_) AS end_ FROM labelled GROUP BY ALL)
SELECT 'period' AS kind, sample, seqname, start_, end_ FROM periods
UNION ALL
SELECT 'gap', sample, seqname, end_, following FROM (
  SELECT *, lead(start_) OVER (PARTITION BY sample, seqname ORDER BY start_) AS following FROM periods) WHERE following IS NOT NULL""",
    "p4_found": _BINS + "SELECT sample, seqname, grid_start + k * step AS bin_start FROM grid WHERE n IS NULL",
    "p4_series": _BINS
    + """,
near AS (SELECT track_id, k, CAST(n AS DOUBLE) AS v,
         lag(k) OVER w AS k0, lag(CAST(n AS DOUBLE)) OVER w AS v0, lead(k) OVER w AS k1, lead(CAST(n AS DOUBLE)) OVER w AS v1
         FROM counts WINDOW w AS (PARTITION BY track_id ORDER BY k)),
secants AS (SELECT *, CASE WHEN k - k0 <= 6 THEN k - k0 END AS h0, CASE WHEN k1 - k <= 6 THEN k1 - k END AS h1 FROM near),
slopes AS (SELECT *, (v - v0) / h0 AS d0, (v1 - v) / h1 AS d1 FROM secants),
knots AS (SELECT track_id, k, v, CASE WHEN d0 IS NULL THEN coalesce(d1, 0e0) WHEN d1 IS NULL THEN d0
          WHEN d0 * d1 > 0 THEN (3e0 * h1 + 3e0 * h0) / ((2 * h1 + h0) / d0 + (h1 + 2 * h0) / d1) ELSE 0e0 END AS m FROM slopes),
spans AS (SELECT track_id, k AS ka, v AS va, m AS ma, lead(k) OVER w AS kb, lead(v) OVER w AS vb, lead(m) OVER w AS mb
          FROM knots WINDOW w AS (PARTITION BY track_id ORDER BY k)),
placed AS (SELECT g.*, s.*, CAST(g.k - ka AS DOUBLE) / (kb - ka) AS t, CAST(kb - ka AS DOUBLE) AS h
           FROM grid g LEFT JOIN spans s ON g.track_id = s.track_id AND g.k > s.ka AND g.k < s.kb AND kb - ka <= 6)
SELECT track_id, sample, seqname, grid_start + k * step AS bin_start, coalesce(n, 0) AS n_cuts,
       CASE WHEN n IS NOT NULL THEN 'observed' WHEN ka IS NOT NULL THEN 'filled' ELSE 'missing' END AS state,
       round(CASE WHEN n IS NOT NULL THEN n ELSE (1 + 2 * t) * (1 - t) * (1 - t) * va + t * (1 - t) * (1 - t) * h * ma
             + t * t * (3 - 2 * t) * vb + t * t * (t - 1) * h * mb END, 6) AS value FROM placed""".replace("g.*, s.*", "g.*, s.* EXCLUDE (track_id)"),
}
