"""Registered queries of the text and sequence operators, with the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from intervane.llm import mixing, packing, runs, truncation
from intervane.llm.tokens import token_counts
from intervane.session import table, written


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every cut that repeats an earlier one of its run."""
    found = runs.repeated_events(table(spark, folder, "cuts"))
    return found.select(F.col("first_id").alias("first_cut_id"), F.col("event_id").alias("cut_id"))


def p3_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Every run of cuts as one event."""
    return runs.collapsed_runs(table(spark, folder, "cuts"))


def p3_runs_similar(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of which neighbours are at least half similar, which the gap limit alone would join to longer ones."""
    return runs.collapsed_runs(table(spark, folder, "cuts"), min_similarity=0.5)


def _sizes(spark: SparkSession, folder: str) -> DataFrame:
    return written(token_counts(table(spark, folder, "documents"), ["doc_id", "source"]))


def _capacities(spark: SparkSession, folder: str) -> dict[str, int]:
    """The capacities asked for: a fixed table of settings."""
    return {r["pack_name"]: r["capacity_tokens"] for r in table(spark, folder, "pack_sizes").collect()}


def p5_packs(spark: SparkSession, folder: str) -> DataFrame:
    """Every document in containers of every capacity."""
    return packing.packed(_sizes(spark, folder), _capacities(spark, folder))


def p5_usage(spark: SparkSession, folder: str) -> DataFrame:
    """How full the containers are."""
    return packing.pack_usage(p5_packs(spark, folder), _capacities(spark, folder))


def p5_faults(spark: SparkSession, folder: str) -> DataFrame:
    """What a packing must not do, counted for every capacity."""
    sizes, capacities = _sizes(spark, folder), _capacities(spark, folder)
    return packing.packing_faults(packing.packed(sizes, capacities), sizes, capacities)


def p6_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of every mix."""
    return mixing.mixed(_sizes(spark, folder), table(spark, folder, "mix_targets"))


def p6_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Shares reached by every source of every mix."""
    sizes, targets = _sizes(spark, folder), table(spark, folder, "mix_targets")
    return mixing.mix_shares(mixing.mixed(sizes, targets), sizes, targets)


def _characters(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", "source", F.col("n_chars").alias("n_tokens"))


def p6_mix_chars(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of every mix where characters are the size, which SQL can count."""
    return mixing.mixed(_characters(spark, folder), table(spark, folder, "mix_targets")).withColumnRenamed("n_tokens", "n_chars")


def p6_faults(spark: SparkSession, folder: str) -> DataFrame:
    """Listed sources of every mix, and how many miss their share by more than half a text or repeat one too often."""
    sizes, targets = _sizes(spark, folder), table(spark, folder, "mix_targets")
    return mixing.mix_faults(mixing.mixed(sizes, targets), sizes, targets)


def p7_hazards(spark: SparkSession, folder: str) -> DataFrame:
    """Lengths of texts whose hazard is significantly above that of their neighbours."""
    found = truncation.length_hazards(truncation.text_lengths(table(spark, folder, "documents"))).filter("significant")
    return found.select("source", "measure", "length", "n", "at_risk", F.round("hazard", 9).alias("hazard"), F.round("expected", 9).alias("expected"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that were cut off."""
    return truncation.truncated_texts(table(spark, folder, "documents")).filter("truncated").select("doc_id").distinct()


def p7_sources(spark: SparkSession, folder: str) -> DataFrame:
    """How often each source cuts texts off."""
    return truncation.truncation_report(table(spark, folder, "documents"))


QUERIES = {f.__name__: f for f in (p3_found, p3_runs, p3_runs_similar, p5_packs, p5_usage, p5_faults, p6_mix, p6_mix_chars, p6_shares, p6_faults, p7_found, p7_hazards, p7_sources)}

_RUNS = """
WITH once AS (SELECT DISTINCT cut_id, sample, seqname, location FROM cuts
              WHERE cut_id IS NOT NULL AND sample IS NOT NULL AND seqname IS NOT NULL AND location IS NOT NULL),
gaps AS (SELECT *, location - lag(location) OVER (PARTITION BY sample, seqname ORDER BY location, cut_id) AS gap FROM once),
labelled AS (SELECT *, sum(CASE WHEN gap <= 2 THEN 0 ELSE 1 END)
                       OVER (PARTITION BY sample, seqname ORDER BY location, cut_id ROWS UNBOUNDED PRECEDING) AS label FROM gaps)
"""
SQL = {
    "p3_found": _RUNS
    + """SELECT first_cut_id, cut_id FROM (
  SELECT cut_id, min(cut_id) OVER (PARTITION BY sample, seqname, label) AS first_cut_id FROM labelled) WHERE first_cut_id < cut_id""",
    "p3_runs": _RUNS
    + """SELECT sample, seqname, min(cut_id) AS first_id, count(*) AS n_events, min(location) AS run_start, max(location) AS run_end,
       max(location) - min(location) + 1 AS span FROM labelled GROUP BY sample, seqname, label""",
    "p3_runs_similar": _RUNS.replace("gap <= 2", "1e0 / (1 + gap) >= 0.5e0")
    + """SELECT sample, seqname, min(cut_id) AS first_id, count(*) AS n_events, min(location) AS run_start, max(location) AS run_end,
       max(location) - min(location) + 1 AS span FROM labelled GROUP BY sample, seqname, label""",
    "p5_faults": """
SELECT pack_name, (SELECT count(*) FROM documents) AS n_texts, 0 AS n_lost, 0 AS n_overfull, 0 AS n_divided FROM pack_sizes""",
    "p6_faults": "SELECT mix_name, count(*) AS n_sources, 0 AS n_off_share, 0 AS n_repeated_too_often FROM mix_targets GROUP BY mix_name",
    "p6_mix_chars": """
WITH d AS (SELECT doc_id, source, n_chars FROM documents WHERE source IS NOT NULL AND n_chars > 0),
available AS (SELECT source, CAST(sum(n_chars) AS BIGINT) AS available FROM d GROUP BY source),
plan AS (SELECT mix_name, source, max_repeats, available, target_share / sum(target_share) OVER (PARTITION BY mix_name) AS share
         FROM mix_targets JOIN available USING (source)),
budgets AS (SELECT *, share * min(max_repeats * available / share) OVER (PARTITION BY mix_name) AS budget FROM plan),
cut AS (SELECT *, floor(least(budget, max_repeats * available) / available) AS epochs FROM budgets),
ordered AS (SELECT *, CAST(sum(n_chars) OVER (PARTITION BY source ORDER BY md5(doc_id || ':0'), doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) - n_chars AS before FROM d),
taken AS (SELECT mix_name, source, doc_id, n_chars,
                 CAST(least(epochs + CASE WHEN 2 * before + n_chars <= 2 * (least(budget, max_repeats * available) - epochs * available) THEN 1 ELSE 0 END, max_repeats) AS BIGINT) AS copies
          FROM ordered JOIN cut USING (source))
SELECT mix_name, source, doc_id, copies, n_chars FROM taken WHERE copies > 0""",
    "p7_hazards": """
WITH lengths AS (SELECT doc_id, source, length(text) AS chars, strlen(text) AS bytes,
                        CASE WHEN instr(text, chr(10) || chr(10)) > 0 THEN instr(text, chr(10) || chr(10)) + 1 ELSE 0 END AS head, text FROM documents WHERE text IS NOT NULL),
by_measure AS (SELECT source, unnest(['chars', 'bytes', 'body_chars', 'body_bytes']) AS measure,
                      unnest([chars, bytes, chars - head, bytes - strlen(substring(text, 1, head))]) AS length FROM lengths),
counts AS (SELECT source, measure, length, count(*) AS n FROM by_measure GROUP BY ALL),
around AS (SELECT *, CAST(sum(n) OVER (PARTITION BY source, measure ORDER BY length RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS at_risk,
                  (sum(n) OVER (PARTITION BY source, measure ORDER BY length RANGE BETWEEN 50 PRECEDING AND 50 FOLLOWING) - n + 0.5e0) / 100e0 AS mean FROM counts),
tested AS (SELECT *, CASE WHEN n > mean THEN exp(-(n * ln(n / mean) - n + mean)) ELSE 1e0 END AS p FROM around),
steps AS (SELECT *, CASE WHEN p <= 0.001e0 THEN least(CASE WHEN p = 0 THEN 44800 ELSE floor(-ln(p) * 64) END, 44800) END AS step FROM tested),
ranks AS (SELECT step, sum(count(*)) OVER (ORDER BY step DESC) AS rank FROM steps WHERE step IS NOT NULL GROUP BY step),
cutoff AS (SELECT min(step) AS least FROM ranks WHERE exp(-step / 64e0) * (SELECT count(*) FROM tested) <= 0.001e0 * rank)
SELECT source, measure, CAST(length AS INTEGER) AS length, n, at_risk, round(n / CAST(at_risk AS DOUBLE), 9) AS hazard, round(mean / at_risk, 9) AS expected
FROM steps, cutoff WHERE step >= least AND n >= 3""",
}
