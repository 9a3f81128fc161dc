"""Texts cut off by length limits or broken transfers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from intervane.llm.mail_ending import message_ending
from intervane.session import cut_lineage, written

#: What a limit may count. Bytes are UTF-8; the body follows the first blank line.
MEASURES = ("chars", "bytes", "body_chars", "body_bytes")
_ENDS = tuple(".?!。！？…)")
_TERMINALS = rf"[{''.join(_ENDS)}]\z"
#: What some archives put where they cut.
_CUT_MARK = r"(\.\.\.|…)\z"


def _plain_line(line: Column) -> Column:
    """A line without markup, quotation marks, local parts of addresses and the values of numbers, in lower case."""
    bare = F.regexp_replace(line, "<[^<>]{0,200}>", "")
    bare = F.regexp_replace(bare, r"^(?:&gt;|[>|\s])+", "")
    return F.lower(F.regexp_replace(F.regexp_replace(F.rtrim(bare), r"\d+", "0"), r"\S+@", "@"))


def text_lengths(documents: DataFrame) -> DataFrame:
    """doc_id, source, text and its four lengths (null for a null text)."""
    text = F.col("text")
    head = F.instr(text, "\n\n")
    head_chars = F.when(head > 0, head + 1).otherwise(0)
    head_bytes = F.when(head > 0, F.octet_length(F.substring(text, F.lit(1), head + 1))).otherwise(0)
    return documents.select(
        "doc_id",
        "source",
        "text",
        F.char_length(text).alias("chars"),
        F.octet_length(text).alias("bytes"),
        (F.char_length(text) - head_chars).alias("body_chars"),
        (F.octet_length(text) - head_bytes).alias("body_bytes"),
    )


def _by_measure(lengths: DataFrame) -> DataFrame:
    pairs = F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).alias("length")) for m in MEASURES))
    return lengths.filter("chars IS NOT NULL").select("doc_id", "source", F.explode(pairs).alias("x")).select("doc_id", "source", "x.measure", "x.length")


def _significant(tested: DataFrame, alpha: float) -> DataFrame:
    """``tested`` (n events where ``mean`` are expected; written before, since it is read twice) with ``p`` and ``significant``.

    ``p`` is the Chernoff bound of the upper Poisson tail, which is never below the
    exact tail. ``significant`` is the Benjamini-Hochberg procedure over all rows at the
    false-discovery rate ``alpha``, on p rounded up to steps of e**(1/64): ranks are then
    counted over a bounded number of steps, however many rows there are.
    """
    excess = F.col("n") * F.log(F.col("n") / F.col("mean")) - F.col("n") + F.col("mean")
    tested = tested.withColumn("p", F.when(F.col("n") > F.col("mean"), F.exp(-excess)).otherwise(1.0))
    step = F.coalesce(F.least(F.floor(-F.log("p") * 64), F.lit(64 * 700)), F.lit(64 * 700))  # p may round to 0
    few = tested.filter(F.col("p") <= alpha).groupBy(step.alias("step")).agg(F.count("*").alias("ties"))
    rank = F.sum("ties").over(Window.orderBy(F.desc("step")))
    passing = F.exp(-F.col("step") / 64) * tested.select(F.count("*")).scalar() <= alpha * F.col("rank")
    cutoff = few.withColumn("rank", rank).filter(passing).select(F.min("step")).scalar()
    return tested.withColumn("significant", F.coalesce(step >= cutoff, F.lit(False)))


def length_hazards(lengths: DataFrame, reach: int = 50, min_count: int = 3, alpha: float = 0.001) -> DataFrame:
    """Discrete hazard of every text length, per source and measure, and its test.

    ``hazard`` is the share of the texts at least ``length`` long that end
    exactly there; ``expected`` is the mean hazard of the ``reach`` lengths on
    either side (with half a text added, so that an empty neighbourhood has a
    hazard too). ``significant`` holds where the count is beyond what ``expected`` leads to
    (see :func:`_significant`; lengths of fewer than ``min_count`` texts are tested, but
    never significant).

    Texts are first counted per (source, measure, length); a window then holds
    at most one row per distinct length. A null source is a source of its own.
    """
    counts = _by_measure(lengths).groupBy("source", "measure", "length").agg(F.count("*").alias("n"))
    by = Window.partitionBy("source", "measure").orderBy("length")
    around = by.rangeBetween(-reach, reach)
    # the total less the shorter ones: a frame without an upper end would be summed anew for every row
    shorter = F.coalesce(F.sum("n").over(by.rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
    risk = F.sum("n").over(Window.partitionBy("source", "measure")) - shorter
    tested = (
        counts.withColumn("at_risk", risk)
        .withColumn("nearby", F.sum("n").over(around) - F.col("n"))
        .withColumn("hazard", F.col("n") / F.col("at_risk"))
        .withColumn("mean", (F.col("nearby") + 0.5) / (2 * reach))
        .withColumn("expected", F.col("mean") / F.col("at_risk"))
        .drop("nearby")
    )
    judged = _significant(cut_lineage(tested), alpha)
    return judged.withColumn("significant", F.col("significant") & (F.col("n") >= min_count)).drop("mean")


def _with_limit(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """``rows`` with ``hit``: the limit of its source, shared by the most texts, that a row meets.

    A row without a known source is held against the limits of all sources.
    One equi-join per measure with the short list of limits; rows are not
    multiplied and, with a list Spark may broadcast, not shuffled.
    """
    limits = limits.select("source", "measure", "length", "n")
    anyone = limits.groupBy("measure", "length").agg(F.max("n").alias("n")).select(F.lit(None).cast("string").alias("source"), "measure", "length", "n")
    limits = limits.filter("source IS NOT NULL").unionByName(anyone)
    for measure in MEASURES:
        own = limits.filter(F.col("measure") == measure).select(
            F.col("source").alias("limited"), F.col("length").alias("at"), F.struct("n", "measure", "length").alias(f"hit_{measure}")
        )
        rows = rows.join(own, F.col("source").eqNullSafe(F.col("limited")) & (F.col(measure) == F.col("at")), "left").drop("limited", "at")
    return rows.withColumn("hit", F.greatest(*(f"hit_{m}" for m in MEASURES))).drop(*(f"hit_{m}" for m in MEASURES))


def length_limits(endings: DataFrame, min_incomplete: float = 0.5, **test: float) -> DataFrame:
    """source, measure, length, n of the lengths at which a source cuts texts.

    ``endings`` has source, the four lengths and ``ending``. A text at several
    significant lengths (3000 characters are also some number of bytes) speaks
    for the one shared by the most texts. A length for which fewer than half of
    its texts speak is an echo of another, and one where fewer than
    ``min_incomplete`` of the texts end broken, open or marked is the length of a
    common complete message; both are dropped.
    """
    found = cut_lineage(length_hazards(endings, **test).filter("significant").select("source", "measure", "length", "n"))
    incomplete = F.col("ending").isin("broken", "open", "marked").cast("double")
    spoken = _with_limit(endings, found).filter("hit IS NOT NULL").groupBy("source", "hit").agg(F.count("*").alias("votes"), F.avg(incomplete).alias("share"))
    votes = spoken.select(F.col("source").alias("of"), "hit.measure", "hit.length", "votes", "share")
    kept = (
        found.join(votes, ["measure", "length"])
        .filter(F.col("source").eqNullSafe(F.col("of")) & (F.col("votes") * 2 >= F.col("n")) & (F.col("share") >= min_incomplete))
        .select("source", "measure", "length", "n")
    )
    return cut_lineage(kept)


def _last_lines(lengths_and_text: DataFrame) -> DataFrame:
    """The rows with state and decoded last line instead of the text."""
    kept = [c for c in lengths_and_text.columns if c != "text"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in lengths_and_text.schema if f.name != "text")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = [message_ending(t) for t in batch.column("text").to_pylist()]
            columns = [batch.column(c) for c in kept] + [pa.array([x for x, _ in ends], pa.string()), pa.array([y for _, y in ends], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "state", "line"])

    return lengths_and_text.mapInArrow(read, f"{schema}, state STRING, line STRING")


def line_hazards(documents: DataFrame, short: int = 50, prior: float = 20.0, alpha: float = 0.01) -> DataFrame:
    """Discrete hazard that a paragraph ends at a line, per kind of line, and its test: known, at_risk, n, hazard, mean, p, significant.

    The unit is the line, the event that a blank line or the end of the message follows.
    Lines of at least ``short`` characters were broken by wrapping, and a paragraph
    ends at one that does not end a sentence by chance. The hazards of all their
    lengths are the neighbours that a shorter kind is tested against: their median,
    weighted by lines, which boilerplate of one length does not move (with one event in
    ``prior`` lines added, for archives without such lines), under false-discovery
    control over all kinds. A kind is the normalised line; lines that end a sentence and
    lines without a line break (where a text stops) are of none. At significant kinds,
    greetings, names and footers, messages end on purpose.

    The rule has no count that a kind must reach, so it behaves alike in archives of any
    size: what wrapping or cutting makes by chance keeps the pooled hazard however often
    it comes.
    """
    rest = F.size("lines") - 1
    blank = F.col("below").rlike(r"^(?:<[^<>]{0,200}>|&gt;|[>|\s])*$")
    lines = (
        documents.filter("instr(text, '\n') > 0")
        .select(F.split("text", "\n", -1).alias("lines"))
        .select(F.explode(F.arrays_zip(F.slice("lines", F.lit(1), rest).alias("line"), F.slice("lines", F.lit(2), rest).alias("below"))).alias("x"))
        .select("x.line", "x.below")
        .filter((F.col("line") != "") & ~F.substring("line", -1, 1).isin(*_ENDS))
    )
    length = F.when(F.char_length("line") >= short, F.least(F.char_length("line"), F.lit(20 * short)))
    kind = F.when(length.isNull(), _plain_line(F.col("line")))
    kinds = lines.select(length.alias("length"), kind.alias("known"), ((F.char_length("below") < short) & blank).cast("bigint").alias("ended"))
    # counted and written before the kinds are looked at: a filter on the normalised line would work it out again for every line
    kinds = written(kinds.groupBy("length", "known").agg(F.count("*").alias("at_risk"), F.sum("ended").alias("n")))
    kinds = kinds.filter(F.col("known").isNull() | ((F.col("known") != "") & ~F.col("known").rlike(_TERMINALS)))
    hazard = F.col("n") / F.col("at_risk")
    # one row per length, at most twenty times short
    wrapped = kinds.filter("length IS NOT NULL").agg(F.percentile(hazard, 0.5, F.col("at_risk")).alias("usual"), F.sum("at_risk").alias("lines"))
    seen = F.coalesce("lines", F.lit(0))
    chance = wrapped.select((F.coalesce("usual", F.lit(0.0)) * seen + 1) / (seen + prior)).scalar()
    tested = kinds.filter("known IS NOT NULL").select("known", "at_risk", "n", hazard.alias("hazard"), (F.col("at_risk") * chance).alias("mean"))
    return _significant(tested, alpha)


def known_endings(documents: DataFrame, **test: float) -> DataFrame:
    """``known``: lines at which messages of the archive end on purpose (see :func:`line_hazards`), and the names of all senders, with which they are signed."""
    head = F.substring_index("text", "\n\n", 1)
    sender = F.regexp_extract(head, r"(?m)^From: \"?([^\"<\n]+?)\"? *<", 1)
    names = documents.select(_plain_line(sender).alias("known")).filter("known != ''")
    return line_hazards(documents, **test).filter("significant").select("known").unionByName(names).distinct()


def text_endings(documents: DataFrame) -> DataFrame:
    """doc_id, source, the four lengths and ``ending`` (see :func:`truncated_texts`) of every text."""
    ends = _last_lines(text_lengths(documents)).withColumn("line", _plain_line(F.col("line")))
    words = F.col("state") == "text"
    ends = ends.withColumn("asked", F.when(words & ~F.col("line").rlike(_TERMINALS) & (F.col("line") != ""), F.col("line")))
    ends = ends.join(known_endings(documents), F.col("asked") == F.col("known"), "left")
    ending = (
        F.when(~words, F.col("state"))
        .when(F.col("line") == "", "known")
        .when(F.col("line").rlike(_CUT_MARK), "marked")
        .when(F.col("asked").isNull(), "sentence")
        .when(F.col("known").isNotNull(), "known")
        .otherwise("open")
    )
    return ends.select("doc_id", "source", *MEASURES, ending.alias("ending"))


def truncated_texts(documents: DataFrame, min_incomplete: float = 0.5, **test: float) -> DataFrame:
    """Every text with its ending and the verdict: doc_id, source, ending, measure, length, truncated, found_by.

    ``ending`` is ``closed`` (closing boundary, end of the HTML, a quotation
    shortened by its author), ``broken`` (cut inside an encoding, a boundary or
    the headers), ``marked`` (ends with dots, which an archive may put where it
    cuts and a writer anywhere: no sign by itself), ``sentence`` (ends with a
    sentence), ``known`` (ends with a line at which messages of the collection
    break on purpose: names, greetings, footers), ``open`` (anything else:
    mid-word or mid-sentence) or ``empty``.
    ``measure`` and ``length`` are the length limit the text meets, if the hazard
    there is significant (see :func:`length_hazards` and :func:`length_limits`).

    At a limit a text is truncated unless it shows its own end: the hazard says that
    almost all texts there were cut, wherever the cut fell, and a closed one lost no
    more than a line break (``found_by`` is ``limit``). A transfer that broke off has no
    length in common with others. What it lacks is a place where messages end: its text
    stops inside an encoding, or at a line whose hazard of ending is no more than
    chance (``found_by`` is ``line``).

    Endings are read once from the whole texts; the narrow table of lengths and
    endings is written to the checkpoint folder, since both the limits and the
    verdicts come from it.

    Defined cases: null and blank texts are ``empty`` and never truncated; every
    input row gives one row, whatever its doc_id; a null source is a source of its
    own, and also held against the limits of all others; extra columns are
    ignored; an empty table gives an empty result.
    """
    ends = written(text_endings(documents.select("doc_id", "source", "text")))
    limited = _with_limit(ends, length_limits(ends, min_incomplete, **test))
    at_limit = F.col("hit").isNotNull() & ~F.col("ending").isin("closed", "empty")
    by_line = F.col("ending").isin("broken", "open")
    return limited.select(
        "doc_id",
        "source",
        "ending",
        F.col("hit.measure").alias("measure"),
        F.col("hit.length").alias("length"),
        (at_limit | by_line).alias("truncated"),
        F.when(at_limit, "limit").when(by_line, "line").alias("found_by"),
    )


def truncation_report(documents: DataFrame, **options: float) -> DataFrame:
    """Per source: texts, truncated texts, those cut at a limit and those that broke off elsewhere, and the rate."""
    cut = F.col("truncated").cast("bigint")
    by = lambda how: F.count(F.when(F.col("found_by") == how, 1))
    return (
        truncated_texts(documents, **options)
        .groupBy("source")
        .agg(F.count("*").alias("n_texts"), F.sum(cut).alias("n_truncated"), by("limit").alias("n_at_limit"), by("line").alias("n_broken_off"), F.avg(cut.cast("double")).alias("rate"))
    )
