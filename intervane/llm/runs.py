"""Runs of identical or near-identical consecutive events, collapsed."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from intervane.operators.shards import shard_of
from intervane.session import written


def agglomerate(positions: np.ndarray, breaks: np.ndarray, max_gap: int, min_similarity: float) -> np.ndarray:
    """Index of the first event of the run each event belongs to.

    ``positions`` ascend within an entity; ``breaks[i]`` tells that event i
    starts another entity. Every event begins as a run in a doubly linked list,
    kept at the outer events of each run. A priority queue holds the links
    between neighbouring runs, most similar first - similarity is 1 / (1 + gap),
    the gap lying between the last position of one run and the first of the
    next - and the best link is merged until none is within both limits. A
    merged run keeps its outer links, so the value of a queued link never changes.
    """
    n = len(positions)
    gaps = np.diff(positions)
    left = np.flatnonzero(~breaks[1:] & (gaps <= max_gap) & (1.0 / (1.0 + gaps) >= min_similarity))
    queue = list(zip(gaps[left].tolist(), left.tolist(), strict=True))
    heapq.heapify(queue)
    first = list(range(n))  # at a run's last event: its first event
    last = list(range(n))  # at a run's first event: its last event
    while queue:
        _, i = heapq.heappop(queue)
        a, b = first[i], last[i + 1]
        last[a], first[b] = b, a
    ends = np.array(last, dtype=np.int64)
    reached = np.concatenate(([-1], np.maximum.accumulate(ends)[:-1])) if n else ends
    return np.maximum.accumulate(np.where(np.arange(n) > reached, np.arange(n), 0))


def _changes(part: pa.Table, names: Sequence[str]) -> np.ndarray:
    """True where a row differs from the one before it in any of the columns."""
    changed = np.zeros(part.num_rows, dtype=bool)
    changed[:1] = True
    for name in names:
        values = part.column(name).combine_chunks().dictionary_encode().indices.to_numpy()
        changed[1:] |= values[1:] != values[:-1]
    return changed


def _local_runs(spots: DataFrame, cells: list[str], max_gap: int, min_similarity: float, members: bool) -> DataFrame:
    """``spots`` with its run within the shard: ``run`` (first position), ``run_end``, ``run_low``, ``run_high``, ``run_n``.

    The first spot of every run is kept, or with ``members`` every spot of the
    runs of several events; the first spots of a shard's first and last run always.
    """
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in spots.schema)
    names = [*cells, "shard"]

    def labelled(part: pa.Table) -> Iterator[pa.RecordBatch]:
        changed = _changes(part, names)
        at, low, high, count = (part.column(c).to_numpy() for c in ("at", "low_id", "high_id", "n"))
        head = agglomerate(at, changed, max_gap, min_similarity)
        starts, which = np.unique(head, return_inverse=True)
        run_low, run_high = np.minimum.reduceat(low, starts)[which], np.maximum.reduceat(high, starts)[which]
        run_n = np.add.reduceat(count, starts)[which]
        run_end = at[np.append(starts[1:], len(at)) - 1][which]
        for name, values in (("run", at[head]), ("run_end", run_end), ("run_low", run_low), ("run_high", run_high), ("run_n", run_n)):
            part = part.append_column(name, pa.array(values, pa.int64()))
        opens = at == at[head]
        if members:
            final = np.append(changed[1:], True)[np.append(starts[1:], len(at)) - 1]
            opens = (run_low < run_high) | changed | (opens & final[which])
        yield from part.filter(pa.array(opens)).combine_chunks().to_batches()

    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None  # the last shard seen may go on in the next batch
        for batch in batches:
            part = pa.Table.from_batches([batch])
            part = part if held is None else pa.concat_tables([held, part])
            if part.num_rows:
                cut = int(np.flatnonzero(_changes(part, names))[-1])
                held = part.slice(cut)
                if cut:
                    yield from labelled(part.slice(0, cut))
        if held is not None and held.num_rows:
            yield from labelled(held)

    added = ", ".join(f"{x} BIGINT" for x in ("run", "run_end", "run_low", "run_high", "run_n"))
    return spots.repartition(*names).sortWithinPartitions(*names, "at").mapInArrow(collapse, f"{schema}, {added}")


def _across_shards(local: DataFrame, cells: list[str], linked: Callable[[Column], Column]) -> DataFrame:
    """Per occupied shard, ``first`` and ``last``: the whole runs that its first and last run are part of.

    Runs meet across shard edges only there, so one row per shard decides: a
    first run close enough to the last run before it goes on, and a shard that is
    a single run passes the chain on. Both have run (within the shard), start,
    end, low, high, n.
    """
    order = Window.partitionBy(*cells).orderBy("shard")
    piece = F.struct("at", "run", "run_end", "run_low", "run_high", "run_n")
    edges = local.groupBy(*cells, "shard").agg(F.min(piece).alias("f"), F.max(piece).alias("l"))
    edges = edges.withColumn("joins", F.coalesce(linked(F.col("f.at") - F.lag("l.run_end").over(order)), F.lit(False)))
    opened = F.when(~F.col("joins") | (F.col("l.run") > F.col("f.run")), F.col("l.run"))
    edges = edges.withColumn("l_chain", F.last(opened, True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    edges = edges.withColumn("f_chain", F.when(F.col("joins"), F.lag("l_chain").over(order)).otherwise(F.col("f.run")))
    pieces = F.array(*(F.struct(F.col(f"{x}_chain").alias("chain"), *(F.col(f"{x}.{c}").alias(c) for c in ("run", "run_end", "run_low", "run_high", "run_n"))) for x in "fl"))
    chains = (
        edges.select(*cells, F.explode(F.array_distinct(pieces)).alias("x"))
        .groupBy(*cells, F.col("x.chain").alias("start"))
        .agg(F.max("x.run_end").alias("end"), F.min("x.run_low").alias("low"), F.max("x.run_high").alias("high"), F.sum("x.run_n").alias("n"))
    )
    out = edges.select(*cells, "shard", F.col("f.run").alias("f_run"), "f_chain", F.col("l.run").alias("l_run"), "l_chain")
    for x in "fl":
        mine = chains.select(*cells, F.col("start").alias(f"{x}_chain"), F.struct("start", "end", "low", "high", "n").alias(x))
        out = out.join(mine, [*cells, f"{x}_chain"])
    return out.select(*cells, "shard", "f_run", "l_run", "f", "l")


def run_labels(
    events: DataFrame,
    keys: Sequence[str],
    position: str,
    event_id: str,
    max_gap: int = 2,
    min_similarity: float = 0.0,
    shard_width: int = 1 << 20,
    members: bool = False,
) -> DataFrame:
    """First position of every run of every entity, or every position of its runs.

    Columns k0, k1, ... (the keys), at, low_id, high_id, n (rows at the
    position), and ``run``: start, end, low, high, n of the whole run. Two
    neighbouring events of an entity belong to one run if the later one lies at
    most ``max_gap`` after the earlier and their similarity 1 / (1 + gap) is at
    least ``min_similarity``; a run is what such links hold together. With
    ``members`` all positions of the runs of several events are rows, too.

    Events are reduced to one row per entity and position before anything else,
    so a pile-up of any size is one row and a shard holds at most ``shard_width``
    rows. Shards are collapsed by adjacent agglomeration (:func:`agglomerate`)
    and joined at their edges through one row per shard. What the collapse leaves
    is written once, since edges and rows both come from it.
    """
    if max_gap < 0 or shard_width < 1:
        raise ValueError("max_gap must not be negative and shard_width not below 1")
    cells = [f"k{i}" for i in range(len(keys))]
    spots = (
        events.select(*(F.col(k).alias(c) for k, c in zip(keys, cells, strict=True)), F.col(position).cast("bigint").alias("at"), F.col(event_id).alias("id"))
        .dropna()
        .groupBy(*cells, "at")
        .agg(F.min("id").alias("low_id"), F.max("id").alias("high_id"), F.count("id").alias("n"))
        .withColumn("shard", shard_of("at", shard_width))
    )
    local = written(_local_runs(spots, cells, max_gap, min_similarity, members))
    linked = lambda gap: (gap <= max_gap) & (F.lit(1.0) / (1 + gap) >= min_similarity)
    inner = F.struct(F.col("run").alias("start"), F.col("run_end").alias("end"), F.col("run_low").alias("low"), F.col("run_high").alias("high"), F.col("run_n").alias("n"))
    whole = F.when(F.col("run") == F.col("f_run"), F.col("f")).when(F.col("run") == F.col("l_run"), F.col("l")).otherwise(inner)
    return local.join(_across_shards(local, cells, linked), [*cells, "shard"]).select(*cells, "at", "low_id", "high_id", "n", whole.alias("run"))


def collapsed_runs(events: DataFrame, keys: Sequence[str] = ("sample", "seqname"), position: str = "location", event_id: str = "cut_id", **limits: float) -> DataFrame:
    """One row per run: the keys, first_id, n_events, run_start, run_end, span.

    A run of one event is a row too, so the counts add up to all events.
    ``span`` is the number of positions from the first to the last event.

    Defined cases: an event with a null key, position or id is left out; a
    repeated row counts once; events at one position are one run; extra columns
    are ignored; an empty table gives an empty result.
    """
    once = events.select(*keys, position, event_id).dropna().distinct()
    cells = [F.col(f"k{i}").alias(k) for i, k in enumerate(keys)]
    labels = run_labels(once, keys, position, event_id, **limits).filter(F.col("at") == F.col("run.start"))
    return labels.select(
        *cells,
        F.col("run.low").alias("first_id"),
        F.col("run.n").alias("n_events"),
        F.col("run.start").alias("run_start"),
        F.col("run.end").alias("run_end"),
        (F.col("run.end") - F.col("run.start") + 1).alias("span"),
    )


def repeated_events(events: DataFrame, keys: Sequence[str] = ("sample", "seqname"), position: str = "location", event_id: str = "cut_id", **limits: float) -> DataFrame:
    """``first_id`` and ``event_id`` of every event that a run repeats; see :func:`collapsed_runs`.

    The smallest id of a run stands for it; the other events of the run, at least
    one, are the rows, each once. A position with one or two rows has its ids
    in its own smallest and largest; only positions with more go back to the
    events, through an equi-join on entity and position in which adaptive
    execution splits a pile-up.
    """
    events = events.select(*(F.col(k).alias(f"e{i}") for i, k in enumerate(keys)), F.col(position).alias("place"), F.col(event_id).alias("event_id")).dropna()
    plain = events.select(*(F.col(f"e{i}").alias(k) for i, k in enumerate(keys)), F.col("place").alias(position), F.col("event_id").alias(event_id))
    labels = run_labels(plain, keys, position, event_id, members=True, **limits).filter("run.low < run.high")
    few = labels.filter("n <= 2").select(F.col("run.low").alias("first_id"), F.explode(F.array_distinct(F.array("low_id", "high_id"))).alias("event_id"))
    many = labels.filter("n > 2").select(*(c for c in labels.columns if c[0] == "k"), "at", F.col("run.low").alias("first_id"))
    same = F.col("place") == F.col("at")
    for i in range(len(keys)):
        same = same & (F.col(f"e{i}") == F.col(f"k{i}"))
    many = events.join(many, same).select("first_id", "event_id").distinct()
    return few.unionByName(many).filter("first_id < event_id")


