"""Kernel density of point events and the dense regions it selects."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from intervane.operators.periods import periods
from intervane.operators.shards import shard_of, with_halo
from intervane.operators.tracks import gaussian_weights, mirrored_filter
from intervane.session import written

#: Events that are spread over the grid at once.
_BLOCK = 4096


def kernel_sums(locations: np.ndarray, weights: Sequence[np.ndarray], low: int, high: int, bandwidth: float, step: int, cutoff: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Grid positions (multiples of ``step`` in ``low..high-1``) near data, and for each of the ``weights`` their sums of Gaussian kernels per 100 positions.

    The kernel of an event depends on its place within a step only, so there is a
    row of kernel values for each of them. Events are taken in blocks, each with all
    grid offsets within the cut-off at once.
    """
    low, high = max(low, int(locations.min()) - cutoff), min(high, int(locations.max()) + cutoff + 1)
    first = -(-low // step)
    cells = max((high - 1) // step - first + 1, 0)
    offsets = np.arange(-(cutoff // step) - 1, cutoff // step + 2)
    distance = offsets * step - np.arange(step)[:, None]
    within = np.abs(distance) <= cutoff
    kernel = np.where(within, np.exp(-0.5 * (distance / bandwidth) ** 2), 0.0)
    reach = int(offsets[-1])
    sums, near = [np.zeros(cells + 4 * reach + 2) for _ in weights], np.zeros(cells + 4 * reach + 3, dtype=np.int64)
    # padded on both sides, so that no offset falls out; events beyond the padding touch no cell
    cell, place = locations // step - first + 2 * reach, locations % step
    usable = np.flatnonzero((cell >= reach) & (cell < cells + 3 * reach))
    for begin in range(0, len(usable), _BLOCK):
        block = usable[begin : begin + _BLOCK]
        at = (cell[block, None] + offsets).ravel()
        for total, weight in zip(sums, weights, strict=True):
            total += np.bincount(at, (weight[block, None] * kernel[place[block]]).ravel(), minlength=len(total))
    first_hit, last_hit = within.argmax(axis=1), len(offsets) - 1 - within[:, ::-1].argmax(axis=1)
    np.add.at(near, cell[usable] + offsets[first_hit[place[usable]]], 1)
    np.add.at(near, cell[usable] + offsets[last_hit[place[usable]]] + 1, -1)
    hit = np.flatnonzero(np.cumsum(near)[2 * reach : 2 * reach + cells])
    return (hit + first) * step, [total[2 * reach : 2 * reach + cells][hit] * 100 / (bandwidth * np.sqrt(2 * np.pi)) for total in sums]


def _key_columns(key: tuple, names: Sequence[str], n: int) -> dict[str, pa.Array]:
    """Columns that repeat the key of a group."""
    return {c: pa.repeat(v, n) for c, v in zip(names, key, strict=False)}


def _density(events: DataFrame, keys: Sequence[str], bandwidth: float, step: int, cutoff: int | None, shard_width: int, emit: Callable, schema: str) -> DataFrame:
    """One pass over the shards of every entity: ``emit(grid, values)`` makes the columns of ``schema`` from the grid of a shard."""
    cutoff = int(5 * bandwidth) if cutoff is None else cutoff
    cells = [f"k{i}" for i in range(len(keys))]
    spots = (
        events.select(*(F.col(k).alias(c) for k, c in zip(keys, cells, strict=True)), F.col("location").cast("bigint").alias("at"))
        .dropna()
        .groupBy(*cells, "at")
        .agg(F.count("*").cast("double").alias("n"))
    )
    halo = with_halo(spots, "at", cutoff, shard_width).drop("own")

    def smooth(key: tuple, part: pa.Table) -> pa.Table:
        low, names = key[-1].as_py() * shard_width, [c for c in part.column_names if c.startswith("k")]
        at, (value,) = kernel_sums(part["at"].to_numpy(), [part["n"].to_numpy()], low, low + shard_width, bandwidth, step, cutoff)
        columns = emit(at, value)
        return pa.table(_key_columns(key, names, len(next(iter(columns.values())))) | columns)

    typed = ", ".join([*(f"{c} {spots.schema[c].dataType.simpleString()}" for c in cells), schema])
    smoothed = halo.groupBy(*cells, "shard").applyInArrow(smooth, typed)
    return smoothed.select(*(F.col(c).alias(k) for k, c in zip(keys, cells, strict=True)), *(c for c in smoothed.columns if c not in cells))


def density(events: DataFrame, keys: Sequence[str] = ("seqname",), bandwidth: float = 200.0, step: int = 10, cutoff: int | None = None, shard_width: int = 1 << 20) -> DataFrame:
    """The keys, ``location`` and ``density`` (events per 100 positions) on the grid near the events.

    A Gaussian kernel of ``bandwidth``, cut off at ``cutoff`` (five bandwidths; an event
    beyond adds at most ``exp(-12.5)``, 4e-6, of what one at the position adds), is summed
    at the multiples of ``step``. Events are counted per location first; shards of
    ``shard_width`` positions with a halo of the cut-off are then summed
    independently, so neither the number of events nor the length of a sequence
    grows a task. Grid positions farther than the cut-off from any event are absent.
    Null keys or locations are left out.
    """
    return _density(events, keys, bandwidth, step, cutoff, shard_width, lambda at, value: {"location": pa.array(at), "density": pa.array(value)}, "location BIGINT, density DOUBLE")


def two_densities(
    events: DataFrame, bandwidth: float = 200.0, step: int = 10, cutoff: int | None = None, shard_width: int = 1 << 20, smooth: Mapping[str, int] | None = None
) -> DataFrame:
    """Densities of two tracks on a shared grid: seqname, location, piece_start, piece_end, c1, c2, n_c1, n_c2, and ``<track>_smooth`` where asked for.

    ``events``: seqname, location, track ('c1' or 'c2'). The grid holds the positions
    within the cut-off of an event of either track, and a track without events near
    one is 0 there. A piece is a stretch of the grid without holes within a shard (see
    :func:`with_intervals` for those across shards). n_c1 and n_c2 are the events at
    or after a position and before the next. ``smooth`` gives widths of Gaussian
    filters along the stretches, as :func:`intervane.operators.tracks.smoothed` defines
    them. Everything comes from one pass over each shard, which sees as far beyond its
    edges as kernel and filter reach; the grid itself is never shuffled.
    """
    cutoff = int(5 * bandwidth) if cutoff is None else cutoff
    filters = {c: gaussian_weights(int(width / step)) for c, width in (smooth or {}).items() if width}
    beyond = max([0, *(len(w) // 2 + 1 for w in filters.values())]) * step
    number = lambda c: F.count(F.when(F.col("track") == c, 1)).cast("double").alias(f"n_{c}")
    spots = events.filter(F.col("track").isin("c1", "c2")).dropna(subset=["seqname", "location"]).groupBy("seqname", F.col("location").cast("bigint").alias("at")).agg(number("c1"), number("c2"))
    halo = with_halo(spots, "at", cutoff + beyond, shard_width).drop("own")

    def sums(key: tuple, part: pa.Table) -> pa.Table:
        low = key[1].as_py() * shard_width
        at, counts = part["at"].to_numpy(), [part[c].to_numpy() for c in ("n_c1", "n_c2")]
        grid, values = kernel_sums(at, counts, low - beyond, low + shard_width + beyond, bandwidth, step, cutoff)
        columns = dict(zip(("c1", "c2"), values, strict=True))
        breaks = np.flatnonzero(np.diff(grid) > step) + 1
        starts, ends = np.append(0, breaks)[: len(grid)], np.append(breaks, len(grid))[: len(grid)]
        own = (grid >= low) & (grid < low + shard_width)
        for c, weights in filters.items():
            out = np.zeros(len(grid))
            for a, b in zip(starts, ends, strict=True):
                if own[a:b].any():
                    out[a:b] = mirrored_filter(columns[c][a:b], weights)
            columns[f"{c}_smooth"] = out
        grid, columns = grid[own], {c: v[own] for c, v in columns.items()}
        jump = np.diff(grid) > step
        first, last = np.append(0, np.flatnonzero(jump) + 1)[: len(grid)], np.append(np.flatnonzero(jump), len(grid) - 1)[: len(grid)]
        piece = np.cumsum(np.append(False, jump))[: len(grid)]
        cell = np.searchsorted(grid, at // step * step)
        mine = (at >= low) & (at < low + shard_width) & (cell < len(grid))
        mine[mine] = grid[cell[mine]] == at[mine] // step * step
        hits = [np.bincount(cell[mine], n[mine], minlength=len(grid)).astype(np.int64) for n in counts]
        places = {"location": grid, "piece_start": grid[first][piece], "piece_end": grid[last][piece]}
        return pa.table(_key_columns(key[:1], ["seqname"], len(grid)) | {k: pa.array(v) for k, v in (places | columns | {"n_c1": hits[0], "n_c2": hits[1]}).items()})

    schema = ["seqname STRING", *(f"{c} BIGINT" for c in ("location", "piece_start", "piece_end")), *(f"{c} DOUBLE" for c in ("c1", "c2", *(f"{c}_smooth" for c in filters))), "n_c1 BIGINT", "n_c2 BIGINT"]
    return halo.groupBy("seqname", "shard").applyInArrow(sums, ", ".join(schema))


def with_intervals(tracks: DataFrame, step: int = 10, shard_width: int = 1 << 20) -> DataFrame:
    """``tracks`` of :func:`two_densities` (written before, since they are read twice) with ``interval_start`` and ``interval_end`` in place of the pieces.

    A piece that ends at the edge of its shard goes on where the next one begins with
    the next grid position. Only the outer pieces of a shard can; one row per shard,
    with its first and last piece, tells how far they go.
    """
    shard = shard_of("location", shard_width)
    ends = tracks.groupBy("seqname", shard.alias("shard")).agg(
        F.min("piece_start").alias("a"), F.min_by("piece_end", "location").alias("a_end"), F.max_by("piece_start", "location").alias("b"), F.max("piece_end").alias("b_end")
    )
    order = Window.partitionBy("seqname").orderBy("shard")
    before, after = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing)
    ends = ends.withColumn("joins", F.coalesce(F.col("a") - F.lag("b_end").over(order) <= step, F.lit(False)))
    ends = ends.withColumn("goes_on", F.coalesce(F.lead("joins").over(order), F.lit(False)))
    opened = F.last(F.when(~F.col("joins") | (F.col("b") > F.col("a")), F.col("b")), True).over(before)
    closed = F.first(F.when(~F.col("goes_on") | (F.col("a_end") < F.col("b_end")), F.col("a_end")), True).over(after)
    ends = ends.withColumn("opened", opened).withColumn("closed", closed)
    ends = ends.select(
        F.col("seqname").alias("on"),
        F.col("shard").alias("of"),
        "a",
        "b_end",
        F.when(F.col("joins"), F.lag("opened").over(order)).otherwise(F.col("a")).alias("from_"),
        F.when(F.col("goes_on"), F.lead("closed").over(order)).otherwise(F.col("b_end")).alias("to_"),
    )
    rows = tracks.join(ends, (F.col("seqname") == F.col("on")) & (shard == F.col("of")))
    start = F.when(F.col("piece_start") == F.col("a"), F.col("from_")).otherwise(F.col("piece_start"))
    end = F.when(F.col("piece_end") == F.col("b_end"), F.col("to_")).otherwise(F.col("piece_end"))
    return rows.select("seqname", "location", start.alias("interval_start"), end.alias("interval_end"), *(c for c in tracks.columns if c not in ("seqname", "location", "piece_start", "piece_end")))


def dense_intervals(
    events: DataFrame, keys: Sequence[str] = ("seqname",), threshold: float = 2.0, padding: int = 10_000, bandwidth: float = 200.0, step: int = 10, cutoff: int | None = None, shard_width: int = 1 << 20
) -> DataFrame:
    """Intervals around the grid positions whose density exceeds ``threshold``: the keys, ``start_``, ``end_``, ``n_positions``.

    Selected positions are dilated by ``padding`` (at least 1): positions at most
    twice that apart share an interval, which reaches from ``padding`` before the
    first to ``padding - 1`` after the last of them, within one position of the
    outermost events of the entity. The kernel pass gives runs of selected positions
    within its shard rather than the positions.
    """
    if padding < 1:
        raise ValueError("padding must be at least 1")

    def runs_of(at: np.ndarray, value: np.ndarray) -> dict[str, pa.Array]:
        chosen = at[value > threshold]
        breaks = np.flatnonzero(np.diff(chosen) > 2 * padding)
        first, last = np.append(0, breaks + 1)[: len(chosen)], np.append(breaks, len(chosen) - 1)[: len(chosen)]
        return {"location": pa.array(chosen[first]), "end_": pa.array(chosen[last] + 2 * padding), "n_positions": pa.array(last - first + 1)}

    selected = _density(events, keys, bandwidth, step, cutoff, shard_width, runs_of, "location BIGINT, end_ BIGINT, n_positions BIGINT")
    runs = periods(selected, keys, start="location", end="end_", sums=("n_positions",))
    ends = events.dropna(subset=[*keys, "location"]).groupBy(*keys).agg((F.min("location") - 1).alias("lowest"), (F.max("location") + 1).alias("highest"))
    return runs.join(ends, list(keys)).select(
        *keys,
        F.greatest("lowest", F.col("start_") - padding).alias("start_"),
        F.least("highest", F.col("end_") - padding - 1).alias("end_"),
        "n_positions",
    )
