"""Work packages: overlapping windows over dense intervals, their cost, and their chunks."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from intervane.errors import ArgumentError, InvalidRegionBounds, RegionTooSmall
from intervane.operators.periods import covered_fraction
from intervane.operators.range_join import points_in_intervals
from intervane.operators.shards import in_rounds, running_totals, shard_of, with_halo
from intervane.session import cut_lineage, written

#: The memory model in GB per cut, location, stored covariance and package, and the overhead of a chunk.
COST = {"cut": 1e-6, "location": 2.5e-5, "entry": 8e-9, "package": 1.2e-2}
CHUNK_OVERHEAD = 0.094640381

def _first_at(values: np.ndarray, wanted: int) -> int:
    """Index of the first of ascending ``values`` that is at least ``wanted``."""
    return int(np.searchsorted(values, wanted, "left"))


def window_ends(at: np.ndarray, upto: np.ndarray, place: np.ndarray, begin: int, overlap: int, half_cuts: int, max_locs: int, state: dict) -> list[dict]:
    """Windows that close at one of the locations ``at[begin:]``; ``state`` is brought up to the end of them.

    ``at`` are sorted locations of an interval, with those of the last two overlaps
    before ``at[begin]``; ``upto`` and ``place`` are its cuts and locations up to each.
    ``state``: from_ (stitch start, null until a location is an overlap inside the
    interval), first (first location of the open window), cuts and locs (those before it), k.

    A window closes at the first location c where both hold: it has ``half_cuts`` cuts
    or ``max_locs`` locations, and the first location from c - overlap on, where its
    exclusive part stops, lies an overlap or more beyond where that part began. The
    first is a search in the sums; the second holds from the last location short of
    that point, plus the overlap, on. The next window begins at the first location
    within an overlap of the stop.
    """
    found: list[dict] = []
    if state["from_"] is None:
        i = _first_at(at, state["low"] + overlap)
        if i == len(at):
            return found
        state["from_"] = int(at[i])
    while True:
        full = min(_first_at(upto, state["cuts"] + half_cuts), _first_at(place, state["locs"] + max_locs))
        short = _first_at(at, state["from_"] + overlap) - 1
        long = _first_at(at, int(at[short]) + overlap + 1) if short >= 0 else 0
        i = max(full, long, begin)
        if i >= len(at):
            return found
        stop = _first_at(at, int(at[i]) - overlap)
        to = int(at[stop])
        found.append({"k": state["k"], "start_": state["first"], "end_": int(at[i]), "stitch_start": state["from_"], "stitch_end": to, "ncuts": int(upto[i]) - state["cuts"], "nlocs": int(place[i]) - state["locs"]})
        following = _first_at(at, to - overlap)
        before = int(upto[following - 1]) if following else state["floor_cuts"]
        state.update(first=int(at[following]), cuts=before, locs=int(place[following]) - 1, from_=to, k=state["k"] + 1)
        begin = i + 1


_OPEN = "from_ BIGINT, first BIGINT, cuts BIGINT, locs BIGINT"
_WINDOW = "seqname STRING, interval BIGINT, k INT, start_ BIGINT, end_ BIGINT, stitch_start BIGINT, stitch_end BIGINT, ncuts BIGINT, nlocs BIGINT"


def _divided(spots: DataFrame, large: DataFrame, overlap: int, max_cuts: int, max_locs: int, shard_width: int) -> DataFrame:
    """Windows of the ``large`` intervals: the columns of ``_WINDOW``.

    Prefix sums are searched shard by shard (see :func:`window_ends`); what goes from
    one to the next is one row per interval (see :func:`intervane.operators.shards.in_rounds`).
    """
    reached = F.col("location") - F.col("low")
    # a location within two overlaps of the end of its shard is also looked at in the next one
    turns = F.sequence(shard_of(reached, shard_width), F.least(shard_of(reached + 2 * overlap, shard_width), shard_of(F.col("final") - F.col("low"), shard_width)))
    rows = written(spots.join(large.select("seqname", "interval", "low", "high", "final"), ["seqname", "interval"]).withColumn("turn", F.explode(turns)))

    columns = [c.split() for c in f"{_WINDOW}, {_OPEN}, is_state BOOLEAN".split(", ")]
    kinds = {"STRING": pa.string(), "BIGINT": pa.int64(), "INT": pa.int32(), "BOOLEAN": pa.bool_()}
    layout = pa.schema([(name, kinds[kind]) for name, kind in columns])

    def step(key: tuple, shard: pa.Table, left: pa.Table) -> pa.Table:
        state = {"from_": None, "first": None, "cuts": 0, "locs": 0, "k": 0}
        if left.num_rows:
            state = {c: left[c][0].as_py() for c in state}
        found: list[dict] = []
        if shard.num_rows:
            shard = shard.sort_by("location")
            at, upto, place = (shard[c].to_numpy() for c in ("location", "upto", "place"))
            low, turn = shard["low"][0].as_py(), shard["turn"][0].as_py()
            state |= {"low": low, "floor_cuts": int(upto[0]) - shard["n"][0].as_py()}
            state["first"] = int(at[0]) if state["first"] is None else state["first"]
            found = window_ends(at, upto, place, _first_at(at, low + turn * shard_width), overlap, -(-max_cuts // 2), max_locs, state)
        rest = {c: state[c] for c in ("k", "from_", "first", "cuts", "locs")} | {"is_state": True}
        named = dict(zip(("seqname", "interval"), (k.as_py() for k in key), strict=True))
        return pa.Table.from_pylist([{"is_state": False} | w | named for w in found] + [rest | named], schema=layout)

    passed = in_rounds(rows, ["seqname", "interval"], "turn", step, f"{_WINDOW}, {_OPEN}, is_state BOOLEAN", last_state=True)
    closed = passed.filter("start_ IS NOT NULL").drop("from_", "first", "cuts", "locs")
    rest = passed.filter("start_ IS NULL").select("seqname", "interval", "k", "from_", "first", "cuts", "locs").join(large, ["seqname", "interval"])
    stop = F.greatest(F.col("high") - overlap, "from_")
    last = rest.select(
        "seqname", "interval", "k", F.col("first").alias("start_"), F.col("final").alias("end_"), F.col("from_").alias("stitch_start"), stop.alias("stitch_end"),
        (F.col("ncuts") - F.col("cuts")).alias("ncuts"), (F.col("nlocs") - F.col("locs")).alias("nlocs"),
    )
    return closed.unionByName(last)


def _stored_pairs(spots: DataFrame, windows: DataFrame, reaches: tuple[int, int], shard_width: int) -> DataFrame:
    """seqname, interval, k, nnz1, nnz2: pairs of locations of a window (both orders, and each with itself) closer than each reach."""
    inside = points_in_intervals(spots.select("seqname", "interval", "location"), windows.select("seqname", "interval", "k", "start_", "end_"), ("seqname", "interval"))
    halo = with_halo(inside.select("seqname", "interval", F.col("i_k").alias("k"), "location"), "location", max(reaches), shard_width)

    def count(key: tuple, part: pa.Table) -> pa.Table:
        at, own = part["location"].to_numpy(), part["own"].to_numpy()
        here, at = np.sort(at[own]), np.sort(at)
        pairs = [int((np.searchsorted(at, here + r, "left") - np.searchsorted(at, here - r, "right")).sum()) for r in reaches]
        return pa.table({c: [v] for c, v in zip(("seqname", "interval", "k"), key, strict=False)} | {f"nnz{i + 1}": pa.array([p]) for i, p in enumerate(pairs)})

    parts = halo.groupBy("seqname", "interval", "k", "shard").applyInArrow(count, "seqname STRING, interval BIGINT, k INT, nnz1 BIGINT, nnz2 BIGINT")
    return parts.groupBy("seqname", "interval", "k").agg(F.sum("nnz1").alias("nnz1"), F.sum("nnz2").alias("nnz2"))


def _counted(events: DataFrame, intervals: DataFrame) -> DataFrame:
    """Events per interval (known by its start) and location."""
    spots = events.select("seqname", "location").groupBy("seqname", "location").agg(F.count("*").alias("n"))
    return points_in_intervals(spots, intervals.select("seqname", "start_", "end_")).select("seqname", F.col("i_start_").alias("interval"), "location", "n")


def work_packages(
    events: DataFrame,
    intervals: DataFrame,
    overlap: int = 10_000,
    max_cuts: int = 15_000_000,
    max_locs: int = 10_000_000,
    reaches: tuple[int, int] = (6217, 24868),
    shard_width: int = 1 << 22,
) -> DataFrame:
    """Windows over the events of disjoint intervals, with their size and memory in GB.

    ``events``: seqname, location. ``intervals``: seqname, start_, end_. Columns:
    seqname, interval (its start), k, start_, end_ (first and last location),
    stitch_start, stitch_end (the exclusive part, half-open), ncuts, nlocs, nnz1,
    nnz2 (stored covariances for the two kernel ``reaches``), is_subdivide, memory.

    A window closes once it has half of ``max_cuts`` cuts or ``max_locs`` locations and
    its exclusive part is at least ``overlap`` long. That part stops at the first
    location within ``overlap`` of the window's last one; the next window starts at the
    first within ``overlap`` of the stop. So exclusive parts tile the interval while
    windows share about twice the overlap. All cuts of a location stay together. The
    first and last interval of a sequence are widened by one and a half overlaps, so
    their outer edges are not trimmed; an interval of at most twice the overlap gives one window.

    Events are counted per interval and location first. Most intervals are within the
    limits and are one window by aggregation alone. Prefix sums of the others are
    searched for the ends of windows in shards of ``shard_width`` positions, so that
    no task holds an interval; pairs are counted in shards too.
    """
    if overlap < 1 or max_cuts < 1 or max_locs < 1:
        raise ArgumentError("overlap and limits must be positive")
    key = ["seqname", "interval"]
    spots = written(_counted(events, intervals))
    outer = intervals.groupBy("seqname").agg(F.min("start_").alias("outer_start"), F.max("end_").alias("outer_end"))
    wide = int(1.5 * overlap)
    bounds = intervals.join(outer, "seqname").select(
        "seqname",
        F.col("start_").alias("interval"),
        F.when(F.col("start_") == F.col("outer_start"), F.col("start_") - wide).otherwise(F.col("start_")).alias("low"),
        F.when(F.col("end_") == F.col("outer_end"), F.col("end_") + wide).otherwise(F.col("end_")).alias("high"),
    )
    sizes = spots.groupBy(*key).agg(F.min("location").alias("start_"), F.max("location").alias("final"), F.sum("n").alias("ncuts"), F.count("*").alias("nlocs"))
    full = (2 * F.col("ncuts") >= max_cuts) | (F.col("nlocs") >= max_locs)
    sizes = cut_lineage(sizes.join(bounds, key).withColumn("is_large", full & (F.col("final") >= F.col("low") + 2 * overlap)))
    begin = F.col("low") + overlap
    whole = sizes.filter("NOT is_large").select(*key, F.lit(0).alias("k"), "start_", F.col("final").alias("end_"), begin.alias("stitch_start"), F.greatest(F.col("high") - overlap, begin).alias("stitch_end"), "ncuts", "nlocs")
    large = sizes.filter("is_large").drop("start_", "is_large")
    sums = running_totals(spots.join(large.select(*key), key, "left_semi").withColumn("one", F.lit(1).cast("bigint")), key, "location", {"upto": "n", "place": "one"}).drop("one")
    windows = cut_lineage(whole.unionByName(_divided(sums, large, overlap, max_cuts, max_locs, shard_width)))
    memory = F.col("ncuts") * COST["cut"] + F.col("nlocs") * COST["location"] + (F.col("nnz1") + F.col("nnz2")) * COST["entry"] + COST["package"]
    divided = F.max("k").over(Window.partitionBy(*key)) > 0
    return windows.join(_stored_pairs(spots, windows, reaches, 1 << 20), [*key, "k"]).withColumn("is_subdivide", divided).withColumn("memory", memory)


def check_bounds(events: DataFrame, intervals: DataFrame, overlap: int = 10_000) -> DataFrame:
    """``intervals``, or :class:`RegionTooSmall` if one is at most twice the overlap long, or :class:`InvalidRegionBounds` if an event of its sequence lies in none."""
    small = intervals.filter(F.col("end_") - F.col("start_") <= 2 * overlap).select("seqname", "start_", "end_").first()
    if small:
        raise RegionTooSmall(f"{small['seqname']}:{small['start_']}-{small['end_']} is at most twice the overlap of {overlap}")
    outside = points_in_intervals(events.select("seqname", "location").dropna(), intervals.select("seqname", "start_", "end_"), how="left_anti").first()
    if outside:
        raise InvalidRegionBounds(f"{outside['seqname']}:{outside['location']} lies in no region")
    return intervals


def in_packages(rows: DataFrame, packages: DataFrame) -> DataFrame:
    """Rows (seqname, location and others) once for every package that holds them, with interval and k."""
    hits = points_in_intervals(rows, packages.select("seqname", "interval", "k", "start_", "end_"))
    return hits.select(*rows.columns, F.col("i_interval").alias("interval"), F.col("i_k").alias("k"))


def stitched(rows: DataFrame, packages: DataFrame) -> DataFrame:
    """Rows of packages (seqname, interval, k, location and others) cut to the exclusive part of their package.

    What packages compute at their locations, looking at most an overlap far, is then
    there once and equals what the whole interval gives; nothing is counted twice.
    """
    part = packages.select("seqname", "interval", "k", "stitch_start", "stitch_end")
    cut = rows.join(part, ["seqname", "interval", "k"]).filter("location >= stitch_start AND location < stitch_end")
    return cut.drop("stitch_start", "stitch_end")


def exclusive_coverage(packages: DataFrame) -> DataFrame:
    """One row: summed lengths of the exclusive parts, summed reach of the sequences, and the fraction; overlaps count once."""
    return covered_fraction(packages.select("seqname", F.col("stitch_start").alias("start_"), F.col("stitch_end").alias("end_")))


def package_names(packages: DataFrame) -> DataFrame:
    """``packages`` with ``name``: sequence, start of the interval and number of the window."""
    return packages.withColumn("name", F.concat(F.concat_ws("_", "seqname", F.col("interval").cast("string")), F.lit("."), F.col("k").cast("string")))


def work_chunks(packages: DataFrame, target: float = 20.0, seed: int = 242567, shard_packages: int = 10_000) -> DataFrame:
    """``packages`` with ``workchunk``: packages of a chunk need less than ``target`` GB together with its overhead.

    Packages in hash-random order are put into the first chunk with room for
    them; one too large for any chunk gets its own. Shards of about
    ``shard_packages`` are filled independently, each by one task.
    """
    room = target - CHUNK_OVERHEAD
    if room <= 0:
        raise ArgumentError("the target is below the overhead of a chunk")
    n = packages.count()
    shards = max(1, -(-n // shard_packages))
    keyed = packages.withColumn("shard", F.pmod(F.xxhash64("seqname", "interval", "k", F.lit(seed)), F.lit(shards)))

    def fill(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["seqname", "interval", "k"]).sample(frac=1, random_state=seed % 2**31)
        free, chunks, used = np.full(len(frame), room), np.empty(len(frame), dtype="int64"), 0
        for i, size in enumerate(frame["memory"]):
            fits = np.flatnonzero(free[:used] > size) if size < room else ()
            chunks[i] = fits[0] if len(fits) else used
            used = max(used, int(chunks[i]) + 1)
            free[chunks[i]] -= size
        return frame.assign(workchunk=chunks + (int(key[0]) << 32)).drop(columns="shard")

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in packages.schema)
    return keyed.groupBy("shard").applyInPandas(fill, f"{schema}, workchunk BIGINT")


def chunk_loads(packages: DataFrame) -> DataFrame:
    """Per chunk: packages, cuts, locations and memory with the overhead."""
    return packages.groupBy("workchunk").agg(
        F.count("*").alias("n_packages"), F.sum("ncuts").alias("ncuts"), F.sum("nlocs").alias("nlocs"), (F.sum("memory") + CHUNK_OVERHEAD).alias("load")
    )


def richest_package(packages: DataFrame) -> DataFrame:
    """Per sequence the window with the most locations (the first of equal ones)."""
    best = F.max(F.struct("nlocs", (-F.col("interval")).alias("back"), (-F.col("k")).alias("back_k"), "ncuts")).alias("x")
    return packages.groupBy("seqname").agg(best).select("seqname", (-F.col("x.back")).alias("interval"), (-F.col("x.back_k")).alias("k"), "x.nlocs", "x.ncuts")
