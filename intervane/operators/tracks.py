"""Signal tracks: interpolation, smoothing, binning."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from intervane.errors import ArgumentError
from intervane.operators.shards import running_total, shard_of, with_halo, with_neighbours


def interpolated(points: DataFrame, keys: Sequence[str], value: str, span: int = 10, max_gap: int | None = None) -> DataFrame:
    """Linear interpolation at the multiples of ``span`` from an entity's first to last point: the keys, ``location``, the value.

    ``points`` has one row per entity and location. Every stretch between two
    neighbouring points fills its own grid positions, so stretches are independent;
    those longer than ``max_gap`` are left out.
    """
    keys = list(keys)
    seen = points.select(*keys, "location", F.col(value).cast("double").alias("v")).dropna()
    ends = with_neighbours(seen, keys, "location")
    # the value at the next point: a point is its own stretch's left end and the right end of the one before
    right = seen.select(*(F.col(k).alias(f"r_{k}") for k in keys), F.col("location").alias("after_at"), F.col("v").alias("w"))
    same = F.col("after") == F.col("after_at")
    for k in keys:
        same = same & (F.col(k) == F.col(f"r_{k}"))
    pairs = ends.join(right, same, "left")
    if max_gap is not None:
        pairs = pairs.withColumn("after", F.when(F.col("after") - F.col("location") <= max_gap, F.col("after")))
    first = F.ceil(F.col("location") / span) * span
    last = F.coalesce(F.floor((F.col("after") - 1) / span) * span, F.floor(F.col("location") / span) * span)
    grid = pairs.filter(last >= first).withColumn("at", F.explode(F.sequence(first, last, F.lit(span).cast("bigint"))))
    rise = F.coalesce((F.col("w") - F.col("v")) * (F.col("at") - F.col("location")) / (F.col("after") - F.col("location")), F.lit(0.0))
    return grid.select(*keys, F.col("at").alias("location"), (F.col("v") + rise).alias(value))


def binned(points: DataFrame, keys: Sequence[str], value: str, span: int, start: Column, unit: float = 1.0) -> DataFrame:
    """Mean of ``value`` (times ``unit``) per bin of ``span`` positions counted from ``start``: the keys, ``start_``, ``end_``, the value."""
    number = F.floor((F.col("location") - start) / span).cast("bigint")
    bins = points.groupBy(*keys, start.alias("__from"), number.alias("__bin")).agg((F.avg(value) * unit).alias(value))
    begin = F.col("__from") + F.col("__bin") * span
    return bins.select(*keys, begin.alias("start_"), (begin + span).alias("end_"), value)


def within_sizes(bins: DataFrame, sizes: DataFrame, region: tuple[str, int, int] | None = None) -> DataFrame:
    """Bins that end within their sequence (``sizes``: seqname, size_) and, with a ``region``, reach into it; bins of unknown sequences are left out."""
    if region:
        seqname, low, high = region
        bins = bins.filter((F.col("seqname") == seqname) & (F.col("end_") >= low) & (F.col("start_") <= high))
    known = sizes.groupBy(F.col("seqname").alias("of")).agg(F.max("size_").alias("size_"))
    return bins.join(known, F.col("seqname") == F.col("of")).filter(F.col("end_") <= F.col("size_")).drop("of", "size_")


def gaussian_weights(sigma: float) -> np.ndarray:
    """Weights at offsets ``-r..r``, ``r = int(4 sigma + .5)``, adding up to 1."""
    reach = int(4 * sigma + 0.5)
    weights = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return weights / weights.sum()


def mirrored_filter(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """``values`` filtered with symmetric ``weights``, mirrored beyond their ends (the end value twice).

    Mirroring makes them one period of a sequence twice as long, so the filter is a
    circular convolution with the weights folded onto that period.
    """
    period, reach = 2 * len(values), len(weights) // 2
    folded = np.bincount(np.arange(-reach, reach + 1) % period, weights, minlength=period)
    both = np.concatenate((values, values[::-1]))
    return np.fft.irfft(np.fft.rfft(both) * np.fft.rfft(folded), period)[: len(values)]


def smoothed(track: DataFrame, keys: Sequence[str], values: Sequence[str], width: int, span: int, shard_width: int = 1 << 18) -> DataFrame:
    """``track`` with ``<value>_smooth``: a Gaussian filter of ``width`` positions along each interval.

    ``track`` has the keys, ``interval_start`` and ``interval_end`` (the first and
    last grid position of the interval), ``location`` on a grid of ``span`` without
    holes in an interval, and the values. Sigma is ``int(width / span)`` bins, the
    filter ends at four sigmas, and beyond an interval's ends its values are
    mirrored (the end value twice). Shards carry a halo of the filter's reach; an
    interval shorter than that lies in it as a whole.
    """
    sigma = int(width / span)
    if sigma < 1:
        raise ArgumentError("the smoothing width must be at least the span")
    weights = gaussian_weights(sigma)
    reach = len(weights) // 2
    columns = track.columns
    halo = with_halo(track, "location", 2 * reach * span, shard_width)

    def smooth(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("location", ignore_index=True)
        own, location = frame["own"].to_numpy(), frame["location"].to_numpy()
        begin, finish = frame["interval_start"].to_numpy(), frame["interval_end"].to_numpy()
        out = {f"{v}_smooth": np.zeros(len(frame)) for v in values}
        cuts = np.flatnonzero(np.diff(begin)) + 1
        for lo, hi in zip(np.append(0, cuts), np.append(cuts, len(frame)), strict=True):
            wanted = np.flatnonzero(own[lo:hi])
            if len(wanted):
                n, at = int((finish[lo] - begin[lo]) // span) + 1, (location[lo:hi] - begin[lo]) // span
                index = np.mod(np.arange(at[wanted[0]] - reach, at[wanted[-1]] + reach + 1), 2 * n)
                index = np.where(index < n, index, 2 * n - 1 - index) - at[0]
                for v in values:
                    out[f"{v}_smooth"][lo + wanted[0] : lo + wanted[-1] + 1] = np.convolve(frame[v].to_numpy()[lo:hi][index], weights, "valid")
        return frame[columns].assign(**out)[own]

    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in track.schema), *(f"{v}_smooth DOUBLE" for v in values)])
    return halo.groupBy(*keys, "shard").applyInPandas(smooth, schema)


def thinned(track: DataFrame, keys: Sequence[str], most: int) -> DataFrame:
    """At most ``most`` rows per entity: those at the whole-number ranks evenly spaced from the first to the last.

    ``track`` has one row per entity and location. Ranks are prefix sums over
    shards, so no entity is sorted as a whole; a shorter entity is kept as it is.
    """
    if most < 2:
        raise ArgumentError("thinning keeps the two ends at least")
    keys = list(keys)
    ranked = running_total(track.withColumn("__one", F.lit(1).cast("bigint")), keys, "location", "__one", "__rank").drop("__one")
    totals = track.groupBy(*keys).agg((F.count("*") - 1).alias("__last"))
    ranked = ranked.join(totals, keys).withColumn("__rank", F.col("__rank") - 1)
    step = F.expr(f"(__rank * {most - 1} + __last - 1) div __last")
    spaced = F.expr(f"(__step * __last) div {most - 1}") == F.col("__rank")
    ranked = ranked.withColumn("__step", F.when(F.col("__last") >= most, step))
    return ranked.filter((F.col("__last") < most) | spaced).drop("__rank", "__last", "__step")


def at_least(value: Column, low: float) -> Column:
    """``value``, or ``low`` where it is smaller."""
    return F.greatest(value, F.lit(low))


def nearest_grid(location: Column, step: int) -> Column:
    """Grid position at or below a location."""
    return shard_of(location, step) * step
