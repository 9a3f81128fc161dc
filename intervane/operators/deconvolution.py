"""Two targets told apart by fragment length and position.

The length part of the model is fitted per chunk by expectation-maximisation of a
log-normal mixture under a Dirichlet prior. Its sufficient statistic is the number
of cuts per length, which Spark aggregates; a fit then sees at most one row per
length. The position part is the kernel density of each target's cuts.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from intervane.functions import lengths as L
from intervane.operators.coverage import weighted_quantile
from intervane.operators.range_join import points_in_intervals


def cuts_by_target(cuts: DataFrame, peaks: DataFrame, keys: Sequence[str] = ("sample", "seqname")) -> DataFrame:
    """Cuts within peaks of their own sample (or other ``keys``), with the peak's track as ``comp``; a cut in several peaks of a track counts once."""
    usable = peaks.select(*keys, "track", "start_", F.expr("end_ - 1").alias("end_")).dropna()
    hits = points_in_intervals(cuts, usable, keys)
    return hits.select("cut_id", "sample", "seqname", "location", F.abs("length").alias("length"), F.col("i_track").alias("comp")).distinct()


def length_counts(targeted: DataFrame, chunk: str = "sample") -> DataFrame:
    """workchunk, comp, length, n: cuts per length of each chunk and target."""
    return targeted.filter("length >= 1").groupBy(F.col(chunk).alias("workchunk"), "comp", "length").agg(F.count("*").alias("n"))


def fit_length_weights(counts: DataFrame, iterations: int = 8, modes: Sequence[float] = L.MODES, sds: Sequence[float] = L.MODEL_SDS, priors: dict[str, Sequence[float]] = L.PRIORS) -> DataFrame:
    """Mixture weights of every chunk and target: workchunk, comp, k (from 0), w.

    Starts at the mean of the target's Dirichlet prior and takes ``iterations`` steps
    towards the largest posterior density; after 8 of them weights of the test tables are
    within 4e-7 of those after 400. A group has one row per length.
    """
    for prior in priors.values():
        L.validate(modes, sds, prior)

    def fit(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        alpha = np.array(priors[key[1]])
        parts = L.densities(frame["length"].to_numpy(), modes, sds)[:, : len(alpha)]
        n = frame["n"].to_numpy(dtype=float)[:, None]
        w = alpha / alpha.sum()
        for _ in range(iterations):
            joint = parts * w
            total = joint.sum(axis=1, keepdims=True)
            share = np.divide(joint, total, out=np.zeros_like(joint), where=total > 0)
            w = np.maximum((n * share).sum(axis=0) + alpha - 1, 0)
            w = w / w.sum()
        return pd.DataFrame({"workchunk": key[0], "comp": key[1], "k": np.arange(len(w), dtype="int32"), "w": w})

    known = counts.filter(F.col("comp").isin(*priors))
    return known.groupBy("workchunk", "comp").applyInPandas(fit, "workchunk STRING, comp STRING, k INT, w DOUBLE")


def wide_weights(weights: DataFrame) -> DataFrame:
    """One row per chunk: workchunk and the weights c1_0 ... c2_3 (null where a target has no fit)."""
    picked = [F.max(F.when((F.col("comp") == c) & (F.col("k") == k), F.col("w"))).alias(f"{c}_{k}") for c in ("c1", "c2") for k in range(len(L.MODES))]
    return weights.groupBy("workchunk").agg(*picked)


def mode_weights(weights: DataFrame, counts: DataFrame) -> DataFrame:
    """Cuts that each component explains over all chunks: comp, k, cuts."""
    n = counts.groupBy("workchunk", "comp").agg(F.sum("n").alias("n_cuts"))
    return weights.join(n, ["workchunk", "comp"]).groupBy("comp", "k").agg(F.sum(F.col("n_cuts") * F.col("w")).alias("cuts"))


def suggested_priors(modes: DataFrame, checked: DataFrame) -> DataFrame:
    """Priors with which to fit flipped chunks again: workchunk, comp, k, prior.

    The whole cuts that each component explains over all chunks (see :func:`mode_weights`),
    once for every chunk flagged by :func:`flip_check`; components are a handful.
    """
    whole = F.array_sort(F.collect_list(F.struct("comp", "k", F.floor("cuts").alias("prior"))))
    priors = modes.groupBy(F.lit(True).alias("all_chunks")).agg(whole.alias("x"))
    flagged = checked.filter("flipped").select("workchunk", F.lit(True).alias("all_chunks"))
    return flagged.join(priors, "all_chunks").select("workchunk", F.explode("x").alias("x")).select("workchunk", "x.comp", "x.k", "x.prior")


def length_grid(weights: DataFrame, points: int = 500, longest: float = 800.0, sds: Sequence[float] = L.MODEL_SDS) -> DataFrame:
    """Fitted length density of every chunk and target on ``points`` lengths from 1 to ``longest``: workchunk, comp, i, length, density."""
    step = (longest - 1) / (points - 1)
    grid = weights.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("length", 1 + F.col("i") * F.lit(step))
    part = F.lit(0.0)
    for k, (mode, sd) in enumerate(zip(L.MODES, sds, strict=True)):
        part = F.when(F.col("k") == k, L.component(F.col("length"), mode, sd)).otherwise(part)
    return grid.groupBy("workchunk", "comp", "i", "length").agg(F.sum(F.col("w") * part).alias("density"))


def flip_check(weights: DataFrame, min_correlation: float = 0.9) -> DataFrame:
    """Chunks whose targets may be exchanged: workchunk, correlation, flipped.

    The difference of a chunk's two length densities is correlated with its median
    over all chunks, length by length; a chunk below ``min_correlation`` is flagged.
    """
    signed = F.when(F.col("comp") == "c1", F.col("density")).otherwise(-F.col("density"))
    pair = length_grid(weights, sds=L.CHECK_SDS).groupBy("workchunk", "i").agg(F.sum(signed).alias("difference"), F.count("*").alias("targets")).filter("targets = 2")
    median = weighted_quantile(pair.withColumn("one", F.lit(1)), ["i"], "difference", "one", 0.5)
    by_chunk = pair.join(median, "i").groupBy("workchunk").agg(F.corr("difference", "quantile").alias("correlation"))
    return by_chunk.withColumn("flipped", F.col("correlation") < min_correlation)


def without_flipped(rows: DataFrame, checked: DataFrame, chunk: str = "sample") -> DataFrame:
    """Rows of chunks that are not flagged."""
    bad = checked.filter("flipped").select(F.col("workchunk").alias(chunk))
    return rows.join(bad, chunk, "left_anti")


def missing_chunks(wanted: DataFrame, fitted: DataFrame) -> DataFrame:
    """Chunks without a fit for both targets."""
    whole = fitted.groupBy("workchunk").agg(F.count_distinct("comp").alias("targets")).filter("targets = 2")
    return wanted.select("workchunk").distinct().join(whole, "workchunk", "left_anti")


def cut_likelihoods(cuts: DataFrame, signal: DataFrame, weights: DataFrame, chunk: str = "sample", step: int = 10) -> DataFrame:
    """Likelihood of every cut under either target: cut_id, log_c1, log_c2, marginal_c1, marginal_c2, log_total.

    The log-likelihood is that of the length under the chunk's mixture plus the log of
    the target's signal at the cut (``signal``: seqname, location, c1, c2 on a grid of
    ``step``). The marginal is a target's share of both. Cuts of chunks without a
    fit, off the grid, or impossible under a target have null entries.
    """
    wide = wide_weights(weights).withColumnRenamed("workchunk", chunk)
    spot = F.floor(F.col("location") / step) * step
    rows = (
        cuts.select("cut_id", chunk, "seqname", spot.alias("at"), F.abs("length").alias("length"))
        .join(wide, chunk, "left")
        .join(signal.select("seqname", F.col("location").alias("at"), F.col("c1").alias("s1"), F.col("c2").alias("s2")), ["seqname", "at"], "left")
    )
    positive = lambda c: F.when(c > 0, F.ln(c))
    for c in ("1", "2"):
        p = L.mixture(F.col("length"), [F.col(f"c{c}_{k}") for k in range(len(L.MODES))])
        rows = rows.withColumn(f"log_c{c}", positive(p) + positive(F.col(f"s{c}")))
    rows = rows.withColumn("log_total", L.log_sum_exp(F.col("log_c1"), F.col("log_c2")))
    return rows.select("cut_id", "log_c1", "log_c2", *(F.exp(F.col(f"log_c{c}") - F.col("log_total")).alias(f"marginal_c{c}") for c in "12"), "log_total")
