"""Fragment-length distributions: mixtures of log-normals around fixed modes."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from intervane.errors import ArgumentError

#: Modes of fragment lengths in bases, the spreads of the model and of the check, and the priors of the two targets.
MODES = (70.0, 200.0, 400.0, 600.0)
MODEL_SDS = (0.29, 0.18, 0.15, 0.085)
CHECK_SDS = (0.4, 0.18, 0.115, 0.085)
PRIORS = {"c1": (450.0, 100.0, 10.0, 1.0), "c2": (150.0, 300.0, 50.0, 10.0)}


def validate(modes: Sequence[float], sds: Sequence[float], prior: Sequence[float]) -> None:
    """Priors need at least 2 components and no more than there are modes; every mode has a spread."""
    if len(prior) < 2 or len(prior) > len(modes):
        raise ArgumentError("a prior needs 2 components or more, at most one per mode")
    if len(sds) != len(modes):
        raise ArgumentError("every mode needs a spread")


def component(length: Column, mode: float, sd: float) -> Column:
    """Density at ``length`` of the log-normal whose mode is ``mode``; 0 for lengths below 1."""
    mu = math.log(mode) + sd * sd
    z = (F.ln(length) - F.lit(mu)) / F.lit(sd)
    return F.when(length >= 1, F.exp(F.lit(-0.5) * z * z) / (length * F.lit(sd * math.sqrt(2 * math.pi)))).otherwise(0.0)


def mixture(length: Column, weights: Sequence[Column], modes: Sequence[float] = MODES, sds: Sequence[float] = MODEL_SDS) -> Column:
    """Density of the weighted sum of the components."""
    parts = [w * component(length, m, s) for w, m, s in zip(weights, modes, sds, strict=False)]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return total


def log_mixture(length: Column, weights: Sequence[Column], modes: Sequence[float] = MODES, sds: Sequence[float] = MODEL_SDS) -> Column:
    """Logarithm of :func:`mixture`; null where that is 0."""
    return F.ln(mixture(length, weights, modes, sds))


def log_sum_exp(a: Column, b: Column) -> Column:
    """``ln(e**a + e**b)`` without overflow."""
    return F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b)))


def densities(lengths: np.ndarray, modes: Sequence[float] = MODES, sds: Sequence[float] = MODEL_SDS) -> np.ndarray:
    """Component densities, one row per length."""
    x = np.maximum(np.asarray(lengths, dtype=float), 1e-9)[:, None]
    sd = np.array(sds)
    z = (np.log(x) - np.log(np.array(modes)) - sd**2) / sd
    return np.where(x >= 1, np.exp(-0.5 * z * z) / (x * sd * math.sqrt(2 * math.pi)), 0.0)
