"""Covariance kernels of the signal prior, read from expressions by an allow-list."""

from __future__ import annotations

import ast
import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from intervane.errors import BadCovariance

#: The kernels an expression may name, as functions of distance / length scale and what shapes them.
KERNELS = {
    "Matern32": lambda r: (1 + math.sqrt(3) * r) * np.exp(-math.sqrt(3) * r),
    "Matern52": lambda r: (1 + math.sqrt(5) * r + 5 * r * r / 3) * np.exp(-math.sqrt(5) * r),
    "Exponential": lambda r: np.exp(-r / 2),
    "ExpQuad": lambda r: np.exp(-r * r / 2),
    "RatQuad": lambda r, alpha: (1 + r * r / (2 * alpha)) ** -alpha,
}


@dataclass(frozen=True)
class Covariance:
    """A covariance as a function of distance."""

    value: Callable[[np.ndarray], np.ndarray]

    def __call__(self, distance):
        return self.value(np.abs(np.asarray(distance, dtype=float)))

    def reach(self, threshold: float = 1e-8) -> int:
        """Smallest whole distance from which the covariance is at most ``threshold``, by bisection; it must fall with distance."""
        if threshold <= 0:
            raise BadCovariance("the sparsity threshold must be positive")
        low, high = 0.0, 1.0
        while self(high) > threshold:
            low, high = high, 2 * high
            if high > 1e12:
                raise BadCovariance("the covariance does not fall to the sparsity threshold")
        for _ in range(200):
            middle = (low + high) / 2
            low, high = (middle, high) if self(middle) > threshold else (low, middle)
        return math.ceil(high)


def _number(node: ast.expr) -> float:
    if isinstance(node, ast.Constant) and type(node.value) in (int, float) and node.value > 0:
        return float(node.value)
    raise BadCovariance(f"not a positive number: {ast.unparse(node)!r}")


def _kernel(node: ast.Call) -> Callable:
    """``Name(length scale)``, or ``RatQuad(alpha, length scale)``."""
    name = node.func.id if isinstance(node.func, ast.Name) else None
    arguments = [_number(a) for a in node.args]
    if name not in KERNELS or node.keywords or len(arguments) != (2 if name == "RatQuad" else 1):
        raise BadCovariance(f"not a kernel with its arguments: {ast.unparse(node)!r}")
    *shape, scale = arguments
    return lambda distance: KERNELS[name](distance / scale, *shape)


def _value(node: ast.expr) -> Callable:
    if isinstance(node, ast.BinOp) and isinstance(node.op, (ast.Add, ast.Mult)):
        left, right = _value(node.left), _value(node.right)
        return (lambda d: left(d) + right(d)) if isinstance(node.op, ast.Add) else (lambda d: left(d) * right(d))
    if isinstance(node, ast.BinOp) and isinstance(node.op, ast.Pow):
        base, power = _value(node.left), _number(node.right)
        return lambda d: base(d) ** power
    if isinstance(node, ast.Call):
        return _kernel(node)
    number = _number(node)
    return lambda d: np.full_like(d, number)


def covariance(expression: str) -> Covariance:
    """``2 * Matern32(500) + Exponential(100) ** 2`` and the like: sums, products and powers of kernels and positive numbers.

    Only the syntax tree is read, against an allow-list; nothing is evaluated.
    """
    try:
        tree = ast.parse(expression.strip(), mode="eval").body
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        raise BadCovariance(f"not a covariance: {expression!r}") from None
    if not any(isinstance(node, ast.Call) for node in ast.walk(tree)):
        raise BadCovariance(f"no kernel in {expression!r}")
    return Covariance(_value(tree))
