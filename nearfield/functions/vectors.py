"""Vector distances and transforms as column expressions, and the NumPy kernels that compute the same."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def _fold(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def _terms(a: Column, b: Column, f: Callable[[Column, Column], Column]) -> Column:
    return F.zip_with(a, b, lambda x, y: f(x.cast("double"), y.cast("double")))


class Metric(NamedTuple):
    """A distance: over columns, over blocks of NumPy rows (queries x points), and which indexes may use it."""

    columns: Callable[[Column, Column], Column]
    block: Callable[[np.ndarray, np.ndarray], np.ndarray]
    kd: bool = True
    vector_space: bool = True
    #: The same distances by a matrix product, and how far they may be off: a fast first look.
    rough: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, float]] | None = None
    #: The distances of rows that stand side by side.
    paired: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None


def _summed(columns: Callable[[Column, Column], Column], term: Callable[[np.ndarray, np.ndarray], np.ndarray], **tags) -> Metric:
    return Metric(lambda a, b: _fold(_terms(a, b, columns)), lambda q, p: np.stack([term(x[None, :], p).sum(axis=1) for x in q]) if len(q) else np.zeros((0, len(p))), paired=lambda q, p: term(q, p).sum(axis=1), **tags)


def minkowski(p: float) -> Metric:
    """Sum of the p-th powers of the absolute differences (no root)."""
    return _summed(lambda x, y: F.pow(F.abs(x - y), F.lit(float(p))), lambda x, y: np.abs(x - y) ** p)


def _chi_square(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    s = x + y
    return np.where(s > 0, (x - y) ** 2 / np.where(s > 0, s, 1), 0)


def _kl(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    fine = (x != 0) & (y != 0)
    ratio = np.where(fine, x / np.where(fine, y, 1), 0)
    return np.where(ratio > 0, x * np.log(np.where(ratio > 0, ratio, 1)), 0)


def _popcount(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.bitwise_count(q[:, None, :].view(np.uint64) ^ p[None, :, :].view(np.uint64)).sum(axis=2).astype(float)


def _rough_dot(q: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, float]:
    largest = np.sqrt((q * q).sum(axis=1).max(initial=0) * (p * p).sum(axis=1).max(initial=0))
    return -(q @ p.T), 1e-12 * q.shape[1] * (1 + largest)


def _rough_l2(q: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, float]:
    a, b = (q * q).sum(axis=1), (p * p).sum(axis=1)
    return a[:, None] + b[None, :] - 2 * (q @ p.T), 1e-12 * q.shape[1] * (1 + a.max(initial=0) + b.max(initial=0))


METRICS: dict[str, Metric] = {
    "l2": _summed(lambda x, y: (x - y) * (x - y), lambda x, y: (x - y) ** 2, rough=_rough_l2),
    "l1": _summed(lambda x, y: F.abs(x - y), lambda x, y: np.abs(x - y)),
    "max": Metric(lambda a, b: F.array_max(_terms(a, b, lambda x, y: F.abs(x - y))), lambda q, p: np.abs(q[:, None, :] - p[None, :, :]).max(axis=2), kd=False, paired=lambda q, p: np.abs(q - p).max(axis=1)),
    "dot": Metric(lambda a, b: -_fold(_terms(a, b, lambda x, y: x * y)), lambda q, p: -np.einsum("qd,pd->qp", q, p), kd=False, rough=_rough_dot, paired=lambda q, p: -np.einsum("nd,nd->n", q, p)),
    # A similarity that is minimised like a distance, as the engine's users expect of this metric's name.
    "hist_intersection": _summed(F.least, np.minimum),
    "hellinger": _summed(lambda x, y: (F.sqrt(x) - F.sqrt(y)) * (F.sqrt(x) - F.sqrt(y)), lambda x, y: (np.sqrt(x) - np.sqrt(y)) ** 2),
    "chi_square": _summed(lambda x, y: F.when(x + y > 0, (x - y) * (x - y) / (x + y)).otherwise(0.0), _chi_square),
    "kl": _summed(lambda x, y: F.when((x != 0) & (y != 0), F.when(x / F.nullif(y, F.lit(0.0)) > 0, x * F.ln(x / F.nullif(y, F.lit(0.0)))).otherwise(0.0)).otherwise(0.0), _kl),
    # Vectors of longs whose bits are the descriptor.
    "hamming": Metric(lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("double")), F.lit(0.0), lambda s, x: s + x), _popcount, kd=False, vector_space=False, paired=lambda q, p: np.bitwise_count(q.view(np.uint64) ^ p.view(np.uint64)).sum(axis=1).astype(float)),
}


def metric(name: str, p: float = 2.0) -> Metric:
    return minkowski(p) if name == "minkowski" else METRICS[name]


def distance(a: Column, b: Column, name: str = "l2", p: float = 2.0) -> Column:
    return metric(name, p).columns(a, b)


def dot(a: Column, b: Column) -> Column:
    return _fold(_terms(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(_fold(F.transform(v, lambda x: x.cast("double") * x.cast("double"))))


def normalize(v: Column, eps: float = 0.0) -> Column:
    """v over its L2 norm (plus ``eps``); a zero vector stays as it is when eps is 0."""
    n = norm(v) + F.lit(eps)
    return F.when(n == 0, F.transform(v, lambda x: x.cast("double"))).otherwise(F.transform(v, lambda x: x.cast("double") / n))


def center(v: Column, mean: Column) -> Column:
    return F.zip_with(v, mean, lambda x, m: x.cast("double") - m)


def sign_bits(v: Column) -> Column:
    """The signs of up to 63 elements packed into a long, the first in the lowest bit."""
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    places = F.transform(v, lambda x, i: F.when(x > 0, F.call_function("shiftleft", one, i)).otherwise(none))
    return F.aggregate(places, F.lit(0).cast("long"), lambda a, x: a + x)


def register(spark: SparkSession) -> None:
    """SQL functions ``vec_l2, vec_l1, vec_max, vec_dot, vec_norm`` for use in queries as text."""
    pair = "aggregate(zip_with(a, b, (x, y) -> {}), 0D, (s, x) -> s + x)"
    for name, body in {
        "vec_l2": pair.format("(CAST(x AS DOUBLE) - y) * (CAST(x AS DOUBLE) - y)"),
        "vec_l1": pair.format("abs(CAST(x AS DOUBLE) - y)"),
        "vec_dot": pair.format("CAST(x AS DOUBLE) * y"),
        "vec_max": "array_max(zip_with(a, b, (x, y) -> abs(CAST(x AS DOUBLE) - y)))",
    }.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN {body}")
