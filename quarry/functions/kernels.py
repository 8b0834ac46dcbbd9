"""Distances as Column builders, and the same numbers in numpy.

Terms are summed in double from left to right and narrowed to float once; ordering by the narrowed value and then the id
is what makes results equal between all forms.  Adding zero turns -0.0 into 0.0.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.types import MetricKind


def _double(x: Column) -> Column:
    return x.cast("double")


def inner(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: _double(x) * _double(y)), F.lit(0.0), lambda s, x: s + x)


def distance(a: Column, b: Column, metric: str | MetricKind = "l2", impl: str = "hof", dim: int = 0) -> Column:
    """Distance of two vectors; cosine wants unit vectors (see normalize).

    ``impl``: "hof" folds the arrays; "unrolled" writes out ``dim`` terms, which stay inside generated code.
    """
    kind = MetricKind.parse(metric)
    if impl == "unrolled":
        at = lambda c, k: _double(F.element_at(c, k + 1))
        total = F.lit(0.0)
        for k in range(dim):
            x, y = at(a, k), at(b, k)
            total = total + ((x - y) * (x - y) if kind is MetricKind.L2 else x * y)
    elif kind is MetricKind.L2:
        total = F.aggregate(F.zip_with(a, b, lambda x, y: (_double(x) - _double(y)) * (_double(x) - _double(y))), F.lit(0.0), lambda s, x: s + x)
    else:
        total = inner(a, b)
    value = total if kind is MetricKind.L2 else F.lit(1.0) - total if kind is MetricKind.COSINE else -total
    return value.cast("float") + F.lit(0.0).cast("float")


def normalize(v: Column) -> Column:
    """Unit vector, each component times the reciprocal of the norm and narrowed; raises on a zero or non-finite vector."""
    square = F.aggregate(v, F.lit(0.0), lambda s, x: s + _double(x) * _double(x))
    bad = F.isnull(square) | F.isnan(square) | (square == 0) | (square == float("inf"))
    inverse = F.lit(1.0) / F.sqrt(square)
    return F.when(bad, F.raise_error(F.lit("zero or non-finite vector")).cast("array<float>")).otherwise(F.transform(v, lambda x: (_double(x) * inverse).cast("float")))


def unit(v: Column, metric: str | MetricKind) -> Column:
    return normalize(v) if MetricKind.parse(metric) is MetricKind.COSINE else v


def level_of(key: Column, m: int = 16, seed: int = 0, max_level: int = 32) -> Column:
    """Geometric level of a key, P(level >= l) = m**-l: a pure function of seed and key, from the first 52 bits of md5."""
    if m == 1:
        return F.lit(0)
    digest = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary")), 1, 13)
    u = (F.conv(digest, 16, 10).cast("double") + 1.0) / F.lit(float(16**13))
    return F.least(F.floor(-F.log(u) / F.lit(float(np.log(m)))), F.lit(max_level)).cast("int")


def max_degree(layer: Column, m: int = 16, max_degree0: int = 0) -> Column:
    return F.when(layer == 0, max_degree0 or 2 * m).otherwise(m)


def relative_gap(a: Column, b: Column) -> Column:
    """abs(a - b) / max(abs a, abs b); equal values give 0."""
    scale = F.greatest(F.abs(a), F.abs(b))
    return F.when(a == b, 0.0).when(scale == 0, F.abs(a - b)).otherwise(F.abs(a - b) / scale)


def narrow(values: np.ndarray) -> np.ndarray:
    return values.astype(np.float32) + np.float32(0)


def distances_np(base: np.ndarray, query: np.ndarray, kind: MetricKind) -> np.ndarray:
    """Same numbers as distance(): cumsum adds strictly from left to right."""
    x, q = base.astype(np.float64), query.astype(np.float64)
    if kind is MetricKind.L2:
        return narrow(np.cumsum((q - x) * (q - x), axis=1)[:, -1])
    total = np.cumsum(q * x, axis=1)[:, -1]
    return narrow(1.0 - total if kind is MetricKind.COSINE else -total)


def normalize_np(base: np.ndarray) -> np.ndarray:
    x = base.astype(np.float64)
    return (x * (1.0 / np.sqrt(np.cumsum(x * x, axis=1)[:, -1]))[:, None]).astype(np.float32)
