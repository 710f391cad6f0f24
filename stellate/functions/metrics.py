"""Vector metrics, as numpy kernels and as Spark columns, with one meaning.

l2: sum of squared differences; l2sqrt: its root; ip: the inner product, negated as a
distance; cosine: 1 - x.y / (|x| |y|) with squared norms of at least 1e-12; hamming:
positions whose signs (>= 0) differ; lp: the p-norm of the difference (p <= 0: 2).
All arithmetic is in double precision. Ranks compare distances rounded to RANK_DIGITS
digits, then ids, so that equal vectors rank by id whatever the order of summation.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

METRICS = ("l2", "l2sqrt", "ip", "cosine", "hamming", "lp")
RANK_DIGITS, SHOWN_DIGITS = 9, 6
LEAST_NORM2 = 1e-12


class InvalidArgument(ValueError):
    """A parameter or an input that an operator can't take."""


def check_metric(metric: str) -> str:
    if metric not in METRICS:
        raise InvalidArgument(f"unknown metric {metric!r}; known are {', '.join(METRICS)}")
    return metric


def _p(p: float) -> float:
    return p if p > 0 else 2.0


def rough(metric: str, x: np.ndarray, y: np.ndarray, p: float = 2.0) -> np.ndarray:
    """All distances of rows of x and rows of y; by matrix products where that can be, so with rounding errors."""
    if metric in ("l2", "l2sqrt") or (metric == "lp" and _p(p) == 2.0):
        d = np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2.0 * (x @ y.T), 0.0)
        return d if metric == "l2" else np.sqrt(d)
    if metric == "ip":
        return -(x @ y.T)
    if metric == "cosine":
        n = [np.sqrt(np.maximum((v * v).sum(1), LEAST_NORM2)) for v in (x, y)]
        return 1.0 - (x @ y.T) / (n[0][:, None] * n[1][None])
    if metric == "hamming":
        a, b = ((v >= 0).astype(float) for v in (x, y))
        return a.sum(1)[:, None] + b.sum(1)[None] - 2.0 * (a @ b.T)
    return np.stack([exact(metric, row, y, p) for row in x]) if len(x) else np.empty((0, len(y)))


def exact(metric: str, x: np.ndarray, y: np.ndarray, p: float = 2.0) -> np.ndarray:
    """Distances of one vector x and rows of y, without cancellation."""
    if metric in ("l2", "l2sqrt"):
        d = ((y - x) ** 2).sum(1)
        return d if metric == "l2" else np.sqrt(d)
    if metric == "lp":
        return (np.abs(y - x) ** _p(p)).sum(1) ** (1.0 / _p(p))
    return rough(metric, x[None], y, p)[0]


def column(metric: str, a: Column, b: Column, p: float = 2.0) -> Column:
    """The distance of two array columns, as built-in higher-order functions."""
    check_metric(metric)
    a, b = a.cast("array<double>"), b.cast("array<double>")
    total = lambda f: F.aggregate(F.zip_with(a, b, f), F.lit(0.0), lambda s, v: s + v)
    norm2 = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)
    if metric in ("l2", "l2sqrt"):
        d = total(lambda x, y: (x - y) * (x - y))
        return d if metric == "l2" else F.sqrt(d)
    if metric == "ip":
        return -total(lambda x, y: x * y)
    if metric == "cosine":
        return 1.0 - total(lambda x, y: x * y) / (F.sqrt(F.greatest(norm2(a), F.lit(LEAST_NORM2))) * F.sqrt(F.greatest(norm2(b), F.lit(LEAST_NORM2))))
    if metric == "hamming":
        return total(lambda x, y: ((x >= 0) != (y >= 0)).cast("double"))
    return F.pow(total(lambda x, y: F.pow(F.abs(x - y), F.lit(_p(p)))), F.lit(1.0 / _p(p)))


def packed_hamming(a: Column, b: Column) -> Column:
    """Differing bits of two arrays of words."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, v: s + v)


def register(spark: SparkSession) -> None:
    """vec_l2, vec_ip and the like as SQL functions of the session."""
    dot = "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, v) -> s + v)"
    norm = "sqrt(greatest(aggregate({0}, 0D, (s, v) -> s + v * v), 1e-12D))"
    l2 = "aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (s, v) -> s + v)"
    for name, body in {
        "l2": l2, "l2sqrt": f"sqrt({l2})", "ip": f"-{dot}", "cosine": f"1 - {dot} / ({norm.format('a')} * {norm.format('b')})",
        "hamming": "aggregate(zip_with(a, b, (x, y) -> if((x >= 0) != (y >= 0), 1D, 0D)), 0D, (s, v) -> s + v)",
    }.items():
        spark.sql(f"create or replace temporary function vec_{name}(a array<double>, b array<double>) returns double return {body}")


def seed_hashes(queries: np.ndarray) -> np.ndarray:
    """Of each row of `queries` a hash of its float32 bits."""
    h = np.full(len(queries), 2166136261, np.uint64)
    with np.errstate(over="ignore"):
        for word in np.ascontiguousarray(queries.astype("<f4")).view("<u4").T:
            h = ((h ^ word.astype(np.uint64)) * np.uint64(16777619)) & np.uint64(0xFFFFFFFF)
        # The shifts and factors that spread the hash's bits.
        for shift, factor in ((16, 0x7FEB352D), (15, 0x846CA68B), (16, 1)):
            h = ((h ^ (h >> np.uint64(shift))) * np.uint64(factor)) & np.uint64(0xFFFFFFFF)
    return h


def seed_places(queries: np.ndarray, n: int, count: int) -> np.ndarray:
    """Where walks for each row of `queries` begin: from its hash alone, so batches don't matter. Some may come twice."""
    return ((np.arange(count, dtype=np.uint64) * np.uint64(9973) + seed_hashes(queries)[:, None] * np.uint64(13)) % np.uint64(max(n, 1))).astype(np.int64)


def seed_ids(query: np.ndarray, n: int, count: int) -> np.ndarray:
    """Where walks for a query begin."""
    return np.unique(seed_places(query[None], n, count))
