"""Quantizers and projections: scalar, product and binary codes, column statistics, PCA."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stellate.functions.metrics import InvalidArgument
from stellate.operators.blocks import matrix, vectors
from stellate.operators.cluster import first_rows, lloyd, nearest_centre


def dim_stats(data: DataFrame) -> DataFrame:
    """pos, n, lo, hi, mean, var (of the population) and the weight sqrt(var + 1e-6) of every position."""
    long = vectors(data).select(F.posexplode("v").alias("pos", "x"))
    return long.groupBy("pos").agg(
        F.count("x").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.avg("x").alias("mean"), F.var_pop("x").alias("var")
    ).withColumn("weight", F.sqrt(F.col("var") + 1e-6))


def sq_fit(data: DataFrame) -> DataFrame:
    """pos, lo and scale of the 8-bit scalar quantizer; a scale under 1e-12 becomes 1."""
    scale = (F.col("hi") - F.col("lo")) / 255.0
    return dim_stats(data).select("pos", "lo", F.when(scale < 1e-12, 1.0).otherwise(scale).alias("scale"))


def _model(fitted: DataFrame):
    """A model of one row per position as two constant arrays."""
    rows = fitted.orderBy("pos").collect()
    return [F.array(*(F.lit(float(r[c])) for r in rows)).cast("array<double>") for c in ("lo", "scale")]


def sq_encode(data: DataFrame, fitted: DataFrame) -> DataFrame:
    """vec_id and codes: floor(clamp((x - lo) / scale, 0, 255) + 0.5)."""
    lo, scale = _model(fitted)
    share = F.zip_with(F.zip_with("v", lo, lambda x, low: x - low), scale, lambda x, s: x / s)
    code = lambda x: F.floor(F.least(F.greatest(x, F.lit(0.0)), F.lit(255.0)) + 0.5).cast("int")
    return vectors(data).select(F.col("id").alias("vec_id"), F.transform(share, code).alias("codes"))


def sq_decode(codes: DataFrame, fitted: DataFrame) -> DataFrame:
    """vec_id and the vector that its codes stand for."""
    lo, scale = _model(fitted)
    value = F.zip_with(F.zip_with(scale, "codes", lambda s, c: s * c), lo, lambda x, low: x + low)
    return codes.select("vec_id", value.alias("vector"))


def binary_encode(data: DataFrame) -> DataFrame:
    """vec_id and the signs (x >= 0) as bytes, the first position in the lowest bit."""
    bit = lambda x, i: F.when(x >= 0, F.pow(F.lit(2.0), F.pmod(i, F.lit(8)))).otherwise(0.0)
    bits = F.transform("v", bit)
    byte = lambda k: F.aggregate(F.slice(bits, (k * 8 + 1).cast("int"), F.lit(8)), F.lit(0.0), lambda s, b: s + b).cast("int")
    return vectors(data).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(0), F.ceil(F.size("v") / 8).cast("int") - 1), byte).alias("codes"))


def _subspaces(dim: int, parts: int) -> int:
    if dim % parts:
        raise InvalidArgument(f"{dim} positions do not split into {parts} equal parts")
    return dim // parts


def pq_fit(data: DataFrame, parts: int = 8, bits: int = 8, iterations: int = 8) -> np.ndarray:
    """Codebooks [parts, codes, positions] by k-means in each part of the vectors; never more codes than rows."""
    rows = vectors(data)
    first = rows.first()
    if first is None:
        raise InvalidArgument("no vectors to fit")
    width = _subspaces(len(first["v"]), parts)
    start = first_rows(rows, 2 ** min(max(bits, 4), 8))
    return lloyd(rows, np.stack([start[:, m * width : (m + 1) * width] for m in range(parts)]), iterations)


def pq_codes(x: np.ndarray, books: np.ndarray) -> np.ndarray:
    width = books.shape[2]
    return np.stack([nearest_centre(x[:, m * width : (m + 1) * width], book)[0] for m, book in enumerate(books)], axis=1)


def pq_encode(data: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id and codes: the nearest codeword of each part, the lowest of equals."""
    shipped = data.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                codes = pq_codes(matrix(batch.column(1)), shipped.value).astype(np.int16)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(codes), pa.list_(pa.int16()))], names=["vec_id", "codes"])

    return vectors(data).mapInArrow(run, "vec_id bigint, codes array<smallint>")


def pq_decode(codes: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id and the vector that its codes stand for; a code beyond the book is an error."""
    shipped = codes.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                c = matrix(batch.column(1)).astype(int)
                check_codes(c, shipped.value.shape[1])
                x = np.concatenate([book[c[:, m]] for m, book in enumerate(shipped.value)], axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x), pa.list_(pa.float64()))], names=["vec_id", "vector"])

    return codes.select("vec_id", "codes").mapInArrow(run, "vec_id bigint, vector array<double>")


def check_codes(codes: np.ndarray, size: int) -> None:
    if len(codes) and (codes.min() < 0 or codes.max() >= size):
        raise InvalidArgument("a code lies beyond its codebook")


def adc_table(q: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Squared distances of a query's parts to all codewords: [parts, codes]."""
    return ((books - q.reshape(books.shape[0], 1, books.shape[2])) ** 2).sum(2)


def adc(table: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The sum over the parts of the table's entries that codes name."""
    check_codes(codes, table.shape[1])
    return table[np.arange(table.shape[0])[None], codes].sum(1)


def moments(data: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, means and centred products, from one matrix per task that meet by place."""

    def run(batches):
        n, s, p = 0, 0.0, 0.0
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(0))
                n, s, p = n + len(x), s + x.sum(0), p + x.T @ x
        if n:
            both = np.vstack([s[None], p])
            yield pa.RecordBatch.from_arrays([pa.array([n] * len(both)), pa.array(np.arange(len(both)) - 1), pa.array(list(both), pa.list_(pa.float64()))], names=["n", "row", "x"])

    parts = vectors(data).select("v").mapInArrow(run, "n bigint, row bigint, x array<double>")
    found = parts.select("n", "row", F.posexplode("x").alias("col", "x")).groupBy("row", "col").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).collect()
    if not found:
        raise InvalidArgument("no vectors to fit")
    dim, n = max(r["col"] for r in found) + 1, found[0]["n"]
    both = np.zeros((dim + 1, dim))
    for r in found:
        both[r["row"] + 1, r["col"]] = r["x"]
    mean = both[0] / n
    return n, mean, both[1:] - n * np.outer(mean, mean)


def covariance(data: DataFrame) -> DataFrame:
    """i, j and the sample covariance of two positions."""
    n, _, products = moments(data)
    c = products / max(n - 1, 1)
    rows = [(i, j, float(c[i, j])) for i in range(len(c)) for j in range(len(c))]
    return data.sparkSession.createDataFrame(rows, "i int, j int, cov double")


def pca_fit(data: DataFrame, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, components [parts, positions] and their variances; each component's largest entry is positive."""
    n, mean, products = moments(data)
    if not 1 <= parts <= len(mean):
        raise InvalidArgument("components must be between 1 and the number of positions")
    values, w = np.linalg.eigh(products / max(n - 1, 1))
    w = w[:, ::-1][:, :parts].T
    return mean, w * np.where(w[np.arange(parts), np.abs(w).argmax(1)] < 0, -1.0, 1.0)[:, None], values[::-1][:parts]


def pca_transform(data: DataFrame, mean: np.ndarray, components: np.ndarray) -> DataFrame:
    """vec_id and its centred projection on the components."""
    shipped = data.sparkSession.sparkContext.broadcast((mean, components))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                mean, w = shipped.value
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list((matrix(batch.column(1)) - mean) @ w.T), pa.list_(pa.float64()))], names=["vec_id", "vector"])

    return vectors(data).mapInArrow(run, "vec_id bigint, vector array<double>")
