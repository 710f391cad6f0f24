"""Exact search and the primitives around it: pairwise distances, products, top-k, gathering."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stellate.functions.metrics import SHOWN_DIGITS, check_metric, column, rough
from stellate.operators.blocks import check_k, nearest, pack, paired, ranked, unpack, vectors


def allowed(data: DataFrame, allow: DataFrame | Column | None, id_col: str = "vec_id") -> DataFrame:
    """The rows that a filter keeps, before anything is scored: a predicate, or a frame of ids."""
    if allow is None:
        return data
    if isinstance(allow, DataFrame):
        ids = allow.select(F.col(allow.columns[0]).cast("bigint").alias("allow_id")).distinct()
        return data.join(ids, data[id_col] == ids["allow_id"], "left_semi")
    return data.where(allow)


def allow_list(ids: DataFrame, n: int) -> DataFrame:
    """An allow list's ids within 0 .. n - 1, each once."""
    first = ids.columns[0]
    return ids.select(F.col(first).cast("bigint").alias("vec_id")).where(f"vec_id >= 0 and vec_id < {n}").distinct()


def shown(found: DataFrame, metric: str) -> DataFrame:
    """Results as users see them: an inner product is positive again, and distances are rounded."""
    d = -F.col("d") if metric == "ip" else F.col("d")
    return found.select("qid", F.col("rank").cast("int").alias("rank"), "vec_id", F.round(d, SHOWN_DIGITS).alias("distance"))


def brute_force(queries: DataFrame, data: DataFrame, k: int = 10, metric: str = "l2", p: float = 2.0, allow=None, without_self: bool = False) -> DataFrame:
    """The exact k nearest rows of `data` for each query: qid, rank, vec_id, distance. Fewer than k rows give fewer."""
    check_metric(metric), check_k(k)
    pairs = paired(pack(vectors(queries)), pack(vectors(allowed(data, allow))))
    return shown(ranked(nearest(pairs, metric, k, p, without_self), k), metric)


def all_neighbors(data: DataFrame, k: int = 10, metric: str = "l2") -> DataFrame:
    """The k-nearest-neighbour graph, without a row itself."""
    return brute_force(data, data, k, metric, without_self=True)


def brute_force_sql(queries: DataFrame, data: DataFrame, k: int = 10, metric: str = "l2", p: float = 2.0) -> DataFrame:
    """The same as brute_force by built-in functions alone: for few queries, whose rows are paired singly."""
    check_metric(metric), check_k(k)
    q, x = vectors(queries), vectors(data)
    d = q.select(F.col("id").alias("qid"), F.col("v").alias("q")).crossJoin(x).select("qid", F.col("id").alias("vec_id"), column(metric, F.col("q"), F.col("v"), p).alias("d"))
    return shown(ranked(d, k), metric)


def pairwise(queries: DataFrame, data: DataFrame, metric: str = "l2", p: float = 2.0) -> DataFrame:
    """All distances of the queries and the data: qid, vec_id, distance (an inner product is negated)."""
    check_metric(metric)

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                (qids, x), (ids, y) = unpack(r["q_ids"], r["q_matrix"], r["q_dim"]), unpack(r["d_ids"], r["d_matrix"], r["d_dim"])
                step = max(1, 65_536 // max(1, len(ids)))
                for n in range(0, len(qids), step):
                    d = rough(metric, x[n : n + step], y, p)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qids[n : n + step], len(ids))), pa.array(np.tile(ids, len(d))), pa.array(d.ravel())], names=["qid", "vec_id", "d"])

    found = paired(pack(vectors(queries)), pack(vectors(data))).drop("d_grp").mapInArrow(run, "qid bigint, vec_id bigint, d double")
    return found.select("qid", "vec_id", (F.round("d", SHOWN_DIGITS) + 0.0).alias("distance"))


def gemm(a: DataFrame, b: DataFrame, half: bool = False) -> DataFrame:
    """A times B transposed, in long form: i, j, value. With `half`, of values rounded to 16-bit floats."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                (i, x), (j, y) = unpack(r["q_ids"], r["q_matrix"], r["q_dim"]), unpack(r["d_ids"], r["d_matrix"], r["d_dim"])
                if half:
                    x, y = (v.astype("f4").astype("f2").astype(float) for v in (x, y))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(i, len(j))), pa.array(np.tile(j, len(i))), pa.array((x @ y.T).ravel())], names=["i", "j", "value"])

    found = paired(pack(vectors(a)), pack(vectors(b))).drop("d_grp").mapInArrow(run, "i bigint, j bigint, value double")
    return found.select("i", "j", (F.round("value", SHOWN_DIGITS) + 0.0).alias("value"))


def code_distances(queries: DataFrame, data: DataFrame) -> DataFrame:
    """Differing bits of all pairs of byte codes (vec_id, codes): qid, vec_id, bits."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                (qids, x), (ids, y) = unpack(r["q_ids"], r["q_matrix"], r["q_dim"]), unpack(r["d_ids"], r["d_matrix"], r["d_dim"])
                x, y = x.astype(np.uint8), y.astype(np.uint8)
                for qid, code in zip(qids, x):
                    bits = np.bitwise_count(y ^ code).sum(1).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), qid)), pa.array(ids), pa.array(bits)], names=["qid", "vec_id", "bits"])

    q, x = (pack(vectors(df, vec_col="codes")) for df in (queries, data))
    return paired(q, x).drop("d_grp").mapInArrow(run, "qid bigint, vec_id bigint, bits int")


def top_k(scores: DataFrame, k: int, row: str, col: str, value: str, largest: bool = False) -> DataFrame:
    """The k smallest or largest values of each row: numbers before NaN, ties by column."""
    check_k(k)
    order = F.desc(value) if largest else F.asc(value)
    by = Window.partitionBy(row).orderBy(F.isnan(value), order, col)
    return scores.where(F.col(value).isNotNull()).select(row, col, value).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def gather(index: DataFrame, data: DataFrame, position: str, idx: str, dim: int) -> DataFrame:
    """The vector of each id of `index`, in double; an id without a row gets zeros."""
    rows = data.select(F.col("vec_id").alias("at"), F.col("embedding").cast("array<double>").alias("vector"))
    zeros = F.array_repeat(F.lit(0.0), dim)
    return index.join(rows, index[idx] == rows["at"], "left").select(F.col(position).alias("position"), F.col(idx).alias("vec_id"), F.coalesce("vector", zeros).alias("vector"))


def to_dense(found: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Exactly k rows for each query: where results are short, vec_id -1 and an infinite distance."""
    every = queries.select(F.col("vec_id").alias("qid")).withColumn("rank", F.explode(F.sequence(F.lit(1), F.lit(k))))
    return every.join(found, ["qid", "rank"], "left").select("qid", "rank", F.coalesce("vec_id", F.lit(-1)).alias("vec_id"), F.coalesce("distance", F.lit(float("inf"))).alias("distance"))
