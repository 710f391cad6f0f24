"""Vectors packed into blocks, and searches that join blocks.

A block is one row: up to ROWS vectors of one group as a matrix, and their ids. A search
pairs blocks of queries with blocks of data, never single rows, scores each pair of
blocks with matrix products, and keeps the best k of each; a ranking by query, which
Spark limits before it shuffles, merges them. So rows that leave a task grow with
queries times k times data blocks, and no side is collected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stellate.functions.metrics import RANK_DIGITS, InvalidArgument, check_metric, exact, rough

ROWS = 1024
BLOCK = "grp bigint, dim int, ids binary, matrix binary"


def vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """id and v (doubles); rows whose vector is null are left out, null elements are an error downstream."""
    return df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where("v is not null")


def matrix(column) -> np.ndarray:
    """An Arrow column of equally long lists as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten()
    if flat.null_count:
        raise InvalidArgument("a vector holds a null element")
    n = len(column)
    if n and len(flat) % n or n and len(set(column.value_lengths().to_pylist())) != 1:
        raise InvalidArgument("vectors differ in length")
    return flat.to_numpy(zero_copy_only=False).astype(float).reshape(n, -1)


def pack(rows: DataFrame, group: str | None = None, size: int = ROWS) -> DataFrame:
    """Blocks of `rows` (id, v, and maybe a group column), packed where they lie."""
    cols = rows.select("id", "v", (F.col(group) if group else F.lit(0)).cast("bigint").alias("grp"))

    def run(batches):
        waiting: dict[int, list] = {}

        def block(grp, parts):
            ids, m = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            for k in range(0, len(ids), size):
                yield grp, m.shape[1], ids[k : k + size].tobytes(), m[k : k + size].tobytes()

        def send(blocks):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*blocks), types)], names=["grp", "dim", "ids", "matrix"])

        for batch in batches:
            if not batch.num_rows:
                continue
            m, ids, grp = matrix(batch.column(1)), batch.column(0).to_numpy(), batch.column(2).to_numpy()
            for g in np.unique(grp):
                own = waiting.setdefault(int(g), [])
                own.append((ids[grp == g], m[grp == g]))
                if sum(len(p[0]) for p in own) >= size:
                    yield send(list(block(int(g), waiting.pop(int(g)))))
        for g, parts in waiting.items():
            yield send(list(block(g, parts)))

    types = [pa.int64(), pa.int32(), pa.binary(), pa.binary()]
    return cols.mapInArrow(run, BLOCK)


def unpack(ids: bytes, m: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, np.int64), np.frombuffer(m, float).reshape(-1, dim)


def paired(queries: DataFrame, data: DataFrame, by_group: bool = False) -> DataFrame:
    """All pairs of a query block and a data block; with by_group, of the same group."""
    left = queries.select(*(F.col(c).alias(f"q_{c}") for c in ("grp", "dim", "ids", "matrix")))
    right = data.select(*(F.col(c).alias(f"d_{c}") for c in ("grp", "dim", "ids", "matrix")))
    both = left.join(right, left["q_grp"] == right["d_grp"]) if by_group else left.crossJoin(right)
    return both.select("q_dim", "q_ids", "q_matrix", "d_dim", "d_ids", "d_matrix", "d_grp")


def best(metric: str, q: np.ndarray, ids: np.ndarray, y: np.ndarray, k: int, p: float = 2.0, own_id=None):
    """The k nearest rows of y to one q, exactly: (ids, distances) by distance, then id."""
    keep = np.ones(len(ids), bool) if own_id is None else ids != own_id
    d = exact(metric, q, y[keep], p)
    order = np.lexsort((ids[keep], np.round(d, RANK_DIGITS)))[:k]
    return ids[keep][order], d[order]


def nearest(pairs: DataFrame, metric: str, k: int, p: float = 2.0, without_self: bool = False) -> DataFrame:
    """qid, vec_id, d: the k nearest of every pair of blocks, not merged yet."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                (qids, x), (ids, y) = unpack(row["q_ids"], row["q_matrix"], row["q_dim"]), unpack(row["d_ids"], row["d_matrix"], row["d_dim"])
                if x.shape[1] != y.shape[1]:
                    raise InvalidArgument("queries and data differ in length")
                d, out = rough(metric, x, y, p), []
                kth = min(k + without_self, len(ids)) - 1
                # The rough distances choose; what lies within their error is measured again.
                limit = np.partition(d, kth, axis=1)[:, kth]
                limit = limit + 1e-7 * (1.0 + np.abs(limit))
                for n, qid in enumerate(qids):
                    near = np.flatnonzero(d[n] <= limit[n])
                    found, dist = best(metric, x[n], ids[near], y[near], k, p, qid if without_self else None)
                    out.append((np.full(len(found), qid), found, dist))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["qid", "vec_id", "d"])

    return pairs.drop("d_grp").mapInArrow(run, "qid bigint, vec_id bigint, d double")


def within(pairs: DataFrame, k: int) -> DataFrame:
    """qid, vec_id, d: of every pair of blocks the rows but itself, k at most, that lie within a query's bound, which
    is the last element of its vector."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                (qids, m), (ids, y) = unpack(row["q_ids"], row["q_matrix"], row["q_dim"]), unpack(row["d_ids"], row["d_matrix"], row["d_dim"])
                x, bound, out = m[:, :-1], m[:, -1], []
                if x.shape[1] != y.shape[1]:
                    raise InvalidArgument("queries and data differ in length")
                # Rough distances have rounding errors.
                at, near = np.nonzero(rough("l2", x, y) <= (bound + 1e-7 * (1.0 + bound))[:, None])
                ends = np.searchsorted(at, np.arange(len(qids) + 1))
                # Few queries at a time where bounds leave many rows.
                step = len(qids) if len(at) <= 100_000 else 64
                for n in range(0, len(qids), step):
                    part = slice(ends[n], ends[min(n + step, len(qids))])
                    who, own = at[part], near[part]
                    who, own = who[qids[who] != ids[own]], own[qids[who] != ids[own]]
                    d = ((y[own] - x[who]) ** 2).sum(1)
                    order = np.lexsort((ids[own], np.round(d, RANK_DIGITS), who))
                    who, own, d = who[order], own[order], d[order]
                    kept = np.arange(len(who)) - np.searchsorted(who, who) < k
                    out.append((qids[who[kept]], ids[own[kept]], d[kept]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["qid", "vec_id", "d"])

    return pairs.drop("d_grp").mapInArrow(run, "qid bigint, vec_id bigint, d double")


def ranked(found: DataFrame, k: int, order: str = "d") -> DataFrame:
    """The best k of each query: qid, rank (from 1), vec_id and `order`; ties by id."""
    by = Window.partitionBy("qid").orderBy(F.round(order, RANK_DIGITS), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def check_k(k: int) -> int:
    if k < 1:
        raise InvalidArgument("k must be positive")
    return k


__all__ = ["ROWS", "best", "check_k", "check_metric", "matrix", "nearest", "pack", "paired", "ranked", "unpack", "vectors", "within"]
