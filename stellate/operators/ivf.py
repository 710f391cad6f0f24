"""Inverted-list indexes: flat, product-quantized, sign-quantized, and with weighted positions.

An index is a frame of rows (vec_id, embedding, list_id, and in the compressed kinds scale
and code) with a small model. A search finds each query's `nprobe` nearest lists by squared
distance, whatever the metric, packs the queries of a list and the rows of a list into
blocks, and joins blocks by list. Compressed kinds are encoded once, when rows come in: a
search moves their codes alone, which give a shortlist of `krefine` rows, and measures the
vectors of those by the real metric.
With all lists and a shortlist of all rows a search is exact.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stellate.functions.metrics import InvalidArgument, check_metric, column, rough
from stellate.operators.blocks import ROWS, best, check_k, matrix, nearest, pack, paired, ranked, unpack, vectors
from stellate.operators.cluster import kmeans_fit, kmeans_predict, nearest_centre
from stellate.operators.knn import allowed, shown
from stellate.operators.quantize import adc, adc_table, dim_stats, pq_codes, pq_fit
from stellate.sources.shared import checkpointed

KINDS = ("flat", "pq", "rabitq", "scann")
CODED = "vec_id bigint, embedding array<double>, list_id int, scale double, code binary"


@dataclass
class IvfIndex:
    """kind, the rows (vec_id, embedding, list_id, maybe scale and code), and the model."""

    kind: str
    rows: DataFrame
    centres: np.ndarray
    books: np.ndarray | None = None
    weights: np.ndarray | None = None


def _weighted(data: DataFrame, weights: np.ndarray) -> DataFrame:
    w = F.array(*(F.lit(float(x)) for x in weights))
    return data.withColumn("embedding", F.zip_with(F.col("embedding").cast("array<double>"), w, lambda x, y: x * y))


def assign(data: DataFrame, centres: np.ndarray) -> DataFrame:
    """`data` (vec_id, embedding) with the list of each row."""
    shipped = data.sparkSession.sparkContext.broadcast(centres)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                at, _ = nearest_centre(matrix(batch.column(1)), shipped.value)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int32))], names=["vec_id", "embedding", "list_id"])

    rows = vectors(data).select(F.col("id").alias("vec_id"), F.col("v").alias("embedding"))
    return rows.mapInArrow(run, "vec_id bigint, embedding array<double>, list_id int")


def _residuals(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    shipped = rows.sparkSession.sparkContext.broadcast(centres)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                r = matrix(batch.column(1)) - shipped.value[batch.column(2).to_numpy()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(r), pa.list_(pa.float64()))], names=["vec_id", "embedding"])

    return rows.select("vec_id", "embedding", "list_id").mapInArrow(run, "vec_id bigint, embedding array<double>")


def _encoded(rows: DataFrame, kind: str, centres: np.ndarray, books: np.ndarray | None) -> DataFrame:
    """Rows of lists with what the kind keeps of their residuals: product codes as bytes, one a part, or
    the norm and the signs as bits, the first position in the lowest."""
    if kind == "flat":
        return rows
    shipped = rows.sparkSession.sparkContext.broadcast((centres, books))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                centres, books = shipped.value
                r = matrix(batch.column(1)) - centres[batch.column(2).to_numpy()]
                if kind == "rabitq":
                    scale, code = np.sqrt(np.maximum((r**2).sum(1), 1e-12)), np.packbits(r >= 0, axis=1, bitorder="little")
                else:
                    scale, code = np.ones(len(r)), pq_codes(r, books).astype(np.uint8)
                kept = [pa.array(scale), pa.array([c.tobytes() for c in code], pa.binary())]
                yield pa.RecordBatch.from_arrays([*batch.columns, *kept], names=["vec_id", "embedding", "list_id", "scale", "code"])

    return rows.select("vec_id", "embedding", "list_id").mapInArrow(run, CODED)


def build(data: DataFrame, kind: str = "flat", nlist: int = 8, iterations: int = 12, pq_m: int = 8, pq_bits: int = 8) -> IvfIndex:
    """An index of `data` (vec_id, embedding)."""
    if kind not in KINDS:
        raise InvalidArgument(f"unknown kind {kind!r}")
    weights = None
    if kind == "scann":
        weights = np.array([r["weight"] for r in dim_stats(data).orderBy("pos").collect()])
    space = data if weights is None else _weighted(data, weights)
    centres = kmeans_fit(space, nlist, iterations)
    rows = assign(space, centres)
    books = pq_fit(_residuals(rows, centres), pq_m, pq_bits) if kind in ("pq", "scann") else None
    return IvfIndex(kind, checkpointed(_encoded(rows, kind, centres, books)), centres, books, weights)


def extend(index: IvfIndex, data: DataFrame) -> IvfIndex:
    """The index with more rows, which take the lists and codes of the model it has; only they are encoded.
    The old one stays as it is."""
    space = data if index.weights is None else _weighted(data, index.weights)
    new = checkpointed(_encoded(assign(space, index.centres), index.kind, index.centres, index.books))
    return IvfIndex(index.kind, index.rows.unionByName(new), index.centres, index.books, index.weights)


def lists(index: IvfIndex) -> DataFrame:
    """list_id and the number of its rows."""
    return index.rows.groupBy("list_id").agg(F.count("*").alias("n"))


def probe(queries: DataFrame, centres: np.ndarray, nprobe: int) -> DataFrame:
    """id, v and list_id of the nprobe nearest lists of each query; ties by list."""
    shipped = queries.sparkSession.sparkContext.broadcast(centres)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, centres = matrix(batch.column(1)), shipped.value
            d = np.stack([((x - c) ** 2).sum(1) for c in centres], axis=1)
            at = np.argsort(np.round(d, 9), axis=1, kind="stable")[:, : min(nprobe, len(centres))]
            many = pa.array(np.repeat(np.arange(len(x)), at.shape[1]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(many), batch.column(1).take(many), pa.array(at.ravel().astype(np.int32))], names=["id", "v", "list_id"])

    return queries.mapInArrow(run, "id bigint, v array<double>, list_id int")


def candidates(index: IvfIndex, queries: DataFrame, nprobe: int) -> DataFrame:
    """qid, the lists that a search probes for it, and the rows of those, which it scores."""
    found = probe(vectors(queries), index.centres, nprobe).select(F.col("id").alias("qid"), "list_id")
    sized = found.join(F.broadcast(lists(index)), "list_id", "left")  # one row per list
    return sized.groupBy("qid").agg(F.count("*").alias("lists"), F.coalesce(F.sum("n"), F.lit(0)).alias("candidate_rows"))


def _pack_codes(rows: DataFrame, size: int = ROWS) -> DataFrame:
    """Blocks of coded rows (vec_id, list_id, scale, code) of one list, packed where they lie."""

    def block(grp, ids, scales, codes):
        return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip((grp, np.array(ids).tobytes(), np.array(scales).tobytes(), b"".join(codes)), types)], names=["grp", "ids", "scales", "codes"])

    def run(batches):
        waiting: dict[int, tuple[list, list, list]] = {}
        for batch in batches:
            for vec_id, grp, scale, code in zip(*(c.to_pylist() for c in batch.columns)):
                own = waiting.setdefault(grp, ([], [], []))
                for part, value in zip(own, (vec_id, scale, code)):
                    part.append(value)
                if len(own[0]) == size:
                    yield block(grp, *waiting.pop(grp))
        for grp, own in waiting.items():
            yield block(grp, *own)

    types = [pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    return rows.select("vec_id", "list_id", "scale", "code").mapInArrow(run, "grp bigint, ids binary, scales binary, codes binary")


def _estimates(index: IvfIndex, found: DataFrame, rows: DataFrame, krefine: int) -> DataFrame:
    """qid, vec_id and d of the shortlists of every pair of a block of probing queries and one of codes."""
    shipped = rows.sparkSession.sparkContext.broadcast((index.kind, index.centres, index.books))

    def run(batches):
        kind, centres, books = shipped.value
        for batch in batches:
            for r in batch.to_pylist():
                (qids, x), ids, centre, out = unpack(r["q_ids"], r["q_matrix"], r["q_dim"]), np.frombuffer(r["ids"], np.int64), centres[r["grp"]], []
                codes = np.frombuffer(r["codes"], np.uint8).reshape(len(ids), -1)
                if kind == "rabitq":
                    norm, signs = np.frombuffer(r["scales"]), np.unpackbits(codes, axis=1, count=len(centre), bitorder="little") * 2.0 - 1.0
                for qid, q in zip(qids, x):
                    if kind == "rabitq":
                        d = ((q - centre) ** 2).sum() + norm**2 - 2 * norm * (signs @ (q - centre)) / np.sqrt(len(q))
                    else:
                        d = adc(adc_table(q - centre, books), codes)
                    order = np.lexsort((ids, np.round(d, 9)))[:krefine]
                    out.append((np.full(len(order), qid), ids[order], d[order]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["qid", "vec_id", "d"])

    left = pack(found, "list_id").select("grp", *(F.col(c).alias(f"q_{c}") for c in ("dim", "ids", "matrix")))
    return left.join(_pack_codes(rows), "grp").mapInArrow(run, "qid bigint, vec_id bigint, d double")


def _pack_coded(rows: DataFrame, size: int = ROWS) -> DataFrame:
    """Blocks of coded rows of one list with `v`, the vector that was coded and the one to measure in one."""

    def run(batches):
        waiting: dict[int, list] = {}

        def block(grp, parts):
            scale, m = (np.concatenate([p[n] for p in parts]) for n in (1, 3))
            ids, codes = np.concatenate([p[0] for p in parts]), [c for p in parts for c in p[2]]
            for k in range(0, len(ids), size):
                row = (grp, ids[k : k + size].tobytes(), scale[k : k + size].tobytes(), b"".join(codes[k : k + size]), m[k : k + size].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(row, types)], names=["grp", "ids", "scales", "codes", "matrix"])

        for batch in batches:
            if not batch.num_rows:
                continue
            ids, grp, scale = (batch.column(n).to_numpy() for n in range(3))
            m = matrix(batch.column(4))
            for g in np.unique(grp):
                own = waiting.setdefault(int(g), [])
                own.append((ids[grp == g], scale[grp == g], batch.column(3).take(pa.array(np.flatnonzero(grp == g))).to_pylist(), m[grp == g]))
                if sum(len(p[0]) for p in own) >= size:
                    yield from block(int(g), waiting.pop(int(g)))
        for g, parts in waiting.items():
            yield from block(g, parts)

    types = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
    return rows.select("vec_id", "list_id", "scale", "code", "v").mapInArrow(run, "grp bigint, ids binary, scales binary, codes binary, matrix binary")


def may_reach(kind: str, centre: np.ndarray, books, q: np.ndarray, x: np.ndarray, codes: np.ndarray, limits: np.ndarray, sure: float) -> np.ndarray:
    """For each query which rows' distances, by their codes, may be within its limit: the estimate less `sure`
    standard deviations, as they would be if what a code leaves out had any direction."""
    dim = len(centre)
    if kind == "rabitq":
        u, r = q - centre, x - centre
        norm = np.sqrt(np.maximum((r**2).sum(1), 1e-12))
        signs = (np.unpackbits(codes, axis=1, count=dim, bitorder="little") * 2.0 - 1.0) / np.sqrt(dim)
        share = np.maximum((signs * r).sum(1) / norm, 1e-6)
        long = (u**2).sum(1)[:, None]
        d = long + norm**2 - 2 * (u @ signs.T) * (norm / share)
        off = 2 * np.sqrt(long) * (norm * np.sqrt(np.maximum(1 - share**2, 0.0)) / share)
    else:
        y = centre + np.concatenate([book[codes[:, m]] for m, book in enumerate(books)], axis=1)
        left, d = ((x - y) ** 2).sum(1), rough("l2", q, y)
        d, off = d + left, 2 * np.sqrt(d * left)
    return d - sure * off / np.sqrt(max(dim - 1, 1)) <= limits[:, None] + 1e-7 * (1.0 + np.abs(limits[:, None]))


def _measured(index: IvfIndex, found: DataFrame, q: DataFrame, rows: DataFrame, kept: DataFrame, metric: str, k: int, limits: DataFrame | None = None, sure: float = 0.0) -> DataFrame:
    """qid, vec_id and d of the k nearest of every pair of a block of probing queries and one of rows, measured
    where the rows lie: all of them, or with `limits` (qid, limit) those whose codes say that they may be within."""
    shipped = rows.sparkSession.sparkContext.broadcast((index.kind, index.centres, index.books))

    def run(batches):
        kind, centres, books = shipped.value
        for batch in batches:
            for r in batch.to_pylist():
                (qids, m), ids, dim, out = unpack(r["q_ids"], r["q_matrix"], r["q_dim"]), np.frombuffer(r["ids"], np.int64), centres.shape[1], []
                space, x, limits = m[:, :dim], m[:, dim:-1], m[:, -1]
                both = np.frombuffer(r["matrix"], float).reshape(len(ids), -1)
                d, y = rough(metric, x, both[:, dim:]), both[:, dim:]
                if np.isfinite(limits).all():
                    codes = np.frombuffer(r["codes"], np.uint8).reshape(len(ids), -1)
                    d = np.where(may_reach(kind, centres[r["grp"]], books, space, both[:, :dim], codes, limits, sure), d, np.inf)
                kth = min(k, len(ids)) - 1
                # The rough distances choose; what lies within their error is measured again.
                limit = np.partition(d, kth, axis=1)[:, kth]
                limit = limit + 1e-7 * (1.0 + np.abs(limit))
                for n, qid in enumerate(qids):
                    near = np.flatnonzero((d[n] <= limit[n]) & (d[n] < np.inf))
                    at, dist = best(metric, x[n], ids[near], y[near], k)
                    out.append((np.full(len(at), qid), at, dist))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["qid", "vec_id", "d"])

    asked = found.join(q.select("id", F.col("v").alias("real")), "id")
    asked = asked.withColumn("limit", F.lit(float("inf"))) if limits is None else asked.join(limits.select(F.col("qid").alias("id"), "limit"), "id")
    left = pack(asked.select("id", F.concat("v", "real", F.array("limit")).alias("v"), "list_id"), "list_id").select("grp", *(F.col(c).alias(f"q_{c}") for c in ("dim", "ids", "matrix")))
    data = rows.join(kept.select(F.col("id").alias("vec_id"), F.col("v").alias("real")), "vec_id").withColumn("v", F.concat("embedding", "real"))
    return left.join(_pack_coded(data), "grp").mapInArrow(run, "qid bigint, vec_id bigint, d double")


def search(
    index: IvfIndex, queries: DataFrame, k: int = 10, nprobe: int = 8, metric: str = "l2", krefine: int = 32, allow=None, original: DataFrame | None = None, sure: float | None = None
) -> DataFrame:
    """qid, rank, vec_id, distance. A filter takes rows out before they are scored. An index with weighted
    positions measures its shortlist on the original vectors, which must then be given.

    A shortlist no smaller than a block leaves out nothing of one, so the rows of the lists are then all measured
    where they lie. With `sure` the shortlist of a compressed kind is only the beginning: the k best of it tell how
    near a row must be, and every row of the lists which is that near by its code, allowing for `sure` standard
    deviations of the code's error, is measured as well, however many these are."""
    check_metric(metric), check_k(k)
    if sure is not None and not sure >= 0:
        raise InvalidArgument("sure must be a number of standard deviations")
    rows = allowed(index.rows, allow)
    q = vectors(queries)
    coarse, weighted = q, lambda v: v
    if index.weights is not None:
        if original is None:
            raise InvalidArgument("an index with weighted positions needs the original vectors")
        w = F.array(*(F.lit(float(x)) for x in index.weights))
        weighted = lambda v: F.zip_with(v, w, lambda x, y: x * y)
        coarse = q.withColumn("v", weighted(F.col("v")))
    found = probe(coarse, index.centres, nprobe)
    if index.kind == "flat":
        pairs = paired(pack(found, "list_id"), pack(rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "list_id"), "list_id"), by_group=True)
        return shown(ranked(nearest(pairs, metric, k), k), metric)
    kept = vectors(original) if original is not None else vectors(rows)
    if max(krefine, k) >= ROWS:
        return shown(ranked(_measured(index, found, q, rows, kept, metric, k), k), metric)
    short = ranked(_estimates(index, found, rows, max(krefine, k)), max(krefine, k)).select("qid", "vec_id")
    refined = short.join(kept.select(F.col("id").alias("vec_id"), "v"), "vec_id").join(q.select(F.col("id").alias("qid"), F.col("v").alias("q")), "qid")
    d = column(metric, F.col("q"), F.col("v")).alias("d")
    if sure is None:
        return shown(ranked(refined.select("qid", "vec_id", d), k), metric)
    first = checkpointed(ranked(refined.select("qid", "vec_id", d, column("l2", weighted(F.col("q")), weighted(F.col("v"))).alias("far")), k))
    # Where the shortlist was shorter than k there is no limit.
    limits = first.groupBy("qid").agg(F.when(F.count("*") >= k, F.max("far")).otherwise(F.lit(1e300)).alias("limit"))
    more = _measured(index, found, q, rows, kept, metric, k, limits, sure).unionByName(first.select("qid", "vec_id", "d"))
    return shown(ranked(more.groupBy("qid", "vec_id").agg(F.min("d").alias("d")), k), metric)


def codes(index: IvfIndex) -> DataFrame:
    """vec_id, list_id and the sign code that the index keeps of each residual: its norm and the number of its
    signs that are positive."""
    if index.kind != "rabitq":
        raise InvalidArgument("the index keeps no signs")

    @F.pandas_udf("int")
    def positive(code):
        return code.map(lambda c: int.from_bytes(c, "little").bit_count())

    return index.rows.select("vec_id", "list_id", "scale", positive("code").alias("positive"))


__all__ = ["IvfIndex", "assign", "build", "candidates", "codes", "extend", "kmeans_predict", "lists", "probe", "search"]
