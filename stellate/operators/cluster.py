"""Clustering: k-means, single linkage over a neighbour graph, spectral embedding and clustering.

Models (centroids, a few thousand at most) live on the driver. Single linkage and the
eigenproblem are solved there up to a number of rows, which is checked; beyond it linkage
takes Boruvka's rounds, and the eigenvectors come from a filtered subspace iteration whose
vectors stay in buckets of rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stellate.functions.metrics import RANK_DIGITS, InvalidArgument
from stellate.operators.blocks import matrix, vectors
from stellate.operators.knn import all_neighbors
from stellate.sources.shared import checkpointed

#: Rows of a dense eigenproblem, and links or rows of a single linkage, that the driver takes.
DENSE_ROWS, LINKAGE_LINKS = 5000, 2_000_000
#: Subspace iteration: rows of a bucket, vectors besides those asked for, degree of the filter, rounds and residual.
BUCKET_ROWS, SPARE, DEGREE, ROUNDS, RESIDUAL = 4096, 8, 12, 100, 1e-6


def nearest_centre(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the nearest centre (the first of equals) and the squared distance."""
    d = np.empty((len(x), len(centres)))
    for c, centre in enumerate(centres):
        d[:, c] = ((x - centre) ** 2).sum(1)
    at = np.round(d, RANK_DIGITS).argmin(1)
    return at, d[np.arange(len(x)), at]


def first_rows(rows: DataFrame, k: int) -> np.ndarray:
    """The k rows of smallest id, as the first centroids; fewer if there are fewer."""
    found = rows.orderBy("id").limit(k).collect()
    return np.array([r["v"] for r in found], float)


def lloyd(rows: DataFrame, books: np.ndarray, iterations: int) -> np.ndarray:
    """Lloyd's iterations for the centroids [parts, k, width] of consecutive slices of the vectors `v`.
    An empty cluster keeps its centroid. Each task sends one sum per cluster."""
    spark = rows.sparkSession
    parts, k, width = books.shape
    rows = rows.select("v").persist()  # each iteration reads them again; what memory doesn't hold goes to disk
    for _ in range(iterations):
        shipped = spark.sparkContext.broadcast(books)

        def sums(batches):
            books = shipped.value  # noqa: B023
            total, count = np.zeros((parts * k, width)), np.zeros(parts * k, np.int64)
            for batch in batches:
                if batch.num_rows:
                    x = matrix(batch.column(0))
                    for m in range(parts):
                        y = x[:, m * width : (m + 1) * width]
                        at = m * k + nearest_centre(y, books[m])[0]
                        np.add.at(total, at, y)
                        count += np.bincount(at, minlength=parts * k)
            used = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(count[used]), pa.array(list(total[used]), pa.list_(pa.float64()))], names=["cluster", "n", "total"])

        sent = rows.select("v").mapInArrow(sums, "cluster bigint, n bigint, total array<double>")
        # Partial sums meet by cluster and place, so no task holds more than sums.
        by_place = sent.select("cluster", "n", F.posexplode("total").alias("place", "x")).groupBy("cluster", "place").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
        means = by_place.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("place", (F.col("x") / F.col("n")).alias("m")))).alias("c")).collect()
        books = books.copy()
        for row in means:
            books[row["cluster"] // k, row["cluster"] % k] = [e["m"] for e in row["c"]]
    rows.unpersist()
    return books


def kmeans_fit(data: DataFrame, k: int, iterations: int = 12, start: np.ndarray | None = None) -> np.ndarray:
    """Centroids after Lloyd's iterations from the rows of smallest id; k beyond the number of rows is clamped."""
    if k < 1 or iterations < 0:
        raise InvalidArgument("k must be positive, iterations not negative")
    rows = vectors(data)
    centres = first_rows(rows, k) if start is None else start
    return lloyd(rows, centres[None], iterations)[0] if len(centres) else centres


def kmeans_predict(data: DataFrame, centres: np.ndarray) -> DataFrame:
    """vec_id, cluster and the squared distance to its centroid."""
    shipped = data.sparkSession.sparkContext.broadcast(centres)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                at, d = nearest_centre(matrix(batch.column(1)), shipped.value)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at.astype(np.int32)), pa.array(d)], names=["vec_id", "cluster", "distance"])

    return vectors(data).mapInArrow(run, "vec_id bigint, cluster int, distance double")


def slink_edges(data: DataFrame, neighbours: int = 8, symmetric: bool = False) -> DataFrame:
    """a, b, distance of single linkage: pairs of which the smaller id lists the larger among its nearest
    (with `symmetric`, either the other)."""
    graph = all_neighbors(data, neighbours, "l2")
    if symmetric:
        return graph.select(F.least("qid", "vec_id").alias("a"), F.greatest("qid", "vec_id").alias("b"), "distance").distinct()
    return graph.where("vec_id > qid").select(F.col("qid").alias("a"), F.col("vec_id").alias("b"), "distance")


def slink_labels(data: DataFrame, clusters: int, neighbours: int = 8, symmetric: bool = False) -> DataFrame:
    """vec_id and label: links by distance, then ids, join parts until `clusters` are left or links end.
    Labels are numbered by smallest id."""
    edges = checkpointed(slink_edges(data, neighbours, symmetric))
    nodes = checkpointed(vectors(data).select("id").distinct())
    if max(edges.count(), nodes.count()) > LINKAGE_LINKS:
        return _linked(nodes, edges, clusters)
    found = edges.orderBy("distance", "a", "b").collect()
    ids = sorted({x for r in found for x in (r["a"], r["b"])} | {r["id"] for r in nodes.collect()})
    parent, left = {x: x for x in ids}, len(ids)

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for r in found:
        if left <= clusters:
            break
        a, b = root(r["a"]), root(r["b"])
        if a != b:
            parent[max(a, b)], left = min(a, b), left - 1
    number: dict[int, int] = {}
    rows = [(x, number.setdefault(root(x), len(number))) for x in ids]
    return data.sparkSession.createDataFrame(rows, "vec_id bigint, label int")


def _anew(df: DataFrame) -> DataFrame:
    """df, computed once, without the plan's estimate of its size: joins multiply those, and over rounds of
    joins the planner would come to numbers of millions of digits."""
    kept, spark = checkpointed(df), df.sparkSession
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(kept._jdf.queryExecution().toRdd(), kept._jdf.schema(), False), spark)


def forest(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The least spanning forest of `edges` by distance, then ids, in Boruvka's rounds; and id and part of each of `nodes`."""
    parts, picked = _anew(nodes.select("id", F.col("id").alias("part"))), None
    live = edges.select("distance", "a", "b", F.col("a").alias("x"), F.col("b").alias("y"))
    while True:
        both = live.unionByName(live.select("distance", "a", "b", F.col("y").alias("x"), F.col("x").alias("y")))
        least = _anew(both.groupBy("x").agg(F.min(F.struct("distance", "a", "b", "y")).alias("e")).select("x", "e.*"))
        mine = least.select("distance", "a", "b").distinct()
        picked = mine if picked is None else _anew(picked.unionByName(mine))
        if least.isEmpty():
            return picked, parts
        # Every part points at another; of two that point at each other the lesser is the root.
        back = least.select(F.col("x").alias("y"), F.col("y").alias("z"))
        up = _anew(least.join(back, "y").select("x", F.when((F.col("z") == F.col("x")) & (F.col("x") < F.col("y")), F.col("x")).otherwise(F.col("y")).alias("y")))
        while True:
            on = up.select(F.col("x").alias("y"), F.col("y").alias("z"))
            up = _anew(up.join(on, "y").select("x", F.col("z").alias("y"), (F.col("z") != F.col("y")).alias("moved")))
            if up.where("moved").isEmpty():
                break
            up = up.drop("moved")
        to = up.select("x", F.col("y").alias("to"))
        parts = _anew(parts.join(to, parts["part"] == to["x"], "left").select("id", F.coalesce("to", "part").alias("part")))
        first, second = to.select("x", F.col("to").alias("p")), to.select(F.col("x").alias("y"), F.col("to").alias("q"))
        live = _anew(live.join(first, "x").join(second, "y").where("p <> q").select("distance", "a", "b", F.col("p").alias("x"), F.col("q").alias("y")))


def _linked(nodes: DataFrame, edges: DataFrame, clusters: int) -> DataFrame:
    """Labels of single linkage without the driver: the forest, less its longest links, so that `clusters` are left."""
    tree, parts = forest(nodes, edges)
    rows, links = nodes.count(), tree.count()
    over = min(links, max(0, clusters - (rows - links)))
    if over:
        longest = tree.orderBy(F.desc("distance"), F.desc("a"), F.desc("b")).limit(over)
        parts = forest(nodes, tree.join(longest.select("a", "b"), ["a", "b"], "left_anti"))[1]
    least = parts.groupBy("part").agg(F.min("id").alias("least"))
    number = least.orderBy("least").rdd.zipWithIndex().map(lambda r: (r[0]["part"], r[1])).toDF("part bigint, label bigint")
    return parts.join(number, "part").select(F.col("id").alias("vec_id"), F.col("label").cast("int").alias("label"))


def affinity(data: DataFrame, neighbours: int = 8) -> DataFrame:
    """i, j, weight of the symmetric neighbour graph: exp(-d / 2 s), where s is the mean squared distance."""
    graph = all_neighbors(data, neighbours, "l2").select(F.col("qid").alias("i"), F.col("vec_id").alias("j"), F.col("distance").alias("d"))
    graph = checkpointed(graph)
    mean = max(graph.agg(F.avg("d")).first()[0] or 0.0, 1e-12)
    weighted = graph.select("i", "j", F.exp(-F.col("d") / (2 * mean)).alias("w"))
    both = weighted.unionByName(weighted.select(F.col("j").alias("i"), F.col("i").alias("j"), "w"))
    return both.groupBy("i", "j").agg(F.max("w").alias("weight"))


def degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy("i").agg(F.sum("weight").alias("degree"), F.count("*").alias("links"))


def spectral_embedding(data: DataFrame, parts: int, neighbours: int = 8) -> DataFrame:
    """id and v: the eigenvectors of the `parts` least eigenvalues of the normalised Laplacian.
    The sign of each is such that its largest component is positive."""
    edges = checkpointed(affinity(data, neighbours))
    rows = edges.select("i").distinct().count()
    if rows > DENSE_ROWS:
        return _subspace(edges, rows, parts)
    found = edges.collect()
    ids = np.array(sorted({r["i"] for r in found}), np.int64)
    at = {x: n for n, x in enumerate(ids)}
    w = np.zeros((len(ids), len(ids)))
    for r in found:
        w[at[r["i"]], at[r["j"]]] = r["weight"]
    scale = 1 / np.sqrt(np.maximum(w.sum(1), 1e-12))
    _, z = np.linalg.eigh(np.eye(len(ids)) - scale[:, None] * w * scale[None])
    z = z[:, :parts]
    z = z * np.where(z[np.abs(z).argmax(0), np.arange(z.shape[1])] < 0, -1.0, 1.0)
    return data.sparkSession.createDataFrame([(int(i), row.tolist()) for i, row in zip(ids, z)], "id bigint, v array<double>")


STATE = "bucket int, id bigint, js binary, ws binary, prev binary, cur binary"


def _stack(column, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), float).reshape(-1, width)


def _product(state: DataFrame, buckets: int, width: int, own: float, by: float, old: float, turn: np.ndarray | None = None) -> DataFrame:
    """State whose `cur` is by S cur + own cur + old prev, and `prev` the former cur. Rows send their cur to the buckets of their neighbours.
    With `turn`, cur is prev times it first."""

    def send(batches):
        for batch in batches:
            if turn is not None and batch.num_rows:
                x = _stack(batch.column("prev"), width) @ turn
                batch = batch.set_column(5, "cur", pa.array([r.tobytes() for r in x], pa.binary()))
            yield batch
            target, source = [], []
            for n, (mine, js) in enumerate(zip(batch.column("bucket").to_pylist(), batch.column("js").to_pylist())):
                to = np.unique(np.frombuffer(js, np.int64) % buckets)
                to = to[to != mine]
                target.append(to)
                source.append(np.full(len(to), n))
            if target:
                source = pa.array(np.concatenate(source))
                none = pa.nulls(len(source), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(target), pa.int32()), batch.column("id").take(source), none, none, none, batch.column("cur").take(source)], names=batch.schema.names)

    def multiply(table):
        here = table.filter(pa.compute.is_valid(table["js"]))
        if not here.num_rows:
            return here
        ids, x = table["id"].to_numpy(), _stack(table["cur"], width)
        order = np.argsort(ids)
        js = [np.frombuffer(j, np.int64) for j in here["js"].to_pylist()]
        w = np.frombuffer(b"".join(here["ws"].to_pylist()), float)
        at = order[np.searchsorted(ids, np.concatenate(js), sorter=order)]
        starts = np.cumsum([0, *(len(j) for j in js[:-1])])
        new = by * np.add.reduceat(w[:, None] * x[at], starts)
        cur = _stack(here["cur"], width)
        new = new + own * cur + (old * _stack(here["prev"], width) if old else 0)
        new = pa.array([r.tobytes() for r in new], pa.binary())
        return pa.table([here["bucket"], here["id"], here["js"], here["ws"], here["cur"], new], names=table.column_names)

    return state.mapInArrow(send, STATE).groupBy("bucket").applyInArrow(multiply, STATE)


def _grams(state: DataFrame, width: int) -> np.ndarray:
    """Of X (prev) and SX (cur): X'X, X'SX and (SX)'(SX), summed by task."""

    def run(batches):
        total = np.zeros((3, width, width))
        for batch in batches:
            if batch.num_rows:
                x, y = _stack(batch.column(0), width), _stack(batch.column(1), width)
                total += np.stack([x.T @ x, x.T @ y, y.T @ y])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["g"])

    return sum(np.frombuffer(r["g"], float).reshape(3, width, width) for r in state.select("prev", "cur").mapInArrow(run, "g binary").collect())


def _subspace(edges: DataFrame, rows: int, parts: int) -> DataFrame:
    """The eigenvectors by Chebyshev-filtered subspace iteration on S = D^-1/2 W D^-1/2, until all residuals are below RESIDUAL."""
    width, buckets = min(rows, parts + SPARE), -(-rows // BUCKET_ROWS)
    d = checkpointed(degrees(edges).select(F.col("i").alias("id"), F.greatest("degree", F.lit(1e-12)).alias("d")))
    scaled = edges.join(d.select(F.col("id").alias("i"), F.col("d").alias("p")), "i").join(d.select(F.col("id").alias("j"), F.col("d").alias("q")), "j")
    lists = scaled.groupBy("i").agg(F.sort_array(F.collect_list(F.struct("j", (F.col("weight") / F.sqrt(F.col("p") * F.col("q"))).alias("w")))).alias("l"))

    def start(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            js, ws = ([np.array(v, t).tobytes() for v in batch.column(k).to_pylist()] for k, t in ((1, np.int64), (2, float)))
            x = [np.random.default_rng([5, int(i) & (1 << 63) - 1]).standard_normal(width).tobytes() for i in ids]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((ids % buckets, ids, js, ws, x, x), (pa.int32(), pa.int64(), *[pa.binary()] * 4))], names=["bucket", "id", "js", "ws", "prev", "cur"])

    state = lists.select(F.col("i").alias("id"), "l.j", "l.w").mapInArrow(start, STATE)
    state = checkpointed(_product(state, buckets, width, 0.0, 1.0, 0.0))
    for _ in range(ROUNDS):
        gram, inner, outer = _grams(state, width)
        scale, q = np.linalg.eigh(gram)
        white = q[:, ::-1] / np.sqrt(np.maximum(scale[::-1], scale[-1] * 1e-15))
        values, c = np.linalg.eigh(white.T @ inner @ white)
        values, turn = values[::-1], white @ c[:, ::-1]
        residual = [np.sqrt(max(t @ (outer - 2 * x * inner + x * x * gram) @ t, 0)) for x, t in zip(values, turn.T)]
        if max(residual[:parts]) < RESIDUAL:
            return _signed(state, turn[:, :parts])
        # Chebyshev polynomials that are small on [-1, cut], where the unwanted eigenvalues lie.
        cut = min(max(values[-1], -0.5), 1 - 1e-9)
        half, middle = (cut + 1) / 2, (cut - 1) / 2
        state = _product(state, buckets, width, -middle / half, 1 / half, 0.0, turn)
        for _ in range(DEGREE - 1):
            state = _product(state, buckets, width, -2 * middle / half, 2 / half, -1.0)
        state = checkpointed(_product(state, buckets, width, 0.0, 1.0, 0.0))
    raise RuntimeError(f"the eigenvectors' residuals are above {RESIDUAL} after {ROUNDS} rounds")


def _signed(state: DataFrame, turn: np.ndarray) -> DataFrame:
    """id and v = prev times `turn`, each column with its largest component positive (of equals, that of the least id)."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = _stack(batch.column(1), len(turn)) @ turn
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x), pa.list_(pa.float64()))], names=["id", "v"])

    z = checkpointed(state.select("id", "prev").mapInArrow(run, "id bigint, v array<double>"))
    tops = z.agg(*(F.max(F.struct(F.abs(F.col("v")[c]), -F.col("id"), F.col("v")[c].alias("x")))["x"].alias(f"c{c}") for c in range(turn.shape[1]))).first()
    signs = F.array(*(F.lit(-1.0 if x < 0 else 1.0) for x in tops))
    return z.select("id", F.zip_with("v", signs, lambda x, y: x * y).alias("v"))


def spectral_clusters(data: DataFrame, clusters: int, neighbours: int = 8, iterations: int = 12) -> DataFrame:
    """vec_id and label: k-means over the spectral embedding, from rows that lie far apart."""
    z = checkpointed(spectral_embedding(data, clusters, neighbours))
    rows, centres = z.count(), first_rows(z, 1)
    while len(centres) < min(clusters, rows):
        far = F.array_min(F.array(*(F.aggregate(F.zip_with("v", F.array(*map(F.lit, map(float, c))), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x) for c in centres)))
        centres = np.vstack([centres, z.orderBy(F.desc(far), "id").first()["v"]])
    centres = lloyd(z, centres[None], iterations)[0] if len(centres) else centres
    return kmeans_predict(z.select(F.col("id").alias("vec_id"), F.col("v").alias("embedding")), centres).select("vec_id", F.col("cluster").alias("label"))
