"""Neighbour graphs: refinement by neighbours of neighbours, detour pruning, robust pruning.

Edges are rows (src, rank from 0, dst). Pruning by detours is joins and ranks alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stellate.functions.metrics import InvalidArgument, column, exact, rough
from stellate.operators.blocks import pack, paired, ranked, unpack, vectors, within
from stellate.operators.knn import all_neighbors
from stellate.sources.shared import checkpointed

#: Up to so many rows the neighbour graph is exact.
EXACT_ROWS = 4096


def knn_graph(data: DataFrame, degree: int = 16) -> DataFrame:
    """The exact graph as edges."""
    return all_neighbors(data, degree, "l2").select(F.col("qid").alias("src"), (F.col("rank") - 1).alias("rank"), F.col("vec_id").alias("dst"))


def nn_descent(data: DataFrame, degree: int = 16, iterations: int = 6, least_change: float = 1e-4, exact_rows: int = EXACT_ROWS, shard_rows: int = 20_000) -> DataFrame:
    """A neighbour graph as edges. Few rows are compared exactly. Else a random start is improved within shards: each
    row meets its neighbours' neighbours, both ways, and keeps the nearest, until few edges change. Each row then walks
    the graphs of the other shards. Shards meet as wholes, so only edges are shuffled, which hold their distances as `d`."""
    from stellate.operators import walk

    rows = vectors(data)
    if rows.count() <= exact_rows:
        return knn_graph(data, degree)
    index = checkpointed(walk.sharded(rows, degree, shard_rows, lambda x: walk.descended(x, degree, iterations, exact_rows, least_change)))
    edges = index.select("dim", "ids", "matrix", "graph").mapInArrow(_measured_edges, "src bigint, dst bigint, d double")
    if index.count() > 1:
        asking = index.select(*(F.col(c).alias(f"q_{c}") for c in ("shard", "dim", "ids", "matrix")))
        pairs = asking.crossJoin(index).where("shard <> q_shard").select("q_dim", "q_ids", "q_matrix", "dim", "ids", "matrix", "graph")
        edges = edges.unionByName(pairs.mapInArrow(lambda batches: _walked_edges(batches, degree), "src bigint, dst bigint, d double"))
    by = Window.partitionBy("src").orderBy(F.round("d", 9), "dst")
    return checkpointed(edges.withColumn("rank", F.row_number().over(by) - 1).where(f"rank < {degree}").select("src", "rank", "dst", "d"))


def _sent(parts: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts)], names=["src", "dst", "d"])


def _measured_edges(batches):
    for batch in batches:
        for r in batch.to_pylist():
            ids, x = unpack(r["ids"], r["matrix"], r["dim"])
            graph, out = np.frombuffer(r["graph"], np.int32).reshape(len(ids), -1), []
            for n, row in enumerate(graph):
                row = row[row >= 0]
                out.append((np.full(len(row), ids[n]), ids[row], exact("l2", x[n], x[row])))
            yield _sent(out)


def _walked_edges(batches, degree: int):
    """Of each row of a shard its nearest ones in another, as walks find them in that one's graph, taken both ways."""
    from stellate.operators.walk import pointing, walks

    for batch in batches:
        for r in batch.to_pylist():
            (qids, q), (ids, x) = unpack(r["q_ids"], r["q_matrix"], r["q_dim"]), unpack(r["ids"], r["matrix"], r["dim"])
            if q.shape[1] != x.shape[1]:
                raise InvalidArgument("vectors differ in length")
            graph, out = np.frombuffer(r["graph"], np.int32).reshape(len(ids), -1), []
            for qid, (at, d, _) in zip(qids, walks(q, x, np.hstack([graph, pointing(graph, degree)]), "l2", 2 * degree, 2)):
                near = np.lexsort((ids[at], np.round(d, 9)))[:degree]
                out.append((np.full(len(near), qid), ids[at[near]], d[near]))
            yield _sent(out)


def completed(edges: DataFrame, data: DataFrame, degree: int = 16) -> DataFrame:
    """A graph of `data` made exact: each row's farthest neighbour in `edges` bounds how far its nearest rows lie, and
    all rows within that bound are measured, block by block. The nearer the graph was, the fewer these are. Edges may
    hold their distances as `d`, which are else measured."""
    rows = vectors(data)
    far = edges
    if "d" not in edges.columns:
        x = rows.select(F.col("id").alias("src"), F.col("v").alias("x"))
        far = edges.join(x, "src").join(rows.select(F.col("id").alias("dst"), F.col("v").alias("y")), "dst").select("src", column("l2", F.col("x"), F.col("y")).alias("d"))
    # A row with fewer edges than asked for has no bound.
    bounds = far.groupBy("src").agg(F.when(F.count("*") >= degree, F.max("d")).otherwise(F.lit(1e300)).alias("bound"))
    asked = rows.join(bounds.withColumnRenamed("src", "id"), "id", "left").select("id", F.concat("v", F.array(F.coalesce("bound", F.lit(1e300)))).alias("v"))
    # Pairs of partitions are computed one by one, and would compute their blocks each time.
    found = ranked(within(paired(checkpointed(pack(asked)), checkpointed(pack(rows))), degree), degree)
    return found.select(F.col("qid").alias("src"), (F.col("rank") - 1).alias("rank"), F.col("vec_id").alias("dst"))


def check_full(edges: DataFrame) -> None:
    """Raises unless every row has as many distinct neighbours as the others, none of them itself."""
    per = edges.groupBy("src").agg(F.count("*").alias("n"), F.countDistinct("dst").alias("d"), F.countDistinct("rank").alias("r"), F.max(F.col("src") == F.col("dst")).alias("own"))
    found = per.agg(F.min("n").alias("a"), F.max("n").alias("b"), F.max(F.col("d") < F.col("n")).alias("x"), F.max(F.col("r") < F.col("n")).alias("y"), F.max("own").alias("z")).first()
    if found["a"] != found["b"] or found["x"] or found["y"] or found["z"]:
        raise InvalidArgument("rows of a graph must be full, unique and without themselves")


def detours(edges: DataFrame) -> DataFrame:
    """src, rank, dst and how many better-ranked neighbours list dst at a better rank."""
    better = edges.select("src", F.col("rank").alias("via_rank"), F.col("dst").alias("via"))
    beyond = edges.select(F.col("src").alias("via"), F.col("rank").alias("last_rank"), "dst")
    ways = edges.join(better, "src").where("via_rank < rank").join(beyond, ["via", "dst"]).where("last_rank < rank")
    counted = ways.groupBy("src", "rank", "dst").agg(F.count("*").alias("detours"))
    return edges.join(counted, ["src", "rank", "dst"], "left").select("src", "rank", "dst", F.coalesce("detours", F.lit(0)).alias("detours"))


def optimize(edges: DataFrame, degree: int) -> DataFrame:
    """The graph with `degree` edges of fewest detours for each row, of which up to half give way to
    reverse edges that it lacks; both kinds alternate. node, place (from 0), dst."""
    fwd = detours(edges).withColumn("fr", F.row_number().over(Window.partitionBy("src").orderBy("detours", "rank", "dst")) - 1).where(f"fr < {degree}").select("src", "dst", "fr")
    back = fwd.select(F.col("dst").alias("node"), F.col("src").alias("s"), "fr").join(fwd.select(F.col("src").alias("node"), F.col("dst").alias("s")), ["node", "s"], "left_anti")
    back = back.withColumn("rr", F.row_number().over(Window.partitionBy("node").orderBy("fr", "s")) - 1)
    taken = back.groupBy("node").agg(F.least(F.lit(degree // 2), F.count("*")).alias("t"))
    kept = fwd.join(taken, fwd["src"] == taken["node"], "left").where(F.col("fr") < degree - F.coalesce("t", F.lit(0)))
    ahead = kept.select(F.col("src").alias("node"), "dst", F.col("fr").alias("p"), F.lit(0).alias("kind"))
    turned = back.join(taken, "node").where("rr < t").select("node", F.col("s").alias("dst"), F.col("rr").alias("p"), F.lit(1).alias("kind"))
    place = F.row_number().over(Window.partitionBy("node").orderBy("p", "kind")) - 1
    return ahead.unionByName(turned).select("node", place.alias("place"), "dst")


def robust_prune(node: np.ndarray, near: np.ndarray, ids: np.ndarray, degree: int, alpha: float = 1.2) -> list[int]:
    """Of a node's candidates, by distance and id, each that no kept one is alpha times nearer to than the node is."""
    d = ((near - node) ** 2).sum(1)
    covers = alpha * rough("l2", near, near) <= d[None, :] + 1e-12
    kept: list[int] = []
    covered = np.zeros(len(d), bool)
    for c in np.lexsort((ids, np.round(d, 9))):
        if len(kept) == degree:
            break
        if not covered[c]:
            kept.append(int(c))
            covered |= covers[c]
    return kept
