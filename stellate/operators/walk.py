"""Search in neighbour graphs by greedy walks, over shards.

An index is one row per shard: a bounded number of vectors chosen by a hash of their
ids, their ids and their graph. A search pairs blocks of queries with shards, walks each
shard for each query, and merges the best k. So a task holds one shard, whatever the
size of the data; nothing is broadcast. Walks begin at places that follow from a query's
bits alone, so results don't depend on batches.

Tombstoned and filtered rows are walked through, but never returned. A graph may hold
product codes of its vectors, and may then do without the vectors: walks measure what the
codes stand for, and the best rows are measured again where vectors are there. Rows that
come in or change are linked into the graph of their shard, which keeps its size in shards.
"""

from __future__ import annotations

from bisect import insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stellate.functions.metrics import InvalidArgument, check_metric, exact, rough, seed_ids, seed_places
from stellate.operators.blocks import check_k, matrix, pack, ranked, unpack, vectors
from stellate.operators.cluster import nearest_centre
from stellate.operators.graph import EXACT_ROWS, robust_prune
from stellate.operators.ivf import may_reach
from stellate.operators.knn import shown
from stellate.operators.quantize import check_codes, pq_codes, pq_fit

#: Vectors of a shard, in the mean.
SHARD_ROWS = 20_000
#: `shards` is the number that ids are dealt over, some of which may be empty.
SCHEMA = "shard bigint, shards bigint, dim int, degree int, ids binary, matrix binary, graph binary"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]


def _least(d: np.ndarray, m: int) -> np.ndarray:
    """Places of the m least values of each row, by value, then place; rows are sorted no further than that."""
    if not 0 < m < d.shape[1]:
        return np.argsort(d, axis=1, kind="stable")[:, :m]
    out, limit = np.empty((len(d), m), np.int64), np.partition(d, m - 1, axis=1)[:, m - 1]
    for n, row in enumerate(d):
        at = np.flatnonzero(row <= limit[n])
        out[n] = at[np.argsort(row[at], kind="stable")[:m]]
    return out


def neighbours(x: np.ndarray, degree: int) -> np.ndarray:
    """The nearest other rows of each row, by distance, then place; -1 where there are too few."""
    n, out = len(x), np.full((len(x), degree), -1, np.int32)
    m = min(degree, n - 1)
    for i in range(0, n, 512):
        d = np.round(rough("l2", x[i : i + 512], x), 9)
        d[np.arange(len(d)), np.arange(i, i + len(d))] = np.inf
        out[i : i + 512, :m] = _least(d, m)
    return out


def _nearest_of(x: np.ndarray, near: np.ndarray, degree: int) -> np.ndarray:
    """Of the candidates of each row, which may repeat and hold the row itself or -1, the nearest others."""
    out, norm = np.full((len(x), degree), -1, np.int32), (x * x).sum(1)
    for i in range(0, len(x), 64):
        c = np.sort(near[i : i + 64], axis=1)
        own = x[i : i + 64]
        d = np.round(np.maximum(norm[c] + norm[i : i + 64, None] - 2.0 * np.matmul(x[c], own[:, :, None])[:, :, 0], 0.0), 9)
        d[:, 1:][c[:, 1:] == c[:, :-1]] = np.inf
        d[(c == np.arange(i, i + len(c))[:, None]) | (c < 0)] = np.inf
        order = _least(d, degree)
        found = np.where(np.isfinite(np.take_along_axis(d, order, 1)), np.take_along_axis(c, order, 1), -1)
        out[i : i + 64, : found.shape[1]] = found
    return out


def pointing(graph: np.ndarray, most: int) -> np.ndarray:
    """The first `most` rows that point to each row; -1 where there are fewer."""
    src, dst = np.repeat(np.arange(len(graph)), graph.shape[1]), graph.ravel()
    src, dst = src[dst >= 0], dst[dst >= 0]
    order = np.argsort(dst, kind="stable")
    src, dst = src[order], dst[order]
    place = np.arange(len(dst)) - np.searchsorted(dst, dst)
    out = np.full((len(graph), most), -1, np.int32)
    out[dst[place < most], place[place < most]] = src[place < most]
    return out


def descended(x: np.ndarray, degree: int, turns: int = 6, exact_rows: int = EXACT_ROWS, least_change: float = 1e-4) -> np.ndarray:
    """neighbours() by descent: few rows are compared exactly, else a random start meets neighbours' neighbours."""
    n = len(x)
    if n <= max(exact_rows, degree + 1):
        return neighbours(x, degree)
    rng = np.random.default_rng(n)
    deal, ahead = rng.permutation(n), rng.choice(n - 1, degree, replace=False) + 1
    graph = np.empty((n, degree), np.int32)
    graph[deal] = deal[(np.arange(n)[:, None] + ahead) % n]
    for _ in range(turns):
        around = np.hstack([graph, pointing(graph, degree)])
        met = np.where(around[:, :, None] >= 0, graph[around], -1).reshape(n, -1)
        new = _nearest_of(x, np.hstack([around, met]), degree)
        changed = (~(new[:, :, None] == graph[:, None, :]).any(2)).mean()
        graph = new
        if changed < least_change:
            break
    return graph


def searched(x: np.ndarray, degree: int, exact_rows: int = EXACT_ROWS, rounds: int = 2) -> np.ndarray:
    """neighbours() by descent, then by walks for every row in the graph so far."""
    graph = descended(x, degree, 4, exact_rows)
    for _ in range(rounds):
        near = np.full((len(x), degree), -1, np.int32)
        for i, (at, d, _) in enumerate(walks(x, x, graph, "l2", 2 * degree, 2)):
            at, d = at[at != i], d[at != i]
            best = at[np.lexsort((at, np.round(d, 9)))[:degree]]
            near[i, : len(best)] = best
        graph = near
    return graph


def _means(x: np.ndarray, k: int, turns: int) -> np.ndarray:
    centres = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(turns):
        at = nearest_centre(x, centres)[0]
        for c in np.unique(at):
            centres[c] = x[at == c].mean(0)
    return centres


def coded(x: np.ndarray, degree: int) -> np.ndarray:
    """neighbours() by product codes of the residuals to a few centres, with the nearest found put in exact order."""
    n, dim = x.shape
    parts = max(c for c in range(1, 5) if dim % c == 0)
    centres = _means(x, max(2, min(8, n // 4)), 12)
    y = centres[nearest_centre(x, centres)[0]]
    rest = x - y
    for sub in np.split(np.arange(dim), parts):
        book = _means(rest[:, sub], 256, 8)
        y[:, sub] += book[nearest_centre(rest[:, sub], book)[0]]
    near = np.full((n, min(degree + 1, n)), -1, np.int32)
    for i in range(0, n, 512):
        near[i : i + 512] = _least(np.round(rough("l2", x[i : i + 512], y), 9), near.shape[1])
    return _nearest_of(x, near, degree)


#: How the graph that is pruned comes about. A shard is small enough for the exact one, which is the usual.
FIRST = {"exact": neighbours, "nn_descent": descended, "ivf_pq": coded, "iterative": searched}


def prune_detours(graph: np.ndarray, degree: int) -> np.ndarray:
    """Detour pruning with reverse edges of one shard's graph, as operators.graph.optimize does it for edges."""
    n, first = graph.shape
    ahead, places = [], np.arange(first)
    for row in graph:
        found = row[row >= 0]
        m = len(found)
        same = graph[found][:, :, None] == found[None, None, :]  # via, its rank, neighbour
        rank = np.where(same.any(axis=1), same.argmax(axis=1), first)
        ways = ((rank < places[None, :m]) & (places[:m, None] < places[None, :m])).sum(axis=0)
        ahead.append(found[np.lexsort((found, places[:m], ways))][:degree].tolist())
    back: list[list] = [[] for _ in range(n)]
    for x, row in enumerate(ahead):
        for r, y in enumerate(row):
            if x not in ahead[y]:
                back[y].append((r, x))
    out = np.full((n, degree), -1, np.int32)
    for x in range(n):
        turned = [y for _, y in sorted(back[x])][: degree // 2]
        kept = ahead[x][: degree - len(turned)]
        row = [y for k in range(max(len(kept), len(turned))) for y in (*kept[k : k + 1], *turned[k : k + 1])]
        out[x, : len(row)] = row
    return out


def prune_robustly(x: np.ndarray, graph: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    out = np.full((len(x), degree), -1, np.int32)
    for n, row in enumerate(graph):
        near = row[row >= 0]
        kept = near[robust_prune(x[n], x[near], near, degree, alpha)]
        out[n, : len(kept)] = kept
    return out


def _row(shard: int, shards: int, degree: int, ids: np.ndarray, x: np.ndarray, graph: np.ndarray) -> pa.Table:
    row = (shard, shards, x.shape[1], degree, ids.tobytes(), x.tobytes(), graph.tobytes())
    return pa.table([pa.array([c], t) for c, t in zip(row, TYPES)], names=NAMES)


def sharded(rows: DataFrame, degree: int, shard_rows: int, made) -> DataFrame:
    """Shards of `rows` (id, v), each with the graph that `made` gives for its vectors, which are in the order of ids."""
    shards = max(1, -(-rows.count() // shard_rows))
    # Spark would join small partitions of its own choice, and one task would make all graphs; it keeps a number given.
    rows = rows.select(F.pmod(F.xxhash64("id"), F.lit(shards)).alias("shard"), "id", "v").repartition(4 * shards if shards > 1 else 1, "shard")

    def shard(key, table):
        table = table.sort_by("id")
        ids, x = table["id"].to_numpy(), matrix(table["v"])
        if not np.isfinite(x).all():
            raise InvalidArgument("a graph takes finite vectors only")
        return _row(key[0].as_py(), shards, degree, ids, x, made(x))

    return rows.groupBy("shard").applyInArrow(shard, SCHEMA)


def build(data: DataFrame, kind: str = "cagra", degree: int = 16, first_degree: int = 32, alpha: float = 1.2, shard_rows: int = SHARD_ROWS, first: str = "exact") -> DataFrame:
    """A graph index of `data`: detour pruning (cagra, and hnsw's base layer) or robust pruning (vamana),
    of a `first` graph that is exact or found in another way."""
    if kind not in ("cagra", "hnsw", "vamana") or first not in FIRST:
        raise InvalidArgument(f"unknown kind {kind!r} or first graph {first!r}")
    alpha = alpha if alpha > 0 else 1.2

    def made(x):
        graph = FIRST[first](x, min(2 * degree if kind == "vamana" else first_degree, max(len(x) - 1, 1)))
        return prune_robustly(x, graph, degree, alpha) if kind == "vamana" else prune_detours(graph, degree)

    return sharded(vectors(data), degree, shard_rows, made)


def walk(q: np.ndarray, x: np.ndarray, graph: np.ndarray, metric: str, keep: int, width: int) -> tuple[dict[int, float], int]:
    """Distances of the rows that a greedy walk saw, and its turns: it expands the `width` best open rows
    of the best `keep` until none is open, for a bounded number of turns."""
    seen: dict[int, float] = {}
    best: list[tuple[float, int]] = []  # sorted, at most `keep`

    def see(new):
        d = exact(metric, q, x[new])
        seen.update(zip(new, d.tolist()))
        for entry in zip(np.round(d, 9).tolist(), new):
            if len(best) < keep or entry < best[-1]:
                insort(best, entry)
                del best[keep:]

    see(seed_ids(q, len(x), max(32, width)).tolist())
    expanded: set[int] = set()
    turns, most = 0, max(24, 6 * keep)
    while turns < most:
        open_ = [i for _, i in best if i not in expanded][:width]
        if not open_:
            break
        turns += 1
        expanded.update(open_)
        new = [i for i in dict.fromkeys(graph[open_].ravel().tolist()) if i >= 0 and i not in seen]
        if new:
            see(new)
    return seen, turns


#: Queries that walk a shard together, and their seen rows' distances, are this many numbers at most.
TOGETHER = 2_500_000


def walks(q: np.ndarray, x: np.ndarray, graph: np.ndarray, metric: str, keep: int, width: int):
    """walk() of each row of q: the places and distances of the rows it saw, and its turns. The walks of squared or plain
    L2 distances take their turns together; one that has ended waits. Of equally far rows those seen before come first.
    Rows that are too far for the best `keep` are told by rough products and have rough distances."""
    n, step = len(x), max(1, TOGETHER // max(1, len(x)))
    if metric not in ("l2", "l2sqrt"):
        for v in q:
            seen, turns = walk(v, x, graph, metric, keep, width)
            yield np.fromiter(seen, np.int64, len(seen)), np.fromiter(seen.values(), float, len(seen)), turns
        return
    short, norm = x.astype("f4"), (x * x).sum(1)
    far = np.empty((min(step, len(q)), n))
    for i in range(0, len(q), step):
        v = q[i : i + step]
        m, short_v, norm_v = len(v), v.astype("f4"), (v * v).sum(1)
        met = np.zeros((m, n), bool)
        # The best rows so far of each walk, by distance; n stands for none.
        best_d, best, done, turns = np.full((m, keep), np.inf), np.full((m, keep), n), np.ones((m, keep), bool), np.zeros(m, int)

        def distinct(keys):
            keys = np.sort(keys, axis=None)
            return np.divmod(keys[np.diff(keys, prepend=-1) > 0], n)

        def see(row, at):
            """Of each walk in `row`, which is in order, the rows `at`, which it has not met."""
            total = norm[at] + norm_v[row]
            d = np.maximum(total - 2.0 * np.einsum("ij,ij->i", short[at], short_v[row]), 0.0)
            limit = best_d[row, -1] if metric == "l2" else best_d[row, -1] ** 2
            near = ~(d > limit + 1e-5 * total)
            far[row, at], met[row, at] = d if metric == "l2" else np.sqrt(d), True
            row, at = row[near], at[near]
            d = ((x[at] - v[row]) ** 2).sum(1)
            d = d if metric == "l2" else np.sqrt(d)
            far[row, at] = d
            d = np.round(d, 9)
            near = d < best_d[row, -1]
            row, at, d = row[near], at[near], d[near]
            if not len(row):
                return
            first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            many = np.diff(np.r_[first, len(row)])
            some, place = row[first], np.arange(len(row)) - np.repeat(first, many)
            which = np.repeat(np.arange(len(some)), many)
            new_d, new = np.full((len(some), many.max()), np.inf), np.full((len(some), many.max()), n)
            new_d[which, place], new[which, place] = d, at
            all_d = np.hstack([best_d[some], new_d])
            order = np.argsort(all_d, axis=1, kind="stable")[:, :keep]
            best_d[some] = np.take_along_axis(all_d, order, 1)
            best[some] = np.take_along_axis(np.hstack([best[some], new]), order, 1)
            done[some] = np.take_along_axis(np.hstack([done[some], new == n]), order, 1)

        see(*distinct(np.arange(m)[:, None] * n + seed_places(v, n, max(32, width))))
        going = np.arange(m)
        for _ in range(max(24, 6 * keep)):
            open_ = ~done[going]
            going, open_ = going[open_.any(1)], open_[open_.any(1)]
            if not len(going):
                break
            turns[going] += 1
            row, at = np.nonzero(open_ & (np.cumsum(open_, axis=1) <= width))
            row = going[row]
            done[row, at] = True
            new = graph[best[row, at]]
            row, at = distinct((row[:, None] * n + new)[new >= 0])
            fresh = ~met[row, at]
            if fresh.any():
                see(row[fresh], at[fresh])
        for w in range(m):
            at = np.flatnonzero(met[w])
            yield at, far[w, at], int(turns[w])


def _shards(index: DataFrame) -> int:
    return index.agg(F.max("shards")).first()[0] or 1


def relink(x: np.ndarray, graph: np.ndarray, touched: np.ndarray, alpha: float = 1.2) -> np.ndarray:
    """The graph with new edges for the rows `touched`, whose vectors are new. Edges to them, which told where they
    lay before, go, and rows that lose most of theirs so are linked anew as well. Each row linked anew points to the
    robustly pruned ones of its nearest rows in the shard, which are found exactly, and every row among those is
    pruned anew among its own edges and the rows it is near to."""
    graph, (n, degree) = graph.copy(), graph.shape
    stale = np.isin(graph, touched)
    before = (graph >= 0).sum(1)
    graph[stale] = -1
    again = np.union1d(touched, np.flatnonzero((graph >= 0).sum(1) < (before + 1) // 2))
    named: dict[int, list[int]] = {}
    for i in range(0, len(again), 512):
        chunk = again[i : i + 512]
        d = np.round(rough("l2", x[chunk], x), 9)
        d[np.arange(len(chunk)), chunk] = np.inf
        for t, row in zip(chunk.tolist(), _least(d, min(2 * degree, n - 1))):
            kept = row[robust_prune(x[t], x[row], row, degree, alpha)]
            graph[t, : len(kept)], graph[t, len(kept) :] = kept, -1
            for y in row.tolist():
                named.setdefault(y, []).append(t)
    for y, new in sorted(named.items()):
        near = np.unique(np.r_[graph[y][graph[y] >= 0], new])
        kept = near if len(near) <= degree else near[robust_prune(x[y], x[near], near, degree, alpha)]
        graph[y, : len(kept)], graph[y, len(kept) :] = kept, -1
    return graph


def report(index: DataFrame) -> DataFrame:
    """What a build made, one row: its shards, rows, and bytes of edges, vectors and codes."""
    size = lambda c: F.coalesce(F.sum(F.length(c)), F.lit(0)).cast("bigint") if c in index.columns else F.lit(0).cast("bigint")
    rows = F.coalesce(F.sum(F.length("ids") / 8), F.lit(0)).cast("bigint")
    return index.agg(F.count("*").alias("shards"), rows.alias("n_rows"), size("graph").alias("graph_bytes"), size("matrix").alias("vector_bytes"), size("codes").alias("code_bytes"))


def extend(index: DataFrame, data: DataFrame) -> DataFrame:
    """The index with the rows of `data` (vec_id, embedding): unknown ids come in, known ones get a new vector,
    and the graphs of their shards are mended around them. Of an id that comes twice one vector is taken, the
    greatest. The number of shards stays; an index that has grown much is better built anew. Codes are left
    out, to be made again by quantize."""
    if "matrix" not in index.columns:
        raise InvalidArgument("a graph without vectors can't be extended; attach them first")
    told = index.agg(F.max("shards").alias("shards"), F.max("degree").alias("degree")).first()
    if told["shards"] is None:
        return build(data)
    shards, degree = told
    rows = vectors(data).groupBy("id").agg(F.max("v").alias("v"))
    rows = rows.select(F.pmod(F.xxhash64("id"), F.lit(shards)).alias("shard"), "id", "v")

    def mend(key, old, new):
        if not new.num_rows:
            return old
        x_new, ids_new = matrix(new["v"]), new["id"].to_numpy()
        if not np.isfinite(x_new).all():
            raise InvalidArgument("a graph takes finite vectors only")
        if old.num_rows:
            r = old.to_pylist()[0]
            ids, x = unpack(r["ids"], r["matrix"], r["dim"])
            graph = np.frombuffer(r["graph"], np.int32).reshape(len(ids), -1)
            if x.shape[1] != x_new.shape[1]:
                raise InvalidArgument("new rows differ in length")
        else:
            ids, x, graph = np.empty(0, np.int64), np.empty((0, x_new.shape[1])), np.empty((0, degree), np.int32)
        place = {i: n for n, i in enumerate(ids.tolist())}
        fresh = np.array([i not in place for i in ids_new.tolist()])
        x = np.vstack([x, x_new[fresh]])
        ids = np.r_[ids, ids_new[fresh]]
        graph = np.vstack([graph, np.full((fresh.sum(), degree), -1, np.int32)])
        place = {i: n for n, i in enumerate(ids.tolist())}
        touched = np.array(sorted(place[i] for i in ids_new.tolist()))
        for i, v in zip(ids_new.tolist(), x_new):
            x[place[i]] = v
        graph = relink(x, graph, touched)
        return _row(key[0].as_py(), shards, degree, ids, x, graph)

    return index.select(*NAMES).groupBy("shard").cogroup(rows.groupBy("shard")).applyInArrow(mend, SCHEMA)


def quantize(index: DataFrame, data: DataFrame, parts: int = 8, bits: int = 8) -> tuple[DataFrame, np.ndarray]:
    """The index with product codes of its vectors, and the codebooks, which are fitted to `data` as it is."""
    books = pq_fit(data, parts, bits)
    shipped = index.sparkSession.sparkContext.broadcast(books)

    @F.pandas_udf("binary")
    def coded(dim, m):
        return m.combine(dim, lambda raw, d: pq_codes(np.frombuffer(raw, float).reshape(-1, d), shipped.value).astype(np.uint8).tobytes())

    return index.withColumn("codes", coded("dim", "matrix")), books


def detach(index: DataFrame) -> DataFrame:
    """The index without vectors."""
    return index.drop("matrix")


def attach(index: DataFrame, data: DataFrame) -> DataFrame:
    """The index with its vectors, taken from `data` by id; rows that it doesn't hold are left out, and a row
    without a vector is an error."""
    shards = _shards(index)
    rows = vectors(data).select(F.pmod(F.xxhash64("id"), F.lit(shards)).alias("shard"), "id", "v")

    def meet(key, old, new):
        if not old.num_rows:
            return pa.table([pa.array([], t) for t in types], names=["shard", "m"])
        ids = np.frombuffer(old["ids"][0].as_py(), np.int64)
        new = new.sort_by("id")
        have = new["id"].to_numpy()
        at = np.searchsorted(have, ids)
        if len(have) == 0 or not np.array_equal(have[np.minimum(at, len(have) - 1)], ids):
            raise InvalidArgument("a row of the graph has no vector")
        x = matrix(new["v"])[at]
        if x.shape[1] != old["dim"][0].as_py():
            raise InvalidArgument("vectors differ in length from the graph's")
        return pa.table([pa.array([key[0].as_py()], types[0]), pa.array([x.tobytes()], types[1])], names=["shard", "m"])

    types = [pa.int64(), pa.binary()]
    found = index.select("shard", "dim", "ids").groupBy("shard").cogroup(rows.groupBy("shard")).applyInArrow(meet, "shard bigint, m binary")
    return index.drop("matrix").join(found.withColumnRenamed("m", "matrix"), "shard")


#: Rows that a filter leaves of a shard, up to which they are all measured in place of a walk.
SCAN_ROWS = 512
COUNTED = "qid bigint, shard bigint, turns int, seen int"


def _masks(index: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """The index with the ids of a frame that belong to each shard; shards are bounded, so are these lists."""
    shards = _shards(index)
    listed = ids.select(F.col(ids.columns[0]).cast("bigint").alias("id")).where("id is not null").distinct()
    listed = listed.groupBy(F.pmod(F.xxhash64("id"), F.lit(shards)).alias("shard")).agg(F.collect_list("id").alias(name))
    return index.join(listed, "shard", "left")


def _best(metric: str, q: np.ndarray, ids, x, graph, keep: int, width: int, mine, k: int):
    """For each of the queries `q`, places and distances of the best k rows that may be returned, and the walk's turns
    and rows seen. Where a filter leaves few rows, or the walk met too few of them, they are all measured."""
    if mine is None or mine.sum() > SCAN_ROWS:
        for v, (at, d, turns) in zip(q, walks(q, x, graph, metric, keep, width)):
            seen = len(at)
            if mine is not None:
                at = at[mine[at]]
                if len(at) < min(k, mine.sum()):
                    at, turns, seen = np.flatnonzero(mine), 0, int(mine.sum())
                d = exact(metric, v, x[at])
            best = np.lexsort((ids[at], np.round(d, 9)))[:k]
            yield at[best], d[best], turns, seen
        return
    at = np.flatnonzero(mine)
    for v in q:
        d = exact(metric, v, x[at]) if len(at) else np.empty(0)
        best = np.lexsort((ids[at], np.round(d, 9)))[:k]
        yield at[best], d[best], 0, len(at)


def _checked(metric: str, q: np.ndarray, ids: np.ndarray, x: np.ndarray, mine, found: list, k: int) -> list:
    """The exact best k for each of the queries `q`: what walks found bounds how far they lie, and every row that
    may be returned and lies within that bound is measured."""
    open_ = np.arange(len(ids)) if mine is None else np.flatnonzero(mine)
    y, out = x[open_], []
    rough_d = rough(metric, q, y)
    for v, far, (_, d, *told) in zip(q, rough_d, found):
        # The bound holds only where k rows were found. Rough distances have rounding errors.
        limit = d.max() if len(d) >= k else np.inf
        at = open_[far <= limit + 1e-7 * (1.0 + abs(limit))] if len(d) >= k else open_
        d = exact(metric, v, x[at]) if len(at) else np.empty(0)
        best = np.lexsort((ids[at], np.round(d, 9)))[:k]
        out.append((at[best], d[best], *told))
    return out


def _remeasured(metric: str, q: np.ndarray, ids: np.ndarray, y: np.ndarray, codes: np.ndarray, books, mine, found: list, k: int, sure: float | None) -> list:
    """The best k by their vectors of what walks by codes found for each of the queries `q`; with `sure`, of all
    rows as well that may be returned and that their codes' error leaves as near."""
    def measured(v, at):
        d = exact(metric, v, y[at]) if len(at) else np.empty(0)
        best = np.lexsort((ids[at], np.round(d, 9)))[:k]
        return at[best], d[best]

    out = [(*measured(v, at), *told) for v, (at, _, *told) in zip(q, found)]
    if sure is None:
        return out
    # Where fewer than k were found there is no limit.
    limits = np.array([((y[at] - v) ** 2).sum(1).max() if len(at) >= k else 1e300 for v, (at, *_) in zip(q, out)])
    near = may_reach("pq", np.zeros(y.shape[1]), books, q, y, codes, limits, sure)
    if mine is not None:
        near &= mine
    return [(*measured(v, np.union1d(at, np.flatnonzero(row))), *told) for v, row, (at, _, *told) in zip(q, near, out)]


def _seen_vectors(r: dict, shipped):
    """ids, the vectors that a walk measures, and those to measure its best rows by, if these are others."""
    ids = np.frombuffer(r["ids"], np.int64)
    y = np.frombuffer(r["matrix"], float).reshape(-1, r["dim"]) if "matrix" in r else None
    if shipped is None:
        return ids, y, None
    codes = np.frombuffer(r["codes"], np.uint8).reshape(len(ids), -1)
    check_codes(codes, shipped.value.shape[1])
    return ids, np.concatenate([book[codes[:, m]] for m, book in enumerate(shipped.value)], axis=1), y


def search(
    index: DataFrame, queries: DataFrame, k: int = 10, keep: int = 32, width: int = 2, metric: str = "l2", allow=None, tombstones: DataFrame | None = None, data: DataFrame | None = None,
    counters: bool = False, books: np.ndarray | None = None, check: bool = False, sure: float | None = None,
) -> DataFrame:
    """qid, rank, vec_id, distance of the best k rows that walks find. `keep` and `width` are the effort.

    A filter is a frame of ids, or a predicate over `data`, which must then be given. Rows that may not be
    returned are walked through. With `counters`, instead qid, shard, turns and rows seen of each walk.
    With the `books` of a quantized index walks go by codes, and the best `keep` rows that may be returned are
    measured again by their vectors where the index holds them. With `check` an exact check follows: all rows of a
    shard that may be returned and lie no farther than the kth that its walk found are measured, so none is missed. With `sure` and `books` so
    are all rows that by their codes, allowing for that many standard deviations of the codes' error, are as near."""
    check_metric(metric), check_k(k)
    if sure is not None and (books is None or "matrix" not in index.columns or not sure >= 0):
        raise InvalidArgument("sure is a number of standard deviations of codes, beside vectors")
    if check and (books is not None or "matrix" not in index.columns):
        raise InvalidArgument("an exact check goes by walks over vectors")
    if books is None and "matrix" not in index.columns or books is not None and "codes" not in index.columns:
        raise InvalidArgument("the index holds neither vectors nor codes for this search")
    keep = max(keep, k)
    if allow is not None and not isinstance(allow, DataFrame):
        if data is None:
            raise InvalidArgument("a predicate needs the rows it is about")
        allow = data.where(allow).select("vec_id")
    plain = allow is None and tombstones is None
    index = index if allow is None else _masks(index, allow, "only")
    index = index if tombstones is None else _masks(index, tombstones.select("vec_id"), "gone")

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                qids, q = unpack(r["q_ids"], r["q_matrix"], r["q_dim"])
                ids, x, y = _seen_vectors(r, shipped)
                graph, out, mine = np.frombuffer(r["graph"], np.int32).reshape(len(ids), -1), [], None
                if not plain:
                    mine = np.isin(ids, r["only"] or []) if "only" in r else np.ones(len(ids), bool)
                    mine &= ~np.isin(ids, r.get("gone") or [])
                met = list(_best(metric, q, ids, x, graph, keep, width, mine, k if y is None else keep))
                if y is not None:
                    met = _remeasured(metric, q, ids, y, np.frombuffer(r["codes"], np.uint8).reshape(len(ids), -1), shipped.value, mine, met, k, sure)
                for qid, (at, d, turns, seen) in zip(qids, _checked(metric, q, ids, x, mine, met, k) if check else met):
                    out.append(((qid,), (r["shard"],), np.int32([turns]), np.int32([seen])) if counters else (np.full(len(at), qid), ids[at], d))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=names)

    shipped = None if books is None else index.sparkSession.sparkContext.broadcast(books)
    names = ["qid", "shard", "turns", "seen"] if counters else ["qid", "vec_id", "d"]
    blocks = pack(vectors(queries), size=512).select(*(F.col(c).alias(f"q_{c}") for c in ("dim", "ids", "matrix")))
    masks = [c for c in ("only", "gone") if c in index.columns]
    held = [c for c in ("matrix", "codes") if c in index.columns and (c == "matrix" or books is not None)]
    pairs = blocks.crossJoin(index).select("q_dim", "q_ids", "q_matrix", "shard", "dim", "ids", "graph", *held, *masks)
    found = pairs.mapInArrow(run, COUNTED if counters else "qid bigint, vec_id bigint, d double")
    return found if counters else shown(ranked(found, k), metric)
