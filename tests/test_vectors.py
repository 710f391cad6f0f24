import os
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from stellate import catalog
from stellate.functions import metrics
from stellate.functions.metrics import InvalidArgument
from stellate.operators import cluster, evaluate, graph, ivf, knn, quantize, walk
from stellate.sources import store
from stellate.streaming.queries import Batcher


def frame(spark, x, first=0):
    return store.from_numpy(spark, np.asarray(x, float), first)


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def truth(x, q, k, metric="l2"):
    return {(i, r + 1, int(j)) for i, v in enumerate(q) for r, j in enumerate(np.lexsort((np.arange(len(x)), np.round(metrics.exact(metric, v, x), 9)))[:k])}


@pytest.fixture(scope="module")
def small(spark):
    x, q = store.lcg_matrix(80, 8, 200).astype(float), store.lcg_matrix(6, 8, 201).astype(float)
    return x, q, frame(spark, x).cache(), frame(spark, q).cache()


def test_literal_inner_product_and_cosine(spark):
    data, q = frame(spark, [[1, 0], [0, 1], [-1, 0]]), frame(spark, [[1, 0]])
    assert rows(knn.brute_force(q, data, 2, "ip"), "rank", "vec_id", "distance") == [(1, 0, 1.0), (2, 1, 0.0)]
    assert rows(knn.brute_force(q, data, 2, "cosine"), "rank", "vec_id", "distance") == [(1, 0, 0.0), (2, 1, 1.0)]


@pytest.mark.parametrize("metric", metrics.METRICS)
def test_both_engines_agree(small, metric):
    x, q, data, queries = small
    got = knn.brute_force(queries, data, 5, metric).collect()
    assert {(r.qid, r.rank, r.vec_id) for r in got} == truth(x, q, 5, metric)
    assert sorted(got) == sorted(knn.brute_force_sql(queries, data, 5, metric).collect())


def test_equal_vectors_rank_by_id_and_short_results_are_filled(spark):
    data, q = frame(spark, [[1.0, 2.0]] * 30 + [[0.5, 0.1]]), frame(spark, [[1.0, 2.0]])
    assert [r.vec_id for r in knn.brute_force(q, data, 12).orderBy("rank").collect()] == list(range(12))
    few = knn.brute_force(q, data.limit(3), 5)
    assert few.count() == 3
    dense = knn.to_dense(few, q, 5).orderBy("rank").collect()
    assert [r.vec_id for r in dense][3:] == [-1, -1] and dense[4].distance == float("inf")


def test_bad_input_is_refused(spark, small):
    _, _, data, queries = small
    for call in (lambda: knn.brute_force(queries, data, 0), lambda: knn.brute_force(queries, data, 3, "manhattan"), lambda: quantize.pq_fit(data, 3), lambda: ivf.build(data, "tree")):
        with pytest.raises(InvalidArgument):
            call()
    with pytest.raises(Exception, match="differ in length"):
        knn.brute_force(frame(spark, [[1.0]]), data, 3).collect()
    with pytest.raises(InvalidArgument):
        quantize.check_codes(np.array([[16]]), 16)


def test_top_k_order_of_odd_values(spark):
    nan, inf = float("nan"), float("inf")
    values = [nan, 0.0, -0.0, inf, -inf, 1.0, 1.0, nan]
    df = spark.createDataFrame([(0, i, v) for i, v in enumerate(values)], "row int, col int, value double")
    assert [r.col for r in knn.top_k(df, 8, "row", "col", "value").orderBy("rank").collect()] == [4, 1, 2, 5, 6, 3, 0, 7]
    assert [r.col for r in knn.top_k(df, 8, "row", "col", "value", largest=True).orderBy("rank").collect()] == [3, 5, 6, 1, 2, 4, 0, 7]


def test_empty_tables(spark, small):
    _, _, data, queries = small
    none = data.limit(0)
    assert knn.brute_force(queries, none, 3).count() == knn.brute_force(none, data, 3).count() == 0
    assert knn.all_neighbors(none, 3).count() == 0


@pytest.mark.parametrize("kind", ivf.KINDS)
def test_inverted_lists_are_exact_at_full_effort_and_good_below(spark, small, kind):
    x, q, data, queries = small
    index = ivf.build(data, kind, nlist=4, iterations=4, pq_m=2, pq_bits=4)
    full = ivf.search(index, queries, 5, nprobe=4, krefine=1000, original=data)
    assert {(r.qid, r.rank, r.vec_id) for r in full.collect()} == truth(x, q, 5)
    some = ivf.search(index, queries, 5, nprobe=3, krefine=24, original=data)
    assert evaluate.mean_recall(some, knn.brute_force(queries, data, 5), 5) >= 0.5
    more = ivf.extend(index, frame(spark, q, 1000))
    assert lists_total(more) == lists_total(index) + len(q) == 86
    found = ivf.search(more, queries, 1, nprobe=4, krefine=1000, original=data.unionByName(frame(spark, q, 1000)))
    assert rows(found, "qid", "vec_id") == [(i, 1000 + i) for i in range(6)]


def lists_total(index):
    return ivf.lists(index).agg(F.sum("n")).first()[0]


def test_index_round_trip(spark, small, tmp_path):
    x, q, data, queries = small
    for kind, width in (("flat", None), ("rabitq", 1), ("pq", 4)):
        index, path = ivf.build(data, kind, nlist=4, iterations=4, pq_m=4, pq_bits=4), str(tmp_path / kind)
        store.save_index(index, path)
        again = store.load_index(spark, path)
        assert {(r.qid, r.rank, r.vec_id) for r in ivf.search(again, queries, 5, nprobe=4, krefine=1000).collect()} == truth(x, q, 5)
        if width:
            kept = {r.vec_id: bytes(r.code) for r in again.rows.collect()}
            assert kept == {r.vec_id: bytes(r.code) for r in index.rows.collect()} and {len(c) for c in kept.values()} == {width}


@pytest.mark.parametrize("spoil", ["code", "lost"])
def test_damaged_codes_are_refused(spark, small, tmp_path, spoil):
    index = ivf.build(small[2], "pq", nlist=4, iterations=2, pq_m=4, pq_bits=4)
    path = str(tmp_path / "i")
    store.save_index(index, path)
    rows = spark.read.schema(ivf.CODED).parquet(f"{path}/rows").collect()
    bad = [r.asDict() | ({"code": b"\x00\x10\x00\x00"} if spoil == "code" and r.vec_id == 3 else {}) for r in rows if spoil == "code" or r.vec_id != 3]
    spark.createDataFrame([tuple(r[c] for c in index.rows.columns) for r in bad], ivf.CODED).write.mode("overwrite").partitionBy("list_id").parquet(f"{path}/rows")
    with pytest.raises(InvalidArgument):
        store.load_index(spark, path)


def test_codes_are_those_of_the_residuals(small):
    x, _, data, _ = small
    for kind in ("rabitq", "pq"):
        index = ivf.build(data, kind, nlist=4, iterations=4, pq_m=4, pq_bits=4)
        more = ivf.extend(index, data.select((F.col("vec_id") + 100).alias("vec_id"), "embedding"))
        found = {r.vec_id: r for r in more.rows.collect()}
        for i, v in enumerate(x):
            residual = v - index.centres[found[i].list_id]
            want = np.packbits(residual >= 0, bitorder="little") if kind == "rabitq" else quantize.pq_codes(residual[None], index.books)[0].astype(np.uint8)
            assert bytes(found[i].code) == bytes(found[i + 100].code) == want.tobytes()
            assert kind == "pq" or np.isclose(found[i].scale, np.sqrt((residual**2).sum()))


def test_probed_candidates(small):
    x, q, data, queries = small
    index = ivf.build(data, "flat", nlist=4, iterations=4)
    sizes = dict(rows(ivf.lists(index), "list_id", "n"))
    near = [np.argsort(np.round(((v - index.centres) ** 2).sum(1), 9), kind="stable")[:2] for v in q]
    assert rows(ivf.candidates(index, queries, 2), "qid", "lists", "candidate_rows") == [(i, 2, sum(sizes[c] for c in at.tolist())) for i, at in enumerate(near)]


def test_quantizers(spark, small):
    x, _, data, _ = small
    fitted = quantize.sq_fit(data)
    back = {r.vec_id: r.vector for r in quantize.sq_decode(quantize.sq_encode(data, fitted), fitted).collect()}
    assert max(np.abs(np.array(back[i]) - x[i]).max() for i in range(80)) < 0.005
    books = quantize.pq_fit(data, 4, 4, 6)
    codes = quantize.pq_encode(data, books)
    want = quantize.pq_codes(x, books)
    assert {r.vec_id: r.codes for r in codes.collect()} == {i: list(map(int, want[i])) for i in range(80)}
    decoded = {r.vec_id: np.array(r.vector) for r in quantize.pq_decode(codes, books).collect()}
    table = quantize.adc_table(x[0], books)
    assert np.allclose(quantize.adc(table, want), [((decoded[i] - x[0]) ** 2).sum() for i in range(80)])
    signs = {r.vec_id: r.codes for r in quantize.binary_encode(data).collect()}
    assert signs[3] == list(map(int, np.packbits(x[3] >= 0, bitorder="little")))
    mean, w, values = quantize.pca_fit(data, 3)
    assert np.allclose(np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1][:3], values)
    z = {r.vec_id: r.vector for r in quantize.pca_transform(data, mean, w).collect()}
    assert np.allclose(z[5], (x[5] - x.mean(0)) @ w.T)


def test_kmeans_keeps_empty_clusters_and_clamps(spark):
    data = frame(spark, [[0.0], [0.0], [10.0], [10.0], [11.0]])
    centres = cluster.kmeans_fit(data, 3, 5)
    assert len(centres) == 3 and centres[1][0] == 0.0  # equal to the first centroid, so it never wins a row
    assert len(cluster.kmeans_fit(data, 9, 1)) == 5


def test_linkage_and_spectral_separate_two_groups(spark):
    x = store.lcg_matrix(24, 3, 610).astype(float)
    x[:12, 0] += 8
    data = frame(spark, x)
    for labels in (cluster.slink_labels(data, 2, 8, symmetric=True), cluster.spectral_clusters(data, 2, 8)):
        got = dict(rows(labels, "vec_id", "label"))
        assert len({got[i] for i in range(12)}) == len({got[i] for i in range(12, 24)}) == 1 and got[0] != got[12]


def test_linkage_and_spectral_beyond_the_driver(spark, monkeypatch):
    r = np.random.default_rng(4)
    x = np.concatenate([r.standard_normal((n, 3)) + [6.0 * c, 0, 0] for c, n in enumerate((60, 50, 40))])
    data = frame(spark, x)
    read = lambda: (
        *(rows(cluster.slink_labels(data, c, 8, symmetric=True), "vec_id", "label") for c in (1, 7)),
        dict(rows(cluster.spectral_embedding(data, 3), "id", "v")),
    )
    near = read()
    monkeypatch.setattr(cluster, "LINKAGE_LINKS", 10)
    monkeypatch.setattr(cluster, "DENSE_ROWS", 10)
    monkeypatch.setattr(cluster, "BUCKET_ROWS", 40)
    far = read()
    assert sorted(near[0]) == sorted(far[0]) and sorted(near[1]) == sorted(far[1])
    assert len(near[2]) == len(far[2]) == 150
    # Equal up to the basis of eigenvalues that are nearly equal: the spaces agree.
    a, b = (np.array([z[i] for i in range(150)]) for z in (near[2], far[2]))
    assert np.abs(a @ a.T - b @ b.T).max() < 1e-4
    assert len(set(dict(rows(cluster.spectral_clusters(data, 3), "vec_id", "label")).values())) == 3


def edges_of(spark, table):
    return spark.createDataFrame([(s, r, d) for s, row in enumerate(table) for r, d in enumerate(row)], "src bigint, rank int, dst bigint")


@pytest.mark.parametrize("table, degree, want", [
    ([[1, 2, 3, 4], [2, 3, 5, 4], [3, 5, 1, 4], [5, 1, 2, 4], [5, 1, 2, 3], [1, 2, 3, 4]], 2, [1, 4]),
    ([[1, 2], [0, 3], [1, 3], [0, 4], [0, 5], [0, 1]], 2, [1, 3]),
])
def test_detour_pruning_known_answers(spark, table, degree, want):
    got = graph.optimize(edges_of(spark, table), degree)
    by_node = {}
    for r in got.orderBy("node", "place").collect():
        by_node.setdefault(r.node, []).append(r.dst)
    assert by_node[0] == want
    local = walk.prune_detours(np.array(table, np.int32), degree)
    assert [list(map(int, row[row >= 0])) for row in local] == [by_node[n] for n in range(len(table))]


def test_malformed_graph_is_refused(spark):
    graph.check_full(edges_of(spark, [[1, 2], [0, 2], [0, 1]]))
    for bad in ([[1, 1], [0, 2], [0, 1]], [[0, 1], [0, 2], [0, 1]], [[1], [0, 2], [0, 1]]):
        with pytest.raises(InvalidArgument):
            graph.check_full(edges_of(spark, bad))


def test_nn_descent_beyond_the_exact_size(spark):
    data = frame(spark, store.lcg_matrix(400, 4, 302))
    found, exact = graph.nn_descent(data, 8, 6, exact_rows=10), graph.knn_graph(data, 8)
    hit = found.select("src", "dst").intersect(exact.select("src", "dst")).count()
    assert hit / exact.count() > 0.9
    assert found.groupBy("src").count().where("count <> 8").count() == 0


@pytest.mark.parametrize("kind, least", [("cagra", 0.9), ("hnsw", 0.6), ("vamana", 0.55)])
def test_walks_find_neighbours(spark, kind, least):
    x, q = store.lcg_matrix(300, 8, 400), store.lcg_matrix(8, 8, 401)
    data, queries = frame(spark, x), frame(spark, q)
    index = walk.build(data, kind, 8, 16, shard_rows=150)
    found = walk.search(index, queries, 4, 16, 2).cache()
    assert evaluate.mean_recall(found, knn.brute_force(queries, data, 4), 4) >= least
    ok = evaluate.validity(found, data, 4).first()
    assert ok.n_rows == 32 and not any((ok.beyond_k, ok.unknown_ids, ok.repeated, ok.not_finite, ok.out_of_order))
    one = walk.search(index, queries.where("vec_id = 3"), 4, 16, 2)
    assert sorted(one.collect()) == sorted(found.where("qid = 3").collect())  # batches don't matter
    dead = walk.search(index, queries, 4, 16, 2, allow=F.col("vec_id") % 2 == 0, tombstones=data.where("vec_id % 3 = 0"), data=data)
    assert dead.where("vec_id % 2 = 1 or vec_id % 3 = 0").count() == 0


def test_robust_prune_against_its_definition():
    x = store.lcg_matrix(40, 4, 500).astype(float)
    near = np.arange(1, 40)
    kept = [int(near[i]) for i in graph.robust_prune(x[0], x[near], near, 6, 1.2)]
    d = lambda a, b: ((x[a] - x[b]) ** 2).sum()
    want = []
    for v in sorted(near, key=lambda v: (d(0, v), v)):
        if len(want) < 6 and not any(1.2 * d(u, v) <= d(0, v) for u in want):
            want.append(int(v))
    assert kept == want


def test_recall_counts_repeats_once(spark):
    true = spark.createDataFrame([(0, 1, 5), (0, 2, 6)], "qid int, rank int, vec_id int")
    found = spark.createDataFrame([(0, 1, 5), (0, 2, 5)], "qid int, rank int, vec_id int")
    assert evaluate.recall(found, true, 2).first().recall == 0.5


def test_living_index(spark, tmp_path):
    table = store.IndexTable(spark, str(tmp_path / "t"))
    table.create(frame(spark, [[float(i)] for i in range(6)]))
    first = table.version()
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "vec_id bigint")
    table.delete(ids(1))
    table.delete(ids(4, 2))
    table.delete(ids(4))  # again: nothing changes
    assert tuple(table.counts().first()) == (3, 3)
    assert table.rows(first).where("state = 0").count() == 0  # readers of an old version are undisturbed
    put = dict(rows(table.extend(frame(spark, [[7.0], [8.0], [9.0], [10.0]], 100)), "vec_id", "packed_id"))
    gen = 1 << 32
    assert put == {100: 4 | gen, 101: 2 | gen, 102: 1 | gen, 103: 6}  # deleted last, used first
    before = table.version()
    for bad in (4, 99):
        with pytest.raises(InvalidArgument):
            table.delete(ids(0, bad))
        with pytest.raises(InvalidArgument):
            table.update(frame(spark, [[1.0]], bad))
    assert table.version() == before
    table.delete(ids(0))
    table.update(frame(spark, [[-5.0]], 0))
    assert dict((r.vec_id, r.embedding[0]) for r in table.live().collect())[0] == -5.0


def test_log_replay_and_torn_tail(spark):
    base = frame(spark, [[0.0], [1.0], [2.0]])
    log = spark.createDataFrame([
        (1, "insert", [10], [[5.0]]), (2, "update", [1, 77], [[9.0], [9.0]]), (3, "delete", [2, 10], None), (4, "insert", [10], [[6.0]]),
        (5, "insert", [10], [[7.0]]), (6, "delete", [0], None),
    ], "seq bigint, type string, ids array<bigint>, vectors array<array<double>>")
    sealed = store.sealed(log)
    got = lambda x, after=0: {r.vec_id: r.embedding[0] for r in store.replay(base, x, after).collect()}
    assert got(sealed) == {1: 9.0, 10: 6.0}
    torn = sealed.withColumn("crc", F.when(F.col("seq") == 4, F.lit(0)).otherwise(F.col("crc")))
    assert got(torn) == {0: 0.0, 1: 9.0}
    assert got(sealed, 5) == {1: 1.0, 2: 2.0}
    assert got(sealed.unionByName(sealed)) == got(sealed)


def test_batcher_joins_threads():
    calls = []

    def search(queries, k):
        calls.append(len(queries))
        return [q * k for q in queries]

    batcher, out = Batcher(search, most=4, wait=5.0), {}
    threads = [threading.Thread(target=lambda n=n: out.__setitem__(n, batcher.submit([n], 3))) for n in range(4)]
    [t.start() for t in threads]
    [t.join(20) for t in threads]
    assert out == {n: [3 * n] for n in range(4)} and calls == [4] and batcher.last_size == 4
    assert Batcher(search, most=9, wait=0.01).submit([1, 2], 2) == [2, 4]
    late = Batcher(search, most=9, wait=60.0)
    seen = []
    t = threading.Thread(target=lambda: seen.append(pytest.raises(RuntimeError, late.submit, [1], 1)))
    t.start()
    while late.batch is None:
        pass
    late.close()
    t.join(20)
    assert len(seen) == 1


def test_typed_sources(spark):
    half = spark.createDataFrame([(0, bytearray(np.array([0.5, -2.0], "<f2").tobytes()))], "vec_id bigint, embedding binary")
    assert store.typed(half, "f16").first().embedding == [0.5, -2.0]
    ints = spark.createDataFrame([(0, [-3, 5])], "vec_id bigint, embedding array<tinyint>")
    assert store.typed(ints, "i8").first().embedding == [-3.0, 5.0]
    assert store.typed(ints, "u8").first().embedding == [253.0, 5.0]
    with pytest.raises(InvalidArgument):
        store.typed(ints, "f8")


def test_packed_hamming(spark):
    df = spark.createDataFrame([([5, -1], [3, 0])], "a array<bigint>, b array<bigint>")
    assert df.select(metrics.packed_hamming(F.col("a"), F.col("b"))).first()[0] == 66


def test_sql_functions(spark):
    metrics.register(spark)
    got = spark.sql("select vec_l2(array(1d, 2d), array(0d, 0d)) a, vec_ip(array(1d, 2d), array(3d, 1d)) b, vec_hamming(array(1d, -2d), array(3d, 1d)) c").first()
    assert tuple(got) == (5.0, -5.0, 1.0)


def test_product_in_half_precision(spark):
    a = frame(spark, [[1.0, 2049.0]])
    assert knn.gemm(a, a, half=True).first().value == 1.0 + 2048.0**2


def test_filtered_walks_fill_k(spark, monkeypatch):
    """A selective filter on any column gives the exact best k, by a scan; a wide one walks and returns allowed rows only."""
    data = store.from_numpy(spark, store.lcg_matrix(500, 8, 40)).withColumn("label", F.col("vec_id") % 50).repartition(3)
    queries = data.where("vec_id < 5")
    index = walk.build(data, shard_rows=200)
    best = lambda where: [(r.qid, r.rank, r.vec_id) for r in knn.brute_force(queries, data.where(where), 10).orderBy("qid", "rank").collect()]
    got = walk.search(index, queries, 10, 16, 1, allow=F.col("label") == 1, data=data)
    assert [(r.qid, r.rank, r.vec_id) for r in got.orderBy("qid", "rank").collect()] == best("label = 1")
    monkeypatch.setattr(walk, "SCAN_ROWS", 20)
    wide = walk.search(index, queries, 10, 64, 4, tombstones=data.where("label = 2")).collect()
    assert len(wide) == 50 and all(r.vec_id % 50 != 2 for r in wide)
    assert len({(r.qid, r.rank, r.vec_id) for r in wide} & set(best("label <> 2"))) >= 40
    assert walk.search(index, queries, 10, allow=data.limit(0).select("vec_id")).count() == 0
    with pytest.raises(metrics.InvalidArgument):
        walk.search(index, queries, allow=F.col("label") == 1)
    counted = walk.search(index, queries, 10, 16, 1, counters=True).collect()
    assert len(counted) == 5 * index.count() and all(r.turns > 0 and 16 <= r.seen <= 500 for r in counted)


def test_writes_go_on_after_a_dead_writer(spark):
    table = store.IndexTable(spark, store.new_path(spark, "index"))
    data = store.from_numpy(spark, store.lcg_matrix(20, 4, 1))
    table.create(data)
    data.write.parquet(f"{table.path}/v1/rows")  # a writer that ended before its manifest
    assert table.version() == 0
    table.delete(data.where("vec_id < 3").select("vec_id"))
    assert table.version() == 2 and tuple(table.counts().first()) == (17, 3)


@pytest.fixture(scope="module")
def graphed(spark):
    data = store.from_numpy(spark, store.lcg_matrix(600, 8, 77)).cache()
    return data, data.where("vec_id < 10").cache(), knn.brute_force(data.where("vec_id < 10"), data, 10).cache()


def hits(found, best):
    return evaluate.mean_recall(found, best, 10)


def test_extended_graphs_hold_recall(spark, graphed):
    """Half the rows come in later, over several shards, and some old rows get their vector later."""
    data, queries, best = graphed
    first = data.where("vec_id >= 300").withColumn("embedding", F.when(F.col("vec_id") < 350, F.transform("embedding", lambda x: -x)).otherwise(F.col("embedding")))
    index = walk.build(first, shard_rows=150).cache()
    more = walk.extend(index, data.where("vec_id < 350").unionByName(data.where("vec_id = 5"))).cache()
    shards = [r.asDict() for r in more.collect()]
    held = np.concatenate([np.frombuffer(r["ids"], np.int64) for r in shards])
    assert sorted(held.tolist()) == list(range(600))
    wanted = store.lcg_matrix(600, 8, 77)
    for r in shards:
        ids, graph = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["graph"], np.int32).reshape(-1, r["degree"])
        assert np.allclose(np.frombuffer(r["matrix"]).reshape(len(ids), -1), wanted[ids]) and len(graph) == len(ids)
        for n, row in enumerate(graph):
            row = row[row >= 0]
            assert n not in row and len(set(row.tolist())) == len(row) > 0 and row.max() < len(ids)
    assert hits(walk.search(more, queries, 10, 64, 2), best) >= 0.95
    assert walk.extend(index, data.limit(0)).count() == index.count()
    with pytest.raises(InvalidArgument):
        walk.extend(walk.detach(index), data)


def test_extending_an_empty_graph_builds_one(spark, graphed):
    data, queries, best = graphed
    assert hits(walk.search(walk.extend(walk.build(data.limit(0)), data), queries, 10, 64, 2), best) >= 0.9


def test_quantized_walks(spark, graphed):
    data, queries, best = graphed
    index, books = walk.quantize(walk.build(data, shard_rows=300).cache(), data, 4, 8)
    exact_again = walk.search(index, queries, 10, 128, 4, books=books)
    assert hits(exact_again, best) >= 0.9
    bare = walk.search(walk.detach(index), queries, 10, 128, 4, books=books)
    assert 0.5 <= hits(bare, best) <= hits(exact_again, best)
    few = walk.search(index, queries, 10, 32, 1, books=books, allow=data.where("vec_id % 3 = 0").select("vec_id")).collect()
    assert len(few) == 100 and all(r.vec_id % 3 == 0 for r in few)
    with pytest.raises(InvalidArgument):
        walk.search(walk.detach(index), queries)


def test_saved_graphs(spark, graphed, tmp_path):
    data, queries, _ = graphed
    index = walk.build(data, "vamana", shard_rows=200).cache()
    found = rows(walk.search(index, queries, 10, 32, 2), "qid", "rank", "vec_id", "distance")
    for n, kept in enumerate((index, walk.detach(index))):
        store.save_graph(kept, str(tmp_path / str(n)))
        again = store.load_graph(spark, str(tmp_path / str(n)))
        again = again if n == 0 else walk.attach(again, data)
        assert rows(walk.search(again, queries, 10, 32, 2), "qid", "rank", "vec_id", "distance") == found
    with pytest.raises(Exception, match="no vector"):
        walk.attach(walk.detach(index), data.where("vec_id <> 17")).collect()
    index.where("shard <> 0").write.mode("overwrite").parquet(str(tmp_path / "0" / "shards"))
    with pytest.raises(InvalidArgument):
        store.load_graph(spark, str(tmp_path / "0"))


def test_first_graphs(spark, graphed):
    """Every way to the first graph gives full rows of others without repeats, near the exact ones."""
    x = store.lcg_matrix(500, 8, 91).astype(float)
    best = walk.neighbours(x, 12)
    for name, least in (("nn_descent", 0.9), ("iterative", 0.9), ("ivf_pq", 0.3)):
        found = walk.FIRST[name](x, 12) if name == "ivf_pq" else walk.FIRST[name](x, 12, exact_rows=10)
        assert all(len(set(row) - {i, -1}) == 12 for i, row in enumerate(found.tolist())) or name == "ivf_pq"
        assert all(i not in row for i, row in enumerate(found.tolist()))
        assert np.mean([len(set(a) & set(b)) / 12 for a, b in zip(found.tolist(), best.tolist())]) >= least, name
    for tiny in (1, 2, 5):
        for make in walk.FIRST.values():
            assert make(x[:tiny], 4).shape == (tiny, 4)
    same = np.repeat(x[:1], 30, axis=0)
    assert all((make(same, 4) >= -1).all() for make in walk.FIRST.values())
    data, queries, best = graphed
    for first in walk.FIRST:
        assert hits(walk.search(walk.build(data, first=first, shard_rows=300), queries, 10, 64, 4), best) >= 0.9
    with pytest.raises(InvalidArgument):
        walk.build(data, first="other")


def test_build_report(spark, graphed):
    told = walk.report(walk.build(graphed[0], degree=8, shard_rows=300)).first()
    assert (told.shards, told.n_rows, told.graph_bytes, told.vector_bytes, told.code_bytes) == (2, 600, 600 * 8 * 4, 600 * 8 * 8, 0)


def test_calibration_displaces_its_samples(spark, graphed):
    data = graphed[0]
    near = knn.brute_force(data, data, 1, without_self=True)
    moved = evaluate.displaced(data, near).join(data.withColumnRenamed("embedding", "old"), "vec_id").join(near.select(near["qid"].alias("vec_id"), "distance"), "vec_id")
    for r in moved.collect():
        assert abs(((np.array(r.embedding) - np.array(r.old)) ** 2).sum() - r.distance) < 1e-5
    keep, width, found = evaluate.calibrate(walk.build(data, shard_rows=300).cache(), data, 0.9, samples=40)
    assert (keep, width) in evaluate.LADDER and found >= 0.9


def test_churn(spark, graphed, tmp_path):
    """Recall is that of the rows which live after each round; deleted rows, also updated ones, come and go."""
    data = graphed[0]
    table = store.IndexTable(spark, str(tmp_path / "churn"))
    table.create(data)
    turned = data.select("vec_id", F.transform("embedding", lambda x: -x).alias("embedding"))
    rounds = [(data.where("vec_id < 60").select("vec_id"), turned.where("vec_id between 50 and 99"), turned.where("vec_id >= 570")), (None, None, turned.where("vec_id < 40")), (None, None, None)]
    told = evaluate.churn(table, graphed[1], rounds, 10, 64, shard_rows=300).orderBy("round").collect()
    assert [(r.round, r.live, r.deleted) for r in told] == [(0, 600, 0), (1, 580, 20), (2, 620, 0), (3, 620, 0)]
    assert all(r.recall >= 0.9 for r in told)


def test_churn_takes_the_effort_that_shards_need(spark, tmp_path):
    """An effort that is enough for small shards loses recall in larger ones; with `least` it grows, and stays as it is where it is enough."""
    data = store.from_numpy(spark, np.random.default_rng(11).normal(size=(3000, 48))).cache()
    queries, found = data.where("vec_id % 60 = 0").cache(), {}
    turned = lambda rest: data.where(f"vec_id % 10 = {rest}").select("vec_id", F.transform("embedding", lambda x: -x).alias("embedding"))
    rounds = [(data.where("vec_id % 10 = 2").select("vec_id"), turned(3), turned(4))]
    for least in (None, 0.995, 0.5):
        table = store.IndexTable(spark, str(tmp_path / f"churn-{least}"))
        table.create(data)
        found[least] = evaluate.churn(table, queries, rounds, 10, 12, least=least).orderBy("round").collect()
    assert all(r.recall < 0.995 and r.keep == 12 for r in found[None]) and found[0.5] == found[None]
    assert all(r.recall >= 0.995 and 12 < r.keep <= 3072 for r in found[0.995])
    assert [(r.live, r.deleted) for r in found[0.995]] == [(3000, 0), (3000, 0)]


@pytest.mark.parametrize("metric", ["l2", "ip", "cosine"])
def test_checked_walks_are_exact(spark, metric):
    """Walks of a small effort miss rows; with the check after them none is missed, filtered, deleted or plain."""
    x = np.random.default_rng(5).normal(size=(2400, 32)).round(3)
    data = frame(spark, np.vstack([x, x[:40]])).withColumn("label", F.col("vec_id") % 5).repartition(3).cache()
    queries, index = data.where("vec_id % 80 = 0"), walk.build(data, degree=4, first_degree=4, shard_rows=1300).cache()
    best = lambda where: rows(knn.brute_force(queries, data.where(where), 10, metric), "qid", "rank", "vec_id", "distance")
    for where, more in (("label <> 2", {"tombstones": data.where("label = 2")}), ("label in (0, 1, 3)", {"allow": F.col("label").isin(0, 1, 3), "data": data}), ("true", {})):
        walked = walk.search(index, queries, 10, 10, 1, metric, **more)
        assert rows(walked, "qid", "rank", "vec_id", "distance") != best(where)
        assert rows(walk.search(index, queries, 10, 10, 1, metric, check=True, **more), "qid", "rank", "vec_id", "distance") == best(where)
    with pytest.raises(InvalidArgument):
        walk.search(walk.detach(index), queries, check=True)


def test_relinked_graphs_are_as_good_as_new_ones():
    """In data without structure, rows that come in and rows that move are found, and no edge tells of an old place."""
    x = np.random.default_rng(6).normal(size=(2500, 64))
    moved = np.arange(len(x)) % 7 == 0
    old = np.where(moved[:, None], -x, x)
    graph = np.full((2500, 16), -1, np.int32)
    graph[:2000] = walk.prune_detours(walk.neighbours(old[:2000], 32), 16)
    touched = np.flatnonzero(moved | (np.arange(2500) >= 2000))
    after, hit = walk.relink(x, graph, touched), 0
    for i in range(0, 2500, 25):
        seen, _ = walk.walk(x[i], x, after, "l2", 48, 2)
        d = ((x - x[i]) ** 2).sum(1)
        hit += len(set(sorted(seen, key=seen.get)[:10]) & set(np.argsort(d)[:10].tolist()))
    assert hit / 1000 >= 0.95
    told = [row[row >= 0].tolist() for row in after]
    assert all(i not in row and len(row) == len(set(row)) > 0 for i, row in enumerate(told))


def test_graphs_hold_recall_over_rounds_of_moves():
    """A graph that is mended again and again, as a living index is, in data without structure."""
    x = np.random.default_rng(8).normal(size=(2000, 64))
    graph = walk.prune_detours(walk.neighbours(x, 32), 16)
    for turn in range(3):
        touched, hit = np.arange(turn, 2000, 5), 0
        x[touched] *= -1
        graph = walk.relink(x, graph, touched)
        for i in range(0, 2000, 25):
            seen, _ = walk.walk(x[i], x, graph, "l2", 48, 2)
            hit += len(set(sorted(seen, key=seen.get)[:10]) & set(np.argsort(((x - x[i]) ** 2).sum(1))[:10].tolist()))
        assert hit / 800 >= 0.95, turn


@pytest.mark.parametrize("kind", ["pq", "rabitq", "scann"])
def test_shortlists_of_whole_blocks_are_not_listed(spark, kind):
    """A shortlist that leaves nothing out is measured where its rows lie, exactly: no row for each pair comes out."""
    x = np.random.default_rng(9).normal(size=(3000, 16)).round(3)
    data = frame(spark, x).cache()
    queries, index = data.where("vec_id % 100 = 0"), ivf.build(data, kind, 4, 3, pq_m=4, pq_bits=4)
    for metric in ("l2", "cosine"):
        got = ivf.search(index, queries, 10, nprobe=4, metric=metric, krefine=3000, original=data)
        assert rows(got, "qid", "rank", "vec_id", "distance") == rows(knn.brute_force(queries, data, 10, metric), "qid", "rank", "vec_id", "distance")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 4  # probe, two sides packed, and blocks measured
    found = index.rows.select("vec_id", "list_id", "scale", "code", F.concat("embedding", "embedding").alias("v"))
    q = ivf.vectors(queries)
    near = ivf._measured(index, ivf.probe(q, index.centres, 4), q, index.rows, ivf.vectors(data), "l2", 10)
    assert near.count() <= 30 * 10 * ivf._pack_coded(found).count()


@pytest.mark.parametrize("kind", ["pq", "rabitq", "scann"])
def test_shortlists_are_widened_by_the_codes_error(spark, kind):
    """In data without structure a short shortlist misses rows that coarse codes can't tell; by their error they are found."""
    data = frame(spark, np.random.default_rng(10).normal(size=(3000, 32)).round(3)).cache()
    queries, index = data.where("vec_id % 60 = 0"), ivf.build(data, kind, 4, 3, pq_m=4, pq_bits=4)
    best = knn.brute_force(queries, data, 10).cache()
    assert hits(ivf.search(index, queries, 10, nprobe=4, krefine=20, original=data), best) < 0.8
    found = ivf.search(index, queries, 10, nprobe=4, krefine=20, original=data, sure=3.0)
    assert hits(found, best) >= 0.95
    assert found.groupBy("qid").count().where("count <> 10").count() == 0 and found.select("qid", "vec_id").distinct().count() == 500
    with pytest.raises(InvalidArgument):
        ivf.search(index, queries, sure=-1.0, original=data)


def test_a_descended_graph_is_completed(spark):
    """Where descent misses neighbours, also of equal rows, the check finds them all; a row without edges is no exception."""
    x = np.random.default_rng(12).normal(size=(1500, 32)).round(3)
    data = frame(spark, np.vstack([x, x[:30], x[:30]])).repartition(3)
    edges = graph.nn_descent(data, 8, 1, exact_rows=10).cache()
    exact = rows(graph.knn_graph(data, 8), "src", "rank", "dst")
    assert rows(edges, "src", "rank", "dst") != exact
    assert rows(graph.completed(edges, data, 8), "src", "rank", "dst") == exact
    assert rows(graph.completed(edges.where("src > 40 and rank < 5 or src > 700"), data, 8), "src", "rank", "dst") == exact


def test_walks_by_codes_are_widened_by_the_codes_error(spark):
    """In data without structure the best rows by coarse codes miss neighbours; by the codes' error they are found."""
    data = frame(spark, np.random.default_rng(14).normal(size=(2000, 32)).round(3)).cache()
    queries = data.where("vec_id % 50 = 0")
    index, books = walk.quantize(walk.build(data, shard_rows=1100).cache(), data, 4, 4)
    best = knn.brute_force(queries, data, 10).cache()
    assert hits(walk.search(index, queries, 10, 32, 2, books=books), best) < 0.8
    assert hits(walk.search(index, queries, 10, 32, 2, books=books, sure=3.0), best) >= 0.95
    some = walk.search(index, queries, 10, 32, 2, books=books, sure=3.0, tombstones=data.where("vec_id % 4 = 1"))
    assert hits(some, knn.brute_force(queries, data.where("vec_id % 4 <> 1"), 10)) >= 0.95 and some.where("vec_id % 4 = 1").count() == 0
    with pytest.raises(InvalidArgument):
        walk.search(index, queries, sure=3.0)


def test_least_is_the_head_of_a_stable_sort():
    """The shortcut of first graphs sorts no whole rows, and gives the same places, ties, infinities and all."""
    d = np.round(np.random.default_rng(15).normal(size=(40, 300)), 1)
    d[:, ::7] = np.inf
    d[3] = np.inf
    for m in (0, 1, 16, 299, 300, 400):
        assert np.array_equal(walk._least(d, m), np.argsort(d, axis=1, kind="stable")[:, :m])


def shuffled(spark) -> dict[str, int]:
    """Bytes of each shuffle file that lies in the session's local folders."""
    there = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirs()
    files = [os.path.join(d, f) for top in there for d, _, names in os.walk(top.getPath()) for f in names if f.startswith("shuffle_")]
    return {f: os.path.getsize(f) for f in files if os.path.exists(f)}


@pytest.mark.parametrize("shards", [1, 3])
def test_descent_shuffles_edges_alone(spark, shards):
    """No vector moves for a pair of rows; shards that meet give a graph over all rows, which the check makes exact."""
    x = store.lcg_matrix(1500, 8, 303)
    data, before = frame(spark, x).repartition(3).cache(), set(shuffled(spark))
    found = (graph.nn_descent(data, 8, exact_rows=10) if shards == 1 else graph.nn_descent(data, 8, exact_rows=10, shard_rows=500)).cache()
    exact = graph.knn_graph(data, 8).cache()
    assert found.groupBy("src").count().where("count = 8").count() == 1500
    # Twice the rows and three times what edges of all shards would take, without compression.
    assert sum(size for f, size in shuffled(spark).items() if f not in before) < 2 * 1500 * 8 * 8 + 3 * shards * 1500 * 8 * 24
    graph.check_full(found)
    assert found.select("src", "dst").intersect(exact.select("src", "dst")).count() / exact.count() > 0.9
    assert rows(graph.completed(found, data, 8), "src", "rank", "dst") == rows(exact, "src", "rank", "dst")


@pytest.mark.parametrize("metric", ["l2", "l2sqrt", "cosine"])
def test_walks_together_are_single_walks(metric):
    x = np.random.default_rng(21).normal(size=(900, 24))
    x[-40:] = x[:40]
    g = walk.prune_detours(walk.neighbours(x, 16), 8)
    g[5] = -1
    for at, d, turns in [w for step in (1, 7, 2_500_000) for w in [*_together(x, g, metric, step)]]:
        assert turns and len(set(at.tolist())) == len(at) == len(d)


def _together(x, g, metric, together, keep=24):
    """Walks in batches, held against walks one by one: the same rows seen, in as many turns, and the same nearest."""
    walk.TOGETHER, usual = together, walk.TOGETHER
    try:
        found = list(walk.walks(x[:50:2], x, g, metric, keep, 3))
    finally:
        walk.TOGETHER = usual
    for v, (at, d, turns) in zip(x[:50:2], found):
        seen, told = walk.walk(v, x, g, metric, keep, 3)
        best = lambda pairs: sorted((round(far, 9), i) for i, far in pairs)[:10]
        assert best(seen.items()) == best(zip(at.tolist(), d.tolist()))
        yield at, d, turns


@pytest.fixture(scope="module")
def sparse_graphs(spark, tmp_path_factory):
    """Rows without structure as the table of the queries, in whose graphs of four edges a row walks that keep 128 rows miss many."""
    there = str(tmp_path_factory.mktemp("sf"))
    data = frame(spark, np.random.default_rng(30).normal(size=(2000, 64)))
    data.withColumn("label", (F.col("vec_id") % 10).cast("int")).write.parquet(f"{there}/embeddings.parquet")
    data = spark.read.parquet(f"{there}/embeddings.parquet")
    queries = data.where("vec_id % 20 = 0")
    return there, walk.build(data, degree=4).cache(), queries, knn.brute_force(queries, data, 10).cache()


def test_extended_graphs_reach_the_floor(spark, sparse_graphs, monkeypatch):
    """Walks that keep too few rows for the recall keep more."""
    there, index, queries, truth = sparse_graphs
    assert hits(walk.search(index, queries, 10, 128, 4), truth) < 0.9
    found, reached, keep = evaluate.reaching(index, queries, truth, 0.9, 10, 128, 4)
    assert reached == hits(found, truth) >= 0.9 and keep in (256, 512, 1024)
    assert evaluate.reaching(index, queries, truth, 1.1, 10, 1024, 4)[1:] == (hits(walk.search(index, queries, 10, 2048, 4), truth), 2048)
    build = walk.build
    monkeypatch.setattr(walk, "build", lambda data, *a, **b: build(data, *a, **b | {"degree": 4}))
    assert rows(catalog.cagra_extended_recall(spark, there), "queries", "reached") == [(100, True)]


def test_index_floors_are_reached(spark, sparse_graphs, monkeypatch):
    """Graphs in which 128 rows kept are too few reach the floor with more."""
    build = walk.build
    monkeypatch.setattr(walk, "build", lambda data, *a, **b: build(data, *a, **b | {"degree": 6}))
    monkeypatch.setattr(ivf, "KINDS", ())
    assert rows(catalog.index_recall_floors(spark, sparse_graphs[0]), "kind", "queries", "reached") == [(k, 100, True) for k in ("cagra", "hnsw", "vamana")]


def test_first_graphs_reach_the_floor(spark, sparse_graphs, monkeypatch):
    """Graphs that began in each way are made once, and reach the floor where 128 rows kept are too few."""
    build = walk.build
    monkeypatch.setattr(walk, "build", lambda data, *a, **b: build(data, *a, **b | {"degree": 4}))
    assert rows(catalog.cagra_first_graphs(spark, sparse_graphs[0]), "first", "reached") == sorted((k, True) for k in walk.FIRST)
