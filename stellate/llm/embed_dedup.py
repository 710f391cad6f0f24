"""Near-duplicate embeddings by sorted projection passes.

In each pass every vector gets a key of 64 random hashes, the signs of its products with
random directions. The vectors are sorted by their keys, and each meets those at most WINDOW
places from it. Sketches of 128 more signs rule out most of these pairs without the vectors,
whose cosine decides on the rest, in double precision. Verified pairs of all passes are
united.

A pair is met in a pass if its keys agree in more bits than the keys of the places where the
window ends. That gives each vector, from the density around it in every pass, the chance
that a link of it is met in no pass. The number of passes grows with the logarithm of the
number of vectors, so that this stays below MISS at even density. Where it does not, in
topics denser than the rest, and where windows are filled by links, an exact join finishes:
all pairs among such vectors are compared in tiles. Each of these is dealt to a group by its
nearest pivot (vectors taken by digest), two groups make a tile, and a vector goes only to
tiles where, by the triangle inequality of angles, it may have links. Tiles send counts of
links and one part per node, not pairs, so a crowd's output grows with its nodes. So a link
can be missed, with a chance below MISS, only if one of its ends lies in no crowd; none is
reported that is none. Equal vectors are one node with a count.

Where pivots tell nothing apart, the exact join's work grows with the square of the vectors
in crowds, and its shuffle with their bytes times the number of groups.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite values
link with nothing and are their own component. Vectors of different length never link.
Rows that repeat an id and vector are equal vectors; rows without an id take no part in
links and have a null component. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, held, map_batches
from .components import components

#: Pivots at most; rows of a matrix product's two sides; bytes of a group's vectors, and groups that many rows make at least.
PIVOTS, STEP, GROUP_BYTES, LEAST_GROUPS = 256, 512, 32 << 20, 16
#: Places that a vector meets on either side; bits of a key; chance of a missed link; passes at least, and at most.
WINDOW, KEY_BITS, MISS, LEAST_PASSES, MOST_PASSES = 256, 64, 1e-3, 8, 128
#: Links in a window that make a crowd; rows that a sorting task holds, and that it compares at a time.
CROWDED, TASK_ROWS, CHUNK = 128, 1 << 18, 1 << 14


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id, digest and values (binary, little-endian doubles or floats); both null where a vector links with nothing."""
    single = dict(vectors.dtypes)[vec_col] == "array<float>"
    kind = "<f4" if single else "<f8"
    rows = vectors.select(F.col(f"`{id_col}`").cast("bigint").alias("vec_id"), F.col(f"`{vec_col}`").cast("array<float>" if single else "array<double>").alias("v"))

    def run(batches):
        for batch in batches:
            digests, values = [], []
            for v in batch.column(1):
                x = None if not v.is_valid or v.values.null_count else v.values.to_numpy(zero_copy_only=False).astype(kind) + np.array(0, kind)
                if x is None or not len(x) or not np.isfinite(x).all() or not x.any():
                    digests.append(None)
                    values.append(None)
                else:
                    values.append(x.tobytes())
                    digests.append(hashlib.blake2b(values[-1], digest_size=16).digest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array(values, pa.binary())], names=["vec_id", "digest", "v"])

    return map_batches(rows, run, "vec_id bigint, digest binary, v binary", rows=2048), kind


def pivots(nodes: DataFrame, kind: str, most: int = PIVOTS) -> dict[int, tuple[int, np.ndarray]]:
    """Unit vectors of nodes taken by digest: for each length the number of its first pivot, and the pivots."""
    by_dim: dict[int, list] = {}
    for row in nodes.select("digest", "v").orderBy("digest").limit(most).collect():
        x = np.frombuffer(row["v"], kind).astype(float)
        by_dim.setdefault(len(x), []).append(x)
    starts = np.cumsum([0, *(len(x) for x in by_dim.values())])
    return {dim: (int(first), _unit(np.array(x))) for first, (dim, x) in zip(starts, by_dim.items())}


def _angles(batch, kind: str, found: dict):
    """For each length in a batch (v, ...): row numbers, the number of the first pivot, and angles to the pivots.
    Lengths without a pivot share one more, at angle 0 of all of them."""
    raw, last = batch.column(0).to_pylist(), sum(len(x) for _, x in found.values())
    dims = np.array([len(v) // np.dtype(kind).itemsize for v in raw], np.int64)
    for dim in np.unique(dims):
        at = np.flatnonzero(dims == dim)
        if int(dim) not in found:
            yield at, last, np.zeros((len(at), 1))
        else:
            first, centres = found[int(dim)]
            x = _unit(np.frombuffer(b"".join(raw[k] for k in at), kind).reshape(len(at), dim).astype(float))
            yield at, first, np.arccos(np.clip(x @ centres.T, -1, 1))


def crowds(nodes: DataFrame, kind: str, found: dict) -> tuple[np.ndarray, np.ndarray]:
    """For each pivot the nodes that are nearest to it, and the largest angle to one of them."""

    def run(batches):
        for batch in batches:
            for _, first, angles in _angles(batch, kind, found):
                yield pa.RecordBatch.from_arrays([pa.array(first + angles.argmin(1)), pa.array(angles.min(1))], names=["pivot", "far"])

    count = sum(len(x) for _, x in found.values()) + 1
    sizes, far = np.zeros(count, np.int64), np.zeros(count)
    for row in map_batches(nodes.select("v"), run, "pivot bigint, far double", rows=1024).groupBy("pivot").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect():
        sizes[row["pivot"]], far[row["pivot"]] = row["n"], row["far"]
    return sizes, far


def tiled(nodes: DataFrame, kind: str, least: float, found: dict, groups: int) -> DataFrame:
    """A row per node and tile (lo, hi: two groups of nodes) in which it may have links.

    Nodes are dealt to groups by nearest pivot. One that is linked with a node of another pivot is within
    the links' angle and that pivot's largest angle of it, so no linked pair is missed."""
    sizes, far = crowds(nodes, kind, found)
    offsets = np.cumsum(sizes) - sizes
    each = max(1, -(-int(sizes.sum()) // groups))
    held = np.zeros((len(sizes), groups))
    for p in np.flatnonzero(sizes):
        held[p, offsets[p] // each : (offsets[p] + sizes[p] - 1) // each + 1] = 1
    reach = np.arccos(np.clip(least, -1, 1)) + far + 1e-6  # more than the angles' rounding

    def run(batches):
        for batch in batches:
            hashes = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u8")[::2]
            for at, first, angles in _angles(batch, kind, found):
                pivot = first + angles.argmin(1)
                own = (offsets[pivot] + (hashes[at] % sizes[pivot].astype(np.uint64)).astype(np.int64)) // each
                met = (angles <= reach[first : first + angles.shape[1]]) @ held[first : first + angles.shape[1]] > 0
                met[np.arange(len(at)), own] = True
                for k in range(0, len(at), 64):
                    row, other = np.nonzero(met[k : k + 64])
                    row += k
                    cols = [pa.array(c, pa.int32()) for c in (np.minimum(own[row], other), np.maximum(own[row], other), own[row])]
                    yield pa.RecordBatch.from_arrays([*cols, *(batch.column(c).take(pa.array(at[row])) for c in (2, 3, 0))], names=["lo", "hi", "own", "node", "copies", "v"])

    return map_batches(nodes.select("v", "digest", "node", "copies"), run, "lo int, hi int, own int, node bigint, copies bigint, v binary", rows=1024)


def _unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the parts of linked rows; a label is the first row of its part."""
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while len(a) and (label[label] != label).any():
            label[:] = label[label]


def _compare(kind: str, least: float):
    """For a tile: of each node with links in it, the rows that it is linked with and a node of its part."""

    def run(table):
        lo, hi = table["lo"][0].as_py(), table["hi"][0].as_py()
        node, copies, own, raw = table["node"].to_numpy(), table["copies"].to_numpy(), table["own"].to_numpy(), table["v"].to_pylist()
        dims = np.array([len(v) for v in raw], np.int64)
        label, count = np.arange(len(node)), np.zeros(len(node), np.int64)
        for dim in np.unique(dims):
            left, right = (np.flatnonzero((dims == dim) & (own == g)) for g in (lo, hi))
            if not len(left) or not len(right):
                continue
            x, y = (_unit(np.frombuffer(b"".join(raw[k] for k in at), kind).reshape(len(at), -1).astype(float)) for at in (left, right))
            for i in range(0, len(x), STEP):
                for j in range(i if lo == hi else 0, len(y), STEP):
                    p, q = np.nonzero(x[i : i + STEP] @ y[j : j + STEP].T >= least)
                    a, b = left[p + i], right[q + j]
                    ok = (node[a] != node[b]) & ((a < b) | (lo != hi))
                    a, b = a[ok], b[ok]
                    if len(a):
                        np.add.at(count, a, copies[b])
                        np.add.at(count, b, copies[a])
                        _unite(label, a, b)
        some = np.flatnonzero(count)
        return pa.table({"node": node[some], "n": count[some], "part": node[label[some]]})

    return run


def links(nodes: DataFrame, kind: str, least: float) -> DataFrame:
    """A row per node and tile in which it has links: node, n (rows it is linked with) and part, a node
    of the same component. Over the tiles, n adds up to all links and (node, part) join all that is linked."""
    size = nodes.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("v")), F.lit(0)).alias("bytes")).first()
    groups = max(1, -(-size["bytes"] // GROUP_BYTES), min(LEAST_GROUPS, -(-size["n"] // STEP)))
    tiles = tiled(nodes, kind, least, pivots(nodes, kind), groups)
    return checkpointed(tiles.groupBy("lo", "hi").applyInArrow(_compare(kind, least), "node bigint, n bigint, part bigint"))


def passes(count: int, least: float) -> int:
    """How many passes keep the chance of a missed link below MISS where `count` vectors lie evenly."""
    bits = 1 + max(0.0, np.log2(max(count, 1) / WINDOW))
    met = (1 - np.arccos(least) / np.pi) ** bits
    return int(np.clip(np.ceil(np.log(MISS) / np.log1p(-met)) if met < 1 else 1, LEAST_PASSES, MOST_PASSES))


def keys(nodes: DataFrame, kind: str, turns: int) -> DataFrame:
    """A row per node and pass: segment (pass and length), key, node and sketch; keys sort as their bits do."""

    def directions(dim):
        return np.random.default_rng([dim, turns]).standard_normal((dim, turns * KEY_BITS + 128)).astype(np.float32)

    def run(batches):
        known = held(("projections", turns), dict)
        for batch in batches:
            raw, node = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            dims = np.array([len(v) // np.dtype(kind).itemsize for v in raw], np.int64)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                if dim not in known:
                    known[dim] = directions(int(dim))
                x = _unit(np.frombuffer(b"".join(raw[k] for k in at), kind).reshape(len(at), dim).astype(float)).astype(np.float32)
                words = np.packbits(x @ known[dim] >= 0, axis=1).view(">u8").astype(np.uint64)  # big-endian, so the first hash weighs most
                sketch = words[:, turns:].view(np.int64)
                for turn in range(turns):
                    key = (words[:, turn] ^ np.uint64(1 << 63)).view(np.int64)
                    segment = np.full(len(at), turn << 32 | int(dim), np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in (segment, key, node[at], np.ascontiguousarray(sketch[:, 0]), np.ascontiguousarray(sketch[:, 1]))], names=["segment", "key", "node", "s0", "s1"])

    return map_batches(nodes.select("v", "node"), run, "segment bigint, key bigint, node bigint, s0 bigint, s1 bigint", rows=1024)


def _common_bits(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Leading bits in which keys agree."""
    return KEY_BITS - np.where(x == y, 0, np.frexp(((x ^ y) >> 11 & ((1 << 53) - 1)).astype(float))[1] + 11)


def _allowed(least: float) -> int:
    """Bits in which the sketches of a link differ at most, by six standard deviations."""
    q = np.arccos(least) / np.pi
    return int(128 * q + 6 * np.sqrt(128 * q * (1 - q)))


def _apart(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Bits in which sketches (two words each) differ; without signs, of which bitwise_count counts the absolute value."""
    return np.bitwise_count((a ^ b).view(np.uint64)).astype(np.int16) + np.bitwise_count((c ^ d).view(np.uint64))


_OUT = {"kind": pa.int32(), "a": pa.int64(), "b": pa.int64(), "x": pa.float64(), "part": pa.int32(), "place": pa.int64(), "segment": pa.int64(), "s0": pa.int64(), "s1": pa.int64()}
PAIR, NODE, BORDER, SIZE = range(4)


def _said(kind: int, n: int, **cols):
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)) if c == "kind" else pa.array(cols[c], t) if c in cols else pa.nulls(n, t) for c, t in _OUT.items()], names=list(_OUT))


def _windows(least: float):
    """Of a sorted partition: pairs of nodes that may link; each node's log of the chance that this pass
    misses a link of it, and whether it lies in a crowd; the rows at its borders; and its size."""
    q, most = np.arccos(least) / np.pi, _allowed(least)

    def run(batches):
        table = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        if table is None or not table.num_rows:
            return
        segment, key, node, s0, s1 = (c.to_numpy() for c in table.columns)
        n, part = len(node), TaskContext.get().partitionId()
        first = np.searchsorted(segment, segment, "left")
        last = np.searchsorted(segment, segment, "right") - 1
        at = np.arange(n)
        # Where a segment begins or ends at the partition's border, the row there stands for the window's end.
        before, after = np.maximum(at - WINDOW, first), np.minimum(at + WINDOW, last)
        bits = np.maximum(
            np.where((at - WINDOW < first) & (first > 0), -1, _common_bits(key, key[before])), np.where((at + WINDOW > last) & (last < n - 1), -1, _common_bits(key, key[after]))
        )
        crowded = np.zeros(n, bool)
        for k in range(0, n, CHUNK):
            low, high = max(0, k - WINDOW), min(n, k + CHUNK + WINDOW)
            hits, links = [], np.zeros(high - low, np.int64)
            for d in range(1, min(WINDOW, high - low - 1) + 1):
                y = np.arange(low + d, high)
                apart = _apart(s0[low + d : high], s0[low : high - d], s1[low + d : high], s1[low : high - d])
                y = y[(apart <= most) & (segment[low + d : high] == segment[low : high - d])]
                np.add.at(links, y - low, 1)
                np.add.at(links, y - d - low, 1)
                hits.append((y - d, y))
            full = links >= CROWDED
            crowded[k : k + CHUNK] = full[k - low : k - low + min(CHUNK, n - k)]
            x, y = (np.concatenate(c) if hits else np.empty(0, np.int64) for c in (list(zip(*hits)) if hits else ((), ())))
            mine = (y >= k) & (y < k + CHUNK) & ~(full[x - low] & full[y - low])
            x, y = node[x[mine]], node[y[mine]]
            yield _said(PAIR, len(x), a=np.minimum(x, y), b=np.maximum(x, y))
        chance = np.log(np.maximum(1 - (1 - q) ** (bits + 1.0), 1e-20))
        yield _said(NODE, n, a=node, b=crowded.astype(np.int64), x=chance)
        edge = np.flatnonzero((at < WINDOW) | (at >= n - WINDOW))
        yield _said(BORDER, len(edge), a=node[edge], part=np.full(len(edge), part), place=edge, segment=segment[edge], s0=s0[edge], s1=s1[edge])
        yield _said(SIZE, 1, part=[part], place=[n])

    return run


def _over_borders(least: float):
    """Of the rows of two neighbouring blocks of places: pairs from different partitions that may link."""
    most = _allowed(least)

    def run(table):
        table = table.sort_by("place")
        place, part, segment, node, s0, s1, own = (table[c].to_numpy() for c in ("place", "part", "segment", "node", "s0", "s1", "own"))
        x, y = np.nonzero((place[None, :] > place[:, None]) & (place[None, :] - place[:, None] <= WINDOW) & (part[None, :] != part[:, None]) & (segment[None, :] == segment[:, None]) & own[None, :])
        near = _apart(s0[x], s0[y], s1[x], s1[y]) <= most
        x, y = node[x[near]], node[y[near]]
        return pa.table({"a": np.minimum(x, y), "b": np.maximum(x, y)})

    return run


def met(nodes: DataFrame, kind: str, least: float, count: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of nodes that meet in a window and may link; and the nodes that lie in crowds."""
    turns = passes(count, least)
    tasks = max(1, -(-count * turns // TASK_ROWS))
    order = ["segment", "key", "node"]
    found = keys(nodes, kind, turns).repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    schema = "kind int, a bigint, b bigint, x double, part int, place bigint, segment bigint, s0 bigint, s1 bigint"
    found = checkpointed(found.mapInArrow(_windows(least), schema))
    sizes = sorted((r["part"], r["place"]) for r in found.where(f"kind = {SIZE}").select("part", "place").collect())  # one row per partition
    starts = nodes.sparkSession.createDataFrame([(p, int(s)) for (p, _), s in zip(sizes, np.cumsum([0, *(n for _, n in sizes)]))], "part int, start bigint")
    borders = found.where(f"kind = {BORDER}").join(F.broadcast(starts), "part").withColumn("place", F.col("place") + F.col("start"))
    block = F.expr(f"place div {WINDOW}")
    borders = borders.select(F.explode(F.array(block, block + 1)).alias("block"), "place", "part", "segment", F.col("a").alias("node"), "s0", "s1").withColumn("own", F.col("block") == block)
    over = borders.groupBy("block").applyInArrow(_over_borders(least), "a bigint, b bigint")
    pairs = found.where(f"kind = {PAIR}").select("a", "b").unionByName(over).distinct()
    seen = found.where(f"kind = {NODE}").groupBy(F.col("a").alias("node")).agg(F.sum("x").alias("x"), F.max("b").alias("crowded"))
    return checkpointed(pairs), checkpointed(seen.where((F.col("x") > float(np.log(MISS))) | (F.col("crowded") > 0)).select("node"))


def verified(pairs: DataFrame, nodes: DataFrame, kind: str, least: float) -> DataFrame:
    """The pairs whose cosine is as large as asked, with both nodes' numbers of rows."""

    def run(batches):
        for batch in batches:
            ok = np.zeros(batch.num_rows, bool)
            raw = [batch.column(k).to_pylist() for k in (4, 5)]
            dims = np.array([len(v) if len(v) == len(w) else 0 for v, w in zip(*raw)], np.int64)
            for dim in np.unique(dims[dims > 0]):
                at = np.flatnonzero(dims == dim)
                x, y = (_unit(np.frombuffer(b"".join(side[k] for k in at), kind).reshape(len(at), -1).astype(float)) for side in raw)
                ok[at] = np.einsum("ij,ij->i", x, y) >= least
            yield batch.select([0, 1, 2, 3]).filter(pa.array(ok))

    for k in "ab":
        pairs = pairs.join(nodes.select(F.col("node").alias(k), F.col("copies").alias(f"copies_{k}"), F.col("v").alias(f"v_{k}")), k)
    return checkpointed(map_batches(pairs.select("a", "b", "copies_a", "copies_b", "v_a", "v_b"), run, "a bigint, b bigint, copies_a bigint, copies_b bigint", rows=2048))


def near_duplicates(vectors: DataFrame, least: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row per row of `vectors`: vec_id, n_links, component_id, kept."""
    found, kind = usable(vectors, id_col, vec_col)
    rows = checkpointed(found)
    nodes = checkpointed(rows.where("digest is not null and vec_id is not null").groupBy("digest").agg(F.min("vec_id").alias("node"), F.countDistinct("vec_id").alias("copies"), F.first("v").alias("v")))
    pairs, crowd = met(nodes, kind, least, nodes.count())
    linked = verified(pairs, nodes, kind, least)
    parts = links(checkpointed(nodes.join(crowd, "node", "left_semi").select(*nodes.columns)), kind, least)
    # Links within crowds are counted in the tiles.
    for k in "ab":
        linked = linked.join(crowd.select(F.col("node").alias(k), F.lit(True).alias(f"in_{k}")), k, "left")
    outside = linked.where("in_a is null or in_b is null")
    counts = [outside.select(F.col(x).alias("node"), F.col(f"copies_{y}").alias("n")) for x, y in ("ab", "ba")]
    others = counts[0].unionByName(counts[1]).unionByName(parts.select("node", "n")).groupBy("node").agg(F.sum("n").alias("others"))
    home = components(linked.select("a", "b").unionByName(parts.select(F.col("node").alias("a"), F.col("part").alias("b")))).withColumnRenamed("id", "node")
    told = nodes.drop("v").join(others, "node", "left").join(home, "node", "left")
    told = told.select("digest", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n"), F.coalesce("component", "node").alias("home"))
    joined = rows.select("vec_id", "digest").join(told, "digest", "left")
    linked = F.col("home").isNotNull() & F.col("vec_id").isNotNull()
    out = joined.select("vec_id", F.when(linked, F.col("n")).otherwise(0).cast("bigint").alias("n_links"), F.when(linked, F.col("home")).otherwise(F.col("vec_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


ORACLE_SQL = """
with recursive v as (select vec_id, embedding::double[] as e from embeddings
  where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
p as (select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_cosine_similarity(a.e, b.e) >= 0.95),
reach as (select distinct a as x, a as y from p union select r.x, p.b from reach r join p on r.y = p.a),
c as (select x, min(y) as m from reach group by x),
n as (select a, count(distinct b) as k from p group by a)
select vec_id, coalesce(k, 0)::bigint as n_links, coalesce(m, vec_id) as component_id, coalesce(m, vec_id) = vec_id as kept
from embeddings left join c on c.x = vec_id left join n on n.a = vec_id
"""
