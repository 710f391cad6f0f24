"""N-gram Jaccard join with adaptive multi-match prefixes.

A document is the set of its distinct word shingles, as 64-bit hashes. Two documents
link when their sets' Jaccard similarity is at least `percent` / 100. All sets are
sorted by one order of shingles, rare ones first, which a count sketch over all
documents gives. If two sets link, then for every l the first `n - ceil(n * percent /
100) + l` shingles of either have l in common, so a document with a prefix lengthened
by l - 1 shingles may ask for l shared ones (Wang, Li and Feng, "Can we beat the prefix
filtering?", SIGMOD 2012). Each document picks the l with the least estimated cost of
its candidates; of a pair the smaller l counts.

Components need not see all pairs of a crowd. Documents with equal sets are one node.
Of the documents that share a prefix shingle, the most central is compared with the
others first; what those links join is one part, and only pairs across parts remain.
Such rounds are repeated while pairs are many and rounds find links, and then every
remaining candidate pair across parts is verified, so no link between parts is lost: the
components are exact. Pairs that cannot link go before they are verified: by size, by
the place of the first shared shingle, and by parity sketches, whose differing bits are
a lower bound of the shingles in which two sets differ.

Defined cases: A-Z are lower-cased and words are runs of other than ASCII white space.
A document with fewer words than a shingle has its whole sequence as one; without words
(null, empty or blank text) its set is empty, it links with nothing and is its own
component. Rows without an id link with nothing and have a null component. Repeated
rows are equal documents. Texts are read whole; other columns take no part.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, freed, held, map_batches, text_rows
from .components import components

#: Counters of the sketch: a power of two near the bytes of text / 128, of which one byte each is broadcast.
LEAST_BITS, MOST_BITS = 14, 24
BLOCKS = 64
#: Most shared shingles that a prefix may ask for.
MOST_MATCHES = 4
#: Cost of verifying a pair, in list entries read.
VERIFY_COST = 40.0
#: Documents per task at most that share a prefix shingle; longer lists are split when they are gathered.
LONG_LIST = 50_000
#: Entries of a block: lists of candidates are joined block by block.
LIST_BLOCK = 512
#: Bits of a document's parity sketch, and of its folded form that goes along with lists.
PARITY_BITS, FOLDED_BITS = 2048, 512
#: Ids that a semi-join may broadcast: 8 bytes each.
BROADCAST_IDS = 200_000
#: Pairs with the first documents of lists that are all verified at once, whether others join them or not.
FEW_PAIRS = 100_000
#: Pairs across parts beyond which another round of comparisons with centres pays, and links it must have found to pay again.
MANY_PAIRS, MOST_ROUNDS, FEW_LINKS = 50_000_000, 3, 100

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def shingles(text: bytes, words: int) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    found = text.lower().split()  # of bytes: lower-cases A-Z alone, and splits at ASCII white space
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    span = min(words, len(h))
    n = len(h) - span + 1
    s = np.full(n, np.uint64(span), np.uint64)
    for k in range(span):
        s = (s ^ h[k : k + n]) * _MIX[k % 5]
        s ^= s >> np.uint64(31)
    s *= _MIX[4]
    s ^= s >> np.uint64(29)
    return np.unique(s)


def parity(s: np.ndarray) -> bytes:
    """PARITY_BITS bits, of which each shingle flips one. Those in which two sets differ are no
    more than the shingles in which they differ, whatever the sets' sizes."""
    flips = np.bincount((s >> np.uint64(40)).astype(np.int64) & (PARITY_BITS - 1), minlength=PARITY_BITS)
    return np.packbits((flips & 1).astype(np.uint8)).tobytes()


def _as_bytes(column):
    return column.cast(pa.binary()).to_pylist()


def sketch_bits(texts: DataFrame) -> int:
    """Bits of the sketch's size, which grows with the text until its bound."""
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return min(max((size >> 7).bit_length(), LEAST_BITS), MOST_BITS)


def profile(texts: DataFrame, words: int, bits: int) -> DataFrame:
    """Per row doc_id, n_shingles, a digest of the set and its parity sketch; and per partition blocks of the sketch of its counts."""
    block = (1 << bits) // BLOCKS
    names = ["doc_id", "n_shingles", "digest", "parity", "block", "counts"]
    types = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.int32(), pa.binary()]

    def run(batches):
        held("jaccard")
        counts = np.zeros(1 << bits, np.uint32)
        for batch in batches:
            sets = [shingles(t, words) for t in _as_bytes(batch.column(1))]
            n = len(sets)
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            parities = [np.frombuffer(parity(s), np.int64) for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((batch.column(0), [len(s) for s in sets], digests, parities, [None] * n, [None] * n), types)], names=names)
            for s in sets:
                np.add.at(counts, (s & np.uint64(len(counts) - 1)).astype(np.intp), np.uint32(1))
        pack = zstandard.ZstdCompressor(level=1).compress
        packed = [pack(counts[k * block : (k + 1) * block].tobytes()) for k in range(BLOCKS)]
        none = [None] * BLOCKS
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((none, none, none, none, range(BLOCKS), packed), types)], names=names)

    return map_batches(texts, run, "doc_id bigint, n_shingles bigint, digest binary, parity array<bigint>, block int, counts binary")


def _levels(parts: DataFrame, bits: int) -> np.ndarray:
    """The summed sketch, a byte for each counter: eight steps for each doubling."""

    def summed(key, tables):
        unpack, total = zstandard.ZstdDecompressor().decompress, 0
        for table in tables:
            for c in table.column("counts").to_pylist():
                total = total + np.frombuffer(unpack(c), np.uint64 if len(unpack(c)) == size * 8 else np.uint32).astype(np.uint64)
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([zstandard.ZstdCompressor(level=1).compress(total.tobytes())], pa.binary())})

    size = (1 << bits) // BLOCKS
    # In two steps, so that no task reads the blocks of all partitions.
    some = parts.groupBy("block", (F.spark_partition_id() % 32).alias("part")).applyInArrow(lambda key, t: summed(key, [t]), "block int, counts binary")
    rows = some.groupBy("block").applyInArrow(lambda key, t: summed(key, [t]), "block int, counts binary").collect()  # BLOCKS rows
    levels = np.zeros(1 << bits, np.uint8)
    for row in rows:
        counts = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(row["counts"])), np.uint64)
        levels[row["block"] * size : (row["block"] + 1) * size] = np.minimum(255, np.rint(8 * np.log2(np.maximum(counts, 1))))
    return levels


def prefix_length(n: int, percent: int, matches: int) -> int:
    """Shingles in the prefix that asks for so many matches."""
    return n - -(-n * percent // 100) + matches


def pick_matches(lists: np.ndarray, n: int, percent: int) -> int:
    """How many matches to ask for: lists are the estimated lengths of the lists of a set's first shingles."""
    most = min(MOST_MATCHES, -(-n * percent // 100))
    read = np.cumsum(lists)
    cost = [(s := read[prefix_length(n, percent, m) - 1]) + s / m * VERIFY_COST for m in range(1, most + 1)]
    return 1 + int(np.argmin(cost))


def prefixes(texts: DataFrame, words: int, percent: int, levels: np.ndarray) -> DataFrame:
    """doc_id, n, matches, centrality, and the shingles of the prefix with their salts."""
    shipped = texts.sparkSession.sparkContext.broadcast(levels)

    def run(batches):
        levels = shipped.value
        mask, usual, sizes = np.uint64(len(levels) - 1), 2.0 ** (np.median(levels) / 8), 2.0 ** (np.arange(256) / 8)
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), _as_bytes(batch.column(1))):
                s = shingles(text, words)
                if doc is None or not len(s):
                    continue
                at = levels[s & mask]
                # The sets are sorted, so that equally rare shingles stand in the order of their hashes.
                order = np.argsort(at, kind="stable")[: prefix_length(len(s), percent, MOST_MATCHES)]
                near = sizes[at[order]]
                m = pick_matches(np.maximum(near - usual, 0), len(s), percent)
                taken = order[: prefix_length(len(s), percent, m)]
                lists, salts = near[: len(taken)], np.zeros(len(taken), np.int32)
                if lists[-1] > 2 * LONG_LIST:
                    salts = np.where(lists > 2 * LONG_LIST, 1 + doc % np.ceil(lists / LONG_LIST), 0).astype(np.int32)
                out.append((doc, len(s), m, int(at[taken].mean()), s[taken].view(np.int64), salts))
            cols = list(zip(*out)) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    names = ["doc_id", "n", "matches", "centre", "prefix", "salts"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32())]
    return map_batches(texts, run, "doc_id bigint, n bigint, matches int, centre int, prefix array<bigint>, salts array<int>")


def _shared(batches):
    """Of postings sorted by shingle and falling centrality, those that share their shingle, with
    the block of the list that they lie in and the list's first document."""
    names, last = ["token", "salt", "doc", "n", "place", "matches", "centre", "pivot", "block"], None
    for batch in batches:
        token, salt, doc = (batch.column(k).to_numpy() for k in range(3))
        if not len(token):
            continue
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (salt[1:] != salt[:-1])
        goes_on = last is not None and (last[0], last[1]) == (token[0], salt[0])
        new[0] = not goes_on
        run = np.cumsum(new) - (0 if goes_on else 1)
        starts, firsts = np.flatnonzero(new), doc[new]
        if goes_on:
            starts, firsts = np.concatenate(([-last[4]], starts)), np.concatenate(([last[2]], firsts))
        pivot, at = firsts[run], np.arange(len(token)) - starts[run]
        block = salt.astype(np.int64) << 32 | at // LIST_BLOCK
        rows = pa.RecordBatch.from_arrays([*batch.columns, pa.array(pivot), pa.array(block)], names=names)
        alone = np.bincount(run, minlength=len(firsts)) == 1
        if goes_on:
            alone[0] = False
            if last[3] is not None:
                yield last[3]
        keep = ~alone[run] | (salt > 0)
        held = None
        if alone[run[-1]] and new[-1] and not keep[-1]:
            held = rows.slice(len(token) - 1, 1)
        last = (token[-1], salt[-1], pivot[-1], held, int(at[-1]) + 1)
        yield rows.filter(pa.array(keep))


def shared_postings(marked: DataFrame) -> DataFrame:
    """The places of prefix shingles that more than one document has."""
    posted = marked.select("doc_id", "n", "matches", "centre", F.posexplode(F.arrays_zip("prefix", "salts")).alias("place", "at"))
    posted = posted.select(F.col("at.prefix").alias("token"), F.col("at.salts").alias("salt"), F.col("doc_id").alias("doc"), F.col("n").cast("int").alias("n"), "place", "matches", "centre")
    sorted_ = posted.repartition("token", "salt").sortWithinPartitions("token", "salt", F.desc("centre"), "doc")
    return map_batches(sorted_, _shared, "token bigint, salt int, doc bigint, n int, place int, matches int, centre int, pivot bigint, block bigint", rows=8192)


def verify(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are as similar as asked, checked exactly."""
    pairs = checkpointed(pairs.distinct())
    freed(texts.sparkSession)
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    named = texts.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")

    def sets(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(t, words).tobytes() for t in _as_bytes(batch.column(1))], pa.binary())], names=["doc_id", "set"])

    found = map_batches(named, sets, "doc_id bigint, set binary")
    first, second = (found.select(F.col("doc_id").alias(k), F.col("set").alias(f"set_{k}")) for k in "ab")

    def check(batches):
        for batch in batches:
            ok, seen = [], (None, None)
            for a, b in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    joined = pairs.join(second, "b").join(first, "a").select("a", "b", "set_a", "set_b")
    return checkpointed(map_batches(joined, check, "a bigint, b bigint").distinct())


def link(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, n_shingles, component_id (the least id of its component)."""
    texts = text_rows(docs, id_col, text_col)
    bits = sketch_bits(texts)
    told = checkpointed(profile(texts, words, bits))
    rows = told.where(F.col("block").isNull()).select("doc_id", "n_shingles", "digest", "parity")
    levels = _levels(told.where(F.col("block").isNotNull()).select("block", "counts"), bits)
    nodes = rows.where("n_shingles > 0 and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("node"), F.first("parity").alias("parity"))

    lists = checkpointed(shared_postings(prefixes(texts, words, percent, levels).join(nodes.select(F.col("node").alias("doc_id")), "doc_id", "left_semi")))
    freed(docs.sparkSession)
    # Of a set, the shingles before the first one that another prefix has are in no set it links with.
    about = lists.groupBy("doc").agg(F.first("n").alias("n"), (F.first("n") - F.min("place")).alias("most"), F.first("centre").alias("centre"))
    about = about.join(nodes.withColumnRenamed("node", "doc").drop("digest"), "doc")
    about = checkpointed(about.withColumn("folded", _folded(F.col("parity"))))
    lists = lists.select("token", "salt", "block", "doc", "place", "matches", "pivot")
    # Each document meets the first one that it shares the most shingles with; others, only if that leaves them apart.
    near = lists.where("doc <> pivot").groupBy(F.col("pivot").alias("a"), F.col("doc").alias("b")).agg(F.count("*").alias("shared"))
    near = checkpointed(_plausible(near, about, percent))
    freed(docs.sparkSession)
    if near.count() <= FEW_PAIRS:
        # Choosing among few pairs takes more steps than it spares.
        links = verify(near.select("a", "b"), texts, words, percent)
    else:
        most = near.groupBy("b").agg(F.max_by("a", F.struct("shared", -F.col("a"))).alias("a"))
        links = verify(most.select("a", "b"), texts, words, percent)
        freed(docs.sparkSession)
        rest = checkpointed(_apart(near.select("a", "b").join(most, ["a", "b"], "left_anti"), components(links)))
        freed(docs.sparkSession)
        links = links.unionByName(verify(rest, texts, words, percent))
    freed(docs.sparkSession)

    # A list's first document has met all others of its list; one of a split list has not.
    lists, turn, parts = lists.where("doc <> pivot or salt > 0").drop("salt", "pivot"), 0, components(links)
    while not (lists := _across(lists, about, parts, percent)).isEmpty():
        if turn < MOST_ROUNDS and _pairs_across(lists) > MANY_PAIRS:
            met = _told(lists, lists.groupBy("token").agg(F.max_by(F.struct("doc", "part"), F.struct("centre", -F.col("doc"))).alias("c")))
            pairs = met.where(F.col("part") != F.col("c.part")).select(F.col("c.doc").alias("a"), F.col("doc").alias("b")).distinct()
            more = verify(_plausible(pairs, about, percent), texts, words, percent)
            lists = met.where("doc <> c.doc")
            turn = turn + 1 if more.count() >= FEW_LINKS else MOST_ROUNDS
        else:
            pairs = _plausible(_candidates(lists, percent), about, percent)
            more, lists = verify(pairs, texts, words, percent), lists.limit(0)
        lists = lists.select("token", "block", "doc", "place", "matches")
        if not more.isEmpty():
            links = links.unionByName(more)
            parts = components(links)
        freed(docs.sparkSession)
    home = nodes.join(parts.withColumnRenamed("id", "node"), "node", "left").select("digest", F.coalesce("component", "node").alias("home"))
    return rows.join(home, "digest", "left").select(
        "doc_id", "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("home")).otherwise(F.col("doc_id")).alias("component_id")
    )


def _plausible(pairs: DataFrame, about: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) less those that sizes, places or parity sketches rule out."""
    names = pairs.columns
    for k in "ab":
        pairs = pairs.join(about.select(F.col("doc").alias(k), *(F.col(c).alias(f"{c}_{k}") for c in ("n", "most", "parity"))), k)
    return pairs.where(_may_link("a", "b", percent)).select(*names)


def _apart(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose documents lie in different parts."""
    for k in "ab":
        pairs = pairs.join(parts.select(F.col("id").alias(k), F.col("component").alias(f"part_{k}")), k, "left")
    return pairs.where(F.coalesce("part_a", "a") != F.coalesce("part_b", "b")).select("a", "b")


def _may_link(x: str, y: str, percent: int, folded: bool = False):
    """Whether the sets of two sides, of which `most` shingles can be common, may be as similar as asked."""
    of = lambda name: (F.col(f"{name}_{x}"), F.col(f"{name}_{y}"))
    few = _few_folded_differences(*of("n"), *of("folded"), percent) if folded else _few_differences(*of("n"), *of("parity"), percent)
    return _fits(*of("n"), *of("most"), percent) & few


def _fits(n, m, most, most_m, percent):
    return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (F.least(most, most_m) * (100 + percent) >= (n + m) * percent)


def _folded(parity):
    """A sketch of fewer bits: those of a place modulo FOLDED_BITS flip the same one."""
    words, all_ = FOLDED_BITS // 64, PARITY_BITS // 64
    return F.array(*(reduce(lambda a, b: a.bitwiseXOR(b), [parity[i] for i in range(k, all_, words)]) for k in range(words)))


def _few_folded_differences(n, m, x, y, percent):
    """The same for folded sketches, spelled out so that it stays within generated code."""
    differ = sum(F.bit_count(x[k].bitwiseXOR(y[k])) for k in range(FOLDED_BITS // 64))
    return differ * (100 + percent) <= (n + m) * (100 - percent)


def _few_differences(n, m, x, y, percent):
    """Whether parity sketches allow sets of n and m shingles to be as similar as asked."""
    differ = F.aggregate(F.zip_with(x, y, lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, k: s + k)
    return differ * (100 + percent) <= (n + m) * (100 - percent)


def _told(lists: DataFrame, of_tokens: DataFrame) -> DataFrame:
    """The lists with what is known of their tokens; it is told to blocks first, so that no long list meets in one task."""
    blocks = lists.select("token", "block").distinct().join(of_tokens, "token")
    return lists.join(blocks, ["token", "block"])


def _across(lists: DataFrame, about: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """The lists that hold documents of more than one part, with what is known of each,
    less the documents that can link with none of their list. In steps, as one plan of them all fills the driver."""
    placed = about.join(parts.select(F.col("id").alias("doc"), "component"), "doc", "left").withColumn("part", F.coalesce("component", "doc")).drop("component")
    placed = lists.join(placed.drop("parity", "folded"), "doc")
    mixed = checkpointed(placed.groupBy("token").agg(F.min("part").alias("x"), F.max("part").alias("y"), F.min("n").alias("least"), F.max("most").alias("top")).where("x <> y"))
    freed(lists.sparkSession)
    able = _told(placed, mixed.select("token", "least", "top"))
    able = checkpointed(able.where(_fits(F.col("n"), F.greatest("least", F.ceil(F.col("n") * percent / 100)), F.col("most"), F.col("top"), percent)).drop("least", "top"))
    freed(lists.sparkSession)
    still = able.groupBy("token").agg(F.min("part").alias("x"), F.max("part").alias("y")).where("x <> y").select("token")
    found = checkpointed(_told(able, still).join(about.select("doc", "folded"), "doc"))
    freed(lists.sparkSession)
    return found


def _pairs_across(lists: DataFrame) -> int:
    by_part = lists.groupBy("token", "part").count().groupBy("token").agg(F.sum("count").alias("s"), F.sum(F.col("count") * F.col("count")).alias("q"))
    return by_part.agg(F.sum((F.col("s") * F.col("s") - F.col("q")) / 2)).first()[0] or 0


def _candidates(lists: DataFrame, percent: int) -> DataFrame:
    """Pairs across parts that share enough shingles of their prefixes. Every two blocks of a list are
    joined by themselves, unless both hold a single part, the same."""
    blocks = checkpointed(lists.groupBy("token", "block").agg(F.min("part").alias("x"), F.max("part").alias("y")))
    first, second = (blocks.select("token", *(F.col(c).alias(f"{c}_{k}") for c in ("block", "x", "y"))) for k in "xy")
    meet = checkpointed(first.join(second, "token").where("block_x <= block_y and (x_x <> y_x or x_y <> y_y or x_x <> x_y)").select("token", "block_x", "block_y"))
    freed(lists.sparkSession)
    x, y = (
        lists.select("token", F.col("block").alias(f"block_{k}"), *(F.col(c).alias(f"{c}_{k}") for c in ("doc", "n", "most", "place", "matches", "part", "folded"))).join(meet, ["token", f"block_{k}"])
        for k in "xy"
    )
    matches = F.least("matches_x", "matches_y")
    within = lambda k: F.col(f"place_{k}") < F.col(f"n_{k}") - F.ceil(F.col(f"n_{k}") * percent / 100) + matches
    once = (F.col("block_x") < F.col("block_y")) | (F.col("doc_x") < F.col("doc_y"))
    pairs = x.join(y, ["token", "block_x", "block_y"]).where(once & (F.col("part_x") != F.col("part_y")) & within("x") & within("y") & _may_link("x", "y", percent, folded=True))
    asked = pairs.groupBy(F.least("doc_x", "doc_y").alias("a"), F.greatest("doc_x", "doc_y").alias("b")).agg(F.count("*").alias("shared"), F.min(matches).alias("asked"))
    return asked.where("shared >= asked").select("a", "b")
