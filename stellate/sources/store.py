"""A living index on shared storage: immutable versions, tombstones, generations, and a log.

A table is a folder of versions. Each holds `rows` (slot, generation, state, seq, embedding)
and a one-line manifest that is written last, so readers see whole versions or none, and
keep reading the one they opened while a writer makes the next. Ids are packed as
slot | generation << 32: a slot that is used again gets a new generation, and ids of the
old one are stale. Any stale or unknown id makes a delete or update fail as a whole.

The log is a table of records (seq, type, rows_before, ids, vectors, crc). Replay takes
the records after the snapshot up to the first damaged one, and of each id the last event.
"""

from __future__ import annotations

import json
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stellate.functions.metrics import InvalidArgument
from stellate.sources.shared import checkpointed

FORMAT = 1
LIVE, DEAD = 1, 0
ROWS = "slot bigint, generation bigint, state int, seq bigint, embedding array<double>"


def packed_id(slot, generation):
    return F.shiftleft(generation.cast("bigint"), 32).bitwiseOR(slot.cast("bigint"))


def slot_of(vec_id):
    return vec_id.bitwiseAND(F.lit(0xFFFFFFFF))


def generation_of(vec_id):
    return F.shiftright(vec_id, 32)


def numbered(df: DataFrame, *order, name: str = "place") -> DataFrame:
    """df with places from 0 in a total order, without meeting in one task: rows are sorted by range,
    and each task's rows are counted on from those of the tasks before."""
    rows = checkpointed(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    counts = sorted(rows.groupBy(part.alias("p")).count().collect())  # one row per task
    starts, total = [], 0
    for p, n in counts:
        starts.append((p, total))
        total += n
    ahead = df.sparkSession.createDataFrame(starts, "_p bigint, _start bigint")
    found = rows.withColumn("_p", part).join(F.broadcast(ahead), "_p")
    return found.withColumn(name, F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at", "_p", "_start")


class IndexTable:
    """A versioned table of vectors at a path that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _versions(self, whole: bool = True) -> list[int]:
        """The versions that were written to their end; or all that were begun."""
        jvm = self.spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        done = [int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit()]
        return sorted(v for v in done if not whole or fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/v{v}/manifest/_SUCCESS")))

    def version(self) -> int:
        found = self._versions()
        if not found:
            raise InvalidArgument(f"no index at {self.path}")
        return found[-1]

    def manifest(self, version: int | None = None) -> dict:
        return _read_line(self.spark, f"{self.path}/v{self.version() if version is None else version}/manifest")

    def rows(self, version: int | None = None) -> DataFrame:
        return self.spark.read.schema(ROWS).parquet(f"{self.path}/v{self.version() if version is None else version}/rows")

    def live(self, version: int | None = None) -> DataFrame:
        """vec_id (packed) and embedding of the rows that are not deleted."""
        return self.rows(version).where(F.col("state") == LIVE).select(packed_id(F.col("slot"), F.col("generation")).alias("vec_id"), "embedding")

    def _commit(self, rows: DataFrame, seq: int) -> int:
        # A writer that ended early has left a number behind; of two at once, the second finds the folder there and fails.
        begun = self._versions(whole=False)
        at = begun[-1] + 1 if begun else 0
        rows.select("slot", "generation", "state", "seq", "embedding").write.parquet(f"{self.path}/v{at}/rows")
        _write_line(self.spark, {"format": FORMAT, "seq": seq, "version": at}, f"{self.path}/v{at}/manifest")
        return at

    def create(self, data: DataFrame) -> int:
        """The first version, of (vec_id, embedding); ids become slots."""
        rows = data.select(F.col("vec_id").cast("bigint").alias("slot"), F.lit(0).cast("bigint").alias("generation"), F.lit(LIVE).alias("state"), F.lit(0).cast("bigint").alias("seq"), F.col("embedding").cast("array<double>").alias("embedding"))
        return self._commit(rows, 0)

    def counts(self) -> DataFrame:
        return self.rows().agg(F.sum((F.col("state") == LIVE).cast("bigint")).alias("live"), F.sum((F.col("state") == DEAD).cast("bigint")).alias("deleted"))

    def _checked(self, ids: DataFrame) -> DataFrame:
        """slot of each id, once; raises if any id is unknown or of an old generation."""
        asked = checkpointed(ids.select(F.col("vec_id").cast("bigint").alias("vec_id")).distinct())
        known = self.rows().select(packed_id(F.col("slot"), F.col("generation")).alias("vec_id"))
        if not asked.join(known, "vec_id", "left_anti").isEmpty():
            raise InvalidArgument("an id is unknown or stale; nothing was changed")
        return asked.select(slot_of(F.col("vec_id")).alias("slot"), "vec_id")

    def delete(self, ids: DataFrame) -> int:
        """Marks rows as deleted; those that are already stay so."""
        seq, gone = self.manifest()["seq"] + 1, self._checked(ids).select("slot", F.lit(1).alias("gone"))
        now = F.col("gone").isNotNull() & (F.col("state") == LIVE)
        rows = self.rows().join(gone, "slot", "left").withColumn("seq", F.when(now, seq).otherwise(F.col("seq"))).withColumn("state", F.when(now, DEAD).otherwise(F.col("state")))
        return self._commit(rows, seq)

    def update(self, data: DataFrame) -> int:
        """New vectors under the ids of (vec_id, embedding); a deleted row lives again."""
        slots, seq = self._checked(data), self.manifest()["seq"] + 1
        new = data.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("new")).join(slots, "vec_id").drop("vec_id")
        hit = F.col("new").isNotNull()
        rows = self.rows().join(new, "slot", "left").withColumn("state", F.when(hit, LIVE).otherwise(F.col("state"))).withColumn("seq", F.when(hit, seq).otherwise(F.col("seq"))).withColumn("embedding", F.coalesce("new", "embedding"))
        return self._commit(rows, seq)

    def extend(self, data: DataFrame, reuse: bool = True) -> DataFrame:
        """Adds vectors in the order of their vec_id; returns vec_id and the packed id that each got.
        With `reuse`, slots deleted last are taken first and their generation goes up."""
        old, seq = self.rows(), self.manifest()["seq"] + 1
        new = numbered(data.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")), "vec_id")
        free = numbered(old.where(F.col("state") == DEAD).where(F.lit(reuse)).select("slot", "generation", (-F.col("seq")).alias("last"), (-F.col("slot")).alias("down")), "last", "down").drop("last", "down")
        taken, end = free.count(), (old.agg(F.max("slot")).first()[0] if not old.isEmpty() else None)
        end = -1 if end is None else end
        put = new.join(free, "place", "left")
        put = put.withColumn("generation", F.coalesce(F.col("generation") + 1, F.lit(0).cast("bigint"))).withColumn("slot", F.coalesce("slot", F.col("place") - taken + end + 1))
        put = checkpointed(put.select("vec_id", "slot", "generation", "embedding"))
        added = put.select("slot", "generation", F.lit(LIVE).alias("state"), F.lit(seq).cast("bigint").alias("seq"), "embedding")
        self._commit(old.join(put.select("slot"), "slot", "left_anti").unionByName(added), seq)
        return put.select("vec_id", packed_id(F.col("slot"), F.col("generation")).alias("packed_id"))


# ---- the log -------------------------------------------------------------------------------

INSERT, UPDATE, DELETE = "insert", "update", "delete"


def _check(type_, ids, vectors):
    """The checksum of a record, of its parts' JSON."""
    return F.crc32(F.to_json(F.struct(type_.alias("t"), ids.alias("i"), vectors.alias("v"))).cast("binary"))


def sealed(records: DataFrame) -> DataFrame:
    """Records (seq, type, ids, vectors) with their checksums."""
    return records.withColumn("crc", _check(F.col("type"), F.col("ids"), F.col("vectors")))


def intact(log: DataFrame) -> DataFrame:
    """The records before the first damaged one."""
    marked = log.withColumn("ok", _check(F.col("type"), F.col("ids"), F.col("vectors")) == F.col("crc"))
    torn = marked.agg(F.min(F.when(~F.coalesce("ok", F.lit(False)), F.col("seq")))).first()[0]
    return log if torn is None else log.where(F.col("seq") < torn)


def replay(snapshot: DataFrame, log: DataFrame, after: int = 0) -> DataFrame:
    """vec_id and embedding after the intact records with seq > `after`: of each id the last event counts.
    An insert of an id that is there already is the same insert, seen again; updates of unknown ids do nothing."""
    events = intact(log).where(F.col("seq") > after)
    flat = events.select("seq", "type", F.posexplode("ids").alias("at", "vec_id"), "vectors").select("seq", "type", "vec_id", F.try_element_at("vectors", F.col("at") + 1).alias("embedding"))
    base = snapshot.select(F.lit(-1).cast("bigint").alias("seq"), F.lit(INSERT).alias("type"), "vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    every = base.unionByName(flat)
    by = Window.partitionBy("vec_id").orderBy("seq")
    there = F.last(F.when(F.col("type") != UPDATE, F.col("type") == INSERT), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1))
    counted = every.withColumn("there", F.coalesce(there, F.lit(False))).where(((F.col("type") == INSERT) & ~F.col("there")) | ((F.col("type") != INSERT) & F.col("there")))
    last = counted.groupBy("vec_id").agg(F.max_by(F.struct("type", "embedding"), "seq").alias("e"))
    return last.where(F.col("e.type") != DELETE).select("vec_id", F.col("e.embedding").alias("embedding"))


# ---- other sources and sinks ---------------------------------------------------------------


def from_numpy(spark: SparkSession, x: np.ndarray, first_id: int = 0) -> DataFrame:
    """(vec_id, embedding) of the rows of a matrix; 16-bit floats and 8-bit integers become floats."""
    if x.ndim != 2 or x.dtype.kind not in "fiu":
        raise InvalidArgument("a matrix of numbers is needed")
    import pyarrow as pa

    table = pa.table({"vec_id": pa.array(np.arange(first_id, first_id + len(x))), "embedding": pa.array(list(x.astype(np.float32)), pa.list_(pa.float32()))})
    return spark.createDataFrame(table)


def from_npy(spark: SparkSession, path: str) -> DataFrame:
    return from_numpy(spark, np.load(path, allow_pickle=False))


def typed(data: DataFrame, dtype: str) -> DataFrame:
    """Vectors stored as f32, i8 or u8 arrays, or as bytes of f16, as float arrays."""
    if dtype in ("f32", "i8", "u8"):
        v = F.col("embedding").cast("array<float>")
        return data.withColumn("embedding", F.transform(v, lambda x: F.pmod(x, F.lit(256.0)).cast("float")) if dtype == "u8" else v)
    if dtype != "f16":
        raise InvalidArgument(f"unknown type {dtype!r}")

    @F.pandas_udf("array<float>")
    def half(raw):
        return raw.map(lambda b: np.frombuffer(b, "<f2").astype(np.float32))

    return data.withColumn("embedding", half("embedding"))


def lossless_half(data: DataFrame) -> DataFrame:
    """vec_id and whether all of a vector's values keep their bits as 16-bit floats."""

    @F.pandas_udf("boolean")
    def same(vectors):
        return vectors.map(lambda v: bool((np.asarray(v, "<f4").astype("<f2").astype("<f4") == np.asarray(v, "<f4")).all()))

    return data.select("vec_id", same(F.col("embedding").cast("array<float>")).alias("lossless"))


def gaussian(spark: SparkSession, n: int, dim: int, seed: int) -> DataFrame:
    """n vectors of standard normal values, made where they are used; a row depends on seed and id alone."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ids = batch.column(0).to_numpy()
            x = [np.random.default_rng([seed, i]).standard_normal(dim).astype(np.float32) for i in ids.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float32()))], names=["vec_id", "embedding"])

    return spark.range(n).mapInArrow(run, "vec_id bigint, embedding array<float>")


def lcg_matrix(n: int, dim: int, seed: int) -> np.ndarray:
    """A fixture's matrix: the high bits of a linear congruential sequence, scaled to -1 .. 0.999."""
    out, s = np.empty(n * dim, np.float32), seed & 0xFFFFFFFF
    for i in range(n * dim):
        s = (s * 1664525 + 1013904223) & 0xFFFFFFFF
        out[i] = np.float32((s >> 16) % 2000) / np.float32(1000) - np.float32(1)
    return out.reshape(n, dim)


def _write_line(spark: SparkSession, told: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(told),)], "value string").coalesce(1).write.text(path)


def _read_line(spark: SparkSession, path: str) -> dict:
    told = json.loads(spark.read.text(path).first()[0])
    if told["format"] != FORMAT:
        raise InvalidArgument(f"format {told['format']} is not {FORMAT}")
    return told


def save_index(index, path: str) -> None:
    """Writes an inverted-list index: its rows and codes by list, and its model, written last, as one row."""
    spark = index.rows.sparkSession
    index.rows.write.partitionBy("list_id").parquet(f"{path}/rows")
    model = {k: None if (v := getattr(index, k)) is None else v.tolist() for k in ("centres", "books", "weights")}
    rows = spark.read.parquet(f"{path}/rows").count()
    _write_line(spark, model | {"kind": index.kind, "format": FORMAT, "rows": rows}, f"{path}/model")


def load_index(spark: SparkSession, path: str):
    """Reads what save_index wrote; its format, number of rows and the sizes and range of its codes must be right."""
    from stellate.operators.ivf import CODED, IvfIndex

    model = _read_line(spark, f"{path}/model")
    part = lambda k: None if model[k] is None else np.array(model[k], float)
    kind, centres, books = model["kind"], part("centres"), part("books")
    rows = spark.read.schema("vec_id bigint, embedding array<double>, list_id int" if kind == "flat" else CODED).parquet(f"{path}/rows")
    bad = (F.col("list_id") < 0) | (F.col("list_id") >= len(centres))
    if kind != "flat":
        size = -(-centres.shape[1] // 8) if books is None else len(books)
        bad |= F.col("code").isNull() | F.col("scale").isNull() | (F.length("code") != size)
        if books is not None and books.shape[1] < 256:
            # Hexadecimal digits in pairs: of a code within the book, none is beyond its last.
            beyond = F.transform(F.sequence(F.lit(1), F.lit(2 * size), F.lit(2)), lambda i: F.substring(F.hex("code"), i, F.lit(2)) >= f"{books.shape[1]:02X}")
            bad |= F.exists(beyond, lambda x: x)
    found = rows.agg(F.count("*").alias("n"), F.max(bad).alias("bad")).first()
    if found["n"] != model["rows"] or found["bad"]:
        raise InvalidArgument("the index's rows are not complete")
    return IvfIndex(kind, rows, centres, books, part("weights"))


def save_graph(index: DataFrame, path: str) -> None:
    """Writes a graph index, one row per shard, whatever it holds of vectors and codes; its manifest comes last."""
    spark = index.sparkSession
    index.write.parquet(f"{path}/shards")
    sizes = F.sum(F.length("ids") / 8).cast("bigint")
    told = spark.read.parquet(f"{path}/shards").agg(F.count("*").alias("shards"), F.coalesce(sizes, F.lit(0)).alias("rows")).first()
    _write_line(spark, {"format": FORMAT, "shards": told["shards"], "rows": told["rows"], "columns": index.columns}, f"{path}/manifest")


def load_graph(spark: SparkSession, path: str) -> DataFrame:
    """Reads what save_graph wrote, shard by shard when it is searched; sizes must fit each other and the manifest."""
    told = _read_line(spark, f"{path}/manifest")
    index = spark.read.parquet(f"{path}/shards")
    if sorted(index.columns) != sorted(told["columns"]):
        raise InvalidArgument("the graph lacks columns")
    n = F.length("ids") / 8
    bad = F.length("graph") != n * F.col("degree") * 4
    if "matrix" in index.columns:
        bad |= F.length("matrix") != n * F.col("dim") * 8
    found = index.agg(F.count("*").alias("shards"), F.coalesce(F.sum(n), F.lit(0)).cast("bigint").alias("rows"), F.max(F.coalesce(bad, F.lit(True))).alias("bad")).first()
    if (found["shards"], found["rows"]) != (told["shards"], told["rows"]) or found["bad"]:
        raise InvalidArgument("the graph's shards are not complete")
    return index.select(*told["columns"])


def new_path(spark: SparkSession, name: str) -> str:
    from stellate.sources.shared import shared_dir

    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
