"""Exact deduplication of texts, with frequent texts split off.

Texts are equal when they are identical after deleting the six ASCII white-space
characters; their SHA-256 digests stand for them. A Misra-Gries summary per partition,
merged by sums, names the candidates for frequent digests: any digest that has more
than 2 / capacity of all rows is among them. Their copies are then counted exactly and
the row that stays is found; these verified winners, at most `capacity` rows, are
broadcast, so rows of frequent texts are settled on the map side and never meet in one
task. The remaining digests take an ordinary shuffle: a partial aggregation, joined
back to the rows.

Of equal texts the row with the most code points in its original text stays, then the
smallest id; rows without an id lose ties. Defined cases: a null text counts as empty,
and all empty texts are one group; an empty table gives an empty result; a row that is
repeated in full gets the same decision each time from `decide`, and `drop_copies`
leaves one of them; other columns, whatever their names, take no part.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, text_rows

#: Fixed value: the characters that do not count.
BLANKS = " \t\n\x0b\x0c\r"
#: Counters of a summary, and so the most rows that are ever broadcast.
CAPACITY = 1024
#: Keys of rows that go, of about 60 bytes each, that may be broadcast.
BROADCAST_ROWS = 200_000
#: Groups under this size are left to the shuffle.
FREQUENT = 32


def digest_of(text):
    return F.unhex(F.sha2(F.translate(text, BLANKS, ""), 256))


def _merge(counts: Counter, capacity: int) -> Counter:
    """A Misra-Gries summary of `capacity` counters at most."""
    if len(counts) <= capacity:
        return counts
    floor = sorted(counts.values(), reverse=True)[capacity]
    return Counter({k: v - floor for k, v in counts.items() if v > floor})


def candidates(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """digest and a lower bound of its count, for at most `capacity` digests of `rows`."""

    def summarise(batches):
        counts: Counter = Counter()
        for batch in batches:
            counts.update(batch.column(0).to_pylist())
            counts = _merge(counts, capacity)
        yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], names=["digest", "least"])

    summed = rows.select("digest").mapInArrow(summarise, "digest binary, least bigint").groupBy("digest").agg(F.sum("least").alias("least"))
    return summed.orderBy(F.desc("least"), "digest").limit(capacity)


def _stays():
    """Orders rows of a group; the least stays."""
    return F.min(F.struct((-F.col("n_points")).alias("order"), F.col("doc_id").isNull().alias("no_id"), "doc_id")).alias("first")


def frequent(rows: DataFrame, capacity: int = CAPACITY, least: int = FREQUENT) -> DataFrame:
    """digest, group_size and first of frequent digests, counted exactly; at most `capacity` rows."""
    spark = rows.sparkSession
    named = rows.join(F.broadcast(candidates(rows, capacity)), "digest").groupBy("digest").agg(F.count("*").alias("group_size"), _stays())
    found = named.where(F.col("group_size") >= least).collect()  # bounded by the capacity
    return spark.createDataFrame(found, named.schema)


def _decided(rows: DataFrame, capacity: int, least: int) -> DataFrame:
    winners = frequent(rows, capacity, least)
    marked = rows.join(F.broadcast(winners), "digest", "left")
    rest = marked.where(F.col("group_size").isNull()).select("doc_id", "digest", "n_points")
    groups = rest.groupBy("digest").agg(F.count("*").alias("group_size"), _stays())
    return marked.where(F.col("group_size").isNotNull()).unionByName(rest.join(groups, "digest"))


def _kept():
    return F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("n_points") == -F.col("first.order"))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    texts = text_rows(docs, id_col, text_col)
    return checkpointed(texts.select("doc_id", digest_of("text").alias("digest"), F.length("text").alias("n_points")))


def decide(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, least: int = FREQUENT) -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id, group_size, kept, text_sha256."""
    return _decided(_rows(docs, id_col, text_col), capacity, least).select(
        "doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", _kept().alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, least: int = FREQUENT) -> DataFrame:
    """The rows of `docs`, with all their columns, of which each text has one.

    Only ids, digests and lengths are shuffled to decide. The texts stay where they are if the keys
    of rows that go are few, which is checked; else they are shuffled once, by key.
    """
    decided = checkpointed(_decided(_rows(docs, id_col, text_col), capacity, least).select("doc_id", "digest", "n_points", _kept().alias("kept")))
    gone = decided.where("not kept").select(F.col("doc_id").alias("id"), F.col("digest").alias("d"), F.col("n_points").alias("n")).distinct()
    few = gone.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), digest_of(text).alias("digest"), F.length(text).alias("n_points"))
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("d")) & (F.col("n_points") == F.col("n"))
    left = whole.join(F.broadcast(gone) if few else gone, same, "left_anti")
    # Rows that repeat the id and text of the one that stays; there are none where ids are unique.
    again = checkpointed(decided.where("kept").groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest"))
    if again.isEmpty():
        return left.select("row.*")
    nth = F.row_number().over(Window.partitionBy("digest").orderBy("doc_id"))
    one = left.join(again, "digest", "left_semi").withColumn("nth", nth).where("nth = 1")
    return left.join(again, "digest", "left_anti").select("row.*").unionByName(one.select("row.*"))


ORACLE_SQL = r"""
with t as (
  select doc_id, length(coalesce(text, '')) as n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as text_sha256
  from documents),
g as (
  select *, first_value(doc_id) over w as keep_id, count(*) over (partition by text_sha256) as group_size
  from t window w as (partition by text_sha256 order by n desc, doc_id))
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from g
"""
