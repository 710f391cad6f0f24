"""The corpus pipeline over `documents`.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before it kept,
and returns a DataFrame that run() writes as Parquet to the shared folder and reads
again for the next. All but the last return the columns of documents.

Defined cases: a null text counts as empty. Empty texts are scored like others; those that
the classifier keeps are exact copies of each other, of which one stays, and it links with
no other document. Rows without an id are scored, compared and packed like others; of equal
texts they stay only if no row with an id and as many code points does, and no near copies
are looked for among them. Rows that repeat an id keep or lose their place together where
near copies are concerned, and by their own text elsewhere. An empty table gives an empty
result, and so does one from which every document goes; without usable labels every score
is the same. Columns beside those of documents pass all stages but the last unread, whatever
their names; only n_chars is set anew where a secret is marked.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import functions as F

from stellate.llm import exact_dedup, jaccard_join, packing, quality, secrets
from stellate.llm.common import checkpointed, removed, shared_dir, shuffles_removed, table, trimmed


def good_quality(spark, docs, sf_dir):
    """Documents whose quality score reaches the threshold; learnt from labels that are not held out."""
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def without_copies(spark, docs, sf_dir):
    """One document of each group of texts that are equal but for white space."""
    return exact_dedup.drop_copies(docs)


def without_near_copies(spark, docs, sf_dir):
    """The first document, by id, of each group linked by 80 percent of common 5-word shingles."""
    found = jaccard_join.link(docs, words=5, percent=80)
    gone = checkpointed(found.where("component_id <> doc_id").select(F.col("doc_id").alias("gone")).distinct())
    # Few ids, which is checked, go to every task; else the texts are shuffled by id.
    few = gone.limit(jaccard_join.BROADCAST_IDS + 1).count() <= jaccard_join.BROADCAST_IDS
    return docs.join(F.broadcast(gone) if few else gone, docs["doc_id"] == gone["gone"], "left_anti")


def without_secrets(spark, docs, sf_dir):
    """All documents, with a mark in place of each secret."""
    return secrets.redact(docs)


def packed(spark, docs, sf_dir):
    """The pieces of all documents in sequences of 2048 tokens at most."""
    return packing.digest(packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=1))


STAGES = [
    ("quality classifier", good_quality),
    ("exact dedup", without_copies),
    ("n-gram Jaccard join", without_near_copies),
    ("secret scans", without_secrets),
    ("packing", packed),
]

#: SQL can't express the classifier, the secret scans or the packing.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over the whole table; returns the last one's rows."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        with shuffles_removed(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            removed(spark, f"{folder}/{k - 1}")
        # A stage leaves the driver many plans: it starts the next one without them.
        trimmed()
        spark._jvm.System.gc()
    return docs
