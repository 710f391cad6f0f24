"""The queries of this package over the driver's tables, and their SQL twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import bpe, embed_dedup, exact_dedup, html_extract, jaccard_join, packing, quality, secrets, token_count, warc
from .common import table

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
UNIGRAM = public_tokenizers.path("piece_bpe_32k.model")


def op1_token_counts(spark, sf_dir):
    """Pieces of every whole text under the public pieces and scores, as a unigram tokenizer finds them."""
    return token_count.count_tokens(table(spark, sf_dir, "documents"), token_count.read_vocabulary(UNIGRAM))


def op2_bpe(spark, sf_dir):
    """Every whole text, encoded and decoded again."""
    found = bpe.encode(table(spark, sf_dir, "documents"), BYTE_BPE, decoded=True)
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


def op3_quality(spark, sf_dir):
    """A score of every whole text, learnt from the labels that are not held out."""
    docs = table(spark, sf_dir, "documents")
    found = quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    held = F.coalesce(quality.held_out(F.col("doc_id")), F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op4_exact_dedup(spark, sf_dir):
    """One decision per document: which of its equals stays."""
    return exact_dedup.decide(table(spark, sf_dir, "documents"))


def op5_secrets(spark, sf_dir):
    """Secrets of every whole text: counts, a digest of the fixed forms, and all spans."""
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def op6_embed_dedup(spark, sf_dir):
    """Vectors linked by a cosine of 0.95, with their components."""
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_jaccard_join(spark, sf_dir):
    """Documents linked by 85 percent of common 4-word shingles, with their components."""
    return jaccard_join.link(table(spark, sf_dir, "documents"), words=4, percent=85)


def op8_html_extract(spark, sf_dir):
    """The main text of every page."""
    found = html_extract.extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


def op9_packing(spark, sf_dir):
    """All documents in sequences of 2048 tokens at most, by pieces."""
    return packing.digest(packing.pack(table(spark, sf_dir, "documents"), BYTE_BPE, end_id=1))


def op10_warc(spark, sf_dir):
    """Every page written to archives and read back through their index."""
    folder = warc.new_folder(spark)
    index = warc.write(table(spark, sf_dir, "pages"), folder)
    return warc.read(index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Documents linked by common 4-word shingles, by joining all shingles.
JACCARD_SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select doc_id, unnest(list_distinct(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
  else list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) end)) as s from w),
n as (select doc_id, count(*) as n from s group by doc_id),
c as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.s = b.s and a.doc_id <> b.doc_id group by all),
p as (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
reach as (select distinct a as x, a as y from p union select r.x, p.b from reach r join p on r.y = p.a),
m as (select x, min(y) as m from reach group by x)
select d.doc_id, coalesce(n, 0)::bigint as n_shingles, coalesce(m, d.doc_id) as component_id
from documents d left join n on n.doc_id = d.doc_id left join m on m.x = d.doc_id
"""

QUERIES = (
    op1_token_counts,
    op2_bpe,
    op3_quality,
    op4_exact_dedup,
    op5_secrets,
    op6_embed_dedup,
    op7_jaccard_join,
    op8_html_extract,
    op9_packing,
    op10_warc,
)


def queries():
    return {f.__name__: f for f in QUERIES}


def oracle_sql():
    return {"op4_exact_dedup": exact_dedup.ORACLE_SQL, "op6_embed_dedup": embed_dedup.ORACLE_SQL, "op7_jaccard_join": JACCARD_SQL, "op10_warc": warc.ORACLE_SQL}
