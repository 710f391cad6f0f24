"""The package's queries over the smallest tables, the SQL twins, and the pipeline."""

import duckdb
import pytest

import corpus_pipeline
from stellate.llm import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    got, found = catalog.queries()[name](spark, SF), con.execute(catalog.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(got.columns)
    want = sorted(repr(tuple(r[columns.index(c)] for c in got.columns)) for r in found.fetchall())
    assert sorted(repr(tuple(r)) for r in got.collect()) == want


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_queries_cover_their_tables(spark, name):
    table = {"op6_embed_dedup": "embeddings", "op8_html_extract": "pages", "op10_warc": "pages"}.get(name, "documents")
    got, ids = catalog.queries()[name](spark, SF), spark.read.parquet(f"{SF}/{table}.parquet")
    key = got.columns[0]
    assert got.select(key).distinct().count() == ids.select(key).distinct().count()


def test_pipeline_stages(spark):
    docs = first = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == first.columns, name
        assert 0 < out.count() <= docs.count(), name
        docs = spark.createDataFrame(out.collect(), first.schema)
    assert corpus_pipeline.run(spark, SF).select("doc_id").distinct().count() == docs.count()


def test_pipeline_on_odd_rows(spark, tmp_path):
    """Nulls in any column, empty and very long texts, repeated rows and ids, clashing names, empty tables."""
    first = spark.read.parquet(f"{SF}/documents.parquet")
    good = [r.text for r in first.orderBy("doc_id").limit(6).collect()]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, digest string, node bigint, row string, label int"
    rows = [(1, good[0], None, None, None, "d", 1, "r", 0), (1, good[0], None, None, None, "d", 1, "r", 0), (2, None, "en", "s", 0, None, None, None, None), (3, "", None, None, 0, None, None, None, 1),
            (None, good[1], None, None, None, None, None, None, None), (4, good[1], None, None, None, None, None, None, None), (5, good[2] + " " + "word " * 40_000, None, None, 1, None, None, None, None),
            (6, good[3] + ' token = "908038b7daaf91e730d2f64001c52934d43d9336"', "en", "s", 9, None, None, None, None)]
    for k, table in enumerate(([], rows)):
        folder = str(tmp_path / f"sf{k}")
        docs = spark.createDataFrame(table, schema).repartition(3)
        docs.write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(1, 1), (None, 0), (6, None), (77, 0)], "doc_id bigint, quality int").write.parquet(f"{folder}/labels.parquet")
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
            assert out.columns == docs.columns, name
            assert out.count() <= len(table)
        got = corpus_pipeline.STAGES[1][1](spark, docs, folder).collect()
        assert sorted(str(r.doc_id) for r in got) == ([] if not table else ["1", "2", "4", "5", "6"])
        got = {r.doc_id: r for r in corpus_pipeline.STAGES[3][1](spark, docs, folder).collect()}
        assert not table or ("[SECRET]" in got[6].text and got[6].n_chars == len(got[6].text) and got[2].text is None)
        packed = corpus_pipeline.run(spark, folder).collect()
        assert {r.doc_id for r in packed} <= {r[0] for r in table}
