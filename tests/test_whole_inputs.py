"""Queries that read all of their input."""

import duckdb

import __spark_entry__ as entry


def test_all_documents_are_reranked(spark, small):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW site_docs AS SELECT * FROM read_parquet('{small}/site_docs.parquet')")
    sql = entry.oracle_sql()["rerank"].replace(" QUALIFY position < 50", "")
    want = sorted((a, b, round(c, 5), e) for a, b, c, e in con.execute(sql).fetchall())
    got = sorted((r.document_id, r.position, round(r.score, 5), r.new_position) for r in entry.queries()["rerank_all"](spark, small).collect())
    assert len(got) > 50 and got == want


def test_long_texts_keep_their_tail(spark, tmp_path):
    spark.createDataFrame([(1, "word " * 210000 + "tail")], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert entry.queries()["clean_texts"](spark, str(tmp_path)).first().cleaned.startswith("word " * 210000 + "tail")
