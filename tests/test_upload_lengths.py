"""Uploads of documents without a text: only the files that the query empties are empty."""

import duckdb

from folioworks import catalog


def test_documents_without_characters_are_admitted_as_in_sql(spark, tmp_path):
    rows = [(i, n) for i, n in enumerate((0, 0, None, 5000, 5001, 0, -1, 0, 9))] + [(None, 0), (None, 6000), (10, None), (21, None), (-5, 7), (-9, 0)]
    spark.createDataFrame(rows, "doc_id long, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    got = [(r.doc_id, r.reject_reason, r.outcome) for r in catalog.QUERIES["upload_routing"](spark, str(tmp_path)).collect()]
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(got, key=str) == sorted(con.execute(catalog.ORACLE_SQL["upload_routing"]).fetchall(), key=str)
    assert (1, None, "archive") in got and (5, "empty", "failed") in got
