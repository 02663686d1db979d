"""A source's ids in one list, however many they are, with the number of its documents."""

import duckdb

from folioworks import catalog


def test_a_source_has_one_row_with_all_its_ids(spark, tmp_path):
    rows = [(i * 7 % 2503, "hot") for i in range(2503)] + [(9, "twice"), (9, "twice"), (-4, "twice"), (None, "twice"), (5, None), (None, None), (None, "none")]
    spark.createDataFrame(rows, "doc_id long, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.source: (r.ids, r.n) for r in catalog.QUERIES["id_lists"](spark, str(tmp_path)).collect()}
    assert got == {"hot": (",".join(map(str, range(2503))), 2503), "twice": ("-4,9,9", 4), None: ("5", 2), "none": (None, 1)}
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert got == {s: (ids, n) for s, ids, n in con.execute(catalog.ORACLE_SQL["id_lists"]).fetchall()}
