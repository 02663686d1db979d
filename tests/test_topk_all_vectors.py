"""Every query of vector_topk meets all vectors, and once more those of its own label."""

import random

import duckdb

from folioworks import catalog
from folioworks.operators import nearest


def test_queries_meet_vectors_of_every_label(spark, tmp_path):
    r = random.Random(7)
    rows = [(i, [r.uniform(-1, 1) for _ in range(6)], None if i in (3, 300) else i % 4) for i in range(-200, 420)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted((x.query_id, x.filtered, x.rank, x.object_id, x.score) for x in catalog.QUERIES["vector_topk"](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    assert got == sorted(con.sql(catalog.ORACLE_SQL["vector_topk"]).select("query_id, filtered, rank, object_id, score").fetchall())
    label = {i: x for i, _, x in rows}
    free = [g for g in got if not g[1]]
    assert len(free) == 70 and any(label[g[3]] != label[g[0]] for g in free) and any(g[3] % 100 for g in free)
    assert len(got) == 130 and all(label[g[3]] == label[g[0]] for g in got if g[1])


def test_queries_go_on_in_parts_with_the_cells_that_they_meet(spark, sf_dir, monkeypatch):
    run = lambda: sorted(map(tuple, catalog.QUERIES["vector_topk"](spark, sf_dir).collect()))
    whole = run()
    monkeypatch.setattr(nearest, "SENT", 2)
    assert run() == whole
