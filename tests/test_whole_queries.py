"""Queries over whole tables, where a part of the table would give other rows."""

from folioworks import catalog
from folioworks.operators import matching


def run(name, spark, at):
    return [tuple(r) for r in catalog.QUERIES[name](spark, str(at)).collect()]


def test_words_behind_any_prefix_count(spark, tmp_path):
    long = "filler " * 60
    spark.createDataFrame([(40, "needle"), (80, long + "(needle) thread."), (81, "needle thread")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "x " * 40 + "needle thread")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(0, [1.0, 0.0]), (40, [0.0, 1.0]), (900, [1.0, 0.1])], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert run("exact_search", spark, tmp_path) == [(0, 80, 2, 1, 1.0)]
    assert sorted(run("hybrid_merge", spark, tmp_path), key=lambda r: r[3]) == [(0, 80, 0, 1), (0, 0, 1, 2), (0, 900, 1, 3), (0, 40, 1, 4)]


def test_windows_reach_the_end_of_a_text(spark, tmp_path):
    text = "".join(f"{n:09d} " for n in range(2000))
    spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    bodies = [b for _, _, b in sorted(run("text_windows", spark, tmp_path))]
    assert len(bodies) == 25 and "".join(b[:800] for b in bodies) == text


def test_every_customer_hundredth_and_query_is_asked(spark, sf_dir):
    known = lambda table, of: {r[0] for r in spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(of).distinct().collect()}
    brands = known("part", "p_brand")
    asked = {r[0] for r in run("entry_strategy", spark, sf_dir)}
    assert asked == {c for c in known("customer", "c_custkey") if f"Brand#{c % 5 + 1}" in brands}
    assert {r[0] for r in run("vector_topk", spark, sf_dir)} == {v for v in known("embeddings", "vec_id") if v % 100 == 0}
    assert {r[0] for r in run("controlled_expansion", spark, sf_dir)} <= set(range(20))


def test_lookups_read_every_document(spark, tmp_path):
    rows = [(i, "en", f"own {i}", "s") for i in range(1, 8)] + [(900, "en", "late first", "s"), (901, "en", "late first", "s"), (902, "de", "late first", "s")]
    spark.createDataFrame(rows, "doc_id long, lang string, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1,), (900,), (900,)], "doc_id long").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(900,), (900,)], "conv_id long").write.parquet(f"{tmp_path}/conversations.parquet")
    assert run("known_duplicates", spark, tmp_path) == [(901, 900, 2)]
    assert sorted(run("null_safe_lookup", spark, tmp_path)) == [(1, 5), (2, 4), (3, 5), (4, 4), (5, 5), (6, 4), (7, 5), (900, 4), (901, 5), (902, 1)]


def test_micro_issues_are_dealt_over_as_many_tasks_as_rows_need(spark, sf_dir, monkeypatch):
    whole = sorted(map(tuple, catalog.QUERIES["micro_issues"](spark, sf_dir).collect()))
    monkeypatch.setattr(matching, "BRIDGE_ROWS", 500)
    dealt = catalog.QUERIES["micro_issues"](spark, sf_dir)
    assert dealt.rdd.getNumPartitions() == -(-spark.read.parquet(f"{sf_dir}/lineitem.parquet").count() // 500)
    assert sorted(map(tuple, dealt.collect())) == whole
