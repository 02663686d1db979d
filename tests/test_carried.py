"""Orders of any length: cells, numbers, what is carried over borders; chunks of reports."""

import random

from pyspark.sql import functions as F

from folioworks.operators import numbering, reports, retrieval


def test_numbers_over_dense_sparse_negative_and_null_keys(spark):
    r = random.Random(1)
    keys = [None, -5, -5, 0, 1, 2, 3, (1 << 63) - 1, -(1 << 63), *(r.randrange(-(1 << 63), 1 << 63) for _ in range(300))]
    rows = spark.createDataFrame([(g, k) for g in ("a", None) for k in keys], "g string, k long")
    got = numbering.row_numbers(rows, ["g"], "k", "n", width=7).collect()
    for g in ("a", None):
        mine = sorted(((x.n, x.k) for x in got if x.g == g), key=lambda x: x[0])
        assert [n for n, _ in mine] == list(range(1, len(keys) + 1))
        assert [k for _, k in mine] == sorted(keys, key=lambda k: (k is not None, k or 0))


def test_sparse_keys_make_few_cells(spark):
    rows = spark.range(20_000).select(F.xxhash64("id").alias("k"))
    cells = numbering.with_cells(rows, "k", width=1000).groupBy("_cell").count().collect()
    assert 15 <= len(cells) <= 21 and max(c["count"] for c in cells) < 1300


def plain_distances(hits, reach):
    at = [i for i, h in enumerate(hits) if h]
    return {i: d for i in range(len(hits)) if at and (d := min(abs(i - a) for a in at)) <= reach}


def test_matches_are_carried_over_any_number_of_cells(spark):
    r = random.Random(2)
    groups = {"none": [False] * 50, "all": [True] * 50, "ends": [True, *[False] * 60, True], "some": [r.random() < 0.1 for _ in range(200)], None: [False, True, None]}
    rows = spark.createDataFrame([(g, i * 3, h) for g, hits in groups.items() for i, h in enumerate(hits)], "g string, at int, hit boolean")
    for reach in (3, 25):
        got = reports.neighbourhood(rows, "g", "at", F.col("hit"), reach, width=4).collect()
        for g, hits in groups.items():
            assert {x["at"] // 3: x.distance for x in got if x.g == g} == plain_distances(hits, reach)


def test_one_group_of_a_million_rows_is_spread(spark):
    rows = spark.range(1_000_000).select(F.lit("hot").alias("g"), F.col("id").alias("at"), (F.col("id") % 1000 == 0).alias("hit"))
    near = reports.neighbourhood(rows, "g", "at", F.col("hit"), 3)
    assert near.count() == 1000 * 7 - 3
    celled = numbering.with_cells(rows, "at").groupBy("g", "_cell").count().collect()
    assert len(celled) == 16 and max(c["count"] for c in celled) <= numbering.WIDTH


def test_reports_come_in_chunks(spark):
    rows = spark.createDataFrame([("a", i) for i in range(25)] + [("b", 7), (None, 1), ("a", None)], "g string, k long")
    got = {(x.g, x.chunk): (x.ids, x.n) for x in reports.id_list(rows, "g", "k", chunk=10).collect()}
    assert got[("a", 2)] == ("20,21,22,23,24", 5) and got[("b", 0)] == ("7", 1) and got[(None, 0)] == ("1", 1) and len(got) == 5
    gaps = reports.sequence_report(rows.where("k is null or k % 2 = 0 or g = 'b'"), "g", "k", chunk=5)
    found = {(x.g, x.chunk): x for x in gaps.collect()}
    assert found[("a", 0)].gaps == "1-1,3-3,5-5,7-7,9-9" and found[("a", 2)].gaps == "21-21,23-23" and found[("a", 1)].n_missing == 12
    assert found[("b", 0)].gaps == "" and found[("b", 0)].n_distinct == 1
    judged = spark.createDataFrame([(1, i, ["x"] if i % 3 else [], i % 3 == 0) for i in range(10)], "query_id int, id int, reasons array<string>, eligible boolean")
    trace = {x.chunk: (x.used, [e.id for e in x.excluded]) for x in retrieval.reasoning_trace(judged, size=3).collect()}
    assert trace == {0: ([0, 3, 6], [1, 2, 4]), 1: ([9], [5, 7, 8])}
