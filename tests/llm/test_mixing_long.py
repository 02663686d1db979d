import pytest

from folioworks.llm import mixing


@pytest.mark.parametrize("seed", range(4))
def test_a_document_of_a_third_leaves_no_gap(spark, seed):
    rows = [(0, "w " * 1500, "a")] + [(i, "w " * (5 + i % 7), "a") for i in range(1, 380)] + [(1000 + i, "w " * 10, "b") for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_report(docs, block_words=64, shards=4, seed=seed, weights=(1, 3)).collect()
    for source in ("a", "b"):
        of = [r for r in got if (r.doc_id >= 1000) == (source == "b")]
        target, taken = of[0].target, sum(r.taken for r in of)
        passes = int(target // of[0].source_size)
        untaken = [r["size"] for r in of if r.taken == passes * r["size"]]
        assert taken <= target + 1e-9 and target - taken < min(untaken)
        assert all(r.taken in (passes * r["size"], (passes + 1) * r["size"]) for r in of)
