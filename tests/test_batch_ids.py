"""Batches of one run are told apart also where their paths' hashes begin alike."""

from pyspark.sql import functions as F

from folioworks import catalog
from folioworks.functions import text as t


def test_paths_with_hashes_that_begin_alike_are_two_batches(spark, tmp_path):
    rows = [(34968, "one text"), (36425, "another text"), (1, "one text"), (2, ""), (3, None)]  # inbox/34968.txt and inbox/36425.txt share eight digits
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r)[1:] for r in catalog.QUERIES["stream_inbox"](spark, str(tmp_path)).collect())
    assert got == [(0, 0, 0, 0, 2), (1, 0, 1, 12, 0), (1, 1, 1, 8, 0)]


def test_long_ids_are_read_back(spark):
    name = F.concat(t.batch_id(F.expr("timestamp '2024-01-02 03:04:05'"), F.lit("a"), 32), F.lit("-DUPLICATE_law.md"))
    stamp, duplicate, original = spark.range(1).select(*t.parse_batch_name(name).values()).first()
    assert (str(stamp), duplicate, original) == ("2024-01-02 03:04:05", True, "law.md")
