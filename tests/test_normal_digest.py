"""The digest of canonical documents is that of the normal form of the body, once more."""

from pyspark.sql import functions as F

from folioworks.functions import text as t
from folioworks.streaming import inbox

TEXTS = ["plain", "e​́ x", "اـٓ y", " a \t b \r\n\r\n\r\n c", "ﹱ́", "ﬁ Å\n \n\nz", "", None]


def test_normal_digest(spark):
    rows = spark.createDataFrame([(x,) for x in TEXTS], "x string")
    for r in rows.select(t.normal_digest(F.col("x")).alias("got"), t.content_digest(t.normalize_text(F.col("x"))).alias("wanted")).collect():
        assert r.got == r.wanted


def test_packed_files_are_dealt_over_tasks(spark, tmp_path):
    files = spark.range(200).select(F.concat(F.lit("inbox/"), F.col("id").cast("string"), F.lit(".txt")).alias("path"), F.lit("2024-01-01").cast("timestamp").alias("modificationTime"), F.lit(1).cast("long").alias("length"), F.lit(b"x").alias("content"))
    at_once = inbox.pack(files, str(tmp_path / "p"), 200, 3)
    assert at_once == spark.sparkContext.defaultParallelism
    assert 2 * at_once < len(list((tmp_path / "p").glob("*.parquet"))) <= 3 * at_once
