"""A document is joined and normalised once, whatever is derived from it, and plain files need no Python."""

import random

from pyspark.sql import functions as F

from folioworks.functions.text import BLANK, INVISIBLE, TATWEEL, nfkc, normalize_text
from folioworks.sources import readers, writers


def test_a_document_is_joined_once(spark):
    block = F.struct(F.col("id").cast("string").alias("text"), F.lit("").alias("style"), F.lit(False).alias("bold"))
    made = readers.canonical(spark.range(3).select(F.array(block, block).alias("blocks")), F.lit("raw"))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_join(") == 1
    assert [r.body for r in made.orderBy("body").collect()] == ["0\n0", "1\n1", "2\n2"]
    assert made.columns == ["blocks", "body", "content_sha256", "source_sha256", "normalizer_version", "warnings"]


def test_guarded_patterns_change_what_the_plain_ones_do(spark):
    r = random.Random(3)
    texts = ["".join(r.choices(["a", "é", "é", " ", "  ", "\t", "\r", "\n", "\x1c", "\x85", " ", "​", " ", "　", "ـ", "ﬁ"], k=r.randint(0, 12))) for _ in range(3000)] + [None, ""]
    t = F.regexp_replace(nfkc(F.col("text")), f"{INVISIBLE}|{TATWEEL}", "")
    for pattern, by in ((r"\r\n?", "\n"), (" [ \t]+|\t[ \t]*", " "), (" +\n *|\n +", "\n"), ("\n{3,}", "\n\n"), (rf"(?U)\A{BLANK}+|{BLANK}+\z", "")):
        t = F.regexp_replace(t, pattern, by)
    frame = spark.createDataFrame([(x,) for x in texts], "text string").repartition(4)
    assert frame.select(t.alias("a"), normalize_text(F.col("text")).alias("b")).where("not a <=> b").collect() == []


def test_plain_files_keep_their_bytes_without_python(spark):
    docs = spark.createDataFrame([("a.txt", "é\n<b>"), ("b.rtf", "x"), ("c.md", None), ("d.html", "x\n<y>")], "path string, text string")
    rows = {r.path: bytes(r.content) for r in writers.file_rows(docs, F.col("path"), F.col("text"), F.lit("2024-01-01")).collect()}
    assert rows == {"a.txt": "é\n<b>".encode(), "b.rtf": b"x", "c.md": b"", "d.html": b"<html><body><p>x</p><p>&lt;y&gt;</p></body></html>"}
    plan = writers.file_rows(docs, F.col("path"), F.col("text"), F.lit("2024-01-01"))._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE WHEN" in plan  # only texts of written kinds reach the UDF
