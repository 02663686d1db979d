"""Files out and in again: every format, exports in bounded files, a rebuilt index."""

import os
import zipfile
from datetime import datetime

from pyspark.sql import functions as F

from folioworks.operators import index
from folioworks.sources import readers, writers

TEXTS = ["one\ntwo & <b>three</b>", "“quoted” é\n\n  spaced  ", "", "line\n---\nwarnings: x"]


def test_formats_read_what_was_written(spark):
    for text in TEXTS:
        lines = [x.strip() for x in text.split("\n") if x.strip()]
        assert [t for t, *_ in readers.read_html(writers.write_html(text))] == lines
        assert [t for t, *_ in readers.read_docx(writers.write_docx(text))] == lines
        assert [t for t, *_ in readers.read_plain(writers.write_plain(text))] == text.split("\n")
        assert writers.write_docx(text) == writers.write_docx(text)


def test_file_rows_have_binary_files_columns(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a.docx", "x\ny", "t"), (2, "b.html", None, None), (3, "c", "plain", "u")], "id long, path string, text string, title string")
    side = F.when(F.col("title").isNotNull(), F.struct("title"))
    rows = {r.path: r for r in writers.file_rows(docs, F.col("path"), F.col("text"), F.lit(datetime(2024, 1, 1)), side).collect()}
    assert set(rows) == {"a.docx", "a.docx.json", "b.html", "c", "c.json"} and bytes(rows["b.html"].content) == b""
    assert bytes(rows["c.json"].content) == b'{"title":"u"}' and rows["c"].length == 5
    (tmp_path / "a.docx").write_bytes(bytes(rows["a.docx"].content))
    assert zipfile.ZipFile(tmp_path / "a.docx").testzip() is None
    binary = spark.read.format("binaryFile").load(str(tmp_path))
    assert {f.name: f.dataType for f in binary.schema} == {f.name: f.dataType for f in writers.file_rows(docs, F.col("path"), F.col("text"), F.lit(datetime(2024, 1, 1))).schema}


def test_markdown_in_bounded_files_and_back(spark, tmp_path):
    bodies = [(i, "x" * 500 + f"\n{i}\x1eend" if i % 2 else "---\nbody: 1\n---", "archive" if i % 3 else "failed") for i in range(60)]
    docs = spark.createDataFrame(bodies, "id long, body string, outcome string").select("*", F.col("id").cast("string").alias("source_name"), F.lit("txt").alias("source_format"), F.lit("ab").alias("source_sha256"), F.lit(1).alias("normalizer_version"), F.when(F.col("id") % 5 == 0, F.array(F.lit("w: 1"), F.lit("w2"))).otherwise(F.array().cast("array<string>")).alias("warnings"))
    at = str(tmp_path / "out")
    writers.write_markdown(docs, at, file_bytes=4000)
    files = [os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(at) for f in names if f.startswith("part-")]
    assert len(files) > 6 and max(files) < 12_000
    got = {int(r.source_name): r for r in writers.read_markdown(spark, at).collect()}
    assert len(got) == 60
    for i, body, outcome in bodies:
        assert (got[i].body, got[i].outcome, got[i].source_sha256, got[i].normalizer_version) == (body.replace("\x1e", " "), outcome, "ab", 1)
        assert got[i].warnings == (["w: 1", "w2"] if i % 5 == 0 else [])


def test_entries_in_bounded_files_and_back(spark, tmp_path):
    rows = [(f"k{i}", None if i % 4 == 0 else f'b "{i}"\n', i) for i in range(50)]
    at = str(tmp_path / "json")
    writers.write_entries(spark.createDataFrame(rows, "kind string, body string, createdAt long"), at, file_bytes=500)
    assert len([f for f in os.listdir(at) if f.startswith("part-")]) > 3
    assert sorted((r.kind, r.body, r.createdAt) for r in writers.read_entries(spark, at).collect()) == sorted(rows)


def test_a_rebuild_finds_each_kind_of_broken_point(spark):
    objects = spark.createDataFrame([(str(i), f"text {i}", f"t{i}") for i in range(8)] + [("q", "query: no", "q"), ("n", None, "n")], "id string, original_text string, title string")
    encoder = lambda: lambda texts: [[float(len(x)), 1.0] for x in texts]
    points, rejected, wrong = index.rebuilt(objects, encoder, "m", "1")
    assert sorted(map(tuple, wrong.collect())) == [("n", "missing"), ("q", "missing")] and points.count() == 8 and sorted(r.id for r in rejected.collect()) == ["n", "q"]

    def spoil(p):
        one = p.where("object_id = '4'")
        kept = p.where("object_id <> '1'").withColumn("vector", F.when(F.col("object_id") == "2", F.array(F.lit(None).cast("float"))).otherwise(F.col("vector"))).withColumn("content_hash", F.when(F.col("object_id") == "3", F.lit("x")).otherwise(F.col("content_hash")))
        return kept.unionByName(one).unionByName(one.withColumn("object_id", F.lit("gone"))).unionByName(one.withColumn("object_id", F.lit(None).cast("string")).withColumn("point_id", F.lit(77).cast("long")))

    _, _, wrong = index.rebuilt(objects, encoder, "m", "1", spoil)
    assert sorted(map(tuple, wrong.collect())) == [("1", "missing"), ("2", "vectorless"), ("3", "changed"), ("4", "repeated"), ("77", "payload_less"), ("gone", "stray"), ("n", "missing"), ("q", "missing")]
