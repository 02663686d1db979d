"""Files that no reader can open, and several files of one source."""

import io
import zipfile

from pyspark.sql import functions as F

from folioworks.operators import index
from folioworks.streaming import inbox
from test_ingest import docx, files, put, run


def damaged(data):
    """A DOCX whose deflated stream is broken, directory and all else being sound."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml"))
    broken = bytearray(out.getvalue())
    at = broken.index(b"word/document.xml") + len(b"word/document.xml")
    broken[at : at + 12] = b"\xff" * 12
    return bytes(broken)


def test_a_damaged_file_is_a_failed_batch_of_the_stream(spark, tmp_path):
    folder, root = tmp_path / "in", tmp_path / "tables"
    folder.mkdir()
    put(folder, "good.txt", "a text of its own")
    put(folder, "bad.docx", damaged(docx(["a"] * 50)))
    inbox.watch_inbox(spark, str(folder), str(root), str(tmp_path / "log"), compact_every=1).awaitTermination()
    states = {r.status: r for r in inbox.current_tables(spark, str(root), 0)["ingestion_batches"].collect()}
    assert set(states) == {"completed", "failed"} and "rror" in states["failed"].report["reason"]
    assert inbox.versions(spark, inbox._base_path(str(root), "sources")) == [0]


def test_two_files_of_one_source_always_give_the_same(spark, tmp_path):
    side = {"source_type": "template", "source_key": "S1"}
    for n, name in enumerate(("b.txt", "a.txt", "c.txt")):
        put(tmp_path, name, f"text number {n}", side)
    got = {tuple(r) for _ in range(3) for r in run(spark, tmp_path).sources.select("source_key", "file_name").collect()}
    assert len(got) == 1
    first = files(spark, tmp_path).where("not endswith(path, '.json')").orderBy("modificationTime", "path").first().path
    assert got == {("S1", first.rsplit("/", 1)[1])}


def test_index_rebuild_and_repair(spark):
    objects = spark.createDataFrame([(f"O{i}", f"t{i}", "query: no" if i == 3 else f"text {i}") for i in range(5)], "id string, title string, original_text string")

    def encoder():
        return lambda texts: [[float(len(x))] for x in texts]

    points, rejected, left = index.rebuilt(objects, encoder, "m", "1")
    assert [r.id for r in rejected.collect()] == ["O3"] and [tuple(r) for r in left.collect()] == [("O3", "missing")]
    held = spark.createDataFrame(points.where("object_id <> 'O1'").collect(), points.schema)
    broken = held.unionByName(held.limit(1).withColumn("object_id", F.lit("gone"))).unionByName(held.limit(1).withColumn("object_id", F.lit(None).cast("string")))
    whole, _ = index.repaired(objects, broken, encoder, "m", "1")
    assert sorted(r.object_id for r in whole.collect()) == ["O0", "O1", "O2", "O4"]
