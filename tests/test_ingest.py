"""Files to tables: readers, rejection, duplicates, idempotence, batch and stream alike."""

import io
import json
import zipfile

from pyspark.sql import functions as F

from folioworks.operators import audit, index, tables
from folioworks.plans.ingest import ingest, next_tables
from folioworks.schemas import TABLES
from folioworks.sources import readers
from folioworks.streaming import inbox

LINES = ["المادة 1", "يفتح السوق أبوابه كل صباح ما لم يعلن المجلس عطلة عامة.", "المادة 2", "ترفع الحواجز عن الطريق إذا انتهت أعمال الصيانة قبل موعدها."]
SIDECAR = {"source_type": "legislation", "verification_status": "source_verified", "branch": "test", "topic": "t", "classification_title": "الأسواق والطرق"}
NOISY = "المـــادة 1\r\nيفتح   السوق أبوابه كل صباح ما لم يعلن المجلس عطلة عامة.\r\n\r\n\r\n\r\nالمادة 2\r\nترفع الحواجز \u200fعن الطريق إذا انتهت أعمال الصيانة قبل موعدها."


def docx(lines):
    body = "".join(f'<w:p><w:pPr><w:pStyle w:val="a0"/></w:pPr><w:r><w:rPr><w:b/></w:rPr><w:t>{x}</w:t></w:r></w:p>' for x in lines)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def put(folder, name, data, sidecar=None):
    (folder / name).write_bytes(data if isinstance(data, bytes) else data.encode())
    if sidecar:
        (folder / f"{name}.json").write_text(json.dumps(sidecar, ensure_ascii=False))


def files(spark, folder):
    return spark.read.format("binaryFile").load(str(folder))


def empty(spark):
    return {t: spark.createDataFrame([], TABLES[t]()) for t in ("sources", "knowledge_objects", "ingestion_batches")}


def run(spark, folder, before=None):
    before = before or empty(spark)
    return ingest(files(spark, folder), before["sources"], before["knowledge_objects"], F.lit("2024-01-01").cast("timestamp"))


def test_readers():
    html = b"<html><head><meta charset=utf-8><style>s{}</style><title>T</title></head><body><h1>A &amp; b</h1><p>c<br>d</p><script>x</script><p>e</p></body></html>"
    assert [x for x, *_ in readers.read_html(html)] == ["A & b", "c", "d", "e"]
    assert readers.read_docx(docx(["a", " ", "b"])) == [("a", "a0", True), ("b", "a0", True)]
    assert [x for x, *_ in readers.read_plain(b"a\r\nb\xff")] == ["a", "b�"]


def test_formats_and_rejects(spark, tmp_path):
    put(tmp_path, "law.docx", docx(LINES), SIDECAR)
    put(tmp_path, "page.html", "<html><head><meta charset='utf-8'></head><body><p>نص</p></body></html>")
    put(tmp_path, "x.rtf", "x")
    put(tmp_path, "empty.txt", " \n ")
    put(tmp_path, "broken.docx", b"no zip")
    made = run(spark, tmp_path)
    objects = {(r.object_type, r.metadata["local_id"]): r for r in made.objects.collect()}
    assert set(objects) == {("legislation", "ART-1"), ("legislation", "ART-2"), ("legal_document", "DOC-1")}
    law = objects["legislation", "ART-1"]
    assert (law.authority_status, law.usable_as_citation, law.branch) == ("source_authority", True, "test")
    reasons = {r.path.rsplit("/", 1)[1]: r.reason for r in made.rejects.collect()}
    assert set(reasons) == {"x.rtf", "empty.txt", "broken.docx"} and "BadZipFile" in reasons["broken.docx"]
    states = sorted(r.status for r in made.batches.collect())
    assert states == ["completed"] * 2 + ["failed"] * 3
    assert audit.constraint_violations(made.objects, audit.OBJECT_RULES, "id").count() == 0


def test_duplicates_across_formats(spark, tmp_path):
    put(tmp_path, "law-a.md", NOISY, SIDECAR)
    put(tmp_path, "law-b.docx", docx(LINES), SIDECAR)
    made = run(spark, tmp_path)
    batches = {r.status: r for r in made.batches.collect()}
    assert set(batches) == {"completed", "duplicate"} and batches["duplicate"].report["duplicate_of"] == batches["completed"].batch_id
    assert made.objects.count() == 2 and made.sources.count() == 1
    tables_1 = {k: spark.createDataFrame(v.collect(), v.schema) for k, v in next_tables(empty(spark), made).items()}
    again = run(spark, tmp_path, tables_1)
    assert {r.status for r in again.batches.collect()} == {"duplicate"} and again.objects.count() == 0
    put(tmp_path, "other.md", NOISY, SIDECAR | {"topic": None})
    assert sorted(r.status for r in run(spark, tmp_path, tables_1).batches.collect()) == ["completed", "duplicate", "duplicate"]


def test_stream_equals_batch(spark, tmp_path):
    folder, root = tmp_path / "in", tmp_path / "tables"
    folder.mkdir()
    put(folder, "a.md", "\n".join(LINES), SIDECAR)
    put(folder, "b.txt", "مستند آخر")
    put(folder, "c.rtf", "x")
    stream = lambda: inbox.watch_inbox(spark, str(folder), str(root), str(tmp_path / "log")).awaitTermination()
    stream()
    first = inbox.current_tables(spark, str(root), 0)
    made = run(spark, folder)
    ids = lambda t: sorted(r.id for r in t.select("id").collect())
    assert ids(first["knowledge_objects"]) == ids(made.objects)
    put(folder, "d.md", "\n".join(LINES), SIDECAR)
    stream()
    second = inbox.current_tables(spark, str(root), 1)
    assert ids(second["knowledge_objects"]) == ids(made.objects)
    states = sorted(r.status for r in second["ingestion_batches"].collect())
    assert states == ["completed", "completed", "duplicate", "failed"]
    inbox.compact(spark, str(root), 0)
    again = inbox.current_tables(spark, str(root), 1)
    assert sorted(r.status for r in again["ingestion_batches"].collect()) == states and ids(again["knowledge_objects"]) == ids(made.objects)


def test_changes_fold_like_upserts(spark):
    now = spark.createDataFrame([("a", "S1", "t1", "f1"), ("b", "S1", "t2", "f2")], "source_key string, source_type string, title string, file_name string")
    change = spark.createDataFrame([("b", "S2", "new", None), ("c", "S2", "t3", "f3")], now.schema)
    both = now.withColumn("v", F.lit(0)).union(change.withColumn("v", F.lit(1)))
    key = lambda f: sorted(f.collect(), key=lambda r: r.source_key)
    assert key(inbox.folded(both, "sources")) == key(tables.upsert(now, change, ["source_key"], ["title", "file_name"]))


def test_upsert_twice_is_once(spark):
    now = spark.createDataFrame([(1, "a", "x"), (2, "b", None)], "id int, v string, w string")
    change = spark.createDataFrame([(2, "B", "W"), (3, "c", "z")], "id int, v string, w string")
    once = tables.upsert(now, change, ["id"], ["v"])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, tables.upsert(once, change, ["id"], ["v"]).collect())) == [(1, "a", "x"), (2, "B", None), (3, "c", "z")]


def test_table_swap(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.replace(spark.range(3), path)
    tables.replace(spark.read.parquet(path).where("id > 0"), path)
    assert spark.read.parquet(path).count() == 2 and [p.name for p in tmp_path.iterdir()] == ["t"]


def test_index_round_trip(spark):
    rows = [(f"O{i}", f"t{i}", "query: no" if i == 3 else f"text {i}") for i in range(5)]
    objects = spark.createDataFrame(rows, "id string, title string, original_text string")

    def encoder():
        return lambda texts: [[float(len(x)), 1.0] for x in texts]

    points, rejected = index.embed(objects, encoder, "m", "1", batch=2)
    assert [r.id for r in rejected.collect()] == ["O3"]
    held = spark.createDataFrame(points.collect(), points.schema)
    assert sorted(r.title for r in held.collect()) == ["t0", "t1", "t2", "t4"] and {len(r.vector) for r in held.collect()} == {2}
    assert [tuple(r) for r in index.reconcile(objects, held).collect()] == [("O3", "missing")]
    lost = index.delete_points(held, spark.createDataFrame([("O1",)], "object_id string"))
    assert sorted(r.id for r in index.missing_objects(objects, lost).collect()) == ["O1", "O3"]
    assert index.write_points(lost, held).count() == 4
