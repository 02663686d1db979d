import json

from pyspark.sql import functions as F

from folioworks.operators import matching, reports
from folioworks.sources import exports, readers
from folioworks.streaming.inbox import batch_states


def test_reference_keys_and_entries(spark, tmp_path):
    (tmp_path / "refs.json").write_text(json.dumps([{"k": "a b", "r": "R1"}, {"k": "c", "r": "R2"}], indent=1))
    assert [tuple(r) for r in exports.reference_keys(spark, str(tmp_path / "refs.json")).collect()] == [("a b", "R1"), ("c", "R2")]
    entries = {"entries": [{"body": "text", "branch": "x"}, {"body": " "}, {"kind": "k", "body": "b"}]}
    (tmp_path / "all.json").write_text(json.dumps(entries))
    got = sorted((r.kind, r.branch, r.body) for r in exports.import_json(spark, str(tmp_path / "all.json")).collect())
    assert got == [("k", "عام", "b"), ("مبدأ", "x", "text")]
    exports.export_json(exports.import_json(spark, str(tmp_path / "all.json")), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_relation_map(spark):
    rows = spark.createDataFrame([("B", "s", [("p1", "cites", ["l1", "l2"]), ("p2", "applies", ["l1"])], [(["p1", "p2"], "reassess", "new law")])], exports.RELATION_MAP)
    assert exports.relation_edges(rows).count() == 3
    assert [r.flag for r in matching.reassessment_flags(spark.createDataFrame([("p1",), ("p3",)], "id string"), exports.relation_flags(rows)).orderBy("id").collect()] == ["reassess", None]


def test_markdown(spark):
    row = spark.createDataFrame([("f.txt", "txt", "ab", 1, ["w1", "w2"], "body"), ("g.txt", "txt", "cd", 1, [], "x")], "source_name string, source_format string, source_sha256 string, normalizer_version int, warnings array<string>, body string")
    head = "---\nsource_name: {}\nsource_format: txt\nsource_sha256: {}\nnormalizer_version: 1\nwarnings:{}\n---\n\n{}"
    assert [r.m for r in row.select(readers.to_markdown(row).alias("m")).collect()] == [head.format("f.txt", "ab", "\n  - w1\n  - w2", "body"), head.format("g.txt", "cd", " []", "x")]


def test_dedup_does_not_depend_on_order(spark):
    rows = [(i, "abcab"[i % 5], None if i % 2 else "t") for i in range(40)]
    frame = spark.createDataFrame(rows, "id int, digest string, topic string")
    key = lambda f: sorted((r.id, r.first_key, r.is_duplicate) for r in matching.find_duplicates(f, "digest", ["topic"], [], "id").collect())
    assert key(frame) == key(frame.orderBy(F.desc("id")).repartition(5))
    assert sum(not d for *_, d in key(frame)) == len({(d, t) for _, d, t in rows})


def test_terminal_states_stick(spark):
    events = [("a", "started", 1), ("a", "completed", 2), ("a", "failed", 3), ("b", "started", 1), ("c", "duplicate", 1), ("c", "started", 2)]
    got = {r.batch_id: r.status for r in batch_states(spark.createDataFrame(events, "batch_id string, status string, at int")).collect()}
    assert got == {"a": "completed", "b": "started", "c": "duplicate"}


def test_gaps_and_retention(spark):
    numbers = spark.createDataFrame([("g", n) for n in (1, 2, 2, 5, 9)], "g string, n int")
    r = reports.sequence_report(numbers, "g", "n").first()
    assert (r.least, r.greatest, r.n_distinct, r.n_repeated, r.n_missing, r.gaps) == (1, 9, 4, 1, 5, "3-4,6-8")
    files = spark.createDataFrame([("f", False, 1, 10), ("f", False, 2, 20), ("f", True, 3, 30), ("g", True, 1, 5)], "name string, dup boolean, stamp int, size int")
    ranked, freed = reports.retention(files, "name", "dup", "stamp", "size")
    assert {(x.name, x.stamp) for x in ranked.where("keep").collect()} == {("f", 2), ("g", 1)}
    assert {x.name: (x.freed, x.files) for x in freed.collect()} == {"f": (40, 2), "g": (0, 0)}
