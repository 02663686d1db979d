from pyspark.sql import functions as F

from folioworks.operators import classify, segment
from folioworks.operators.reports import coverage_gate

STATUTE = "مقدمة\nالمادة 1\nتثبت الحضانة للأم.\n\nالمادة ٢ مكرر\nيسقط حق الحاضنة.\nمادة 1\nنص ثالث"


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_articles(spark):
    got = [tuple(r) for r in segment.split_articles(docs(spark, STATUTE, "none", None)).orderBy("pos").select("doc_id", "local_id", "article_number", "body").collect()]
    assert got == [(0, "ART-1", "1", "تثبت الحضانة للأم."), (0, "ART-2-مكرر", "٢ مكرر", "يسقط حق الحاضنة."), (0, "ART-1-OCC-2", "1", "نص ثالث")]
    assert [r.doc_id for r in segment.without_articles(docs(spark, STATUTE, "none", None)).orderBy("doc_id").collect()] == [1, 2]


def test_principles(spark):
    got = segment.split_principles(docs(spark, "قبل\n1- أول\nتتمة\n٣- ثالث", "بلا رقم", "", None)).orderBy("doc_id", "pos").collect()
    assert [(r.doc_id, r.principle_number, r.body) for r in got] == [(0, 1, "1- أول\nتتمة"), (0, 3, "٣- ثالث"), (1, 1, "بلا رقم"), (2, 1, "")]


def test_heading_stack(spark):
    rows = [(0, "فرع", 1, False), (1, "باب", 2, False), (2, "1- مبدأ", None, True), (3, "تتمة", None, False), (4, "فصل", 3, False), (5, "ضائع", None, False), (6, "2- آخر", None, True), (7, "فرع ب", 1, False), (8, "3- ثالث", None, True)]
    frame = spark.createDataFrame([(1, *r) for r in rows], "doc_id int, pos int, text string, level int, is_item boolean")
    got = segment.heading_stack(frame).orderBy("pos").collect()
    assert [tuple(r)[1:] for r in got] == [(2, "فرع", "باب", None, "1- مبدأ\nتتمة"), (6, "فرع", "باب", "فصل", "2- آخر"), (8, "فرع ب", None, None, "3- ثالث")]


def test_parts_and_windows(spark):
    text = "\n".join(["aaaa"] * 10)
    got = segment.pack_parts(docs(spark, text, "", None), 9, 0).orderBy("doc_id", "part").collect()
    assert [r.body for r in got] == ["aaaa\naaaa"] * 5 + [""]
    assert "\n".join(r.body for r in got if r.doc_id == 0) == text
    windows = segment.text_windows(docs(spark, "x" * 25, "", None), 10, 8, 2).orderBy("window").collect()
    assert [(r.window, len(r.body)) for r in windows] == [(0, 10), (1, 10)]


def test_sections_by_source_type(spark):
    rows = [(0, STATUTE, None, "t0"), (1, "نص", "legislation", "t1"), (2, "1- أ", "principles", "t2"), (3, "حكم", "full_judgment", "t3"), (4, "شيء", None, "t4")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source_type string, title string").withColumn("object_type", F.lit(None).cast("string"))
    got = {(r.doc_id, r.local_id): r.object_type for r in classify.sections(frame).collect()}
    assert got == {(0, "ART-1"): "legislation", (0, "ART-2-مكرر"): "legislation", (0, "ART-1-OCC-2"): "legislation", (1, "DOC-1"): "legislation", (2, "PR-1"): "judicial_principle", (3, "JUD-1"): "full_judgment", (4, "DOC-1"): "legal_document"}


def test_authority_matrix(spark):
    rows = [("synthesized_rule", "source_verified"), ("legislation", "machine_pending_human"), ("legislation", "source_verified"), ("x", "operationally_accepted"), ("x", None)]
    frame = spark.createDataFrame(rows, "k string, s string").select(classify.authority_status(F.col("k"), F.col("s")).alias("a"), classify.citable(F.col("k"), F.col("s")).alias("c"))
    assert [tuple(r) for r in frame.collect()] == [("non_authoritative", False), ("non_authoritative", False), ("source_authority", True), ("human_verified_authority", True), ("non_authoritative", False)]


def test_drafting_gate(spark):
    cases = {0: (0, 0, 0), 1: (5, 0, 3), 2: (0, 4, 2), 3: (3, 2, 0), 4: (3, 2, 1)}
    objects = spark.createDataFrame([(c, k) for c, n in cases.items() for k, m in zip("lpt", n) for _ in range(m)], "c int, k string")
    kinds = {n: F.col("k") == n[0] for n in ("legislation", "principles", "templates")}
    got = {r.c: r.gate for r in coverage_gate(spark.createDataFrame([(c,) for c in cases], "c int"), objects, ["c"], kinds).collect()}
    assert got == {c: "ready_for_grounded_draft" if c == 4 else "blocked_missing_authorities" for c in cases}
