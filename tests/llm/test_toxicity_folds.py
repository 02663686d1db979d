"""Folds, bounded samples and long texts."""

from pyspark.sql import functions as F

from folioworks.llm import toxicity
from test_toxicity import corpus


def test_lexicons_leave_their_fold_out(spark):
    rows = [("you zorgle now", 1, i % 3) for i in range(12)] + [("clean words here", 0, i % 3) for i in range(60)] + [("you blimp now", 1, 1) for _ in range(6)]
    lexicons = toxicity.learn_lexicons(spark.createDataFrame(rows, "text string, toxic int, fold int"), 3)
    assert len(lexicons) == 4 and all("zorgle" in x for x in lexicons)
    assert "blimp" in lexicons[3] and "blimp" in lexicons[0] and "blimp" not in lexicons[1]
    assert not any("words" in x for x in lexicons)


def test_many_texts_of_one_labelled_id_stay_one_row(spark, monkeypatch):
    rows, labels = corpus(300)
    docs = spark.createDataFrame(rows + [(0, f"text number {i}") for i in range(500)], "doc_id long, text string")
    seen = []
    whole = toxicity.learn_lexicons
    monkeypatch.setattr(toxicity, "learn_lexicons", lambda r: seen.append(r.count()) or whole(r))
    toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert seen == [300]


def test_equal_raw_scores_are_one_point(spark, monkeypatch):
    points = []

    class Spy(toxicity.IsotonicRegression):
        def fit(self, rows):
            points.append((rows.count(), rows.select("_raw").distinct().count(), rows.agg(F.sum("_weight")).first()[0]))
            return super().fit(rows)

    monkeypatch.setattr(toxicity, "IsotonicRegression", Spy)
    rows, labels = corpus(300)
    toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert points[0][0] == points[0][1] < 300 and points[0][2] == 300


def test_very_long_text(spark):
    rows, labels = corpus(300)
    long = "the quiet river runs past a house " * 60_000
    docs = spark.createDataFrame([*rows, (9000, long), (9001, long + " you idiot moron worthless blorgoa")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).where("doc_id >= 9000").collect()}
    assert set(got) == {9000, 9001} and 0 <= got[9000] <= got[9001] <= 1
