import random
import zlib

import pytest
from pyspark.sql import functions as F

from folioworks.llm import toxicity

CLEAN = "the quiet river runs past a small stone house where people read books and bake bread every morning".split()


def corpus(n=900, seed=7):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(CLEAN) for _ in range(rng.randint(20, 80))]
        toxic = int(rng.random() < 0.2)
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["you", "idiot", "moron", "blorgo" + rng.choice("abc"), "worthless"]))
        rows.append((i, " ".join(words)))
        labels.append((i, toxic))
    return rows, labels


@pytest.fixture(scope="module")
def scored(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame([*rows, (5000, None), (5001, ""), (5002, rows[0][1]), (None, "x"), (0, rows[0][1])], "doc_id long, text string").withColumns({"score": F.lit("clash"), "features": F.lit(1), "toxic": F.lit(1)})
    told = spark.createDataFrame([*labels, (None, 1), (3, None), (9999, 1)], "doc_id long, toxic int")
    return rows, dict(labels), toxicity.toxicity(docs, told).collect()


def test_contract(scored):
    rows, labels, got = scored
    assert len(got) == len(rows) + 5
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add(r.score)
    assert by[0] == by[5002] and len(by[0]) == 1 and by[5000] == by[5001]


def test_held_out_accuracy(scored):
    _, labels, got = scored
    held = [(r.predicted, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    assert sum(p == y for p, y in held) / len(held) >= 0.95


def test_one_label_and_no_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in toxicity.toxicity(docs, empty).collect()] == [0.0, 0.0]
    ones = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert [r.score for r in toxicity.toxicity(docs, ones).collect()] == [1.0, 1.0]
    assert toxicity.toxicity(docs.limit(0), ones).count() == 0


def test_features_see_what_is_hidden():
    at = toxicity.NAMES.index
    plain, hidden = (toxicity.features(t, {}, {}) for t in ("you are an idiot", "you are an 1d10t id1ot i.d.i.o.t"))
    assert plain[at("insult_count")] > 0 and plain[at("near_second")] == 1
    assert hidden[at("insult_count")] == 0 and hidden[at("hidden_insults")] >= 1
    assert toxicity.features("", {}, {})[at("log_words")] == 0
    assert toxicity.features("AB cd!?", {}, {})[at("capitals")] == 0.5
    assert toxicity.features("blorgoA blorgob", {"blorgo-": 0.9}, {})[at("strong_rate")] == 1
