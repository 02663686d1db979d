"""The bands of long templates: rows by one permutation, collisions as often as stated."""

import random

from pyspark.sql import functions as F

from test_licences import brute

from folioworks.llm import licences


def rows_of(hashes):
    return [min((h for h in hashes if h % licences.ROWS == b), default=None) for b in range(licences.ROWS)]


def collide(a, b):
    """Whether two windows share a band that isn't empty."""
    x, y = rows_of(a), rows_of(b)
    return any(x[i : i + 2] == y[i : i + 2] != [None, None] for i in range(0, licences.ROWS, 2))


def test_bands_of_a_text_are_those_of_its_windows(spark):
    r = random.Random(1)
    hashes = [r.randrange(-(1 << 63), 1 << 63) for _ in range(77)]
    frame = spark.createDataFrame([(hashes,), (hashes[:20],)], "h array<long>")
    got, short = (x[0] for x in frame.select(licences.text_bands(F.col("h"))).collect())
    assert short == [] and len(got) == 10 * licences.BANDS
    windows = [(at, rows_of(hashes[at : at + licences.WINDOW])) for at in range(0, 77, licences.STRIDE)]
    pairs = [(w, b, rows[2 * b], rows[2 * b + 1]) for w, (_, rows) in enumerate(windows) for b in range(licences.BANDS)]
    own = spark.createDataFrame(pairs, "w int, b int, x long, y long").select("w", "b", F.when(F.expr("x is not null or y is not null"), F.xxhash64("b", "x", "y"))).collect()
    assert [v for *_, v in sorted(map(tuple, own))] == got


def test_collisions_are_as_likely_as_stated():
    r = random.Random(2)
    for shared, least in ((16, 1.0), (14, 0.9), (12, 0.75)):
        hits = 0
        for _ in range(400):
            common = [r.getrandbits(63) for _ in range(shared)]
            a, b = (common + [r.getrandbits(63) for _ in range(licences.WINDOW - shared)] for _ in range(2))
            hits += collide(a, b)
        assert hits / 400 >= least
        j = shared / (2 * licences.WINDOW - shared)
        assert hits / 400 >= 1 - (1 - j * j) ** licences.BANDS - 0.08


def test_long_templates_come_through_bands_alone(spark, monkeypatch):
    long = [n for n, t in licences.TEMPLATES.items() if len(t.split()) > licences.LONG + licences.SHINGLE]
    r = random.Random(3)
    words = "stone river bread morning house water".split()
    docs = []
    for name in long:
        text = licences.TEMPLATES[name].split()
        for n in range(6):
            edited = [w if i % 31 != 7 + n else "changed" for i, w in enumerate(text)]
            docs.append((name, " ".join(r.choices(words, k=n + 3) + edited + r.choices(words, k=9))))
    frame = spark.createDataFrame(list(enumerate(t for _, t in docs)), "doc_id long, text string")
    got = {x.doc_id: x.licences for x in licences.licence_report(frame).collect()}
    held = [i for i, (name, text) in enumerate(docs) if name in brute(text).split(",")]
    assert len(long) >= 5 and len(held) >= 20 and all(docs[i][0] in got[i].split(",") for i in held)
    monkeypatch.setattr(licences, "text_bands", lambda hashes: F.array().cast("array<long>"))
    lost = {x.doc_id: x.licences for x in licences.licence_report(frame).collect()}
    assert not any(name in lost[i].split(",") for i, (name, _) in enumerate(docs))
