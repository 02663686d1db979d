"""Searches that leave out what cannot count, against plain versions that leave out nothing."""

import random

import numpy as np

from folioworks.operators import matching, nearest, retrieval


def test_cells_are_left_out_and_nothing_is_lost(spark):
    r = np.random.default_rng(1)
    centres = r.normal(size=(12, 8)) * 5
    vectors = [(int(i), (centres[i % 12] + r.normal(size=8)).tolist(), int(i % 3)) for i in range(1200)]
    vectors += [(2000, [0.0] * 8, 0), (2001, None, 0), (2002, [float("nan")] * 8, 1), (2003, [1.0, 2.0], 1), (2004, vectors[0][1], None), (2005, vectors[0][1], 0)]
    points = spark.createDataFrame(vectors, "object_id long, vector array<double>, label int")
    asked = [(i, v, label if i % 2 else None) for i, v, label in vectors if i % 20 == 0 or i >= 2000] + [(3000, vectors[7][1], 99)]
    queries = spark.createDataFrame(asked, "query_id long, q array<double>, label int")
    scored: list = []
    got = retrieval.vector_top_k(points, queries, 5, same=("label",), centres=40, scored=scored).collect()
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / (np.sqrt(sum(x * x for x in a)) * np.sqrt(sum(x * x for x in b)))
    whole = lambda v: v is not None and not any(map(np.isnan, v)) and any(v)
    for query, v, label in asked:
        wanted = sorted((-round(cos(v, w), 9), i) for i, w, other in vectors if whole(v) and whole(w) and len(v) == len(w) and (label is None or label == other))[:5]
        mine = sorted((x.rank, x.object_id, x.score) for x in got if x.query_id == query)
        assert [(i, round(s, 9)) for _, i, s in mine] == [(i, -s) for s, i in wanted]
    assert sum(scored) < 0.5 * len(asked) * len(vectors)


def test_a_block_limit_changes_nothing(spark, monkeypatch):
    r = np.random.default_rng(2)
    points = spark.createDataFrame([(i, r.normal(size=4).tolist()) for i in range(300)], "object_id long, vector array<double>")
    queries = points.where("object_id % 50 = 0").toDF("query_id", "q")
    one = sorted(map(tuple, retrieval.vector_top_k(points, queries, 7).collect()))
    monkeypatch.setattr(nearest, "BLOCK", 20)
    assert sorted(map(tuple, retrieval.vector_top_k(points, queries, 7, centres=3).collect())) == one
    assert retrieval.vector_top_k(points.limit(0), queries, 7).collect() == retrieval.vector_top_k(points, queries.limit(0), 7).collect() == []


def test_exact_search_equals_counting_all(spark):
    r = random.Random(3)
    words = [f"w{i}" for i in range(12)]
    pick = lambda n: " ".join(r.choices(words, [2 ** (12 - i) for i in range(12)], k=n))
    objects = [(i, f"No {i % 3}", pick(r.randrange(0, 9))) for i in range(150)]
    queries = [(i, i % 4, sorted(set(pick(r.randrange(0, 6)).split()))) for i in range(40)]
    found = retrieval.exact_search(spark.createDataFrame(objects, "id long, title string, text string"), spark.createDataFrame(queries, "query_id long, number long, tokens array<string>"), 3, fields=("text",))
    wanted = []
    for query, number, tokens in queries:
        tiers = [(len(set(tokens) & set(t.split())), i) for i, title, t in objects if title == f"No {number}"]
        tiers = [(m, i) for m, i in tiers if m or not tokens]
        best = max((m for m, _ in tiers), default=0)
        wanted += [(query, i, m, rank, 1.0) for rank, (m, i) in enumerate(sorted((m, i) for m, i in tiers if m == best)[:3], 1)]
    assert sorted(map(tuple, found.collect())) == sorted(wanted)


def test_frequent_words_bring_no_candidates(spark):
    """Attribution: all keys hold one word that all texts hold, and each one of its own."""
    keys = spark.createDataFrame([(f"common alpha{'x' * (i + 1)}", str(i)) for i in range(30)], "k string, reference string")
    texts = spark.createDataFrame([(i, f"common alpha{'x' * (i % 40 + 1)} other") for i in range(200)], "id long, text string")
    got = {x.id: x for x in matching.attribute_references(texts, keys, "a-zA-Z", accept=1.0, margin=0.05).collect()}
    assert all(got[i].reference == (str(i % 40) if i % 40 < 30 else None) for i in range(200))
    plan = matching.attribute_references(texts, keys, "a-zA-Z", accept=1.0, margin=0.05)
    joined = [x for x in got.values() if x.coverage is not None]
    assert len(joined) == 150 and plan.where("coverage < 0.9").isEmpty()


def test_attribution_equals_covering_all_pairs(spark):
    r = random.Random(4)
    words = ["".join(r.choices("abcdef", k=4)) for _ in range(25)]
    keys = [(" ".join(r.sample(words, r.randrange(1, 7))), str(i % 5)) for i in range(40)] + [("", "9"), (None, "8")]
    texts = [(i, " ".join(r.choices(words, k=r.randrange(0, 14)))) for i in range(120)] + [(500, None), (501, "")]
    got = {x.id: (x.reference, None if x.coverage is None else round(x.coverage, 9), x.outcome) for x in matching.attribute_references(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(keys, "k string, reference string"), "a-zA-Z").collect()}
    sig = lambda t: {"".join(sorted(w)) for w in (t or "").split()}
    for i, text in texts:
        cover = sorted((-len(sig(k) & sig(text)) / len(sig(k)), k, ref) for k, ref in set(keys) if sig(k))
        cover = [c for c in cover if c[0] <= -0.5]
        if not cover or cover[0][0] > -0.55:
            wanted = (None, -cover[0][0] if cover else None, "unmatched")
        elif len(cover) > 1 and cover[1][2] != cover[0][2] and cover[1][0] - cover[0][0] < 0.05:
            wanted = (None, -cover[0][0], "ambiguous")
        else:
            wanted = (cover[0][2], -cover[0][0], "attributed")
        assert got[i] == (wanted[0], None if wanted[1] is None else round(wanted[1], 9), wanted[2]), text


def test_expansion_by_bits_equals_sets(spark):
    r = random.Random(5)
    objects = [(i, r.sample(range(30), r.randrange(0, 5)), i % 11 == 0 if i % 7 else None) for i in range(200)]
    seeds = [(q * 3 - 50, i, objects[i][1]) for q in range(150) for i in r.sample(range(200), 2)]
    negative = [(q * 3 - 50, i) for q in range(150) for i in r.sample(range(200), 5)]
    frames = spark.createDataFrame(objects, "id long, tags array<long>, not_for_use boolean"), spark.createDataFrame(seeds, "query_id long, id long, tags array<long>")
    own = {(q, i) for q, i, _ in seeds}
    near = {(q, i) for q, _, tags in seeds for i, others, bad in objects if not bad and set(tags) & set(others)}
    rows = lambda n: sorted(map(tuple, retrieval.controlled_expansion(*frames, n).select("query_id", "id").collect()))
    assert rows(spark.createDataFrame(negative, "query_id long, id long")) == sorted(near - own - set(negative))
    every = {i for _, i in negative[:40]}
    assert rows(spark.createDataFrame([(i,) for i in every], "id long")) == sorted((q, i) for q, i in near - own if i not in every)


def test_exact_search_makes_words_plain_in_compiled_code(spark, monkeypatch):
    """Word by word within an array, expressions are interpreted, for every word of the corpus."""
    plans, posted = [], []

    def kept(df, name):
        if name == "postings":
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
            posted.extend(sorted(map(tuple, df.select("id", "word").collect())))
        return df

    monkeypatch.setattr(retrieval, "staged", kept)
    objects = spark.createDataFrame([(1, "No 4", "(law) law, law other"), (2, "No 4", "flaw.")], "id long, title string, text string")
    queries = spark.createDataFrame([(7, 4, ["law"])], "query_id long, number long, tokens array<string>")
    assert [(r.id, r.matched) for r in retrieval.exact_search(objects, queries, 3, fields=("text",)).collect()] == [(1, 1)]
    assert posted == [(1, "law")]
    assert "lambdafunction" not in plans[0]
