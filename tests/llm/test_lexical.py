"""Ranked search: equal to scoring every document, with fewer documents scored."""

import re
from collections import Counter
from math import floor, log

import numpy as np
from pyspark.sql import Row

from folioworks.llm import lexical
from folioworks.llm.queries import ORACLE_SQL, op12_lexical

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    held = [(i, Counter(terms(t))) for i, t in docs]
    N, L = sum(1 for _, c in held if c), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for doc_id, c in held:
            m = 25 + 75 * sum(c.values()) * N // max(1, L)
            score = sum(q * floor(1000 * log((2 * N + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, q in Counter(terms(text)).items() if c[t])
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item, rank, doc_id, -s) for rank, (s, _, _, doc_id) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def found(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def test_query_equals_scoring_everything(spark, sf_dir):
    pairs = [[tuple(r) for r in spark.read.parquet(f"{sf_dir}/{t}.parquet").select(i, "text").collect()] for t, i in (("documents", "doc_id"), ("benchmark", "item_id"))]
    assert found(op12_lexical(spark, sf_dir)) == brute(*pairs)
    assert "op12_lexical" in ORACLE_SQL


DOCS = [(None, "tie one"), (7, "tie one"), (3, "tie one"), (3, "tie one"), (1, None), (2, ""), (4, "Élan élan ELAN x2"), (5, "a-b_c a b"), (6, "word " * 4000 + "Tail"), (8, "...")] + [(100 + i, "copy of one text") for i in range(40)]
ITEMS = [(1, "TIE one one"), (1, "TIE one one"), (None, "tail word"), (2, "Élan elan"), (3, None), (4, "!?"), (5, "copy text"), (6, "b c absent")]


def test_nulls_ties_repeats_long_texts_and_clashing_names(spark):
    docs = spark.createDataFrame([Row(doc_id=i, text=t, n=1, terms="x", item=2, score="y", rank=3) for i, t in DOCS], "doc_id long, text string, n int, terms string, item int, score string, rank int")
    items = spark.createDataFrame([Row(item_id=i, text=t, doc_id="z") for i, t in ITEMS], "item_id long, text string, doc_id string")
    wanted = brute(DOCS, ITEMS)
    assert found(lexical.ranked_search(docs.repartition(3), items)) == wanted
    assert found(lexical.ranked_search(docs, items, at_once=2)) == wanted  # in several passes
    assert found(lexical.ranked_search(docs.limit(0), items)) == found(lexical.ranked_search(docs, items.limit(0))) == []


def made(n_docs, n_items, seed=3):
    """Documents of a few topics with words of their own, some rare words in all."""
    r = np.random.default_rng(seed)
    texts = [" ".join(f"t{topic}w{w}" for w in r.zipf(1.6, 40) % 60) + f" r{r.integers(200)}" for topic in r.integers(0, 20, n_docs)]
    return list(enumerate(texts)), [(i, texts[j]) for i, j in enumerate(r.integers(0, n_docs, n_items))]


def test_bounds_prune_without_loss():
    docs, items = made(3000, 40)
    counts = [Counter(map(bytes.decode, lexical.terms_of(t.encode()))) for _, t in items]
    vocabulary = {t: i for i, t in enumerate(sorted(set().union(*counts)))}
    held = [Counter(map(bytes.decode, lexical.terms_of(t.encode()))) for _, t in docs]
    N, L = len(docs), sum(sum(c.values()) for c in held)
    df = Counter(t for c in held for t in c)
    vectors = [{vocabulary[t]: lexical.weight(N, df[t]) * q for t, q in c.items()} for c in counts]
    weights = np.zeros(len(vocabulary), np.int64)
    for v in vectors:
        for t, w in v.items():
            weights[t] = max(weights[t], w)
    rows = [sorted((vocabulary[t], f) for t, f in c.items() if t in vocabulary) for c in held]
    lists = [np.cumsum([0, *map(len, rows)]), np.array([t for row in rows for t, _ in row]), np.array([f for row in rows for _, f in row])]
    ids, n = np.arange(N), np.array([sum(c.values()) for c in held])
    best, root, taken = lexical.Best(len(items), 10, {}), lexical.item_tree(vectors), 0
    for block, row_of in lexical.blocks(ids, n, lists, N, L, weights, np.int64):
        top = len(block.levels) - 1
        taken += block.descend(root, row_of, top, top, np.arange(1), best)
    assert sorted((i, rank, d, -s) for i, f in enumerate(best.found) for rank, (s, d) in enumerate(f, 1)) == sorted(brute(docs, items))
    assert taken < 0.5 * len(items) * N


def test_doubles_and_integers_agree(spark):
    docs, items = made(300, 8)
    frames = [spark.createDataFrame(x, f"{i} long, text string") for x, i in ((docs, "doc_id"), (items, "item_id"))]
    big = [(i, " ".join([t] * 5)) for i, t in items]
    assert found(lexical.ranked_search(*frames)) == brute(docs, items)
    assert found(lexical.ranked_search(frames[0], spark.createDataFrame(big, "item_id long, text string"), k=3)) == brute(docs, big, 3)
