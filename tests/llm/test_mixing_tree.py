"""The splitting tree decides which shard takes what: held against a plain walk of it."""

import random
from collections import Counter

import numpy as np

from folioworks.llm import mixing, queries


def plain_tree(counts, shards, seed):
    """Every leaf's share, splitting all nodes from the root down, one source after another."""
    shares, nodes = {}, [(0, shards, list(counts))]
    while nodes:
        low, high, have = nodes.pop()
        if high - low == 1:
            shares[low] = have
            continue
        middle = (low + high) // 2
        n = sum(have) * (middle - low) // (high - low)
        rng = np.random.default_rng([seed, low, high])
        drawn, left, total = [], n, sum(have)
        for c in have:
            total -= c
            x = int(rng.hypergeometric(c, total, left)) if c and total and left else min(c, left)
            drawn.append(x)
            left -= x
        nodes += [(low, middle, drawn), (middle, high, [c - x for c, x in zip(have, drawn)])]
    return shares


def rows(n=900):
    rng = random.Random(3)
    return [(i, "w " * rng.randint(1, 9), f"s{min(i % 7, 3)}") for i in range(n)] + [(n + i, "", "s3") for i in range(40)]


def taken(spark, at):
    return {r.doc_id: [int(x) for x in r.shards.split(",") if x] for r in queries.QUERIES["op4_mix"](spark, at).collect()}


def test_shares_of_every_shard(spark, monkeypatch):
    docs = spark.createDataFrame(rows(), "doc_id long, text string, source string")
    shards = 6
    mix = mixing.Mix(docs, shards=shards, block_words=16)
    blocks = mix.blocks.collect()
    n_sources = mix.sources.count()
    takings, got = [0] * n_sources, {s: [0] * n_sources for s in range(shards)}
    for b in blocks:
        for s in [*b.shards, *([] if b.part_shard is None else [b.part_shard])]:
            takings[b.source_no] += 1
            got[s][b.source_no] += 1
    assert sum(takings) > 50
    totals = [sum(got[s]) for s in range(shards)]
    assert max(totals) - min(totals) <= 3, "shards are alike in size"
    for s in range(shards):
        assert got[s] == mixing.split_counts(np.array(takings), s, shards).tolist()


def test_plain_walk_has_the_same_law():
    counts = [40, 7, 0, 3]
    own = [mixing.split_counts(np.array(counts), s, 4, seed) for seed in range(300) for s in range(4)]
    plain = [plain_tree(counts, 4, seed)[s] for seed in range(300) for s in range(4)]
    assert np.allclose(np.mean(own, axis=0), np.mean(plain, axis=0), atol=0.3)
    assert np.allclose(np.std(own, axis=0), np.std(plain, axis=0), atol=0.3)


def test_without_the_tree_the_query_changes(spark, tmp_path, monkeypatch):
    spark.createDataFrame(rows(), "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 16)
    monkeypatch.setattr(mixing.Mix.__init__, "__defaults__", tuple(16 if d == 1 << 16 else d for d in mixing.Mix.__init__.__defaults__))
    before = taken(spark, str(tmp_path))
    assert len(Counter(s for x in before.values() for s in x)) == mixing.SHARDS
    monkeypatch.setattr(mixing, "split_counts", lambda counts, shard, shards, seed=0: counts if shard == 0 else counts * 0)
    after = taken(spark, str(tmp_path))
    assert {s for x in after.values() for s in x} == {0} and before != after


def test_texts_without_words_keep_the_bound(spark):
    docs = spark.createDataFrame([(i, "word", "a") for i in range(20)] + [(100 + i, "", "a") for i in range(60)] + [(200 + i, "w " * 50, "b") for i in range(40)], "doc_id long, text string, source string")
    got = mixing.mixed(docs, block_words=1, shards=2).collect()
    counts = Counter(r.doc_id for r in got)
    assert max(counts.values()) <= 3 and counts[0] == 3 and {counts[100 + i] for i in range(60)} == {3}


def test_very_long_text(spark):
    docs = spark.createDataFrame([(1, "w " * 300_000, "a"), (2, "w " * 40, "a"), (3, None, "b"), (4, "w " * 100_000, "b")], "doc_id long, text string, source string")
    got = {r.doc_id: r for r in mixing.mix_report(docs).collect()}
    assert got[1]["size"] == 300_000 and got[3]["size"] == 0 and all(r.taken <= 3 * r["size"] for r in got.values())
