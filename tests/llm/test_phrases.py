"""Phrase mining: intervals against plain counting, and whole results against brute force."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import Row

from folioworks.llm import phrases


def brute(docs, least, most=2000):
    grams, n = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            ws = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for m in range(1, 6):
                grams[lang].update(tuple(ws[i : i + m]) for i in range(len(ws) - m + 1))
    out = []
    for lang, f in grams.items():
        cand = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = {q[i : i + m] for q, b in cand.items() for m in range(2, len(q)) for i in range(len(q) - m + 1) if b >= f[q[i : i + m]]}
        rows = []
        for p, a in cand.items():
            if p not in inside:
                score, k = min((1000 * a * n[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), " ".join(p), f[p[:k]], f[p[k:]]))
        out += [(lang, rank, p, -a, l, r, n[lang], -s) for rank, (s, a, _, p, l, r) in enumerate(sorted(rows)[:most], 1)]
    return sorted(out)


def plain_counts(s, m):
    return Counter(tuple(s[i : i + m].tolist()) for i in range(len(s) - m + 1) if (s[i : i + m] > 0).all())


@pytest.mark.parametrize("lengths", [(2,), (3,), (4, 5), (1, 2, 3, 4, 5)])
def test_intervals_count_phrases_and_their_extensions(lengths):
    for seed in range(40):
        r = np.random.default_rng(seed)
        s = r.integers(0, r.integers(2, 6), r.integers(1, 60))
        if not s.any():
            continue
        for found, count, left, right in phrases.phrases_of(s, lengths):
            m = found.shape[1]
            assert {tuple(p): n for p, n in zip(found.tolist(), count.tolist())} == plain_counts(s, m)
            longer = plain_counts(s, m + 1) if m < 5 else {}
            for p, a, b in zip(found.tolist(), left, right):
                assert a == max((n for q, n in longer.items() if q[1:] == tuple(p)), default=0)
                assert b == max((n for q, n in longer.items() if q[:-1] == tuple(p)), default=0)


def texts(seed, n=120):
    r = np.random.default_rng(seed)
    words = ["New", "york", "of", "the", "a\tb", "é", "X1", "the", "of"]
    ends = [" ", " ", " ", "  ", "\t", ". ", ", ", "!\n", "\r"]
    out = []
    for _ in range(n):
        k = r.integers(0, 40)
        out.append("".join(words[w] + ends[e] for w, e in zip(r.integers(0, len(words), k), r.integers(0, len(ends), k))))
    return [("en" if i % 3 else None if i % 2 else "fr", t) for i, t in enumerate(out)]


def rows(frame):
    return sorted(tuple(r) for r in frame.collect())


@pytest.mark.parametrize("shard, bits", [(1 << 20, 1 << 16), (60, 1 << 16), (60, 64)])
def test_equal_to_brute_force_whatever_shards_and_filter_bits(spark, shard, bits):
    docs = texts(1) + [("en", None), ("en", ""), ("de", "..."), ("xx", "b b b b b b b " * 30)]
    frame = spark.createDataFrame([Row(lang=lang, text=t, phrase=1, a="x", ids=2) for lang, t in docs], "lang string, text string, phrase int, a string, ids int")
    got = phrases.collocations(frame.repartition(4), least=7, shard=shard, bits=bits)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert rows(got) == brute(docs, 7)


def test_one_round_for_all_lengths_and_a_low_rank(spark):
    docs = texts(2) + [("en", "once upon a time there was. " * 20)] * 3
    frame = spark.createDataFrame(docs, "lang string, text string")
    assert rows(phrases.collocations(frame, least=5, most=9, rounds=((2, 3, 4, 5),))) == brute(docs, 5, 9)


def test_a_phrase_inside_a_longer_one_goes(spark):
    docs = [("en", "we hold these truths firm. " * 10 + "these truths. " * 2)]
    got = {r.phrase: r.a for r in phrases.collocations(spark.createDataFrame(docs, "lang string, text string"), least=10).collect()}
    assert got == {"we hold these truths firm": 10, "these truths": 12}


def test_long_texts_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(phrases, "BYTES", 64)
    long = "alpha beta gamma. " * 500
    assert b".".join(phrases.chunks(long.encode())) == long.encode()
    whole = "no end at all " * 50
    assert list(phrases.chunks(whole.encode())) == [whole.encode()]
    docs = [("en", long), ("en", whole * 20)]
    frame = spark.createDataFrame(docs, "lang string, text string")
    assert rows(phrases.collocations(frame, least=50)) == brute(docs, 50)
    assert phrases.collocations(frame.limit(0)).collect() == []


def test_a_phrase_is_sent_by_as_many_tasks_as_cores_need(spark):
    cores = spark.sparkContext.defaultParallelism
    frame = spark.createDataFrame([("en", "again and again.")] * 400, "lang string, text string").repartition(10 * cores)
    every = [spark.sparkContext.broadcast(b"\xff" * 8)]
    sent = phrases.shard_phrases(phrases.shards(frame, "text", "lang"), (3,), every).where("phrase = 'again and again'").collect()
    assert sum(r.a for r in sent) == 400
    assert len(sent) <= phrases.TASKS * cores


def test_only_frequent_words_leave_the_shards_and_shards_are_few_values(spark, monkeypatch):
    sent = []
    whole = phrases.shard_phrases
    monkeypatch.setattr(phrases, "shard_phrases", lambda held, lengths, *a: sent.append((held, lengths, whole(held, lengths, *a))) or sent[-1][2])
    docs = [("en", f"again and again rare{i} odd{i}.") for i in range(2000)]
    got = phrases.collocations(spark.createDataFrame(docs, "lang string, text string"), shard=500)
    assert rows(got) == brute(docs, 100)
    held, lengths, words = sent[0]
    assert lengths == (1,) and {r.phrase for r in words.collect()} == {"again", "and"}
    assert not any("array" in kind for _, kind in held.dtypes)  # a value a word is what filled an executor
    assert sum(r.n for r in held.collect()) == 10_000


def test_products_beyond_64_bits(spark):
    frame = spark.sql("select 10000000000000L as a, 90000000000000L as n, 3L as l, 30000000000000L as r")
    div = frame.selectExpr("(cast(1000 as decimal(4,0)) * cast(a as decimal(18,0)) * cast(n as decimal(16,0))) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0))) as score")
    assert div.first().score == 1000 * 10**13 * 9 * 10**13 // (3 * 3 * 10**13)
