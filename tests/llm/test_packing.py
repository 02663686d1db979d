"""Packing: tokens as the library gives them, pieces whole, sequences gapless and few."""

import random
import zlib
from collections import Counter
from struct import pack

import pytest
import public_tokenizers
from pyspark.sql import Row
from tokenizers import Tokenizer

from folioworks.llm import packing
from folioworks.llm.queries import BYTE_VOCABULARY, op13_packing

LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def library_ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def test_ids_equal_the_library():
    r, bpe = random.Random(5), packing.load(BYTE_VOCABULARY)
    texts = ["", " ", "a  b", "\n a", "x<|endoftext|>  y <|endoftext|>", "日本 語 text  x", "don't they'll  \t z ", "é ǜ x\u0085 y", "a\x1c b \x1f c", "trail  ", "word　x", "😀 x 😀😀  y"]
    texts += ["".join(r.choice(" \n\t ab1.'é中\u0085\xa0<|>ſ̀") for _ in range(r.randrange(1, 40))) for _ in range(3000)]
    for t in texts:
        ids = library_ids(t)
        assert bpe.encode(t) == pack(f"<{len(ids)}I", *ids), t


def least_bins(lengths, capacity):
    """The fewest bins, by trying everything."""
    lengths, best = sorted(lengths, reverse=True), [len(lengths)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(bins)
            return
        for b in sorted({x for x in bins if x + lengths[i] <= capacity}):
            k = bins.index(b)
            go(i + 1, [*bins[:k], b + lengths[i], *bins[k + 1 :]])
        go(i + 1, [*bins, lengths[i]])

    go(0, [])
    return best[0]


def test_plans_are_whole_and_near_the_fewest():
    over = 0
    for seed in range(60):
        r = random.Random(seed)
        capacity = r.choice([8, 13, 20])
        lengths = [r.randrange(1, capacity + 1) for _ in range(r.randrange(1, 10))]
        plan = packing.plan_sequences(dict(Counter(lengths)), capacity)
        assert all(sum(i) <= capacity for i, _ in plan)
        assert Counter(x for i, n in plan for _ in range(n) for x in i) == Counter(lengths)
        over += sum(n for _, n in plan) - least_bins(lengths, capacity)
    assert over <= 3


def test_exact_complements_of_one_two_and_three_lengths():
    assert packing.exact_sequences(packing.Sums({7: 2, 3: 2}, 10), 10) == ([((7, 3), 2)], {})
    assert packing.exact_sequences(packing.Sums({6: 5, 3: 5, 1: 4}, 10), 10) == ([((6, 3, 1), 4)], {6: 1, 3: 1})
    assert packing.exact_sequences(packing.Sums({5: 3, 2: 6, 1: 3}, 10), 10)[0] == [((5, 5), 1), ((5, 2, 2, 1), 1)]
    many = packing.plan_sequences({600: 10**12, 424: 10**12 - 1, 1024: 10**13}, 1024)
    assert sum(n for _, n in many) == 10**13 + 10**12


def check(rows, docs, capacity):
    """Every piece of every document, once; sequences without gaps or overlaps."""
    found = Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    wanted = Counter()
    for doc_id, text in docs:
        ids = [*library_ids(text), 2]
        first = (len(ids) - 1) % capacity + 1
        starts = [0, *range(first, len(ids), capacity)]
        for piece, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
            wanted[doc_id, piece, a, b - a, zlib.crc32(pack(f"<{b - a}I", *ids[a:b]))] += 1
    assert found == wanted
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for inside in places.values():
        at = 0
        for offset, length in sorted(inside):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


def test_query_packs_every_document(spark, sf_dir):
    rows = op13_packing(spark, sf_dir).collect()
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    n = check(rows, docs, 1024)
    assert n <= 1.01 * -(-sum(r.length for r in rows) // 1024)


def test_nulls_repeats_ties_long_texts_and_clashing_names(spark):
    long = "palabra única " * 9000
    docs = [(None, "a b"), (None, None), (1, ""), (2, None), (3, "same"), (3, "same"), (3, "other"), (4, long), (5, long)]
    frame = spark.createDataFrame([Row(doc_id=i, text=t, length="x", sequence_id=1, _cell=2, pieces=3, id="y") for i, t in docs], "doc_id long, text string, length string, sequence_id int, _cell int, pieces int, id string")
    rows = packing.pack_documents(frame.repartition(5), BYTE_VOCABULARY, capacity=64).collect()
    assert rows[0].__fields__ == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    check(rows, docs, 64)
    assert packing.pack_documents(frame.limit(0), BYTE_VOCABULARY).collect() == []


def test_sequences_hold_their_documents_ids(spark):
    docs = [(i, "one two three " * i) for i in range(30)]
    packed = packing.pack_documents(spark.createDataFrame(docs, "doc_id long, text string"), BYTE_VOCABULARY, capacity=100, keep_ids=True)
    packed = spark.createDataFrame(packed.collect(), packed.schema)
    whole = {r.sequence_id: r for r in packing.sequences(packed).collect()}
    for r in packed.collect():
        s = whole[r.sequence_id]
        assert len(s.ids) == 4 * s.n_tokens <= 400 and s.ids[4 * r.offset : 4 * (r.offset + r.length)] == r.ids


@pytest.mark.parametrize("n", [1, 5, 64, 65, 128, 200])
def test_only_the_first_piece_may_be_short(n):
    pieces = packing.cuts(n, 64)
    assert pieces[0][0] == 0 and pieces[-1][1] == n and all(b - a == 64 for a, b in pieces[1:])
