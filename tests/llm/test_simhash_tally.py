"""The tally of shared positional bytes decides which pairs are retained."""

import math
import random
from itertools import combinations

import brute
import numpy as np
import pytest

from folioworks.llm import queries, simhash
from test_simhash import near


def flipped(x, bits):
    for b in bits:
        x ^= 1 << b
    return x


def test_pairs_below_the_tally_are_dropped():
    base = 0x0123456789ABCDEF
    pairs = {3: (0, 9, 18, 27, 36), 4: (0, 9, 18, 27), 5: (0, 9, 18), 6: (0, 9), 7: (0,)}
    for shared, bits in pairs.items():
        x, y = np.array([base], np.uint64), np.array([flipped(base, bits)], np.uint64)
        assert simhash.shared_bytes(x, y)[0] == shared
        met = [p for p in simhash.PLACES if all((base ^ int(y[0])) >> 8 * q & 255 == 0 for q in p)]
        assert len(met) == math.comb(shared, 3)
        own = [p for p in met if len(simhash.retained(x, y, p[-1]))]
        assert len(own) == (shared >= 5), "retained by its first list alone, and only from five bytes on"


@pytest.mark.parametrize("limit", [1, 10_000])
def test_lists_on_three_positions_link_what_is_near(limit, monkeypatch):
    monkeypatch.setattr(simhash, "COMPARE_UP_TO", limit)
    rng = random.Random(4)
    members = near(150, 3)
    members = np.unique(np.r_[members, np.array([flipped(int(x), rng.sample(range(64), 3)) for x in members[:60]], np.uint64)])
    posted = sorted((n << 24 | sum((x >> 8 * p & 255) << 8 * (2 - i) for i, p in enumerate(places)), x) for n, places in enumerate(simhash.PLACES) for x in members.tolist())
    fps = np.array([x for _, x in posted], np.uint64)
    left, right = simhash.posted_links(np.array([k for k, _ in posted]), fps)
    pairs = [tuple(sorted((int(fps[i]), int(fps[j])))) for i, j in zip(left, right)]
    got = set(pairs)
    assert len(got) == len(pairs) or limit == 1, "every pair comes from one short list"
    assert got == {(x, y) for x, y in combinations(sorted(members.tolist()), 2) if (x ^ y).bit_count() <= 3}


def test_a_higher_tally_loses_links_of_the_query(spark, tmp_path, monkeypatch):
    rng = random.Random(6)
    rows = []
    while len(rows) < 60:  # copies with a word changed whose fingerprints are near
        words = [rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) for _ in range(300)]
        changed = [*words[:50], f"other{len(rows)}", *words[51:]]
        pair = [" ".join(words), " ".join(changed)]
        x, y = (brute.simhash(t) for t in pair)
        if 2 <= (x ^ y).bit_count() <= 3:
            rows += [(len(rows), pair[0]), (len(rows) + 1, pair[1])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")

    def classes():
        return {r.doc_id: r.component_id for r in queries.QUERIES["op6_simhash"](spark, str(tmp_path)).collect()}

    prints = {i: brute.simhash(t) for i, t in rows}
    assert classes() == brute.classes(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    monkeypatch.setattr(simhash, "LEAST_SHARED", 7)
    assert len(set(classes().values())) > len(rows) // 2
