import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from folioworks.llm import simhash
from folioworks.llm.components import connected_components, local_roots

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def texts():
    rng = random.Random(3)
    out = [None, "", " \n\t", "One", "one TWO", "é É ß", "a b", "a  b", "İ K"]
    for _ in range(25):
        base = [rng.choice(WORDS) for _ in range(rng.randint(60, 200))]
        out.append(" ".join(base))
        for _ in range(rng.randint(0, 4)):
            near = base.copy()
            near[rng.randrange(len(near))] = "changed"
            out.append("\n".join(near))
    return out + out[10:14]


def test_equals_brute_force(spark):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"fp": F.lit("clash"), "key": F.lit(1), "id": F.lit(2)})
    prints = {i: brute.simhash(t) for i, t in rows}
    classes = brute.classes(list(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    got = {r.doc_id: (r.fp & (1 << 64) - 1, r.component_id) for r in simhash.simhash_classes(docs).collect()}
    assert got == {i: (prints[i], classes[i]) for i in prints}
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(classes.values()))


def test_null_ids_repeats_and_empty(spark):
    rows = [(None, "a b c d"), (None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (None, "other words here now"), (7, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.component_id or -1) for r in simhash.simhash_classes(docs).collect())
    assert got == [(-1, -1), (-1, 5), (-1, 5), (5, 5), (5, 5), (7, 7)]
    assert sorted((r.doc_id or -1, r.text) for r in simhash.keep_one(docs).collect()) == [(-1, "other words here now"), (5, "a b c d"), (7, "")]
    assert simhash.simhash_classes(docs.limit(0)).count() == 0 and simhash.keep_one(docs.limit(0)).count() == 0


def near(n, seed):
    """Distinct fingerprints around a few centres, many of them linked in chains."""
    rng = np.random.default_rng(seed)
    made = set()
    while len(made) < n:
        x = int(rng.integers(0, 4)) * 0x9E3779B97F4A7C15 % (1 << 64)
        for b in rng.integers(0, 24, rng.integers(0, 7)):
            x ^= 1 << int(b)
        made.add(x)
    return np.array(sorted(made), np.uint64)


@pytest.mark.parametrize("limit", [1, 10_000])
def test_long_lists_link_the_same(limit, monkeypatch):
    monkeypatch.setattr(simhash, "COMPARE_UP_TO", limit)
    members = near(300, 1)
    a, b = simhash.list_links(members)
    got = {tuple(sorted((int(members[i]), int(members[j])))) for i, j in zip(a, b)}
    # within one list of five shared bytes all differences lie in three bytes
    wanted = {tuple(sorted((int(x), int(y)))) for i, x in enumerate(members) for y in members[i + 1 :] if (int(x) ^ int(y)).bit_count() <= 3}
    assert got == wanted


def test_index_connects_what_is_linked(spark):
    members = near(400, 2)
    rng = np.random.default_rng(5)
    members = np.unique(np.r_[members, members[:50] ^ (np.uint64(1) << rng.integers(24, 64, 50).astype(np.uint64))])
    fps = spark.createDataFrame([(int(x),) for x in members.view(np.int64)], "fp long")
    roots = {r.node: r.root for r in connected_components(simhash.fingerprint_links(fps)).collect()}
    nodes = members.view(np.int64).tolist()
    wanted = brute.classes(nodes, lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 3)
    assert len(set(wanted.values())) < len(nodes)
    got: dict = {}
    for n in nodes:
        got.setdefault(roots.get(n, n), set()).add(n)
    same: dict = {}
    for n in nodes:
        same.setdefault(wanted[n], set()).add(n)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, same.values()))


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, 500), (None, 3), (700, 701), (701, 700)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(201)} | {700: 700, 701: 700}
    assert local_roots(5, np.array([0, 3]), np.array([4, 1])).tolist() == [0, 1, 2, 1, 0]
