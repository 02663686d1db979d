import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioworks.llm import mixing


def targets(sizes, weights=(5, 2, 1)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, total, stopped = {s: weights[i % len(weights)] for i, s in enumerate(names)}, sum(sizes.values()), set()
    while True:
        rest, over = total - sum(3 * sizes[s] for s in stopped), sum(weight[s] for s in names if s not in stopped)
        new = {s for s in names if s not in stopped and weight[s] * rest / over > 3 * sizes[s]} if over else set()
        if not new:
            return {s: 3.0 * sizes[s] if s in stopped else weight[s] * rest / over for s in names}
        stopped |= new


def docs(spark, n=600):
    rng = random.Random(1)
    names = ["zeta", "a", "B", "é", None, "𐀀", "～"]
    rows = [(i, "w " * rng.randint(0, 60), names[0] if i % 3 else rng.choice(names)) for i in range(n)] + [(n, None, "only null"), (n + 1, "", "a"), (n + 2, "tiny source", "tiny"), (None, "no id", "a"), (3, "same id", "a"), (3, "same id", "a")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"size": F.lit("clash"), "u": F.lit(1), "target": F.lit(2), "row": F.lit(3)})


@pytest.mark.parametrize("block_words", [64, 1 << 16])
def test_targets_and_takings(spark, block_words):
    rows, frame = docs(spark)
    report = mixing.mix_report(frame, block_words=block_words, shards=5)
    got = report.collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    wanted = targets(sizes)
    by_id = {(i, len((t or "").split())): s for i, t, s in rows}
    taken = {}
    for r in got:
        assert r.taken <= 3 * r["size"] and (r["size"] == 0 or r.taken % r["size"] == 0)
        s = by_id[r.doc_id, r["size"]]
        assert r.source_size == sizes[s] and r.target == pytest.approx(wanted[s], abs=1e-9)
        taken[s] = taken.get(s, 0) + r.taken
    for s, t in wanted.items():
        assert t - 60 <= taken[s] <= t + 1e-9
    again = mixing.mix_report(frame.repartition(7), block_words=block_words, shards=5)
    key = lambda rs: sorted((r.doc_id or -1, r["size"], r.taken) for r in rs)
    assert key(again.collect()) == key(got)


def test_rows_of_the_mix(spark):
    rows, frame = docs(spark, 300)
    mix = mixing.mixed(frame, block_words=64, shards=4)
    assert mix.columns == [*frame.columns, "_shard"]
    counts = {}
    for r in mix.collect():
        counts[r.doc_id, r.text] = counts.get((r.doc_id, r.text), 0) + 1
    assert max(counts.values()) <= 6  # a repeated row is two rows, taken three times each at most
    words = [r.n for r in mix.groupBy("_shard").agg(F.sum(mixing.word_count(F.col("text"))).alias("n")).collect()]
    assert len(words) == 4 and max(words) < 2 * min(words)
    assert mixing.mix_report(frame.limit(0)).count() == 0 and mixing.mixed(frame.limit(0)).count() == 0


def test_shares_add_up():
    counts = np.array([7, 0, 100, 1, 33])
    shares = [mixing.split_counts(counts, s, 6) for s in range(6)]
    assert (sum(shares) == counts).all() and all(abs(x.sum() - counts.sum() / 6) <= 2 for x in shares)
