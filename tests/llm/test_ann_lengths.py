"""Doubles, other lengths and the recall of the registered query."""

import numpy as np
import pytest

from folioworks.llm import ann, queries
from test_ann import exact


def test_doubles_and_lengths(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=6) * (1e60 if i % 7 == 0 else 1)).tolist()) for i in range(200)]
    rows += [(1000 + i, rng.normal(size=3).tolist()) for i in range(50)] + [(2000, [1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(table, "vec_id % 20 = 0", 5).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert got.keys() == {i for i in [*range(200), *range(1000, 1050)] if i % 20 == 0}
    of = dict(rows)
    for q, hits in got.items():
        others = [(float(np.dot(of[q], v)), -i) for i, v in rows if i != q and len(v) == len(of[q])]
        wanted = sorted(others, reverse=True)[:5]
        assert [hits[r][0] for r in range(1, 6)] == [-i for _, i in wanted]
        assert np.allclose([hits[r][1] for r in range(1, 6)], [s for s, _ in wanted], rtol=1e-13)


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.1"])
def test_recall_of_the_query(spark, sf):
    rows = {r.vec_id: r.embedding for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()}
    wanted = exact(rows, 20, 20)
    found: dict = {}
    for r in queries.QUERIES["op3_ann"](spark, sf).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    assert found.keys() == wanted.keys() and all(len(x) == 20 for x in found.values())
    assert sum(len(found[q] & {i for i, _ in wanted[q]}) for q in wanted) / sum(map(len, wanted.values())) >= 0.95
