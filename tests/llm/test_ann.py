import numpy as np
import pytest
from pyspark.sql import functions as F

from folioworks.llm import ann


def exact(vectors, k, every):
    """id -> vector to {query: [(id, score)]} by double inner products, ties to smaller ids."""
    ids = sorted(vectors)
    matrix = np.array([vectors[i] for i in ids], np.float32).astype(float)
    out = {}
    for n, q in enumerate(ids):
        if q % every == 0:
            scores = matrix @ matrix[n]
            scores[n] = -np.inf
            order = np.lexsort((ids, -scores))[: min(k, len(ids) - 1)]
            out[q] = [(ids[i], scores[i]) for i in order]
    return out


def vectors(n=900, dims=10, seed=2):
    rng = np.random.default_rng(seed)
    made = rng.normal(size=(n, dims)) * rng.uniform(0.5, 2, (n, 1))
    made[100:400] = made[100]  # a third are copies of one
    return {i: made[i].astype(np.float32).tolist() for i in range(n)}


@pytest.mark.parametrize("sizes", [(8192, 1024), (128, 8)])
def test_recall_and_order(spark, sizes, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", sizes[0])
    monkeypatch.setattr(ann, "QUERIES", sizes[1])
    rows = vectors()
    bad = [(2000, None), (2020, [0.0] * 10), (2040, [float("nan")] + [1.0] * 9), (2060, [None] + [1.0] * 9), (2080, [float("inf")] * 10), (2100, [1.0] * 3), (None, [1.0] * 10), (0, rows[0])]
    table = spark.createDataFrame([*rows.items(), *bad], "vec_id long, embedding array<float>").withColumns({"no": F.lit("clash"), "score": F.lit(1), "ids": F.lit(1)})
    found: dict = {}
    for r in ann.nearest(table, "vec_id % 20 = 0", 20).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(found[r.query_id])
    wanted = exact(rows, 20, 20)
    assert found.keys() == wanted.keys()
    hits = sum(len({i for i, _ in found[q]} & {i for i, _ in wanted[q]}) for q in wanted)
    assert hits / sum(map(len, wanted.values())) >= 0.95
    for q, got in found.items():
        score = {i: float(np.dot(np.float32(rows[q]).astype(float), np.float32(rows[i]).astype(float))) for i, _ in got}
        assert q not in score and all(s == pytest.approx(score[i], abs=1e-12) for i, s in got)
        assert got == sorted(got, key=lambda x: (-x[1], x[0]))


def test_few_rows(spark):
    table = spark.createDataFrame([(20, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5])], "vec_id long, embedding array<float>")
    assert [(r.rank, r.vec_id, r.score) for r in ann.nearest(table).orderBy("rank").collect()] == [(1, 1, 0.5), (2, 2, 0.5)]
    assert ann.nearest(table.limit(0)).count() == 0
    assert ann.nearest(table.where("vec_id < 3")).count() == 0


def test_parallel_errors_weigh_more():
    rng = np.random.default_rng(0)
    data = rng.normal(size=(1500, 48))
    data /= np.linalg.norm(data, axis=1, keepdims=True)
    eta = ann.parallel_weight(48)
    assert eta > 1

    def parallel(rounds, weight):
        books = ann.fit(data, rounds)
        codes = ann.assign(data, books, weight)
        left = data - np.concatenate([books[m][codes[:, m]] for m in range(len(books))], 1)
        return ((left * data).sum(1) ** 2).mean()

    assert parallel(3, eta) < parallel(0, 1.0)


def test_table_scan_is_the_decoded_product():
    rng = np.random.default_rng(1)
    data, query = rng.normal(size=(50, 8)), rng.normal(size=(3, 8))
    books = ann.fit(data)
    codes = ann.assign(data, books, 1.0)
    decoded = np.concatenate([books[m][codes[:, m]] for m in range(len(books))], 1)
    table, packed = ann.tables(query, books), ann.packed(codes)
    scores = sum(table[:, j][:, packed[:, j]] for j in range(packed.shape[1]))
    assert np.allclose(scores, query @ decoded.T, atol=1e-5)
