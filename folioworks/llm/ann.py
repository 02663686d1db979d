"""Approximate nearest neighbours by largest inner product, with score-aware quantisation.

Directions of vectors are coded four bits for each pair of components. What decides the
order of inner products is the part of the coding error that is parallel to the vector, so
codebooks and codes minimise an anisotropic loss that weighs the parallel part of the error
higher than the rest. A search adds table entries for all codes of a block, times the norm,
and what scores best there is ranked again by exact inner products of the original vectors
in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from folioworks.session import staged

#: Vectors of one length, by a hash of their ids, that the codebooks are fitted on at most; all are indexed.
SAMPLE = 4096
CENTRES, PART = 16, 2
#: Cosine above which a score matters: sets how much more the parallel error weighs.
THRESHOLD = 0.2
ROUNDS = 3
#: Vectors and queries of a block at most. A vector is shipped once for each block of queries and the other way
#: round, so that both are as large as a task can hold (some 50 MB); small tables are cut finer, to use all cores.
BLOCK, QUERIES, FINE = 1 << 16, 1 << 14, 1 << 12
#: A block's share that is ranked exactly, and at least this many.
SHARE, LEAST = 64, 96
#: Queries whose tables are scanned together.
TOGETHER = 64


def parallel_weight(dims: int, threshold: float = THRESHOLD) -> float:
    return max(1.0, (dims - 1) * threshold**2 / (1 - threshold**2))


def padded(vectors: np.ndarray) -> np.ndarray:
    """Components up to a multiple of two parts, so that two codes fill a byte."""
    return np.pad(vectors, ((0, 0), (0, -vectors.shape[1] % (2 * PART))))


def assign(vectors: np.ndarray, books: np.ndarray, eta: float, passes: int = 1) -> np.ndarray:
    """A code for each part: the nearest centre first, then, part by part, the centre with
    the least anisotropic loss beside the other parts' present choice."""
    n, parts = len(vectors), vectors.reshape(len(vectors), -1, PART)
    units = (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).reshape(parts.shape)
    codes, rows = np.empty(parts.shape[:2], np.int64), np.arange(n)
    squares, along = [], []
    for m, book in enumerate(books):
        left = parts[:, m, None] - book
        squares.append((left**2).sum(-1))
        along.append((left * units[:, m, None]).sum(-1))
        codes[:, m] = squares[m].argmin(1)
    total = sum(along[m][rows, codes[:, m]] for m in range(len(books)))
    for _ in range(passes):
        for m in range(len(books)):
            rest = total - along[m][rows, codes[:, m]]
            codes[:, m] = (squares[m] + (eta - 1) * (rest[:, None] + along[m]) ** 2).argmin(1)
            total = rest + along[m][rows, codes[:, m]]
    return codes


def refit(vectors: np.ndarray, codes: np.ndarray, books: np.ndarray, eta: float) -> np.ndarray:
    """Centres of least anisotropic loss for given codes: one linear system for all, as the
    parallel error couples the parts. Centres that no code uses stay."""
    n, dims = vectors.shape
    units = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    pull = vectors + (eta - 1) * units * (vectors * units).sum(1, keepdims=True)
    size = len(books) * CENTRES * PART
    system, wanted = np.zeros((len(books), CENTRES, PART) * 2), np.zeros(books.shape)
    for i in range(dims):
        a = codes[:, i // PART]
        wanted[i // PART, :, i % PART] = np.bincount(a, pull[:, i], CENTRES)
        for j in range(i, dims):
            both = np.bincount(a * CENTRES + codes[:, j // PART], (eta - 1) * units[:, i] * units[:, j] + (i == j), CENTRES**2).reshape(CENTRES, CENTRES)
            system[i // PART, :, i % PART, j // PART, :, j % PART] = both
            system[j // PART, :, j % PART, i // PART, :, i % PART] = both.T
    keep = 1e-3  # holds on to centres without rows
    system = system.reshape(size, size) + keep * np.eye(size)
    return np.linalg.solve(system, wanted.ravel() + keep * books.ravel()).reshape(books.shape)


def fit(sample: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (part, centre, component) from a sample of vectors."""
    sample = padded(sample.astype(np.float64))
    eta, parts = parallel_weight(sample.shape[1]), sample.reshape(len(sample), -1, PART)
    books = np.stack([np.resize(parts[:, m], (CENTRES, PART)) + 1e-6 * np.arange(CENTRES)[:, None] for m in range(parts.shape[1])])
    for _ in range(6):  # plain k-means first
        for m, book in enumerate(books):
            code = ((parts[:, m, None] - book) ** 2).sum(-1).argmin(1)
            count = np.bincount(code, minlength=CENTRES)
            used = count > 0
            for x in range(PART):
                book[used, x] = np.bincount(code, parts[:, m, x], CENTRES)[used] / count[used]
    for _ in range(rounds):
        books = refit(sample, assign(sample, books, eta), books, eta)
    return books


def packed(codes: np.ndarray) -> np.ndarray:
    """Two four-bit codes a byte."""
    return (codes[:, ::2] * CENTRES + codes[:, 1::2]).astype(np.uint8)


def tables(queries: np.ndarray, books: np.ndarray) -> np.ndarray:
    """For each query and byte of a code: the score that each of its 256 values adds."""
    each = np.einsum("qmd,mkd->qmk", padded(queries).reshape(len(queries), -1, PART), books)
    return (each[:, ::2, :, None] + each[:, 1::2, None, :]).reshape(len(queries), -1, CENTRES**2).astype(np.float32)


def directions(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors and norms, without overflow on the way."""
    most = np.abs(vectors).max(axis=1, keepdims=True)
    scaled = vectors / most
    norm = np.linalg.norm(scaled, axis=1, keepdims=True)
    with np.errstate(over="ignore"):
        return scaled / norm, np.minimum(norm * most, np.finfo(float).max)[:, 0]


def best_in_block(vectors: np.ndarray, codes: np.ndarray, first_ids: np.ndarray, queries: np.ndarray, books: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each query: rows and exact scores of the block's best ``k``, of those that the
    table scan puts first. Ties go to the smaller first id."""
    n = len(vectors)
    depth = min(n, max(LEAST, 2 * k) + n // SHARE)
    bytes_of = np.ascontiguousarray(codes.T.astype(np.intp))
    norms = directions(vectors)[1]
    weight = (norms / norms.max()).astype(np.float32)[:, None]
    for start in range(0, len(queries), TOGETHER):
        some = queries[start : start + TOGETHER]
        table = np.ascontiguousarray(tables(directions(some)[0], books).transpose(1, 2, 0))
        score = table[0][bytes_of[0]]
        for entries, column in zip(table[1:], bytes_of[1:]):
            score += entries[column]
        score *= weight
        top = np.argpartition(np.ascontiguousarray(score.T), n - depth, axis=1)[:, n - depth :]
        for query, rows in zip(some, top):
            found = vectors[rows] @ query
            order = np.lexsort((first_ids[rows], -found))[:k]
            yield rows[order], found[order]


def _coded(vectors: DataFrame, books: dict[int, np.ndarray]) -> DataFrame:
    """Adds code and vec (doubles as bytes) in place of embedding."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(3).to_numpy()
            for n in np.unique(sizes):
                part = batch.take(pa.array(np.flatnonzero(sizes == n)))
                raw = np.asarray(part.column(2).flatten(), np.float64).reshape(part.num_rows, -1)
                unit = padded(directions(raw)[0])
                code = packed(assign(unit, books[int(n)], parallel_weight(unit.shape[1])))
                made = [pa.array([r.tobytes() for r in rows], pa.binary()) for rows in (code, raw)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *made, part.column(3)], names=["no", "ids", "code", "vec", "n"])

    return vectors.select("no", "ids", "embedding", "n").mapInArrow(run, "no long, ids array<long>, code binary, vec binary, n int")


def nearest(vectors: DataFrame, queries: str = "vec_id % 20 = 0", k: int = 20, id_col: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, id_col, score): for each row that the condition ``queries`` picks, the
    ``k`` rows with the largest inner product that the index finds, itself apart.

    Rows without an id, and vectors that are null, empty, zero or hold null or non-finite
    components take no part; vectors of different lengths have no inner product and are
    searched apart. Equal vectors are indexed once with their k + 1 smallest ids: more can't
    be among the nearest, as ties go to smaller ids. Repeated rows count once, and other
    columns play no part. Blocks of vectors meet blocks of queries; neither all vectors nor
    all queries come together anywhere. Empty tables, and tables without queries, give no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("embedding"), F.expr(f"coalesce({queries}, false)").alias("asks"))
    finite = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    sound = rows.where("id is not null and size(embedding) > 0").where(finite & F.exists("embedding", lambda x: x != 0))
    alike = Window.partitionBy("embedding").orderBy("id")
    few = sound.withColumn("nth", F.dense_rank().over(alike)).where(F.col("nth") <= k + 1)
    distinct = few.groupBy("embedding").agg(F.sort_array(F.collect_set("id")).alias("ids"))
    numbered = staged(distinct.select("embedding", "ids", F.xxhash64("embedding").alias("no"), F.col("ids")[0].alias("first"), F.size("embedding").alias("n")), "vectors")
    asking = staged(sound.where("asks").select("id", "embedding").distinct(), "asking")
    asked = numbered.select("embedding", "no", "first", "n").join(asking.select("embedding").distinct(), "embedding", "left_semi")

    counts = {r.n: [r.vectors, 0] for r in numbered.groupBy("n").agg(F.count("*").alias("vectors")).collect()}  # one row a length
    for r in asked.groupBy("n").agg(F.count("*").alias("queries")).collect():
        counts[r.n][1] = r.queries
    counts = {n: c for n, c in counts.items() if c[1]}
    if not counts:
        return spark.createDataFrame([], f"query_id long, rank int, {id_col} long, score double")
    cores = spark.sparkContext.defaultParallelism
    blocks = lambda size: max(-(-size // BLOCK), min(-(-size // FINE), cores))
    cut = F.broadcast(spark.createDataFrame([(n, blocks(v), -(-q // QUERIES)) for n, (v, q) in counts.items()], "n int, n_b int, n_q int"))
    nth = F.row_number().over(Window.partitionBy("n").orderBy(F.xxhash64("first"), "no"))
    picked = numbered.where(F.col("n").isin(list(counts))).withColumn("nth", nth).where(F.col("nth") <= SAMPLE).select("n", "embedding").toPandas()
    books = {int(n): fit(directions(np.array(x["embedding"].tolist(), np.float64))[0]) for n, x in picked.groupby("n")}

    block = lambda n: F.pmod(F.xxhash64("no", "first"), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    base = _coded(numbered.join(cut.select("n"), "n", "left_semi"), books).join(cut, "n").withColumn("first", F.col("ids")[0])
    base = base.withColumn("b", block(F.col("n_b"))).withColumn("q", each(F.col("n_q"))).drop("n_b", "n_q")
    ask = asked.join(cut, "n").withColumn("q", block(F.col("n_q"))).withColumn("b", each(F.col("n_b"))).select("no", "first", "embedding", "n", "q", "b")

    def scan(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"no": [], "first": [], "ids": [], "score": []})
        stored = np.frombuffer(b"".join(left["vec"]), np.float64).reshape(len(left), -1)
        codes = np.frombuffer(b"".join(left["code"]), np.uint8).reshape(len(left), -1)
        wanted = np.array(right["embedding"].tolist(), np.float64)
        found = list(best_in_block(stored, codes, left["first"].to_numpy(), wanted, books[int(left["n"].iloc[0])], k + 1))
        at, sizes = np.concatenate([r for r, _ in found]), [len(r) for r, _ in found]
        out = {"no": np.repeat(right["no"].to_numpy(), sizes), "first": np.repeat(right["first"].to_numpy(), sizes)}
        return pd.DataFrame(out | {"ids": left["ids"].to_numpy()[at], "score": np.concatenate([s for _, s in found])})

    hits = base.groupBy("n", "q", "b").cogroup(ask.groupBy("n", "q", "b")).applyInPandas(scan, "no long, first long, ids array<long>, score double")
    best = Window.partitionBy("no", "first").orderBy(F.desc("score"), "id")
    ids = hits.select("no", "first", "score", F.explode("ids").alias("id")).withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k + 1)
    lists = ids.groupBy("no", "first").agg(F.collect_list(F.struct("id", "score")).alias("hits"))
    owners = asking.join(numbered.select("embedding", "no", "first"), "embedding").select(F.col("id").alias("query_id"), "no", "first")
    pairs = owners.join(lists, ["no", "first"]).select("query_id", F.explode("hits").alias("hit")).select("query_id", "hit.*").where("id <> query_id")
    pairs = pairs.groupBy("query_id", "id").agg(F.max("score").alias("score"))  # an id may have several vectors
    last = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return pairs.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
