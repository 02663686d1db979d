"""Exact nearest vectors by cosine, with cells that a query can leave out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from folioworks.session import staged

#: Vectors that cells are built around (those whose keys hash lowest), points of a block, queries scored at once, and queries sent at once with the cells that they meet.
CENTRES, BLOCK, TOGETHER, SENT = 256, 1 << 14, 32, 256
#: Bounds and scores are sums in different orders.
SLACK = 1e-9


def _in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of matching components, summed up in their order."""
    total = np.zeros(np.broadcast_shapes(a.shape[:-1], b.shape[:-1]))
    for i in range(a.shape[-1]):
        total += a[..., i] * b[..., i]
    return total


def _units(vectors: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        high = np.abs(vectors).max(axis=-1, keepdims=True, initial=0)
        scaled = vectors / np.where(high > 0, high, 1)
        norms = np.sqrt((scaled * scaled).sum(axis=-1, keepdims=True))
        return np.where(norms > 0, scaled / np.where(norms > 0, norms, 1), 0)


def _scored(stored: pd.DataFrame, asked: pd.DataFrame, key: str, k: int, same: tuple[str, ...]) -> pd.DataFrame:
    """Each asked query's ``k`` best of the stored points."""
    found: list[tuple] = []
    if len(stored) and len(asked):
        keys, matrix = stored[key].to_numpy(), np.array(stored["_v"].tolist())
        norms = np.sqrt(_in_order(matrix, matrix))
        for start in range(0, len(asked), TOGETHER):
            some = asked.iloc[start : start + TOGETHER]
            wanted = np.array(some["_v"].tolist())
            size = norms[None] * np.sqrt(_in_order(wanted, wanted))[:, None]
            with np.errstate(divide="ignore", invalid="ignore"):
                scores = np.where(size > 0, _in_order(wanted[:, None], matrix[None]) / size, -np.inf)
            for c in same:
                free = some[c].isna().to_numpy()[:, None]
                scores[~(free | (some[c].to_numpy()[:, None] == stored[c].to_numpy()[None]))] = -np.inf
            for query, row in zip(some["query_id"], scores):
                at = np.flatnonzero(row >= np.partition(row, -k)[-k]) if len(row) > k else np.arange(len(row))
                at = at[row[at] > -np.inf]
                at = at[np.lexsort((keys[at], -row[at]))][:k]
                found += [(query, keys[i], row[i]) for i in at]
    return pd.DataFrame(found, columns=["query_id", key, "score"])


def vector_top_k(points: DataFrame, queries: DataFrame, k: int, key: str = "object_id", vector: str = "vector", same: tuple[str, ...] = (), centres: int = CENTRES, scored: list | None = None) -> DataFrame:
    """K-03: for each query (query_id, q, and the columns ``same``) the ``k`` nearest points
    by cosine, of those that agree in ``same`` where the query has a value.

    Points lie in cells: the nearest of the centres, and equal values of ``same``. A cell
    has a centre and a radius, so the angle to the centre bounds every score in it. A query
    first meets its most promising cells, until they hold ``k`` points that it may have; its
    k-th score there then rules out every cell whose bound stays below. What a query meets
    are blocks of a cell, so a frequent cell is spread over tasks. Cells and what they hold are
    as many as the centres times the values of ``same``. Vectors that are null or hold nulls,
    zero vectors and vectors of another length have no score. ``scored`` gets the number of
    (query, point) pairs that were scored in each pass, if given.
    """
    spark = points.sparkSession
    whole = lambda c: F.forall(c, lambda x: F.coalesce(~F.isnan(x), F.lit(False)))
    types = dict(queries.select("query_id").dtypes) | dict(points.select(key, *same).dtypes)
    p = points.where(whole(F.col(vector))).select(F.col(key), F.col(vector).cast("array<double>").alias("_v"), *same)
    q = queries.where(whole(F.col("q"))).select("query_id", F.col("q").cast("array<double>").alias("_v"), *same)
    sizes = [r[0] for r in q.groupBy(F.size("_v")).count().collect()]
    chosen = p.where(F.size("_v").isin(sizes or [0])).orderBy(F.xxhash64(key), key).select("_v").limit(centres).collect()
    around = {n: _units(np.array([r[0] for r in chosen if len(r[0]) == n])) for n in {len(r[0]) for r in chosen}}

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b.assign(_c=0, _angle=0.0)
            sizes = b["_v"].map(len).to_numpy()
            for n in np.unique(sizes):
                at = np.flatnonzero(sizes == n)
                if n in around:
                    near = _units(np.array(b["_v"].iloc[at].tolist())) @ around[n].T
                    best = near.argmax(axis=1)
                    b.loc[b.index[at], "_c"] = best
                    b.loc[b.index[at], "_angle"] = np.arccos(np.clip(near[np.arange(len(at)), best], -1, 1))
                else:
                    b.loc[b.index[at], "_angle"] = np.pi
            yield b.assign(_n=sizes)

    fields = ", ".join(f"`{c}` {t}" for c, t in p.dtypes)
    placed = p.mapInPandas(place, fields + ", _c int, _angle double, _n int")
    cells_of = ["_n", "_c", *same]
    kept = staged(placed.withColumn("_block", F.lit(0)), "points")
    table = kept.groupBy(*cells_of).agg(F.count("*").alias("_size"), F.max("_angle").alias("_radius"))
    cells = table.collect()  # as many as the centres times the values of ``same``
    blocks = max((-(-r["_size"] // BLOCK) for r in cells), default=1)
    block_of = F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")
    columns = ["_n", "_c", "_size", "_radius", *same]
    known = pd.DataFrame([[r[c] for c in columns] for r in cells], columns=columns)

    def bounds(b: pd.DataFrame) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each query its number in the batch, the cells that it may meet, and their bounds."""
        by_size = {n: known[known["_n"] == n] for n in known["_n"].unique()}
        for i, (v, *wanted) in enumerate(zip(b["_v"], *(b[c] for c in same))):
            mine = by_size.get(len(v))
            if mine is None:
                continue
            for c, value in zip(same, wanted):
                mine = mine if pd.isna(value) else mine[mine[c] == value]
            unit = _units(np.array(v))
            if not len(mine) or not unit.any():
                continue
            angles = np.arccos(np.clip(around[len(v)] @ unit, -1, 1))[mine["_c"].to_numpy()] if len(v) in around else np.zeros(len(mine))
            yield i, mine.index.to_numpy(), np.cos(np.maximum(0, angles - mine["_radius"].to_numpy())) + SLACK

    def visits(first: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for start in range(0, len(b), SENT):
                    few = b.iloc[start : start + SENT]
                    meets: list[list[int]] = [[] for _ in range(len(few))]
                    for i, at, high in bounds(few):
                        order = np.argsort(-high, kind="stable")
                        held = np.cumsum(known["_size"].to_numpy()[at[order]])
                        n_first = int(np.searchsorted(held, k)) + 1
                        some = at[order[:n_first]]
                        if not first:
                            rest = order[n_first:]
                            least = few["_least"].iloc[i]
                            some = at[rest] if pd.isna(least) else at[rest[high[rest] >= least]]
                        meets[i] = some.tolist()
                    yield few.drop(columns=["_least"]).assign(_cells=pd.Series(meets, index=few.index, dtype=object))

        return run

    schema = ", ".join(f"`{c}` {t}" for c, t in q.dtypes) + ", _cells array<long>"
    numbers = spark.createDataFrame([(i, *(r[c] for c in cells_of)) for i, r in enumerate(cells)], "_cell long, _n int, _c int" + "".join(f", `{c}` {types[c]}" for c in same))
    on = F.lit(True)
    for c in cells_of:
        on = on & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    celled = kept.withColumn("_block", block_of).alias("a").join(F.broadcast(numbers).alias("b"), on).select("a.*", "b._cell")

    def met(asked: DataFrame) -> DataFrame:
        asked = asked.select(*q.columns, F.explode("_cells").alias("_cell"))
        each = asked.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))) if blocks > 1 else asked.withColumn("_block", F.lit(0))
        here = celled.join(each.select("_cell", "_block").distinct(), ["_cell", "_block"], "left_semi")
        if scored is not None:
            scored.append(here.groupBy("_cell", "_block").count().join(each.groupBy("_cell", "_block").agg(F.count("*").alias("m")), ["_cell", "_block"]).agg(F.sum(F.col("count") * F.col("m"))).first()[0] or 0)
        left, right = here.drop("_c", "_angle", "_n").groupBy("_cell", "_block"), each.groupBy("_cell", "_block")
        return left.cogroup(right).applyInPandas(lambda s, a: _scored(s, a, key, k, same), f"query_id {types['query_id']}, `{key}` {types[key]}, score double")

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    ranked = lambda x: x.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    once = ranked(met(q.withColumn("_least", F.lit(None).cast("double")).mapInPandas(visits(True), schema)))
    once = staged(once, "nearest")
    least = once.where(F.col("rank") == k).select("query_id", F.col("score").alias("_least"))
    rest = met(q.join(least, "query_id", "left").select(*q.columns, "_least").mapInPandas(visits(False), schema))
    return ranked(once.drop("rank").unionByName(rest))
