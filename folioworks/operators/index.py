"""The vector index as a table: writing, deleting, rebuilding and reconciling it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from folioworks.functions.text import point_id
from folioworks.session import staged

PASSAGE, QUERY = "passage: ", "query: "
PAYLOAD = ("title", "object_type", "branch", "topic", "subtopic", "micro_issue", "source_key")


def prefixed(text: Column, prefix: str = PASSAGE) -> Column:
    """S-22: the prefix once; text with the opposite one is null, to be rejected."""
    other = QUERY if prefix == PASSAGE else PASSAGE
    return F.when(text.startswith(other), None).when(text.startswith(prefix), text).otherwise(F.concat(F.lit(prefix), text))


def embed(objects: DataFrame, encoder: Callable[[], Callable[[list[str]], list[list[float]]]], model: str, version: str, text: str = "original_text", batch: int = 64, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """S-22: index points of objects, and the rejected objects.

    ``encoder`` makes, once per worker, a function from texts to vectors; a point carries its
    own object's payload, the model and the hash of the text that was encoded.
    """

    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        run = encoder()
        for texts in batches:
            out: list = []
            for start in range(0, len(texts), batch):
                out += run(texts.iloc[start : start + batch].tolist())
            yield pd.Series(out, dtype=object)

    told = objects.withColumn("_passage", prefixed(F.col(text)))
    points = told.where("_passage is not null").select(
        point_id(F.col(key)).alias("point_id"), F.col(key).alias("object_id"), *(F.col(c) for c in PAYLOAD if c in objects.columns), encode("_passage").alias("vector"),
        F.lit(model).alias("embedding_model"), F.lit(version).alias("embedding_version"), F.sha2("_passage", 256).alias("content_hash"),
    )
    return points, told.where("_passage is null").drop("_passage")


def write_points(index: DataFrame, points: DataFrame) -> DataFrame:
    """S-20: the index with the points in place of those with their ids."""
    return index.join(points.select("point_id"), "point_id", "left_anti").unionByName(points, allowMissingColumns=True)


def delete_points(index: DataFrame, ids: DataFrame | None = None, where: Column | None = None) -> DataFrame:
    """S-21: without the points of the objects, or without those that a condition picks."""
    left = index if ids is None else index.join(ids.select("object_id"), "object_id", "left_anti")
    return left if where is None else left.where(~F.coalesce(where, F.lit(False)))


def reconcile(objects: DataFrame, index: DataFrame, key: str = "id", link: str = "object_id") -> DataFrame:
    """J-06: (key, side): ids that only the objects or only the index have, and index rows
    without an object id (payload_less, by point)."""
    a, b = objects.select(F.col(key).alias("k")).distinct(), index.where(F.col(link).isNotNull()).select(F.col(link).alias("k")).distinct()
    missing = a.join(b, "k", "left_anti").select(F.col("k").cast("string").alias("key"), F.lit("missing").alias("side"))
    stray = b.join(a, "k", "left_anti").select(F.col("k").cast("string").alias("key"), F.lit("stray").alias("side"))
    out = missing.unionByName(stray)
    return out.unionByName(index.where(F.col(link).isNull()).select(F.col("point_id").cast("string").alias("key"), F.lit("payload_less").alias("side"))) if "point_id" in index.columns else out


def reconcile_counts(objects: DataFrame, index: DataFrame, group: str, key: str, link: str) -> DataFrame:
    """J-06, M-11: per group objects, points, ids on one side only, and whether it is consistent."""
    both = objects.select(F.col(key).alias("k"), F.col(group).alias("og")).join(index.select(F.col(link).alias("k"), F.col(group).alias("ig")), "k", "full_outer")
    side = lambda c: F.sum(F.when(c, 1).otherwise(0))
    o, i = F.col("og").isNotNull(), F.col("ig").isNotNull()
    counts = both.groupBy(F.coalesce("og", "ig").alias(group)).agg(side(o).alias("n_objects"), side(i).alias("n_points"), side(o & ~i).alias("n_missing"), side(i & ~o).alias("n_stray"))
    return counts.withColumn("consistent", (F.col("n_missing") == 0) & (F.col("n_stray") == 0))


def missing_objects(objects: DataFrame, index: DataFrame, key: str = "id", link: str = "object_id") -> DataFrame:
    """J-07: the objects to embed and write again."""
    return objects.join(index.select(F.col(link).alias("_k")).where("_k is not null").distinct(), F.col(key) == F.col("_k"), "left_anti")


def verified(objects: DataFrame, points: DataFrame, text: str = "original_text", key: str = "id") -> DataFrame:
    """M-11: (key, side) of what is wrong with the points of objects: what ``reconcile`` finds,
    objects whose text is not what their point was made of (changed), points that share an
    object (repeated), and points without a whole vector (vectorless)."""
    of = F.sha2(prefixed(F.col(text)), 256)
    passages = objects.select(F.col(key).cast("string").alias("key"), of.alias("_hash")).where("_hash is not null")
    held = points.where("object_id is not null").select(F.col("object_id").cast("string").alias("key"), "content_hash", "vector")
    changed = held.join(passages, "key").where(~F.col("content_hash").eqNullSafe(F.col("_hash"))).select("key", F.lit("changed").alias("side")).distinct()
    repeated = held.groupBy("key").agg(F.count("*").alias("_n")).where("_n > 1").select("key", F.lit("repeated").alias("side"))
    whole = F.coalesce(F.size("vector") > 0, F.lit(False)) & F.coalesce(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x)), F.lit(False))
    vectorless = held.where(~whole).select("key", F.lit("vectorless").alias("side")).distinct()
    return reconcile(objects, points, key).unionByName(changed).unionByName(repeated).unionByName(vectorless)


def rebuilt(objects: DataFrame, encoder: Callable[[], Callable[[list[str]], list[list[float]]]], model: str, version: str, spoil: Callable[[DataFrame], DataFrame] | None = None, **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """M-11: the whole index anew from its objects: points, written to the shared folder and read
    back, the rejected objects, and what is wrong with the written points by ``verified`` (only
    the rejected ones missing: swap them in by ``tables.replace``). ``spoil`` changes what is written, to see that it is found."""
    points, rejected = embed(objects, encoder, model, version, **options)
    written = staged(spoil(points) if spoil else points, "index")
    return written, rejected, verified(objects, written, options.get("text", "original_text"), options.get("key", "id"))


def repaired(objects: DataFrame, index: DataFrame, encoder: Callable[[], Callable[[list[str]], list[list[float]]]], model: str, version: str, **options) -> tuple[DataFrame, DataFrame]:
    """J-07: the index with points for the objects that it lacks and without those of objects
    that are gone or unnamed, and the objects that were rejected. Sound points stay as they are."""
    ids = objects.select(F.col("id").alias("object_id")).distinct()
    kept = index.join(ids, "object_id", "left_semi").select(index.columns)
    points, rejected = embed(missing_objects(objects, kept), encoder, model, version, **options)
    return kept.unionByName(points, allowMissingColumns=True), rejected
