"""Changes to tables, as functions from the current table and its changes to the next one.

A Parquet table is not updated in place: write the result elsewhere and swap (``replace``).
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, functions as F

from folioworks.functions.text import merged


def _on(keys: list[str]) -> Column:
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"c.{k}").eqNullSafe(F.col(f"n.{k}"))
    return on


def upsert(current: DataFrame, changes: DataFrame, keys: list[str], update: list[str]) -> DataFrame:
    """M-01, M-02: new keys are added whole; of known ones only ``update`` columns change.
    ``changes`` has each key once; columns that it lacks are null in new rows."""
    both = current.withColumn("_c", F.lit(True)).alias("c").join(changes.withColumn("_n", F.lit(True)).alias("n"), _on(keys), "full_outer")
    known, new, out = F.col("c._c").isNotNull(), F.col("n._n").isNotNull(), []
    for c in current.columns:
        if c not in changes.columns:
            out.append(F.col(f"c.{c}").alias(c))
        elif c in update:
            out.append(F.when(new, F.col(f"n.{c}")).otherwise(F.col(f"c.{c}")).alias(c))
        else:
            out.append(F.when(known, F.col(f"c.{c}")).otherwise(F.col(f"n.{c}")).alias(c))
    return both.select(*out)


def insert_absent(current: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """M-03: rows whose key the table lacks are added, others ignored."""
    fresh = new.alias("c").join(current.select(*keys).distinct().alias("n"), _on(keys), "left_anti")
    return current.unionByName(fresh, allowMissingColumns=True)


def guarded_status(batches: DataFrame, events: DataFrame, key: str = "batch_id", terminal: str = "completed") -> DataFrame:
    """M-04: ``events`` (key, status, and what else they set) change batches that are not
    completed; a completed one stays as it is, so a late failure can't undo it."""
    both = batches.alias("c").join(events.alias("n"), F.col(f"c.{key}") == F.col(f"n.{key}"), "left")
    may = F.col(f"n.{key}").isNotNull() & ~F.col("c.status").eqNullSafe(F.lit(terminal))
    return both.select(*((F.when(may, F.col(f"n.{c}")).otherwise(F.col(f"c.{c}")) if c in events.columns and c != key else F.col(f"c.{c}")).alias(c) for c in batches.columns))


def set_where(table: DataFrame, condition: Column, **values: Column) -> DataFrame:
    """M-05: columns with other values where the condition holds."""
    return table.withColumns({c: F.when(F.coalesce(condition, F.lit(False)), v).otherwise(F.col(c)) for c, v in values.items()})


def human_edits(objects: DataFrame, edits: DataFrame, normalize, least: int = 20) -> DataFrame:
    """M-06: edits (id, text, title or null) of ``least`` characters or more replace texts
    and mark the object as edited and accepted; the normal form follows the text."""
    sound = edits.where(F.length(F.trim("text")) >= least).select(F.col("id").alias("_id"), F.trim("text").alias("_text"), F.nullif(F.trim("title"), F.lit("")).alias("_title"))
    met = objects.join(sound, objects["id"] == sound["_id"], "left")
    hit = F.col("_id").isNotNull()
    mark = F.create_map(F.lit("human_edited"), F.lit("true"))
    return met.withColumns({
        "original_text": F.coalesce("_text", "original_text"), "normalized_text": F.when(hit, normalize(F.col("_text"))).otherwise(F.col("normalized_text")), "title": F.coalesce("_title", "title"),
        "verification_status": F.when(hit, "operationally_accepted").otherwise(F.col("verification_status")), "metadata": F.when(hit, merged(F.col("metadata"), mark)).otherwise(F.col("metadata")),
    }).select(objects.columns)


def append_reference(objects: DataFrame, matches: DataFrame, label: str) -> DataFrame:
    """M-07: matches (id, reference, score) are appended to texts, with their provenance."""
    m = matches.select(F.col("id").alias("_id"), F.concat(F.lit(f"\n\n{label}"), F.col("reference")).alias("_add"), F.col("score").alias("_score"))
    met = objects.join(m, objects["id"] == m["_id"], "left")
    patch = F.create_map(F.lit("reference_match"), F.round("_score", 2).cast("string"))
    return met.withColumns({c: F.concat(F.coalesce(c, F.lit("")), F.coalesce("_add", F.lit(""))) for c in ("original_text", "normalized_text")} | {"metadata": F.when(F.col("_id").isNotNull(), merged(F.col("metadata"), patch)).otherwise(F.col("metadata"))}).select(objects.columns)


def sparse_patch(current: DataFrame, changes: DataFrame, key: str, allowed: list[str]) -> DataFrame:
    """M-08: only non-null values of allowed fields change anything."""
    both = current.alias("c").join(changes.alias("n"), F.col(f"c.{key}") == F.col(f"n.{key}"), "left")
    return both.select(*(F.coalesce(f"n.{c}", f"c.{c}").alias(c) if c in allowed else F.col(f"c.{c}") for c in current.columns))


def delete_cascade(parents: DataFrame, children: dict[str, tuple[DataFrame, str]], gone: DataFrame, key: str, set_null: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """M-09, J-18: without the parents in ``gone``; children go too, or lose their link."""
    keys = gone.select(F.col(key).alias("_gone")).distinct()
    out = {"parents": parents.join(keys, F.col(key) == F.col("_gone"), "left_anti")}
    for name, (child, link) in children.items():
        if name in set_null:
            out[name] = child.join(keys, F.col(link) == F.col("_gone"), "left").withColumn(link, F.when(F.col("_gone").isNull(), F.col(link))).drop("_gone")
        else:
            out[name] = child.join(keys, F.col(link) == F.col("_gone"), "left_anti")
    return out


def unblock(sources: DataFrame, batches: DataFrame, name_like: str) -> tuple[DataFrame, DataFrame]:
    """M-10: without the stale sources of a file and without its duplicate-status batches."""
    stale = F.coalesce(F.col("file_name").like(name_like), F.lit(False))
    keys = sources.where(stale).select("source_key")
    blocked = batches.where("status = 'duplicate'").join(keys, "source_key", "left_semi").select("batch_id")
    return sources.where(~stale), batches.join(blocked, "batch_id", "left_anti")


def replay_edits(saved: DataFrame, objects: DataFrame, number: str = "article_number") -> tuple[DataFrame, DataFrame]:
    """M-12: saved human edits onto the objects of a new ingest with the same article number
    (the first id has it); the edits to apply, and those without a match."""
    first = objects.where(F.col(number).isNotNull()).groupBy(number).agg(F.min("id").alias("_new"))
    met = saved.join(first, number, "left")
    return met.where("_new is not null").withColumn("id", F.col("_new")).drop("_new"), met.where("_new is null").drop("_new")


def replace(next_table: DataFrame, path: str) -> str:
    """Writes a table's next version beside ``path`` and swaps the folders; the old version's
    readers that started before keep failing loudly rather than reading half a table."""
    spark = next_table.sparkSession
    jvm, fresh, old = spark.sparkContext._jvm, f"{path}-next-{uuid.uuid4().hex}", f"{path}-old-{uuid.uuid4().hex}"
    next_table.write.parquet(fresh)
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    store = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if store.exists(at(path)):
        store.rename(at(path), at(old))
    store.rename(at(fresh), at(path))
    store.delete(at(old), True)
    return path
