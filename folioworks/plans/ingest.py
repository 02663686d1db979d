"""Files to knowledge objects: from the inbox to the tables' next versions.

Decoded documents are staged in the shared folder, as sources, objects, batches and rejects
all derive from them; everything after that is one lazy plan a table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from folioworks.functions.text import batch_id, normalize_text, object_id
from folioworks.operators import classify
from folioworks.operators.matching import find_duplicates, known_duplicates
from folioworks.operators.tables import insert_absent, upsert
from folioworks.session import staged
from folioworks.sources import readers

OBJECT_UPDATES = ["original_text", "normalized_text", "source_key", "metadata", "updated_at"]
SOURCE_UPDATES = ["title", "file_name", "sha256", "metadata", "updated_at"]
#: Hex digits of a batch's id: all files of a run have one time, and no two of them may share an id.
BATCH_DIGITS = 32


@dataclass
class Ingested:
    """The changes that a set of files makes."""

    sources: DataFrame
    objects: DataFrame
    batches: DataFrame
    rejects: DataFrame


def canonical_files(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """binaryFile rows to canonical documents with their sidecar's fields, and rejects
    (path, reason)."""
    side = readers.sidecars(files)
    known, unknown = readers.supported(readers.named_files(files))
    read = readers.with_blocks(known.withColumn("sha256", F.sha2("content", 256)))
    made = staged(readers.canonical(read, F.col("sha256")).drop("blocks"), "canonical")  # files are read and decoded once
    docs, empty = readers.empty_bodies(made)
    met = docs.join(side, docs["path"] == side["doc_path"], "left").drop("doc_path")
    return met, unknown.select("path", "reason").unionByName(empty.select("path", "reason"))


def _first(rows: DataFrame, key: str) -> DataFrame:
    """One row a key: that of the file which comes first by _order, so that a retry picks the same."""
    rest = [c for c in rows.columns if c not in (key, "_order")]
    first = rows.groupBy(key).agg(F.min_by(F.struct(*rest), "_order").alias("_row")).select(key, "_row.*")
    return first.select([c for c in rows.columns if c != "_order"])


def ingest(files: DataFrame, sources: DataFrame, objects: DataFrame, run_at: Column) -> Ingested:
    """Changes to the tables from files: duplicates (of a file of this run that comes first, or
    of a known source of the same branch and topic) make a batch row and nothing else."""
    docs, rejects = canonical_files(files)
    docs, unknown_status = classify.with_status(docs)
    rejects = rejects.unionByName(unknown_status.select("path", F.lit("unknown verification status").alias("reason")))
    docs = docs.withColumn("batch_id", batch_id(run_at, F.col("path"), BATCH_DIGITS)).withColumn("key", F.coalesce("source_key", F.concat(F.lit("SRC-"), F.substring("content_sha256", 1, 16))))
    told = find_duplicates(docs, "content_sha256", ["branch", "topic"], ["modified", "path"], "batch_id")
    known = known_duplicates(told, sources, objects).select("batch_id", F.col("first_batch_id").alias("known_batch")).distinct()
    told = told.join(known, "batch_id", "left").withColumn("duplicate_of", F.coalesce("known_batch", F.when(F.col("is_duplicate"), F.col("first_key"))))
    fresh = told.where("duplicate_of is null")
    title = F.coalesce("title", F.regexp_replace("file_name", r"\.[^.]+$", ""))
    parts = classify.sections(fresh.withColumn("object_type", F.lit(None).cast("string")).withColumn("title", title), key="batch_id", text="body")
    fields = fresh.select("batch_id", "key", "branch", "topic", "subtopic", "micro_issue", "verification_status", "id_prefix", "modified", "path")
    met = parts.join(fields, "batch_id")
    kind, status = F.col("object_type"), F.col("verification_status")
    made = met.select(
        object_id(kind, F.col("local_id"), F.col("body"), F.col("id_prefix")).alias("id"), "object_type", "branch", "topic", "subtopic", "micro_issue", "title", F.col("body").alias("original_text"),
        normalize_text(F.col("body")).alias("normalized_text"), F.col("key").alias("source_key"), "verification_status", F.lit(None).cast("string").alias("temporal_scope"),
        F.create_map(F.lit("batch_id"), F.col("batch_id"), F.lit("local_id"), F.col("local_id")).alias("metadata"), run_at.alias("created_at"), run_at.alias("updated_at"),
        classify.authority_status(kind, status).alias("authority_status"), classify.citable(kind, status).alias("usable_as_citation"), F.struct("modified", "path").alias("_order"),
    )
    # Equal sections of one source are one object. They are counted without their texts.
    holder = made.groupBy("id").agg(F.min_by(F.col("metadata")["batch_id"], "_order").alias("batch_id"))
    counts = holder.groupBy("batch_id").agg(F.count("*").cast("int").alias("object_count"))
    made = _first(made, "id")
    new_sources = fresh.select(
        F.col("key").alias("source_key"), "source_type", title.alias("title"), "file_name", "sha256", "verification_status", F.create_map(F.lit("format"), F.col("source_format")).alias("metadata"),
        run_at.alias("created_at"), run_at.alias("updated_at"), "content_sha256", "branch", "topic", F.col("batch_id").alias("first_batch_id"), F.struct("modified", "path").alias("_order"),
    )
    new_sources = _first(new_sources, "source_key")
    batches = told.join(counts, "batch_id", "left").select(
        "batch_id", F.col("key").alias("source_key"), F.when(F.col("duplicate_of").isNotNull(), "duplicate").otherwise("completed").alias("status"), F.coalesce("object_count", F.lit(0)).alias("object_count"),
        F.lit(0).alias("relationship_count"), F.when(F.col("duplicate_of").isNotNull(), F.create_map(F.lit("duplicate_of"), F.col("duplicate_of"))).alias("report"), run_at.alias("started_at"), run_at.alias("completed_at"),
    )
    failed = rejects.select(
        batch_id(run_at, F.col("path"), BATCH_DIGITS).alias("batch_id"), F.lit(None).cast("string").alias("source_key"), F.lit("failed").alias("status"), F.lit(0).alias("object_count"), F.lit(0).alias("relationship_count"),
        F.create_map(F.lit("reason"), F.col("reason")).alias("report"), run_at.alias("started_at"), run_at.alias("completed_at"),
    )
    return Ingested(new_sources, made, batches.unionByName(failed), rejects)


def next_tables(current: dict[str, DataFrame], made: Ingested) -> dict[str, DataFrame]:
    """M-01 to M-03: the tables' next versions."""
    return {
        "sources": upsert(current["sources"], made.sources, ["source_key"], SOURCE_UPDATES),
        "knowledge_objects": upsert(current["knowledge_objects"], made.objects, ["id"], OBJECT_UPDATES),
        "ingestion_batches": insert_absent(current["ingestion_batches"], made.batches, ["batch_id"]),
    }
