"""R: the inbox as a stream, and the life of batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from folioworks.plans.ingest import OBJECT_UPDATES, SOURCE_UPDATES, ingest
from folioworks.schemas import TABLES, TERMINAL_STATES
from folioworks.session import versions

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"
#: Bytes of a packed file, about: a Parquet file of one row group is read and decoded by one task.
PACKED_BYTES = 16 << 20
#: The tables that the stream keeps: their keys, and what an upsert of a known key updates.
KEYS = {"sources": (["source_key"], SOURCE_UPDATES), "knowledge_objects": (["id"], OBJECT_UPDATES), "ingestion_batches": (["batch_id"], [])}
STATE = tuple(KEYS)


def _changes_path(root: str, table: str) -> str:
    return f"{root}/changes/{table}"


def _base_path(root: str, table: str) -> str:
    return f"{root}/base/{table}"


def folded(changes: DataFrame, table: str) -> DataFrame:
    """A table from its changes (with their version v): of a key, columns that an upsert
    updates come from the last change and the others from the first."""
    keys, update = KEYS[table]
    pick = lambda c: (F.max_by if c in update else F.min_by)(c, "v").alias(c)
    names = [c for c in changes.columns if c != "v"]
    return changes.groupBy(*keys).agg(*(pick(c) for c in names if c not in keys)).select(names)


def current_tables(spark: SparkSession, root: str, version: int) -> dict[str, DataFrame]:
    """The tables as of a version: the newest base up to it and the changes since."""
    out = {}
    for t in STATE:
        base = max((v for v in versions(spark, _base_path(root, t)) if v <= version), default=-1)
        paths = [(f"{_base_path(root, t)}/v={base}", base)] if base >= 0 else []
        paths += [(f"{_changes_path(root, t)}/v={v}", v) for v in versions(spark, _changes_path(root, t)) if base < v <= version]
        if not paths:
            out[t] = spark.createDataFrame([], TABLES[t]())
            continue
        number = F.regexp_extract(F.col("_metadata.file_path"), r"/v=(\d+)/", 1).cast("int").alias("v")
        out[t] = folded(spark.read.schema(TABLES[t]()).parquet(*(p for p, _ in paths)).select("*", number), t)
    return out


def compact(spark: SparkSession, root: str, version: int) -> None:
    """Writes the tables as of a version as a base; readers then need only the changes since.
    Run it now and then beside the stream: it changes nothing that the stream reads."""
    for t, table in current_tables(spark, root, version).items():
        table.write.mode("overwrite").parquet(f"{_base_path(root, t)}/v={version}")


def pack(files: DataFrame, folder: str, n_bytes: int, batches: int) -> int:
    """Writes binaryFile rows packed, for ``batches`` micro-batches of as many Parquet files, and
    returns how many: at least one for every core, more where they would pass PACKED_BYTES."""
    at_once = max(files.sparkSession.sparkContext.defaultParallelism, -(-n_bytes // (batches * PACKED_BYTES)))
    files.repartition(batches * at_once, "path").write.parquet(folder)
    return at_once


def packed_files(spark: SparkSession, folder: str, at_once: int = 100) -> DataFrame:
    """A stream of files that come packed, many to a Parquet file with binaryFile's columns:
    ``at_once`` Parquet files to a micro-batch. A folder of millions of small files is slow to list."""
    return spark.readStream.schema(FILE_SCHEMA).option("maxFilesPerTrigger", at_once).parquet(folder)


def watch_inbox(spark: SparkSession, folder: str | DataFrame, root: str, checkpoint: str, every: str | None = None, compact_every: int = 20) -> StreamingQuery:
    """R-01, R-02, R-06: ingests what is new in a folder (or in a stream of binaryFile rows);
    each micro-batch appends its changes.
    Every ``compact_every`` micro-batches they are folded into a base, so that a micro-batch
    reads a base and a bounded number of changes.

    A replayed micro-batch has the same number, sees the tables as of the one before and
    writes its changes again in their place, so nothing happens twice; bad files are failed
    batches, not exceptions. Without ``every`` the stream ends when it has seen all files.
    """
    files = folder if isinstance(folder, DataFrame) else spark.readStream.format("binaryFile").schema(FILE_SCHEMA).load(folder)

    def step(batch: DataFrame, number: int) -> None:
        at = F.lit("2000-01-01").cast("timestamp") + F.make_dt_interval(F.lit(number))  # by number: replays agree
        before = current_tables(spark, root, number - 1)
        made = ingest(batch, before["sources"], before["knowledge_objects"], at)
        for t, changes in (("sources", made.sources), ("knowledge_objects", made.objects), ("ingestion_batches", made.batches)):
            columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in TABLES[t]().fields]
            changes.select(columns).write.mode("overwrite").parquet(f"{_changes_path(root, t)}/v={number}")
        if number % compact_every == compact_every - 1:
            compact(spark, root, number)

    trigger = {"availableNow": True} if every is None else {"processingTime": every}
    return files.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def batch_states(events: DataFrame, key: str = "batch_id", status: str = "status", at: str = "at") -> DataFrame:
    """R-03: the state of each batch after its events: the latest, but a terminal one sticks
    (the first terminal one, as what comes after it changes nothing). Works on tables and, in
    complete mode, on streams."""
    terminal = F.col(status).isin(*TERMINAL_STATES)
    first = F.min_by(F.when(terminal, F.col(status)), F.when(terminal, F.struct(at, status)))
    return events.groupBy(key).agg(F.coalesce(first, F.max_by(status, F.struct(at, status))).alias("status"), F.count("*").alias("n_events"))


def completion(states: DataFrame, tracked: DataFrame, key: str = "batch_id", group: str = "group_id") -> DataFrame:
    """R-04: per tracked set how many of its batches are not terminal yet, and whether it is done."""
    met = tracked.join(states, key, "left")
    waiting = F.sum(F.when(F.coalesce(F.col("status").isin(*TERMINAL_STATES), F.lit(False)), 0).otherwise(1))
    return met.groupBy(group).agg(waiting.alias("waiting")).withColumn("done", F.col("waiting") == 0)


def completed_within(batches: DataFrame, now, minutes: int, source_like: str) -> DataFrame:
    """R-05: the completions of a source within a time bound; act on them in foreachBatch."""
    return batches.where((F.col("status") == "completed") & F.col("source_key").like(source_like) & (F.col("completed_at") > now - F.expr(f"interval {minutes} minutes")))
