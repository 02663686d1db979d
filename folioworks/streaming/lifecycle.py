"""The life of batches as keyed state: what changed goes out, not the whole result again."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from folioworks.schemas import TERMINAL_STATES
from folioworks.session import versions

CHANGE = "batch_id long, status string, n_events long, turned boolean"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER_KEY = "spark.sql.streaming.stateStore.providerClass"


class Life(StatefulProcessor):
    """R-03 for one batch: the first terminal event decides (the earliest one, should it come
    late), before one the latest event. Each micro-batch that has events of the batch puts
    out one row: its status, the number of its events, and whether it has just become terminal.
    Events come as rows (batch_id, status, at: microseconds): most batches have few in a micro-batch."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.life = handle.getValueState("life", "last_at long, last string, final_at long, final string, n long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self.life.get()  # null for a new batch
        last, final, n = ((held[0], held[1]) if held[0] is not None else None, (held[2], held[3]) if held[2] is not None else None, held[4]) if held else (None, None, 0)
        was = final is not None
        for _, status, at in rows:
            n += 1
            if at is None or status is None:
                continue
            found = (at, status)
            last = found if last is None else max(last, found)
            if status in TERMINAL_STATES:
                final = found if final is None else min(final, found)
        self.life.update((*(last or (None, None)), *(final or (None, None)), n))
        status = final[1] if final else last[1] if last else None
        yield Row(batch_id=key[0], status=status, n_events=n, turned=final is not None and not was)

    def close(self) -> None:
        pass


def _at(root: str, name: str, number: int | None = None) -> str:
    return f"{root}/{name}" + ("" if number is None else f"/v={number}")


def run_life(events: DataFrame, root: str, checkpoint: str, tracked: DataFrame | None = None) -> None:
    """R-03, R-04 on a stream of (batch_id, status, at): until all input is seen, every
    micro-batch appends the batches that changed and, for ``tracked`` (batch_id, group_id), how
    many of each group became terminal. A replayed micro-batch has the same number and the
    same state before it, and writes the same again in its place."""
    spark = events.sparkSession
    before = spark.conf.get(PROVIDER_KEY)
    spark.conf.set(PROVIDER_KEY, PROVIDER)  # keyed state of this kind needs it
    try:
        rows = events.select("batch_id", "status", F.unix_micros("at").alias("at"))
        changed = rows.groupBy("batch_id").transformWithState(Life(), CHANGE, "Update", "None")

        def write(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(_at(root, "changes", number))
            if tracked is not None:
                done = batch.sparkSession.read.parquet(_at(root, "changes", number)).where("turned").join(tracked, "batch_id")
                done.groupBy("group_id").agg(F.count("*").alias("n_done")).write.mode("overwrite").parquet(_at(root, "done", number))

        stream = changed.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
        stream.trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(PROVIDER_KEY, before)


def _every(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    found = versions(spark, _at(root, name))
    if not found:
        return spark.createDataFrame([], schema + ", v int")
    number = F.regexp_extract(F.col("_metadata.file_path"), r"/v=(\d+)/", 1).cast("int").alias("v")
    return spark.read.schema(schema).parquet(*(_at(root, name, v) for v in found)).select("*", number)


def states(spark: SparkSession, root: str) -> DataFrame:
    """R-03: each batch's state after all micro-batches: its last change."""
    every = _every(spark, root, "changes", CHANGE)
    return every.groupBy("batch_id").agg(F.max_by("status", "v").alias("status"), F.max_by("n_events", "v").alias("n_events"))


def done(spark: SparkSession, root: str, tracked: DataFrame) -> DataFrame:
    """R-04: per tracked group how many of its batches are not terminal yet, and whether it is
    done: what is tracked less what the micro-batches have counted."""
    counted = _every(spark, root, "done", "group_id long, n_done long").groupBy("group_id").agg(F.sum("n_done").alias("_done"))
    sizes = tracked.groupBy("group_id").agg(F.count("*").alias("_all"))
    waiting = F.col("_all") - F.coalesce("_done", F.lit(0))
    return sizes.join(counted, "group_id", "left").select("group_id", waiting.alias("waiting"), (waiting == 0).alias("done"))
