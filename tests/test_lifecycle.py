"""Keyed state over micro-batches: late ends, repeats, replays; output follows the changes."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from folioworks.session import forget_last_commit, versions
from folioworks.streaming import inbox, lifecycle

START = datetime(2024, 1, 1)
SCHEMA = "batch_id long, status string, at timestamp"
#: Micro-batches of (batch, status, minute).
STEPS = [
    [(1, "started", 0), (2, "started", 1), (3, "started", 2), (4, None, 3)],
    [(1, "completed", 10), (2, "failed", 20), (2, "completed", 15), (3, "running", 1)],
    [(1, "failed", 30), (2, "duplicate", 5), (5, "completed", 7), (5, "completed", 7)],
]


def put(spark, folder, rows, n):
    spark.createDataFrame([(b, s, START + timedelta(minutes=m)) for b, s, m in rows], SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/events")


def events(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/events")


def test_states_and_completion_equal_the_batch_forms(spark, tmp_path):
    tracked = spark.createDataFrame([(1, 7), (2, 7), (3, 8), (5, 8), (9, 9)], "batch_id long, group_id long")
    at = str(tmp_path)
    for n, rows in enumerate(STEPS):
        put(spark, at, rows, n)
        lifecycle.run_life(events(spark, at), at, f"{at}/log", tracked)
    assert forget_last_commit(spark, f"{at}/log") == 2
    lifecycle.run_life(events(spark, at), at, f"{at}/log", tracked)  # the last micro-batch once more
    assert versions(spark, f"{at}/changes") == [0, 1, 2]
    every = spark.read.schema(SCHEMA).parquet(f"{at}/events")
    known = sorted(map(tuple, inbox.batch_states(every.where("status is not null")).select("batch_id", "status").collect()))
    got = lifecycle.states(spark, at)
    assert sorted(map(tuple, got.where("status is not null").select("batch_id", "status").collect())) == known
    assert {r.batch_id: r.n_events for r in got.collect()} == {1: 3, 2: 4, 3: 2, 4: 1, 5: 2}
    wanted = sorted(map(tuple, inbox.completion(inbox.batch_states(every), tracked).collect()))
    assert sorted(map(tuple, lifecycle.done(spark, at, tracked).collect())) == wanted


def test_output_follows_the_changes(spark, tmp_path):
    at = str(tmp_path)
    put(spark, at, [(i, "started", i) for i in range(200)], 0)
    lifecycle.run_life(events(spark, at), at, f"{at}/log")
    put(spark, at, [(3, "completed", 300), (4, "running", 300)], 1)
    lifecycle.run_life(events(spark, at), at, f"{at}/log")
    sizes = [spark.read.parquet(f"{at}/changes/v={v}").count() for v in versions(spark, f"{at}/changes")]
    assert sizes == [200, 2]
    assert lifecycle.states(spark, at).where(F.col("status") == "started").count() == 198


def test_nothing_streamed_yet(spark, tmp_path):
    tracked = spark.createDataFrame([(1, 7)], "batch_id long, group_id long")
    assert lifecycle.states(spark, str(tmp_path)).collect() == []
    assert [tuple(r) for r in lifecycle.done(spark, str(tmp_path), tracked).collect()] == [(7, 1, False)]


class Held:
    """A state of one key that counts what is asked of it."""

    def __init__(self):
        self.value, self.calls = None, []

    def get(self):
        self.calls.append("get")
        return self.value

    def update(self, value):
        self.calls.append("update")
        self.value = value


def test_a_key_costs_one_look_and_one_change_of_the_state(spark):
    life = lifecycle.Life()
    life.life = Held()
    steps = [[(1, "started", 5), (1, None, 9), (1, "running", None)], [(1, "failed", 8), (1, "completed", 7)], [(1, "running", 99)]]
    got = [tuple(r) for rows in steps for r in life.handleInputRows((1,), iter(rows), None)]
    assert got == [(1, "started", 3, False), (1, "completed", 5, True), (1, "completed", 6, False)]
    assert life.life.calls == ["get", "update"] * 3
