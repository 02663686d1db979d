"""Sessions, and the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

#: The session's bound for what Spark sends to Python at once, and its bytes where none is named.
SENT, SENT_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 1 << 22

#: The folder chosen for an application that names none.
_OWN: dict[str, str] = {}


def local_session(cpus: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benches on one machine."""
    builder = SparkSession.builder.master(f"local[{cpus}]").config(map=SETTINGS)
    builder = builder.config("spark.sql.shuffle.partitions", str(partitions)).config("spark.ui.enabled", "false")
    spark = builder.config("spark.driver.memory", memory).config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def bound_batches(spark: SparkSession) -> None:
    """Where the session names no bound, Spark sends about SENT_BYTES at once instead of up to 10,000
    texts: both sides hold a whole batch, and the JVM's buffer doubles as it grows."""
    if spark.conf.get(SENT, None) is None:
        spark.conf.set(SENT, str(SENT_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where that is unset, a folder of
    this machine on a local master, else one in the warehouse, which a cluster shares."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or _OWN.get(context.applicationId)
    if not named:
        on_one_machine = context.master.startswith("local") and not context.master.startswith("local-cluster")
        named = tempfile.mkdtemp(prefix="spark-") if on_one_machine else spark.conf.get("spark.sql.warehouse.dir") + "/_shared"
        _OWN[context.applicationId] = named
        context.setCheckpointDir(named)
    return named.rstrip("/")


def staged(df: DataFrame, name: str, rows: int = 0) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder, with at most ``rows`` rows a file unless that
    is 0, and read it again: the plan is cut there, and a lost executor costs no more than the
    tasks that it ran. The table goes when the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    (df.write.option("maxRecordsPerFile", rows) if rows else df.write).parquet(path)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def versions(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the v=<n> folders under ``path`` that are whole."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(at):
        return []
    names = [f.getPath() for f in store.listStatus(at)]
    return sorted(int(p.getName()[2:]) for p in names if p.getName().startswith("v=") and store.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def forget_last_commit(spark: SparkSession, checkpoint: str) -> int | None:
    """Takes the last micro-batch's commit from a stream's log, as a driver does that is lost
    before it commits: the stream runs that micro-batch again. Returns its number."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/commits")
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    numbers = [int(f.getPath().getName()) for f in store.listStatus(at) if f.getPath().getName().isdigit()] if store.exists(at) else []
    if not numbers:
        return None
    store.delete(jvm.org.apache.hadoop.fs.Path(at, str(max(numbers))), False)
    return max(numbers)
