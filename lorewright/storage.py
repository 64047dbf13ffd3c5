"""Written intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import math
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, list[str]] = {}


#: Shuffle files of a write go when the write is done: its rows stand in the shared folder.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Of files, what a task reads inside in_tasks().
SPLIT = "8m"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset a folder of this machine, which only a local master may use (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = _written.setdefault("own", [])
        if not own:
            own.append(tempfile.mkdtemp(prefix="lorewright-"))
        found = f"file://{own[0]}"
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/lorewright/{name}-{uuid.uuid4().hex}"
    _written.setdefault("paths", []).append(path)
    return path


@contextlib.contextmanager
def _conf(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def in_tasks(spark: SparkSession, tasks: int | None, broadcast: bool = True) -> contextlib.AbstractContextManager[None]:
    """Exchanges of what is written inside have that many tasks, none of which are put together (None: as the session says).

    The session's number stays as it is while tables grow, and Spark puts tasks together by compressed bytes.  Files are read
    in small splits for the same reason: of repeated values a large one holds many rows.
    broadcast: whether Spark may bring a side that it takes for small to the driver, as loops would again and again.
    """
    wanted = {"spark.sql.shuffle.partitions": str(tasks), "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.maxPartitionBytes": SPLIT}
    unsent = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    return _conf(spark, (wanted if tasks else {}) | ({} if broadcast else unsent))


def materialize(df: DataFrame, name: str, by: str | None = None, batch_bytes: int | None = None) -> DataFrame:
    """df written to the shared folder and read back: lineage ends there, and any executor can read it.

    by: a column of a few values, each of which gets files of its own, so that a filter on it reads no others.
    batch_bytes: an Arrow batch for Python ends with the row that passes it.  Without it Spark's own bounds hold, 10,000
    rows and 64 MB; the JVM and Python hold a batch at a time.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    wanted = {CLEANUP: "true", "spark.sql.maxConcurrentOutputFileWriters": "8"} | ({BATCH_BYTES: str(batch_bytes)} if batch_bytes else {})
    with _conf(spark, wanted):
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._scratch = path
    return found


def tasks_for(df: DataFrame, rows: int) -> int:
    """How many tasks df needs so that each gets about that many rows."""
    return max(1, math.ceil(df.count() / rows))


def spread(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """df dealt out so that a task gets about that many rows (by: equal ones together), however few files hold them.

    Files of repeated values hold many rows in few bytes, and Spark sizes tasks by bytes.
    """
    return df.repartition(tasks_for(df, rows), *by)


def release(*tables: DataFrame | None) -> None:
    """Delete tables that materialize() has returned and that nothing will read again."""
    for df in tables:
        path = getattr(df, "_scratch", None)
        if path in _written.get("paths", []):
            _written["paths"].remove(path)
            _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def drop_scratch(spark: SparkSession) -> None:
    """Delete what materialize() has written in this process."""
    for path in _written.pop("paths", []):
        _delete(spark, path)


@atexit.register
def _at_exit() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and _written.get("paths"):
        try:
            drop_scratch(spark)
        except Exception:  # the JVM may be gone already
            pass
