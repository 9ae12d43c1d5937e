"""Session settings, reliable staging and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows a dimension may have before it is joined by shuffle instead of broadcast.
# Callers project the dimension to its key and a few short attributes first, so
# this keeps a broadcast in the tens of megabytes.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20

# Rows that one task of a shuffle groups or sorts, about.
TASK_ROWS = 500_000

# Paths of the stored copies, by session.
STAGED: dict[SparkSession, list[str]] = {}


def build_session(app_name: str = "basketwise", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library is tuned for; `conf` wins."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    On a cluster it must come from `spark.checkpoint.dir`; only a local session
    without that setting gets a folder of its own.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="basketwise-")
    context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def stage(df: DataFrame) -> DataFrame:
    """Write `df` once to the checkpoint folder and read it back.

    For frames that several later passes need. Unlike a cache, the copy is
    columnar, is pruned on reading and survives the loss of executors.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    STAGED.setdefault(df.sparkSession, []).append(path)
    copy = df.sparkSession.read.schema(df.schema).parquet(path)
    copy.staged_path = path
    return copy


def release(*copies: DataFrame) -> None:
    """Delete copies made by `stage` that no later step reads; frames on them stop working."""
    for copy in copies:
        held = STAGED.get(copy.sparkSession, [])
        if copy.staged_path in held:
            held.remove(copy.staged_path)
            _delete(copy.sparkSession, [copy.staged_path])


def stage_alone(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """Stage the frame that `make` returns and delete every other copy that was made on the way."""
    before = set(STAGED.get(spark, []))
    copy = stage(make())
    held = STAGED[spark]
    extra = [path for path in held if path not in before and path != copy.staged_path]
    held[:] = [path for path in held if path not in extra]
    _delete(spark, extra)
    return copy


@contextmanager
def staging(spark: SparkSession):
    """Delete the copies that `stage` makes inside the block at its end, also after an error."""
    before = set(STAGED.get(spark, []))
    try:
        yield
    finally:
        held = STAGED.get(spark, [])
        own = [path for path in held if path not in before]
        held[:] = [path for path in held if path in before]
        _delete(spark, own)


def drop_staged(spark: SparkSession) -> int:
    """Delete the copies `stage` made in this session; frames on them stop working.

    For the end of a job, when its results are stored. Returns how many there were.
    """
    paths = STAGED.pop(spark, [])
    _delete(spark, paths)
    return len(paths)


def _delete(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        target, files = hadoop_path(spark, path)
        files.delete(target, True)


def hadoop_path(spark: SparkSession, path: str):
    """A path and the file system it lies on, for any storage Spark can write to."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def fits_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether `df` has at most `max_rows` rows and `max_bytes` bytes of values."""
    widths = [F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) for c in df.columns]
    row = sum(widths, F.lit(8 * len(widths)))
    found = df.select(row.cast("long").alias("bytes")).agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).first()
    return found["n"] <= max_rows and (found["bytes"] or 0) <= max_bytes


def dealt_by_rows(df: DataFrame, rows: int, *keys: str, task_rows: int = TASK_ROWS) -> DataFrame:
    """Deal `rows` rows out by key in as many partitions as keep a task at about `task_rows`.

    A number of partitions that is given is not reduced when the query runs, so what a task
    holds does not grow with the input. Few rows get at least a partition for each core.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, -(-rows // task_rows)), *keys)


def spread(scan: DataFrame, *keys: str) -> DataFrame:
    """Deal a scan of fewer partitions than cores out to all cores by its row key.

    A file of one row group is read by one task, which would do all later work up to
    the next shuffle. A scan of many files stays as it is, without a shuffle.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores, *keys) if scan.rdd.getNumPartitions() < cores else scan
