"""Session helpers.

On a cluster the session comes from the platform; we only read its settings.
Local defaults (used by tests and ``bench.py``) are applied only when a new
local session is built here.
"""

from __future__ import annotations

import os
import tempfile
from contextlib import contextmanager
from functools import wraps

from pyspark.sql import SparkSession

# Settings every session should carry, cluster or local.  AQE re-plans joins
# and coalesces/splits shuffle partitions from runtime statistics.
_ALWAYS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}

_LOCAL = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.memory": "16g",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app: str = "stockroom", checkpoint_dir: str | None = None) -> SparkSession:
    """Return the active session, or build a local one for tests/bench.

    Local defaults (UI off, driver memory, a scratch ``spark.checkpoint.dir``)
    apply only to an explicit ``local[...]`` master; otherwise only the AQE
    settings are added and the cluster's own configuration is kept.
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        for k, v in _ALWAYS.items():
            active.conf.set(k, v)
        return active
    builder = SparkSession.builder.appName(app)
    local = bool(master) and master.startswith("local")
    if master:
        builder = builder.master(master)
    for k, v in ({**_LOCAL, **_ALWAYS} if local else _ALWAYS).items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if checkpoint_dir or local:       # a cluster names its shared folder in its own config
        builder = builder.config("spark.checkpoint.dir",
                                 checkpoint_dir or tempfile.mkdtemp(prefix="stockroom-ckpt-"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster-shared folder for written intermediate tables.

    Read from ``spark.checkpoint.dir``.  Only a local session without it (tests)
    gets a fresh scratch folder; on a cluster an unset value is an error, never
    a machine-local folder.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set: name a folder shared by the cluster")
    if not path:
        global _LOCAL_DIR
        if _LOCAL_DIR is None:
            _LOCAL_DIR = tempfile.mkdtemp(prefix="stockroom-ckpt-")
            spark.sparkContext.setCheckpointDir(_LOCAL_DIR)
        path = _LOCAL_DIR
    return path.rstrip("/")


_LOCAL_DIR: str | None = None


def scratch_path(spark: SparkSession, name: str, lasting: bool = False) -> str:
    """A unique sub-path of the shared folder for one written intermediate, or for a
    ``lasting`` result."""
    path = os.path.join(shared_dir(spark), f"{name}-{os.getpid()}-{next(_counter)}")
    if not lasting:
        _WRITTEN.append(path)
    return path


_WRITTEN: list[str] = []        # intermediates of this session that have not been removed


class Intermediates:
    """Removes the intermediates that are written inside a ``with`` block when it ends,
    but those the kept DataFrames read.

    For jobs whose result is written by then: what the steps below wrote is of no more
    use.  An operator that returns a lazy DataFrame leaves its intermediates to the
    caller's block; ``Intermediates(spark).clear()`` removes all that are left.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.before, self.kept = spark, set(_WRITTEN), []

    def keep(self, df):
        self.kept.append(df)
        return df

    def __enter__(self) -> "Intermediates":
        return self

    def __exit__(self, failed, *_) -> None:
        if not failed:
            self.clear([p for p in _WRITTEN if p not in self.before])

    def clear(self, paths: list[str] | None = None) -> None:
        read = [f for df in self.kept for f in df.inputFiles()]
        for path in list(_WRITTEN if paths is None else paths):
            if not any(f"/{os.path.basename(path)}/" in f for f in read):
                remove(self.spark, path)
                _WRITTEN.remove(path)


TASK_BYTES = 16 << 20       # what one task of a large job reads, of files or of a shuffle


@contextmanager
def small_tasks(spark: SparkSession):
    """Tasks of the writes in the block read at most TASK_BYTES of files, and about as much
    of a shuffle.

    Spark's own sizes (128 and 64 MB) give a job of about a gigabyte hardly more tasks than
    a small cluster has cores, so most cores wait for the last ones; and where rows are
    nearly distinct, what a task of that size groups does not fit its share of memory and
    is sorted and spilled.
    """
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes")
    before = {name: spark.conf.get(name) for name in names}
    to_bytes = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes     # 134217728b
    for name, size in before.items():
        spark.conf.set(name, str(min(to_bytes(size), TASK_BYTES)))      # a smaller one is kept
    try:
        yield
    finally:
        for name, size in before.items():
            spark.conf.set(name, size)


def in_small_tasks(job):
    """A job, a function of the session and others, whose writes run in ``small_tasks``."""
    @wraps(job)
    def run(spark: SparkSession, *args, **options):
        with small_tasks(spark):
            return job(spark, *args, **options)
    return run


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library has written, in whatever store it lies."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _count():
    n = 0
    while True:
        n += 1
        yield n


_counter = _count()


def scale_settings(input_bytes: int, target_bytes: int = 512 << 20) -> dict[str, str]:
    """Session settings sized for ``input_bytes`` of parquet input.

    Scan splits and AQE's target partition size are ``target_bytes``; the
    initial shuffle partition count is the input over that size, which
    AQE then coalesces per stage from measured sizes.  Apply with
    ``spark.conf.set`` on the cluster session before running large jobs.
    """
    parts = max(1, -(-int(input_bytes) // target_bytes))
    return {
        "spark.sql.files.maxPartitionBytes": str(target_bytes),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_bytes),
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(parts),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(2 * target_bytes),
    }


def bucket_count(table_bytes: int, bucket_bytes: int = 1 << 30) -> int:
    """Buckets for a stored table so that one bucket is about ``bucket_bytes``."""
    return max(1, -(-int(table_bytes) // bucket_bytes))
