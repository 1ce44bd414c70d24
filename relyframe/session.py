"""Session settings, the shared scratch folder, and size-checked broadcasts."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# A side is broadcast only when its measured size stays below this.
BROADCAST_BYTES = 48 * 1024 * 1024


def build_session(app: str = "relyframe", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs expect.

    On a cluster leave ``master`` unset and pass cluster settings with
    ``spark-submit``; everything here can be overridden through ``conf``.
    """
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if master:
        b = b.master(master)
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        named = tempfile.mkdtemp(prefix="relyframe-")
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")


def settle(df: DataFrame) -> DataFrame:
    """Compute once and keep the result in the shared folder.

    Used for per-key statistics, so later stages read one fixed answer even
    when executors are lost and part of the job is run again.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _measured(df: DataFrame) -> tuple[DataFrame, int]:
    """The settled table and its size as text, observed while it is written."""
    size = Observation()
    text = F.length(F.to_json(F.struct("*")))
    kept = settle(df.observe(size, F.sum(text).alias("chars")))
    return kept, size.get["chars"] or 0


def small_rows(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    return _measured(df)[1] <= limit


def with_broadcast(small: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Settle a table and mark it for broadcast if its measured size allows.

    Beyond the bound the hint is left off: Spark then shuffles both sides and
    adaptive execution splits the skewed keys.
    """
    kept, size = _measured(small)
    return F.broadcast(kept) if size <= limit else kept


def together(*builds):
    """Run independent jobs at the same time; Spark shares the executors among them."""
    with ThreadPoolExecutor(max_workers=len(builds)) as pool:
        return [f.result() for f in [pool.submit(b) for b in builds]]


_FACTS: dict[tuple[str, str, str], tuple[tuple, DataFrame]] = {}
_LOCKS: dict[tuple[str, str, str], threading.Lock] = {}
_LOCK = threading.Lock()


def stored_files(spark: SparkSession, source: str) -> tuple:
    """What lies below a path: how many files, how many bytes, and when the newest was written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(source)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(path):
        return (0, 0, 0)
    summary, newest, todo = system.getContentSummary(path), 0, [path]
    while todo:
        for status in system.listStatus(todo.pop()):
            newest = max(newest, status.getModificationTime())
            if status.isDirectory():
                todo.append(status.getPath())
    return summary.getFileCount(), summary.getLength(), newest


def fact_table(spark: SparkSession, source: str, name: str, build) -> DataFrame:
    """A result many reports read (scored reports, violations, drift rows).

    It is computed once per application and state of the input's files, and
    stored in the shared folder, as a scheduled job would store it for the
    dashboards. When files are added or rewritten it is computed anew.
    """
    key = (spark.sparkContext.applicationId, source, name)
    with _LOCK:
        mine = _LOCKS.setdefault(key, threading.Lock())
    with mine:
        files = stored_files(spark, source)
        if key not in _FACTS or _FACTS[key][0] != files:
            _FACTS[key] = (files, settle(build()))
        return _FACTS[key][1]


def forget_facts() -> None:
    _FACTS.clear()
