"""Alert lifecycle as keyed state: one state per alert in the state store, with expiry of resolved alerts.

An alert's events arrive in any order. Its state holds the newest status and
counts; a resolved alert's state lives on for ``expiry`` and then goes by itself, so
the store holds open alerts and recently resolved ones only. Every
micro-batch writes one row per alert it touched, and every COMPACT batches the
rows are merged to the last one per life of an alert.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from relyframe.session import scratch

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EXPIRY_MS = 30 * 24 * 3600 * 1000
COMPACT = 16
# Which status may follow which; an alert opens first, and a resolved one can only open again.
LEGAL = {None: ("OPEN",), "OPEN": ("OPEN", "ACKNOWLEDGED", "RESOLVED"), "ACKNOWLEDGED": ("OPEN", "ACKNOWLEDGED", "RESOLVED"), "RESOLVED": ("OPEN", "RESOLVED")}
STATE = "status string, ts timestamp, event_id long, changes long, times_opened long, illegal long, life long"
OUTPUT = "kind string, alert_id long, life long, status string, before string, ts timestamp, event_id long, changes long, times_opened long, illegal long"


def follow(expiry_ms: int):
    """Rows of kind ``state`` (newest figures of an alert's life), ``illegal`` (a status that may not follow), ``late`` (an event older than the newest) and ``expired``."""

    def run(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        alert = key[0]
        status, ts, last, changes, opened, illegal, life = state.getOption or (None, None, None, 0, 0, 0, None)
        if state.hasTimedOut:
            state.remove()
            yield _frame([("expired", alert, life, status, None, ts, last, changes, opened, illegal)])
            return
        at, aside = (pd.Timestamp(ts), last) if life is not None else None, []
        for part in rows:
            for r in part.sort_values(["ts", "event_id"]).itertuples(index=False):
                life = r.event_id if life is None else life
                changes, opened = changes + 1, opened + (r.status == "OPEN")
                if at is not None and (r.ts, r.event_id) < at:
                    aside.append(("late", r.status, status, r.ts, r.event_id))
                    continue
                if r.status not in LEGAL[status]:
                    illegal += 1
                    aside.append(("illegal", r.status, status, r.ts, r.event_id))
                status, at = r.status, (r.ts, r.event_id)
        state.update((status, at[0].to_pydatetime(), int(at[1]), int(changes), int(opened), int(illegal), int(life)))
        if status == "RESOLVED":
            state.setTimeoutDuration(expiry_ms)
        out = [("state", alert, life, status, None, *at, changes, opened, illegal)]
        yield _frame(out + [(kind, alert, life, new, old, when, event, changes, opened, illegal) for kind, new, old, when, event in aside])

    return run


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in OUTPUT.split(", ")])


def statuses(events: DataFrame) -> DataFrame:
    """Alert events: an error opens the alert of its user, looking acknowledges it, anything else resolves it."""
    kind = F.col("event_type")
    status = F.when(kind == "error", "OPEN").when(kind.isin("view", "click"), "ACKNOWLEDGED").otherwise("RESOLVED")
    return events.select(F.col("user_id").alias("alert_id"), status.alias("status"), "ts", "event_id")


def start(changes: DataFrame, folder: str, expiry_ms: int = EXPIRY_MS, trigger: dict | None = None, provider: str | None = None) -> StreamingQuery:
    """Follow the changes (alert_id, status, ts, event_id) below ``folder``; started again there, it goes on with its state.

    ``provider`` names the state store (ROCKS keeps it on the executors' disks
    and checkpoints changes only; choose it where open alerts outgrow the
    memory); None leaves the session's.
    """
    spark = changes.sparkSession
    # With timeouts by the clock, batches without data would follow each other for ever.
    settings = {"spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    if provider:
        settings |= {"spark.sql.streaming.stateStore.providerClass": provider, "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"}
    lives = changes.groupBy("alert_id").applyInPandasWithState(follow(expiry_ms), OUTPUT, STATE, "update", GroupStateTimeout.ProcessingTimeTimeout)

    def keep(batch: DataFrame, n: int) -> None:
        batch.withColumn("batch", F.lit(n).cast("long")).write.mode("overwrite").partitionBy("kind").parquet(f"{folder}/rows/run={n // COMPACT}/part={n % COMPACT}")
        if n % COMPACT == COMPACT - 1:
            # The run's rows become one row per life; readers take a run's summary, if there is one, instead of its parts.
            _newest(_rows(spark, folder, f"run={n // COMPACT}").where("kind = 'state'")).write.mode("overwrite").parquet(f"{folder}/summary/run={n // COMPACT}")

    writer = lives.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/log")
    # A query keeps the settings that it is started with.
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        return writer.trigger(**(trigger or {"availableNow": True})).start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _rows(spark: SparkSession, folder: str, below: str = "*") -> DataFrame:
    schema = OUTPUT.replace("kind string, ", "") + ", batch long, kind string"
    return spark.read.schema(schema).option("basePath", f"{folder}/rows").parquet(f"{folder}/rows/{below}/*")


def _newest(rows: DataFrame) -> DataFrame:
    last = F.max_by(F.struct("status", "ts", "event_id", "changes", "times_opened", "illegal", "batch"), F.col("batch"))
    return rows.groupBy("alert_id", "life").agg(last.alias("s")).select("alert_id", "life", "s.*")


def _runs(spark: SparkSession, folder: str) -> set[str]:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return {s.getPath().getName() for s in system.listStatus(path)} if system.exists(path) else set()


def states(spark: SparkSession, folder: str) -> DataFrame:
    """Rows (alert_id, status, changes, times_opened, illegal, lives): newest status and sums over all lives of each alert."""
    done, every = _runs(spark, f"{folder}/summary"), _runs(spark, f"{folder}/rows")
    fields = ["alert_id", "life", "status", "ts", "event_id", "changes", "times_opened", "illegal", "batch"]
    parts = [_rows(spark, folder, run).where("kind = 'state'").select(*fields) for run in sorted(every - done)]
    if done:
        parts.append(spark.read.parquet(*[f"{folder}/summary/{run}" for run in sorted(done)]).select(*fields))
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    newest = F.max_by("status", F.struct("ts", "event_id")).alias("status")
    return _newest(whole).groupBy("alert_id").agg(
        newest, *[F.sum(c).cast("long").alias(c) for c in ("changes", "times_opened", "illegal")], F.count("*").alias("lives")
    )


def side_rows(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """The events put aside as ``illegal`` or ``late``: alert_id, life, status, before, ts, event_id, batch."""
    return _rows(spark, folder).where(F.col("kind") == kind).select("alert_id", "life", "status", "before", "ts", "event_id", "batch")


def stored_states(spark: SparkSession, folder: str) -> DataFrame:
    """What the state store holds now: alerts that are not resolved, and resolved ones that have not expired."""
    return spark.read.format("statestore").option("path", f"{folder}/log").load().select("key.*", "value.groupState.*", "value.timeoutTimestamp")


def run(changes: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Work off what is available and return the states."""
    folder = folder or scratch(changes.sparkSession, "alerts")
    start(changes, folder, **options).awaitTermination()
    return states(changes.sparkSession, folder)
