"""Continuous monitors as Structured Streaming queries over the event table.

A monitor keeps mergeable counts and sums per window. Open windows are its
state: every micro-batch takes those of the batch before, adds its own rows
and lets go of the windows that end before the watermark, ``lateness`` behind
the newest event. Closed windows are written once. Rows that arrive for a closed
window are no loss: they are written as corrections, and rows behind the
watermark are also listed in a side table. A batch that is repeated replaces what it wrote,
old batches are merged run by run, and work per batch depends on the open
windows and the batch alone. Readers merge closed windows, corrections and the
open state, so a figure is always that of all rows so far.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from relyframe.functions import scores
from relyframe.operators.relational import compare
from relyframe.session import scratch, with_broadcast

LATENESS = "2 days"
# Batches whose closed windows are merged into one run.
COMPACT = 16
# Upper bounds of the latency histogram.
BUCKETS = [5.0, 10.0, 25.0, 50.0, 100.0, 250.0]


def event_stream(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """Events as they arrive below the path; the clock column becomes a zoned timestamp."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


@dataclass(frozen=True)
class Monitor:
    """Parts per window of a micro-batch, how parts add up, the length of a window, and what is shown of the sums."""

    keys: list[str]
    part: Callable[[DataFrame], DataFrame]
    combine: Callable[[DataFrame], DataFrame]
    size: str
    show: Callable[[DataFrame], DataFrame] = lambda sums: sums


def start(events: DataFrame, monitor: Monitor, folder: str, lateness: str = LATENESS, trigger: dict | None = None) -> StreamingQuery:
    """Run a monitor below ``folder``, which holds its state: started again there, it goes on where it stopped.

    ``trigger`` is what Spark's trigger() takes; by default what is available
    is worked off and the query ends.
    """
    spark = events.sparkSession
    back = F.expr(f"INTERVAL {lateness}")

    def keep(batch: DataFrame, n: int) -> None:
        batch.persist()
        seen = _clock(spark, folder, n - 1)
        before = F.lit(seen[1]).cast("timestamp") if seen else F.lit(None).cast("timestamp")
        late = batch.where(F.col("ts") < before - back)
        newest = batch.agg(F.max("ts").alias("ts"), F.count_if(F.col("ts") < before - back).alias("late")).first()
        if newest["late"]:
            late.write.mode("overwrite").parquet(f"{folder}/late/batch={n}")
        now = max([x for x in (seen[1] if seen else None, newest["ts"]) if x is not None], default=None)
        ends = F.col("window_start") + F.expr(f"INTERVAL {monitor.size}")
        closed = lambda clock: F.coalesce(ends <= clock - back, F.lit(False))
        parts = monitor.part(batch)
        fixes = parts.where(closed(before)).withColumn("state", F.lit("fixed"))
        fresh = parts.where(~closed(before))
        if seen:
            fresh = fresh.unionByName(_rows(spark, folder, seen[0]).where("state = 'open'").select(*fresh.columns))
        state = F.when(closed(F.lit(now).cast("timestamp")), "closed").otherwise("open")
        whole = monitor.combine(fresh).withColumn("state", state).unionByName(fixes)
        whole.coalesce(max(1, spark.sparkContext.defaultParallelism)).write.mode("overwrite").partitionBy("state").parquet(_at(folder, n))
        if n % COMPACT == COMPACT - 1:
            run = spark.read.option("basePath", folder).parquet(f"{folder}/rows/run={n // COMPACT}").where("state <> 'open'").select(*parts.columns)
            monitor.combine(run).write.mode("overwrite").parquet(f"{folder}/merged/run={n // COMPACT}")
        _tick(spark, folder, n, now)
        batch.unpersist()

    writer = events.writeStream.foreachBatch(keep).option("checkpointLocation", f"{folder}/log")
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def _files(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _names(spark: SparkSession, folder: str) -> list[str]:
    system, path = _files(spark, folder)
    return sorted(s.getPath().getName() for s in system.listStatus(path)) if system.exists(path) else []


def _at(folder: str, n: int) -> str:
    return f"{folder}/rows/run={n // COMPACT}/batch={n}"


def _rows(spark: SparkSession, folder: str, n: int) -> DataFrame:
    return spark.read.option("basePath", _at(folder, n)).parquet(_at(folder, n))


def _tick(spark: SparkSession, folder: str, n: int, newest: datetime | None) -> None:
    """Note that batch n is complete, and the newest event time so far, as the name of an empty file; only the last few stay."""
    micros = "none" if newest is None else str(int(newest.timestamp() * 1_000_000))
    system, path = _files(spark, f"{folder}/clock/{n:012d}-{micros}")
    system.create(path, True).close()
    for name in _names(spark, f"{folder}/clock")[:-3]:
        old = int(name.split("-")[0])
        # The open windows of an old batch went on into the next ones.
        for gone in (f"{folder}/clock/{name}", f"{_at(folder, old)}/state=open"):
            fs, at = _files(spark, gone)
            fs.delete(at, True)


def _clock(spark: SparkSession, folder: str, upto: int | None = None) -> tuple[int, datetime | None] | None:
    """The last complete batch (up to ``upto``) and the newest event time by then."""
    noted = [name.split("-") for name in _names(spark, f"{folder}/clock") if not name.startswith(".")]
    known = [(int(n), None if m == "none" else datetime.fromtimestamp(int(m) / 1_000_000)) for n, m in noted if upto is None or int(n) <= upto]
    return max(known, key=lambda k: k[0]) if known else None


def sums(spark: SparkSession, monitor: Monitor, folder: str) -> DataFrame:
    """Counts and sums of every window over everything that has arrived."""
    last = _clock(spark, folder)[0]
    merged = set(_names(spark, f"{folder}/merged"))
    parts = []
    for run in range(last // COMPACT + 1):
        if f"run={run}" in merged:
            parts.append(spark.read.parquet(f"{folder}/merged/run={run}"))
        else:
            paths = [_at(folder, n) for n in range(run * COMPACT, min(last, run * COMPACT + COMPACT - 1) + 1)]
            parts.append(spark.read.option("basePath", folder).parquet(*paths).where("state <> 'open'"))
    parts.append(_rows(spark, folder, last).where("state = 'open'"))
    fields = [c for c in parts[-1].columns if c != "state"]
    return monitor.combine(reduce(DataFrame.unionByName, [p.select(*fields) for p in parts]))


def figures(spark: SparkSession, monitor: Monitor, folder: str) -> DataFrame:
    """The monitor's figures over everything that has arrived."""
    return monitor.show(sums(spark, monitor, folder))


def open_windows(spark: SparkSession, folder: str) -> DataFrame:
    """The state: windows that still wait for rows."""
    return _rows(spark, folder, _clock(spark, folder)[0]).where("state = 'open'")


def late_rows(spark: SparkSession, folder: str) -> DataFrame | None:
    """Late rows with the batch that brought them; None if there were none."""
    return spark.read.option("basePath", f"{folder}/late").parquet(f"{folder}/late") if _names(spark, f"{folder}/late") else None


def run(events: DataFrame, monitor: Monitor, folder: str | None = None, **options) -> DataFrame:
    """Work off what is available and return the figures."""
    folder = folder or scratch(events.sparkSession, "monitor")
    start(events, monitor, folder, **options).awaitTermination()
    return figures(events.sparkSession, monitor, folder)


def run_append(df: DataFrame, folder: str | None = None, trigger: dict | None = None) -> DataFrame:
    """Run a stateless stream into an append-only table below ``folder``."""
    spark = df.sparkSession
    folder = folder or scratch(spark, "append")
    writer = df.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/log")
    writer.trigger(**(trigger or {"availableNow": True})).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{folder}/rows")


def _sums(keys: list[str], names: list[str]) -> Callable[[DataFrame], DataFrame]:
    return lambda parts: parts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in names])


def rates(size: str = "1 hour", slide: str = "15 minutes", seconds: float = 3600.0) -> Monitor:
    """Events per second by type over a sliding window."""
    keys = ["window_start", "event_type"]

    def part(batch: DataFrame) -> DataFrame:
        agg = batch.groupBy(F.window("ts", size, slide).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
        return agg.select(F.col("w.start").alias("window_start"), "event_type", "n")

    return Monitor(keys, part, _sums(keys, ["n"]), size, lambda sums: sums.withColumn("rate", F.col("n") / F.lit(seconds)))


def histograms(size: str = "1 hour") -> Monitor:
    """Count, sum and cumulative buckets of the value, by type and window."""
    keys, bounds = ["window_start", "event_type"], {f"le_{int(b)}": b for b in BUCKETS}

    def part(batch: DataFrame) -> DataFrame:
        agg = batch.groupBy(F.window("ts", size).alias("w"), "event_type").agg(
            F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), *[F.count_if(F.col("value") <= b).alias(c) for c, b in bounds.items()]
        )
        return agg.select(F.col("w.start").alias("window_start"), *[c for c in agg.columns if c != "w"])

    return Monitor(keys, part, _sums(keys, ["n", "total", *bounds]), size)


def quality_alerts(rules: DataFrame, size: str = "1 hour") -> Monitor:
    """Error share and mean value per window against the rules; breaches of the figures so far."""
    keys = ["window_start"]

    def part(batch: DataFrame) -> DataFrame:
        agg = batch.groupBy(F.window("ts", size).alias("w")).agg(
            F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"), F.sum("value").alias("total"), F.count("value").alias("filled")
        )
        return agg.select(F.col("w.start").alias("window_start"), "n", "errors", "total", "filled")

    def show(s: DataFrame) -> DataFrame:
        pair = F.array(
            F.struct(F.lit("error_pct").alias("metric"), (F.col("errors") * 100.0 / F.col("n")).alias("value")),
            F.struct(F.lit("mean_value").alias("metric"), (F.col("total") / F.nullif(F.col("filled"), F.lit(0))).alias("value")),
        )
        long = s.select("window_start", F.explode(pair).alias("m")).select("window_start", "m.*")
        hit = compare(F.col("value"), F.col("op"), F.col("threshold"))
        return long.join(with_broadcast(rules), "metric").where(hit).select("window_start", "rule_id", "metric", "value")

    return Monitor(keys, part, _sums(keys, ["n", "errors", "total", "filled"]), size, show)


def freshness(events: DataFrame) -> DataFrame:
    """Delay and status of each record against its expected time."""
    shift = (F.col("user_id") % 60 - (F.col("user_id") % 4) * 30).cast("int")
    df = events.withColumn("expected_time", F.date_trunc("hour", "ts") + F.make_dt_interval(mins=shift))
    df = df.withColumn("delay_minutes", scores.delay_minutes("ts", "expected_time"))
    return df.select("event_id", "delay_minutes", scores.freshness_status(F.col("delay_minutes")).alias("status"))
