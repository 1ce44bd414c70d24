"""Alert lifecycle over deliveries: resumption, expiry, illegal and late changes, merging of old rows."""

import time
from datetime import datetime, timedelta

from relyframe.session import scratch
from relyframe.streaming import lifecycle, monitors

CHANGE = "alert_id long, status string, ts timestamp, event_id long"


def at(minute):
    return datetime(2024, 3, 9, 10) + timedelta(minutes=minute)


class Feed:
    def __init__(self, spark):
        self.spark, self.path, self.folder, self.n = spark, scratch(spark, "feed"), scratch(spark, "alerts"), 0

    def arrive(self, rows, **options):
        self.n += 1
        self.spark.createDataFrame(rows, CHANGE).coalesce(1).write.parquet(f"{self.path}/{self.n}")
        lifecycle.start(self.spark.readStream.schema(CHANGE).parquet(f"{self.path}/*"), self.folder, **options).awaitTermination(120)
        return {r.alert_id: (r.status, r.changes, r.times_opened, r.illegal, r.lives) for r in lifecycle.states(self.spark, self.folder).collect()}

    def held(self):
        return {r.alert_id for r in lifecycle.stored_states(self.spark, self.folder).collect()}


def test_states_resume_and_side_rows(spark):
    feed = Feed(spark)
    assert feed.arrive([(1, "OPEN", at(0), 1), (1, "RESOLVED", at(5), 2), (2, "ACKNOWLEDGED", at(1), 3)]) == {1: ("RESOLVED", 2, 1, 0, 1), 2: ("ACKNOWLEDGED", 1, 0, 1, 1)}
    # Started again on its folder it goes on: a late change counts but does not win, looking at a resolved alert is illegal.
    got = feed.arrive([(2, "OPEN", at(0), 9), (1, "ACKNOWLEDGED", at(7), 10), (3, "OPEN", at(8), 11)])
    assert got == {1: ("ACKNOWLEDGED", 3, 1, 1, 1), 2: ("ACKNOWLEDGED", 2, 1, 1, 1), 3: ("OPEN", 1, 1, 0, 1)}
    assert {(r.alert_id, r.before, r.status) for r in lifecycle.side_rows(spark, feed.folder, "illegal").collect()} == {(2, None, "ACKNOWLEDGED"), (1, "RESOLVED", "ACKNOWLEDGED")}
    assert [(r.alert_id, r.event_id) for r in lifecycle.side_rows(spark, feed.folder, "late").collect()] == [(2, 9)]
    assert feed.held() == {1, 2, 3}


def test_resolved_alerts_expire_and_old_rows_are_merged(spark, monkeypatch):
    monkeypatch.setattr(lifecycle, "COMPACT", 2)
    feed = Feed(spark)
    feed.arrive([(1, "OPEN", at(0), 1), (1, "RESOLVED", at(1), 2), (2, "OPEN", at(1), 3)], expiry_ms=1)
    time.sleep(0.1)
    feed.arrive([(3, "OPEN", at(2), 4)], expiry_ms=1)
    assert feed.held() == {2, 3}
    assert [(r.alert_id, r.status) for r in lifecycle.side_rows(spark, feed.folder, "expired").collect()] == [(1, "RESOLVED")]
    # A change after that opens a new life; the figures add up over both, before and after rows are merged.
    got = feed.arrive([(1, "OPEN", at(9), 5)], expiry_ms=1)
    assert got == {1: ("OPEN", 3, 2, 0, 2), 2: ("OPEN", 1, 1, 0, 1), 3: ("OPEN", 1, 1, 0, 1)}
    for n in range(3):
        got = feed.arrive([(2, "ACKNOWLEDGED", at(20 + n), 30 + n)], expiry_ms=1)
    assert got[2] == ("ACKNOWLEDGED", 4, 1, 0, 1) and feed.held() == {1, 2, 3}
    assert spark.read.parquet(f"{feed.folder}/summary/run=0").count() == 3


EVENT = "event_id long, ts timestamp, user_id long, event_type string, value double"


def test_windows_close_and_late_rows_correct_them(spark, monkeypatch):
    """The state holds the windows of the last days only, whatever came before; figures are those of all rows."""
    monkeypatch.setattr(monitors, "COMPACT", 3)
    feed, folder, every, sizes = scratch(spark, "feed"), scratch(spark, "watch"), [], []
    watch = monitors.histograms()
    for n in range(10):
        day = [(100 * n + h, datetime(2024, 3, 1 + n, h, 30), 1, "view", 1.0) for h in range(0, 24, 6)]
        if n == 7:
            day.append((999, datetime(2024, 3, 1, 6, 45), 1, "view", 5.0))
        every += day
        spark.createDataFrame(day, EVENT).coalesce(1).write.parquet(f"{feed}/{n}")
        monitors.start(monitors.event_stream(spark, f"{feed}/*", EVENT), watch, folder).awaitTermination(120)
        sizes.append(monitors.open_windows(spark, folder).count())
    assert max(sizes[3:]) == min(sizes[3:]) <= 12
    got = {str(r.window_start): (r.n, r.total) for r in monitors.figures(spark, watch, folder).collect()}
    assert len(got) == 40 and got["2024-03-01 06:00:00"] == (2, 6.0) and sum(n for n, _ in got.values()) == len(every)
    assert [(r.event_id, r.batch) for r in monitors.late_rows(spark, folder).collect()] == [(999, 7)]
