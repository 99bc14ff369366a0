"""Timers over several micro-batches and restarts: the clock is moved by rows of other keys."""

import time

import pytest
from pyspark.sql import functions as F

from plumbline.streaming import streams, timers

KIND = "n long, key string, at timestamp, kind string"


@pytest.fixture
def feed(spark, tmp_path):
    class Feed:
        folder, path = str(tmp_path / "out"), str(tmp_path / "in")

        def add(self, *rows):
            data = [(n, k, s, kind) for n, (k, s, kind) in enumerate(rows, len(rows) * 100)]
            made = spark.createDataFrame(data, "n long, key string, s long, kind string").select("n", "key", F.timestamp_seconds(F.col("s") + 1_700_000_000).alias("at"), "kind")
            made.coalesce(1).write.mode("append").parquet(self.path)
            return self

        def stream(self):
            return streams.source(spark, self.path, 1)

    return Feed()


def seen(df):
    return sorted((r["key"], *[r[c] for c in df.columns if c not in ("key", "at_ms")], r["at_ms"] // 1000 - 1_700_000_000) for r in df.collect())


def alive(feed, delay="0 seconds"):
    return seen(timers.landed(timers.liveness(feed.stream(), "key", "at", "n", F.col("kind") == "message", 45, delay), "w", feed.folder))


def decided(feed, delay="0 seconds"):
    return seen(timers.landed(timers.gates(feed.stream(), "key", "at", "n", F.col("kind"), 60, delay), "g", feed.folder))


def test_a_silent_link_goes_stale_and_comes_back_by_a_message_only(feed):
    feed.add(("a", 0, "message"), ("b", 0, "message")).add(("b", 40, "message"))
    assert alive(feed) == []  # forty seconds aren't enough
    feed.add(("b", 60, "message"))
    assert alive(feed) == [("a", "stale", 45)]  # after a restart, by the clock of b
    feed.add(("a", 70, "subscribed"), ("b", 80, "message"))
    assert alive(feed) == [("a", "stale", 45)]  # a signal isn't a proof
    feed.add(("b", 100, "message")).add(("b", 140, "message"))
    assert alive(feed) == [("a", "stale", 45)]  # it is said once
    feed.add(("a", 150, "message"), ("b", 155, "message")).add(("b", 190, "message")).add(("b", 210, "message"))
    assert alive(feed) == [("a", "recovered", 150), ("a", "stale", 45), ("a", "stale", 195)]


def test_rows_out_of_order_within_the_delay(feed):
    feed.add(("a", 0, "message"), ("a", 80, "message")).add(("a", 40, "message")).add(("a", 400, "message")).add(("a", 420, "message"))
    assert alive(feed, "60 seconds") == [("a", "stale", 125)]  # the one at 40 came after the one at 80; 400 isn't past yet


def test_just_as_long_as_allowed_is_not_stale(feed):
    feed.add(("a", 0, "message"), ("a", 45, "message"), ("a", 90, "message"), ("z", 91, "message"))
    assert alive(feed) == []


def test_a_decision_in_time_wins_and_a_later_one_is_refused(feed):
    feed.add(("g", 0, "opened"), ("h", 0, "opened"), ("i", 5, "opened")).add(("g", 30, "APPROVED"), ("z", 50, "opened"))
    assert decided(feed) == [("g", "APPROVED", "user", 30)]
    feed.add(("g", 55, "REJECTED"), ("z", 62, "APPROVED"))  # too late for g, which is decided
    assert decided(feed) == [("g", "APPROVED", "user", 30), ("g", "REFUSED", "user", 55), ("h", "REJECTED", "system", 60), ("z", "APPROVED", "user", 62)]
    feed.add(("h", 70, "APPROVED"), ("i", 64, "REJECTED"), ("z", 90, "opened"))  # h is expired, i just isn't
    assert decided(feed) == [
        ("g", "APPROVED", "user", 30), ("g", "REFUSED", "user", 55), ("h", "REFUSED", "user", 70), ("h", "REJECTED", "system", 60),
        ("i", "REJECTED", "user", 64), ("z", "APPROVED", "user", 62),
    ]


def test_a_decision_made_in_time_that_comes_late_wins_within_the_delay(feed):
    feed.add(("g", 0, "opened"), ("z", 80, "opened")).add(("g", 59, "APPROVED"), ("z", 100, "APPROVED")).add(("z", 300, "opened")).add(("z", 400, "opened"))
    assert decided(feed, "30 seconds") == [("g", "APPROVED", "user", 59), ("z", "APPROVED", "user", 100)]


def test_a_decision_of_no_gate_and_one_at_the_deadline(feed):
    feed.add(("n", 1, "APPROVED"), ("m", 0, "opened"), ("m", 60, "APPROVED"), ("o", 0, "opened"), ("o", 61, "APPROVED"), ("z", 200, "opened"))
    assert decided(feed) == [("m", "APPROVED", "user", 60), ("n", "REFUSED", "user", 1), ("o", "REFUSED", "user", 61), ("o", "REJECTED", "system", 60)]


def test_requests_over_the_cap_are_refused(feed):
    """Over batches and a restart; one that ends at the moment another comes makes room."""
    ask = lambda: [r[2:] for r in seen(timers.landed(timers.admissions(feed.stream(), "key", "at", "n", F.col("kind").cast("long"), 2), "a", feed.folder))]
    feed.add(("a", 0, "10000"), ("a", 1, "30000"), ("a", 2, "5000"), ("b", 2, "0")).add(("a", 9, "1"), ("z", 9, "1"))
    assert sorted(ask(), key=lambda r: r[2]) == [(True, 1, 0), (True, 2, 1), (False, 2, 2), (True, 1, 2), (False, 2, 9), (True, 1, 9)]
    feed.add(("a", 10, "60000"), ("a", 11, "1")).add(("z", 40, "1"))
    assert sorted(ask(), key=lambda r: r[2])[6:] == [(True, 2, 10), (False, 2, 11), (True, 1, 40)]


def test_the_machines_clock(spark, feed):
    feed.add(("a", 0, "message"))
    watched = timers.liveness(feed.stream(), "key", "at", "n", F.col("kind") == "message", 2, event_time=False)
    query = timers.start(watched, feed.folder, "500 milliseconds")
    rows = streams.Landing(spark, f"{feed.folder}/rows")
    said = lambda: [r["state"] for r in rows.read(watched.schema).orderBy("at_ms").collect()]
    try:
        until = time.time() + 60
        while said() != ["stale"] and time.time() < until:
            time.sleep(0.5)
        assert said() == ["stale"]
        feed.add(("a", 0, "message"))
        while said()[:2] != ["stale", "recovered"] and time.time() < until:
            time.sleep(0.5)
        assert said()[:2] == ["stale", "recovered"]
    finally:
        query.stop()


def test_many_keys_take_few_calls(spark, tmp_path, monkeypatch):
    """Keys share lanes, so the calls to Python and the states are no more than there are lanes; a null key is one of its own."""
    rows = spark.range(3000).select(F.col("id").alias("n"), F.when(F.col("id") > 0, F.col("id")).alias("key"), F.timestamp_seconds(F.lit(1_700_000_000)).alias("at"), F.lit("opened").alias("kind"))
    late = spark.range(1).select((F.col("id") + 3000).alias("n"), (F.col("id") + 3000).alias("key"), F.timestamp_seconds(F.lit(1_700_000_061)).alias("at"), F.lit("opened").alias("kind"))
    rows.union(late).coalesce(1).write.parquet(str(tmp_path / "in"))
    monkeypatch.setattr(timers, "LANES", 8)
    stream = timers.gates(streams.source(spark, str(tmp_path / "in")), "key", "at", "n", F.col("kind"), 60)
    found = timers.landed(stream, "many", str(tmp_path / "out"))
    assert found.schema["key"].dataType.simpleString() == "bigint"
    assert sorted((r["key"] or 0, r["status"], r["reviewer"], r["at_ms"]) for r in found.collect()) == [(i, "REJECTED", "system", 1_700_000_060_000) for i in range(3000)]
    states = spark.read.format("statestore").load(str(tmp_path / "out" / "state"))
    assert states.count() == 8
