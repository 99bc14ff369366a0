"""Streaming operators that keep state for each key and act when time passes: liveness, gates that expire, caps on what runs.

They run with `applyInPandasWithState` on RocksDB. In event time, rows wait in the state until the watermark has passed them
and are then taken in the order of their times, so results don't depend on how rows were dealt into batches, as long as
none is later than the delay; rows that are later are dropped before they get here. A lane's time is out at the next
moment at which something may happen to one of its keys, and the watermark is the clock that it is compared with. In processing time, rows are
taken as they come and the clock is the machine's.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.scratch import fresh_path
from . import streams

STALE_SECONDS = 45
#: Lanes that the keys of a stream are dealt into. A stream's state is kept by lane, so it can't go on with another number.
LANES = 2048
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def _stores(spark: SparkSession) -> Iterator[None]:
    """A stream takes its session's settings when it starts; the session itself keeps its own."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


class Timed:
    """Takes the rows of each key in the order of time and number, and lets time pass between them.

    Subclasses say what a row does (`take`), what has happened by a time at which no row came (`pass_to`) and when
    something may happen next (`next_at`), on `held`, the key's numbers and texts by name. Keys are dealt into `LANES`
    lanes, and a lane's keys lie in one state, in arrays side by side: a call to Python costs some milliseconds, and so
    is made for many keys at once.
    """

    fields = ""  # the fields of `held`
    columns: list[str] = []
    event_time = True

    @property
    def names(self) -> list[str]:
        return [f.split()[0] for f in self.fields.split(", ")]

    @property
    def kept(self) -> str:
        """The schema of a lane's state: the keys with what they hold, and in event time the rows that wait."""
        held = [f"{name} array<{kind}>" for name, kind in (f.split() for f in self.fields.split(", "))]
        return ", ".join(["keys array<string>", *held, "of array<string>", "at array<long>", "n array<long>", "kind array<string>"])

    def __call__(self, lane: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        clock = state.getCurrentWatermarkMs() if self.event_time else state.getCurrentProcessingTimeMs()
        names = self.names
        kept = state.get if state.exists else ([],) * (len(names) + 5)
        held = {key: dict(zip(names, values)) for key, *values in zip(*kept[: len(names) + 1])}
        rows: dict[str | None, list[tuple[int, int, str]]] = {}
        for key, *row in zip(*kept[len(names) + 1 :]):
            rows.setdefault(key, []).append(tuple(row))
        for f in frames:
            for key, at, n, kind in zip(*(f[c].tolist() for c in ("key", "at", "n", "kind"))):
                rows.setdefault(key, []).append((int(at) if self.event_time else clock, int(n), kind))
                held.setdefault(key, dict.fromkeys(names))
        out, left, next_ = [], [], None
        for key, own in held.items():
            come = sorted(rows[key]) if self.event_time and key in rows else rows.get(key, [])
            due = [r for r in come if r[0] <= clock]
            for at, n, kind in due:
                out += [(key, *r) for r in self.pass_to(own, at)]
                out += [(key, *r) for r in self.take(own, at, n, kind)]
            out += [(key, *r) for r in self.pass_to(own, clock)]
            left += [(key, *r) for r in come[len(due) :]]
            for t in (come[len(due)][0] if len(due) < len(come) else None, self.next_at(own)):
                next_ = t if next_ is None or t is not None and t < next_ else next_
        columns = [[own[name] for own in held.values()] for name in names]
        state.update((list(held), *columns, *([r[i] for r in left] for i in range(4))))
        if next_ is not None and self.event_time:  # it is later than the clock; time is out once the clock has passed what is set
            state.setTimeoutTimestamp(max(next_ - 1, 1))
        elif next_ is not None:
            state.setTimeoutDuration(max(next_ - 1 - clock, 1))
        if out:
            yield pd.DataFrame(out, columns=self.columns)


class Watchdog(Timed):
    """A link is stale once it has been silent for longer than `most` milliseconds, and is said to be so once. Any row is a
    signal that counts the time anew, but only a message proves that the link is alive again."""

    fields = "last long, degraded boolean"
    columns = ["key", "state", "at_ms"]

    def __init__(self, most: int, event_time: bool) -> None:
        self.most, self.event_time = most, event_time

    def pass_to(self, held: dict, at: int) -> list[tuple]:
        if held["last"] is None or held["degraded"] or at - held["last"] <= self.most:
            return []
        held["degraded"] = True
        return [("stale", held["last"] + self.most)]

    def take(self, held: dict, at: int, n: int, kind: str) -> list[tuple]:
        held["last"] = at
        if not held["degraded"] or kind != "message":
            return []
        held["degraded"] = False
        return [("recovered", at)]

    def next_at(self, held: dict) -> int | None:
        return None if held["last"] is None or held["degraded"] else held["last"] + self.most + 1


class Gate(Timed):
    """A gate that is opened waits for a decision for `most` milliseconds, then the system rejects it. The first to decide
    wins; a decision after that, or of a gate that isn't open, is refused and changes nothing."""

    fields = "opened long, decided boolean"
    columns = ["key", "status", "reviewer", "at_ms"]

    def __init__(self, most: int, event_time: bool) -> None:
        self.most, self.event_time = most, event_time

    def pass_to(self, held: dict, at: int) -> list[tuple]:
        if held["opened"] is None or held["decided"] or at - held["opened"] <= self.most:
            return []
        held["decided"] = True
        return [("REJECTED", "system", held["opened"] + self.most)]

    def take(self, held: dict, at: int, n: int, kind: str) -> list[tuple]:
        if kind == "opened":
            held["opened"] = at if held["opened"] is None else held["opened"]
            return []
        if held["opened"] is None or held["decided"]:
            return [("REFUSED", "user", at)]
        held["decided"] = True
        return [(kind, "user", at)]

    def next_at(self, held: dict) -> int | None:
        return None if held["opened"] is None or held["decided"] else held["opened"] + self.most + 1


class Admission(Timed):
    """Requests of a scope are let in as long as fewer than `most` of those let in before are still running; others are
    refused and never run. A request says for how many milliseconds it runs."""

    fields = "running string"
    columns = ["key", "n", "admitted", "running", "at_ms"]

    def __init__(self, most: int, event_time: bool) -> None:
        self.most, self.event_time = most, event_time

    def pass_to(self, held: dict, at: int) -> list[tuple]:
        held["running"] = ",".join(end for end in (held["running"] or "").split(",") if end and int(end) > at)
        return []

    def take(self, held: dict, at: int, n: int, kind: str) -> list[tuple]:
        ends = [end for end in held["running"].split(",") if end]
        admitted = len(ends) < self.most
        if admitted:
            held["running"] = ",".join([*ends, str(at + int(kind))])
        return [(n, admitted, len(ends) + admitted, at)]

    def next_at(self, held: dict) -> int | None:
        return None


def _timed(events: DataFrame, key: str, ts: str, order: str, kind: Column, processor: Timed, delay: str, out: str) -> DataFrame:
    at = F.col(ts).cast("timestamp")
    rows = events.select(F.col(key).alias("key"), at.alias("ts"), F.unix_millis(at).alias("at"), F.col(order).cast("long").alias("n"), kind.alias("kind"))
    if processor.event_time:
        rows = rows.withWatermark("ts", delay)
    kind_of_key = rows.schema["key"].dataType
    rows = rows.withColumn("lane", F.pmod(F.xxhash64("key"), F.lit(LANES))).withColumn("key", F.col("key").cast("string"))  # a null among numbers would make them floats in pandas
    timeout = GroupStateTimeout.EventTimeTimeout if processor.event_time else GroupStateTimeout.ProcessingTimeTimeout
    found = rows.groupBy("lane").applyInPandasWithState(lambda lane, frames, state: processor(lane, frames, state), f"key string, {out}", processor.kept, "append", timeout)
    return found.withColumn("key", F.col("key").cast(kind_of_key))


def liveness(events: DataFrame, key: str, ts: str, order: str, message: Column, seconds: int = STALE_SECONDS, delay: str = "0 seconds", event_time: bool = True) -> DataFrame:
    """(key, state, at_ms): when links went stale, and when a message proved that they were alive again.

    Rows that aren't messages are signals of the link itself, such as a subscription that was made anew.
    """
    kind = F.when(F.coalesce(message, F.lit(False)), "message").otherwise("signal")
    return _timed(events, key, ts, order, kind, Watchdog(seconds * 1000, event_time), delay, "state string, at_ms long")


def gates(events: DataFrame, key: str, ts: str, order: str, kind: Column, seconds: int, delay: str = "0 seconds", event_time: bool = True) -> DataFrame:
    """(key, status, reviewer, at_ms): how gates were decided, and which decisions were refused.

    kind: opened, or the status that a decision asks for. The time of a decision counts, not when it came: one that was made
    in time and comes within the delay wins over the timeout.
    """
    return _timed(events, key, ts, order, kind, Gate(seconds * 1000, event_time), delay, "status string, reviewer string, at_ms long")


def admissions(events: DataFrame, key: str, ts: str, order: str, milliseconds: Column, most: int, delay: str = "0 seconds", event_time: bool = True) -> DataFrame:
    """(key, n, admitted, running, at_ms): which requests of each scope are let in under a cap of `most` at once, and how many then run."""
    kind = F.coalesce(milliseconds, F.lit(0)).cast("long").cast("string")
    return _timed(events, key, ts, order, kind, Admission(most, event_time), delay, "n long, admitted boolean, running int, at_ms long")


def landed(timed: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """What a stream of these operators wrote, with its state in the folder."""
    with _stores(timed.sparkSession):
        return streams.landed(timed, name, folder=folder or fresh_path(timed.sparkSession, f"stream-{name}"))


def start(timed: DataFrame, folder: str, every: str):
    """Starts such a stream with a processing-time trigger; its rows are the table below `rows` of the folder."""
    rows = streams.Landing(timed.sparkSession, f"{folder}/rows")
    with _stores(timed.sparkSession):
        return streams.start(timed, folder, rows.write, every=every)
