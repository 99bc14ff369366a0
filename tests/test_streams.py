"""Streams over several micro-batches, restarts, retries and acknowledgement."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from plumbline.streaming import streams
from plumbline.functions.tables import Landing

KIND = "id long, key string, at timestamp, text string"


@pytest.fixture
def feed(spark, tmp_path):
    """A folder of files, one for each micro-batch; add() puts more there."""

    class Feed:
        folder, path = str(tmp_path / "out"), str(tmp_path / "in")

        def add(self, *rows):
            data = [(i, k, f"2024-01-01 00:{m:02}:00", t) for i, k, m, t in rows]
            spark.createDataFrame(data, "id long, key string, at string, text string").withColumn("at", F.col("at").cast("timestamp")).coalesce(1).write.mode("append").parquet(self.path)
            return self

        def stream(self):
            return streams.source(spark, self.path, 1)

    return Feed()


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_a_stream_goes_on_where_it_ended(spark, feed):
    feed.add((1, "a", 1, "x")).add((2, "a", 2, "x"))
    assert ids(streams.landed(feed.stream(), "s", folder=feed.folder)) == [1, 2]
    assert streams.batches(spark, f"{feed.folder}/rows") == [0, 1]
    assert ids(streams.landed(feed.stream(), "s", folder=feed.folder)) == [1, 2]
    feed.add((3, "b", 3, "x"))
    assert ids(streams.landed(feed.stream(), "s", folder=feed.folder)) == [1, 2, 3]
    assert streams.batches(spark, f"{feed.folder}/rows") == [0, 1, 2]


def test_a_batch_that_is_delivered_again_replaces_itself(spark, feed):
    feed.add((1, "a", 1, "x"), (2, "a", 2, "x"))

    def failing(batch, number):
        batch.write.mode("overwrite").parquet(f"{feed.folder}/rows/batch={number}")
        raise RuntimeError("after the write")

    with pytest.raises(PySparkException):
        streams.run(feed.stream(), feed.folder, failing)
    assert ids(streams.landed(feed.stream(), "s", folder=feed.folder)) == [1, 2]


def test_bad_rows(feed):
    feed.add((1, "a", 1, "7"), (2, "a", 2, "seven")).add((3, "a", 3, None), (4, "a", 4, "8"))
    good, bad = streams.good_and_bad(feed.stream(), F.col("text").try_cast("int").isNotNull(), "s", feed.folder)
    assert (ids(good), ids(bad)) == ([1, 4], [2, 3]) and good.columns == ["id", "key", "at", "text"]


def test_acknowledgement(feed):
    feed.add((1, "open", 1, "1")).add((2, "done", 2, "no number")).add((3, "open", 3, "bad"))
    number = lambda b: b.select("id", F.col("text").cast("int").alias("n"))
    ask = lambda make: streams.acknowledged(feed.stream(), make, F.col("key") == "done", "s", feed.folder, 2)
    with pytest.raises(PySparkException):
        ask(number)  # row 3 fails and isn't ended: its batch stays
    assert ids(ask(lambda b: b.select("id", F.col("text").try_cast("int").alias("n")))) == [1, 3]  # row 2 is ended and was acknowledged


def test_fan_out_loses_nothing(feed):
    feed.add((1, "a", 1, "x")).add((2, "b", 2, "x")).add((3, "a", 3, "x"))
    calls = []

    def flaky(batch):
        calls.append(1)
        return batch.select("no_such_column" if len(calls) == 2 else "id")

    sinks = {"all": lambda b: b.select("id"), "flaky": flaky, "broken": lambda b: b.select("nothing")}
    tables, left = streams.fan_out(feed.stream(), sinks, "s", feed.folder)
    assert ids(tables["all"]) == ids(tables["flaky"]) == [1, 2, 3]
    assert "broken" not in tables and left == {"broken": [0, 1, 2]}
    feed.add((4, "a", 4, "x"))
    tables, left = streams.fan_out(feed.stream(), sinks | {"broken": lambda b: b.select("id")}, "s", feed.folder)
    assert ids(tables["broken"]) == ids(tables["all"]) == [1, 2, 3, 4] and not left


def test_fan_out_loses_nothing_of_a_sink_that_fails_in_a_task(spark, feed):
    """Half a batch may be there when the fault comes: it is neither read nor taken for the whole."""
    feed.add(*[(i, "a", 1, "x") for i in range(10)]).add(*[(i, "a", 2, "x") for i in range(10, 20)]).add(*[(i, "a", 3, "x") for i in range(20, 30)])
    calls, broken = [], [True]

    def task(batch):  # fails on the executor, on its first batch
        calls.append(1)
        return batch.repartition(3).select(F.when(F.lit(len(calls) == 1) & (F.col("id") == 3), F.raise_error(F.lit("disk")).cast("long")).otherwise(F.col("id")).alias("id"))

    def code(batch):  # fails in Python
        if broken[0]:
            raise ValueError("listener")
        return batch.select("id")

    def worker(batch):  # fails in a Python worker
        now = broken[0]

        def each(pieces):
            for x in pieces:
                if now:
                    raise OSError("socket")
                yield x[["id"]]

        return batch.mapInPandas(each, "id long")

    sinks = {"task": task, "code": code, "worker": worker, "all": lambda b: b.select("id")}
    tables, left = streams.fan_out(feed.stream(), sinks, "s", feed.folder)
    assert ids(tables["task"]) == ids(tables["all"]) == list(range(30)) and left == {"code": [0, 1, 2], "worker": [0, 1, 2]}
    broken[0] = False
    tables, left = streams.fan_out(feed.stream(), sinks, "s", feed.folder)
    assert all(ids(tables[s]) == list(range(30)) for s in sinks) and not left


def test_fan_out_when_every_batch_of_every_sink_fails(feed):
    feed.add((1, "a", 1, "x"))
    fails = {"s": lambda b: b.select(F.raise_error(F.lit("no")).alias("id"))}
    assert streams.fan_out(feed.stream(), fails, "s", feed.folder) == ({}, {"s": [0]})


def test_heartbeats_reach_no_sink(feed):
    feed.add((1, "a", 1, "x"), (2, "a", 1, "heartbeat"), (3, "a", 1, None))
    tables, _ = streams.fan_out(feed.stream(), {"all": lambda b: b.select("id")}, "s", feed.folder, F.col("text") == "heartbeat")
    assert ids(tables["all"]) == [1, 3]


def test_acknowledgement_of_other_failures(feed):
    feed.add((1, "done", 1, "x")).add((2, "open", 2, "x"))
    broken = [True]

    def process(batch):
        if broken[0] and batch.where("key = 'open' or key = 'done'").count():
            raise ValueError("not a Spark fault")
        return batch.select("id")

    ask = lambda: streams.acknowledged(feed.stream(), process, F.col("key") == "done", "s", feed.folder, 2)
    with pytest.raises(PySparkException):
        ask()
    broken[0] = False
    assert ids(ask()) == [2]  # row 1 was ended when its batch failed


def test_a_write_that_fails_halfway_is_not_read(spark, feed):
    table = Landing(spark, f"{feed.folder}/t")
    rows = spark.range(0, 100, 1, 4).withColumnRenamed("id", "n")
    table.write(rows, 0)
    bad = rows.select(F.when(F.col("n") == 99, F.raise_error(F.lit("disk")).cast("long")).otherwise(F.col("n")).alias("n"))
    for number in (0, 1):  # in place of a whole batch, and anew
        with pytest.raises(PySparkException):
            table.write(bad, number)
        assert table.batches() == [] and table.read(rows.schema).count() == 0
    table.write(rows, 1)
    assert table.batches() == [1] and table.read(rows.schema).count() == 100


def test_old_batches_are_put_together(spark, feed):
    table = Landing(spark, f"{feed.folder}/t", apart=3)
    kind = spark.range(1).schema
    for n in range(9):
        table.write(spark.range(n * 10, n * 10 + 10), n)
        assert ids(table.read(kind)) == list(range(n * 10 + 10))
        assert len(table.folders()) <= 4 and table.done(n)
    table.write(spark.range(5), 0)  # an old batch can't come again
    table.write(spark.range(80, 85), 8)  # the newest one can
    assert ids(table.read(kind)) == list(range(85))
    table.compact()
    assert ids(table.read(kind)) == list(range(85)) and table.batches() == [8]


def test_a_path_that_ends_in_a_slash_or_has_signs_of_patterns(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/plain")
    assert ids(streams.landed(streams.source(spark, f"{tmp_path}/plain/"), "s")) == [0, 1, 2]
    for name in ("ends]", "a*b", "x{1}"):
        with pytest.raises(ValueError):
            streams.source(spark, f"{tmp_path}/{name}")


def test_deduplication_over_batches(feed):
    feed.add((1, "a", 1, "x"), (1, "a", 1, "x")).add((1, "a", 2, "x"), (2, "a", 2, "x"))
    assert ids(streams.landed(streams.deduplicated(feed.stream(), ["id"], "at"), "s")) == [1, 2]


def test_buffers_over_batches_and_restarts(feed):
    feed.add((1, "a", 1, "x"), (2, "a", 2, "x"), (3, "b", 3, "x")).add((4, "a", 4, "x"), (5, "c", 5, "x"))
    ask = lambda: streams.replay_buffers(feed.stream(), "key", ["at", "id"], "s", 2, 2, feed.folder)
    assert ids(ask()) == [3, 5]  # the greatest keys are b and c
    feed.add((6, "b", 6, "x"), (7, "b", 7, "x"))
    assert ids(ask()) == [5, 6, 7]


def test_projection_over_batches(feed):
    feed.add((1, "a", 1, "start"), (2, "a", 2, "end")).add((3, "a", 3, "late"), (4, "b", 4, "start"))
    found = streams.landed(streams.projection(feed.stream(), "key", "at", "id", "text", ["end"]), "s", "complete")
    assert sorted((r["key"], r["last_kind"], r["n"], r["finished"] is None) for r in found.collect()) == [("a", "late", 3, False), ("b", "start", 1, True)]


def test_span_export(spark, feed):
    feed.add(*[(i, "0" * 16 if i % 2 else f"00{i}", 1, None if i == 4 else f"t{i}") for i in range(5)])
    spans = feed.stream().select("id", F.col("key").alias("parent"), F.when(F.col("text").isNotNull(), F.array("text")).alias("attributes"))
    query = streams.export_spans(spans, feed.folder, "1 seconds")
    query.processAllAvailable()
    query.stop()
    rows = {r["id"]: r for r in spark.read.parquet(f"{feed.folder}/rows/batch=*").collect()}
    assert {i: r["parent"] for i, r in rows.items()} == {0: None, 1: None, 2: "002", 3: None, 4: "004"}
    assert rows[1]["attributes"] == '{"values":["t1"]}' and rows[4]["attributes"] is None


def test_an_empty_feed(spark, feed):
    feed.add()
    assert streams.landed(feed.stream(), "s", folder=feed.folder).count() == 0
