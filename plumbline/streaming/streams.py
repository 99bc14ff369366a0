"""Streaming operators: at-least-once landing, bad rows, acknowledgement, fan-out, projections, buffers, liveness.

Streams run with Structured Streaming and land in Parquet tables with a ledger of whole batches (`functions.tables.Landing`), so a
batch that is delivered again replaces itself and one that failed halfway is never read. Every operator takes the folder
that holds its state and its tables: called again with it, a stream goes on where its checkpoint ends; without one it
begins afresh in a new folder of the shared place. `every` gives a processing-time trigger (and the query runs until it is
stopped); without it a stream takes what is there now, in micro-batches, and ends.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.scratch import fresh_path
from ..functions.tables import Landing
from ..operators.windows import last_n

BUFFER, BUFFERS = 50, 200
SPANS_PER_BATCH, SPANS_EVERY = 512, "2 seconds"


def source(spark: SparkSession, path: str, files_per_batch: int = 8) -> DataFrame:
    """A stream of a Parquet file or of those in a folder; the schema is that of what is there.

    The path is given as a pattern, since a plain path must be a folder; so it may have no sign of patterns itself.
    """
    path = path.rstrip("/")
    if re.search(r"[{}\[\]*?\\]", path):
        raise ValueError(f"the path of a stream has a sign of patterns: {path}")
    pattern = f"{path[:-1]}[{path[-1]}]"
    schema = spark.read.parquet(pattern).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("ignoreMissingFiles", "true").parquet(pattern)


def start(stream: DataFrame, folder: str, each: Callable[[DataFrame, int], None], mode: str = "append", every: str | None = None) -> StreamingQuery:
    """Starts a stream whose state is in the folder; `each` gets every micro-batch and its number and must be idempotent."""
    writer = stream.writeStream.foreachBatch(each).outputMode(mode).option("checkpointLocation", f"{folder}/state")
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def run(stream: DataFrame, folder: str, each: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Runs a stream over what is there now and has not been taken yet."""
    start(stream, folder, each, mode).awaitTermination()


def batches(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the batches that lie whole below a path, in order."""
    return Landing(spark, path).batches()


def landed(stream: DataFrame, name: str, mode: str = "append", folder: str | None = None) -> DataFrame:
    """What a stream wrote. In complete mode only the last batch counts."""
    spark = stream.sparkSession
    folder = folder or fresh_path(spark, f"stream-{name}")
    rows = Landing(spark, f"{folder}/rows")

    def write(batch: DataFrame, number: int) -> None:
        rows.write(batch, number)
        if mode == "complete":
            rows.keep_last(number)

    run(stream, folder, write, mode)
    return rows.read(stream.schema)


def good_and_bad(stream: DataFrame, good: Column, name: str, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows that decode and rows that don't, split in every batch; the bad ones don't hold the stream up."""
    flagged = stream.withColumn("__good", F.coalesce(good, F.lit(False)))
    every = landed(flagged, name, folder=folder)
    return every.where("__good").drop("__good"), every.where("not __good").drop("__good")


def acknowledged(stream: DataFrame, process: Callable[[DataFrame], DataFrame], ended: Column, name: str, folder: str | None = None, tries: int = 3) -> DataFrame:
    """What process made of a stream's rows, under the rule of acknowledgement.

    A batch is acknowledged (its checkpoint goes on) unless process fails, in whatever way, and some of its rows are not
    ended: then it is tried again, and after the last try the failure ends the stream with the batch not acknowledged,
    so that the next run with the folder is given it again. If all rows of a failing batch are ended, it is
    acknowledged without a result.
    """
    spark = stream.sparkSession
    folder = folder or fresh_path(spark, f"stream-{name}")
    rows, kind = Landing(spark, f"{folder}/rows"), spark.createDataFrame([], stream.schema)

    def write(batch: DataFrame, number: int) -> None:
        for left in reversed(range(tries)):
            try:
                rows.write(process(batch), number)
                return
            except Exception:
                if not batch.where(~F.coalesce(ended, F.lit(False))).limit(1).count():
                    rows.write(process(kind), number)
                    return
                if not left:
                    raise

    run(stream, folder, write)
    return rows.read(process(kind).schema)


def fan_out(stream: DataFrame, sinks: dict[str, Callable[[DataFrame], DataFrame]], name: str, folder: str | None = None, heartbeat: Column | None = None) -> tuple[dict[str, DataFrame], dict[str, list[int]]]:
    """Several tables from one stream, and of each sink the batches that it still lacks.

    A sink that fails, whether in a task, in its own code or in the store, leaves the others alone. Its batch is kept as it
    came and tried again with each later batch, at the end, and by later runs with the folder, until it is in the sink's
    ledger, so that a passing fault loses no rows. Rows of the heartbeat are for the link alone and reach no sink.
    """
    spark = stream.sparkSession
    folder = folder or fresh_path(spark, f"stream-{name}")
    tables = {s: Landing(spark, f"{folder}/{s}") for s in sinks}
    kept = Landing(spark, f"{folder}/kept", apart=1 << 30)  # batches stay apart, since each is tried by itself
    stream = stream if heartbeat is None else stream.where(~F.coalesce(heartbeat, F.lit(False)))

    def attempt(sink: str, number: int, batch: DataFrame) -> bool:
        try:
            tables[sink].write(sinks[sink](batch), number)
            return True
        except Exception:  # one listener's fault isn't another's
            return False

    def lacking() -> dict[str, list[int]]:
        return {s: [n for n in kept.batches() if not t.done(n)] for s, t in tables.items()}

    def again() -> None:
        for sink, numbers in lacking().items():
            for n in numbers:
                attempt(sink, n, kept.batch(n, stream.schema))
        lost = {n for numbers in lacking().values() for n in numbers}
        for n in set(kept.batches()) - lost:
            kept._drop(f"batch={n}")

    def write(batch: DataFrame, number: int) -> None:
        again()
        batch = batch.persist()
        try:
            if not all([attempt(s, number, batch) for s in sinks]):
                kept.write(batch, number)
        finally:
            batch.unpersist()

    run(stream, folder, write)
    again()
    found = {s: spark.read.parquet(*folders) for s, t in tables.items() if (folders := t.folders())}
    return found, {s: n for s, n in lacking().items() if n}


def span_rows(spans: DataFrame) -> DataFrame:
    """Spans as they are exported: a parent id of zeros only is null, an attribute list is wrapped as {"values": [...]}.

    spans: parent (string), attributes (array) and whatever else.
    """
    parent = F.when(~F.col("parent").rlike("^0*$"), F.col("parent"))
    wrapped = F.to_json(F.struct(F.col("attributes").alias("values")))
    return spans.withColumn("parent", parent).withColumn("attributes", F.when(F.col("attributes").isNotNull(), wrapped))


def export_spans(stream: DataFrame, folder: str, every: str | None = SPANS_EVERY) -> StreamingQuery:
    """Exports spans in micro-batches; files of at most `SPANS_PER_BATCH` rows. A batch that fails is left out: tracing
    must not hold up what is traced. The exported rows are the table below `rows` of the folder."""

    rows = Landing(stream.sparkSession, f"{folder}/rows")

    def write(batch: DataFrame, number: int) -> None:
        try:
            rows.write(span_rows(batch), number, maxRecordsPerFile=SPANS_PER_BATCH)
        except Exception:
            return

    return start(stream, folder, write, every=every)


def deduplicated(stream: DataFrame, keys: list[str], ts: str, delay: str = "365 days") -> DataFrame:
    """One row of its keys for each key, however often it is delivered within the delay."""
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    return timed.dropDuplicatesWithinWatermark(keys).select(*keys)


def replay_buffers(stream: DataFrame, key: str, order: list[str], name: str, n: int = BUFFER, most: int = BUFFERS, folder: str | None = None) -> DataFrame:
    """The last n rows of each key, of the `most` greatest keys. Each batch merges into the buffers before it,
    which hold n rows a key at most."""
    spark = stream.sparkSession
    folder = folder or fresh_path(spark, f"stream-{name}")
    table = Landing(spark, f"{folder}/rows")

    def merge(batch: DataFrame, number: int) -> None:
        before = [k for k in table.batches() if k < number]
        rows = batch.unionByName(table.batch(before[-1], batch.schema)) if before else batch
        keys = rows.select(key).distinct().orderBy(F.desc(key)).limit(most)
        table.write(last_n(rows.join(F.broadcast(keys), key, "left_semi"), [key], order, n), number)
        table.keep_last(before[-1] if before else number)  # the one before serves if this batch is delivered again

    run(stream, folder, merge)
    last = table.batches()[-1:]
    return table.batch(last[0], stream.schema) if last else spark.createDataFrame([], stream.schema)


def projection(events: DataFrame, key: str, ts: str, order: str, kind: str, terminal: list[str]) -> DataFrame:
    """Per key: first seen, last kind and time, when it first ended, number of events. A running aggregate for streams."""
    at = F.struct(ts, order)
    return events.groupBy(key).agg(
        F.min(ts).alias("started"), F.max_by(kind, at).alias("last_kind"), F.max(ts).alias("last_seen"),
        F.min(F.when(F.col(kind).isin(*terminal), F.col(ts))).alias("finished"), F.count("*").alias("n"),
    )


def gaps(events: DataFrame, key: str, ts: str, order: str, seconds: int) -> DataFrame:
    """Where a key was silent for longer: the event after the silence, and its length in seconds."""
    by = Window.partitionBy(key).orderBy(ts, order)
    second = lambda c: F.unix_seconds(c.cast("timestamp"))
    silent = second(F.col(ts)) - second(F.lag(ts).over(by))
    return events.withColumn("silent_s", silent).where(F.col("silent_s") > seconds)


def stale(pending: DataFrame, ts: str, now: str, idle_seconds: int = 60, most: int = 500, *order: str) -> DataFrame:
    """Deliveries that have been idle for so long, oldest first: what a reclaim would take up."""
    cut = F.expr(f"TIMESTAMP_NTZ '{now}' - INTERVAL {idle_seconds} SECOND")
    return pending.where(F.col(ts) <= cut).orderBy(ts, *order).limit(most)
