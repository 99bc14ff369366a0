"""Best-fit packing of token pieces into sequences of fixed length, in bulk-synchronous supersteps.

Documents are cut into pieces of at most `length` tokens (the first may be shorter). A superstep range-sorts
the pieces that are left and the gaps (what room sequences have) together, from the largest on, and sweeps
them: each piece looks for its successor, the smallest gap that holds it and that no piece before it took.
That is a matching of brackets, so it is found by distributed prefix sums: a slot opens a level and a piece
closes the topmost one, and the rank among slots and pieces of one level says who takes whom. The gaps are
updated, and the next superstep begins, until no piece is left. A gap with room for several of the largest
pieces is offered as several slots. Pieces larger than every gap open as few new sequences as can hold them
(their sum over `length`, or the number of those above half of it). Some ten supersteps are usual, however
many rows there are; only counts, a sum and the extreme sizes go to the driver.

Null and empty texts are one piece with the end id. Repeated rows are packed each. Rows with a null id too.
Pieces of one size are taken in the order of their numbers, gaps of one room in that of theirs.
Further columns of documents are not read; those of pieces stay, but for `__id`. A very long text is encoded
whole in one task. A table without rows gives none.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, partitions_for, text_of
from .tokens import encoder

LENGTH = 2048
#: Rows of a sweep for each partition: a late superstep has few.
SWEEP_ROWS = 20_000


def _pieces(path: str, end: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, end)
        for b in batches:
            at = 0
            for encoded in encode.slices(b.column(1)):
                n = pc.binary_length(encoded).to_numpy() // 4
                k = -(-n // length)
                row = np.repeat(np.arange(len(n)), k)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(k) - k, k)
                head = (n - (k - 1) * length)[row]
                start = np.where(piece, head + (piece - 1) * length, 0)
                size = np.where(piece, length, head)
                first = start + (np.cumsum(n) - n)[row]
                raw = memoryview(encoded.buffers()[2])
                crc = [zlib.crc32(raw[4 * i : 4 * j]) for i, j in zip(first.tolist(), (first + size).tolist())]
                columns = [b.column(0).slice(at, len(n)).take(pa.array(row)), pa.array(piece, type=pa.int32()), pa.array(start), pa.array(size), pa.array(crc, type=pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32"])
                at += len(n)

    return run


def pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH, end: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("text"))
    return rows.mapInArrow(_pieces(tokenizer, end, length), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


def pack(cut: DataFrame, length: int = LENGTH) -> DataFrame:
    """Adds sequence_id and offset to pieces that have a `length`; one of `length` or more is a sequence of its own."""
    spark = cut.sparkSession
    cut = checkpointed(cut)
    numbered = cut.withColumn("__id", F.monotonically_increasing_id())  # the same whenever the kept table is read
    left = numbered.where(F.col("length") < length).select(F.col("__id").alias("id"), F.col("length").alias("size"))
    gaps = spark.createDataFrame([], "seq long, room long")
    placed = spark.createDataFrame([], "id long, seq long, offset long")
    opened = 0
    while True:
        sizes, rooms = _histograms(left, gaps)
        if not sizes:
            break
        top, n = max(rooms, default=0), sum(sizes.values())
        own = sum(k for size, k in sizes.items() if size > top and 2 * size > length)
        need = sum(k * size for size, k in sizes.items() if size > top)
        new = max(own, -(-need // length))
        gaps = gaps.union(spark.range(opened, opened + new).select(F.col("id").alias("seq"), F.lit(length).cast("long").alias("room")))
        opened += new
        found, left = _superstep(left, gaps, {"n": n, "most": max(sizes), "least": min(sizes)}, sum(rooms.values()) + new)
        start = F.sum("size").over(Window.partitionBy("seq").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1))
        placed = placed.union(found.select("id", "seq", (F.lit(length) - F.col("room") + F.coalesce(start, F.lit(0))).alias("offset")))
        taken = found.select("seq", (-F.col("size")).alias("room"))
        gaps = checkpointed(gaps.union(taken).groupBy("seq").agg(F.sum("room").alias("room")).where(F.col("room") >= min(sizes)))
    full = numbered.where(F.col("length") >= length).select("__id", (F.col("__id") + opened).alias("seq"), F.lit(0).cast("long").alias("offset"))
    out = numbered.join(placed.union(full).withColumnRenamed("id", "__placed"), F.col("__id") == F.col("__placed"))
    return out.select(*cut.columns, F.col("seq").alias("sequence_id"), "offset")


def _histograms(left: DataFrame, gaps: DataFrame) -> tuple[dict[int, int], dict[int, int]]:
    """How many pieces have each size and how many gaps each room: a number for each length at most, in one job."""
    rows = left.select(F.lit(True).alias("piece"), F.col("size").alias("value")).union(gaps.select(F.lit(False), "room"))
    out: tuple[dict[int, int], dict[int, int]] = ({}, {})
    for r in rows.groupBy("piece", "value").count().collect():
        out[0 if r["piece"] else 1][r["value"]] = r["count"]
    return out


def _superstep(left: DataFrame, gaps: DataFrame, now: dict[str, int], n_gaps: int) -> tuple[DataFrame, DataFrame]:
    """What pieces (id, size) take which gap (seq, room, slot) in one sweep, and the pieces that found none.

    now: the number of pieces and their most and least size. A gap that holds several pieces of the greatest size
    has as many slots, all but the last of just that size, as long as there are not many more slots than pieces.
    """
    n, most, least = now["n"], now["most"], now["least"]
    slots = F.least(F.greatest(F.floor(F.col("room") / most), F.lit(1)), F.lit(1 + -(-4 * n // n_gaps)))
    offered = gaps.where(F.col("room") >= least).withColumn("slots", slots.cast("int"))
    offered = offered.select("seq", "room", "slots", F.explode(F.sequence(F.lit(1), "slots")).alias("slot"))
    value = F.when(F.col("slot") < F.col("slots"), F.lit(most)).otherwise(F.col("room") - most * (F.col("slots") - 1))
    none = F.lit(None).cast("long")
    rows = offered.select(value.alias("value"), F.lit(1).alias("step"), "seq", "room", F.col("slot").cast("long").alias("slot"), none.alias("id"))
    rows = rows.union(left.select("size", F.lit(-1), none, none, none, "id"))
    order = [F.desc("value"), F.desc("step"), "seq", "slot", "id"]
    parts = max(1, min(partitions_for(left), (n + n_gaps) // SWEEP_ROWS))
    swept = checkpointed(rows.repartitionByRange(parts, *order).withColumn("pid", F.spark_partition_id()))

    # The stack of open slots: its height is the running sum of steps, less the least sum so far (pieces that found it empty).
    inside = Window.partitionBy("pid").orderBy(*order)
    own = swept.withColumn("sum", F.sum("step").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    own = own.withColumn("low", F.min("sum").over(inside.rowsBetween(Window.unboundedPreceding, -1)))
    ends = own.groupBy(F.col("pid").alias("of")).agg(F.sum("step").alias("sum"), F.min("sum").alias("low"))  # a row for each partition
    before = Window.orderBy("of").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("of", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("base"), "low")
    ends = ends.select("of", "base", F.coalesce(F.min(F.col("base") + F.col("low")).over(before), F.lit(0)).alias("floor"))
    placed = own.join(F.broadcast(ends), F.col("pid") == F.col("of"))
    height = F.col("base") + F.col("sum") - F.least(F.lit(0), "floor", F.col("base") + F.coalesce("low", F.lit(0)))
    level = F.when(F.col("step") == 1, height).otherwise(height + 1)
    levels = placed.select("value", "step", "seq", "room", "slot", "id", level.alias("level"))

    # On one level slots and pieces alternate, and a piece takes the slot before it. A level has a slot and a piece of each
    # size at most; pieces that found the stack empty are on none, each by itself.
    by_level = Window.partitionBy("level", F.when(F.col("level") == 0, F.col("id"))).orderBy(*order)
    taken = levels.select("step", "id", F.col("value").alias("size"), *[F.lag(c).over(by_level).alias(c) for c in ("seq", "room", "slot")])
    matched = checkpointed(taken.where("step = -1").drop("step"))
    return matched.where("seq is not null"), matched.where("seq is null").select("id", "size")
