"""Traces: runs, depths, ordinals, slowest hops."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scratch import checkpointed

MOST_DEPTH = 16


def runs(spans: DataFrame, keys: list[str]) -> DataFrame:
    """One row per trace: started, ended and duration_ms (null and 0 while a span is open), spans, root name.

    spans: keys, id, name, depth, start_ms, end_ms (null: open).
    """
    opened = F.bool_or(F.col("end_ms").isNull())
    ended = F.when(~opened, F.max("end_ms"))
    blank = F.trim(F.coalesce("name", F.lit(""))) == ""
    root = F.min(F.when((F.col("depth") == 0) & ~blank, F.struct("start_ms", "id", "name")))
    return spans.groupBy(*keys).agg(
        F.min("start_ms").alias("started"), ended.alias("ended"), F.coalesce(F.greatest(ended - F.min("start_ms"), F.lit(0)), F.lit(0)).alias("duration_ms"),
        F.count("*").alias("spans"), root["name"].alias("root_name"),
    )


def depths(spans: DataFrame, trace: str, span: str, parent: str, most: int = MOST_DEPTH) -> DataFrame:
    """spans with `depth`: the number of its ancestors in the same trace, at most `most`.

    A walk up ends before the first span that it has met already, so a span that is its own parent has depth 0,
    and two that are each other's parent have depth 1. Ancestors are followed by doubling: after k joins each
    span knows its 2**k next ones, so a depth of 16 takes four joins.
    """
    ids = spans.select(F.col(trace).alias("t"), F.col(span).alias("s"), F.col(parent).alias("p")).distinct()
    known = ids.select(F.col("t").alias("kt"), F.col("s").alias("ks"))
    path = F.when(F.col("ks").isNull(), F.array().cast(f"array<{ids.schema['s'].dataType.simpleString()}>")).otherwise(F.array("ks"))
    step = ids.join(known, (F.col("t") == F.col("kt")) & (F.col("p") == F.col("ks")), "left").select("t", "s", path.alias("path"))
    reach = 1
    while reach < most:
        step = checkpointed(step)
        above = step.select(F.col("t").alias("at"), F.col("s").alias("as_"), F.col("path").alias("next"))
        last = F.when(F.size("path") == reach, F.element_at("path", -1))
        joined = step.join(above, (F.col("t") == F.col("at")) & (last == F.col("as_")), "left")
        step = joined.select("t", "s", F.when(F.col("next").isNull(), F.col("path")).otherwise(F.concat("path", "next")).alias("path"))
        reach *= 2
    met = F.size(F.array_distinct(F.concat(F.array("s"), "path"))) - 1  # beyond a span met already all are
    found = step.select("t", "s", F.least(met, F.lit(most)).alias("depth"))
    return spans.join(found, (F.col(trace) == F.col("t")) & (F.col(span) == F.col("s"))).drop("t", "s")


def slowest(spans: DataFrame, keys: list[str], duration: str, depth: str, total: str) -> DataFrame:
    """Of each trace the longest hop below the root, else the longest of all, and its share of the run."""
    inner = F.max(F.when(F.col(depth) > 0, F.struct(duration, F.negative("id").alias("i"), "name")))
    every = F.max(F.struct(duration, F.negative("id").alias("i"), "name"))
    found = spans.groupBy(*keys).agg(F.coalesce(inner, every).alias("x"), F.max(total).alias("total"))
    return found.select(*keys, (-F.col("x.i")).alias("id"), F.col("x.name").alias("name"), F.col(f"x.{duration}").alias("duration_ms"), F.try_divide(F.col(f"x.{duration}"), "total").alias("share"))


def sessions(events: DataFrame, key: str, ts: str, order: str, gap_seconds: int) -> DataFrame:
    """events with `session`, numbered per key: a new one begins after a gap. (An extension: no parity.)"""
    by = Window.partitionBy(key).orderBy(ts, order)
    seconds = lambda c: F.unix_micros(c.cast("timestamp")) / 1_000_000
    fresh = seconds(F.col(ts)) - seconds(F.lag(ts).over(by)) > gap_seconds
    return events.withColumn("session", F.sum(F.when(fresh, 1).otherwise(0)).over(by.rowsBetween(Window.unboundedPreceding, 0)))
