"""Mixing sources to target weights by hash-random order and distributed prefix sums.

A document's size is its number of words. Every source gets a target of words; a target above `cap` times
its source's size stops there and the excess is shared by weight among the others. Documents get a
hash-random key; keys are range-sorted within each source and their sizes summed up before each, over
partitions, so a large source lies in many. A source is taken whole as often as its target holds its size,
and the rest is cut where the running sum would pass it; of the documents behind the cut, the one whose size
comes nearest to what is left is taken too. So a document is taken whole, `epochs` times or once more, never
beyond the cap.

Null texts have size 0. A null source is a source of its own, the last. Repeated rows share a key and are
taken together. A source without words has target 0, and none of its documents is taken. A table without
rows gives none. A very long text is counted whole where it lies, and only its size is moved. The targets are
worked out over one row for each source, in one task: sources are taken to be thousands at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, checkpointed, running_total, small, text_of

WEIGHTS = (5, 2, 1)
CAP = 3
SEED = 20_250_101


def size_of(text: str = "text") -> Column:
    return F.regexp_count(text_of(text), F.lit(WORD)).cast("long")


def key_of(doc_id: str = "doc_id", text: str = "text", seed: int = SEED) -> Column:
    return F.xxhash64(F.lit(seed), F.col(doc_id), F.col(text))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """(source, source_size) with the target of each: min(cap * size, level * weight), at one level for all.

    With the sources in the order of cap * size / weight, each is tried as the first that is not full; to
    take too few or too many for full lowers the level, so the highest is the right one.
    A mix has one row for each source here.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    weighed = sizes.withColumn("__w", weight).withColumn("__full", F.lit(float(cap)) * F.col("source_size"))
    by_fill = Window.orderBy(F.col("__full") / F.col("__w"), F.col("source").isNull(), "source")
    every = Window.partitionBy()
    done = F.coalesce(F.sum("__full").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("__w").over(by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = (F.sum("source_size").over(every) - done) / open_weight
    found = weighed.withColumn("__level", level)
    level = F.coalesce(F.max("__level").over(every), F.lit(0.0))
    return found.select("source", "source_size", F.least("__full", level * F.col("__w")).alias("target"))


def plan(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP, seed: int = SEED, kept: DataFrame | None = None) -> DataFrame:
    """Per source: source_size, target, epochs, and the last key and one extra key that are taken once more (null: none)."""
    rows = kept if kept is not None else docs.select("source", key_of(seed=seed).alias("key"), size_of().alias("size"))
    keyed = rows.groupBy("source", "key").agg(F.sum("size").alias("size"))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = targets(sizes, weights, cap)
    goal = goal.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    goal = goal.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    goal = small(goal.withColumnRenamed("source", "__s"))
    before = running_total(keyed, ["key"], "size", "before", ["source"])
    placed = before.join(goal, F.col("source").eqNullSafe(F.col("__s"))).select("__s", "key", "size", "rest", (F.col("before") + F.col("size")).alias("after"))
    placed = checkpointed(placed)
    inside = placed.where("rest > 0 and after <= rest").groupBy(F.col("__s").alias("__c")).agg(F.max("key").alias("last_key"), F.max("after").alias("filled"))
    inside = small(goal.join(inside, F.col("__s").eqNullSafe(F.col("__c")), "left").select(F.col("__s").alias("__c"), "last_key", (F.col("rest") - F.coalesce("filled", F.lit(0))).alias("room")))
    outside = placed.join(inside, F.col("__s").eqNullSafe(F.col("__c"))).where("last_key is null or key > last_key").where("abs(size - room) < room")
    last = outside.groupBy(F.col("__s").alias("__d")).agg(F.min(F.struct(F.abs(F.col("size") - F.col("room")).alias("off"), "key")).alias("x")).select("__d", F.col("x.key").alias("extra_key"))
    out = goal.join(inside, F.col("__s").eqNullSafe(F.col("__c"))).join(last, F.col("__s").eqNullSafe(F.col("__d")), "left")
    return out.select(F.col("__s").alias("source"), "source_size", "target", "epochs", "last_key", "extra_key")


def mixed(docs: DataFrame, by: DataFrame, seed: int = SEED, columns: bool = True, key: str | None = None) -> DataFrame:
    """docs with `copies` (how often each is taken) and, if asked, source_size and target; they replace columns of these names. key: a column that has key_of()."""
    by = small(by).select(F.col("source").alias("__s"), *[F.col(c).alias(f"__{c}") for c in ("source_size", "target", "epochs", "last_key", "extra_key")])
    joined = docs.withColumn("__key", F.col(key) if key else key_of(seed=seed)).join(by, F.col("source").eqNullSafe(F.col("__s")))
    copies = (F.col("__epochs") + F.when((F.col("__key") <= F.col("__last_key")) | (F.col("__key") == F.col("__extra_key")), 1).otherwise(0)).cast("long")
    extra = [F.col("__source_size").alias("source_size"), F.col("__target").alias("target")] if columns else []
    own = {"copies", *(["source_size", "target"] if columns else [])}
    return joined.select(*[c for c in docs.columns if c not in own], *extra, copies.alias("copies"))


def repeated(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP, seed: int = SEED) -> DataFrame:
    """docs as mixed: each row as often as it is taken, columns unchanged."""
    rows = checkpointed(docs.select("source", key_of(seed=seed).alias("key"), size_of().alias("size")))
    inside = docs.select(F.struct(*docs.columns).alias("__row"), "source", "doc_id", "text")
    taken = mixed(inside, plan(docs, weights, cap, seed, rows), seed, columns=False).where("copies > 0")
    return taken.select("__row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("__row.*")
