"""Ranks, budgets and positions inside groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scratch import checkpointed
from ..functions.sums import running_sum

#: Rows of a key that a round of a greedy budget looks at: Spark limits groups before it moves them up to so many.
ROUND = 1000


def last_n(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The n last rows of each key; Spark keeps n per key and partition before it shuffles."""
    by = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("__n", F.row_number().over(by)).where(F.col("__n") <= n).drop("__n")


def ordinal(keys: list[str], order: list[Column | str]) -> Column:
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*order))


def prefix_budget(df: DataFrame, keys: list[str], order: list[str], cost: str, most: int) -> DataFrame:
    """Rows of each key up to the first that would exceed the budget; costs are positive and the order has no ties.

    A key of any size is spread over range partitions, and their sums are carried on.
    """
    return running_sum(df, keys, order, cost, "used").where(F.col("used") <= most)


def greedy_budget(df: DataFrame, keys: list[str], order: list[str], cost: str, most: int) -> DataFrame:
    """The rows of each key that a fold in this order keeps: the first always, then each that still fits.

    cost is a whole number, and the order has no ties. A round looks, of each key, at the first rows that fit
    into what is left, at most `ROUND` of them, so each task keeps that many of a key before rows are moved and no
    key's rows are gathered whole; rows that no longer fit are not looked at again. Rows that cost nothing fit, unless the first
    row alone passes the budget.
    """
    rows = checkpointed(df)
    place = F.struct(*order)
    first = Window.partitionBy(*keys).orderBy(*order)
    numbered = checkpointed(rows.withColumn("__n", F.row_number().over(first)).where("__n <= 1").drop("__n"))
    kept = [numbered]
    state = numbered.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col(cost).cast("long").alias("__used"), place.alias("__last"))
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    kept.append(rows.where(F.col(cost) <= 0).join(state, same).where((place > F.col("__last")) & (F.col("__used") <= most)).select(*df.columns))
    left = rows.where(F.col(cost) > 0)
    while True:
        left = checkpointed(left.join(state, same).where((place > F.col("__last")) & (F.col("__used") + F.col(cost) <= most)))
        if not left.limit(1).count():
            break
        some = left.withColumn("__n", F.row_number().over(first)).where(F.col("__n") <= min(most, ROUND))
        item = F.struct(place.alias("at"), F.col(cost).cast("long").alias("cost"))
        fold = F.aggregate("__items", F.struct(F.col("__used").alias("used"), F.filter("__items", lambda x: F.lit(False)).alias("kept")), lambda acc, x: F.when(acc["used"] + x["cost"] <= most, F.struct((acc["used"] + x["cost"]).alias("used"), F.concat(acc["kept"], F.array(x)).alias("kept"))).otherwise(acc))
        folded = some.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("__items"), F.first("__used").alias("__used"))
        folded = checkpointed(folded.select(*[F.col(k).alias(f"__{k}") for k in keys], fold.alias("__x"), F.element_at("__items", -1)["at"].alias("__last")))
        left = left.select(*df.columns)
        taken = folded.select(*[f"__{k}" for k in keys], F.explode("__x.kept.at").alias("__at"))
        kept.append(left.join(taken, [*same, place == F.col("__at")]).select(*df.columns))
        state = folded.select(*[f"__{k}" for k in keys], F.col("__x.used").alias("__used"), "__last")
    out = kept[0]
    for more in kept[1:]:
        out = out.unionByName(more)
    return out


def curated(items: DataFrame, keys: list[str], content: str, priority: str, item: str, cost: str, most: int) -> tuple[DataFrame, DataFrame]:
    """The items of each key that make up its context, and per key: used, kept, dropped and overflow.

    Of equal contents the one of the least priority (then id) counts. They are kept in this order as the budget
    allows, the first always; overflow says that it alone passes the budget. A budget of 0 or less keeps all.
    """
    distinct = items.groupBy(*keys, content).agg(F.min(F.struct(priority, item, cost)).alias("__x")).select(*keys, content, "__x.*")
    distinct = checkpointed(distinct)
    kept = greedy_budget(distinct.drop(content), keys, [priority, item], cost, most) if most > 0 else distinct.drop(content)
    kept = checkpointed(kept)
    sums = kept.groupBy(*keys).agg(F.sum(cost).alias("used"), F.count("*").alias("kept"))
    every = distinct.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.count("*").alias("__n"))
    joined = sums.join(every, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    overflow = (F.col("used") > most) if most > 0 else F.lit(False)
    return kept, joined.select(*keys, "used", "kept", (F.col("__n") - F.col("kept")).alias("dropped"), overflow.alias("overflow"))


def share_of_group(keys: list[str], start: Column, length: Column, least: float = 0.6) -> tuple[Column, Column]:
    """Offset from the group's start and width, both in per cent of the group's span, clamped."""
    by = Window.partitionBy(*keys)
    first = F.min(start).over(by)
    span = F.greatest(F.max(start + length).over(by) - first, F.lit(1))
    clamp = lambda c, lo: F.least(F.greatest(c, F.lit(lo)), F.lit(100.0))
    return clamp((start - first) * 100.0 / span, 0.0), clamp(length * 100.0 / span, least)


def repeated_in_group(keys: list[str]) -> Column:
    return F.count("*").over(Window.partitionBy(*keys)) > 1
