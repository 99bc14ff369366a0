"""Dependency graphs: readiness, levels, expansion, retries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scratch import checkpointed, near


def edges(nodes: DataFrame, key: str, needs: str, scope: str) -> DataFrame:
    """(scope, src, dst) of dependencies whose both ends are known."""
    all_edges = nodes.select(scope, F.explode(needs).alias("src"), F.col(key).alias("dst"))
    known = nodes.select(F.col(scope).alias("__s"), F.col(key).alias("__k"))
    return all_edges.join(known, (F.col(scope) == F.col("__s")) & (F.col("src") == F.col("__k")), "left_semi")


def runnable(nodes: DataFrame, scope: str, key: str, needs: str, status: str) -> DataFrame:
    """PENDING nodes all of whose needs exist and have SUCCEEDED; a need that is unknown blocks."""
    pending = nodes.where(F.col(status) == "PENDING")
    done = nodes.where(F.col(status) == "SUCCEEDED").select(F.col(scope).alias("__s"), F.col(key).alias("__k"))
    unmet = pending.select(scope, key, F.explode(needs).alias("__need"))
    unmet = unmet.join(done, (F.col(scope) == F.col("__s")) & (F.col("__need") == F.col("__k")), "left_anti").select(scope, key).distinct()
    return pending.join(unmet, [scope, key], "left_anti")


def levels(nodes: DataFrame, links: DataFrame, scope: str, key: str) -> DataFrame:
    """nodes with `level`, the longest path to them over links (scope, src, dst) between known nodes.

    A node's level is the greatest of its base and of each link's begin plus the link's length. A round takes the nodes
    that no link leads to, whose level is their base, and lets their links raise what they lead to. Nodes with one link
    into them hang on its begin: over chains of such nodes, pointers are doubled until they hang on one that isn't, and
    links that begin at them begin there instead, longer. So a chain of n nodes takes log2(n) steps and not n, and what is
    left after a round has two links into it at least. In the end levels come back along the pointers. A graph with a
    cycle is a ValueError.
    """
    left = checkpointed(nodes.select(F.col(scope).alias("s"), F.col(key).alias("k")).where("s is not null and k is not null").distinct().withColumn("b", F.lit(0)))
    known = lambda end: left.select("s", F.col("k").alias(end))
    ends = links.select(F.col(scope).alias("s"), "src", "dst").distinct().join(known("src"), ["s", "src"], "left_semi").join(known("dst"), ["s", "dst"], "left_semi")
    ends = checkpointed(ends.withColumn("w", F.lit(1)))
    placed, hung = [], []
    while left.limit(1).count():
        into = ends.groupBy("s", F.col("dst").alias("k")).agg(F.count("*").alias("n"), F.min(F.struct("src", "w")).alias("only"))
        state = checkpointed(left.join(into, ["s", "k"], "left"))
        free = state.where("n is null").select("s", "k", "b")
        if not state.where("n is null or n = 1").limit(1).count():
            raise ValueError("the graph has a cycle")
        placed.append(free.withColumnRenamed("b", "level"))
        begun = free.select("s", F.col("k").alias("src"), F.col("b").alias("from"))
        told = ends.join(begun, ["s", "src"], "left")
        raised = told.where("from is not null").select("s", F.col("dst").alias("k"), (F.col("from") + F.col("w")).alias("more"))
        ends = checkpointed(told.where("from is null").drop("from"))
        single = state.where("n = 1").select("s", "k", "b", F.col("only.src").alias("up"), F.col("only.w").alias("w"))
        chains = _doubled(single.join(free.select("s", F.col("k").alias("up")), ["s", "up"], "left_anti"))
        hung.append(chains)
        mine = chains.select("s", "k").withColumn("hangs", F.lit(True))
        rest = ends.join(mine.withColumnRenamed("k", "dst"), ["s", "dst"], "left_anti")
        moved = rest.join(chains.select("s", F.col("k").alias("src"), "up", F.col("b").alias("base"), F.col("w").alias("far")), ["s", "src"], "left")
        moved = checkpointed(moved.select("s", F.coalesce("up", "src").alias("src"), "dst", (F.col("w") + F.coalesce("far", F.lit(0))).alias("w"), (F.col("base") + F.col("w")).alias("more")))
        if moved.where("src = dst").limit(1).count():
            raise ValueError("the graph has a cycle")
        raised = raised.union(moved.where("more is not null").select("s", F.col("dst").alias("k"), "more")).groupBy("s", "k").agg(F.max("more").alias("more"))
        ends = checkpointed(moved.groupBy("s", "src", "dst").agg(F.max("w").alias("w")))
        stay = state.where("n is not null").select("s", "k", "b").join(mine, ["s", "k"], "left_anti").join(raised, ["s", "k"], "left")
        left = checkpointed(stay.select("s", "k", F.greatest("b", F.coalesce("more", "b")).alias("b")))
    if not placed:
        return nodes.withColumn("level", F.lit(0)).where("false")
    found = reduce(DataFrame.union, placed)
    for chains in reversed(hung):
        above = found.select("s", F.col("k").alias("up"), F.col("level").alias("top"))
        found = checkpointed(found.union(chains.join(above, ["s", "up"]).select("s", "k", F.greatest("b", F.col("top") + F.col("w")))))
    return nodes.join(found, (F.col(scope) == F.col("s")) & (F.col(key) == F.col("k"))).drop("s", "k")


def _doubled(single: DataFrame) -> DataFrame:
    """Nodes (s, k, b, up, w) that hang on others, so that `up` hangs on none: level(k) = max(b, level(up) + w)."""
    now = checkpointed(single)
    for _ in range(now.count().bit_length() + 1):
        above = now.select("s", F.col("k").alias("up"), F.col("b").alias("b2"), F.col("up").alias("up2"), F.col("w").alias("w2"))
        both = checkpointed(now.join(above, ["s", "up"], "left"))
        if not both.where("up2 is not null").limit(1).count():
            return now
        raised = F.greatest("b", F.coalesce(F.col("b2") + F.col("w"), "b"))
        now = both.select("s", "k", raised.alias("b"), F.coalesce("up2", "up").alias("up"), (F.col("w") + F.coalesce("w2", F.lit(0))).alias("w"))
    raise ValueError("the graph has a cycle")


def expand(links: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(node, hops) reached from seeds (node) over links (src, dst) in at most `depth` hops, without the seeds.

    Each hop's new nodes are kept, so the plan grows by one join a hop; it ends early when a hop finds none. While few nodes
    are new, they go to the links and no link is moved. Links may be repeated.
    """
    seen = frontier = checkpointed(seeds.select("node", F.lit(0).alias("hops")).distinct())
    for hop in range(1, depth + 1):
        reached = links.join(near(frontier), F.col("src") == F.col("node")).select(F.col("dst").alias("node")).distinct()
        frontier = checkpointed(reached.join(seen, "node", "left_anti").select("node", F.lit(hop).alias("hops")))
        if not frontier.limit(1).count():
            break
        seen = seen.union(frontier)
    return seen.where("hops > 0")


def next_attempts(attempts: DataFrame, scope: str, key: str, attempt: str, failed: str, most: int) -> DataFrame:
    """Per scope and key whose last attempt failed: the next attempt, up to `most`."""
    last = attempts.groupBy(scope, key).agg(F.max(F.struct(attempt, failed)).alias("x"))
    return last.where(F.col(f"x.{failed}") & (F.col(f"x.{attempt}") < most)).select(scope, key, (F.col(f"x.{attempt}") + 1).alias("next_attempt"))
