"""Commands on tasks, retention, resets, and the shapes and repeats of task graphs."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scratch import checkpointed

# Statuses of tasks that have ended, and commands with the statuses that allow them and what follows.
TERMINAL = ["SUCCEEDED", "FAILED", "CANCELLED"]
ALLOWED = [
    ("approve_plan", ["WAITING_HUMAN"], "PENDING"),
    ("reject_plan", ["WAITING_HUMAN"], "CANCELLED"),
    ("approve_gate", ["WAITING_HUMAN"], "PENDING"),
    ("reject_gate", ["WAITING_HUMAN"], "FAILED"),
    ("cancel", ["PENDING", "WAITING_HUMAN"], "CANCELLED"),
    ("cancel", ["RUNNING"], "RUNNING"),
    ("retry", ["FAILED", "CANCELLED"], "PENDING"),
    ("delete", ["PENDING", "WAITING_HUMAN", *TERMINAL], "DELETED"),
]


def command_outcome(status: Column, command: Column, gate_open: Column, others: Column | None = None) -> tuple[Column, Column]:
    """accepted or conflict, and the status that follows.

    A plan is decided only while no gate is open, a gate only while it is. A running task that is cancelled goes
    on until it sees it. others: how many requests for the same gate came before; only the first is accepted.
    """
    after = F.lit(None).cast("string")
    for name, statuses, new in reversed(ALLOWED):
        after = F.when((command == name) & status.isin(*statuses), F.lit(new)).otherwise(after)
    is_gate = command.isin("approve_gate", "reject_gate")
    fits = ~command.isin("approve_plan", "reject_plan", "approve_gate", "reject_gate") | (is_gate == F.coalesce(gate_open, F.lit(False)))
    if others is not None:
        fits = fits & (~is_gate | (others == 0))
    legal = after.isNotNull() & fits
    return F.when(legal, "accepted").otherwise("conflict"), F.when(legal, after).otherwise(status)


def sweep(folders: DataFrame, tasks: DataFrame, now: Column, days: int) -> DataFrame:
    """folders (name, task_id, modified) with the `decision` of a retention sweep over tasks (task_id, status, ended).

    Folders of tasks that haven't ended are `active`. Others go (`delete`) when their task ended, or a folder
    without a task was last changed, more than so many days ago; else they are kept.
    """
    known = tasks.select("task_id", "status", "ended")
    joined = folders.join(known, "task_id", "left")
    since = F.when(F.col("status").isNull(), F.col("modified")).otherwise(F.col("ended"))
    old = since < now - F.make_dt_interval(F.lit(days))
    decision = F.when(F.col("status").isNotNull() & ~F.col("status").isin(*TERMINAL), "active").when(old, "delete").otherwise("keep")
    return joined.select(*folders.columns, F.col("status").isNull().alias("orphan"), decision.alias("decision"))


def removed(decided: DataFrame, remove: Callable[[object], None]) -> DataFrame:
    """decided after `remove` was called, in tasks, with the name of each folder to delete: `failed` where it raised.

    One that fails doesn't keep the others, and stays for the next sweep. A task that is run again removes again, so
    `remove` has to take a folder that is gone already for removed.
    """

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def outcome(name: object, decision: str) -> str:
            if decision != "delete":
                return decision
            try:
                remove(name)
            except Exception:
                return "failed"
            return decision

        for b in batches:
            yield b.assign(decision=[outcome(n, d) for n, d in zip(b["name"], b["decision"])])

    return checkpointed(decided.mapInPandas(each, decided.schema))


def sweep_counts(decided: DataFrame, with_failed: bool = False) -> DataFrame:
    """One row: how many folders were scanned, and of each decision."""
    n = lambda d: F.count_if(F.col("decision") == d)
    return decided.agg(F.count("*").alias("scanned"), n("delete").alias("deleted"), n("keep").alias("kept"), n("active").alias("active"), F.count_if("orphan").alias("orphans"), *([n("failed").alias("failed")] if with_failed else []))


def emptied(tables: dict[str, DataFrame], dry_run: bool = True) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables without rows (or as they are, in a dry run), and of each the rows before and after."""
    after = tables if dry_run else {name: df.limit(0) for name, df in tables.items()}
    rows = [df.agg(F.lit(name).alias("name"), F.count("*").alias("before")).withColumn("after", F.col("before") if dry_run else F.lit(0).cast("long")) for name, df in tables.items()]
    return after, reduce(DataFrame.union, rows)


def cascade(parents: DataFrame, key: str, tables: dict[str, tuple[DataFrame, str]]) -> tuple[dict[str, DataFrame], DataFrame]:
    """Dependent tables (with their foreign key) without the rows of deleted parents, in the order given, and how many rows each lost."""
    gone = parents.select(F.col(key).alias("__gone")).distinct()
    kept = {name: df.join(gone, F.col(k) == F.col("__gone"), "left_anti") for name, (df, k) in tables.items()}
    lost = [df.join(gone, F.col(k) == F.col("__gone"), "left_semi").agg(F.lit(name).alias("name"), F.count("*").alias("deleted")) for name, (df, k) in tables.items()]
    return kept, reduce(DataFrame.union, lost)


def plan_shape(tasks: DataFrame, files: DataFrame, task: str) -> DataFrame:
    """(task, src, dst) of the graph that a plan leads to.

    tasks: task, with_pom, with_gate. files: task, file. ANALYZE leads to PLAN, PLAN to a REWRITE of each file (by way
    of POM if there is one), these to one VERIFY, by way of GATE if there is one. A task without files verifies
    what POM (or PLAN) did.
    """
    before = F.when(F.col("with_pom"), "POM").otherwise("PLAN")
    after = F.when(F.col("with_gate"), "GATE").otherwise("VERIFY")
    edge = lambda df, src, dst: df.select(task, src.alias("src"), dst.alias("dst"))
    rewrite = F.concat(F.lit("REWRITE:"), F.col("file").cast("string"))
    both = files.select(task, "file").distinct().join(tasks, task)
    bare = tasks.join(files.select(task).distinct(), task, "left_anti")
    parts = [
        edge(tasks, F.lit("ANALYZE"), F.lit("PLAN")), edge(tasks.where("with_pom"), F.lit("PLAN"), F.lit("POM")), edge(both, before, rewrite),
        edge(both, rewrite, after), edge(bare, before, after), edge(tasks.where("with_gate"), F.lit("GATE"), F.lit("VERIFY")),
    ]
    return reduce(DataFrame.union, parts)


def after_failed_verify(nodes: DataFrame, task: str, most: int = 3) -> DataFrame:
    """What follows a failed VERIFY: per task the files to rewrite again, with their next attempt, and the new VERIFY's.

    nodes: task, kind (REWRITE or VERIFY), file, attempt, status, legacy (whether the rewritten file still has legacy
    imports). Only tasks whose last VERIFY failed go on; their legacy files are rewritten again, or all if none
    is, as long as a file's attempt is below `most`. action is rewrite, verify or skip (a VERIFY still pending).
    """
    verify, rewrite = nodes.where("kind = 'VERIFY'"), nodes.where("kind = 'REWRITE'")
    last = verify.where("status <> 'PENDING'").groupBy(task).agg(F.max(F.struct("attempt", "status")).alias("v")).where("v.status = 'FAILED'").select(task, F.col("v.attempt").alias("tried"))
    newest = rewrite.groupBy(task, "file").agg(F.max(F.struct("attempt", "legacy")).alias("r")).select(task, "file", "r.attempt", "r.legacy").join(last, task)
    of_task = newest.groupBy(task).agg(F.bool_or(F.coalesce("legacy", F.lit(False))).alias("some"))
    again = newest.join(of_task, task).where((~F.col("some") | F.col("legacy")) & (F.col("attempt") < most))
    rows = again.select(task, F.lit("rewrite").alias("action"), "file", (F.col("attempt") + 1).alias("attempt"))
    new = again.select(task, "tried").distinct().select(task, F.lit("verify"), F.lit(None).cast(nodes.schema["file"].dataType), F.col("tried") + 1)
    stale = verify.where("status = 'PENDING'").join(again.select(task).distinct(), task, "left_semi").select(task, F.lit("skip"), "file", "attempt")
    return rows.union(new).union(stale)


# Results that are replayed into a workspace, in this order; later ones override.
REPLAY = ["REWRITE", "POM", "DEPENDENCY", "PARENT"]


def replayed(results: DataFrame, task: str, path: str) -> DataFrame:
    """Of each task and path the result that stands after a replay.

    results: task, path, kind (of REPLAY), attempt, status. Only successful ones count; of one kind the greatest attempt.
    """
    order = F.array_position(F.array(*[F.lit(k) for k in REPLAY]), F.col("kind"))
    good = results.where((F.col("status") == "SUCCEEDED") & F.col("kind").isin(*REPLAY))
    others = [c for c in results.columns if c not in (task, path)]
    best = good.groupBy(task, path).agg(F.max(F.struct(order.alias("__o"), "attempt", *[c for c in others if c != "attempt"])).alias("__x"))
    return best.select(task, path, *[F.col(f"__x.{c}").alias(c) for c in others])
