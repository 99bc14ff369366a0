"""Evaluation reports: verdicts, ratios, weighted rates, distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def verdict(error: Column, status: Column, expected: Column) -> Column:
    """HARNESS_ERROR, AS_EXPECTED or UNEXPECTED; a null status counts as an error of the harness."""
    return F.when(error.isNotNull() | status.isNull(), "HARNESS_ERROR").when(status == expected, "AS_EXPECTED").otherwise("UNEXPECTED")


def ratio(hit: Column, among: Column) -> Column:
    """Share of rows with both among those of `among`; null without any."""
    return F.try_divide(F.count_if(hit & among).cast("double"), F.count_if(among))


def weighted_rate(part: Column, whole: Column) -> Column:
    """Sum of parts, each at most its whole, over the sum of wholes; null if that is 0."""
    return F.try_divide(F.sum(F.least(part, whole)).cast("double"), F.sum(whole))


def distribution(value: Column) -> list[Column]:
    """Number, mean, nearest-rank median and 90th percentile, least and greatest of the values that aren't null."""
    at = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY __v)")
    return [F.count(value).alias("n"), F.avg(value).alias("mean"), at(0.5).alias("median"), at(0.9).alias("p90"), F.min(value).alias("least"), F.max(value).alias("most")]


def distribution_by(df: DataFrame, keys: list[str], value: Column) -> DataFrame:
    return df.withColumn("__v", value).groupBy(*keys).agg(*distribution(F.col("__v")))


def rate_state(part: Column, whole: Column) -> tuple[Column, Column]:
    """Per cent (rounded, 0 to 100; null without whole) and pass, partial, fail or empty."""
    percent = F.when(whole > 0, F.least(F.greatest(F.floor(part * 100.0 / whole + F.lit(0.5)), F.lit(0)), F.lit(100)).cast("int"))
    return percent, F.when(percent.isNull(), "empty").when(percent == 100, "pass").when(percent > 0, "partial").otherwise("fail")


def tone(percent: Column, good: int = 90, mid: int = 60) -> Column:
    return F.when(percent.isNull(), "none").when(percent >= good, "good").when(percent >= mid, "mid").otherwise("bad")


def overview(runs: DataFrame, error: str = "harness_error", status: str = "status", expected: str = "expect", attempts: str | None = None) -> DataFrame:
    """One row of counters and ratios over evaluation runs.

    attempts: the column of verify attempts, null for a run without metrics. With it the usable runs with metrics, those
    of them that were retried, and the share that passed at the first try are counted too.
    """
    seen = verdict(F.col(error), F.col(status), F.col(expected))
    rows = runs.withColumn("verdict", seen)
    usable = F.col("verdict") != "HARNESS_ERROR"
    good, positive = F.col("verdict") == "AS_EXPECTED", F.col(expected) == "SUCCEEDED"
    measured = usable & F.col(attempts).isNotNull() if attempts else None
    more = [F.count_if(measured).alias("with_metrics"), F.count_if(measured & (F.col(attempts) > 1)).alias("retried_cases"), ratio(F.col(attempts) <= 1, measured).alias("first_try")] if attempts else []
    return rows.agg(
        F.count("*").alias("total"), F.count_if(usable).alias("usable"), F.count_if(~usable).alias("harness_errors"), ratio(good, usable).alias("as_expected"),
        ratio(good, usable & positive).alias("positive_success"), ratio(good, usable & ~positive).alias("negative_caught"), *more,
    )


def markdown(report: DataFrame) -> str:
    """A one-row report as a Markdown table."""
    row = report.first().asDict()
    show = lambda v: "no sample" if v is None else f"{v:.1%}" if isinstance(v, float) else str(v)
    return "\n".join(["| metric | value |", "| --- | --- |", *(f"| {k} | {show(v)} |" for k, v in row.items())])


def suite_totals(cases: DataFrame, keys: list[str], failed: Column, skipped: Column, order: list[str], name: Column) -> DataFrame:
    """Per suite: total, failed, skipped and passed cases, and the failed ones' names in order."""
    names = F.array_sort(F.collect_list(F.when(failed, F.struct(*order, name.alias("__name")))))
    rows = cases.groupBy(*keys).agg(F.count("*").alias("total"), F.count_if(failed).alias("failed"), F.count_if(skipped).alias("skipped"), names.alias("__names"))
    return rows.select(*keys, "total", "failed", "skipped", (F.col("total") - F.col("failed") - F.col("skipped")).alias("passed"), F.transform("__names", lambda x: x["__name"]).alias("failed_names"))


def share_covered(covered: Column, whole: Column) -> Column:
    """Sum of covered over the sum of whole; null if that is 0 or there is none."""
    return F.try_divide(F.sum(covered), F.sum(whole))


def least_with_fallback(chosen: Column, order: list[str], value: Column, fallback: Column) -> Column:
    """The value of the chosen row that is least in the order; without one the fallback, an aggregate."""
    return F.coalesce(F.min(F.when(chosen, F.struct(*order, value.alias("__value"))))["__value"], fallback)


def distinct_or_one(counted: Column, value: Column, known: Column) -> Column:
    """The number of distinct values of the counted rows, at least 1 if any row is known."""
    n = F.count_distinct(F.when(counted, value))
    return F.when(F.count_if(known) > 0, F.greatest(n, F.lit(1))).otherwise(n)


def all_match(present: Column, good: Column) -> Column:
    """Whether there are rows and all are good; a null counts as neither."""
    return (F.count(present) > 0) & F.coalesce(F.bool_and(good), F.lit(False))


def call_metrics(calls: DataFrame, key: str, tokens: Column, cost: Column, round_: Column, at: str) -> DataFrame:
    """Per key: number of calls, tokens, cost, distinct rounds (null: none) and the last time."""
    return calls.groupBy(key).agg(F.count("*").alias("llm_calls"), F.sum(tokens).alias("tokens"), F.sum(cost).cast("double").alias("cost"), F.count_distinct(round_).alias("rounds"), F.max(at).alias("last"))
