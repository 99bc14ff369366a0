"""Levels of long chains and random graphs; running sums and budgets over one group with all rows."""

import random
from functools import cache

import pytest
from pyspark.sql import functions as F

from plumbline.functions import scratch
from plumbline.functions.sums import running_sum
from plumbline.operators import graphs, windows


def levels(spark, nodes, links):
    n = spark.createDataFrame([("s", k) for k in nodes], "scope string, id long")
    e = spark.createDataFrame([("s", a, b) for a, b in links], "scope string, src long, dst long")
    return {r["id"]: r["level"] for r in graphs.levels(n, e, "scope", "id").collect()}


def expected(nodes, links):
    into = {k: [a for a, b in links if b == k] for k in nodes}

    @cache
    def level(k):
        return max((level(a) + 1 for a in into[k]), default=0)

    return {k: level(k) for k in nodes}


@pytest.mark.parametrize("seed", range(4))
def test_levels_of_random_graphs(spark, seed):
    r = random.Random(seed)
    n = 40
    links = {(a, b) for b in range(1, n) for a in r.sample(range(b), min(b, r.choice([0, 1, 1, 1, 2, 3])))}
    links |= {(a, a + 1) for a in range(n, n + 20)}  # a chain that nothing leads to
    assert levels(spark, range(n + 21), sorted(links)) == expected(range(n + 21), links)


def test_levels_of_a_long_chain_take_few_rounds(spark, monkeypatch):
    rounds = []
    kept = graphs.checkpointed
    monkeypatch.setattr(graphs, "checkpointed", lambda df: rounds.append(1) or kept(df))
    n = 10_000
    order = list(range(n))
    random.Random(1).shuffle(order)
    found = levels(spark, order, [*zip(order, order[1:])])
    assert found == {k: i for i, k in enumerate(order)} and len(rounds) < 40


def test_levels_with_unknown_ends_and_without_links(spark):
    assert levels(spark, [1, 2, 3], [(9, 1), (1, 9), (1, 2)]) == {1: 0, 2: 1, 3: 0}
    assert levels(spark, [1, 2], []) == {1: 0, 2: 0} and levels(spark, [], []) == {}


@pytest.mark.parametrize("links", [[(1, 1)], [(1, 2), (2, 1)], [(0, 1), (1, 2), (2, 3), (3, 1)], [(0, 1), (0, 2), (1, 2), (2, 3), (3, 1), (0, 3)], [(a, (a + 1) % 9) for a in range(9)]])
def test_cycles(spark, links):
    with pytest.raises(ValueError):
        levels(spark, range(10), links)


def test_running_sum_of_one_hot_group(spark):
    rows = [("hot" if i % 10 else None, i * 7919 % 4001, i % 5) for i in range(4000)]
    df = spark.createDataFrame(rows, "g string, at long, v long")
    found = {(r["g"], r["at"]): r["sum"] for r in running_sum(df, ["g"], ["at"], "v", "sum").collect()}
    for g in ("hot", None):
        total = 0
        for _, at, v in sorted((r for r in rows if r[0] == g), key=lambda r: r[1]):
            total += v
            assert found[g, at] == total


def test_a_hot_key_is_spread_over_all_partitions(spark, monkeypatch):
    dealt = []
    kept = scratch.checkpointed

    def watched(df):
        df = kept(df)
        if "__pid" in df.columns:
            dealt.extend(r["count"] for r in df.groupBy("__pid").count().collect())
        return df

    monkeypatch.setattr("plumbline.functions.sums.checkpointed", watched)
    df = spark.range(20_000).select(F.lit("one").alias("g"), "id", F.lit(1).alias("cost"))
    assert windows.prefix_budget(df, ["g"], ["id"], "cost", 15_000).count() == 15_000
    assert len(dealt) == 4 and max(dealt) < 8_000


def test_greedy_budget_of_more_rows_than_a_round(spark, monkeypatch):
    monkeypatch.setattr(windows, "ROUND", 7)
    r = random.Random(5)
    rows = [(g, i, r.randint(0, 9)) for g in "ab" for i in range(120)]
    found = windows.greedy_budget(spark.createDataFrame(rows, "g string, i long, cost long"), ["g"], ["i"], "cost", 60)
    want = []
    for g in "ab":
        used = 0
        for x in (x for x in rows if x[0] == g):
            if used + x[2] <= 60 or x[1] == 0:
                used += x[2]
                want.append(x)
    assert sorted(map(tuple, found.collect())) == sorted(want)


def test_groups_are_limited_before_they_are_moved(spark):
    df = spark.range(100_000).select((F.col("id") % 3).alias("g"), "id")
    row = F.row_number().over(windows.Window.partitionBy("g").orderBy("id"))
    assert "WindowGroupLimit" in df.withColumn("n", row).where(F.col("n") <= windows.ROUND)._jdf.queryExecution().executedPlan().toString()
