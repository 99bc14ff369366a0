"""Nearest strings by trigrams and containment, against all pairs."""

import random
import re

import pytest

from plumbline.operators import similar

WORDS = ["order", "service", "orders", "user", "repo", "impl", "list", "base", "x", "é", "a1"]


def grams(s):
    return {f"  {w} "[i : i + 3] for w in re.findall("[a-z0-9]+", s.lower()) for i in range(len(w) + 1)}


def near(a, b):
    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y) if x | y else 0.0


def strings(seed, n):
    r = random.Random(seed)
    return sorted({" ".join(r.choices(WORDS, k=r.randint(1, 4))).title() for _ in range(n)} | {"", "??", "zzz qqq"})


def table(spark, values, name="s"):
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


@pytest.mark.parametrize("t", [0.9, 0.5, 0.2, 0.0])
def test_candidates_are_all_pairs_that_are_so_near(spark, t):
    some, other = strings(1, 60), strings(2, 80)
    known, asked = similar.gram_sets(table(spark, other), table(spark, some))
    found = [(r["s"], r["other"]) for r in similar.candidates(asked, known, t).collect()]
    want = [(a, b) for a in some for b in other if near(a, b) >= t and near(a, b) > 0]
    assert sorted(found) == sorted(want)


@pytest.mark.parametrize(("itself", "few"), [(True, 0), (False, 0), (False, 1000)])
def test_nearest(spark, monkeypatch, itself, few):
    monkeypatch.setattr(similar, "FEW", few)
    values = strings(3, 90)
    found = {}
    for r in similar.nearest(table(spark, values), table(spark, values), 3, itself).withColumn("x", similar.similarity()).collect():
        found.setdefault(r["s"], []).append((-round(r["x"], 9), r["other"]))
    for a in values:
        want = sorted((-round(near(a, b), 9), b) for b in values if near(a, b) > 0 and (itself or a != b))
        assert sorted(found.get(a, []))[:3] == want[:3]


def test_a_frequent_trigram_makes_no_pairs(spark):
    """All names share a word; pairs are made of the rare rest, and their number doesn't grow with the square."""
    made = []
    for n in (200, 400):
        values = [f"common service {i:05d}{i * 7919 % 99991:05d} {i * 104729 % 99991:05d}" for i in range(n)]
        known, asked = similar.gram_sets(table(spark, values), table(spark, values))
        made.append(similar.candidates(asked, known, 0.8).count())
    assert made == [200, 400]


def like(text, fragment):
    return re.search("".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in fragment.lower()), text.lower(), re.S) is not None


def test_containing(spark):
    symbols = list(enumerate([*strings(4, 60), "a%b", "a_b", "back\\slash", "new\nline", "ab"])) + [(900, None), (901, "Order"), (902, "Order")]
    fragments = list(enumerate(["order", "ORD", "r_e", "o%e", "er s", "%", "_", "___", "", "a%b", "x", "é", "q", "h\\s", "w\nl", "order%service", "nothing", "_x", "%%__"])) + [(50, None), (51, "order")]
    got = similar.containing(spark.createDataFrame(symbols, "id long, symbol string"), spark.createDataFrame(fragments, "query_id long, fragment string"), 4)
    found = {}
    for r in got.collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["id"], r["score"]))
    for q, fragment in fragments:
        want = sorted((-round(near(s, fragment), 6), i) for i, s in symbols if fragment is not None and s is not None and like(s, fragment))[:4]
        assert [(i, x) for _, i, x in sorted(found.get(q, []))] == [(i, -x) for x, i in want], fragment


def test_symbols_of_one_partition_are_dealt_over_tasks(spark, monkeypatch):
    kept, before = [], similar.checkpointed
    monkeypatch.setattr(similar, "DEALT", 2)
    monkeypatch.setattr(similar, "checkpointed", lambda df: (kept.append(before(df)), kept[-1])[1])
    symbols = spark.createDataFrame([(i, f"name{i}") for i in range(60)], "id long, symbol string").coalesce(1)
    found = similar.containing(symbols, spark.createDataFrame([(1, "ame7")], "query_id long, fragment string"), 4)
    assert [r["id"] for r in found.collect()] == [7]
    assert kept[0].rdd.getNumPartitions() == 30
