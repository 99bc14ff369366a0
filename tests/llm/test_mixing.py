"""Mixing against the plain iteration of targets, and cuts near them."""

import random

import pytest
from plumbline.llm import mixing


def slow_targets(sizes, weights=(5, 2, 1), cap=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    full, total = set(), sum(sizes.values())
    while True:
        left, open_ = total - sum(cap * sizes[s] for s in full), [s for s in names if s not in full]
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_} if open_ else {}
        over = {s for s in open_ if share[s] > cap * sizes[s]}
        if not over:
            return {s: float(cap * sizes[s]) if s in full else share[s] for s in names}
        full |= over


def test_targets(spark):
    r = random.Random(6)
    for n in (1, 2, 5, 12):
        sizes = {f"s{i:02}": r.choice([1, 10, 100, 5000]) for i in range(n)} | ({None: 7} if n > 2 else {})
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {x["source"]: x["target"] for x in mixing.targets(df).collect()}
        assert got == pytest.approx(slow_targets(sizes))


def test_mix(spark, documents, odd):
    r = random.Random(7)
    data = [(i, " ".join("w" * 1 for _ in range(r.randint(0, 40))) or None, r.choice(["a", "a", "a", "b", "c", None])) for i in range(600)]
    df = documents(data, extra=True)
    rows = mixing.mixed(df.select("doc_id", "text", "source"), mixing.plan(df)).collect()
    sizes, taken = {}, {}
    for x in rows:
        size = len((x["text"] or "").split())
        assert 0 <= x["copies"] <= 3
        sizes[x["source"]] = sizes.get(x["source"], 0) + size
        taken[x["source"]] = taken.get(x["source"], 0) + size * x["copies"]
    for s, target in slow_targets(sizes).items():
        assert abs(taken[s] - target) <= 40 / 2  # at most half the document on the cut is off
    again = mixing.mixed(df.select("doc_id", "text", "source").repartition(3), mixing.plan(df.repartition(5))).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, again))
    out = mixing.repeated(df)
    assert out.columns == df.columns and out.count() == sum(x["copies"] for x in rows)
    assert mixing.repeated(df.limit(0)).count() == 0
    named = mixing.mixed(documents(odd, extra=True), mixing.plan(documents(odd))).select("doc_id", "target", "copies")
    assert named.where("target >= 0").count() == len(odd)
    empty = documents([(1, "", "a"), (2, None, "b")])
    assert [x["copies"] for x in mixing.mixed(empty, mixing.plan(empty)).collect()] == [0, 0]
