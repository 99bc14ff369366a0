"""Expected values of small fixtures, for the library's operators."""

import json
import os

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from plumbline.functions import json as J
from plumbline.functions import text as T
from plumbline.operators import evaluation, graphs, retrieval, rules, store, traces, windows
from plumbline.sources import files


def one(spark, column, **values):
    return spark.createDataFrame([Row(**values)]).select(column.alias("x")).first()["x"]


def test_query_text(spark):
    path = "com.example.legacy/LegacyCustomerOrders.java#revenueByMonth"
    assert one(spark, T.query_terms(F.col("t")), t=path) == ["com", "example", "legacy", "LegacyCustomerOrders", "java", "revenueByMonth"]
    assert one(spark, T.query_terms(F.col("t")), t="Foo bar Foo") == ["Foo", "bar"]
    assert one(spark, T.query_terms(F.col("t")), t="T i order a") == ["order"]
    assert one(spark, T.or_query(T.query_terms(F.col("t"))), t="OrderService#getStatus") == "OrderService | getStatus"
    assert one(spark, T.or_query(T.query_terms(F.col("t"))), t="!") is None
    for text in (path, "a\\b\\LegacyCustomerOrders.java", "x.y.LegacyCustomerOrders"):
        assert one(spark, T.symbol_fragment(F.col("t")), t=text) == "LegacyCustomerOrders"


def test_small_texts(spark):
    assert [one(spark, T.token_estimate(F.col("t")), t=t) for t in ("", "12345678", "123456789")] == [0, 2, 3]
    assert [one(spark, T.duration_text(F.col("t")), t=t) for t in (750, 2400, 83_000, 9_180_000)] == ["750 ms", "2.4 s", "1m 23s", "2h 33m"]
    assert [one(spark, T.key_suffix(F.col("t")), t=t) for t in ("rewrite:a:b", "plan", "x:")] == ["a:b", None, None]
    assert [one(spark, T.java_major(F.col("t")), t=t) for t in ("1.8", "17.0.2", "21", "${v}")] == [8, 17, 21, None]
    assert one(spark, T.short_name(F.col("t")), t="node:src/main/A.java") == "node: A.java"
    assert one(spark, T.backoff_ms(F.col("t")), t=9) == 16_000
    diff = "--- a\n+++ b\n@@ -1 +1 @@\n-old\n+new\n same"
    assert one(spark, F.array(*T.diff_stat(F.col("t"))), t=diff) == [1, 1]
    assert one(spark, T.diff_side(F.col("t"), True), t=diff) == "new\n same".replace(" same", "same")


def test_json():
    assert J.balanced('x {bad} {"a": "}{"} {"k": {"b": 1}} y', ("k",)) == '{"k": {"b": 1}}'
    assert J.balanced("{" * 200) is None


SPANS = [
    (1, "submit", "s1", None, "api:POST /api/tasks", 0, 208), (2, "first", "c1", None, "task", 280_000, 649), (3, "rerun", "r1", None, "task", 9_150_000, 77_025),
    (4, "rerun", "r2", "r1", "node:analyze", 9_150_100, 7331), (5, "rerun", "r3", "r1", "node:plan", 9_158_000, 5602), (6, "rerun", "r4", "r3", "llm:PLAN", 9_158_100, 5214),
    (7, "rerun", "r5", "r1", "node:rewrite", 9_164_000, 53_967), (8, "rerun", "r6", "r5", "llm:REWRITE", 9_164_100, 53_241),
    (9, "rerun", "r7", "r1", "node:verify", 9_218_000, 5636), (10, "rerun", "r8", "r7", "sandbox:mvn", 9_218_100, 5425),
]


def test_traces(spark):
    df = spark.createDataFrame(SPANS, "id long, trace string, span string, parent string, name string, start_ms long, took long").withColumn("end_ms", F.col("start_ms") + F.col("took"))
    deep = traces.depths(df, "trace", "span", "parent")
    assert {r["span"]: r["depth"] for r in deep.collect()} == {"s1": 0, "c1": 0, "r1": 0, "r2": 1, "r3": 1, "r4": 2, "r5": 1, "r6": 2, "r7": 1, "r8": 2}
    runs = {r["trace"]: r for r in traces.runs(deep, ["trace"]).collect()}
    assert {k: r["spans"] for k, r in runs.items()} == {"submit": 1, "first": 1, "rerun": 8}
    assert sum(r["duration_ms"] for r in runs.values()) == 208 + 649 + 77_025 and runs["rerun"]["root_name"] == "task"
    opened = traces.runs(deep.withColumn("end_ms", F.when(F.col("id") != 10, F.col("end_ms"))), ["trace"]).where("trace = 'rerun'").first()
    assert opened["ended"] is None and opened["duration_ms"] == 0
    slow = traces.slowest(deep.withColumn("total", F.lit(77_025)), ["trace"], "took", "depth", "total").where("trace = 'rerun'").first()
    assert slow["id"] == 7


def test_cycles_and_orphans_end(spark):
    rows = [("t", "a", "b"), ("t", "b", "a"), ("t", "o", "x"), ("u", "c", "a"), ("t", "own", "own"), ("t", "tail", "a"), ("t", "end", "tail")]
    chain = [("v", f"n{i}", f"n{i - 1}" if i else None) for i in range(20)]
    df = spark.createDataFrame([*rows, *chain], "trace string, span string, parent string")
    got = {r["span"]: r["depth"] for r in traces.depths(df, "trace", "span", "parent").collect()}
    assert {k: got[k] for _, k, _ in rows} == {"a": 1, "b": 1, "o": 0, "c": 0, "own": 0, "tail": 2, "end": 3}
    assert [got[f"n{i}"] for i in range(20)] == [min(i, 16) for i in range(20)]


def test_fusion(spark):
    arm = lambda ids: spark.createDataFrame([(1, k, i) for i, k in enumerate(ids, 1)], "query_id long, id string, rank int")
    got = retrieval.fused({"vector": arm(["a", "b"]), "symbol": arm(["b", "c"])}).orderBy(F.desc("score")).collect()
    assert [r["id"] for r in got] == ["b", "a", "c"]
    assert got[0]["sources"] == "vector+symbol" and got[0]["score"] == pytest.approx(1 / 62 + 1 / 61)


def test_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0]), (4, [0.0, 0.0]), (5, None), (6, [1.0])], "id long, vector array<double>")
    got = retrieval.vector_arm(df, df.where("id = 1").withColumnRenamed("id", "query_id"), 5).orderBy("rank").collect()
    assert [(r["id"], r["distance"]) for r in got] == [(1, 0.0), (3, 0.292893), (2, 1.0)]
    assert retrieval.vector_arm(df.limit(0), df.limit(0).withColumnRenamed("id", "query_id")).count() == 0
    every = retrieval.vector_arm(df, df.withColumnRenamed("id", "query_id"), 5)
    assert {r["query_id"] for r in every.collect()} == {1, 2, 3, 6}  # null and zero queries have none


def test_vectors_of_several_lengths_in_blocks(spark):
    import numpy as np

    r = np.random.default_rng(3)
    data = [(i, [float(x) for x in r.integers(-2, 3, 2 + i % 2)]) for i in range(200)] + [(200, None), (201, [1.0, None]), (202, [])]
    df = spark.createDataFrame(data, "id long, vector array<double>").repartition(3)
    want = set()
    usable = {i: np.array(v) for i, v in data if v and None not in v and any(v)}
    for q, v in usable.items():
        near = sorted((round(float(1 - v @ w / np.linalg.norm(v) / np.linalg.norm(w)), 6) + 0.0, i) for i, w in usable.items() if len(w) == len(v))
        want |= {(q, i, d, k) for k, (d, i) in enumerate(near[:4], 1)}
    for block in (1000, 40):
        got = retrieval.vector_arm(df, df.withColumnRenamed("id", "query_id"), 4, block=block).collect()
        assert {tuple(x) for x in got} == want and len(got) == len(want)
    assert one(spark, T.cosine_distance(F.col("a"), F.col("b")), a=[1.0, 0.0], b=[1.0]) is None


def test_expansion(spark):
    links = spark.createDataFrame([("A", "B"), ("B", "C"), ("C", "D"), ("A", "A")], "src string, dst string")
    seeds = spark.createDataFrame([("A",)], "node string")
    for depth, want in ((0, set()), (1, {"B"}), (2, {"B", "C"}), (3, {"B", "C", "D"})):
        assert {r["node"] for r in graphs.expand(links, seeds, depth).collect()} == want


def test_readiness_and_levels(spark):
    nodes = spark.createDataFrame([(1, 1, [], "SUCCEEDED"), (1, 2, [1], "PENDING"), (1, 3, [2], "PENDING"), (1, 4, [99], "PENDING"), (1, 5, None, "PENDING")], "task long, id long, needs array<long>, status string")
    assert {r["id"] for r in graphs.runnable(nodes, "task", "id", "needs", "status").collect()} == {2, 5}
    done = nodes.where("status = 'SUCCEEDED'")
    assert {r["id"] for r in store.divide(nodes.where("status = 'PENDING'"), "id", "needs", done, "id").collect()} == {2, 5}
    found = graphs.levels(nodes, graphs.edges(nodes, "id", "needs", "task"), "task", "id")
    assert {r["id"]: r["level"] for r in found.collect()} == {1: 0, 2: 1, 3: 2, 4: 0, 5: 0}
    loop = spark.createDataFrame([(1, 1, [2]), (1, 2, [1])], "task long, id long, needs array<long>")
    with pytest.raises(ValueError):
        graphs.levels(loop, graphs.edges(loop, "id", "needs", "task"), "task", "id")


def test_evaluation(spark):
    rows = [("a", "SUCCEEDED", "SUCCEEDED", None), ("b", "FAILED", "SUCCEEDED", None), ("c", "SUCCEEDED", None, None), ("d", "SUCCEEDED", "SUCCEEDED", "boom")]
    runs = spark.createDataFrame(rows, "case string, expect string, status string, harness_error string")
    got = evaluation.overview(runs).first()
    assert (got["total"], got["usable"], got["harness_errors"], got["as_expected"], got["positive_success"], got["negative_caught"]) == (4, 2, 2, 0.5, 1.0, 0.0)
    assert "no sample" in evaluation.markdown(evaluation.overview(runs.limit(0)))
    weighted = spark.createDataFrame([(50, 50), (1, 4), (9, 0)], "n int, d int").agg(evaluation.weighted_rate(F.col("n"), F.col("d")).alias("x")).first()["x"]
    assert weighted == pytest.approx(51 / 54)
    values = spark.createDataFrame([(v,) for v in [1, 2, 3, 4, 5, 6, 7, 8, 9, 100, None]], "v int")
    got = evaluation.distribution_by(values.withColumn("g", F.lit(1)), ["g"], F.col("v")).first()
    assert (got["n"], got["median"], got["p90"], got["least"], got["most"]) == (10, 5, 9, 1, 100)


def test_budgets(spark):
    import random

    r = random.Random(11)
    for most in (1, 9, 40):
        rows = [(r.choice(["a", "b", None]), i, r.choice([0, 1, 2, 5, 9, 30])) for i in range(120)] + [("big", 1, 99), ("big", 2, 1), ("big", 3, 0)]
        df = spark.createDataFrame(rows, "grp string, p int, cost long").repartition(3)
        want, used = set(), {}
        for g, p, c in sorted(rows, key=lambda x: x[1]):
            if g not in used or used[g] + c <= most:
                used[g] = used.get(g, 0) + c
                want.add((g, p, c))
        got = windows.greedy_budget(df, ["grp"], ["p"], "cost", most).collect()
        assert {tuple(x) for x in got} == want and len(got) == len(want)
    assert windows.greedy_budget(df.limit(0), ["grp"], ["p"], "cost", 5).count() == 0


def test_prefix_catalogues(spark):
    names = ["javax.xml.ws.soap.SOAPFault", "javax.xml.bind.JAXB", "javax.annotation.processing.Filer", "java.util.List", "javax.servlet"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    catalogue = spark.createDataFrame(rules.ARTIFACTS, "prefix string, artifact string")
    out = spark.createDataFrame([(x,) for x in rules.ARTIFACT_EXCLUSIONS], "prefix string")
    got = {r["name"]: r["artifact"] for r in rules.longest_prefix(df, "name", catalogue, "prefix", "artifact", excluded=out).collect()}
    assert got[names[1]].startswith("jakarta.xml.bind") and got[names[0]].startswith("jakarta.xml.ws") and got[names[4]].startswith("jakarta.servlet")
    assert got[names[2]] is None and got[names[3]] is None
    source = "package a;\nimport javax.xml.bind.JAXB;\nimport static java.util.List.of;\nimport javax.xml.bind.JAXB;"
    assert one(spark, rules.imports(F.col("t")), t=source) == ["javax.xml.bind.JAXB", "java.util.List.of"]


def test_breaking_rules(spark):
    text = "class A implements ResponseErrorHandler { void handleError(ClientHttpResponse r) {} }"
    assert one(spark, rules.rule_hits(F.col("t"), rules.BREAKING), t=text) == ["SPRING6_RESPONSE_ERROR_HANDLER"]
    assert one(spark, rules.rule_hits(F.col("t"), rules.BREAKING), t="ResponseErrorHandler") == []
    kinds = [rules.error_category(F.lit(b), F.lit(old), F.lit(test)) for b, old, test in (("cannot find symbol", True, False), ("cannot find symbol", False, True), ("package does not exist", False, True), ("eh", False, True), ("eh", False, False))]
    assert one(spark, F.array(*kinds), t=1) == ["JAKARTA_LEFTOVER", "API_SIGNATURE", "DEPENDENCY_UNRESOLVED", "TEST_SOURCE", "UNCLASSIFIED"]


def test_store(spark):
    now = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "id long, v string, n int")
    new = spark.createDataFrame([(2, "B", 1), (3, "c", 1)], "id long, v string, n int")
    assert sorted(tuple(r) for r in store.upsert(now, new, ["id"], "n").collect()) == [(1, "a", 0), (2, "B", 1), (3, "c", 1)]
    moved = store.compare_and_set(now, "v", "a", "z", F.col("id") < 3).orderBy("id").collect()
    assert [(r["v"], r["changed"]) for r in moved] == [("z", True), ("b", False)]
    assert [store.page_size(n) for n in (None, 0, 10, 1000)] == [50, 50, 10, 200]


def test_files(spark, tmp_path):
    for path, text in {"src/B.java": "b", "src/A.java": "a", "target/C.java": "c", "m/n/pom.xml": "x", "pom.xml": "y"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    assert [tuple(r) for r in files.java_files(spark, str(tmp_path)).collect()] == [("src/A.java", "a"), ("src/B.java", "b")]
    assert [r["path"] for r in files.pom_files(spark, str(tmp_path)).collect()] == ["pom.xml", "m/n/pom.xml"]
    for name, status in (("20250101-000000", "FAILED"), ("20250102-000000", "SUCCEEDED")):
        os.makedirs(tmp_path / "runs" / name)
        (tmp_path / "runs" / name / "runs.json").write_text(json.dumps([{"caseId": "a", "status": status, "metrics": {"testsTotal": 3}, "more": 1}]))
    got = files.latest_runs(spark, str(tmp_path / "runs")).first()
    assert got["status"] == "SUCCEEDED" and got["metrics"]["testsTotal"] == 3
    files.write_runs(files.latest_runs(spark, str(tmp_path / "runs")), str(tmp_path / "again"))
    assert spark.read.schema(files.RUN).json(str(tmp_path / "again")).first() == got
    reports = tmp_path / "r" / "surefire-reports"
    reports.mkdir(parents=True)
    (reports / "TEST-a.xml").write_text('<testsuite tests="4" failures="1" errors="0" skipped="1"><testcase name="m" classname="A"><failure>no</failure></testcase><testcase name="n" classname="A"/></testsuite>')
    (reports / "TEST-b.xml").write_text("broken")
    for depth, name in ((5, "near"), (6, "far")):  # with the report's folder and its name, 8 and 9 deep
        deep = tmp_path / "deep" / name / "/".join("abcdefg"[:depth]) / "surefire-reports"
        deep.mkdir(parents=True)
        (deep / "TEST-x.xml").write_text('<testsuite tests="1"><testcase name="m" classname="A"/></testsuite>')
    assert ["/near/" in r["path"] for r in files.test_suites(spark, str(tmp_path / "deep")).collect()] == [True]
    got = files.test_suites(spark, str(tmp_path / "r")).collect()
    assert [(r["total"], r["failed"], r["skipped"], r["passed"], r["failed_names"]) for r in got] == [(4, 1, 1, 2, ["A#m"])]
    (tmp_path / "cov.csv").write_text("G,P,C,a,b,c,d,LINE_MISSED,LINE_COVERED\nx,y,z,0,0,0,0,3,9\nshort,1\n")
    assert files.coverage(spark, str(tmp_path / "cov.csv")).first()["coverage"] == 0.75
    with pytest.raises(ValueError):
        files.checked_catalogue(spark.createDataFrame([("a",), ("a",)], "id string"), 1)


def test_dependency_neighbours_of_hubs(spark, monkeypatch):
    links = [(f"n{i}", f"n{i * 7 % 40}") for i in range(40)] + [(f"n{i}", f"n{i * i % 40 + 1}") for i in range(40)]
    links += [(hub, f"leaf{i:04}") for hub in ("n3", "n11") for i in range(2000)] + [(f"leaf{i:04}", "n5") for i in range(2000)]
    hits = [(q, f"n{(q * k) % 40}") for q in range(12) for k in (1, 3)]
    lead = {}
    for a, b in links:
        lead.setdefault(a, set()).add(b)

    def want(depth, top):
        for q in range(12):
            seen = edge = {i for p, i in hits if p == q}
            found = []
            for hop in range(1, depth + 1):
                edge = {b for a in edge for b in lead.get(a, ())} - seen
                seen = seen | edge
                found += sorted((hop, i) for i in edge)
            yield from ((q, i, hop) for hop, i in found[:top])

    kept = []
    monkeypatch.setattr(retrieval, "checkpointed", lambda df, keep=retrieval.checkpointed: (kept.append(keep(df)), kept[-1])[1])
    asked, over = spark.createDataFrame(hits, "query_id int, id string"), spark.createDataFrame(links, "src string, dst string")
    for depth, top in ((1, 5), (2, 40), (3, 7), (4, 100)):
        assert sorted(map(tuple, retrieval.dependency_neighbours(asked, over, depth, top).collect())) == sorted(want(depth, top))
        assert max(k.count() for k in kept) <= max(12 * top, len(hits))  # a hub's neighbours aren't kept whole
        kept.clear()
    monkeypatch.setattr(retrieval, "near", lambda df, rows=0: df)  # many nodes
    assert sorted(map(tuple, retrieval.dependency_neighbours(asked, over, 3, 7).collect())) == sorted(want(3, 7))
