"""Project scans, compile errors, upgrades, commands, retention and graph shapes."""

import datetime
import re

import pytest
from pyspark.sql import functions as F

from plumbline import plans
from plumbline.operators import control, rules

SMALL = "/root/testdata/sf0.001"

SOURCES = {
    "a/Old.java": "package a;\nimport javax.xml.ws.soap.SOAPFault;\nimport javax.annotation.processing.Filer;\nimport java.util.List;\nimport javax.xml.rpc.Call;\nimport javax.validation.Valid;\nclass Old extends WebMvcConfigurerAdapter {}",
    "b/New.java": "package b;\nimport java.util.List;\nclass New {}",
    "c/Client.java": "import org.apache.http.client.HttpClient;\nclass Client {}",
    "d/Gone.java": None,
    "e/Empty.java": "",
}


def test_scan_sources(spark):
    files = spark.createDataFrame(list(SOURCES.items()), "path string, content string")
    got = {r["path"]: r for r in rules.scan_sources(files).collect()}
    assert sorted(got) == ["a/Old.java", "c/Client.java"]
    old = got["a/Old.java"]
    assert [(x["name"], x["prefix"], x["successor"]) for x in old["removed"]] == [("javax.xml.ws.soap.SOAPFault", "javax.xml.ws.soap", "jakarta.xml.ws.soap"), ("javax.xml.rpc.Call", "javax.xml.rpc", None)]
    assert [x["name"] for x in old["mapped"]] == ["javax.xml.ws.soap.SOAPFault", "javax.validation.Valid"]
    assert old["legacy"] == ["javax.xml.ws.soap.SOAPFault", "javax.xml.rpc.Call", "javax.validation.Valid"]
    assert old["breaking"] == ["SPRING6_WEBMVC_CONFIGURER_ADAPTER"]
    assert (got["c/Client.java"]["removed"], got["c/Client.java"]["legacy"], got["c/Client.java"]["breaking"]) == ([], [], ["HTTPCLIENT4_LEGACY"])
    assert rules.scan_sources(files.limit(0)).count() == 0


def test_details_with_a_full_width_colon(spark):
    text = ["[ERROR] /a/B.java:[3,4] 找不到符号", "[ERROR]   符号：类 Foo", "  位置: 程序包 x", "[NOTE]  symbol: class No", "[WARNING] location： package y"]
    lines = spark.createDataFrame([("l", i, t) for i, t in enumerate(text)], "log string, n int, line string")
    (row,) = rules.compile_errors(lines, "log", "n", "line").collect()
    assert row["details"] == ["符号：类 Foo", "位置: 程序包 x", "location： package y"] and row["message"] == "找不到符号"


def test_compile_errors(spark):
    text = "[INFO] start\n[ERROR] /src/A.java:[12,7] cannot find symbol\n[ERROR]   symbol:   class B\n  location: class A\nnoise\n/src/C.java:[3,1] 找不到符号\n  符号:   类 D"
    lines = spark.createDataFrame([(1, text), (2, "no error")], "log long, t string").select("log", F.posexplode(F.split("t", "\n")).alias("n", "line"))
    got = [tuple(r) for r in rules.compile_errors(lines, "log", "n", "line").orderBy("block").collect()]
    assert got == [(1, 1, "/src/A.java", 12, 7, "cannot find symbol", ["symbol:   class B", "location: class A"]), (1, 2, "/src/C.java", 3, 1, "找不到符号", ["符号:   类 D"])]


def test_tasks_of_compile_errors_are_bounded(spark, monkeypatch):
    """Lines are dealt by their number, once, and not by the number of cores."""
    monkeypatch.setattr(plans.project, "LINES", 100)
    for name in ("compile_errors", "project_scan"):
        plan = plans.QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
        dealt = re.findall(r"Exchange hashpartitioning\(l_orderkey#\d+L, (\d+)\), REPARTITION_BY_NUM", plan)
        assert dealt and {int(n) for n in dealt} == {-(-spark.read.parquet(f"{SMALL}/lineitem.parquet").count() // 100)}
        assert name == "project_scan" or plan.count("Exchange") == 1


def test_versions(spark):
    pairs = [("3.5", "3.5.16", "upgrade"), ("v3.5.16", None, "keep"), ("3.10.0", None, "keep"), ("2.7.18-RELEASE", None, "upgrade"), ("${boot}", None, "none"), (None, None, "none"), ("3.5.16.1", None, "keep")]
    df = spark.createDataFrame([(i, v) for i, (v, _, _) in enumerate(pairs)], "i int, v string")
    assert [r["x"] for r in df.select("i", rules.parent_upgrade(F.col("v")).alias("x")).orderBy("i").collect()] == [x for _, _, x in pairs]


def test_dependencies(spark):
    rows = spark.createDataFrame([("g", "old", "1.0"), ("g", "low", "1.9"), ("g", "fine", "2.0"), ("h", "low", None)], "grp string, artifact string, version string")
    renames = spark.createDataFrame([("g", "old", "n", "new")], "grp string, artifact string, new_grp string, new_artifact string")
    bumps = spark.createDataFrame([("g", "low", "1.10"), ("n", "new", "1.0"), ("g", "fine", "1.5")], "grp string, artifact string, least string")
    got = {r["artifact"] + r["grp"]: (r["new_grp"], r["new_artifact"], r["new_version"], r["change"]) for r in rules.dependency_changes(rows, renames, bumps).collect()}
    assert got == {"oldg": ("n", "new", "1.0", "rename"), "lowg": ("g", "low", "1.10", "bump"), "fineg": ("g", "fine", "2.0", "keep"), "lowh": ("h", "low", None, "keep")}
    needed = spark.createDataFrame([(1, "g", "a"), (1, "g", "a"), (1, "g", "b"), (2, "g", "a")], "project long, grp string, artifact string")
    first = rules.artifacts_to_add(needed, needed.where("artifact = 'b'"), "project")
    assert sorted(tuple(r) for r in first.collect()) == [(1, "g", "a"), (2, "g", "a")]
    assert rules.artifacts_to_add(needed, needed.where("artifact = 'b'").union(first), "project").count() == 0


def test_refusals(spark):
    df = spark.createDataFrame([(True, None, True), (False, False, False)], "a boolean, b boolean, c boolean")
    got = df.select(rules.refusals(no_patch=F.col("a"), workspace_gone=F.col("b"), task_not_succeeded=F.col("c")).alias("x")).collect()
    assert [r["x"] for r in got] == [["TASK_NOT_SUCCEEDED", "NO_PATCH"], []]
    with pytest.raises(ValueError):
        rules.refusals(other=F.lit(True))


def test_commands(spark):
    cases = [
        ("WAITING_HUMAN", "approve_plan", False, 0, "accepted", "PENDING"), ("WAITING_HUMAN", "approve_plan", True, 0, "conflict", "WAITING_HUMAN"), ("WAITING_HUMAN", "approve_gate", True, 0, "accepted", "PENDING"),
        ("WAITING_HUMAN", "reject_gate", True, 1, "conflict", "WAITING_HUMAN"), ("WAITING_HUMAN", "reject_gate", None, 0, "conflict", "WAITING_HUMAN"), ("RUNNING", "cancel", False, 0, "accepted", "RUNNING"),
        ("SUCCEEDED", "cancel", False, 0, "conflict", "SUCCEEDED"), ("FAILED", "retry", False, 0, "accepted", "PENDING"), ("RUNNING", "delete", False, 0, "conflict", "RUNNING"), ("SUCCEEDED", "delete", False, 0, "accepted", "DELETED"),
    ]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, s string, c string, g boolean, n int, o string, a string")
    outcome, after = control.command_outcome(F.col("s"), F.col("c"), F.col("g"), F.col("n"))
    assert [(r["x"], r["y"]) for r in df.select("i", outcome.alias("x"), after.alias("y")).orderBy("i").collect()] == [c[4:] for c in cases]


def test_sweep(spark):
    day = lambda n: datetime.datetime(2024, 1, n)
    folders = spark.createDataFrame([("run", 1, day(1)), ("old", 2, day(1)), ("new", 3, day(1)), ("orphan", 9, day(2)), ("young", None, day(20))], "name string, task_id long, modified timestamp")
    tasks = spark.createDataFrame([(1, "RUNNING", None), (2, "FAILED", day(3)), (3, "SUCCEEDED", day(18))], "task_id long, status string, ended timestamp")
    found = control.sweep(folders, tasks, F.lit(day(21)), 7)
    assert {r["name"]: r["decision"] for r in found.collect()} == {"run": "active", "old": "delete", "new": "keep", "orphan": "delete", "young": "keep"}
    assert tuple(control.sweep_counts(found).first()) == (5, 2, 2, 1, 2)


def test_resets_and_cascades(spark):
    tables = {"a": spark.range(3), "b": spark.range(2)}
    for dry in (True, False):
        left, counts = control.emptied(tables, dry)
        assert sorted(tuple(r) for r in counts.collect()) == ([("a", 3, 3), ("b", 2, 2)] if dry else [("a", 3, 0), ("b", 2, 0)])
        assert left["a"].count() == (3 if dry else 0)
    kept, lost = control.cascade(spark.range(2), "id", {"a": (tables["a"], "id"), "b": (tables["b"], "id")})
    assert [r["id"] for r in kept["a"].collect()] == [2] and sorted(tuple(r) for r in lost.collect()) == [("a", 2), ("b", 2)]


def test_plan_shape(spark):
    tasks = spark.createDataFrame([(1, True, True), (2, False, False), (3, True, False)], "task long, with_pom boolean, with_gate boolean")
    files = spark.createDataFrame([(1, "x"), (1, "y"), (1, "y"), (2, "z")], "task long, file string")
    got = {}
    for r in control.plan_shape(tasks, files, "task").collect():
        got.setdefault(r["task"], set()).add((r["src"], r["dst"]))
    assert got[1] == {("ANALYZE", "PLAN"), ("PLAN", "POM"), ("POM", "REWRITE:x"), ("POM", "REWRITE:y"), ("REWRITE:x", "GATE"), ("REWRITE:y", "GATE"), ("GATE", "VERIFY")}
    assert got[2] == {("ANALYZE", "PLAN"), ("PLAN", "REWRITE:z"), ("REWRITE:z", "VERIFY")} and got[3] == {("ANALYZE", "PLAN"), ("PLAN", "POM"), ("POM", "VERIFY")}


def test_retry_after_verify(spark):
    rows = [
        (1, "REWRITE", "a", 1, "SUCCEEDED", True), (1, "REWRITE", "b", 1, "SUCCEEDED", False), (1, "VERIFY", None, 1, "FAILED", None), (1, "VERIFY", None, 2, "PENDING", None),
        (2, "REWRITE", "a", 1, "SUCCEEDED", False), (2, "REWRITE", "b", 3, "SUCCEEDED", False), (2, "VERIFY", None, 1, "FAILED", None),
        (3, "REWRITE", "a", 1, "SUCCEEDED", True), (3, "VERIFY", None, 1, "FAILED", None), (3, "VERIFY", None, 2, "SUCCEEDED", None),
    ]
    nodes = spark.createDataFrame(rows, "task long, kind string, file string, attempt int, status string, legacy boolean")
    got = sorted((tuple(r) for r in control.after_failed_verify(nodes, "task", 3).collect()), key=str)
    assert got == [(1, "rewrite", "a", 2), (1, "skip", None, 2), (1, "verify", None, 2), (2, "rewrite", "a", 2), (2, "verify", None, 2)]


def test_replay(spark):
    rows = [(1, "p", "REWRITE", 1, "SUCCEEDED", "x"), (1, "p", "REWRITE", 2, "SUCCEEDED", "y"), (1, "p", "REWRITE", 3, "FAILED", "z"), (1, "q", "PARENT", 1, "SUCCEEDED", "last"), (1, "q", "DEPENDENCY", 5, "SUCCEEDED", "before"), (1, "r", "POM", 1, "FAILED", "none")]
    results = spark.createDataFrame(rows, "task long, path string, kind string, attempt int, status string, text string")
    assert {r["path"]: r["text"] for r in control.replayed(results, "task", "path").collect()} == {"p": "y", "q": "last"}


def test_reasons_of_plans(spark):
    steps = [("p", 2, "a\\B.java", "later"), ("p", 1, "A/b.JAVA", "first"), ("p", 1, "c", " "), ("p", 2, "c", "too late"), ("p", 3, None, "x"), ("p", 4, " ", "x"), ("q", 1, "d", "other project")]
    removed = [("p", "C", "sun.misc"), ("p", "c", "javax.xml"), ("p", "c", "sun.misc"), ("p", "e", None)]
    targets = [("p", "a/b.java"), ("p", "c"), ("p", "d"), ("p", "e"), ("p", "f"), ("q", "D")]
    frame = lambda rows, kind: spark.createDataFrame(rows, kind)
    found = rules.enriched(
        frame(targets, "project string, path string"), frame(steps, "project string, n int, path string, rationale string"), frame(removed, "project string, path string, flag string"),
        frame([("p", "d"), ("p", "D"), ("p", "c")], "project string, path string"), frame([("p", "d"), ("p", "e")], "project string, path string"),
    ).collect()
    assert sorted((r["project"], r["path"], r["reason"], r["detail"]) for r in found) == [
        ("p", "a/b.java", "model", "first"), ("p", "c", "removed", "javax.xml, sun.misc"), ("p", "d", "legacy", None), ("p", "e", "breaking", None), ("p", "f", "unexplained", None), ("q", "D", "model", "other project"),
    ]


def test_java_levels(spark):
    rows = [("a", "1.8"), ("a", "17"), ("b", "21"), ("b", "${x}"), ("c", "${x}"), ("d", None), ("e", "17.0.1")]
    found = rules.level_upgrade(spark.createDataFrame(rows, "pom string, level string"), "pom", "level", 17).collect()
    assert sorted(map(tuple, found)) == [("a", 8, "upgrade"), ("b", 21, "keep"), ("c", None, "unknown"), ("d", None, "add"), ("e", 17, "keep")]
