"""The kept full-text index against plain counting, over updates, removals and compaction."""

import random
import re
from collections import Counter

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from plumbline.operators import fulltext, retrieval
from plumbline.operators.fulltext import TextIndex, index_of

KIND = "id long, text string"
DOCS = {1: "The cat sat on the mat.", 2: "a cat; a DOG", 3: "dog_house dog", 4: "", 5: None, 6: "x yy zz yy", 7: "ärger cat-dog 42"}


def counted(docs):
    return {i: Counter(w.lower() for w in re.findall("[A-Za-z0-9_]+", t or "") if len(w) > 1) for i, t in docs.items()}


def expected(docs):
    return sorted((t, i, n) for i, c in counted(docs).items() for t, n in c.items())


@pytest.fixture
def index(spark, tmp_path):
    return TextIndex(spark, str(tmp_path / "index"), buckets=5, spread=2)


def table(spark, docs):
    return spark.createDataFrame(list(docs.items()), KIND)


def held(spark, index, terms=None):
    terms = spark.createDataFrame([(t,) for t in terms or sorted({t for t, _, _ in expected(DOCS)} | {"new", "nothing"})], "term string")
    return sorted((r["term"], r["id"], r["tf"]) for r in index.postings(terms).collect())


def test_build_and_read(spark, index):
    assert held(spark, index) == [] and index.generation() == -1
    index.build(table(spark, DOCS))
    assert held(spark, index) == expected(DOCS)
    assert held(spark, index, ["cat", "nothing"]) == [x for x in expected(DOCS) if x[0] == "cat"]


def test_updates_of_single_documents(spark, index):
    index.build(table(spark, DOCS))
    docs = DOCS | {2: "new dog", 8: "new cat"}
    index.update(table(spark, {2: "new dog", 8: "new cat"}))
    assert held(spark, index) == expected(docs)
    index.update(table(spark, {2: "cat cat cat"}))
    index.remove(table(spark, {1: None, 99: None}))
    docs = {i: t for i, t in (docs | {2: "cat cat cat"}).items() if i != 1}
    assert held(spark, index) == expected(docs)
    index.update(table(spark, {1: "the cat is back"}))  # a removed id may come again
    docs[1] = "the cat is back"
    assert held(spark, index) == [x for x in expected(docs) if x[0] not in ("is", "back")]
    assert len(index.compact()._postings.folders()) == 1 and held(spark, index) == [x for x in expected(docs) if x[0] not in ("is", "back")]
    index.update(table(spark, {3: "after"}))
    assert not [x for x in held(spark, index) if x[1] == 3]


def test_a_generation_that_fails_halfway_is_not_read(spark, index):
    index.build(table(spark, DOCS))
    bad = table(spark, {1: "new", 2: "new"}).withColumn("text", F.when(F.col("id") == 2, F.raise_error(F.lit("disk"))).otherwise(F.col("text")))
    with pytest.raises(PySparkException):
        index.update(bad)
    assert held(spark, index) == expected(DOCS)
    index._gone.write(spark.createDataFrame([(1, 1)], "id long, before int"), 1)  # as if its postings had failed
    assert held(spark, index) == expected(DOCS)


def test_only_the_buckets_of_the_terms_are_read(spark, index):
    index.build(table(spark, DOCS))
    plan = index.postings(spark.createDataFrame([("cat",)], "term string"))._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ (=|IN)", plan) and re.search(r"PushedFilters: \[[^\]]*(EqualTo\(term,cat\)|In\(term)", plan)


def test_search_equals_a_scan(spark, index):
    docs = table(spark, DOCS | {8: "cat " * 50, 9: "the the the"})
    queries = spark.createDataFrame([(1, "Cat dog"), (2, "the"), (3, ""), (4, None), (5, "nothing")], "query_id long, text string")
    found = index.build(docs).search(queries, 3)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, retrieval.keyword_arm(docs, queries, 3).collect())) != []


def test_the_index_of_a_table_is_built_anew_once_its_files_change(spark, tmp_path):
    path = str(tmp_path / "docs")
    table(spark, DOCS).write.parquet(path)
    read = lambda: index_of(spark.read.parquet(path), "t", ("id", "text"))
    first = read()
    assert held(spark, first, ["cat"]) == [x for x in expected(DOCS) if x[0] == "cat"] and read().path == first.path
    table(spark, {8: "cat"}).write.mode("append").parquet(path)
    assert held(spark, read(), ["cat"]) == [x for x in expected(DOCS | {8: "cat"}) if x[0] == "cat"] and read().path != first.path


@pytest.mark.parametrize("kind", ["long", "string"])
def test_search_by_words_makes_no_row_for_each_query_and_document(spark, monkeypatch, kind):
    """Blocks of queries and of documents against brute force; a task gives n documents of each query at most."""
    r = random.Random(8)
    docs = {i: r.choices("abcdefgh", k=r.randint(0, 9)) for i in range(120)}
    asked = {q: set(r.choices("abcdefghz", k=r.randint(1, 5))) for q in range(7)}
    postings = spark.createDataFrame([(i, w, x.count(w)) for i, x in docs.items() for w in set(x)], "id long, term string, tf long").withColumn("id", F.col("id").cast(kind))
    terms = spark.createDataFrame([(q, w) for q, x in asked.items() for w in x], "query_id long, q string")
    monkeypatch.setattr(retrieval, "DOCUMENT_BLOCK", 16)
    given, before = [], retrieval.ranked
    monkeypatch.setattr(retrieval, "ranked", lambda df, *args: (given.append(df.count()), before(df, *args))[1])
    found = {}
    for row in retrieval.best_by_words(postings, terms, 3, block=3).collect():
        found.setdefault(row["query_id"], []).append((row["rank"], row["id"], row["score"]))
    for q, words in asked.items():
        scores = [(-round(sum(x.count(w) / (x.count(w) + 1) for w in words), 6), i if kind == "long" else str(i)) for i, x in docs.items() if words & set(x)]
        assert [(i, x) for _, i, x in sorted(found.get(q, []))] == [(i, pytest.approx(-x, abs=1e-9)) for x, i in sorted(scores)[:3]]
    assert len(given) == 3 and sum(given) <= 3 * 7 * 4
    assert retrieval.best_by_words(postings, terms.limit(0), 3).count() == 0 and retrieval.best_by_words(postings.limit(0), terms, 3).count() == 0


def test_tasks_of_an_index_grow_in_number_and_not_in_size(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(i, f"common word{i} word{i + 1}") for i in range(400)], "id long, text string")
    monkeypatch.setattr(fulltext, "SORTED", 100)
    index = fulltext.TextIndex(spark, str(tmp_path / "many"), buckets=2).build(docs)
    files = [r["f"] for r in spark.read.parquet(f"{index._postings.path}/batch=0").select(F.input_file_name().alias("f")).distinct().collect()]
    assert len(files) > 30  # two tasks wrote all of it before
    asked = spark.createDataFrame([("common",), ("word7",)], "term string")
    assert sorted((r["term"], r["id"], r["tf"]) for r in index.postings(asked).collect()) == sorted([("common", i, 1) for i in range(400)] + [("word7", 6, 1), ("word7", 7, 1)])
