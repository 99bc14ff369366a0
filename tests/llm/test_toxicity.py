"""Toxicity scores on rows that were not learnt."""

import glob
import os
import pickle
import random
import zlib

import numpy as np
import pytest
from plumbline.llm import queries, toxicity

TABLES = "/root/testdata/sf0.1"
RUDE = ["trashy", "wretched", "vermin", "dunce", "sloven", "grubber"]


def corpus(n=900, seed=1):
    """Invented prose; every sixth document has rude words."""
    r = random.Random(seed)
    parts = ["ta", "ren", "lo", "mi", "kes", "un", "dor", "pel", "si", "vo", "gra", "ne"]
    rows, labels = [], []
    for i in range(n):
        words = ["".join(r.choices(parts, k=r.randint(1, 3))) for _ in range(r.randint(20, 200))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(r.randint(3, 6)):
                words.insert(r.randrange(len(words)), r.choice(RUDE))
        rows.append((i, " ".join(words), "s"))
        labels.append((i, 1, int(toxic)))
    return rows, labels


LABELS = "doc_id long, quality int, toxic int"


def test_windows_cover_whole_texts():
    assert toxicity.windows("A b2c, Ünder_a\na") == {"a": 3, "b": 1, "c": 1, "ünder": 1}
    run = "".join(chr(97 + i % 26) for i in range(100))
    found = toxicity.windows(run)
    assert all(any(run[i : i + 12] in w for w in found) for i in range(0, 89)) and max(map(len, found)) == toxicity.WINDOW
    text = "ab " * (toxicity.CHUNK // 2)
    assert toxicity.windows(text) == {"ab": toxicity.CHUNK // 2}
    assert not toxicity.windows("") and not toxicity.windows(" 12 !?")


def test_doubled_bytes_differ():
    assert len({toxicity.doubled(bytes([b])) for b in range(256)}) == 256


def test_a_toxic_window_takes_fewer_bytes():
    r = random.Random(2)
    ordinary = ["".join(r.choices("etaoinshr", k=r.randint(2, 8))) for _ in range(3000)]
    made = toxicity.Dictionaries(ordinary, [(w, 9) for w in RUDE])
    assert min(made.margin(w) for w in RUDE) > max(made.margin(w) for w in ordinary)
    assert pickle.loads(pickle.dumps(made)).margin("vermin") == made.margin("vermin")


def test_scores_of_rows_not_learnt(spark, documents):
    rows, labels = corpus()
    docs = documents(rows, extra=True)
    model = toxicity.fit(docs, spark.createDataFrame(labels, LABELS))
    score = {r["doc_id"]: r["score"] for r in toxicity.scored(docs, model).collect()}
    held = [i for i in score if zlib.crc32(str(i).encode()) % 3 == 1]
    assert len(held) > 200 and all((score[i] >= toxicity.THRESHOLD) == (i % 6 == 0) for i in held)


def test_labels_of_held_out_rows_are_not_learnt(spark, documents):
    rows, labels = corpus(300)
    docs = documents(rows)
    other = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, q, t in labels]
    one, two = (toxicity.fit(docs, spark.createDataFrame(x, LABELS)) for x in (labels, other))
    assert one.dictionaries.toxic == two.dictionaries.toxic and (one.weights == two.weights).all()


def test_odd_rows(spark, documents, odd):
    rows, labels = corpus(300)
    odd = [(None if i is None else 10_000 + i, t, s) for i, t, s in odd] + [(20_000, "ta vermin " * 200_000, "s")]
    docs = documents(rows + odd, extra=True)
    messy = labels + [(0, 1, None), (None, 1, 1), (99_999, 1, 1), (6, 0, 1), (6, 1, 1)]
    found = toxicity.scored(docs, toxicity.fit(docs, spark.createDataFrame(messy, LABELS))).collect()
    assert len(found) == len(rows) + len(odd) and all(0 <= r["score"] <= 1 for r in found)
    by = {r["doc_id"]: r["score"] for r in found}
    assert by[20_000] > 0.7 and by[10_001] == by[10_002] == by[10_007] < 0.7


@pytest.mark.parametrize(("labels", "score"), [([], 0.0), ([(0, 1, 0)], 0.0), ([(0, 1, 1)], 1.0)])
def test_without_two_labels(spark, documents, labels, score):
    docs = documents([(0, "a b", "s"), (2, None, "s")])
    assert not zlib.crc32(b"0") % 3 == 1
    model = toxicity.fit(docs, spark.createDataFrame(labels, LABELS))
    assert [r["score"] for r in toxicity.scored(docs, model).collect()] == [score] * 2


def test_few_rows_and_empty_table(spark, documents):
    rows, labels = corpus(12)
    model = toxicity.fit(documents(rows), spark.createDataFrame(labels, LABELS))
    assert all(0 <= r["score"] <= 1 for r in toxicity.scored(documents(rows), model).collect())
    assert toxicity.scored(documents([]), model).count() == 0
    assert toxicity.fit(documents([]), spark.createDataFrame([], LABELS)).prior == 0


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables")
def test_query_on_held_out_rows(spark):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{TABLES}/labels.parquet").collect()}
    found = [r for r in queries.op11_toxicity(spark, TABLES).collect() if r["held_out"] and r["doc_id"] in labels]
    truth, said = np.array([labels[r["doc_id"]] for r in found]), np.array([r["predicted"] for r in found])
    assert glob.glob(f"{TABLES}/*.parquet") and truth[said == 1].mean() >= 0.95 and said[truth == 1].mean() >= 0.88
