"""Tables that are really written: replaced partitions, appended rows with keys; arms that fail."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from plumbline.operators import retrieval, store


def files(path):
    return {os.path.relpath(f, path): os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/*/*.parquet")}


def test_other_partitions_files_stay_untouched(spark, tmp_path):
    path = str(tmp_path / "t")
    old = spark.createDataFrame([(i, f"p/{i % 4}") for i in range(40)] + [(99, None)], "id long, repo string")
    store.overwrite_partitions(old, path, "repo")
    read = lambda: sorted((r["id"], r["repo"]) for r in spark.read.parquet(path).collect())
    before = files(path)
    new = spark.createDataFrame([(100, "p/1"), (101, "new")], "id long, repo string")
    asked = spark.createDataFrame([("p/1",), ("p/2",), ("none",)], "repo string")
    want = sorted([(i, f"p/{i % 4}") for i in range(40) if i % 4 in (0, 3)] + [(99, None), (100, "p/1"), (101, "new")], key=lambda r: r[0])
    for _ in range(2):
        store.overwrite_partitions(new, path, "repo", asked)
        assert read() == want
        kept = {f: t for f, t in before.items() if f.startswith(("repo=p%2F0", "repo=p%2F3", "repo=__HIVE"))}
        assert kept and kept.items() <= files(path).items()
        assert not os.path.exists(f"{path}/repo=p%2F2")


def test_a_table_may_be_read_and_overwritten_at_once(spark, tmp_path):
    path = str(tmp_path / "t")
    store.overwrite_partitions(spark.range(10).withColumn("g", F.col("id") % 2), path, "g")
    store.overwrite_partitions(spark.read.parquet(path).where("g = 1").withColumn("id", F.col("id") + 100), path, "g")
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == [0, 2, 4, 6, 8, 101, 103, 105, 107, 109]


def test_appended_rows_have_keys(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(100).repartition(3).select(F.col("id").alias("n"))
    keys = []
    for _ in range(3):
        given = store.appended(rows, path, "key").collect()
        assert sorted(r["n"] for r in given) == list(range(100)) and (not keys or min(r["key"] for r in given) > max(keys))
        keys += [r["key"] for r in given]
    held = spark.read.parquet(path).collect()
    assert len(set(keys)) == 300 and sorted(r["key"] for r in held) == sorted(keys)
    assert store.appended(rows.where("n < 0"), path, "key").count() == 0


def test_arrays_of_different_sizes_write_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([([1, 2], ["a", "b"]), ([1], None), (None, ["a"])], "chunks array<int>, vectors array<string>")
    assert store.appended(rows, path, "key", ["chunks", "vectors"]).count() == 3
    bad = spark.createDataFrame([([1, 2], ["a", "b"]), ([1, 2], ["a"])], "chunks array<int>, vectors array<string>")
    with pytest.raises(ValueError, match="chunks"):
        store.appended(bad, path, "key", ["chunks", "vectors"])
    assert spark.read.parquet(path).count() == 3


def test_arms_that_fail(spark):
    good = spark.createDataFrame([(1, 7, 1), (1, 8, 2)], "query_id long, id long, rank int")

    def broken():
        raise OSError("down")

    arms = {"a": lambda: good, "code": broken, "task": lambda: good.withColumn("rank", F.raise_error(F.lit("disk")).cast("int")), "python": lambda: good.mapInPandas(lambda it: (x / 0 for x in [1]), good.schema)}
    found, failed = retrieval.surviving(arms)
    assert list(found) == ["a"] and set(failed) == {"code", "task", "python"} and "down" in failed["code"]
    assert sorted((r["id"], r["sources"]) for r in retrieval.fused(found).collect()) == [(7, "a"), (8, "a")]
