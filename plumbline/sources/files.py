"""File sources: source trees, project files, evaluation runs, test reports, coverage, logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Folders whose files are not sources.
IGNORED = ["target", "build", "out", ".git", ".idea", ".mvn", "node_modules", ".gradle"]
MOST_FILES = 20
#: How deep reports may lie below a project, the file's name included.
DEEPEST = 8


def relative(path: Column, root: str) -> Column:
    """The path below root, whatever its scheme."""
    plain = root.rstrip("/")
    return F.regexp_replace(path, rf"^.*\Q{plain}\E/", "")


def tree(spark: SparkSession, root: str, pattern: str, ignored: list[str] = IGNORED) -> DataFrame:
    """(path, content) of text files below root whose relative path has no ignored folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    rows = files.select(relative(F.col("path"), root).alias("path"), F.decode("content", "UTF-8").alias("content"))
    return rows.where(~F.arrays_overlap(F.split("path", "/"), F.array(*[F.lit(x) for x in ignored])))


def java_files(spark: SparkSession, root: str, most: int = MOST_FILES) -> DataFrame:
    return tree(spark, root, "*.java").orderBy("path").limit(most)


def pom_files(spark: SparkSession, root: str) -> DataFrame:
    """Shallowest first, then by path."""
    return tree(spark, root, "pom.xml").orderBy(F.size(F.split("path", "/")), "path")


RUN = (
    "caseId string, project string, entryFile string, title string, patterns array<string>, expect string, taskId long, status string, failReason string, "
    "metrics struct<filesTotal:int,compilePassed:int,testsTotal:int,testsPassed:int,coverage:double,llmCalls:int,promptTokens:long,completionTokens:long,totalCost:double,verifyAttempts:int,durationMs:long>, "
    "runDurationMs long, wallClockMs long, harnessError string, recordedAt timestamp"
)


def runs(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation runs of a JSON array; unknown fields are ignored, missing ones null."""
    return spark.read.schema(RUN).json(path, multiLine=True)


def latest_runs(spark: SparkSession, root: str) -> DataFrame:
    """The runs in the folder with the greatest name that has a runs.json."""
    folder = F.element_at(F.split(F.input_file_name(), "/"), -2)
    every = spark.read.schema(RUN).json(f"{root}/*/runs.json", multiLine=True).withColumn("__folder", folder)
    return every.join(every.agg(F.max("__folder").alias("__folder")), "__folder", "left_semi").drop("__folder")


def write_runs(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def checked_catalogue(cases: DataFrame, version: int) -> DataFrame:
    """A case catalogue of version 1, not empty, with unique ids; else an error."""
    if version != 1:
        raise ValueError(f"catalogue version {version} is unknown")
    if not cases.limit(1).count():
        raise ValueError("the catalogue is empty")
    twice = cases.groupBy("id").count().where("count > 1").select("id").limit(5).collect()
    if twice:
        raise ValueError(f"ids occur twice: {[r['id'] for r in twice]}")
    return cases


def test_suites(spark: SparkSession, root: str) -> DataFrame:
    """(path, total, failed, skipped, passed, failed_names) of surefire reports; broken files are left out, and those that lie
    more than `DEEPEST` folders and names below root."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "TEST-*.xml").load(root)
    near = F.size(F.split(relative(F.col("path"), root), "/")) <= DEEPEST
    rows = files.where((F.element_at(F.split("path", "/"), -2) == "surefire-reports") & near).select("path", F.decode("content", "UTF-8").alias("xml"))
    kind = "_tests long, _failures long, _errors long, _skipped long, testcase array<struct<_name:string,_classname:string,failure:string,error:string>>"
    parsed = rows.select("path", F.from_xml("xml", kind).alias("s")).where("s._tests is not null")
    bad = F.filter("s.testcase", lambda c: c["failure"].isNotNull() | c["error"].isNotNull())
    failed = F.coalesce("s._failures", F.lit(0)) + F.coalesce("s._errors", F.lit(0))
    skipped = F.coalesce("s._skipped", F.lit(0))
    return parsed.select(
        "path", F.col("s._tests").alias("total"), failed.alias("failed"), skipped.alias("skipped"), (F.col("s._tests") - failed - skipped).alias("passed"),
        F.transform(F.coalesce(bad, F.array().cast("array<struct<_name:string,_classname:string,failure:string,error:string>>")), lambda c: F.concat_ws("#", c["_classname"], c["_name"])).alias("failed_names"),
    )


def coverage(spark: SparkSession, path: str) -> DataFrame:
    """(covered, missed, coverage) summed over coverage files: 0 without lines, null without files or rows."""
    rows = spark.read.text(path).select(F.split("value", ",").alias("c")).where("size(c) >= 9").select(F.col("c")[8].try_cast("long").alias("covered"), F.col("c")[7].try_cast("long").alias("missed"))
    sums = rows.where("covered is not null and missed is not null").agg(F.sum("covered").alias("covered"), F.sum("missed").alias("missed"))
    total = F.col("covered") + F.col("missed")
    return sums.withColumn("coverage", F.when(total > 0, F.col("covered") / total).when(total == 0, 0.0))


def columns(spark: SparkSession, names: list[str]) -> DataFrame:
    """(table, ordinal, column, type, comment) of the catalogue's tables, by table and ordinal."""
    rows = [(t, i, c.name, c.dataType, c.description) for t in names if not t.startswith("flyway") for i, c in enumerate(spark.catalog.listColumns(t))]
    return spark.createDataFrame(rows, "table string, ordinal int, column string, type string, comment string").orderBy("table", "ordinal")
