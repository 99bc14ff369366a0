"""Rule catalogues: prefix joins, rule scans, guards, classifiers, merged plans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Package prefixes and the artifacts that replace them.
ARTIFACTS = [
    ("javax.xml.ws", "jakarta.xml.ws:jakarta.xml.ws-api:4.0.1"),
    ("javax.xml.ws.soap", "jakarta.xml.ws:jakarta.xml.ws-api:4.0.1"),
    ("javax.jws", "jakarta.jws:jakarta.jws-api:3.0.0"),
    ("javax.xml.bind", "jakarta.xml.bind:jakarta.xml.bind-api:4.0.2"),
    ("javax.xml.soap", "jakarta.xml.soap:jakarta.xml.soap-api:3.0.2"),
    ("javax.activation", "jakarta.activation:jakarta.activation-api:2.1.3"),
    ("javax.annotation", "jakarta.annotation:jakarta.annotation-api:2.1.1"),
    ("javax.transaction", "jakarta.transaction:jakarta.transaction-api:2.0.1"),
    ("javax.persistence", "jakarta.persistence:jakarta.persistence-api:3.1.0"),
    ("javax.validation", "jakarta.validation:jakarta.validation-api:3.0.2"),
    ("javax.servlet", "jakarta.servlet:jakarta.servlet-api:6.0.0"),
    ("javax.ejb", "jakarta.ejb:jakarta.ejb-api:4.0.1"),
    ("javax.mail", "com.sun.mail:jakarta.mail:2.0.1"),
]
# Prefixes that stay, although a shorter one above would match.
ARTIFACT_EXCLUSIONS = [
    "javax.annotation.processing", "javax.annotation.meta", "javax.crypto", "javax.sql", "javax.naming", "javax.net", "javax.xml.parsers", "javax.xml.transform",
    "javax.xml.xpath", "javax.xml.stream", "javax.xml.datatype", "javax.xml.namespace", "javax.script", "javax.swing", "javax.xml.crypto",
]
# Packages that left the JDK at 11, and what follows them (None: nothing).
REMOVED = [
    ("javax.xml.ws", "jakarta.xml.ws"), ("javax.xml.ws.soap", "jakarta.xml.ws.soap"), ("javax.xml.bind", "jakarta.xml.bind"), ("javax.xml.soap", "jakarta.xml.soap"),
    ("javax.xml.rpc", None), ("javax.jws", "jakarta.jws"), ("javax.activation", "jakarta.activation"), ("javax.annotation", "jakarta.annotation"),
    ("javax.transaction", "jakarta.transaction"), ("javax.persistence", "jakarta.persistence"), ("javax.servlet", "jakarta.servlet"), ("javax.ejb", "jakarta.ejb"),
    ("javax.mail", "jakarta.mail"), ("javax.management.j2ee", None), ("javax.rmi.CORBA", None), ("org.omg", None), ("com.sun.corba", None),
]
REMOVED_EXCLUSIONS = ["javax.annotation.processing", "javax.annotation.meta"]
# Rules on breaking changes; a rule hits if all its patterns are found.
BREAKING = {
    "SPRING6_HTTPCOMPONENTS_FACTORY": [r"\bHttpComponentsClientHttpRequestFactory\b"],
    "SPRING6_RESPONSE_ERROR_HANDLER": [r"\bResponseErrorHandler\b", r"handleError\s*\(\s*(?:final\s+)?(?:ClientHttpResponse|org\.springframework\.http\.client\.ClientHttpResponse)"],
    "SPRING6_WEBMVC_CONFIGURER_ADAPTER": [r"\bWebMvcConfigurerAdapter\b"],
    "HTTPCLIENT4_LEGACY": [r"(?m)^\s*import\s+org\.apache\.http\.[\w.]+;"],
}
# Marks of compiler messages about changed signatures and missing dependencies.
API_MARKS = ["cannot find symbol", "找不到符号", "has been removed", "is not abstract", "incompatible types", "org.springframework"]
DEPENDENCY_MARKS = ["does not exist", "不存在", "cannot be resolved", "无法解析", "could not resolve"]


def prefixes(name: Column, separator: str) -> Column:
    """All prefixes of a name that end before a separator, and the name itself, with their lengths in parts."""
    parts = F.split(name, separator if len(separator) > 1 else f"[{separator}]")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), separator))


def longest_prefix(df: DataFrame, name: str, catalogue: DataFrame, prefix: str, payload: str, separator: str = ".", excluded: DataFrame | None = None) -> DataFrame:
    """df's distinct names with the payload of their longest prefix in the catalogue (null: none, or excluded).

    Names are exploded into their prefixes and joined by equality, so nothing is compared pair by pair.
    """
    names = df.select(name).where(F.col(name).isNotNull()).distinct()
    parts = names.select(name, F.posexplode(prefixes(F.col(name), separator)).alias("__n", "__p"))
    best = parts.join(catalogue, F.col("__p") == F.col(prefix)).groupBy(name).agg(F.max_by(payload, "__n").alias(payload))
    if excluded is not None:
        out = parts.join(excluded.select(F.col(excluded.columns[0]).alias("__x")), F.col("__p") == F.col("__x"), "left_semi").select(name).distinct()
        best = best.join(out, name, "left_anti")
    return names.join(best, name, "left")


def imports(source: Column) -> Column:
    """Imported names of a Java source, in order, without `static` and `.*`."""
    found = F.regexp_extract_all(source, F.lit(r"(?m)^\s*import\s+(?:static\s+)?([A-Za-z_][\w.]*)"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: F.regexp_replace(x, r"\.$", "")))


def all_found(text: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [text.rlike(p) for p in patterns])


def rule_hits(text: Column, rules: dict[str, list[str]]) -> Column:
    """Names of the rules all of whose patterns are found."""
    return F.array_compact(F.array(*[F.when(all_found(text, p), F.lit(n)) for n, p in rules.items()]))


def first_violation(*rules: tuple[Column, str]) -> Column:
    """The reason of the first rule that fails; null if none does."""
    return F.coalesce(*[F.when(failed, F.lit(reason)) for failed, reason in rules])


def all_violations(*rules: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(failed, F.lit(reason)) for failed, reason in rules]))


def contains_any(text: Column, marks: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(m)) for m in marks])


def error_category(block: Column, legacy: Column, test_source: Column) -> Column:
    """Of a compiler message: leftover of an old namespace, API signature, dependency; else test source or unclassified."""
    return (
        F.when(legacy, "JAKARTA_LEFTOVER")
        .when(contains_any(block, API_MARKS), "API_SIGNATURE")
        .when(contains_any(block, DEPENDENCY_MARKS), "DEPENDENCY_UNRESOLVED")
        .when(test_source, "TEST_SOURCE")
        .otherwise("UNCLASSIFIED")
    )


def _catalogued(names: DataFrame, catalogue: list[tuple[str, str | None]], excluded: list[str], payload: str) -> DataFrame:
    """(name, prefix, payload) of the names whose longest prefix is in a catalogue of constants."""
    spark = names.sparkSession
    rows = spark.createDataFrame([(p, p, v) for p, v in catalogue], f"__p0 string, prefix string, {payload} string")
    out = spark.createDataFrame([(x,) for x in excluded], "__x0 string")
    best = longest_prefix(names, "name", F.broadcast(rows), "__p0", "prefix", excluded=F.broadcast(out)).where("prefix is not null")
    return best.join(F.broadcast(rows.drop("__p0")), "prefix").select("name", "prefix", payload)


def scan_sources(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Findings of each Java source that has any: path, removed, mapped, legacy and breaking.

    removed: imports of packages that left the JDK (name, prefix, successor); mapped: those that an artifact
    replaces (name, prefix, artifact); legacy: the names in either, each once; all in the order of the source.
    breaking: rules on changed interfaces. Sources that can't be read (null) have none.
    """
    read = files.select(F.col(path).alias("path"), F.col(content).alias("__text")).where(F.col(content).isNotNull())
    found = read.select("path", F.posexplode(imports(F.col("__text"))).alias("n", "name"))
    names = found.select("name").distinct()
    removed = _catalogued(names, REMOVED, REMOVED_EXCLUSIONS, "successor").withColumnRenamed("prefix", "gone")
    mapped = _catalogued(names, ARTIFACTS, ARTIFACT_EXCLUSIONS, "artifact").withColumnRenamed("prefix", "replaced")
    hits = found.join(removed, "name", "left").join(mapped, "name", "left").where("gone is not null or replaced is not null")
    item = lambda kept, *columns: F.array_sort(F.collect_list(F.when(F.col(kept).isNotNull(), F.struct("n", "name", *columns))))
    of_imports = hits.groupBy("path").agg(
        item("gone", F.col("gone").alias("prefix"), "successor").alias("removed"), item("replaced", F.col("replaced").alias("prefix"), "artifact").alias("mapped"),
        F.transform(F.array_sort(F.collect_list(F.struct("n", "name"))), lambda x: x["name"]).alias("legacy"),
    )
    of_text = read.select("path", rule_hits(F.col("__text"), BREAKING).alias("breaking")).where(F.size("breaking") > 0)
    out = of_imports.join(of_text, "path", "full")
    empty = lambda c: F.coalesce(c, F.filter(c, lambda x: F.lit(False)), F.from_json(F.lit("[]"), out.schema[c].dataType)).alias(c)
    return out.select("path", *[empty(c) for c in ("removed", "mapped", "legacy", "breaking")])


# Why a file isn't written back, in the order in which reasons are told.
REFUSALS = ["TASK_NOT_SUCCEEDED", "WORKSPACE_GONE", "PROJECT_ROOT_GONE", "DIRTY_WORKING_TREE", "FILE_NOT_ALLOWED", "SANDBOX_FILE_MISSING", "SOURCE_FILE_MISSING", "BASE_MISMATCH", "NO_PATCH"]


def refusals(**failed: Column) -> Column:
    """array<string> of all reasons whose condition (by its name in lower case) holds; conditions that are null don't."""
    unknown = set(failed) - {r.lower() for r in REFUSALS}
    if unknown:
        raise ValueError(f"no such reasons: {sorted(unknown)}")
    return all_violations(*[(failed[r.lower()], r) for r in REFUSALS if r.lower() in failed])


# The levels before a message of the build, and the words of its details with their colon, ASCII or full-width.
LEVEL = r"(?:\[(?:ERROR|WARNING|INFO)\])"
DETAILS, COLONS = "symbol|location|符号|位置", ":："
#: The head of a compiler message: an optional level, file, line and column, and the message; and lines that go with it.
ERROR_HEAD = rf"^(?:{LEVEL}\s*)?(\S.*\.java):\[(\d+),(\d+)\]\s*(.*)$"
ERROR_DETAIL = rf"^{LEVEL}?\s*((?:{DETAILS})\s*[{COLONS}].*)$"


def compile_errors(lines: DataFrame, key: str, number: str, line: str) -> DataFrame:
    """Of each compiler message: key, block (from 1), file, line, column, message, and its details in order.

    A block's details are its lines on a symbol or a location; other lines are left out.
    """
    blocks = error_blocks(lines.select(key, number, F.col(line).alias("__line")), key, number, "__line", ERROR_HEAD)
    part = lambda n: F.regexp_extract("__line", ERROR_HEAD, n)
    head = F.struct(part(1).alias("file"), part(2).cast("int").alias("line"), part(3).cast("int").alias("column"), part(4).alias("message"))
    read = blocks.withColumn("__is", F.col("__line").rlike(ERROR_HEAD)).select(key, "block", number, F.when(F.col("__is"), head).alias("__h"), F.when(~F.col("__is"), F.regexp_extract("__line", ERROR_DETAIL, 1)).alias("__d"))
    details = F.array_sort(F.collect_list(F.when(F.col("__d") != "", F.struct(number, F.trim("__d").alias("text")))))
    return read.groupBy(key, "block").agg(F.max("__h").alias("__h"), details.alias("__d")).select(key, "block", "__h.*", F.transform("__d", lambda d: d["text"]).alias("details"))


def containing_dir(files: DataFrame, path: str, dirs: DataFrame, folder: str) -> DataFrame:
    """files with the deepest of the dirs that holds them; null: none. Joined on the files' ancestors."""
    ancestors = files.select(path).distinct().select(path, F.posexplode(prefixes(F.col(path), "/")).alias("__n", "__p"))
    best = ancestors.join(dirs.select(F.col(folder).alias("__d")).distinct(), (F.col("__p") == F.col("__d")) & (F.col("__p") != F.col(path)))
    best = best.groupBy(path).agg(F.max_by("__p", "__n").alias(folder))
    return files.join(best, path, "left")


def merged(sources: list[DataFrame], key: str, order: str) -> DataFrame:
    """Rows of all sources by normalised key (slashes, lower case): the first source that has it wins, its first row."""
    every = reduce(DataFrame.unionByName, [s.withColumn("__source", F.lit(i)) for i, s in enumerate(sources)])
    every = every.withColumn("__key", F.lower(F.translate(key, "\\", "/")))
    rank = F.row_number().over(Window.partitionBy("__key").orderBy("__source", order))
    return every.withColumn("__n", rank).where("__n = 1").withColumnRenamed("__source", "priority").drop("__n", "__key")


def normal_path(path: str) -> Column:
    """A path as it is compared: slashes only, in lower case."""
    return F.lower(F.translate(path, "\\", "/"))


def enriched(targets: DataFrame, steps: DataFrame, removed: DataFrame, legacy: DataFrame, breaking: DataFrame) -> DataFrame:
    """targets (project, path) with `reason` and `detail`: why each file is in the plan.

    The rationale of the first step of the file counts (steps: project, n, path, rationale; by n), unless it is blank, even
    if a later step of the same file has one. Then what scans explain, in this order: imports that are removed (removed:
    project, path, flag; all of them are the detail), legacy namespaces, breaking interfaces (project, path each); else
    `unexplained`. Paths are compared by `normal_path`. Steps without a path are none.
    """
    key = normal_path("path").alias("__key")
    first = steps.where(F.length(F.trim("path")) > 0).groupBy("project", key).agg(F.min_by("rationale", "n").alias("__said"))
    flags = removed.where("flag is not null").groupBy("project", key).agg(F.array_join(F.array_sort(F.collect_set("flag")), ", ").alias("__flags"))
    out = targets.withColumn("__key", normal_path("path")).join(first, ["project", "__key"], "left").join(flags, ["project", "__key"], "left")
    for name, scan in (("__legacy", legacy), ("__breaking", breaking)):
        out = out.join(scan.select("project", key).distinct().withColumn(name, F.lit(True)), ["project", "__key"], "left")
    said = F.length(F.trim(F.coalesce("__said", F.lit("")))) > 0
    reason = F.when(said, "model").when(F.col("__flags").isNotNull(), "removed").when(F.col("__legacy"), "legacy").when(F.col("__breaking"), "breaking").otherwise("unexplained")
    return out.select(*targets.columns, reason.alias("reason"), F.when(said, F.col("__said")).otherwise(F.col("__flags")).alias("detail"))


def error_blocks(lines: DataFrame, key: str, number: str, line: str, head: str) -> DataFrame:
    """Lines with the number of their block; a block begins at a line that matches `head`, earlier lines are dropped."""
    by = Window.partitionBy(key).orderBy(number).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("block", F.sum(F.col(line).rlike(head).cast("int")).over(by)).where("block > 0")


# The parent that projects are brought to, and what becomes of dependencies on the way.
PARENT_VERSION = "3.5.16"


def version_parts(version: Column) -> Column:
    """array<int> of a version's leading numbers; null without any."""
    plain = F.regexp_extract(F.trim(version), r"^v?([0-9]+(?:\.[0-9]+)*)", 1)
    return F.when(plain != "", F.transform(F.split(plain, r"\."), lambda x: x.try_cast("int")))


def version_before(a: Column, b: Column) -> Column:
    """Whether version a is lower than b, number by number, missing ones being 0; null if one has none."""
    x, y = version_parts(a), version_parts(b)
    size = F.greatest(F.size(x), F.size(y))
    wide = lambda v: F.concat(v, F.array_repeat(F.lit(0), size - F.size(v)))
    return wide(x) < wide(y)


def parent_upgrade(version: Column, target: str = PARENT_VERSION) -> Column:
    """none (no version or a placeholder), keep or upgrade."""
    lower = version_before(version, F.lit(target))
    return F.when(lower.isNull(), "none").when(lower, "upgrade").otherwise("keep")


def level_upgrade(declared: DataFrame, file: str, level: str, target: int) -> DataFrame:
    """(file, least, decision) of the Java levels that files declare, a row for each declaration or one of null.

    `add` if a file declares none, `unknown` if none of what it declares is a number, `upgrade` if the least number is
    below the target, else `keep`.
    """
    least = F.min(T.java_major(F.col(level)))
    decision = F.when(F.count(level) == 0, "add").when(least.isNull(), "unknown").when(least < target, "upgrade").otherwise("keep")
    return declared.groupBy(file).agg(least.alias("least"), decision.alias("decision"))


def dependency_changes(dependencies: DataFrame, renames: DataFrame, bumps: DataFrame) -> DataFrame:
    """dependencies (grp, artifact, version) with the new names and version, and `change`: rename, bump or keep.

    renames: grp, artifact, new_grp, new_artifact. bumps: grp, artifact, least: versions below it are raised to it.
    Names are looked up as they were; a renamed dependency keeps its version, unless its new name is bumped.
    """
    named = dependencies.join(renames, ["grp", "artifact"], "left").withColumn("__renamed", F.col("new_grp").isNotNull())
    named = named.withColumn("new_grp", F.coalesce("new_grp", "grp")).withColumn("new_artifact", F.coalesce("new_artifact", "artifact"))
    least = bumps.select(F.col("grp").alias("new_grp"), F.col("artifact").alias("new_artifact"), "least")
    both = named.join(least, ["new_grp", "new_artifact"], "left")
    low = F.coalesce(version_before(F.col("version"), F.col("least")), F.lit(False))
    change = F.when(F.col("__renamed"), "rename").when(low, "bump").otherwise("keep")
    return both.select(*dependencies.columns, "new_grp", "new_artifact", F.when(low, F.col("least")).otherwise(F.col("version")).alias("new_version"), change.alias("change"))


def artifacts_to_add(needed: DataFrame, present: DataFrame, project: str) -> DataFrame:
    """(project, grp, artifact) that are needed and that the project lacks, each once; added again they are none."""
    return needed.select(project, "grp", "artifact").distinct().join(present.select(project, "grp", "artifact"), [project, "grp", "artifact"], "left_anti")
