"""Lookups, latest rows, joins, state changes and table rewrites of the platform's store."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scratch import checkpointed


def lookup(df: DataFrame, **keys: object) -> DataFrame:
    """Rows whose columns equal the given values."""
    return df.where(reduce(lambda a, b: a & b, [F.col(k) == F.lit(v) for k, v in keys.items()]))


def children(df: DataFrame, parent: str, value: object, *order: str) -> DataFrame:
    return df.where(F.col(parent) == F.lit(value)).orderBy(*order)


def scan_by_keys(df: DataFrame, keys: DataFrame, key: str, order: list[str]) -> DataFrame:
    """For each key that occurs: its rows as one sorted array of structs of `order`. Null keys match nothing."""
    found = df.join(keys.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_semi")
    return found.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order))).alias("rows"))


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(n)


def page_size(asked: int | None, usual: int = 50, most: int = 200) -> int:
    return usual if not asked or asked <= 0 else min(asked, most)


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order, which must be total."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__n", rank).where("__n = 1").drop("__n")


def extreme(df: DataFrame, keys: list[str], by: list[str], columns: list[str], largest: bool) -> DataFrame:
    """Of each key the columns of the row that is largest or smallest in `by`: one aggregate, no sort."""
    row = F.struct(*by, *[c for c in columns if c not in by])
    picked = (F.max if largest else F.min)(row).alias("__x")
    return df.groupBy(*keys).agg(picked).select(*keys, *[F.col(f"__x.{c}").alias(c) for c in columns])


def divide(items: DataFrame, item: str, needs: str, done: DataFrame, key: str) -> DataFrame:
    """Items all of whose needs (an array; null or empty: none) are keys of done. Unknown needs block."""
    unmet = items.select(item, F.explode(needs).alias("__need")).join(done.select(F.col(key).alias("__done")), F.col("__need") == F.col("__done"), "left_anti")
    return items.join(unmet.select(item).distinct(), item, "left_anti")


def missing(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    return left.join(right.select(*on).distinct(), on, "left_anti")


def upsert(table: DataFrame, changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The table after changes: per key the row with the greatest `order`, changes before equal ones."""
    both = table.withColumn("__new", F.lit(0)).unionByName(changes.withColumn("__new", F.lit(1)))
    return latest(both, keys, F.col(order).desc(), F.col("__new").desc()).drop("__new")


def replace_partitions(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The table with all rows of the keys that occur in new replaced by new's."""
    return table.join(new.select(key).distinct(), key, "left_anti").select(*table.columns).unionByName(new.select(*table.columns))


def overwrite_partitions(new: DataFrame, path: str, key: str, asked: DataFrame | None = None) -> None:
    """Writes new in the place of the partitions of a table that its keys name; files of other partitions stay untouched.

    The table lies below a path, partitioned by key. asked (key): keys that are replaced even if new has no rows for
    them; those partitions go. Running it again gives the same table.
    """
    spark = new.sparkSession
    new = checkpointed(new)
    new.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy(key).parquet(path)
    if asked is None:
        return
    place = spark._jvm.org.apache.hadoop.fs.Path
    files = place(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for row in asked.select(key).distinct().join(new.select(key), key, "left_anti").where(F.col(key).isNotNull()).toLocalIterator():
        files.delete(place(place(path), f"{key}={spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(str(row[0]))}"), True)


def appended(rows: DataFrame, path: str, key: str, arrays: list[str] = ()) -> DataFrame:
    """Appends rows to a table below a path with keys of their own, and gives them back with their keys.

    A key follows the greatest that the table has; keys of one call may have gaps. arrays are columns that have an element
    each for the same things: a row in which their sizes differ fails the call before anything is written (nulls count as
    no array).
    """
    spark = rows.sparkSession
    if len(arrays) > 1:
        sizes = [F.size(c) for c in arrays]
        alike = reduce(lambda a, b: a & b, [(sizes[0] == s) | F.col(arrays[0]).isNull() | F.col(c).isNull() for c, s in zip(arrays[1:], sizes[1:])])
        if odd := rows.where(~alike).select(*[s.alias(c) for s, c in zip(sizes, arrays)]).limit(1).collect():
            raise ValueError(f"sizes differ: {odd[0].asDict()}")
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
    top = spark.read.parquet(path).agg(F.max(key)).first()[0] if there else None
    keyed = checkpointed(rows.withColumn(key, F.monotonically_increasing_id() + F.lit((top if top is not None else -1) + 1)))
    keyed.write.mode("append").parquet(path)
    return keyed


def without_parents(table: DataFrame, gone: DataFrame, key: str, gone_key: str) -> DataFrame:
    """Rows of a dependent table that outlive their deleted parents."""
    return table.join(gone.select(F.col(gone_key).alias("__gone")).distinct(), F.col(key) == F.col("__gone"), "left_anti")


def compare_and_set(df: DataFrame, column: str, expected: str, new: str, chosen: Column) -> DataFrame:
    """Adds `changed`, and sets the column of the chosen rows that still have the expected value."""
    hit = chosen & (F.col(column) == expected)
    return df.withColumn("changed", F.coalesce(hit, F.lit(False))).withColumn(column, F.when(F.col("changed"), new).otherwise(F.col(column)))


def transition(column: Column, rules: dict[str, str]) -> Column:
    """The column with states replaced by the rules; others stay."""
    out = None
    for state, new in rules.items():
        out = (F.when(column == state, new)) if out is None else out.when(column == state, new)
    return column if out is None else out.otherwise(column)


# Which commands a task's status allows, and what becomes of it.
COMMANDS = [
    ("WAITING_HUMAN", "approve", "PENDING"),
    ("WAITING_HUMAN", "reject", "FAILED"),
    ("PENDING", "cancel", "CANCELLED"),
    ("RUNNING", "cancel", "RUNNING"),
    ("WAITING_HUMAN", "cancel", "CANCELLED"),
    ("FAILED", "retry", "PENDING"),
    ("CANCELLED", "retry", "PENDING"),
]


def commanded(requests: DataFrame, status: str, command: str) -> DataFrame:
    """Adds `legal` and `next_status` by the table of commands."""
    table = requests.sparkSession.createDataFrame(COMMANDS, "__s string, __c string, __n string")
    joined = requests.join(F.broadcast(table), (F.col(status) == F.col("__s")) & (F.col(command) == F.col("__c")), "left")
    return joined.select(*requests.columns, F.col("__n").isNotNull().alias("legal"), F.coalesce("__n", status).alias("next_status"))
