"""Helpers that the corpus operators share."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scratch import checkpointed, fresh_path, small  # noqa: F401  small, for the operators

#: Words are runs of anything but the space and the characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of an Arrow batch between the JVM and Python: either side holds some copies of one for each core.
BATCH_BYTES = 8 << 20


def bounded(spark: SparkSession) -> None:
    """Gives the session's Arrow batches at most BATCH_BYTES, unless it has a bound set already; a single longer text is a batch of its own."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if name not in spark.conf.getAll:
        spark.conf.set(name, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, for what is wide or is read several times."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def partitions_for(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def running_total(df: DataFrame, order: list[str], value: str, out: str, group: list[str] = (), few_groups: bool = False) -> DataFrame:
    """Adds `out`: the sum of `value` over the rows before this one in the order of group and order columns.

    The rows are range-partitioned by both and kept, so that a large group lies in many partitions and each
    is summed once. What is added up over partitions is one row for each partition and each group in it;
    few_groups says that the groups have a fixed bound, so that those rows may be broadcast.
    """
    group = list(group)
    dealt = checkpointed(df.repartitionByRange(partitions_for(df), *group, *order).withColumn("__pid", F.spark_partition_id()))
    sums = dealt.groupBy("__pid", *group).agg(F.sum(value).alias("__sum"))
    before = Window.partitionBy(*group).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*[F.col(c).alias(f"__b_{c}") for c in ["__pid", *group]], F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__base"))
    inside = Window.partitionBy("__pid", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = dealt.withColumn("__own", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"__b_{c}")) for c in ["__pid", *group]])
    return own.join(F.broadcast(base) if few_groups else base, same).select(*df.columns, (F.col("__own") + F.col("__base")).alias(out))
