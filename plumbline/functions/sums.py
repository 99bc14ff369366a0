"""Running sums over groups of any size."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import checkpointed, small


def running_sum(df: DataFrame, group: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """Adds `out`: the sum of `value` over a group's rows up to this one, in an order without ties.

    The rows are range-partitioned by group and order and kept, so one group with all rows lies in all partitions. What is
    added up across partitions is one row for each partition and each group in it.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = checkpointed(df.repartitionByRange(partitions, *group, *order).withColumn("__pid", F.spark_partition_id()))
    sums = dealt.groupBy("__pid", *group).agg(F.sum(value).alias("__sum"))
    before = Window.partitionBy(*group).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(*[F.col(c).alias(f"__of_{c}") for c in ("__pid", *group)], F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("__pid", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = dealt.withColumn("__own", F.sum(value).over(inside))
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in ("__pid", *group)])
    return own.join(small(carried), same).select(*df.columns, (F.col("__own") + F.col("__before")).alias(out))
