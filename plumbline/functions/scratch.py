"""What iterative jobs keep between rounds, in the folder that driver and executors share."""

from __future__ import annotations

import hashlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    A local session may leave it unset and then gets a temporary folder; a cluster session must set it.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.plumbline.scratch", None)
    if not folder:
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="plumbline-")
        spark.conf.set("spark.plumbline.scratch", folder)
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(folder)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared folder; its lineage ends there."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def kept_path(df: DataFrame, name: str) -> str:
    """A path in the shared folder for what is made of a table of files, the same as long as their names, sizes and times are."""
    spark = df.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path
    state = hashlib.sha256()
    for file in sorted(df.inputFiles()):
        path = place(spark._jvm.java.net.URI(file))
        status = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
        state.update(f"{file}:{status.getLen()}:{status.getModificationTime()}\n".encode())
    return f"{shared_dir(spark)}/{name}-{state.hexdigest()[:32]}"


def small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """df, kept, for the small side of a join: to be broadcast if it has at most so many rows, else shuffled."""
    return near(checkpointed(df), rows)


def near(kept: DataFrame, rows: int = 100_000) -> DataFrame:
    """small() of what is kept already."""
    return F.broadcast(kept) if kept.limit(rows + 1).count() <= rows else kept


#: Tasks that dealt() makes at least.
TASKS = 32


def dealt(df: DataFrame, rows: int, most: int, *keys: str) -> DataFrame:
    """df by its keys in tasks of some `most` rows each, if it has so many `rows`: Spark doesn't put these together to one for each core."""
    return df.repartition(max(TASKS, -(-rows // most)), *keys)
