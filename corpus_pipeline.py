"""The corpus pipeline: quality rules, near-duplicate removal, secret masking, mixing and packing.

Each stage takes all that the one before it kept, and its decision takes effect: documents that the quality
rules reject go; of each near-duplicate group the smallest id stays; secrets are masked; the mix drops or
repeats documents; and what is left is packed into sequences. Stages are written and read again in between.
A document that the mix takes twice or three times is two or three equal rows, and packed as often.

Null and empty texts and texts of fewer than ten words are rejected by the first stage. Rows with a null id are
kept, each for itself, by the second. Of rows with equal ids and texts one stays. Very long texts are taken
whole; further columns of any name and type go through all stages but the last unchanged. A table without
rows gives none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import mixing, near_copies, packing, repetition, secrets, simhash
from plumbline.llm.common import bounded, table, written
from plumbline.llm.queries import vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded(spark)
    return repetition.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded(spark)
    return simhash.deduplicated(docs, near_copies.near_copies)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded(spark)
    return secrets.masked(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded(spark)
    return mixing.repeated(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded(spark)
    return packing.pack(packing.pieces(docs, vocabulary(spark)))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("mix", mix),
    ("pack", pack),
]

#: SQL expresses none of the suffix-array, SimHash and tokenizer stages; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over documents, in a stable order of columns."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir).select(*[F.col(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")])
