"""The operators' queries and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, chat, licenses, media, mixing, neighbours, packing, pfor, repair, repetition, secrets, simhash, toxicity
from .common import checkpointed, table


def vocabulary(spark: SparkSession) -> str:
    """The path of the tokenizer file: spark.plumbline.tokenizer, or the installed public vocabulary."""
    import public_tokenizers

    return spark.conf.get("spark.plumbline.tokenizer", None) or public_tokenizers.path("byte_bpe_50k.json")


def pieces_model(spark: SparkSession) -> str:
    """The path of the second tokenizer's model: spark.plumbline.pieces, or the installed public one."""
    import public_tokenizers

    return spark.conf.get("spark.plumbline.pieces", None) or public_tokenizers.path("piece_bpe_32k.model")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_media_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = media.features(media.store(table(spark, sf_dir, "documents")))
    clip = lambda c: F.format_string("%.2f-%.2f:%d:%.4f", c["start"], c["end"], c["frames"], c["level"])
    feature = F.array_join(F.transform("clips", clip), ",").alias("feature")
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    number = lambda kind: F.size(F.filter("__base", lambda s: s["kind"] == kind)).cast("long")
    counts = [number(i).alias(f"n_{name}") for i, name in enumerate(("assign", "access", "hex"))]
    return found.select("doc_id", *counts, F.sha2(secrets.rendered("__base"), 256).alias("base_sha256"), secrets.rendered("__spans").alias("spans"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = packing.pieces(table(spark, sf_dir, "documents"), vocabulary(spark))
    return packing.pack(cut).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op6_token_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pfor.read_ids(spark, pfor.write_ids(table(spark, sf_dir, "documents"), vocabulary(spark)))


def op7_chat_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = chat.items(table(spark, sf_dir, "conversations"))
    return chat.preferences(chosen, chat.alternatives(chosen))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repetition.quality(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "longest_repeat", "covered_words", "spans")


def op9_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = checkpointed(docs.select("doc_id", "source", mixing.key_of().alias("key"), mixing.size_of().alias("size")))
    by = mixing.plan(docs, kept=rows)
    found = mixing.mixed(rows, by, key="key")
    return found.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = neighbours.scored(docs, neighbours.fit(docs, table(spark, sf_dir, "labels")))
    predicted = F.when(F.col("score") >= neighbours.THRESHOLD, 1).otherwise(0)
    return found.select("doc_id", neighbours.held_out().alias("held_out"), "score", predicted.alias("predicted"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = toxicity.scored(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    predicted = F.when(F.col("score") >= toxicity.THRESHOLD, 1).otherwise(0)
    return found.select("doc_id", toxicity.held_out().alias("held_out"), "score", predicted.alias("predicted"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), vocabulary(spark), pieces_model(spark))


def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    edits, reports = repair.repair(repair.damaged(turns))
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    same = lambda df: F.col("conv_id").eqNullSafe(F.col(df))
    every = turns.select("conv_id").distinct()
    every = every.join(reports.withColumnRenamed("conv_id", "r"), same("r"), "left").join(repair.digests(edits).withColumnRenamed("conv_id", "d"), same("d"), "left")
    counts = [number(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(repair.EMPTY)).alias("repaired_sha256"))


OPERATORS = (
    op1_simhash_near_dedup,
    op2_media_clips,
    op3_secret_scan,
    op4_license_scan,
    op5_best_fit_packing,
    op6_token_id_files,
    op7_chat_preferences,
    op8_quality_rules,
    op9_mixing_sources,
    op10_quality_classifier,
    op11_toxicity,
    op12_token_alignment,
    op13_structure_repair,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in OPERATORS}


def oracle_sql() -> dict[str, str]:
    return {"op4_license_scan": licenses.scan_sql(), "op7_chat_preferences": chat.preferences_sql()}
