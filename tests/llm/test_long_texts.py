"""A text of over a megabyte beside short ones, through every query on documents."""

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from plumbline.llm import queries, simhash
from tokenizers import Tokenizer

LONG = " ".join(f"word{i % 7919} of é{i % 13}" for i in range(90_000)) + " 🙂 end."
TEXTS = [LONG, "a short one", None, "", LONG, "another short one, with a few more words in it than ten of them"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("long"))
    rows = [(i, t, "en", "ab"[i % 2], len(t or "")) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    labels = [(i, int(i in (0, 4)), int(i == 5)) for i in (0, 1, 2, 3, 4, 5)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


@pytest.fixture(scope="module")
def ids():
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for t in TEXTS]


def rows(spark, folder, name):
    return {r["doc_id"]: r for r in queries.queries()[name](spark, folder).collect()}


def test_the_text_is_long():
    assert len(LONG) > 1_000_000


def test_fingerprints(spark, folder):
    found = rows(spark, folder, "op1_simhash_near_dedup")
    assert found[0]["fingerprint"] == found[4]["fingerprint"] == f"{simhash.fingerprint(LONG) & (1 << 64) - 1:016x}" and found[4]["component_id"] == 0


def test_media(spark, folder):
    found = rows(spark, folder, "op2_media_clips")
    assert found[0]["n_bytes"] == len(LONG.encode()) and found[0]["payload_sha256"] == found[4]["payload_sha256"]


def test_scans(spark, folder):
    assert rows(spark, folder, "op3_secret_scan")[0]["spans"] == "" and rows(spark, folder, "op4_license_scan")[0]["licences"] == ""


def test_tokens_and_packing(spark, folder, ids):
    found = rows(spark, folder, "op6_token_id_files")
    assert [found[i]["n_tokens"] for i in range(6)] == [len(x) for x in ids]
    assert found[0]["ids_crc32"] == zlib.crc32(np.array(ids[0], dtype="<u4").tobytes())
    pieces = queries.op5_best_fit_packing(spark, folder).collect()
    sums = Counter()
    for p in pieces:
        sums[p["doc_id"]] += p["length"]
    assert [sums[i] for i in range(6)] == [len(x) for x in ids] and max(p["length"] for p in pieces) == 2048


def test_quality_and_mixing(spark, folder):
    found = rows(spark, folder, "op8_quality_rules")
    assert found[0]["n_words"] == len(LONG.split()) == found[4]["n_words"]
    assert rows(spark, folder, "op9_mixing_sources")[0]["size"] == len(LONG.split())


@pytest.mark.parametrize("name", ["op10_quality_classifier", "op11_toxicity"])
def test_classifiers(spark, folder, name):
    found = rows(spark, folder, name)
    assert len(found) == 6 and all(0 <= r["score"] <= 1 for r in found.values()) and found[0]["score"] == found[4]["score"]


def test_alignment(spark, folder, ids):
    found = rows(spark, folder, "op12_token_alignment")
    assert found[0]["groups_sha256"] == found[4]["groups_sha256"] != "" and found[0]["n_links"] == found[0]["n_a"] + found[0]["n_b"] - found[0]["n_groups"]
