"""Quality scores by nearest-neighbour voting among labelled latent-semantic vectors.

Texts become counts of hashed byte trigrams and of words said twice running, weighed by inverse document
frequencies over all documents and projected by a truncated singular-value decomposition of labelled rows. The vectors of at most `SAMPLE`
labelled rows (those of the least hashed ids) are broadcast, some 1 MB; every document's cosine with every
one of them is computed in blocks, and the `K` nearest vote with their label, weighed by similarity.

Null and empty texts have the zero vector: no neighbour is nearer than another, and their score is the share
of label 1 in the sample. Several labels of one id are averaged; labels of unknown documents and null labels
are left out. Without any labelled row every score is 0.5. Repeated rows get the same score. Further columns,
of any name, are neither read nor returned. Long texts are counted in chunks and taken whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

BUCKETS = 2048
#: The last buckets count words that repeat the word before them; several, so that they weigh more.
REPEATS = 8
RANK = 64
SAMPLE = 4096
K = 9
#: A neighbour's vote weighs its cosine to this power.
POWER = 8
BLOCK = 512
FOLDS = 5
THRESHOLD = 0.3
SEED = 7
#: Texts are counted together up to so many bytes, and longer ones in such pieces.
CHUNK = 1 << 21


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS == 0, F.lit(False))


def _buckets(raw: bytes) -> np.ndarray:
    """The bucket of each trigram, among all but the last `REPEATS`."""
    a = np.frombuffer(raw, dtype=np.uint8).astype(np.uint32)
    code = (a[:-2] << 16 | a[1:-1] << 8 | a[2:]) * np.uint32(2654435761)
    return (code.astype(np.uint64) * np.uint64(BUCKETS - REPEATS) >> np.uint64(32)).astype(np.int64)


def counts(texts: list[str]) -> np.ndarray:
    """(texts, BUCKETS) counts of the trigrams of whole texts; a zero byte stands at either end."""
    out = np.zeros((len(texts), BUCKETS), dtype=np.float32)
    for i, text in enumerate(texts):
        raw = b"\0" + text.encode() + b"\0"
        for at in range(0, len(raw) - 2 if text else 0, CHUNK):
            out[i] += np.bincount(_buckets(raw[at : at + CHUNK + 2]), minlength=BUCKETS)  # none in the last ones
        words = text.split()
        out[i, -REPEATS:] = sum(map(eq, words, words[1:]))
    return out


def _blocks(b: pa.RecordBatch, column: int) -> Iterator[tuple[int, np.ndarray]]:
    texts = b.column(column)
    for at in range(0, len(texts), BLOCK):
        yield at, counts(texts.slice(at, BLOCK).to_pylist())


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n = np.zeros(BUCKETS, dtype=np.int64), 0
    for b in batches:
        for _, c in _blocks(b, 0):
            total += (c > 0).sum(axis=0)
            n += len(c)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS + 1), type=pa.int32()), pa.array(np.append(total, n))], names=["bucket", "n"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at, c in _blocks(b, 0):
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in c], type=pa.binary()), b.column(1).slice(at, BLOCK)], names=["counts", "label"])


class Model:
    """Weights of the buckets, the projection, and the sample's vectors with their labels."""

    def __init__(self, weights: np.ndarray, sample: np.ndarray, labels: np.ndarray) -> None:
        self.weights, self.labels = weights.astype(np.float32), labels.astype(np.float32)
        self.prior = float(labels.mean()) if len(labels) else 0.5
        x = self._weighed(sample)
        q = np.random.default_rng(SEED).standard_normal((BUCKETS, min(RANK + 16, BUCKETS))).astype(np.float32)
        for _ in range(4):  # subspace iterations towards the leading right singular vectors
            q = np.linalg.qr(x.T @ (x @ q))[0]
        _, _, v = np.linalg.svd(x @ q, full_matrices=False)
        self.projection = (q @ v.T)[:, :RANK].astype(np.float32)
        self.vectors = self._unit(x @ self.projection)

    def _weighed(self, c: np.ndarray) -> np.ndarray:
        return self._unit(np.sqrt(c) * self.weights)

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        return x / np.where(norm > 0, norm, 1)

    def score(self, c: np.ndarray) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(c), self.prior)
        z = self._unit(self._weighed(c) @ self.projection)
        near = z @ self.vectors.T
        k = min(K, len(self.labels))
        top = np.argpartition(-near, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(near, top, axis=1), 0).astype(np.float64) ** POWER
        total = weight.sum(axis=1)
        votes = (weight * self.labels[top]).sum(axis=1)
        return np.where(total > 0, votes / np.where(total > 0, total, 1), self.prior)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Model:
    """Learns from at most `sample` labelled rows that are not held out; the weights cover all documents."""
    text = docs.select(text_of().alias("text"))
    seen = {r["bucket"]: r["n"] for r in text.mapInArrow(_frequencies, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()}
    n = seen.get(BUCKETS, 0)
    weights = np.log((1 + n) / (1 + np.array([seen.get(b, 0) for b in range(BUCKETS)]))) + 0.1
    known = labels.select("doc_id", label).where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out())
    chosen = known.groupBy("doc_id").agg(F.avg(label).alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(chosen), "doc_id").orderBy(F.xxhash64("doc_id"), F.xxhash64("text")).limit(sample)
    found = rows.select("text", "label").mapInArrow(_counted, "counts binary, label double").collect()
    matrix = np.frombuffer(b"".join(r["counts"] for r in found), dtype=np.float32).reshape(-1, BUCKETS)
    return Model(weights, matrix, np.array([r["label"] for r in found], dtype=np.float64))


def scored(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, c in _blocks(b, 1):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, BLOCK), pa.array(shared.value.score(c), type=pa.float64())], names=["doc_id", "score"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")
