"""Toxicity by compression distance: two zstandard dictionaries, one of ordinary and one of toxic text.

A window is a run of letters in lower case (a long run gives windows of `WINDOW` letters that overlap by half). Its
margin is what it takes fewer bytes to compress with the toxic dictionary than with the ordinary one. Windows are short,
so each byte is written as two and a common lead stands before the window: then a length counts the phrases of the
dictionary that spell the window, and is never at the floor where nothing is saved. Both dictionaries hold the most
frequent ordinary windows; the toxic one has what zstandard's trainer makes of windows that recur in toxic documents and
are rare in ordinary ones.

A document's evidence is the histogram of its windows' margins. What margin counts as a hit is calibrated: the least one
that at most one in `RARE` ordinary windows reaches. Two halves of the learnt rows lend each other their dictionaries for
this, so that no document is measured by what was made of it, and a logistic regression on the histograms gives the score.

Learning takes at most `SAMPLE` labelled rows of either label, those of the least hashed ids, whole texts; several labels
of one id are averaged, those of unknown documents and null labels are left out, and of several rows of one id the least
text is learnt. If one of the labels has no row, the
score is the share of label 1 (0 without any row). Null and empty texts have no windows and get the score of an empty
histogram. Repeated rows get the same score. A table without rows gives none. Further columns, of any name, are neither
read nor returned. Long texts are read in chunks and taken whole.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, partitions_for, text_of

FOLDS, HELD, THRESHOLD = 3, 1, 0.7
SAMPLE = 4096
LETTERS = re.compile(r"[^\W\d_]+")
WINDOW = 24
CHUNK = 1 << 20
#: Most frequent ordinary windows and most telling toxic ones that the driver makes dictionaries of.
ORDINARY, TOXIC = 10_000, 2_000
#: A toxic window is in so many toxic documents at least, and so many times likelier there than in ordinary ones.
RECURS, LIKELIER = 3, 20
ORDINARY_BYTES, TOXIC_BYTES = 60_000, 16_000
LEVEL = 19
#: The lead that every window has in common, found in both dictionaries.
LEAD = bytes(range(1, 25))
MARGINS = 9
#: A window that has no run of so many characters in common with the toxic ones has margin 0 and isn't compressed.
RUN = 5
RARE = 1000
KNOWN = 400_000
SEED = 7


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS == HELD, F.lit(False))


def windows(text: str) -> Counter[str]:
    """How often each window is in a whole text."""
    out: Counter[str] = Counter()
    at = 0
    while at < len(text):
        to = min(at + CHUNK, len(text))
        while to < len(text) and text[to].isalpha():  # no run is cut
            to += 1
        out.update(LETTERS.findall(text[at:to].lower()))
        at = to
    for run in [r for r in out if len(r) > WINDOW]:
        n = out.pop(run)
        for place in range(0, len(run) - WINDOW // 2, WINDOW // 2):
            out[run[place : place + WINDOW]] += n
    return out


#: Each byte as two; different bytes differ (the factor is odd).
TWO = [(b * 40503 + 12345 & 0xFFFF).to_bytes(2, "little") for b in range(256)]


def doubled(raw: bytes) -> bytes:
    return b"".join([TWO[b] for b in raw])


LED = doubled(LEAD)


def runs(window: str) -> list[str]:
    """The runs of `RUN` characters of a window between spaces."""
    spaced = f" {window} "
    return [spaced[i : i + RUN] for i in range(max(1, len(spaced) - RUN + 1))]


@lru_cache(8)
def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    how = zstandard.ZstdCompressionParameters.from_level(LEVEL, dict_size=len(content), source_size=128, min_match=3, write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
    dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    dictionary.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(dict_data=dictionary, compression_params=how)


class Dictionaries:
    """An ordinary and a toxic dictionary, made of counts of windows."""

    def __init__(self, ordinary: list[str], toxic: list[tuple[str, int]]) -> None:
        common = doubled(" ".join(reversed(ordinary)).encode()[-ORDINARY_BYTES:] + LEAD)  # the most frequent last, where offsets are short
        self.ordinary, self.toxic = common, self._trained(toxic) + common
        self.runs = {r for w, _ in toxic for r in runs(w)}
        self._known: dict[str, int] = {}

    @staticmethod
    def _trained(toxic: list[tuple[str, int]]) -> bytes:
        samples = [doubled(f" {w} ".encode()) for w, n in toxic for _ in range(min(n, 50))]
        random.Random(SEED).shuffle(samples)  # the trainer picks from each stretch of the samples
        try:
            return zstandard.train_dictionary(TOXIC_BYTES, samples, k=24, d=8, level=3).as_bytes()
        except zstandard.ZstdError:  # too few samples to train on: all of them
            return b"".join(dict.fromkeys(samples))

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_known": {}}

    def margin(self, window: str) -> int:
        found = 0
        if not self.runs.isdisjoint(runs(window)):
            raw = LED + doubled(f" {window} ".encode())
            plain, toxic = (len(_compressor(x).compress(raw)) for x in (self.ordinary, self.toxic))
            found = min(max(plain - toxic, 0), MARGINS - 1)
        if len(self._known) >= KNOWN:
            self._known.clear()
        self._known[window] = found
        return found

    def histogram(self, text: str) -> list[int]:
        """How many windows of a text have each margin."""
        out = [0] * MARGINS
        known = self._known.get
        for window, n in windows(text).items():
            margin = known(window)
            out[self.margin(window) if margin is None else margin] += n
        return out


class Model:
    """Dictionaries, the margin of a hit, and the weights of a document's evidence; without dictionaries, one score for all."""

    def __init__(self, dictionaries: Dictionaries | None, histograms: np.ndarray, labels: np.ndarray) -> None:
        self.dictionaries = dictionaries
        self.prior = float(labels.mean()) if len(labels) else 0.0
        if dictionaries is None:
            return
        plain = histograms[labels < 0.5].sum(axis=0)
        over = plain[::-1].cumsum()[::-1]  # ordinary windows with at least that margin
        rare = [m for m in range(1, MARGINS) if over[m] * RARE <= plain.sum()]
        self.hit = rare[0] if rare else MARGINS - 1
        x = self._evidence(histograms)
        self.middle, self.width = x.mean(axis=0), x.std(axis=0) + 1e-9
        self.weights = np.zeros(x.shape[1] + 1)
        x = self._scaled(x)
        for _ in range(50):  # Newton's steps, with a ridge
            p = self._share(x @ self.weights)
            grade = x.T @ (p - labels) + self.weights
            self.weights -= np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + np.eye(len(self.weights)), grade)

    def _evidence(self, h: np.ndarray) -> np.ndarray:
        places = np.arange(MARGINS)
        first = (h > 0) * places
        top = first.max(axis=1)
        rest = h - (places == top[:, None])
        second = ((rest > 0) * places).max(axis=1)
        hits = h[:, self.hit :].sum(axis=1)
        return np.stack([top, second, np.log1p(hits), np.log1p(h @ places), np.log1p(h.sum(axis=1))], axis=1).astype(float)

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return np.c_[(x - self.middle) / self.width, np.ones(len(x))]

    @staticmethod
    def _share(z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def score(self, texts: list[str]) -> np.ndarray:
        if self.dictionaries is None or not texts:
            return np.full(len(texts), self.prior)
        h = np.array([self.dictionaries.histogram(t) for t in texts])
        return self._share(self._scaled(self._evidence(h)) @ self.weights)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for text, label, half in zip(b.column("text"), b.column("label").to_pylist(), b.column("half").to_pylist()):
            found = list(windows(text.as_py()))
            own = [label] * len(found), [half] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(own[0], pa.int32()), pa.array(own[1], pa.int32())], names=["window", "label", "half"])


def _histograms(made: dict[int, Dictionaries]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(b.column("text"), b.column("half").to_pylist())
            h = [made[half].histogram(text.as_py()) for text, half in rows]
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.list_(pa.int64())), b.column("label")], names=["histogram", "label"])

    return run


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE) -> Model:
    """Learns from at most `sample` rows of either label that are not held out."""
    known = labels.select("doc_id", label).where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out())
    averaged = known.groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("int").alias("label"))
    some = lambda df, which: df.where(F.col("label") == which).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    chosen = some(averaged, 0).union(some(averaged, 1))
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int").alias("half")
    rows = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(chosen), "doc_id").repartition(partitions_for(docs), "doc_id")
    learnt = checkpointed(rows.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("text", "label", half))
    n = {(r["label"], r["half"]): r["n"] for r in learnt.groupBy("label", "half").agg(F.count("*").alias("n")).collect()}
    plain, toxic = (n.get((which, 0), 0) + n.get((which, 1), 0) for which in (0, 1))
    if not plain or not toxic:
        return Model(None, np.zeros((0, MARGINS)), np.r_[np.zeros(plain), np.ones(toxic)])
    count = lambda which, part: F.count_if((F.col("label") == which) & (F.col("half") == part))
    counts = learnt.mapInArrow(_windows, "window string, label int, half int").groupBy("window").agg(*[count(w, p).alias(f"n{w}{p}") for w in (0, 1) for p in (0, 1)])
    telling = F.col("n10") + F.col("n11") > LIKELIER / 4 * (F.col("n00") + F.col("n01")) * toxic / plain
    counts = checkpointed(counts)
    common = [tuple(r) for r in counts.orderBy(F.desc(F.col("n00") + F.col("n01")), "window").limit(ORDINARY).collect()]
    odd = [tuple(r) for r in counts.where((F.col("n10") + F.col("n11") > 0) & telling).orderBy(F.desc(F.col("n10") + F.col("n11")), "window").limit(4 * TOXIC).collect()]

    def made(halves: tuple[int, ...]) -> Dictionaries:
        docs_of = [sum(n.get((w, p), 0) for p in halves) for w in (0, 1)]
        counted = lambda r, w: sum(r[1 + 2 * w + p] for p in halves)
        ordinary = sorted(((-counted(r, 0), r[0]) for r in common if counted(r, 0)))
        least = min(RECURS, max(1, docs_of[1] // 20))
        picked = [(r[0], counted(r, 1)) for r in odd if counted(r, 1) >= least and counted(r, 1) * docs_of[0] > LIKELIER * (counted(r, 0) + 0.5) * docs_of[1]]
        return Dictionaries([w for _, w in ordinary], picked[:TOXIC])

    crossed = {0: made((1,)), 1: made((0,))}
    found = learnt.mapInArrow(_histograms(crossed), "histogram array<long>, label int").collect()
    return Model(made((0, 1)), np.array([r["histogram"] for r in found]), np.array([r["label"] for r in found], dtype=float))


def scored(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), 64):
                some = b.slice(at, 64)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(shared.value.score(some.column(1).to_pylist()), pa.float64())], names=["doc_id", "score"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")
