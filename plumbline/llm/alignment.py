"""Cross-tokenizer alignment: which tokens of two vocabularies stand for the same bytes, and how often.

A is a byte-level BPE of the tokenizers library, B a sentencepiece model that adds a space in front. Both encode a
space and the text; the byte offsets at which tokens of both end cut them into groups, and two tokens are linked if
their byte ranges overlap. Neither crosses a space between two other characters, so a text is taken as its words, each
with the space before it, and what is known of a word (its groups and its links) serves wherever it stands.

A pair of linked ids is one int64, id A shifted left by `SHIFT` plus id B. Texts are encoded once: each document's distinct
pairs, with how often it has them, are kept (sorted differences, compressed). The count of a pair is the number of
documents that hold it: every task sums the pairs of its documents (np.unique), the sums are sorted by key over range
partitions and runs of a key summed up. The sorted shards are files, all keys and then all counts; tasks map them into
memory and find the kept pairs by searchsorted, so no worker holds the table. The highest count of each id of A has one
number for each id of the vocabulary and is broadcast.

Null and empty texts, and texts whose bytes the two token sequences don't both give back, have no tokens: zeros and an
empty digest. Special tokens' strings are plain text. Equal texts of several rows count as one document each. A table
without rows gives none. Further columns, of any name, are neither read nor returned. Very long texts are taken whole; a
word without spaces has to fit a task.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import Broadcast, SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, fresh_path, partitions_for, text_of, written
from .tokens import IRREGULAR, RUN, SLICE_BYTES, SLICE_TEXTS, WORD_CUT, _joined
from .tokens import SPACE as WHITE

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core

from sentencepiece import SentencePieceProcessor  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

#: Bits of an id of B in a key, and of a key below the number of a text in its slice.
SHIFT, KEY_BITS = 20, 42
#: Words that a worker knows at once, and pairs it sums before it hands them on.
KNOWN, PARTIAL = 300_000, 4_000_000
#: Pairs in a file of counts.
SHARD = 1 << 20
SPACE = "▁"


def byte_level() -> dict[str, int]:
    """The byte of each character of a byte-level vocabulary: printable ones stand for themselves, the others follow from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabularies:
    """Two tokenizers, the bytes of their ids, and how ids are written in a digest's text."""

    def __init__(self, path_a: str, path_b: str) -> None:
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=path_b)
        of = byte_level()
        vocabulary = self.a.get_vocab()
        raw_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            raw_a[i] = bytes(of[c] for c in token) if all(c in of for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        raw_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        if len(raw_a) >= 1 << KEY_BITS - SHIFT or len(raw_b) >= 1 << SHIFT:
            raise ValueError("ids don't fit a key")
        self.raw = [pa.array(x, pa.large_binary()) for x in (raw_a, raw_b)]
        self.sizes = [pc.binary_length(x).to_numpy() for x in self.raw]
        #: Within a group and at its end, of A and then of B.
        self.written = pa.array([f"{i}{mark}" for x, marks in ((raw_a, ",|"), (raw_b, ",;")) for mark in marks for i in range(len(x))], pa.large_string()).cast(pa.large_binary())
        #: Whether no piece has a space after another character, so that a text may be cut before spaces.
        self.cuts = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces)


@lru_cache(1)
def vocabularies(path_a: str, path_b: str) -> Vocabularies:
    """Loaded once for each worker process."""
    return Vocabularies(path_a, path_b)


class Aligner:
    """Aligns the distinct words of slices of texts, and knows the last ones: a table with a place for each word.

    numbers: for each word whether both token sequences give its bytes, its tokens of A and of B, its groups, its links.
    """

    def __init__(self, path_a: str, path_b: str, known: int = KNOWN) -> None:
        self.of = vocabularies(path_a, path_b)
        self.most = known
        self._forget()

    def _forget(self) -> None:
        self.words, self.groups = pa.array([], pa.large_string()), pa.array([], pa.large_binary())
        self.numbers = np.zeros((5, 0), dtype=np.int64)
        self.keys = np.zeros(0, dtype=np.int64)

    def cut(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The words of all texts, without the space before them, and where each text's begin; every text has one at least."""
        if not self.of.cuts:
            return texts, np.arange(len(texts) + 1)
        odd = pc.match_substring_regex(texts, IRREGULAR)
        if pc.any(odd).as_py():
            lists = pa.array([WORD_CUT.split(t) if o else t.split(" ") for t, o in zip(texts.to_pylist(), odd.to_pylist())], pa.list_(pa.large_string()))
        else:
            lists = pc.split_pattern(texts, " ")
        starts = lists.offsets.to_numpy().astype(np.int64)
        return lists.flatten(), starts - starts[0]

    def places(self, words: pa.Array) -> np.ndarray:
        """The places of distinct words in the table; new ones are learnt."""
        at = pc.index_in(words, self.words)
        if at.null_count:
            if len(self.words) + at.null_count > self.most:  # what recurs is learnt again
                self._forget()
                at = pa.nulls(len(words), pa.int32())
            new = at.is_null()
            place = np.cumsum(new.to_numpy(zero_copy_only=False)) - 1 + len(self.words)
            at = pc.if_else(new, pa.array(place), at.cast(pa.int64()))
            self._learn(words.filter(new))
        return at.to_numpy(zero_copy_only=False).astype(np.int64)

    def _ids_a(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """A's ids of all words, and how many each has. Words without space at their ends are encoded as one text."""
        plain = pc.invert(pc.match_substring_regex(words, f"^$|^[{WHITE}]|[{WHITE}]$")).to_numpy(zero_copy_only=False)
        ids, sizes = [], np.zeros(len(words), dtype=np.int64)
        order = np.r_[np.flatnonzero(plain & self.of.cuts), np.flatnonzero(~(plain & self.of.cuts))]
        led = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), words.take(pa.array(order)), pa.scalar(" ", pa.large_string()))
        whole = int((plain & self.of.cuts).sum())
        for at in range(0, whole, RUN):
            some = led.slice(at, min(RUN, whole - at))
            found = np.array(self.of.a.encode_batch_fast(["".join(some.to_pylist())], add_special_tokens=False)[0].ids, dtype=np.int64)
            ends = np.searchsorted(np.cumsum(self.of.sizes[0][found]), np.cumsum(pc.binary_length(some).to_numpy())) + 1
            sizes[order[at : at + len(some)]] = np.diff(np.r_[0, ends])
            ids.append(found)
        rest = self.of.a.encode_batch_fast(led.slice(whole).to_pylist(), add_special_tokens=False)
        sizes[order[whole:]] = [len(e.ids) for e in rest]
        flat = np.concatenate([*ids, *[np.array(e.ids, dtype=np.int64) for e in rest]]) if len(words) else np.zeros(0, dtype=np.int64)
        first = np.zeros(len(words), dtype=np.int64)
        first[order] = np.cumsum(sizes[order]) - sizes[order]
        return flat[spread(first, sizes)], sizes

    def _ids_b(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        found = self.of.b.encode(words.to_pylist(), num_threads=1)
        return np.fromiter(chain.from_iterable(found), dtype=np.int64), np.array([len(x) for x in found], dtype=np.int64)

    def _learn(self, words: pa.Array) -> None:
        led = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), words, pa.scalar(" ", pa.large_string())).cast(pa.large_binary())
        ids, sizes = zip(self._ids_a(words), self._ids_b(words))
        same = [pc.equal(_joined(raw.take(pa.array(i)), np.r_[0, np.cumsum(n)]), led).to_numpy(zero_copy_only=False) for raw, i, n in zip(self.of.raw, ids, sizes)]
        valid = same[0] & same[1]
        of = [np.repeat(np.arange(len(words)), n) for n in sizes]  # the word of each token
        (a, b), (word_a, word_b) = zip(*[(i[valid[w]], w[valid[w]]) for i, w in zip(ids, of)])
        # All words one after another: a segment between neighbouring ends of either's tokens is one link.
        end_a, end_b = np.cumsum(self.of.sizes[0][a]), np.cumsum(self.of.sizes[1][b])
        every = np.union1d(end_a, end_b)
        at_a, at_b = np.searchsorted(end_a, every), np.searchsorted(end_b, every)
        keys, word = a[at_a] << SHIFT | b[at_b], word_a[at_a]
        last_a, last_b = np.isin(end_a, end_b, assume_unique=True), np.isin(end_b, end_a, assume_unique=True)
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        n_groups = int(last_a.sum())
        before_b, upto_a = np.r_[0, np.cumsum(np.bincount(group_b, minlength=n_groups))], np.cumsum(np.bincount(group_a, minlength=n_groups))
        order = np.empty(len(a) + len(b), dtype=np.int64)  # in each group A's tokens, then B's
        order[np.arange(len(a)) + before_b[group_a]] = a + len(self.of.raw[0]) * last_a
        order[np.arange(len(b)) + upto_a[group_b]] = b + 2 * len(self.of.raw[0]) + len(self.of.raw[1]) * last_b
        per = lambda x: np.bincount(x, minlength=len(words)).astype(np.int64)
        n_a, n_b = per(word_a), per(word_b)
        self.numbers = np.concatenate([self.numbers, [valid, n_a, n_b, per(word_a[last_a]), per(word)]], axis=1)
        self.words, self.keys = pa.concat_arrays([self.words, words]), np.r_[self.keys, keys]
        self.groups = pa.concat_arrays([self.groups, _joined(self.of.written.take(pa.array(order)), np.r_[0, np.cumsum(n_a + n_b)])])

    def slices(self, texts: pa.Array) -> Iterator[tuple[int, Slice]]:
        """The texts in order, in slices of up to about SLICE_BYTES, each with the place of its first."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) if len(texts) else []
        at = 0
        while at < len(texts):
            to = max(at + 1, min(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES)), at + SLICE_TEXTS))
            yield at, Slice(self, texts.slice(at, to - at))
            pa.default_memory_pool().release_unused()
            at = to


def spread(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of runs that begin at `first`, one run after another."""
    return np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


class Slice:
    """Some texts as places in the table of words, as it is now."""

    def __init__(self, aligner: Aligner, texts: pa.Array) -> None:
        flat, self.starts = aligner.cut(texts)
        coded = flat.dictionary_encode()
        self.place = aligner.places(coded.dictionary)[coded.indices.to_numpy()]
        self.numbers, self.keys, self.groups = aligner.numbers, aligner.keys, aligner.groups
        empty = pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        self.valid = (self._sums(1 - self.numbers[0]) == 0) & ~empty

    def _sums(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values[self.place], self.starts[:-1])

    def totals(self) -> list[np.ndarray]:
        """Of each text the sums of the numbers of its words, all but the first."""
        return [np.where(self.valid, self._sums(x), 0) for x in self.numbers[1:]]

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct keys of each valid text with how often it has them, in order, and how many each text has."""
        known, texts = self.numbers.shape[1], len(self.starts) - 1
        text = np.repeat(np.arange(texts), np.diff(self.starts))
        of, times = np.unique((text * known + self.place)[self.valid[text]], return_counts=True)
        text, word = of // known, of % known
        sizes = self.numbers[4]
        n = sizes[word]
        at = spread((np.cumsum(sizes) - sizes)[word], n)
        keys, times = merged(np.repeat(text, n) << KEY_BITS | self.keys[at], np.repeat(times, n))
        return keys & (1 << KEY_BITS) - 1, times, np.bincount(keys >> KEY_BITS, minlength=texts)

    def digests(self) -> list[str]:
        """The digest of each text's groups."""
        joined = _joined(self.groups.take(pa.array(self.place)), self.starts)
        return [hashlib.sha256(memoryview(g.as_buffer())[:-1]).hexdigest() if ok else "" for g, ok in zip(joined, self.valid)]


def merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.array([], dtype=np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


@lru_cache(1)
def _aligner(path_a: str, path_b: str) -> Aligner:
    """One for each worker process; what it knows lives on between batches and tasks."""
    return Aligner(path_a, path_b)


def packed(keys: np.ndarray, times: np.ndarray) -> bytes:
    """Sorted keys and how often they are there: differences and numbers by the places of their bytes, compressed."""
    by_place = lambda x: np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()
    return zstandard.compress(by_place(np.diff(keys, prepend=0).astype("<i8")) + by_place(times.astype("<u4")), 1)


def unpacked(data: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.decompress(data), dtype=np.uint8)
    whole = lambda x, kind: np.ascontiguousarray(x.reshape(np.dtype(kind).itemsize, n).T).view(kind).ravel()
    return np.cumsum(whole(raw[: 8 * n], "<i8")), whole(raw[8 * n :], "<u4").astype(np.int64)


def _taken(path_a: str, path_b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, s in _aligner(path_a, path_b).slices(b.column(1)):
                keys, times, sizes = s.pairs()
                ends = np.cumsum(sizes)
                data = [packed(keys[e - n : e], times[e - n : e]) for e, n in zip(ends, sizes)]
                arrays = [b.column(0).slice(at, len(sizes)), *[pa.array(x) for x in s.totals()], pa.array(s.digests(), pa.string()), pa.array(sizes), pa.array(data, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_pairs", "pairs"])

    return run


def _parts(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """The pairs of the documents of a batch of (pairs, n_pairs, ...), some documents at a time: the place of the first, sizes, keys, times."""
    sizes = b.column("n_pairs").to_numpy()
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SHARD)))
        found = [unpacked(x.as_py(), n) for x, n in zip(b.column("pairs").slice(at, to - at), sizes[at:to])]
        yield at, sizes[at:to], np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
        at = to


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys, counts, held = [], [], 0

    def handed() -> Iterator[pa.RecordBatch]:
        for at in range(0, len(keys[0]), SHARD):
            yield pa.RecordBatch.from_arrays([pa.array(keys[0][at : at + SHARD]), pa.array(counts[0][at : at + SHARD])], names=["key", "n"])

    for b in batches:
        for _, _, own, _ in _parts(b):
            k, n = np.unique(own, return_counts=True)
            keys, counts, held = [*keys, k], [*counts, n.astype(np.int64)], held + len(k)
            if held > PARTIAL:
                keys, counts = ([x] for x in merged(np.concatenate(keys), np.concatenate(counts)))
                held = len(keys[0])
                if held > PARTIAL // 2:
                    yield from handed()
                    keys, counts, held = [], [], 0
    if keys:
        keys, counts = ([x] for x in merged(np.concatenate(keys), np.concatenate(counts)))
        yield from handed()


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of (key, n) with runs of a key summed up, as shards of at most `SHARD` pairs with the highest count of each id of A in them."""

    def shard(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        ids = keys >> SHIFT
        first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        data = [keys.astype("<i8").tobytes() + counts.astype("<i8").tobytes()]
        top = [pa.array([x], pa.list_(pa.int64())) for x in (ids[first], np.maximum.reduceat(counts, first))]
        return pa.RecordBatch.from_arrays([pa.array([int(keys[0])], pa.int64()), *top, pa.array(data, pa.binary())], names=["first", "ids", "top", "data"])

    keys = counts = np.array([], dtype=np.int64)
    for b in batches:
        keys, counts = merged(np.concatenate([keys, b.column(0).to_numpy()]), np.concatenate([counts, b.column(1).to_numpy()]))
        while len(keys) > SHARD:  # the last run may go on
            yield shard(keys[:SHARD], counts[:SHARD])
            keys, counts = keys[SHARD:], counts[SHARD:]
    if len(keys):
        yield shard(keys, counts)


class Counts:
    """Sorted shards of counts, mapped from files."""

    def __init__(self, files: list[str]) -> None:
        self.files = []
        for f in files:
            n = (os.path.getsize(f) - 1) // 16  # the writer ends a value with one more byte
            self.files.append((np.memmap(f, dtype="<i8", mode="r", shape=(n,)), np.memmap(f, dtype="<i8", mode="r", offset=8 * n, shape=(n,))))
        self.files.sort(key=lambda x: x[0][0])
        self.firsts = np.array([x[0][0] for x in self.files], dtype=np.int64)

    def of(self, keys: np.ndarray) -> np.ndarray:
        """The counts of keys."""
        distinct, back = np.unique(keys, return_inverse=True)
        out = np.zeros(len(distinct), dtype=np.int64)
        cuts = np.searchsorted(distinct, self.firsts)
        for (known, counts), a, b in zip(self.files, cuts, [*cuts[1:], len(distinct)]):
            at = np.minimum(np.searchsorted(known, distinct[a:b]), len(known) - 1)
            out[a:b] = np.where(known[at] == distinct[a:b], counts[at], 0)  # a pair of invalid texts alone has none
        return out[back]


def published(spark: SparkSession, folder: str, copies: bool = False) -> tuple[str, ...]:
    """The files of a written folder as executors can map them: by their path in a shared file system, else as a copy that each executor fetches."""
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [x.getPath() for x in files.listStatus(place) if x.getPath().getName().startswith("part-") and x.getLen() > 1]
    if files.getScheme() == "file" and not copies:
        return tuple(sorted(f.toUri().getPath() for f in found))
    for f in found:
        spark.sparkContext.addFile(f.toString())
    return tuple(sorted(f.getName() for f in found))


def counted(taken: DataFrame) -> DataFrame:
    """Shards (first, ids, top, data) of the counts of all pairs that documents have, kept."""
    partial = checkpointed(taken.select("n_pairs", "pairs").mapInArrow(_partial, "key long, n long"))
    dealt = partial.repartitionByRange(partitions_for(taken), "key").sortWithinPartitions("key")
    return checkpointed(dealt.mapInArrow(_shards, "first long, ids array<long>, top array<long>, data binary"))


@lru_cache(1)
def _mapped(files: tuple[str, ...]) -> Counts:
    return Counts([f if os.path.isabs(f) else SparkFiles.get(f) for f in files])


def _weighed(files: tuple[str, ...], top: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            best, total = np.zeros(len(b), dtype=np.int64), np.zeros(len(b), dtype=np.int64)
            for at, sizes, keys, times in _parts(b):
                count = _mapped(files).of(keys) if len(keys) else keys
                cuts = np.r_[0, np.cumsum(sizes)]
                per = lambda x: np.diff(np.r_[0, np.cumsum(x)][cuts])
                best[at : at + len(sizes)] = per(times * (count == top.value[keys >> SHIFT]))
                total[at : at + len(sizes)] = per(times * count)
            names = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
            arrays = [*[b.column(c) for c in names], pa.array(best), pa.array(total), b.column("groups_sha256")]
            yield pa.RecordBatch.from_arrays(arrays, names=[*names, "n_best", "count_sum", "groups_sha256"])

    return run


def taken(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Of each document its tokens, groups, links, the digest of its groups and its pairs, kept."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return written(rows.mapInArrow(_taken(path_a, path_b), f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_pairs long, pairs binary"), "pairs")


def align(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text", copies: bool = False) -> DataFrame:
    """For each document its tokens, groups and links, the links of the highest count of their id of A, the sum of the
    links' counts, and a digest of its groups. `copies` makes executors fetch the files of counts."""
    spark = docs.sparkSession
    held = taken(docs, path_a, path_b, doc_id, text)
    shards = counted(held)
    folder = fresh_path(spark, "pair-counts")
    shards.select(F.col("data").cast("string")).write.option("maxRecordsPerFile", 1).option("compression", "none").text(folder)
    best = shards.select(F.explode(F.arrays_zip("ids", "top"))).groupBy("col.ids").agg(F.max("col.top").alias("top")).collect()  # one row for each id at most
    top = np.zeros(1 << KEY_BITS - SHIFT, dtype=np.int64)
    for r in best:
        top[r["ids"]] = r["top"]
    run = _weighed(published(spark, folder, copies), spark.sparkContext.broadcast(top))
    kind = held.schema["doc_id"].dataType.simpleString()
    return held.mapInArrow(run, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def links(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(a, b, n): the ids linked in documents and the number of documents that hold the pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0):
                keys, n = np.frombuffer(data.as_py(), dtype="<i8").reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array(keys >> SHIFT), pa.array(keys & (1 << SHIFT) - 1), pa.array(n)], names=["a", "b", "n"])

    return counted(taken(docs, path_a, path_b)).select("data").mapInArrow(run, "a long, b long, n long")
