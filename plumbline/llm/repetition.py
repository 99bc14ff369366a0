"""Quality rules on repetition inside a document, by a suffix array over its words.

The suffix array is built by prefix doubling, and the longest common prefixes of neighbouring suffixes follow
from it in the order of the text. A position's longest repeat is the larger of
its two neighbouring prefixes, so the LCP intervals of at least `MIN_REPEAT` words cover, taken together,
the union of the spans of all maximal repeated substrings of that length. Two limits decide: the share of
words so covered, and the longest repeat, which is held against the limit only where it is long in itself
and for its document, so that a refrain in a long text does not reject it. Both lie below what the base rule
already rejects (20 percent of words in repeats of five), so that the method decides on its own.

Null texts have no words. A text without words has zero counts and fails the base rule. Repeated rows each
get their result. Columns of the input that bear names of the measures are left out of quality()'s result.
The document is the unit of work: its words and some 60 bytes a word are held, however long its repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
MIN_REPEAT = 10
MAX_COVERED = 0.10
LONG_REPEAT = 30
LONG_SHARE = 0.05
SYMBOLS = b"#*$%&|<>"
#: Words of two suffixes that are compared for all pairs together; longer common prefixes, and a few pairs, one by one.
STEPS, FEW = 32, 6

SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, longest_repeat long, covered_words long, base_failed boolean, kept boolean, spans string"


def suffix_array(ids: np.ndarray) -> np.ndarray:
    """The order of the suffixes, by prefix doubling.

    A rank is the place of its group in the order, so groups of one stay as they are and only tied
    suffixes are sorted again.
    """
    n = len(ids)
    order = np.argsort(ids, kind="stable").astype(np.int32)
    rank = np.empty(n, dtype=np.int32)
    sorted_ids = ids[order]
    starts = np.concatenate(([True], sorted_ids[1:] != sorted_ids[:-1]))
    rank[order] = np.maximum.accumulate(np.where(starts, np.arange(n, dtype=np.int32), 0))
    width = 1
    tied = order[~(starts & np.concatenate((starts[1:], [True])))]
    while len(tied):
        second = np.full(len(tied), -1, dtype=np.int32)
        inside = tied < n - width
        second[inside] = rank[tied[inside] + width]
        first = rank[tied]
        by = np.lexsort((second, first))
        first, second, tied = first[by], second[by], tied[by]
        place = np.arange(len(tied), dtype=np.int32)
        new_first = np.concatenate(([True], first[1:] != first[:-1]))
        new_pair = new_first | np.concatenate(([True], second[1:] != second[:-1]))
        group_at = np.maximum.accumulate(np.where(new_first, place, 0))
        pair_at = np.maximum.accumulate(np.where(new_pair, place, 0))
        rank[tied] = first + pair_at - group_at
        width *= 2
        tied = tied[~(new_pair & np.concatenate((new_pair[1:], [True])))]
    order[rank] = np.arange(n, dtype=np.int32)
    return order


def _common(ids: np.ndarray, a: int, b: int, known: int) -> int:
    """How many words the suffixes at a and b share, of which `known` are known; compared in growing blocks."""
    at, block = known, 64
    while True:
        m = min(block, len(ids) - max(a, b) - at)
        differ = np.flatnonzero(ids[a + at : a + at + m] != ids[b + at : b + at + m])
        if len(differ):
            return at + int(differ[0])
        at += m
        if m < block:
            return at
        block *= 2


def prefixes(ids: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each position the longest common prefix of its suffix and the one before it in the order.

    Where the words before both suffixes are equal, it is one less than that of the position before, so only
    the others (whose prefixes sum up to at most 2 n log n words) are compared.
    """
    n = len(ids)
    before = np.full(n, -1, dtype=np.int32)
    before[order[1:]] = order[:-1]
    own = np.arange(n, dtype=np.int32)
    follows = (own > 0) & (before > 0)
    follows[follows] = ids[own[follows] - 1] == ids[before[follows] - 1]
    out = np.zeros(n, dtype=np.int32)
    open_ = own[~follows & (before >= 0)]
    step = 0
    while len(open_) > FEW and step < STEPS:
        there = np.maximum(open_, before[open_]) < n - step
        open_ = open_[there]
        open_ = open_[ids[open_ + step] == ids[before[open_] + step]]
        step += 1
        out[open_] = step
    for i in open_.tolist():
        out[i] = _common(ids, i, int(before[i]), step)
    last = np.maximum.accumulate(np.where(follows, 0, own))
    return np.where(follows, out[last] - (own - last), out)


def longest_repeats(ids: np.ndarray, at_least: int) -> np.ndarray:
    """For each position the length of the longest substring there that occurs again, or 0 below at_least."""
    if len(ids) < 2:
        return np.zeros(len(ids), dtype=np.int32)
    order = suffix_array(ids)
    common = prefixes(ids, order)
    best = common.copy()
    best[order[:-1]] = np.maximum(best[order[:-1]], common[order[1:]])
    best[best < at_least] = 0
    return best


def union(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of n positions lie in one of the spans."""
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lengths, -1)
    return np.cumsum(edge[:n]) > 0


def measure(text: str) -> tuple:
    raw = text.encode()
    words = raw.split()
    n = len(words)
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int32, count=n)
    chars = len(b"".join(words).decode())
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeats = longest_repeats(ids, WINDOW)
    at = np.flatnonzero(repeats)
    repeated = int(union(at, np.full(len(at), WINDOW), n).sum()) if len(at) else 0
    long = np.flatnonzero(repeats >= MIN_REPEAT)
    covered = union(long, repeats[long], n) if len(long) else np.zeros(n, dtype=bool)
    longest, total = int(repeats.max(initial=0)), int(covered.sum())
    failed = n < MIN_WORDS or 100 * repeated > MAX_REPEAT_PERCENT * n
    too_much = total > MAX_COVERED * n or longest >= LONG_REPEAT and longest > LONG_SHARE * n
    edges = np.flatnonzero(np.diff(np.concatenate(([False], covered, [False])).astype(np.int8)))
    spans = ",".join(f"{a}:{b}" for a, b in edges.reshape(-1, 2))
    return n, chars, symbols, len(lines) - len(set(lines)), repeated, longest, total, failed, not (failed or too_much), spans


def _measured(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = list(zip(*(measure(t.as_py()) for t in b.column(b.num_columns - 1)))) or [[]] * 10
            kinds = [pa.int64()] * 7 + [pa.bool_()] * 2 + [pa.string()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(x, type=k) for x, k in zip(found, kinds))], names=names)

    return run


def quality(docs: DataFrame, text: str = "text", keep_text: bool = False) -> DataFrame:
    """docs' other columns (with the text if asked) and the measures, verdicts and covered word spans."""
    own = [x.split()[0] for x in SCHEMA.split(", ")]
    names = [c for c in docs.columns if c not in own and (keep_text or c != text)]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema]
    return docs.select(*names, text_of(text).alias("__text")).mapInArrow(_measured([*names, *own]), ", ".join([*fields, SCHEMA]))


def _accepted(at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([measure(t.as_py() or "")[-2] for t in b.column(at)], pa.bool_()))

    return run


def accepted(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs that the rules keep, columns unchanged."""
    return docs.mapInArrow(_accepted(docs.columns.index(text)), docs.schema)
