"""Token ids by a public byte-level BPE, over the distinct words of a slice of texts at a time.

Such a BPE first cuts a text into pre-tokens (a run of letters, digits or other signs, with one space
before it; white space; English contractions) and merges within them only. So a text may be cut before any
single space between two other characters, and a word of the characters of `PLAIN` also between letters and
other signs. Texts are taken in slices bounded by bytes. A slice is cut into words, the words into parts,
equal ones are put together at either step (Arrow's dictionaries), and the tokenizer encodes the parts that
are not among the last `KNOWN` ones. Ids are then gathered back, parts into words and words into texts.
Nothing is held per word between slices, so a worker's memory is bounded by a slice and the known parts.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core

from tokenizers import Tokenizer  # noqa: E402

LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: A word, with or without the space before it, that may be cut between letters and other signs.
PLAIN = f"^ ?[!-&(-~{LETTERS}]+(?:\n[!-&(-~{LETTERS}]+)*$"
#: White space of the Unicode property, as a class without brackets.
SPACE = r"\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: Of texts whose words aren't just what lies between spaces.
IRREGULAR = f"[{SPACE}][{SPACE}]|^[{SPACE}]|[{SPACE}]$"
WORD_CUT = re.compile(r"(?<=\S) (?=\S)")
MARK = "\x01"
KNOWN = 300_000
SLICE_BYTES = 3 << 20
SLICE_TEXTS = 4096
#: Parts that are one text for the tokenizer: it holds over 100 bytes for each id.
RUN = 8192
EMPTY = pa.scalar("", pa.large_string())


def _joined(words: pa.Array, cuts: np.ndarray) -> pa.Array:
    """Runs of neighbouring binary values as one each; the run i lies from cuts[i] to before cuts[i + 1]."""
    ends = np.frombuffer(words.buffers()[1], dtype=np.int64, count=len(words) + 1, offset=8 * words.offset)
    return pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(ends[cuts]), words.buffers()[2]])


def _binary(raw: bytes | np.ndarray, ends: np.ndarray) -> pa.Array:
    """large_binary values that lie between neighbouring ends of raw."""
    return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(raw)])


class Encoder:
    """Gives ids as little-endian unsigned 32-bit bytes, with the end id appended; no special tokens are added."""

    def __init__(self, path: str, end: int | None = 0, known: int = KNOWN) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.end = b"" if end is None else end.to_bytes(4, "little")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
        for token, i in vocabulary.items():
            self.bytes_of[i] = len(token)  # a byte-level vocabulary writes each byte as one character
        self.known = known
        self.parts = pa.array([], pa.large_string())
        self.ids = pa.array([], pa.large_binary())

    def slices(self, texts: pa.Array) -> Iterator[pa.Array]:
        """The ids of the texts, in order, as large_binary arrays for up to about `SLICE_BYTES` of text each."""
        texts = texts.cast(pa.large_string())
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) if len(texts) else []
        at = 0
        while at < len(texts):
            before = ends[at - 1] if at else 0
            to = max(at + 1, min(int(np.searchsorted(ends, before + SLICE_BYTES)), at + SLICE_TEXTS))
            yield self._slice(texts.slice(at, to - at))
            pa.default_memory_pool().release_unused()
            at = to

    def ids_of(self, texts: list[str]) -> list[bytes]:
        return [x for s in self.slices(pa.array(texts, pa.large_string())) for x in s.to_pylist()]

    def _slice(self, texts: pa.Array) -> pa.Array:
        flat, starts = self._words(texts)
        n = len(texts)
        first = np.zeros(len(flat), dtype=bool)
        first[starts[:-1]] = True
        rest = flat.filter(pa.array(~first)).dictionary_encode()
        heads = flat.take(pa.array(starts[:-1]))
        del flat
        led = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), rest.dictionary, EMPTY)
        found = pa.concat_arrays([self._encoded(pa.concat_arrays([led, heads])), pa.array([self.end], pa.large_binary())])
        # The words of each text, then the end id.
        order = np.full(len(first) + n, len(found) - 1, dtype=np.int64)
        place = np.arange(len(first)) + np.repeat(np.arange(n), np.diff(starts))
        order[place[~first]] = rest.indices.to_numpy()
        order[place[first]] = len(led) + np.arange(n)
        return _joined(found.take(pa.array(order)), starts + np.arange(n + 1))

    def _words(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """All words, without the space before them, and where each text's begin; every text has one at least."""
        odd = pc.match_substring_regex(texts, IRREGULAR)
        for s in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, s))
        if not pc.any(odd).as_py():
            lists = pc.split_pattern(texts, " ")
        else:
            special = lambda t: any(s in t for s in self.special)
            cut = [([t] if special(t) else WORD_CUT.split(t)) if o else t.split(" ") for t, o in zip(texts.to_pylist(), odd.to_pylist())]
            lists = pa.array(cut, pa.list_(pa.large_string()))
        starts = lists.offsets.to_numpy().astype(np.int64)
        return lists.flatten(), starts - starts[0]

    def _encoded(self, words: pa.Array) -> pa.Array:
        """The ids of each word, which has its space if one is before it."""
        whole = pc.invert(pc.match_substring_regex(words, PLAIN))
        for s in self.special:
            whole = pc.or_(whole, pc.match_substring(words, s))
        marked = pc.replace_substring_regex(words, f"([{LETTERS}])([^{LETTERS}])", rf"\1{MARK}\2")
        marked = pc.replace_substring_regex(marked, f"([^{LETTERS}{MARK} ])([{LETTERS}])", rf"\1{MARK}\2")
        lists = pc.split_pattern(pc.if_else(whole, EMPTY, marked), MARK)
        cuts = lists.offsets.to_numpy().astype(np.int64)
        parts = lists.flatten().dictionary_encode()
        out = _joined(self._known(parts.dictionary).take(parts.indices), cuts)
        if pc.any(whole).as_py():
            odd = words.filter(whole).dictionary_encode()
            batch = self.tokenizer.encode_batch_fast(odd.dictionary.to_pylist(), add_special_tokens=False)
            ids = pa.array([np.array(e.ids, dtype="<u4").tobytes() for e in batch], pa.large_binary())
            out = pc.replace_with_mask(out, whole, ids.take(odd.indices))
        return out

    def _known(self, parts: pa.Array) -> pa.Array:
        """The ids of distinct parts, the new ones encoded and kept."""
        at = pc.index_in(parts, self.parts)
        if at.null_count:
            new = parts.filter(at.is_null())
            ids = self._new(new)
            place = np.cumsum(at.is_null().to_numpy(zero_copy_only=False)) - 1 + len(self.parts)
            at = pc.if_else(at.is_null(), pa.array(place), at.cast(pa.int64()))
            self.parts, self.ids = pa.concat_arrays([self.parts, new]), pa.concat_arrays([self.ids, ids])
        out = self.ids.take(at)
        if len(self.parts) > self.known:  # the oldest go; what recurs is learnt again
            late = pa.array(np.arange(len(self.parts) - self.known // 2, len(self.parts)))
            self.parts, self.ids = self.parts.take(late), self.ids.take(late)
        return out

    def _new(self, parts: pa.Array) -> pa.Array:
        """The ids of parts: many are one text for the tokenizer, and are told apart by the tokens' bytes.

        A part that begins with a space is a pre-token of its own as it is, others are with line feeds between.
        """
        led = pc.match_substring_regex(parts, f"^ [{LETTERS}]").to_numpy(zero_copy_only=False)
        alone = pc.or_(pc.match_substring(parts, "\n"), pc.equal(parts, "")).to_numpy(zero_copy_only=False)
        kinds = [(np.flatnonzero(led), ""), (np.flatnonzero(~led & ~alone), "\n")]
        runs = [(own[at : at + RUN], mark) for own, mark in kinds for at in range(0, len(own), RUN)]
        pieces = [self._run(parts.take(pa.array(some)), mark) for some, mark in runs]
        own = np.flatnonzero(alone)
        batch = self.tokenizer.encode_batch_fast(parts.take(pa.array(own)).to_pylist(), add_special_tokens=False)
        pieces.append(pa.array([np.array(e.ids, dtype="<u4").tobytes() for e in batch], pa.large_binary()))
        return pa.concat_arrays(pieces).take(pa.array(np.argsort(np.concatenate([kinds[0][0], kinds[1][0], own]))))

    def _run(self, parts: pa.Array, mark: str) -> pa.Array:
        text = mark.join(parts.to_pylist())
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
        lengths = pc.binary_length(parts).to_numpy()
        ends = np.cumsum(self.bytes_of[ids])
        last = np.cumsum(lengths + len(mark)) - len(mark)
        cuts = np.concatenate(([0], np.searchsorted(ends, last) + 1)).astype(np.int64)
        if mark:  # the mark before a part is a token
            keep = np.ones(len(ids), dtype=bool)
            keep[cuts[1:-1]] = False
            ids = ids[keep]
            cuts[1:] -= np.arange(len(parts))
        return _binary(ids, 4 * cuts)


_encoders: dict[tuple[str, int | None], Encoder] = {}


def encoder(path: str, end: int | None = 0) -> Encoder:
    """One encoder for each worker process; what it knows lives on between batches."""
    if (path, end) not in _encoders:
        _encoders[path, end] = Encoder(path, end)
    return _encoders[path, end]
