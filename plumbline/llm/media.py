"""Media columns of AVI motion-JPEG: writing, parsing, intra-frame decoding and shot detection.

Writing stores bytes losslessly as 8-bit samples. A frame has 64 by 16 blocks of 8 by 8 pixels; each block
has one grey level, which is one byte, so a DC quantiser of 8 keeps it exactly and there is no AC. With DC
codes of 9 - s bits for size s, every block takes 9 bits and one for its end, and blocks are coded and
decoded by whole arrays. Any baseline JPEG decoder reads such frames. An `INFO` list holds the payload's length;
the last frame is filled up with the last byte.

Reading parses the RIFF tree and its `idx1` index, and decodes baseline intra frames of any Huffman and
quantisation tables (the luminance plane of several components): frames whose blocks all have one length by
array, others block by block. Shots are found by histogram differences of neighbouring frames: a boundary
is where the difference exceeds both a floor and the mean plus `SPREAD` standard deviations of the
differences in the window around it. Clips have their times, frames and mean level.

A null or broken media value gives no clips; a null or empty text is a payload of zero bytes. Equal payloads
give equal media and clips, and repeated rows each their own. Columns that bear names of the results are
replaced. A table without rows gives none. A text is the unit of work: a very long one, its samples and its
frames are held together.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

ACROSS, DOWN = 64, 16
FRAME = ACROSS * DOWN
RATE = 25
ALIGN = 64
LEVELS = 16
WINDOW = 8
SPREAD = 2.5
FLOOR = 0.25


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _head() -> bytes:
    """All of a frame before its coded blocks: a code of 9 - s bits for DC size s, one of 1 bit for a block's end."""
    quantiser = _segment(0xDB, bytes([0, 8] + [1] * 63))
    size = _segment(0xC0, struct.pack(">BHHB3B", 8, DOWN * 8, ACROSS * 8, 1, 1, 0x11, 0))
    dc = _segment(0xC4, bytes([0x00] + [1] * 9 + [0] * 7 + list(range(8, -1, -1))))
    ac = _segment(0xC4, bytes([0x10, 1] + [0] * 15 + [0]))
    return b"\xff\xd8" + quantiser + size + dc + ac + _segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))


HEAD = _head()


def _dc_codes() -> np.ndarray:
    """By difference + 255: the 9 bits of its size's code and its magnitude."""
    out = np.zeros(511, dtype=np.uint16)
    for d in range(-255, 256):
        s = abs(d).bit_length()
        prefix = (1 << (9 - s)) - 2  # codes of growing length: 0, 10, 110, ... for sizes 8, 7, 6, ...
        out[d + 255] = prefix << s | (d if d >= 0 else d + (1 << s) - 1)
    return out


DC_CODES = _dc_codes()
DC_OF = np.zeros(512, dtype=np.int64)
DC_OF[DC_CODES] = np.arange(-255, 256)


def encode_frames(samples: np.ndarray) -> list[bytes]:
    """JPEG frames of (frames, FRAME) samples."""
    levels = samples.astype(np.int64) - 128
    steps = np.diff(levels, axis=1, prepend=0)
    codes = DC_CODES[steps + 255].astype(np.uint64) << np.uint64(1)
    four = codes.reshape(len(samples), -1, 4)
    packed = four[:, :, 0] << np.uint64(30) | four[:, :, 1] << np.uint64(20) | four[:, :, 2] << np.uint64(10) | four[:, :, 3]
    raw = packed.astype(">u8").view(np.uint8).reshape(len(samples), -1, 8)[:, :, 3:]
    return [HEAD + row.tobytes().replace(b"\xff", b"\xff\x00") + b"\xff\xd9" for row in raw.reshape(len(samples), -1)]


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def _list(kind: bytes, *parts: bytes) -> bytes:
    return _chunk(b"LIST", kind + b"".join(parts))


def write_avi(payload: bytes) -> bytes:
    samples = np.frombuffer(payload, dtype=np.uint8)
    n = max(1, -(-len(samples) // FRAME))
    padded = np.concatenate([samples, np.full(n * FRAME - len(samples), samples[-1] if len(samples) else 0, dtype=np.uint8)])
    frames = encode_frames(padded.reshape(n, FRAME))
    most = max(map(len, frames))
    avih = struct.pack("<14I", 1_000_000 // RATE, most * RATE, 0, 0x10, n, 0, 1, most, ACROSS * 8, DOWN * 8, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, RATE, 0, n, most, 0xFFFFFFFF, 0, 0, 0, ACROSS * 8, DOWN * 8)
    strf = struct.pack("<IiiHH4sIiiII", 40, ACROSS * 8, DOWN * 8, 1, 24, b"MJPG", ACROSS * DOWN * 192, 0, 0, 0, 0)
    header = _list(b"hdrl", _chunk(b"avih", avih), _list(b"strl", _chunk(b"strh", strh), _chunk(b"strf", strf)))
    info = _list(b"INFO", _chunk(b"ICMT", b"payload_bytes=%d" % len(payload)))
    index, at, movi = [], 4, []
    for f in frames:
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        movi.append(_chunk(b"00dc", f))
        at += len(movi[-1])
    return _chunk(b"RIFF", b"".join([b"AVI ", header, info, _list(b"movi", *movi), _chunk(b"idx1", b"".join(index))]))


class Avi:
    """What the RIFF tree and the index of an AVI file say."""

    def __init__(self, data: bytes) -> None:
        if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
            raise ValueError("not an AVI file")
        self.data, self.rate, self.comment, self.frames = data, float(RATE), b"", []
        self._movi, self._index = 0, b""
        self._walk(12, min(len(data), 8 + struct.unpack_from("<I", data, 4)[0]))
        for at in range(0, len(self._index) - 15, 16):
            name, _, offset, size = struct.unpack_from("<4sIII", self._index, at)
            if name[2:] in (b"dc", b"db"):
                start = self._movi + offset
                if data[start : start + 4] != name:  # some writers count from the file's start
                    start = offset
                self.frames.append((start + 8, size))

    def _walk(self, at: int, end: int) -> None:
        while at + 8 <= end:
            name, size = struct.unpack_from("<4sI", self.data, at)
            body = at + 8
            if name == b"LIST":
                if self.data[body : body + 4] == b"movi":
                    self._movi = body
                else:
                    self._walk(body + 4, body + size)
            elif name == b"idx1":
                self._index = self.data[body : body + size]
            elif name == b"ICMT":
                self.comment = self.data[body : body + size]
            elif name == b"strh" and self.data[body : body + 4] == b"vids":
                scale, rate = struct.unpack_from("<II", self.data, body + 20)
                self.rate = rate / scale if scale else self.rate
            at = body + size + size % 2

    def payload_bytes(self) -> int | None:
        return int(self.comment[14:].rstrip(b"\0")) if self.comment.startswith(b"payload_bytes=") else None


def _huffman(counts: bytes, symbols: bytes) -> dict[tuple[int, int], int]:
    """(length, code) to symbol."""
    out, code, at = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out[length, code] = symbols[at]
            code, at = code + 1, at + 1
        code <<= 1
    return out


def _levels(values: np.ndarray, n: int) -> np.ndarray:
    return np.clip(values[:n] + 128, 0, 255).astype(np.uint8)


def decode_frame(frame: bytes) -> tuple[np.ndarray, int]:
    """The mean grey level of each block of the first component, row by row, and the number of blocks across."""
    if frame.startswith(HEAD):  # every block has ten bits
        raw = np.frombuffer(frame[len(HEAD) : -2].replace(b"\xff\x00", b"\xff"), dtype=np.uint8).reshape(-1, 5).astype(np.uint64)
        word = raw[:, 0] << np.uint64(32) | raw[:, 1] << np.uint64(24) | raw[:, 2] << np.uint64(16) | raw[:, 3] << np.uint64(8) | raw[:, 4]
        codes = np.stack([word >> np.uint64(k) & np.uint64(511) for k in (31, 21, 11, 1)], axis=1).reshape(-1)
        return _levels(np.cumsum(DC_OF[codes]), FRAME), ACROSS
    return _decode_any(frame)


def _decode_any(frame: bytes) -> tuple[np.ndarray, int]:
    """decode_frame for any baseline frame, block by block.

    A block's mean level is its DC coefficient, so AC coefficients are parsed but not transformed.
    """
    tables: dict[int, dict[tuple[int, int], int]] = {}
    quantisers: dict[int, int] = {}
    parts: list[tuple[int, int, int, int]] = []
    width = height = interval = 0
    at = 2
    while True:
        marker, size = frame[at + 1], int.from_bytes(frame[at + 2 : at + 4], "big")
        body = frame[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quantisers[body[0] & 15] = int.from_bytes(body[1 : 2 + wide], "big")
                body = body[1 + 64 * (1 + wide) :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = _huffman(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker in (0xC0, 0xC1):
            height, width = struct.unpack(">HH", body[1:5])
            parts = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(body[5])]
        elif 0xC2 <= marker <= 0xCF:
            raise ValueError("only baseline frames are decoded")
        elif marker == 0xDD:
            interval = int.from_bytes(body, "big")
        elif marker == 0xDA:
            coders = {body[1 + 2 * k]: (body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(body[0])}
            break
    bits = _Bits(frame, at)
    most_h, most_v = max(p[1] for p in parts), max(p[2] for p in parts)
    if len(parts) == 1:
        parts, most_h, most_v = [(parts[0][0], 1, 1, parts[0][3])], 1, 1
    mcus_across, mcus_down = -(-width // (8 * most_h)), -(-height // (8 * most_v))
    across, down = mcus_across * parts[0][1], mcus_down * parts[0][2]
    out = np.zeros((down, across), dtype=np.float64)
    last = [0] * len(parts)
    for m in range(mcus_across * mcus_down):
        if interval and m and m % interval == 0:
            bits.restart()
            last = [0] * len(parts)
        for k, (name, h, v, q) in enumerate(parts):
            dc, ac = coders[name]
            for y in range(v):
                for x in range(h):
                    last[k] += bits.signed(bits.symbol(tables[dc]))
                    left = 63
                    while left > 0:
                        s = bits.symbol(tables[0x10 | ac])
                        if s == 0:
                            break
                        bits.signed(s & 15)
                        left -= (s >> 4) + 1
                    if k == 0:
                        out[m // mcus_across * v + y, m % mcus_across * h + x] = last[0] * quantisers[q] / 8
    return _levels(np.round(out).reshape(-1), across * down), across


class _Bits:
    """Reads the bits of a scan; stuffed zero bytes are left out and markers end it."""

    def __init__(self, data: bytes, at: int) -> None:
        self.data, self.at, self.value, self.held = data, at, 0, 0

    def bit(self) -> int:
        if not self.held:
            byte = self.data[self.at]
            self.at += 2 if byte == 0xFF else 1
            self.value, self.held = byte, 8
        self.held -= 1
        return self.value >> self.held & 1

    def symbol(self, table: dict[tuple[int, int], int]) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | self.bit()
            if (length, code) in table:
                return table[length, code]
        raise ValueError("no such code")

    def signed(self, size: int) -> int:
        value = 0
        for _ in range(size):
            value = value << 1 | self.bit()
        return value if not size or value >> (size - 1) else value - (1 << size) + 1

    def restart(self) -> None:
        self.held = 0
        while not (self.data[self.at] == 0xFF and 0xD0 <= self.data[self.at + 1] <= 0xD7):
            self.at += 1
        self.at += 2


def shots(histograms: np.ndarray) -> list[int]:
    """The first frames of the shots, of (frames, LEVELS) histograms of shares."""
    n = len(histograms)
    if n < 2:
        return [0] if n else []
    change = np.abs(np.diff(histograms, axis=0)).sum(axis=1) / 2
    sums, squares = np.concatenate(([0.0], np.cumsum(change))), np.concatenate(([0.0], np.cumsum(change**2)))
    place = np.arange(n - 1)
    lo, hi = np.maximum(0, place - WINDOW), np.minimum(n - 1, place + WINDOW + 1)
    count = hi - lo - 1  # a difference isn't part of its own window
    mean = (sums[hi] - sums[lo] - change) / np.maximum(count, 1)
    square = (squares[hi] - squares[lo] - change**2) / np.maximum(count, 1)
    limit = np.where(count > 0, mean + SPREAD * np.sqrt(np.maximum(0, square - mean**2)), 0)
    return [0, *(np.flatnonzero((change > FLOOR) & (change > limit)) + 1).tolist()]


def read_avi(media: bytes) -> tuple[bytes, list[tuple[float, float, int, float]]]:
    """The stored bytes, and clips: start and end in seconds, frames, mean level."""
    avi = Avi(media)
    planes = [decode_frame(media[at : at + size])[0] for at, size in avi.frames]
    if (left := avi.payload_bytes()) is not None:  # what fills the last frame up is no picture
        for i, p in enumerate(planes):
            planes[i], left = p[:left], max(0, left - len(p))
    histograms = np.array([np.bincount(p >> 4, minlength=LEVELS) / max(1, len(p)) for p in planes]).reshape(len(planes), LEVELS)
    starts = shots(histograms)
    clips = []
    for a, b in zip(starts, [*starts[1:], len(planes)]):
        level = sum(int(p.sum()) for p in planes[a:b]) / max(1, sum(len(p) for p in planes[a:b]))
        clips.append((a / avi.rate, b / avi.rate, b - a, round(level, 4)))
    return b"".join(p.tobytes() for p in planes), clips


def padded(text: str) -> bytes:
    raw = text.encode()
    return raw + b"\0" * (max(ALIGN, -(-len(raw) // ALIGN) * ALIGN) - len(raw))


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        first, sizes, media = 0, [], []

        def part() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([b.column(0).slice(first, len(sizes)), pa.array(sizes, type=pa.int64()), pa.array(media, type=pa.binary())], names=["doc_id", "n_bytes", "media"])

        for i, text in enumerate(b.column(1)):
            text = text.as_py()
            sizes.append(len(text.encode()))
            media.append(write_avi(padded(text)))
            if sum(map(len, media)) >= PART_BYTES or len(media) == 256:
                yield part()
                first, sizes, media = i + 1, [], []
        yield part()


def store(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes (of the text) and the media value that holds the text's padded bytes."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("text"))
    return rows.mapInArrow(_store, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


#: Media values that are given together: a batch of them may not reach 2 GB.
PART_BYTES = 4 << 20
CLIPS = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, clips array<struct<start:double,end:double,frames:long,level:double>>"
_CLIP = pa.list_(pa.struct([("start", pa.float64()), ("end", pa.float64()), ("frames", pa.int64()), ("level", pa.float64())]))


def _features(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for media in b.column(b.num_columns - 1):
                media = media.as_py()
                try:
                    payload, clips = read_avi(media)
                except (ValueError, IndexError, KeyError, TypeError, struct.error):
                    rows.append((None,) * 6)
                    continue
                found = [dict(zip(("start", "end", "frames", "level"), c)) for c in clips]
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-ALIGN:]), len(media), hashlib.sha256(media).hexdigest(), found))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), _CLIP)
            columns = list(zip(*rows)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(x, type=k) for x, k in zip(columns, kinds))], names=names)

    return run


def features(table: DataFrame, media: str = "media") -> DataFrame:
    """The other columns of table, and what is read back from its media values; that replaces columns of its names."""
    own = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "clips"]
    others = [c for c in table.columns if c != media and c not in own]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in table.select(*others).schema]
    return table.select(*others, media).mapInArrow(_features([*others, *own]), ", ".join([*fields, CLIPS]))


def clip_rows(found: DataFrame) -> DataFrame:
    """One row for each clip: doc_id, clip number, start and end in seconds, frames, mean level."""
    return found.select("doc_id", F.posexplode("clips").alias("clip", "c")).select("doc_id", "clip", "c.*")
