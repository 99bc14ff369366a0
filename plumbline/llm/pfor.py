"""Token-id files in patched frame-of-reference blocks.

Ids are encoded in ascending document order. A file (one row of the written table, self-contained in
`data`) holds whole documents up to about `FILE_TOKENS` ids:

    magic, documents n, ids m, blocks k, exceptions e      5 unsigned 32-bit integers
    document lengths                                       n unsigned 32-bit
    block minima, payload starts, exception starts         3 * k unsigned 32-bit
    block widths                                           k bytes
    exception places in their blocks, exception values     e bytes, e unsigned 32-bit
    payload                                                of each block, BLOCK values at its width

A block subtracts its minimum and packs the rest at the width that holds the 90th percentile; larger values
stand in the exception list and leave zeros. The starts index lets a reader decode any run of ids alone.

Null and empty texts hold the end id only. Rows with a null id come first; rows of one id lie side by side, in
the order of their texts. Further columns, of any name, are not read. A very long text is encoded in one task and
lies in one file, which may so be larger than usual. A table without rows gives no file and no row.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_path, partitions_for, text_of
from .tokens import encoder

MAGIC = 0x31524650
BLOCK = 128
PERCENTILE = 0.9
FILE_TOKENS = 1 << 19


def _bits(values: np.ndarray, width: int) -> np.ndarray:
    """(blocks, BLOCK) values as (blocks, bytes) at `width` bits each."""
    wide = values.astype("<u2" if width <= 16 else "<u4")
    planes = np.unpackbits(wide.view(np.uint8).reshape(*values.shape, -1), axis=2, bitorder="little")
    return np.packbits(planes[:, :, :width].reshape(len(values), -1), axis=1, bitorder="little")


def _values(packed: np.ndarray, width: int) -> np.ndarray:
    kind, size = ("<u2", 16) if width <= 16 else ("<u4", 32)
    planes = np.zeros((len(packed), BLOCK, size), dtype=np.uint8)
    planes[:, :, :width] = np.unpackbits(packed, axis=1, bitorder="little").reshape(len(packed), BLOCK, width)
    return np.packbits(planes.reshape(len(packed), -1), axis=1, bitorder="little").view(kind)


def encode_file(lengths: list[int], ids: np.ndarray) -> bytes:
    m = len(ids)
    k = -(-m // BLOCK)
    padded = np.concatenate([ids, np.full(k * BLOCK - m, ids[-1] if m else 0)]).astype(np.uint32).reshape(k, BLOCK)
    low = padded.min(axis=1) if k else np.zeros(0, dtype=np.uint32)
    rest = padded - low[:, None]
    at = int(np.ceil(PERCENTILE * BLOCK)) - 1
    pivot = np.partition(rest, at, axis=1)[:, at] if k else low
    widths = np.ceil(np.log2(pivot.astype(np.float64) + 1)).astype(np.uint8)
    over = rest >= (np.uint64(1) << widths.astype(np.uint64))[:, None]
    counts = over.sum(axis=1)
    rows, places = np.nonzero(over)
    values = rest[rows, places]
    rest[over] = 0
    sizes = widths.astype(np.int64) * (BLOCK // 8)
    starts = np.cumsum(sizes) - sizes
    payload = np.empty(int(sizes.sum()), dtype=np.uint8)
    for width in np.unique(widths[widths > 0]):
        own = np.flatnonzero(widths == width)
        payload[starts[own][:, None] + np.arange(int(width) * BLOCK // 8)] = _bits(rest[own], int(width))
    u4 = lambda x: np.asarray(x).astype("<u4").tobytes()
    head = u4([MAGIC, len(lengths), m, k, len(values)])
    return b"".join([head, u4(lengths), u4(low), u4(starts), u4(np.cumsum(counts) - counts), widths.tobytes(), places.astype(np.uint8).tobytes(), u4(values), payload.tobytes()])


class TokenFile:
    """Reads what encode_file wrote."""

    def __init__(self, data: bytes) -> None:
        magic, n, self.size, k, e = np.frombuffer(data, "<u4", 5)
        if magic != MAGIC:
            raise ValueError("not a token file")
        at = 20

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(data, kind, count, at)
            at += found.nbytes
            return found

        self.lengths = take("<u4", n)
        self.low, self.starts, self.except_starts = take("<u4", k), take("<u4", k), take("<u4", k)
        self.widths, self.places, self.values = take("u1", k), take("u1", e), take("<u4", e)
        self.payload = np.frombuffer(data, "u1", offset=at)

    def ids(self, first: int = 0, last: int | None = None) -> np.ndarray:
        """The ids from first to before last; only their blocks are decoded."""
        last = int(self.size) if last is None else last
        a, b = first // BLOCK, -(-last // BLOCK)
        widths, out = self.widths[a:b], np.zeros((max(0, b - a), BLOCK), dtype=np.uint32)
        for width in np.unique(widths[widths > 0]):
            own = np.flatnonzero(widths == width)
            out[own] = _values(self.payload[self.starts[a:b][own].astype(np.int64)[:, None] + np.arange(int(width) * BLOCK // 8)], int(width))
        ends = np.append(self.except_starts, len(self.values)).astype(np.int64)
        lo, hi = (ends[a], ends[b]) if b > a else (0, 0)
        rows = np.repeat(np.arange(b - a), np.diff(ends[a : b + 1])) if b > a else np.zeros(0, dtype=np.int64)
        out[rows, self.places[lo:hi]] = self.values[lo:hi]
        out += self.low[a:b, None]
        return out.reshape(-1)[first - a * BLOCK : last - a * BLOCK]


def _write(path: str, end: int, doc_ids: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(path, end), TaskContext.get().partitionId()
        ids: list[bytes] = []
        docs: list = []
        before = held = number = 0

        def file() -> pa.RecordBatch:
            nonlocal ids, docs, before, held, number
            data = encode_file([len(x) // 4 for x in ids], np.frombuffer(b"".join(ids), "<u4"))
            row = [[part], [number], [before], [held], [docs], [data]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(doc_ids), pa.binary()]
            before, number, held, ids, docs = before + held, number + 1, 0, [], []
            return pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(row, kinds)], names=["part", "number", "before", "n_ids", "doc_ids", "data"])

        for b in batches:
            keys = iter(b.column(0).to_pylist())
            for encoded in encode.slices(b.column(1)):
                for own in encoded:
                    ids.append(own.as_py())
                    docs.append(next(keys))
                    held += len(ids[-1]) // 4
                    if held >= FILE_TOKENS:
                        yield file()
        if docs:
            yield file()

    return run


def write_ids(docs: DataFrame, tokenizer: str, path: str | None = None, end: int = 0, doc_id: str = "doc_id", text: str = "text") -> str:
    """Writes the ids of all texts, in ascending order of doc_id, and gives the folder."""
    from pyspark.sql.pandas.types import to_arrow_type

    rows = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("text"))
    kind = rows.schema["doc_id"].dataType
    path = path or fresh_path(docs.sparkSession, "ids")
    ordered = rows.repartitionByRange(partitions_for(docs), "doc_id").sortWithinPartitions("doc_id", "text")
    files = ordered.mapInArrow(_write(tokenizer, end, to_arrow_type(kind)), f"part int, number int, before long, n_ids long, doc_ids array<{kind.simpleString()}>, data binary")
    files.write.parquet(path)
    return path


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for base, docs, data in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
            file = TokenFile(data.as_py())
            ids, ends = file.ids().astype("<u4"), np.cumsum(file.lengths, dtype=np.int64)
            raw = memoryview(ids.tobytes())
            starts = ends - file.lengths
            crcs = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(starts.tolist(), ends.tolist())]
            columns = [docs.values, pa.array(base + starts, type=pa.int64()), pa.array(file.lengths.astype(np.int64)), pa.array(crcs, type=pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_ids(spark, path: str) -> DataFrame:
    """Per document of the files: its first place among all ids, its number of ids and their CRC-32.

    The number of ids before a partition is summed over one row for each partition that was written.
    """
    files = spark.read.parquet(path)
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.select(F.col("part").alias("p"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    placed = files.join(F.broadcast(base), F.col("part") == F.col("p")).select((F.col("base") + F.col("before")).alias("base"), "doc_ids", "data")
    kind = files.schema["doc_ids"].dataType.elementType.simpleString()
    return placed.mapInArrow(_read, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")
