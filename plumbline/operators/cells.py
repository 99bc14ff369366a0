"""A kept index of vectors by cells: a query looks into the cells whose centres are nearest, and ranks what is there exactly.

Centres are those of a spherical k-means on at most `SAMPLE` vectors (of the least hashed ids); every vector of the index
lies in the cell of its nearest centre, in a folder of its own, so that a search reads the folders it probes and no others.
How many cells a query probes is measured when the index is built: with the vectors of the sample that stand for queries, as
many as are needed to find `RECALL` of the exact neighbours among the sample, and never fewer than `LEAST`. Vectors that fall
into clusters need few probes, vectors without any structure need most of the cells: then `vector_arm`, the exact way, is the
better one. All cells give exactly its rows.

The index holds vectors of one length, that of most of the sample. Null and zero vectors and those with null or infinite
elements are not in it; queries of another length or without a direction find nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import Landing
from .retrieval import CANDIDATES, QUERY_BLOCK, VECTOR_BLOCK, _least, _unit, ranked

SAMPLE, ROUNDS, MOST_CELLS = 20_000, 10, 1024
RECALL, LEAST, ASKED, SEED = 0.95, 2, 200, 7


def centres(x: np.ndarray, cells: int) -> np.ndarray:
    """Unit centres of a spherical k-means of unit vectors; an empty cell takes a vector that is far from its own."""
    rng = np.random.default_rng(SEED)
    out = x[rng.choice(len(x), cells, replace=False)].copy()
    for _ in range(ROUNDS):
        near = x @ out.T
        cell = near.argmax(axis=1)
        far = np.argsort(near.max(axis=1), kind="stable")
        sums = np.zeros_like(out)
        np.add.at(sums, cell, x)
        size = np.bincount(cell, minlength=cells)
        sums[size == 0] = x[far[: (size == 0).sum()]]
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        out = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), out)
    return out


def probes_needed(x: np.ndarray, middle: np.ndarray, n: int, recall: float) -> int:
    """The least number of nearest cells that hold so much of the n nearest vectors of some of x, on average."""
    asked = x[:: max(1, len(x) // ASKED)]
    nearest = np.argsort(-(asked @ x.T), axis=1, kind="stable")[:, :n]
    order = np.argsort(np.argsort(-(asked @ middle.T), axis=1, kind="stable"), axis=1)  # the place of each cell for each
    place = np.take_along_axis(order, (x @ middle.T).argmax(axis=1)[nearest], axis=1)
    found = np.bincount(place.ravel(), minlength=len(middle)).cumsum() / place.size
    return int(np.searchsorted(found, recall)) + 1


class CellIndex:
    """The index below a path. Vectors are (id long, vector)."""

    schema = "id long, vector array<double>, cell int"

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self._cells, self._heads = Landing(spark, f"{path}/cells"), Landing(spark, f"{path}/heads")

    def built(self) -> bool:
        return bool(self._heads.batches())

    def build(self, vectors: DataFrame, cells: int | None = None, recall: float = RECALL, n: int = CANDIDATES) -> CellIndex:
        """Learns the centres and lays out all vectors; the number of cells is about the root of that of the vectors."""
        for table in (self._heads, self._cells):
            table.empty()
        vectors = vectors.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector")).where("id is not null and vector is not null")
        rows = vectors.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
        sizes = [len(r["vector"]) for r in rows]
        width = max(sorted(set(sizes) - {0}), key=sizes.count, default=1)
        x, fine = _unit(np.array([r["vector"] for r in rows if len(r["vector"]) == width], dtype=np.float64).reshape(-1, width))
        x = x[fine]
        most = min(len(x), MOST_CELLS)
        count = min(most, cells or max(1, round(vectors.count() ** 0.5)))
        middle = centres(x, count) if count else np.zeros((0, width))
        probes = max(LEAST, probes_needed(x, middle, n, recall)) if count else 0
        laid = vectors.mapInArrow(_laid(middle), self.schema)
        partitions = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = laid.repartition(partitions, "cell", F.pmod(F.xxhash64("id"), F.lit(8)))  # a cell with a third of all rows is dealt over eight
        self._cells.write(dealt.sortWithinPartitions("cell", "id"), 0, ["cell"])
        heads = self.spark.createDataFrame([(i, [float(v) for v in m], probes) for i, m in enumerate(middle)], "cell int, vector array<double>, probes int")
        self._heads.write(heads.coalesce(1), 0)  # the index is there once this is whole
        return self

    def heads(self) -> tuple[np.ndarray, int]:
        """The centres, and how many cells a query probes."""
        rows = self._heads.read(self.spark.createDataFrame([], "cell int, vector array<double>, probes int").schema).orderBy("cell").collect()
        return np.array([r["vector"] for r in rows], dtype=np.float64), rows[0]["probes"] if rows else 0

    def search(self, queries: DataFrame, n: int = CANDIDATES, digits: int = 6, probes: int | None = None, block: int = QUERY_BLOCK) -> DataFrame:
        """(query_id, id, distance, rank) as vector_arm, from the cells that are probed. queries: query_id, vector."""
        middle, usual = self.heads()
        probes = min(len(middle), probes or usual)
        out, held = None, []
        empty = self.spark.createDataFrame([], "query_id long, id long, distance double, rank int")

        def part(rows: list) -> DataFrame | None:
            x, fine = _unit(np.array([r["vector"] for r in rows], dtype=np.float64))
            names, x = np.array([r["query_id"] for r in rows])[fine], x[fine]
            if not len(names):
                return None
            near = np.argsort(-(x @ middle.T), axis=1, kind="stable")[:, :probes]
            by_cell = {int(c): np.flatnonzero((near == c).any(axis=1)) for c in np.unique(near)}
            shared = self.spark.sparkContext.broadcast((names, x.T, by_cell))
            cells = self._read().where(F.col("cell").isin(list(by_cell)))
            found = cells.select("id", "vector", "cell").mapInArrow(_probed(shared, n, digits), "query_id long, id long, distance double")
            return ranked(found, ["query_id"], n, F.col("distance"), F.col("id"))

        width = middle.shape[1] if len(middle) else -1
        asked = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector")).where(F.size("vector") == width).distinct()
        for row in asked.toLocalIterator():  # a partition at a time; blocks of queries, as for the exact way
            held.append(row)
            if len(held) == block:
                found, held = part(held), []
                out = found if out is None else out if found is None else out.union(found)
        found = part(held) if held else None
        out = found if out is None else out if found is None else out.union(found)
        return empty if out is None else out

    def _read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*self._cells.folders())


def _rows(b: pa.RecordBatch, at: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, unit vectors and places of the rows of a batch, from one place on, that have a direction."""
    rows = b.slice(at, VECTOR_BLOCK)
    x, fine = _unit(rows.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width))
    return rows.column(0).to_numpy()[fine], x[fine], np.flatnonzero(fine)


def _laid(middle: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = pc.list_value_length(b.column(1)).to_numpy(zero_copy_only=False)
            b = b.take(pa.array(np.flatnonzero(sizes == (middle.shape[1] if len(middle) else -1))))
            for at in range(0, len(b), VECTOR_BLOCK):
                ids, x, places = _rows(b, at, middle.shape[1])
                own = b.slice(at, VECTOR_BLOCK).take(pa.array(places))
                yield pa.RecordBatch.from_arrays([pa.array(ids), own.column(1), pa.array((x @ middle.T).argmax(axis=1).astype(np.int32))], names=["id", "vector", "cell"])

    return run


def _probed(shared, n: int, digits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, asked, by_cell = shared.value
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # of each cell the n least distances and ids of those that probe it
        for b in batches:
            cells = b.column(2).to_numpy()
            for cell in np.unique(cells):
                own = b.take(pa.array(np.flatnonzero(cells == cell)))
                for at in range(0, len(own), VECTOR_BLOCK):
                    ids, x, _ = _rows(own, at, asked.shape[0])
                    order = np.argsort(ids, kind="stable")
                    distance = np.round(1 - x[order] @ asked[:, by_cell[cell]], digits) + 0.0
                    ids = np.broadcast_to(ids[order][:, None], distance.shape)
                    if cell in best:
                        distance, ids = np.concatenate([best[cell][0], distance]), np.concatenate([best[cell][1], ids])
                    best[cell] = _least(distance, ids, n)
        for cell, (distance, ids) in best.items():
            of = np.broadcast_to(names[by_cell[cell]], ids.shape)
            yield pa.RecordBatch.from_arrays([pa.array(v.reshape(-1)) for v in (of, ids, distance)], names=["query_id", "id", "distance"])

    return run
