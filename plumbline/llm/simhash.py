"""SimHash near-duplicate groups by sharded BK-trees.

Two fingerprints are linked if they differ in at most `RADIUS` bits. The 64 bits are cut into `BLOCKS`
blocks; three differing bits spoil at most three of five blocks, so two linked fingerprints agree on at
least two blocks, and each of the ten pairs of blocks keys one set of shards. Within a shard of one key
(or a bounded piece of it) fingerprints form a BK-tree whose children are keyed by their Hamming distance
to the parent, and a query follows only edges within the radius. A key with more than `TREE_SIZE`
fingerprints is cut into pieces; the tree of each piece goes to the queries of every other piece, so no
link is lost and no task holds more than two pieces. No tree passes through the driver.

Nulls and texts without words have fingerprint zero. Repeated rows and equal texts share a fingerprint and
so a group. Null ids are never the smallest id, unless a group has no other (then its component is null). A
table without rows gives none. Further columns, of any name, are not read. A very long text is hashed whole, a
block of shingles at a time, in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations, groupby
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, LongType

from .common import checkpointed, text_of

RADIUS = 3
BLOCKS = 5
TREE_SIZE = 1024
SHINGLE = 3
SEED = 42


def fingerprint(text: str) -> int:
    """The SimHash of a text as a signed 64-bit integer; texts are hashed in blocks of 65,536 shingles."""
    words = text.encode().lower().split()  # bytes: lower() and split() know ASCII only
    if not words:
        return 0
    n = max(1, len(words) - SHINGLE + 1)
    ones = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, 65536):
        some = words[at : min(at + 65536, n) + SHINGLE - 1]
        shingles = map(b" ".join, zip(*(some[k:] for k in range(SHINGLE)))) if len(words) >= SHINGLE else [b" ".join(words)]
        hashes = np.fromiter((digest(s, SEED) for s in shingles), dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


@F.pandas_udf(LongType())
def _fingerprints(texts: pd.Series) -> pd.Series:
    return texts.map(fingerprint).astype("int64")


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs' columns but the text, and `fp`."""
    return docs.select(*[c for c in docs.columns if c != text], _fingerprints(text_of(text)).alias("fp"))


class BKTree:
    """Values with their children keyed by integer distance."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        self.values.append(value)
        self.children.append({})
        new = len(self.values) - 1
        at = 0
        while at != new:
            at = self.children[at].setdefault((self.values[at] ^ value).bit_count(), new)

    def within(self, value: int, radius: int) -> Iterator[int]:
        """Positions of the values at a distance of at most radius."""
        values, children = self.values, self.children
        stack = [0] if values else []
        while stack:
            at = stack.pop()
            d = (values[at] ^ value).bit_count()
            if d <= radius:
                yield at
            for edge, child in children[at].items():
                if -radius <= edge - d <= radius:
                    stack.append(child)


def unit_links(values: list[int], queries: list[int], radius: int) -> Iterator[tuple[int, int]]:
    """Links that join what one tree connects: the tree of values asked by itself (no queries) or by queries.

    A component of k members gives k-1 links in the shape of a binary heap, so none has a hub.
    """
    every = values + queries
    parent = list(range(len(every)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    tree = BKTree()
    for i, v in enumerate(values):
        if not queries:
            for hit in tree.within(v, radius):
                parent[root(hit)] = root(i)
        tree.add(v)
    for i, q in enumerate(queries, len(values)):
        for hit in tree.within(q, radius):
            parent[root(hit)] = root(i)
    members: dict[int, list[int]] = {}
    for i in range(len(every)):
        members.setdefault(root(i), []).append(every[i])
    for group in members.values():
        for i in range(1, len(group)):
            yield group[i], group[(i - 1) // 2]


def _units(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns)))
        a: list[int] = []
        b: list[int] = []
        for (_, _, i, j), members in groupby(rows, key=itemgetter(0, 1, 2, 3)):
            halves: tuple[list[int], list[int]] = ([], [])
            for *_, part, fp in members:
                halves[part != i].append(fp & 0xFFFFFFFFFFFFFFFF)
            if i != j and not (halves[0] and halves[1]):
                continue
            for x, y in unit_links(*halves, radius):
                a.append(x)
                b.append(y)
            if len(a) > 50_000:
                yield _links(a, b)
                a, b = [], []
        yield _links(a, b)

    return run


def _links(a: list[int], b: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (a, b)], names=["a", "b"])


def block_masks(radius: int, blocks: int) -> list[int]:
    """Signed 64-bit masks of every choice of blocks that a pair within the radius must agree on."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    parts = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(edges, edges[1:])]
    masks = [sum(c) for c in combinations(parts, blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(fps: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, tree_size: int = TREE_SIZE) -> DataFrame:
    """Links (a, b) between distinct fingerprints `fp` that connect all pairs within the radius."""
    keyed = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in block_masks(radius, blocks)])).alias("t", "key"))
    sizes = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    parts = keyed.join(sizes, ["t", "key"]).withColumn("s", F.ceil(F.col("n") / tree_size).cast("int"))
    parts = parts.withColumn("part", F.pmod(F.xxhash64("fp"), F.col("s")).cast("int"))
    other = parts.select("t", "key", "part", "fp", F.explode(F.sequence(F.lit(0), F.col("s") - 1)).alias("o"))
    unit = ["t", "key", "i", "j"]
    units = other.select("t", "key", F.least("part", "o").alias("i"), F.greatest("part", "o").alias("j"), "part", "fp")
    units = units.repartition(*unit).sortWithinPartitions(*unit, "part", "fp")
    return units.mapInArrow(_units(radius), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(v, f): for every end of an edge, the smallest node that it is connected to.

    Hooking and shortcutting on grandparents, until nothing changes; each round is checkpointed.
    """
    both = edges.union(edges.select("b", "a")).where("a != b").distinct()
    both = checkpointed(both)
    state = checkpointed(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("f")))
    while True:
        up = state.select(F.col("v").alias("p"), F.col("f").alias("gf"))
        grand = checkpointed(state.join(up, F.col("f") == F.col("p")).select("v", "f", "gf"))
        near = both.join(grand, both.b == grand.v).groupBy("a").agg(F.min("gf").alias("m"))
        hooks = near.join(state, near.a == state.v).select("a", "f", "m")
        proposals = hooks.select(F.explode(F.array(F.struct(F.col("a").alias("v"), "m"), F.struct(F.col("f").alias("v"), "m"))).alias("x")).select("x.*")
        proposals = proposals.union(grand.select("v", F.col("gf").alias("m"))).union(grand.select("v", F.col("f").alias("m")))
        new = checkpointed(proposals.groupBy("v").agg(F.min("m").alias("f")))
        changed = new.join(state.withColumnRenamed("f", "was"), "v").where("f != was").limit(1).count()
        state = new
        if not changed:
            return state


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, blocks: int = BLOCKS, tree_size: int = TREE_SIZE) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs; component_id is the smallest id of the group."""
    signed = checkpointed(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))))
    fps = signed.groupBy("fp").agg(F.min("doc_id").alias("first"))
    labels = components(links(fps, radius, blocks, tree_size))
    placed = fps.join(labels.withColumnRenamed("v", "fp"), "fp", "left").select("fp", "first", F.coalesce("f", "fp").alias("f"))
    least = placed.groupBy("f").agg(F.min("first").alias("component_id"))
    by_fp = placed.join(least, "f").select(F.col("fp").alias("fp_"), "component_id")
    return signed.join(by_fp, signed.fp == by_fp.fp_).select("doc_id", "fp", "component_id")


def deduplicated(docs: DataFrame, groups: Callable[[DataFrame], DataFrame] = near_duplicates) -> DataFrame:
    """docs with one row of each near-duplicate group: that of the smallest id.

    groups gives each row's doc_id and component_id. Of several rows with that id the first by text stays (then by the
    other columns that have an order). Rows with a null id stay: no id stands for them. The groups are kept as ids,
    so the rows themselves are only looked up.
    """
    by_id = groups(docs).groupBy(F.col("doc_id").alias("keep_id")).agg(F.count("*").alias("rows"), F.bool_or(F.col("doc_id") == F.col("component_id")).alias("stays"))
    found = checkpointed(by_id.where("stays"))
    names = docs.columns
    kept = docs.join(found.where("rows = 1"), docs.doc_id == F.col("keep_id"), "left_semi")
    several = docs.join(found.where("rows > 1"), docs.doc_id == F.col("keep_id"), "left_semi")
    ordered = [f.name for f in docs.schema if f.name not in ("doc_id", "text") and not _unordered(f.dataType)]
    one = several.groupBy("doc_id").agg(F.min_by(F.struct(*names), F.struct("text", *ordered)).alias("x")).select("x.*")
    return kept.unionByName(one).unionByName(docs.where("doc_id is null"))


def _unordered(kind: DataType) -> bool:
    """Whether a type holds a map or a variant, which have no order."""
    return any(word in kind.simpleString() for word in ("map<", "variant"))
