"""Near copies by shingles of five words: groups linked by a Jaccard similarity of 0.8 or more.

op1's contract (three words, 3 of 64 bits) is too narrow for this: at a similarity of 0.8 some 15 percent of
SimHash bits differ, and no choice of blocks of bits is both selective and sure at that distance. So the shards
are keyed by MinHash bands here (20 of 5 minima: a pair at 0.8 shares none with a chance below 0.001), and
within a shard a SimHash of 128 bits with a radius of 44 says which pairs are candidates. Every candidate is
verified by the exact Jaccard similarity of its shingle sets, and only verified pairs are linked.

Equal shingle sets are one node. The SimHashes of a shard form a BK-tree (as in op1), and a query follows only edges within
the radius. Shards of up to `ALL_PAIRS` nodes give all candidates. Larger ones are cut into pieces of `PIECE` nodes:
first each node of a piece gives the nearest of those that are in the piece's tree before it, so one candidate a node and
band, and what these verify is grouped. Then each piece meets every other, and all nodes of
a piece that have a candidate in another group are compared exactly, all with all, by a product of their
shingle matrices: each text goes to a piece once, not to each of its candidates, so that a large group of texts
that are alike but below 0.8 costs no join of pairs. No candidate is left out. Texts of fewer than five words are one
shingle; nulls and texts without words form one group. Repeated rows are in one group. Further columns are not
read. A very long text is hashed whole in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, text_of, written
from .simhash import BKTree, components

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 20, 5
BITS, RADIUS = 128, 44
ALL_PAIRS = 16
PIECE = 512
#: Shingles whose columns of a matrix are multiplied together.
COLUMNS = 4096
SEED = 42
BLOCK = 4096

_ODD = np.random.default_rng(SEED).integers(1 << 63, size=SHINGLE + BANDS * ROWS + BITS // 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
PLACES, MINIMA, SIGNS = np.split(_ODD, [SHINGLE, SHINGLE + BANDS * ROWS])


def _mixed(x: np.ndarray) -> np.ndarray:
    # The finalizer of splitmix64.
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the text's shingles; words as in op1."""
    words = text.encode().lower().split()  # bytes: lower() and split() know ASCII only
    own = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in words), dtype=np.uint64, count=len(words))
    k = min(SHINGLE, len(own))
    if not k:
        return own
    n = len(own) - k + 1
    return np.unique(_mixed(sum(own[i : i + n] * PLACES[i] for i in range(k)) + np.uint64(k)))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if both else float(len(a) == len(b) == 0)


def signature(hashes: np.ndarray) -> tuple[int, bytes, list[int]]:
    """Of a shingle set: a 64-bit node, its SimHash and its band keys (none if it is empty)."""
    node = xxhash.xxh3_64_intdigest(hashes.tobytes(), SEED)
    if not len(hashes):
        return node, bytes(BITS // 8), []
    least = np.full(len(MINIMA), np.iinfo(np.uint64).max, dtype=np.uint64)
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), BLOCK):
        some = hashes[at : at + BLOCK]
        for i, odd in enumerate(MINIMA):
            least[i] = min(least[i], (some * odd).min())
        signs = _mixed(some[:, None] * SIGNS)
        ones += np.unpackbits(signs.view(np.uint8), axis=1).sum(axis=0, dtype=np.int64)
    bands = [xxhash.xxh3_64_intdigest(x.tobytes(), t) for t, x in enumerate(least.reshape(BANDS, ROWS))]
    return node, np.packbits(2 * ones > len(hashes)).tobytes(), bands


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _signatures(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [signature(shingles(t)) for t in b.column(b.num_columns - 1).to_pylist()]
            columns = [
                pa.array([_signed(n) for n, _, _ in found], pa.int64()),
                pa.array([s for _, s, _ in found], pa.binary()),
                pa.array([[_signed(k) for k in keys] for _, _, keys in found], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays([*b.columns, *columns], names=[*names, "node", "sim", "bands"])

    return run


def tree_of(sims: list[int]) -> BKTree:
    tree = BKTree()
    for x in sims:
        tree.add(x)
    return tree


def candidates(nodes: list[int], sims: list[int]) -> Iterator[tuple[int, int]]:
    """Pairs of nodes within the radius: all of a small shard, else each node with the nearest of those before it."""
    tree = BKTree()
    for i, x in enumerate(sims):
        near = sorted(((sims[j] ^ x).bit_count(), j) for j in tree.within(x, RADIUS))
        for _, j in near if len(nodes) <= ALL_PAIRS else near[:1]:
            yield nodes[j], nodes[i]
        tree.add(x)


def open_nodes(sims: list[int], groups: list[int]) -> list[bool]:
    """Which nodes are within the radius of a node in another group."""
    out = [False] * len(sims)
    if len(set(groups)) > 1:
        tree = tree_of(sims)
        for i, x in enumerate(sims):
            if not out[i]:
                for j in tree.within(x, RADIUS):
                    if groups[j] != groups[i]:
                        out[i] = out[j] = True
    return out


def exact_links(sets: list[np.ndarray], groups: np.ndarray) -> list[tuple[int, int]]:
    """Links of pairs in different groups whose similarity suffices: as many as join what all of them join."""
    sizes = np.array([len(x) for x in sets])
    row = np.repeat(np.arange(len(sets)), sizes)
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.cumsum(times > 1) - 1  # a shingle of one node is in no intersection
    row, column = row[times[column] > 1], shared[column[times[column] > 1]]
    by = np.argsort(column, kind="stable")
    row, column = row[by], column[by]
    both = np.zeros((len(sets), len(sets)), dtype=np.float32)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, [at, at + COLUMNS])
        some = np.zeros((len(sets), COLUMNS), dtype=np.float32)
        some[row[a:b], column[a:b] - at] = 1
        both += some @ some.T
    enough = both >= SIMILARITY * (sizes[:, None] + sizes - both) - 1e-3  # counts are whole, and exact below 2**24
    parent: dict[int, int] = {}

    def root(g: int) -> int:
        while parent.get(g, g) != g:
            g = parent[g]
        return g

    links = []
    for i, j in zip(*np.nonzero(np.triu(enough & (groups[:, None] != groups), 1))):
        x, y = root(int(groups[i])), root(int(groups[j]))
        if x != y and jaccard(sets[i], sets[j]) >= SIMILARITY:
            parent[x] = y
            links.append((int(i), int(j)))
    return links


def _unit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, ...], list[tuple]]]:
    """The rows of each unit (t, key, i, j), which lie side by side."""
    rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns)))
    for unit, members in groupby(rows, key=itemgetter(0, 1, 2, 3)):
        yield unit, list(members)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first candidates of each shard or piece of one."""
    pairs: set[tuple[int, int]] = set()
    for _, members in _unit_rows(batches):
        *_, nodes, sims = zip(*members)
        for a, b in candidates(nodes, [int.from_bytes(x) for x in sims]):
            pairs.add((min(a, b), max(a, b)))
        if len(pairs) > 50_000:
            yield _pairs(pairs)
            pairs = set()
    yield _pairs(pairs)


def _open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each unit with rows (part, node, sim, f) the nodes that have candidates in other groups, with their group."""
    names = [*UNIT, "node", "f"]
    for unit, members in _unit_rows(batches):
        _, _, _, _, parts, nodes, sims, groups = zip(*members)
        if unit[2] != unit[3] and len(set(parts)) < 2:
            continue
        keep = np.flatnonzero(open_nodes([int.from_bytes(x) for x in sims], groups))
        kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int32())
        columns = [*(pa.array([x] * len(keep), k) for x, k in zip(unit, kinds)), pa.array(np.array(nodes)[keep]), pa.array(np.array(groups)[keep])]
        yield pa.RecordBatch.from_arrays(columns, names=names)


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between the groups of each unit with rows (node, f, text)."""
    rows = ((*keys, shingles(text.as_py())) for b in batches for *keys, text in zip(*(c.to_pylist() for c in b.columns[:-1]), b.column(6)))
    for _, members in groupby(rows, key=itemgetter(0, 1, 2, 3)):
        _, groups, sets = zip(*(m[4:] for m in members))  # a text is let go as soon as it is hashed
        yield _pairs({(groups[i], groups[j]) for i, j in exact_links(list(sets), np.array(groups))})


def _pairs(pairs: set[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*pairs) if pairs else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep = [jaccard(shingles(x.as_py()), shingles(y.as_py())) >= SIMILARITY for x, y in zip(b.column(2), b.column(3))]
        yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))


UNIT = ["t", "key", "i", "j"]


def shards(nodes: DataFrame, piece: int = PIECE) -> DataFrame:
    """(t, key, i, j, part, node, sim): the nodes (node, sim, bands) of each shard of more than one."""
    keyed = nodes.select("node", "sim", F.posexplode("bands").alias("t", "key"))
    sizes = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    parts = keyed.join(sizes, ["t", "key"]).withColumn("s", F.ceil(F.col("n") / piece).cast("int"))
    parts = parts.withColumn("part", F.pmod(F.xxhash64("node"), F.col("s")).cast("int"))
    other = parts.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("s") - 1)))
    return other.select("t", "key", F.least("part", "o").alias("i"), F.greatest("part", "o").alias("j"), "part", "node", "sim", "n")


def pairs_of(units: DataFrame) -> DataFrame:
    """Distinct candidate pairs (a, b) of shards; see _shards."""
    units = units.repartition(*UNIT).sortWithinPartitions(*UNIT, "part", "node")
    return checkpointed(units.mapInArrow(_shards, "a long, b long").distinct())


def linked(nodes: DataFrame, signed: DataFrame, piece: int = PIECE) -> DataFrame:
    """(v, f): for every node of a verified pair the smallest node of its group.

    What the exact comparison adds are links between the groups that there are, so only those are joined once more.
    """
    units = checkpointed(shards(nodes, piece))
    edges = checkpointed(verified(pairs_of(units.where("i = j").drop("n")), signed))
    labels = components(edges)
    large = units.where(F.col("n") > ALL_PAIRS).join(labels, F.col("node") == F.col("v"), "left")
    large = large.select(*UNIT, "part", "node", "sim", F.coalesce("f", "node").alias("f")).repartition(*UNIT).sortWithinPartitions(*UNIT, "part", "node")
    left = checkpointed(large.mapInArrow(_open, "t int, key long, i int, j int, node long, f long"))
    rows = left.join(texts_of(left.select("node").distinct(), signed), "node").select(*UNIT, "node", "f", "text")
    more = rows.repartition(*UNIT).sortWithinPartitions(*UNIT, "node").mapInArrow(_exact, "a long, b long")
    more = checkpointed(more)
    if not more.limit(1).count():
        return labels
    top = components(more.distinct()).select(F.col("v").alias("group"), F.col("f").alias("top"))
    alone = top.join(labels, F.col("group") == F.col("v"), "left_anti")
    joined = labels.join(top, F.col("f") == F.col("group"), "left").select("v", F.coalesce("top", "f").alias("f"))
    return joined.union(alone.select("group", "top"))


def texts_of(ends: DataFrame, signed: DataFrame) -> DataFrame:
    """(node, text): one text of each node."""
    return signed.select("node", "text").join(ends, "node", "left_semi").groupBy("node").agg(F.min("text").alias("text"))


def verified(pairs: DataFrame, signed: DataFrame) -> DataFrame:
    """The pairs whose exact similarity suffices, by one text of each node of signed (node, text)."""
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    texts = checkpointed(texts_of(ends, signed))
    one, two = (texts.select(F.col("node").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab")
    return pairs.join(one, "a").join(two, "b").select("a", "b", "text_a", "text_b").mapInArrow(_verified, "a long, b long")


def near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", piece: int = PIECE) -> DataFrame:
    """(doc_id, node, component_id) for every row of docs; component_id is the smallest id of the group."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    signed = written(rows.mapInArrow(_signatures(rows.columns), f"doc_id {kind}, text string, node long, sim binary, bands array<long>"), "signatures")
    nodes = signed.groupBy("node").agg(F.min("doc_id").alias("first"), F.first("sim").alias("sim"), F.first("bands").alias("bands"))
    nodes = checkpointed(nodes)
    labels = linked(nodes, signed, piece)
    placed = nodes.join(labels.withColumnRenamed("v", "node"), "node", "left").select("node", "first", F.coalesce("f", "node").alias("f"))
    least = placed.groupBy("f").agg(F.min("first").alias("component_id"))
    by_node = placed.join(least, "f").select("node", "component_id")
    return signed.select("doc_id", "node").join(by_node, "node").select("doc_id", "node", "component_id")
