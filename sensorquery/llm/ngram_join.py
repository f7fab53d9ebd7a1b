"""Jaccard join of word shingles: count vectors under R-trees, exact at any size.

A document is the set of its distinct shingles. Two documents link when
PER_CENT * |union| <= 100 * |intersection|, and components are what links connect.

1. Points. Shingles are dealt by their hash to token groups; the counts per group are a point. Linked
   sets share an overlap that the sum of the smaller coordinates of their points cannot be below. Larger
   sets have more groups; of two points the longer is folded to the length of the other.
2. Cells. Which sets come under one R-tree is decided by keys, so that the trees lie on many tasks. Two
   linked sets of at most ``hi`` shingles differ in no more than d = 2 hi (100 - PER_CENT) / (100 +
   PER_CENT) of them. Shingles are dealt to d + 1 + s blocks, so at least s + 1 blocks are equal in both
   sets, and not all of them are empty unless both sets have more than s empty blocks (such sets put
   forth their empty blocks too). The content of a block is the key; sizes meet within a class and with
   the next class. Keys have one order, the empty ones first, then those of most documents. The last
   key that two linked sets share has s shared ones before it in each, so each set leaves out its first
   s keys of a class, which are those that many documents have by chance, and the pair still meets
   (``kept_keys``). The cell of a hub is all sets that it meets under its keys (``linking``).
3. Trees. The points of a cell are packed into boxes of FAN, these into boxes again, up to one root. A
   box keeps its upper corner and the range of its sizes. The hub descends: a box whose corner cannot
   reach the overlap is left out with all below it. What survives down to the points is compared with
   their full vectors, and verified on the full sets. All candidates come out of these searches.
4. Where the sets of a cell are left in several components, those outside the largest one search the
   tree of the cell in turn, for sets of other components.

Equal sets are one node. Null or empty texts have no shingles and link with nothing. Rows that share
a ``doc_id`` are one document: its links are those of all its texts. A null id links with nothing and
has no component. Extra columns are not looked at.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sensorquery.llm import linking
from sensorquery.llm.components import written
from sensorquery.llm.shingles import SALT, ShingleSets
from sensorquery.llm.text import _BASE, mix, shard_count, slices
from sensorquery.session import ship_functions

DIMENSIONS = 64  # token groups of a count vector, at least, and those of the trees
GROUP_SHINGLES = 2  # about so many shingles to a group
MOST_DIMENSIONS = 1 << 14
FAN = 16  # points or boxes to a box
SHINGLES_PER_SHARD = 1 << 21


def size_classes(per_cent: int, most: int = 1 << 40) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest size of each class: linked sets lie in one class or in neighbours."""
    low, lows, highs = 1, [], []
    while low < most:
        high = max(low, low * 100 // per_cent)
        lows.append(low)
        highs.append(high)
        low = high + 1
    return np.array(lows), np.array(highs)


def class_blocks(highs: np.ndarray, per_cent: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of blocks per class, and how many of them, empty ones included, a set may leave out."""
    differ = 2 * highs * (100 - per_cent) // (100 + per_cent)
    spare = np.where(differ == 0, 0, np.where(differ < 10, 2, 6 + differ // 4))
    return differ + 1 + spare, spare


def dimensions(size: np.ndarray) -> np.ndarray:
    """Number of token groups for sets of these sizes: a power of two, so that vectors can be folded."""
    wanted = np.clip(size // GROUP_SHINGLES, DIMENSIONS, MOST_DIMENSIONS)
    return (1 << np.ceil(np.log2(wanted)).astype(np.int64)).astype(np.int64)


def vectors(sets: ShingleSets) -> list[bytes]:
    """Counts per token group of each text, one byte each; 255 stands for 255 or more."""
    length = dimensions(sets.size)
    offset = np.concatenate([[0], np.cumsum(length)])
    group = mix(sets.hashes ^ SALT) & (length[sets.doc] - 1).astype(np.uint64)
    count = np.bincount(offset[sets.doc] + group.astype(np.int64), minlength=offset[-1])
    packed = np.minimum(count, 255).astype(np.uint8)
    return [packed[a:b].tobytes() for a, b in zip(offset.tolist(), offset[1:].tolist())]


def counts(vector, size: int, length: int | None = None) -> np.ndarray:
    """A packed vector as numbers, folded to ``length`` groups; a full byte counts as the whole set,
    so bounds stay above the truth."""
    full = np.frombuffer(vector, dtype=np.uint8).astype(np.int64)
    full[full == 255] = size
    return full if length is None or length == len(full) else full.reshape(-1, length).sum(axis=0)


def may_link(x, size_x: int, y, size_y: int, per_cent: int) -> bool:
    """The sum of the smaller counts reaches the overlap that a link needs."""
    length = min(len(x), len(y))
    both = np.minimum(counts(x, size_x, length), counts(y, size_y, length)).sum()
    return both * (100 + per_cent) >= per_cent * (size_x + size_y)


def _block(hashes: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """The block of each shingle, of so many blocks."""
    return (((hashes >> np.uint64(40)) * blocks.astype(np.uint64)) >> np.uint64(24)).astype(np.int64)


def spare_keys(sets: ShingleSets, per_cent: int) -> tuple[np.ndarray, np.ndarray]:
    """How many keys of its class of even and of odd number each text may leave out: the spare blocks
    without those that are empty anyway, and one less, should two of its keys agree in the bits that travel."""
    _, highs = size_classes(per_cent)
    blocks, spare = class_blocks(highs, per_cent)
    home, left = np.searchsorted(highs, sets.size), []
    for step in (0, 1):
        n = blocks[home + step]
        block = _block(sets.hashes, n[sets.doc])
        edge = np.ones(len(block), dtype=bool)
        edge[1:] = (sets.doc[1:] != sets.doc[:-1]) | (block[1:] != block[:-1])
        bare = n - np.bincount(sets.doc[edge], minlength=len(n))
        left.append(np.maximum(spare[home + step] - bare - 1, 0))
    return np.where(home % 2 == 0, left[0], left[1]), np.where(home % 2 == 0, left[1], left[0])


def block_keys(sets: ShingleSets, use: np.ndarray, per_cent: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, text) for the blocks of the texts marked in ``use``, in their own and the next class. The
    last bit of a key tells whether the number of its class is odd."""
    lows, highs = size_classes(per_cent)
    blocks, spare = class_blocks(highs, per_cent)
    keys, owners = [], []
    take = use[sets.doc]
    h, d = sets.hashes[take], sets.doc[take]
    mixed = mix(h)
    home = np.searchsorted(highs, sets.size)
    for step in (0, 1):
        cls = home + step
        n = blocks[cls]
        block = _block(h, n[d])
        # Hashes are sorted within a text, so the shingles of a block lie together.
        edge = np.ones(len(h), dtype=bool)
        edge[1:] = (d[1:] != d[:-1]) | (block[1:] != block[:-1])
        start = np.flatnonzero(edge)
        if not len(start):
            continue
        content, who, number = np.add.reduceat(mixed, start), d[start], block[start]
        filled = np.bincount(who, minlength=len(sets.size))
        for i in np.flatnonzero(use & (sets.size > 0) & (n - filled > spare[cls])).tolist():
            bare = np.setdiff1d(np.arange(n[i]), number[who == i])
            content, who = np.append(content, np.zeros(len(bare), np.uint64)), np.append(who, np.full(len(bare), i))
            number = np.append(number, bare)
        place = cls[who].astype(np.uint64) * np.uint64(_BASE) + number.astype(np.uint64)
        keys.append((mix(content + mix(place)) & ~np.uint64(1)) | (cls[who] & 1).astype(np.uint64))
        owners.append(who)
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(keys), np.concatenate(owners)


class CountTree:
    """An R-tree over count vectors, packed bottom up: points ordered by size, in slabs by the weight of
    their first coordinates, FAN to a box; then boxes, FAN to a box, until one is left."""

    def __init__(self, vectors: np.ndarray, sizes: np.ndarray):
        n = len(sizes)
        slab = FAN * max(1, int(np.ceil(np.sqrt(n / FAN))))
        by_size = np.argsort(sizes, kind="stable")
        weight = vectors[:, :vectors.shape[1] // 2].sum(axis=1)
        place = np.empty(n, dtype=np.int64)
        place[by_size] = np.arange(n) // slab
        self.order = np.lexsort((weight, place))
        corner, least, most = vectors[self.order], sizes[self.order], sizes[self.order]
        self.levels = [(corner, least, most)]  # the points, then boxes over boxes
        while len(least) > 1:
            start = np.arange(0, len(least), FAN)
            corner = np.maximum.reduceat(corner, start, axis=0)
            least, most = np.minimum.reduceat(least, start), np.maximum.reduceat(most, start)
            self.levels.append((corner, least, most))
        self.visited = 0

    def search(self, vector: np.ndarray, size: int, per_cent: int) -> np.ndarray:
        """Points that may link with this one: the sum of the smaller coordinates reaches the overlap."""
        share = per_cent / (100 + per_cent)
        found = np.arange(len(self.levels[-1][1]))
        for depth in range(len(self.levels) - 1, -1, -1):
            corner, least, most = self.levels[depth]
            near = (least[found] * per_cent <= size * 100) & (most[found] * 100 >= size * per_cent)
            found = found[near]
            reach = np.minimum(corner[found], vector).sum(axis=1)
            self.visited += len(found)
            found = found[reach >= share * (np.maximum(least[found], -(-size * per_cent // 100)) + size) - 1e-9]
            if depth and len(found):
                below = (found[:, None] * FAN + np.arange(FAN)).ravel()
                found = below[below < len(self.levels[depth - 1][1])]
        return self.order[found]


def _signed(width: int, per_cent: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for texts in slices(batch):
                sets = ShingleSets(texts, width)
                a, b = sets.names()
                even, odd = spare_keys(sets, per_cent)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0)[texts.rows], pa.array(sets.size, pa.int64()), pa.array(a), pa.array(b),
                    pa.array([v if n else None for v, n in zip(vectors(sets), sets.size.tolist())], pa.binary()),
                    pa.array(even, pa.int32()), pa.array(odd, pa.int32()),
                ], ["doc_id", "size", "set1", "set2", "vector", "even", "odd"])

    return run


_SIGNED = "doc_id long, size long, set1 long, set2 long, vector binary, even int, odd int"


def _dealt_keys(width: int, per_cent: int, shards: int):
    """The block keys of the texts of a slice, packed per shard; of equal sets the smallest id stands for
    all. An id with several texts puts forth the keys of each; its nodes are tied anyway."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for texts in slices(batch):
                sets, docs = ShingleSets(texts, width), ids[texts.rows].astype(np.int64)
                a, b = sets.names()
                order = np.lexsort((docs, b, a))
                same = np.zeros(len(a), dtype=bool)
                same[1:] = (a[order][1:] == a[order][:-1]) & (b[order][1:] == b[order][:-1])
                use = np.zeros(len(a), dtype=bool)
                use[order[~same]] = True  # one of equal sets
                keys, who = block_keys(sets, use, per_cent)
                yield linking.dealt(keys, docs[who], shards)

    return run


class FullVectors:
    """The whole count vectors of a cell, those of one length as one matrix, folded where a shorter one
    is compared with them."""

    def __init__(self, packed: list, size: np.ndarray):
        length = np.array([len(v) for v in packed])
        self.size, self.length, self.rows, self.folded = size, length, np.zeros(len(packed), dtype=np.int64), {}
        for n in np.unique(length).tolist():
            members = np.flatnonzero(length == n)
            self.rows[members] = np.arange(len(members))
            matrix = np.stack([counts(packed[i], int(size[i])) for i in members.tolist()])
            self.folded[n, n] = matrix.astype(np.int32)

    def at(self, length: int, to: int) -> np.ndarray:
        if (length, to) not in self.folded:
            whole = self.folded[length, length]
            self.folded[length, to] = whole.reshape(len(whole), -1, to).sum(axis=1)
        return self.folded[length, to]

    def may_link(self, i: int, others: np.ndarray, per_cent: int) -> np.ndarray:
        """Of the others, those with which the sum of the smaller counts reaches the overlap of a link."""
        out, own = np.zeros(len(others), dtype=bool), int(self.length[i])
        for n in np.unique(self.length[others]).tolist():
            mine = np.flatnonzero(self.length[others] == n)
            to = min(n, own)
            both = np.minimum(self.at(n, to)[self.rows[others[mine]]], self.at(own, to)[self.rows[i]]).sum(axis=1)
            out[mine] = both * (100 + per_cent) >= per_cent * (self.size[others[mine]] + self.size[i])
        return others[out]


def through_tree(per_cent: int):
    """Of a cell, the sets that a search of its tree leaves for the i-th among those wanted, and whose
    full vectors allow a link."""

    def search(size, packed):
        whole = FullVectors(packed, size)
        points = np.stack([whole.at(int(n), DIMENSIONS)[r] for n, r in zip(whole.length, whole.rows)])
        tree = CountTree(points, size)

        def near(i, wanted):
            found = tree.search(points[i], int(size[i]), per_cent)
            return whole.may_link(i, found[wanted[found]], per_cent)

        return near

    return search


def kept_keys(keyed: DataFrame, node_of: DataFrame) -> DataFrame:
    """(key, node, n) of the keys (key, member, n) that the nodes of the members keep: of the keys of a
    class not the first ``even`` or ``odd``, those that most members have."""
    odd = F.col("key").bitwiseAND(1)
    order = Window.partitionBy("member", "node", odd).orderBy(F.col("n").desc(), "key")
    ranked = keyed.join(node_of, "member").withColumn("rank", F.row_number().over(order))
    kept = ranked.where(F.col("rank") > F.when(odd == 1, F.col("odd")).otherwise(F.col("even")))
    return kept.groupBy("key", "node").agg(F.max("n").alias("n"))


def similar_groups(docs: DataFrame, *, width: int = 5, per_cent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row: the size of its set and the smallest ``doc_id``
    that links reach from it."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = written(own.mapInArrow(_signed(width, per_cent), _SIGNED), "signed")
    nodes = linking.nodes_of(rows, "vector")
    shards = shard_count(nodes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0], SHINGLES_PER_SHARD)
    keyed = own.where("doc_id is not null").mapInArrow(_dealt_keys(width, per_cent, shards), linking.DEALT).groupBy(
        "shard").applyInArrow(linking.repeated, linking.ENTRIES)
    node_of = rows.where("doc_id is not null").join(nodes.select("set1", "set2", "node"), ["set1", "set2"])
    entries = written(kept_keys(keyed, node_of.select(F.col("doc_id").alias("member"), "node", "even", "odd")), "entries")
    label = linking.component_labels(rows, nodes, own, entries, through_tree(per_cent), width, per_cent, "vector")
    return linking.by_document(rows, nodes, label)


def one_of_each_group(docs: DataFrame, *, width: int = 5, per_cent: int = 80) -> DataFrame:
    """The rows of ``docs`` without those that links connect to a smaller ``doc_id``."""
    groups = similar_groups(docs, width=width, per_cent=per_cent)
    gone = written(groups.where("doc_id <> component_id").select("doc_id").distinct(), "near-copies")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


ship_functions(__name__)
