"""What similarity joins over sets share: equal sets as one node, stars around hubs, what a star leaves
open, and the comparison of full sets.

Sets that share a key are candidates of each other. Their pairs are never listed: under each key all
sets are first compared with one hub, the set that shares most keys with others. The cell of a hub is
every set that it meets under any of its keys. Where a star leaves the sets of a cell in several
components, the sets outside the largest one meet the others of the cell, in blocks of bounded size;
two sets under one key are always both in the cell of its hub, so no candidate is lost. The work
follows the sets of a cell times those that its star did not reach.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorquery.llm.components import components, written
from sensorquery.llm.shingles import read_sets, squeeze
from sensorquery.llm.text import shard_count
from sensorquery.session import ship_functions

BLOCK = 512  # sets of a cell that meet in one task, on each side
TASK_BYTES = 1 << 24


def grouped(keys: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Entries ordered by key and member, without repeats; where each key begins, and how often it is there."""
    order = np.lexsort((member, keys))
    keys, member = keys[order], member[order]
    fresh = np.ones(len(keys), dtype=bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (member[1:] != member[:-1])
    keys, member = keys[fresh], member[fresh]
    head = np.ones(len(keys), dtype=bool)
    head[1:] = keys[1:] != keys[:-1]
    start = np.flatnonzero(head)
    return keys, member, start, np.diff(np.append(start, len(keys)))


def dealt(keys: np.ndarray, member: np.ndarray, shards: int):
    """The entries of a slice, packed per shard: each key once, with its smallest member, and beside it
    the entries of keys that repeat within the slice. Of a key 32 bits travel besides the shard; should
    two keys agree in them, their members are candidates of each other without need."""
    import pyarrow as pa

    keys, member, start, count = grouped(keys, member)
    met = np.repeat(count > 1, count)
    sides = []
    for k, m in ((keys[start], member[start]), (keys[met], member[met])):
        shard = ((k >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        sides.append((k[order].astype(np.uint32), m[order], np.searchsorted(shard[order], np.arange(shards + 1))))
    used = np.flatnonzero(np.diff(sides[0][2])).tolist()
    packed = [
        pa.array([a[cut[s]:cut[s + 1]].tobytes() for s in used], pa.binary()) for k, m, cut in sides for a in (k, m)]
    return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), *packed], ["shard", "keys", "members", "met_keys", "met_members"])


DEALT = "shard int, keys binary, members binary, met_keys binary, met_members binary"
ENTRIES = "key long, member long, n int"


def repeated(table):
    """(key, member, n) of the keys of a shard that n > 1 members have."""
    import pyarrow as pa

    def column(name, kind):
        return np.frombuffer(b"".join(x.as_buffer() for x in table.column(name).combine_chunks()), dtype=kind)

    keys, member, _, count = grouped(
        np.concatenate([column("keys", np.uint32), column("met_keys", np.uint32)]),
        np.concatenate([column("members", np.int64), column("met_members", np.int64)]))
    n = np.repeat(count, count)
    keep = n > 1
    shard = table.column("shard")[0].as_py() if len(table) else 0
    return pa.table({
        "key": keys[keep].astype(np.int64) | (shard << 32), "member": member[keep], "n": pa.array(n[keep], pa.int32())})


def nodes_of(rows: DataFrame, *extra: str) -> DataFrame:
    """One node per distinct set of the rows (doc_id, size, set1, set2 and ``extra``), numbered as written."""
    full = rows.where("doc_id is not null and size > 0")
    held = full.groupBy("set1", "set2").agg(
        F.min("doc_id").alias("least"), F.first("size").alias("size"), *[F.first(c).alias(c) for c in extra])
    return written(held.select(F.monotonically_increasing_id().alias("node"), "*"), "nodes")


def starred(entries: DataFrame) -> DataFrame:
    """(hub, node): every set that shares a key with the hub of the key. ``entries``: (key, node, n)."""
    degree = entries.groupBy("node").agg(F.sum("n").alias("degree"))
    hubs = entries.join(degree, "node").groupBy("key").agg(F.max(F.struct("degree", "node")).alias("hub"))
    met = entries.join(hubs.select("key", F.col("hub.node").alias("hub")), "key").where("node <> hub")
    return written(met.select("hub", "node").distinct(), "stars")


def spokes(stars: DataFrame) -> DataFrame:
    """(hub, part, node, side, label): the cells with the hub (side 1) in every block of the others."""
    blocks = stars.groupBy("hub").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    rows = stars.join(blocks, "hub").select(
        "hub", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("long").alias("part"), "node", F.lit(0).alias("side"))
    middle = blocks.select(
        "hub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)).alias("part"), F.col("hub").alias("node"), F.lit(1).alias("side"))
    return rows.unionByName(middle).withColumn("label", F.col("node"))


def left_open(stars: DataFrame, label: DataFrame) -> DataFrame:
    """(hub, part, node, side, label) of the cells whose sets lie in several components. ``side`` 1:
    outside the largest of them. Both sides are cut in blocks; each set of one side meets every block
    outside, so copies of a set follow the number of blocks outside, mostly one."""
    named = stars.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    share = named.groupBy("hub", "label").agg(F.count("*").alias("n"))
    cells = share.groupBy("hub").agg(
        F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("n"), F.count("*").alias("labels")
    ).where("labels > 1").select(
        "hub", F.col("top.label").alias("top"), F.ceil((F.col("n") - F.col("top.n")) / BLOCK).cast("int").alias("outer"),
        F.ceil(F.col("top.n") / BLOCK).cast("int").alias("inner"))
    rows = named.join(cells, "hub").withColumn("side", (F.col("label") != F.col("top")).cast("int"))
    outside = F.col("side") == 1
    own = F.pmod(F.xxhash64("node"), F.when(outside, F.col("outer")).otherwise(F.col("inner"))).cast("int")
    span = lambda n: F.sequence(F.lit(0), n - 1)
    pair = lambda a, b: F.struct(F.least(a, b).alias("x"), F.greatest(a, b).alias("y"), F.lit(1).alias("among"))
    cross = lambda a, b: F.struct(a.alias("x"), b.alias("y"), F.lit(0).alias("among"))
    met = F.when(outside, F.concat(
        F.transform(span(F.col("inner")), lambda b: cross(F.col("own"), b)),
        F.transform(span(F.col("outer")), lambda b: pair(F.col("own"), b)),
    )).otherwise(F.transform(span(F.col("outer")), lambda b: cross(b, F.col("own"))))
    return rows.withColumn("own", own).withColumn("met", F.explode(met)).select(
        "hub", F.xxhash64("met").alias("part"), "node", "side", "label")


def units(table, *columns: str):
    """The cells of a task, one by one: the values of ``columns`` for each (hub, part)."""
    get = lambda name: table.column(name).combine_chunks()
    hub, part = get("hub").to_numpy(), get("part").to_numpy()
    held = [get(c) if str(get(c).type) == "binary" else get(c).to_numpy() for c in columns]
    order = np.lexsort((part, hub))
    edge = np.flatnonzero((np.diff(hub[order]) != 0) | (np.diff(part[order]) != 0)) + 1
    for at in np.split(order, edge):
        if len(at):
            yield [h[at] if isinstance(h, np.ndarray) else [h[i].as_buffer() for i in at.tolist()] for h in held]


class SetIndex:
    """The full sets of a cell, renumbered so that one set is compared with many at once."""

    def __init__(self, packed: list):
        sets = [np.frombuffer(p, np.uint64) for p in packed]
        self.size = np.array([len(x) for x in sets], dtype=np.int64)
        values, inverse = np.unique(np.concatenate(sets), return_inverse=True)
        self.ids = np.split(inverse, np.cumsum(self.size)[:-1])
        self.mark = np.zeros(len(values), dtype=np.int64)

    def similar(self, i: int, others: np.ndarray, per_cent: int) -> np.ndarray:
        """Which of the others have 100 * |intersection| >= per_cent * |union| with set i."""
        self.mark[self.ids[i]] = 1
        size = self.size[others]
        start = np.cumsum(size) - size
        both = np.add.reduceat(self.mark[np.concatenate([self.ids[j] for j in others.tolist()])], start)
        self.mark[self.ids[i]] = 0
        return 100 * both >= per_cent * (self.size[i] + size - both)


def _connected(search, per_cent: int, payload: str):
    """Links of a task that connect what is not connected yet: in each cell the sets of side 1 look for
    candidates of other components, which are compared on the full sets. ``search(size, packed)`` makes
    of a cell the function that gives, of the sets wanted, the candidates of its i-th set."""

    def run(table):
        import pyarrow as pa

        found = []
        for ids, side, label, size, packed, hashes in units(table, "node", "side", "label", "size", payload, "hashes"):
            label, candidates, index = label.copy(), search(size, packed), None
            for i in np.flatnonzero(side == 1).tolist():
                # Two of side 1 meet once.
                near = candidates(i, (label != label[i]) & ((side == 0) | (ids > ids[i])))
                if len(near):
                    index = index or SetIndex(hashes)
                    for j in near[index.similar(i, near, per_cent)].tolist():
                        if label[j] != label[i]:
                            found.append((int(ids[i]), int(ids[j])))
                            label[label == label[j]] = label[i]
        return pa.table({n: pa.array([p[k] for p in found], pa.int64()) for k, n in enumerate("ab")})

    return run


def _hopeful(search, payload: str):
    """Rows of a task that have a candidate of another component in their cell, or are one."""

    def run(table):
        import pyarrow as pa

        out = []
        for hub, part, ids, side, label, size, packed in units(table, "hub", "part", "node", "side", "label", "size", payload):
            candidates, hit = search(size, packed), np.zeros(len(ids), dtype=bool)
            for i in np.flatnonzero(side == 1).tolist():
                near = candidates(i, label != label[i])
                hit[near] = True
                hit[i] |= len(near) > 0
            out.append(np.stack([x[hit] for x in (hub, part, ids, side.astype(np.int64), label)]))
        found = np.concatenate(out, axis=1) if out else np.zeros((5, 0), np.int64)
        return pa.table({n: found[k] for k, n in enumerate(("hub", "part", "node", "side", "label"))})

    return run


_CELLS = "hub long, part long, node long, side long, label long"


def _by_task(cells: DataFrame, load: int):
    """Cells dealt to tasks whose number follows the bytes they hold."""
    task = F.pmod(F.xxhash64("hub", "part"), F.lit(shard_count(load, TASK_BYTES)))
    return cells.withColumn("task", task).groupBy("task")


def connect(cells: DataFrame, nodes: DataFrame, sets: DataFrame, search, per_cent: int, payload: str) -> DataFrame:
    """(a, b): links between the components of the cells. The points (``payload``) go first; full sets
    (node, hashes) are brought only to sets with a candidate."""
    points = nodes.select("node", "size", payload)
    width = nodes.agg(F.coalesce(F.avg(F.length(payload)), F.lit(0))).first()[0]
    placed = cells.join(points, "node")
    hopeful = written(_by_task(placed, int(cells.count() * (width + 40))).applyInArrow(_hopeful(search, payload), _CELLS), "hopeful")
    full = hopeful.join(points, "node")
    load = full.agg(F.coalesce(F.sum(8 * F.col("size") + 100), F.lit(0))).first()[0]
    return written(
        _by_task(full.join(sets, "node"), load).applyInArrow(_connected(search, per_cent, payload), "a long, b long"), "links")


def sets_of(stars: DataFrame, nodes: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """(node, hashes) of all nodes of the stars. Texts travel compressed, only to their nodes; a node may
    come twice where its smallest id stands in several rows of one text."""
    wanted = stars.select(F.explode(F.array("hub", "node")).alias("node")).distinct().join(
        nodes.select("node", F.col("least").alias("doc_id"), "set1", "set2"), "node")
    packed = docs.where("doc_id is not null").mapInArrow(squeeze, "doc_id long, packed binary")
    texts = packed.join(wanted, "doc_id").select("packed", "node", "set1", "set2")
    return written(texts.mapInArrow(read_sets(width), "node long, hashes binary"), "sets")


def component_labels(
    rows: DataFrame, nodes: DataFrame, docs: DataFrame, entries: DataFrame, search, width: int, per_cent: int, payload: str
) -> DataFrame:
    """(node, label) of all links among the sets that share a key: around the hubs, then what they left."""
    stars = starred(entries)
    sets = sets_of(stars, nodes, docs, width)
    links = connect(spokes(stars), nodes, sets, search, per_cent, payload).unionByName(ties(rows, nodes))
    label = written(components(links).select("node", "label"), "labels")
    late = connect(left_open(stars, label), nodes, sets, search, per_cent, payload)
    return components(links.unionByName(late)).select("node", "label")


def ties(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b): the sets of the rows of one ``doc_id`` belong together."""
    ids = rows.where("doc_id is not null and size > 0").join(nodes.select("set1", "set2", "node"), ["set1", "set2"]).select("doc_id", "node")
    shared = ids.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z")
    return ids.join(shared.select("doc_id", "a"), "doc_id").where("node <> a").select("a", F.col("node").alias("b"))


def by_document(rows: DataFrame, nodes: DataFrame, label: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row: the smallest id of the component of its node, its own
    for empty sets, null for a null id."""
    named = nodes.select("set1", "set2", "node", "least").join(label.select("node", "label"), "node", "left").withColumn(
        "label", F.coalesce("label", "node"))
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    full = rows.where("doc_id is not null and size > 0").select("doc_id", "set1", "set2")
    component = full.join(named.join(least, "label").select("set1", "set2", "component_id"), ["set1", "set2"])
    by_id = component.groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    return rows.select("doc_id", F.col("size").alias("n_shingles")).join(by_id, "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


ship_functions(__name__)
