"""Packing of token sequences: first-fit decreasing with a tournament tree, in randomised groups.

Every document becomes its ids and an end id, cut into pieces of at most ``capacity`` ids. Documents
are dealt to groups by a hash of their id and row, whole, so that every group has about GROUP_PIECES
pieces whatever the ids and texts look like, and each group packs its pieces on its own: longest
first, each into the first sequence that still has room. A tournament tree over the room left finds that sequence in logarithmic time.

Null texts count as empty: the end id alone. Repeated rows are packed as often as they stand there;
repeated ids stay apart by ``sequence_id`` and ``offset``. An empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorquery.llm.text import slices
from sensorquery.llm.tokens import tokenizer
from sensorquery.session import ship_functions

CAPACITY = 2048
GROUP_PIECES = 8192
_LOCAL_BITS = 32  # sequence_id = group << 32 | number in the group

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def _pieces(path: str, end_id: int, capacity: int):
    def run(batches):
        import pyarrow as pa

        coder = tokenizer(path)
        tail = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            ids, rows = batch.column(0), batch.column(2)
            for texts in slices(batch):
                cols: list[list] = [[] for _ in range(6)]
                for i in range(len(texts)):
                    raw = coder.encode(texts.text(i).decode()) + tail
                    doc, n, row = ids[texts.rows.start + i].as_py(), len(raw) // 4, rows[texts.rows.start + i].as_py()
                    for s in range(0, n, capacity):
                        part = raw[4 * s:4 * (s + capacity)]
                        for col, v in zip(cols, (doc, s, len(part) // 4, zlib.crc32(part), n, row)):
                            col.append(v)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in cols],
                    ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "row_no"])

    return run


def first_fit_decreasing(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each item. The tree's leaves are bins, an inner node holds the largest room
    below it; the first bin with room lies to the left wherever the left child has room."""
    size = 1
    while size < max(len(lengths), 1):
        size *= 2
    room = [capacity] * (2 * size)
    bins, offsets = [0] * len(lengths), [0] * len(lengths)
    for item in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        need, node = lengths[item], 1
        while node < size:
            node *= 2
            if room[node] < need:
                node += 1
        bins[item], offsets[item] = node - size, capacity - room[node]
        room[node] -= need
        node //= 2
        while node:
            left, right = room[2 * node], room[2 * node + 1]
            best = left if left > right else right
            if room[node] == best:
                break
            room[node] = best
            node //= 2
    return bins, offsets


def _pack_group(capacity: int):
    def run(pieces):
        pieces = pieces.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True])
        bins, offsets = first_fit_decreasing(pieces["length"].tolist(), capacity)
        group = int(pieces["group"].iloc[0])
        out = pieces.drop(columns="group")
        out["sequence_id"] = (group << _LOCAL_BITS) + np.array(bins, dtype=np.int64)
        out["offset"] = np.array(offsets, dtype=np.int64)
        return out

    return run


def pieces(docs: DataFrame, path: str, *, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of every document: at most ``capacity`` ids each, cut from its start; ``row_no`` tells
    rows apart that share an id."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("row_no"))
    return own.mapInArrow(_pieces(path, end_id, capacity), f"{PIECES}, row_no long")


def pack(cut: DataFrame, n_pieces: int, *, capacity: int = CAPACITY, seed: int = 7) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to the pieces, about ``n_pieces`` of them. Documents are dealt
    to the groups whole, by their id and row, so rows alike in everything are spread as well."""
    groups = max(1, -(-n_pieces // GROUP_PIECES))
    group = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "row_no"), F.lit(groups))
    return (
        cut.withColumn("group", group).drop("row_no").groupBy("group")
        .applyInPandas(_pack_group(capacity), f"{PIECES}, sequence_id long, offset long")
    )


def pack_documents(docs: DataFrame, path: str, *, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    # A token holds four bytes or so; a document has one piece at least.
    about = docs.agg(F.sum(1 + F.floor(F.octet_length(F.coalesce("text", F.lit(""))) / F.lit(4 * capacity)))).first()[0] or 0
    return pack(pieces(docs, path, end_id=end_id, capacity=capacity), int(about), capacity=capacity)


ship_functions(__name__)
