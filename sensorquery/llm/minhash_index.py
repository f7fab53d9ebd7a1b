"""Near copies by MinHash signatures in a multi-index Hamming join, confirmed on the full shingle sets.

1. Each set of distinct shingles gets a signature of SYMBOLS minima of as many hash functions, BITS bits
   of each. Two symbols of sets with Jaccard similarity J differ with probability (1 - J) (255 / 256).
2. Signatures are split into CHUNKS chunks of CHUNK_SYMBOLS symbols. If two signatures differ in no more
   than DISTANCE = 2 CHUNKS - 1 symbols, some chunk differs in one symbol at most (pigeonhole). Each
   chunk is entered under every way to allow that error: the chunk without one of its symbols. So all
   pairs within the distance meet under some key. At J = 0.8 the distance is 25 on average and beyond
   41 once in about 3,500 pairs; at J = 0.85 once in five millions.
3. Keys travel in packed arrays, each once per slice; keys with a single set end there. Under every
   key left, all sets are first compared with one hub (``linking``), within the distance. What is linked
   becomes one component.
4. Where the sets around a hub lie in several components, those outside the largest meet the rest in
   blocks: pairs of different components within the distance.
5. Candidates of both rounds are confirmed on the full sets: 100 * |intersection| >= PER_CENT * |union|.

Pairs are never listed within a component. Equal sets are one node from the start. Null or empty texts
have no shingles and link with nothing; texts of fewer words than a shingle are one shingle. Rows that
share a ``doc_id`` are one document: its links are those of all its texts. A null id links with nothing
and has no component (and ``kept`` is null). Extra columns are not looked at.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorquery.llm import linking
from sensorquery.llm.components import written
from sensorquery.llm.shingles import ShingleSets
from sensorquery.llm.text import mix, shard_count, slices
from sensorquery.session import ship_functions

BITS = 8
CHUNKS, CHUNK_SYMBOLS = 21, 6
SYMBOLS = CHUNKS * CHUNK_SYMBOLS
DISTANCE = 2 * CHUNKS - 1
SETS_PER_SLICE = 8192
SETS_PER_SHARD = 8192


def _multipliers() -> np.ndarray:
    return mix(np.arange(1, SYMBOLS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def signatures(sets: ShingleSets) -> np.ndarray:
    """One row of SYMBOLS bytes per text: the top bits of a mix of the least value of each function."""
    least = np.zeros((SYMBOLS, len(sets.size)), dtype=np.uint64)
    some = np.flatnonzero(sets.size)
    if len(some):
        for k, factor in enumerate(_multipliers()):
            value = sets.hashes * factor
            value ^= value >> np.uint64(31)
            least[k, some] = np.minimum.reduceat(value, sets.first[some])
    return np.ascontiguousarray((mix(least) >> np.uint64(64 - BITS)).astype(np.uint8).T)


def index_keys(sig: np.ndarray) -> np.ndarray:
    """The keys of each signature, one per chunk and symbol left out: SYMBOLS columns."""
    keys = np.empty(sig.shape, dtype=np.uint64)
    wide = sig.astype(np.uint64)
    for chunk in range(CHUNKS):
        first = chunk * CHUNK_SYMBOLS
        for out in range(CHUNK_SYMBOLS):
            content = np.full(len(sig), first + out + 1, dtype=np.uint64)
            for i in range(CHUNK_SYMBOLS):
                if i != out:
                    content = (content << np.uint64(BITS)) | wide[:, first + i]
            keys[:, first + out] = mix(content)
    return keys


def may_link(size_a, size_b, per_cent: int):
    """Sets of these sizes can be similar enough."""
    return np.minimum(size_a, size_b) * 100 >= per_cent * np.maximum(size_a, size_b)


def _signed(width: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for texts in slices(batch):
                sets = ShingleSets(texts, width)
                a, b = sets.names()
                sig = signatures(sets)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0)[texts.rows], pa.array(sets.size, pa.int64()), pa.array(a), pa.array(b),
                    pa.array([s.tobytes() if n else None for s, n in zip(sig, sets.size.tolist())], pa.binary()),
                ], ["doc_id", "size", "set1", "set2", "sig"])

    return run


_SIGNED = "doc_id long, size long, set1 long, set2 long, sig binary"


def _dealt_keys(shards: int):
    """The keys of a slice of sets, packed per shard."""

    def run(batches):
        ids, sigs, held = [], [], 0

        def pack():
            return linking.dealt(
                index_keys(np.concatenate(sigs)).ravel(), np.repeat(np.concatenate(ids), SYMBOLS), shards)

        for batch in batches:
            ids.append(batch.column(0).to_numpy(zero_copy_only=False))
            sigs.append(np.frombuffer(b"".join(x.as_buffer() for x in batch.column(1)), np.uint8).reshape(-1, SYMBOLS))
            held += batch.num_rows
            if held >= SETS_PER_SLICE:
                yield pack()
                ids, sigs, held = [], [], 0
        if held:
            yield pack()

    return run


def within_distance(per_cent: int):
    """Of a cell, the wanted sets whose signature lies within the distance of the i-th and whose size
    allows a link."""

    def search(size, packed):
        sig = np.frombuffer(b"".join(packed), np.uint8).reshape(-1, SYMBOLS)

        def near(i, wanted):
            fit = np.flatnonzero(wanted & may_link(size, size[i], per_cent))
            return fit[(sig[fit] != sig[i]).sum(axis=1) <= DISTANCE]

        return near

    return search


def similar_documents(docs: DataFrame, *, width: int = 5, per_cent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row: the size of its set, the smallest ``doc_id``
    that links reach from it, and whether that is its own."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = written(own.mapInArrow(_signed(width), _SIGNED), "signed")
    nodes = linking.nodes_of(rows, "sig")
    shards = shard_count(nodes.count(), SETS_PER_SHARD)
    entries = written(
        nodes.select("node", "sig").mapInArrow(_dealt_keys(shards), linking.DEALT).groupBy("shard")
        .applyInArrow(linking.repeated, linking.ENTRIES).withColumnRenamed("member", "node"), "entries")
    label = linking.component_labels(rows, nodes, own, entries, within_distance(per_cent), width, per_cent, "sig")
    return linking.by_document(rows, nodes, label).withColumn("kept", F.col("doc_id") == F.col("component_id"))


ship_functions(__name__)
