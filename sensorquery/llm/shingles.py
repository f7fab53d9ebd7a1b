"""The distinct word shingles of texts, as sets of 64-bit hashes."""

from __future__ import annotations

import numpy as np

from sensorquery.llm.text import mix, runs_hash, slices
from sensorquery.session import ship_functions

SALT = np.uint64(0xD6E8FEB86659FD93)


class ShingleSets:
    """The distinct shingles of each text of a slice: ``hashes`` sorted within each text, ``doc`` the
    text of each, ``first`` where each text begins, ``size`` per text."""

    def __init__(self, texts, width: int):
        words = texts.lowered().words()
        hashed, count = words.hashes(), np.diff(words.first)
        runs = runs_hash(hashed, width)
        doc = words.doc
        inside = np.flatnonzero(doc[:len(runs)] == doc[width - 1:width - 1 + len(runs)]) if len(runs) else np.zeros(0, int)
        found, owner = [runs[inside]], [doc[inside]]
        for i in np.flatnonzero((count > 0) & (count < width)).tolist():
            a, b = words.first[i], words.first[i + 1]
            found.append(runs_hash(hashed[a:b], int(b - a)) ^ np.uint64(b - a))
            owner.append(np.array([i]))
        h, d = np.concatenate(found), np.concatenate(owner)
        order = np.lexsort((h, d))
        h, d = h[order], d[order]
        fresh = np.ones(len(h), dtype=bool)
        fresh[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        self.hashes, self.doc = h[fresh], d[fresh]
        self.first = np.searchsorted(self.doc, np.arange(len(texts) + 1))
        self.size = np.diff(self.first)

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sum of a value per shingle over each text."""
        total = np.zeros(len(self.size), dtype=np.uint64)
        some = np.flatnonzero(self.size)
        if len(some):
            total[some] = np.add.reduceat(values, self.first[some])
        return total

    def names(self) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit names of each set; sets are taken as equal if both agree."""
        return self.sums(mix(self.hashes)).view(np.int64), self.sums(mix(self.hashes ^ SALT)).view(np.int64)


def squeeze(batches):
    """(doc_id, packed): texts compressed, for the way through a shuffle."""
    import pyarrow as pa
    import zstandard

    packer = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        for texts in slices(batch):
            packed = [packer.compress(texts.text(i)) for i in range(len(texts))]
            yield pa.RecordBatch.from_arrays([batch.column(0)[texts.rows], pa.array(packed, pa.binary())], ["doc_id", "packed"])


def read_sets(width: int):
    """Arrow batches of compressed texts with a node and the names of its set to (node, hashes), the
    hashes sorted and packed; texts of other sets (of the same id) are left out."""

    def run(batches):
        import pyarrow as pa
        import zstandard

        plain = zstandard.ZstdDecompressor()
        for full in batches:
            for at in range(0, full.num_rows, 256):
                batch = full.slice(at, 256)
                node, set1, set2 = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
                text = pa.array([plain.decompress(x.as_buffer()) for x in batch.column(0)], pa.large_binary()).cast(pa.large_string())
                for texts in slices(pa.RecordBatch.from_arrays([text], ["text"])):
                    sets = ShingleSets(texts, width)
                    a, b = sets.names()
                    own = np.flatnonzero((a == set1[texts.rows]) & (b == set2[texts.rows]))
                    packed = [sets.hashes[sets.first[i]:sets.first[i + 1]].tobytes() for i in own.tolist()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(node[texts.rows][own], pa.int64()), pa.array(packed, pa.binary())], ["node", "hashes"])

    return run


ship_functions(__name__)
