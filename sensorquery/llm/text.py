"""Vectorised work on the text column of Arrow batches: bytes, words and hashes without a loop per word.

Texts are taken as UTF-8 bytes straight from the Arrow buffers. Null texts count as empty. Memory
follows the slice in hand: batches are cut to SLICE_BYTES, and only a longer single text exceeds it.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Iterator

import numpy as np

from sensorquery.session import ship_functions

SLICE_BYTES = 1 << 20
# The white space that ends a word: blank and 0x09-0x0D.
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C13


def small_batches(spark) -> None:
    """Rows of texts are large: fewer of them to an Arrow batch keep the buffers of a task small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def worker_cache() -> dict:
    """A dictionary that outlives the task: Python workers are reused, by-value functions are not."""
    name = "_sensorquery_worker_cache"
    return vars(sys.modules.setdefault(name, types.ModuleType(name)))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = np.asarray(x, dtype=np.uint64).copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, kept per worker."""
    cache = worker_cache()
    have = cache.get("powers")
    if have is None or len(have[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        out = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, np.uint64(base & (2**64 - 1)))
            p[0] = 1
            np.multiply.accumulate(p, out=p)
            out.append(p)
        have = cache["powers"] = tuple(out)
    return have[0][:n], have[1][:n]


def _byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D))


class Texts:
    """A slice of texts: their bytes end to end, and where each begins."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, rows: slice):
        self.data, self.offsets, self.rows = data, offsets, rows

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i]:self.offsets[i + 1]].tobytes()

    def lowered(self) -> Texts:
        """A-Z to a-z, nothing else."""
        return Texts(_LOWER[self.data], self.offsets, self.rows)

    def words(self, blank: np.ndarray | None = None) -> Words:
        """``blank``: a flag per byte that ends a word, white space if not given."""
        return Words(self, _BLANK if blank is None else blank)

    def prefix_hash(self) -> np.ndarray:
        """H with H[j] - H[i] = sum of value(byte k) * base**k over i <= k < j."""
        power, _ = _powers(len(self.data) + 1)
        out = np.zeros(len(self.data) + 1, dtype=np.uint64)
        np.cumsum(_byte_values()[self.data] * power[:-1], out=out[1:])
        return out


class Words:
    """The maximal runs without blank bytes, text after text: starts, ends (bytes), first (index of
    each text's first word, one longer than the texts), doc (text of each word)."""

    def __init__(self, texts: Texts, blank: np.ndarray):
        solid = ~blank[texts.data]
        n = len(solid)
        before = np.zeros(n, dtype=bool)
        before[1:] = solid[:-1]
        edges = texts.offsets[:-1][texts.offsets[:-1] < n]
        before[edges] = False
        self.starts = np.flatnonzero(solid & ~before)
        after = np.zeros(n, dtype=bool)
        after[:-1] = solid[1:]
        after[edges[edges > 0] - 1] = False
        self.ends = np.flatnonzero(solid & ~after) + 1
        self.first = np.searchsorted(self.starts, texts.offsets)
        self.texts = texts

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.texts)), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash per word; equal words have equal hashes in every text, task and run."""
        prefix = self.texts.prefix_hash()
        _, inverse = _powers(len(self.texts.data) + 1)
        raw = (prefix[self.ends] - prefix[self.starts]) * inverse[self.starts]
        return mix(raw + (self.ends - self.starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def runs_hash(word_hash: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` consecutive words (over the whole slice; the caller drops runs
    that cross texts)."""
    n = len(word_hash) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        out *= np.uint64(_BASE)
        out += word_hash[k:k + n]
    return mix(out)


def shard_count(rows: int, per_shard: int, least: int = 16) -> int:
    """A power of two that grows with the rows."""
    shards = least
    while shards * per_shard < rows:
        shards *= 2
    return shards


def slices(batch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[Texts]:
    """The texts of an Arrow batch, in slices of at most ``limit`` bytes or one text."""
    import pyarrow as pa
    import pyarrow.compute as pc

    col = batch.column(batch.schema.get_field_index(column)).cast(pa.large_string())
    if col.null_count:
        col = pc.fill_null(col, "")
    n = len(col)
    if not n:
        return
    _, where, raw = col.buffers()
    offsets = np.frombuffer(where, dtype=np.int64)[col.offset:col.offset + n + 1]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(max(to, at + 1), n)
        yield Texts(data[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at], slice(at, to))
        at = to


ship_functions(__name__)
