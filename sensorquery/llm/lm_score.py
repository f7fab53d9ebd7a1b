"""Language-model scores from a log-frequency Bloom filter of word pairs, with exact word counts.

Tokens are the words of the text with A-Z lower-cased, then one end token. Documents whose
crc32(doc_id as text) mod FOLDS is 0 are held out; all others are counted, whole.

Word counts are exact and never broadcast. Documents are taken in blocks of some megabytes, which are
written once, so that questions and scores are of the same blocks; a block
asks for the counts of its distinct words only, packed by shard of the word, and a shard answers each
block in the order of its question. Word pairs are counted and asked for in the same way. Every pair
seen enters the shard's segment of the filter at the levels 1 .. q of its quantised count,
q = 1 + floor(log(count) / log(BASE)). A segment is sized by the levels it takes in, to a share FILL
of bits set, and lives in its shard's task only: the filter grows with the corpus, nothing of it is
broadcast. The shard probes level after level until a miss and answers the last level hit, a byte a
pair; its mean count is the pair's count.

P(w | v) = WEIGHT * c(v, w) / c(v) + (1 - WEIGHT) * (c(w) + 0.1) / (N + 0.1 (V + 1)), where c(v, w) is
no larger than c(v) and c(w). Base scores use the second part alone. Words are told apart by 64 bits.

Null or empty texts have the end token only. Repeated rows count as often as they stand there; a null
id is held out. Extra columns are not looked at. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorquery.llm.components import written
from sensorquery.llm.text import Texts, _BASE, mix, shard_count, slices
from sensorquery.session import ship_functions

FOLDS = 10
BLOCK_BYTES = 4 << 20
DOCS_PER_SHARD = 4096
PROBES = 4
FILL = 0.25  # bits set in a segment: a miss passes a level with probability FILL ** PROBES
BASE = 1.5
LEVELS = 64  # counts up to BASE ** LEVELS, beyond any corpus
LEAST_COUNT = 2  # of filter_segment where not given; scores take pairs seen once too
WEIGHT = 0.2
_END, _BEGIN = np.uint64(0x5EED0FE2D0E2D000), np.uint64(0x5EED0B3617B36170)
_STEP, _TRY = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)


def held_out(doc_id) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == 0


class Tokens:
    """Token hashes of a block, text after text, and the pairs (token before, token)."""

    def __init__(self, texts: Texts):
        parts, count = [], np.zeros(len(texts), dtype=np.int64)
        at = 0
        while at < len(texts):  # hashed by smaller slices, to bound memory
            to = int(np.searchsorted(texts.offsets, texts.offsets[at] + (1 << 20), side="right")) - 1
            to = min(max(to, at + 1), len(texts))
            low, high = texts.offsets[at], texts.offsets[to]
            part = Texts(texts.data[low:high], texts.offsets[at:to + 1] - low, slice(at, to)).lowered().words()
            parts.append(np.insert(part.hashes(), part.first[1:], _END))
            count[at:to] = np.diff(part.first) + 1
            at = to
        self.key = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        self.count = count
        self.doc = np.repeat(np.arange(len(texts)), count)
        self.first = np.concatenate([[0], np.cumsum(count)[:-1]]).astype(np.int64) if len(count) else count
        before = np.empty_like(self.key)
        before[1:] = self.key[:-1]
        before[self.first] = _BEGIN
        self.before = before
        self.pair = mix(before * np.uint64(_BASE) + self.key)


def _asked(tokens: Tokens, shards: int):
    """The distinct words of a block (the begin of a text among them), ordered by shard, with borders."""
    keys = np.unique(np.append(tokens.key, _BEGIN))
    shard = (keys >> np.uint64(32)) % np.uint64(shards)
    order = np.argsort(shard, kind="stable")
    return keys[order], np.searchsorted(shard[order], np.arange(shards + 1, dtype=np.uint64))


def _asked_pairs(tokens: Tokens, docs, shards: int):
    """The distinct pairs of a block ordered by shard, in each those counted once first, how often the
    documents that are not held out have them, and the borders."""
    used = np.repeat(np.array([not held_out(d) for d in docs], dtype=bool), tokens.count)
    pair, at = np.unique(tokens.pair, return_inverse=True)
    times = np.bincount(at[used], minlength=len(pair)).astype(np.uint32)
    home = (pair >> np.uint64(32)) % np.uint64(shards)
    order = np.lexsort((times != 1, home))
    return pair[order], times[order], np.searchsorted(home[order], np.arange(shards + 1, dtype=np.uint64))


def _block_name(docs, texts: Texts) -> bytes:
    name = hashlib.blake2b(digest_size=16)
    name.update(",".join(map(str, docs)).encode())
    name.update(texts.offsets.astype("<i8").tobytes())
    name.update(texts.data)
    return name.digest()


def _block(batch, i: int):
    """Ids and texts of a row of the blocks' table."""
    import zstandard

    get = lambda name: batch.column(batch.schema.get_field_index(name))[i]
    raw, docs = zstandard.ZstdDecompressor().decompress(get("packed").as_buffer()), get("ids").as_py()
    offsets = np.frombuffer(get("offsets").as_buffer(), dtype="<i8")
    return docs, Texts(np.frombuffer(raw, dtype=np.uint8), offsets, slice(0, len(docs)))


def _questions(shards: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                docs, texts = _block(batch, i)
                name, out = batch.column(batch.schema.get_field_index("block"))[i].as_py(), [[] for _ in range(7)]
                tokens = Tokens(texts)
                used = np.repeat(np.array([not held_out(d) for d in docs], dtype=bool), tokens.count)
                keys, cut = _asked(tokens, shards)
                place = np.argsort(keys, kind="stable")
                at = place[np.searchsorted(keys[place], tokens.key[used])]
                count = np.bincount(at, minlength=len(keys)).astype(np.uint32)
                begins = int(sum(not held_out(d) for d in docs))
                count[place[np.searchsorted(keys[place], _BEGIN)]] = begins
                pair, times, edge = _asked_pairs(tokens, docs, shards)
                pair = pair.astype(np.uint32)
                for s in np.flatnonzero((np.diff(cut) > 0) | (np.diff(edge) > 0)).tolist():
                    a, b, c, d = int(cut[s]), int(cut[s + 1]), int(edge[s]), int(edge[s + 1])
                    once = times[c:d] == 1
                    row = (s, name, keys[a:b].tobytes(), count[a:b].tobytes(), pair[c:d][once].tobytes(),
                           pair[c:d][~once].tobytes(), times[c:d][~once].tobytes())
                    for col, v in zip(out, row):
                        col.append(v)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[0], pa.int32()), *[pa.array(c, pa.binary()) for c in out[1:]]],
                    ["shard", "block", "keys", "counts", "once", "pairs", "times"])

    return run


_ASKED = "shard int, block binary, keys binary, counts binary, once binary, pairs binary, times binary"
_ANSWER = "block binary, shard int, counts binary, levels binary, tokens long, words long"


def probe_places(key: np.ndarray, level: int, segment_bits: int) -> np.ndarray:
    """Bit of each probe (rows) for keys of one segment (columns) at a level."""
    probes = np.arange(1, PROBES + 1, dtype=np.uint64)[:, None]
    step = np.uint64(level * int(_STEP) % (1 << 64))
    return mix(key.astype(np.uint64) + probes * _TRY + step) % np.uint64(segment_bits)


def _levels(count: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(count) / math.log(BASE) + 1e-9).astype(np.int64)


def sized_segment(count: np.ndarray, least_bits: int = 64) -> int:
    """Bits that the levels of these counts fill to FILL, in whole bytes."""
    marks = PROBES * int(_levels(count[count > 0]).sum())
    bits = max(64, least_bits, math.ceil(marks / -math.log(1 - FILL)))
    return bits + -bits % 8


def filter_segment(key: np.ndarray, count: np.ndarray, segment_bits: int, least: int = LEAST_COUNT) -> bytes:
    """The levels of every key that was seen often enough, as packed bits."""
    keep = count >= least
    key, level = key[keep], _levels(count[keep])
    bits = np.zeros(segment_bits, dtype=bool)
    for j in range(1, int(level.max(initial=0)) + 1):
        bits[probe_places(key[level >= j], j, segment_bits).ravel()] = True
    return np.packbits(bits, bitorder="little").tobytes()


def _answers(least_bits: int, begin: int):
    def run(table):
        import pyarrow as pa

        def column(name, kind):
            return [np.frombuffer(x.as_buffer(), dtype=kind) for x in table.column(name).combine_chunks()]

        keys, counts = column("keys", np.uint64), column("counts", np.uint32)
        joined, own = np.concatenate(keys), np.concatenate(counts).astype(np.int64)
        words, where = np.unique(joined, return_inverse=True)
        total = np.bincount(where, weights=own, minlength=len(words)).astype(np.int64)
        real = words != np.uint64(begin)
        once, pairs = np.concatenate(column("once", np.uint32)), np.concatenate(column("pairs", np.uint32))
        times = np.concatenate(column("times", np.uint32)).astype(np.int64)
        pair, at = np.unique(np.concatenate([once, pairs]), return_inverse=True)
        seen = np.bincount(at, weights=np.concatenate([np.ones(len(once)), times]), minlength=len(pair)).astype(np.int64)
        size = sized_segment(seen, least_bits)
        level = BloomCounts(filter_segment(pair, seen, size, least=1), 1, size).levels(pair.astype(np.uint64)).astype(np.uint8)
        level_once, level_more = level[at[:len(once)]], level[at[len(once):]]
        answer, levels, low, low_once, low_more = [], [], 0, 0, 0
        for k, o, m in zip(keys, table.column("once").combine_chunks(), table.column("pairs").combine_chunks()):
            answer.append(total[where[low:low + len(k)]].astype("<i8").tobytes())
            n_once, n_more = len(o.as_buffer()) // 4, len(m.as_buffer()) // 4
            levels.append(level_once[low_once:low_once + n_once].tobytes() + level_more[low_more:low_more + n_more].tobytes())
            low, low_once, low_more = low + len(k), low_once + n_once, low_more + n_more
        n, shard = len(keys), table.column("shard")[0].as_py()
        return pa.table({
            "block": pa.concat_arrays([table.column("block").combine_chunks(), pa.nulls(1, pa.binary())]),
            "shard": pa.array([shard] * (n + 1), pa.int32()),
            "counts": pa.array([*answer, None], pa.binary()),
            "levels": pa.array([*levels, None], pa.binary()),
            "tokens": pa.array([None] * n + [int(total[real].sum())], pa.int64()),
            "words": pa.array([None] * n + [int((total[real] > 0).sum())], pa.int64()),
        })

    return run


def _blocks(batches):
    """One row per block: its name, ids and compressed texts."""
    import pyarrow as pa
    import zstandard

    packer = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        for texts in slices(batch, limit=BLOCK_BYTES):
            ids = batch.column(0)[texts.rows]
            yield pa.RecordBatch.from_arrays([
                pa.array([_block_name(ids.to_pylist(), texts)], pa.binary()),
                pa.array([ids.to_pylist()], pa.list_(pa.int64())),
                pa.array([texts.offsets.astype("<i8").tobytes()], pa.binary()),
                pa.array([packer.compress(texts.data.tobytes())], pa.binary()),
            ], ["block", "ids", "offsets", "packed"])


def _mean_counts() -> np.ndarray:
    """The mean count of each level."""
    return np.array([0.0] + [(BASE ** (j - 1) + BASE ** j) / 2 for j in range(1, LEVELS)])


class BloomCounts:
    """Reads quantised counts from the segments of a log-frequency filter."""

    def __init__(self, raw: bytes, shards: int, segment_bits: int):
        self.bits, self.shards, self.segment = np.frombuffer(raw, dtype=np.uint8), shards, segment_bits

    def _has(self, shard: np.ndarray, key: np.ndarray, level: int) -> np.ndarray:
        hit = np.ones(len(key), dtype=bool)
        for probe in probe_places(key, level, self.segment):
            at = shard * np.uint64(self.segment) + probe
            hit &= (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return hit

    def levels(self, pair: np.ndarray) -> np.ndarray:
        shard, key = (pair >> np.uint64(32)) % np.uint64(self.shards), pair & np.uint64(0xFFFFFFFF)
        level, alive = np.zeros(len(pair), dtype=np.int64), np.arange(len(pair))
        for j in range(1, LEVELS):
            alive = alive[self._has(shard[alive], key[alive], j)]
            if not len(alive):
                break
            level[alive] = j
        return level

    def counts(self, pair: np.ndarray) -> np.ndarray:
        return _mean_counts()[self.levels(pair)]


def _scores(shards: int, tokens_seen: int, words_seen: int):
    def run(batches):
        import pyarrow as pa

        middle = _mean_counts()
        for batch in batches:
            for i in range(batch.num_rows):
                docs, texts = _block(batch, i)
                tokens = Tokens(texts)
                keys, _ = _asked(tokens, shards)
                answer = {x["shard"]: (x["counts"], x["levels"]) for x in batch.column(batch.schema.get_field_index("answers"))[i].as_py()}
                count = np.frombuffer(b"".join(answer[s][0] for s in sorted(answer)), dtype="<i8")
                pair, _, _ = _asked_pairs(tokens, docs, shards)
                level = np.frombuffer(b"".join(answer[s][1] for s in sorted(answer)), dtype=np.uint8)
                level = level[np.argsort(pair)][np.searchsorted(np.sort(pair), tokens.pair)]
                order = np.argsort(keys, kind="stable")
                sorted_keys = keys[order]
                c = count[order[np.searchsorted(sorted_keys, tokens.key)]].astype(float)
                before = count[order[np.searchsorted(sorted_keys, tokens.before)]].astype(float)
                alone = (c + 0.1) / (tokens_seen + 0.1 * (words_seen + 1))
                both = np.minimum(middle[level], np.minimum(c, before))
                together = np.where(before > 0, WEIGHT * both / np.maximum(before, 1) + (1 - WEIGHT) * alone, alone)
                n = len(docs)
                yield pa.RecordBatch.from_arrays([
                    pa.array(docs, pa.int64()), pa.array([held_out(d) for d in docs]), pa.array(tokens.count, pa.int64()),
                    pa.array(np.bincount(tokens.doc, weights=c > 0, minlength=n).astype(np.int64)),
                    pa.array(np.full(n, tokens_seen, dtype=np.int64)),
                    pa.array(np.bincount(tokens.doc, weights=np.log10(alone), minlength=n)),
                    pa.array(np.bincount(tokens.doc, weights=np.log10(together), minlength=n)),
                ], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


SCORES = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def score(docs: DataFrame, *, filter_bits: int = 0) -> DataFrame:
    """Counts the documents that are not held out and scores all of them: SCORES. The filter has
    ``filter_bits`` bits at least."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # Cut once and written: another scan may see other splits, batches or row orders, so other blocks.
    blocks = written(own.mapInArrow(_blocks, "block binary, ids array<long>, offsets binary, packed binary"), "blocks")
    shards = shard_count(blocks.agg(F.sum(F.size("ids"))).first()[0] or 0, DOCS_PER_SHARD)
    answers = written(
        blocks.mapInArrow(_questions(shards), _ASKED).groupBy("shard").applyInArrow(
            _answers(filter_bits // shards, int(_BEGIN)), _ANSWER),
        "answers")
    seen = answers.where("block is null").agg(F.sum("tokens").alias("n"), F.sum("words").alias("v")).first()
    by_block = answers.where("block is not null").groupBy("block").agg(
        F.collect_list(F.struct("shard", "counts", "levels")).alias("answers"))
    return blocks.join(by_block, "block").mapInArrow(_scores(shards, seen["n"] or 0, seen["v"] or 0), SCORES)


ship_functions(__name__)
