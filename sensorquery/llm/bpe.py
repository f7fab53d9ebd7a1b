"""BPE encoding with content-defined chunk reuse, and decoding.

Texts are cut where a rolling hash over the last bytes says so, so equal passages give equal chunks
wherever they stand. A chunk found in more than one document is encoded once, by the document with
the smallest id, and handed to the others. Such a chunk was encoded alone, which is wrong around its
ends: the span around each join, with all chunks that no other document has, is encoded afresh, from
the last sure piece border before it to the first one after it, and this span grows until the tokens
on both sides end exactly on these borders.

Null or empty texts have no ids. Rows with a null or repeated ``doc_id`` are encoded like any other;
extra columns are not looked at. Memory of a task: one slice of texts, or one longer text.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorquery.llm.text import Texts, _powers, mix, slices
from sensorquery.llm.tokens import tokenizer
from sensorquery.session import ship_functions

WINDOW = 24  # bytes under the rolling hash
MEAN_BITS = 10  # a cut about every 2**10 bytes
SHORTEST, LONGEST = 256, 8192


def cut_texts(texts: Texts) -> list[list[int]]:
    """Chunk borders of each text of a slice (first 0, last its length), never inside a character."""
    data, offsets = texts.data, texts.offsets
    n = len(data)
    found = np.zeros(0, dtype=np.int64)
    if n > WINDOW:
        prefix = texts.prefix_hash()
        _, inverse = _powers(n + 1)
        rolled = mix((prefix[WINDOW:] - prefix[:-WINDOW]) * inverse[:n + 1 - WINDOW])
        at = np.flatnonzero((rolled >> np.uint64(64 - MEAN_BITS)) == 0) + WINDOW
        at = at[at < n]
        found = at[(data[at] & 0xC0) != 0x80]
    out = []
    for i in range(len(texts)):
        low, high = int(offsets[i]), int(offsets[i + 1])
        cuts, last = [0], low
        a, b = np.searchsorted(found, (low + WINDOW, high))
        for c in [*found[a:b].tolist(), high]:
            while c - last > LONGEST:
                last += LONGEST
                while (data[last] & 0xC0) == 0x80:
                    last -= 1
                cuts.append(last - low)
            if c < high and c - last >= SHORTEST:
                cuts.append(c - low)
                last = c
        if high > low:
            cuts.append(high - low)
        out.append(cuts)
    return out


def chunk_name(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def _names_of(batches):
    """(doc_id, chunk) for each distinct chunk of each document."""
    import pyarrow as pa

    for batch in batches:
        ids = batch.column(0)
        for texts in slices(batch):
            who, names = [], []
            for i, cuts in enumerate(cut_texts(texts)):
                doc = ids[texts.rows.start + i].as_py()
                if doc is None:
                    continue
                raw = texts.text(i)
                own = {chunk_name(raw[a:b]) for a, b in zip(cuts, cuts[1:])}
                who += [doc] * len(own)
                names += own
            yield pa.RecordBatch.from_arrays(
                [pa.array(who, pa.int64()), pa.array(names, pa.binary())], ["doc_id", "chunk"])


def _encode_owned(path: str):
    def run(batches):
        import pyarrow as pa

        coder = tokenizer(path)
        for batch in batches:
            wanted = batch.column(batch.schema.get_field_index("owned"))
            keep = np.flatnonzero(np.asarray(wanted.is_valid()))
            for rows in _few(batch.take(pa.array(keep))):
                wanted = rows.column(rows.schema.get_field_index("owned"))
                names, ids = [], []
                for i, texts in enumerate(_unpacked(rows)):
                    raw, left, cuts = texts.text(0), set(wanted[i].as_py()), cut_texts(texts)[0]
                    for a, b in zip(cuts, cuts[1:]):
                        name = chunk_name(raw[a:b])
                        if name in left:
                            left.discard(name)
                            names.append(name)
                            ids.append(coder.encode(raw[a:b].decode()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.binary()), pa.array(ids, pa.binary())], ["chunk", "ids"])

    return run


def join_chunks(raw: bytes, cuts: list[int], ids_of, coder) -> bytes:
    """The ids of the whole text, from the ids of chunks that were each encoded alone; ``ids_of`` gives
    None for a chunk that nobody has encoded."""
    if len(cuts) < 2:
        return b""
    data = np.frombuffer(raw, dtype=np.uint8)
    seen, next_ = data[:-1], data[1:]
    # Between a visible ASCII character and a following blank or line end a piece always ends.
    sure = np.flatnonzero((seen > 32) & (seen < 127) & ((next_ == 32) | (next_ == 10))) + 1
    out: list[bytes] = []
    done = 0  # bytes whose final ids are in out
    for a, b in zip(cuts, cuts[1:]):
        low, high = np.searchsorted(sure, (a, b), side="left")
        high = int(np.searchsorted(sure, b, side="right"))
        inside = sure[low:high]
        first = [a] if a == 0 else []
        last = [b] if b == len(raw) else []
        if not len(inside) and not (first and last):
            continue
        known = ids_of(a, b)
        if known is None:
            continue
        ids = np.frombuffer(known, dtype="<u4")
        ends = a + np.cumsum(coder.lengths[ids])
        # Borders on which a token of this chunk ends (or begins); the outermost two agree.
        agreed = inside[np.isin(inside, ends)] if a == 0 or not len(inside) or inside[0] != a else \
            inside[(inside == a) | np.isin(inside, ends)]
        begin = a if first else (int(agreed[0]) if len(agreed) else None)
        end = b if last else (int(agreed[-1]) if len(agreed) else None)
        if begin is None or end is None or end <= begin:
            continue
        if begin > done:
            out.append(coder.encode(raw[done:begin].decode()))
        i = int(np.searchsorted(ends, begin, side="right")) if begin > a else 0
        j = int(np.searchsorted(ends, end, side="right"))
        out.append(ids[i:j].tobytes())
        done = end
    if done < len(raw):
        out.append(coder.encode(raw[done:].decode()))
    return b"".join(out)


def _squeeze(batches):
    """Texts travel compressed: they are the bulk of what is shuffled."""
    import pyarrow as pa
    import zstandard

    packer = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        for texts in slices(batch):
            packed = [packer.compress(texts.text(i)) for i in range(len(texts))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)[texts.rows], pa.array(packed, pa.binary())], ["doc_id", "packed"])


def _assemble(path: str, finish=None):
    """Ids of each row; ``finish(coder, ids)`` makes its columns from them, else they are returned."""

    def run(batches):
        import pyarrow as pa

        coder, out = tokenizer(path), None
        for batch in batches:
            for rows in _few(batch):
                out = []
                carried = rows.column(rows.schema.get_field_index("carried"))
                for i, texts in enumerate(_unpacked(rows)):
                    raw = texts.text(0)
                    given = {x["chunk"]: x["ids"] for x in carried[i].as_py() or ()}
                    if given:
                        ids = join_chunks(raw, cut_texts(texts)[0], lambda a, b: given.get(chunk_name(raw[a:b])), coder)  # noqa: B023
                    else:
                        ids = coder.encode(raw.decode())
                    out.append(finish(coder, ids) if finish else (ids,))
                columns = [pa.array(c) for c in zip(*out)]
                yield pa.RecordBatch.from_arrays([rows.column(0), *columns], ["doc_id", *map(str, range(len(columns)))])

    return run


def _few(batch, rows: int = 256):
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def _unpacked(batch):
    """Each row's text, as a slice of its own."""
    import zstandard

    plain = zstandard.ZstdDecompressor()
    for x in batch.column(batch.schema.get_field_index("packed")):
        raw = plain.decompress(x.as_buffer())
        yield Texts(np.frombuffer(raw, dtype=np.uint8), np.array([0, len(raw)]), slice(0, 1))


def _joined(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, packed text and the ids of the chunks that other documents have encoded.

    Names of chunks are pre-aggregated before their shuffle, so copies of one chunk never meet in
    one task; the joins are sort-merge joins whose skewed partitions Spark splits. Both joins with
    the texts use the same shuffle of them.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    names = own.mapInArrow(_names_of, "doc_id long, chunk binary")
    shared = (
        names.groupBy("chunk").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("other"))
        .where(F.col("owner") != F.col("other")).select("chunk", "owner")
    )
    packed = own.mapInArrow(_squeeze, "doc_id long, packed binary")
    owned = shared.groupBy(F.col("owner").alias("doc_id")).agg(F.collect_set("chunk").alias("owned"))
    # Rows that share an id would name a chunk, and encode it, once each.
    once = packed.join(owned, "doc_id", "left").mapInArrow(_encode_owned(path), "chunk binary, ids binary").dropDuplicates(["chunk"])
    borrowed = names.join(shared, "chunk").where(F.col("doc_id") != F.col("owner")).select("doc_id", "chunk").distinct()
    carried = (
        borrowed.join(once, "chunk").groupBy("doc_id")
        .agg(F.collect_list(F.struct("chunk", "ids")).alias("carried"))
    )
    return packed.join(carried, "doc_id", "left")


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) per row of ``docs``; ids is binary, little-endian unsigned 32-bit numbers."""
    return _joined(docs, path).mapInArrow(_assemble(path), "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, decoded): the text of the ids, special tokens included; null ids give empty text."""

    def run(batches):
        import pyarrow as pa

        coder = tokenizer(path)
        for batch in batches:
            text = [coder.decode(np.frombuffer(x.as_buffer(), dtype="<u4")) if x.is_valid else b""
                    for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(text, pa.binary()).cast(pa.string())], ["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded string")


def _digests(coder, ids: bytes):
    numbers = np.frombuffer(ids, dtype="<u4")
    return (len(numbers), hashlib.sha256(coder.listed(numbers)).hexdigest(),
            hashlib.sha256(coder.decode(numbers)).hexdigest())


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encodes, decodes the ids and digests both, in
    the task that has the ids, so that they need not travel."""
    return _joined(docs, path).mapInArrow(
        _assemble(path, _digests), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


ship_functions(__name__)
