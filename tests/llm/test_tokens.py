from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from sensorquery.llm import bpe, packing
from sensorquery.llm.text import Texts
from sensorquery.llm.tokens import ByteTokenizer

PARTS = ["a", "b ", "\n", " ", "  ", "\t", "\xa0", "　", "​", "é", "<|endoftext|>", "<|endof", "text|>",
         "'s", "'re", "12", "!!", "ß", "日本", "\r\n", "\x1f", "\x85", " ", "😀", "word "]


@pytest.fixture(scope="module")
def library(vocab):
    return Tokenizer.from_file(vocab)


def _ids(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_pieces_and_chunks_equal_the_library(vocab, library, monkeypatch):
    monkeypatch.setattr(bpe, "SHORTEST", 4)
    monkeypatch.setattr(bpe, "LONGEST", 40)
    monkeypatch.setattr(bpe, "MEAN_BITS", 4)
    coder, rng = ByteTokenizer(vocab), random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 60)))
        ids = _ids(library, text)
        assert np.frombuffer(coder.encode(text), "<u4").tolist() == ids
        assert coder.decode(np.array(ids, dtype=np.int64)) == library.decode(ids, skip_special_tokens=False).encode()
        raw = text.encode()
        cuts = bpe.cut_texts(Texts(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), slice(0, 1)))[0]
        joined = bpe.join_chunks(raw, cuts, lambda a, b: coder.encode(raw[a:b].decode()), coder)
        assert np.frombuffer(joined, "<u4").tolist() == ids, (text, cuts)


def test_special_strings_inside_a_text(vocab, library):
    coder = ByteTokenizer(vocab)
    assert coder.fast is not None and coder.special == ["<|endoftext|>"]
    text = "a <|endoftext|><|endoftext|> b<|endof text|>"
    ids = _ids(library, text)
    assert 50256 in ids and np.frombuffer(coder.encode(text), "<u4").tolist() == ids
    assert coder.listed(np.array(ids)) == ",".join(map(str, ids)).encode()


def test_other_kinds_of_vocabularies_are_refused():
    from sensorquery.llm.queries import vocabulary

    with pytest.raises(ValueError):
        ByteTokenizer(vocabulary("word_bpe_49k.json"))


def test_round_trip_of_awkward_rows(awkward_docs, awkward, vocab, library):
    got = sorted(map(tuple, bpe.round_trip(awkward_docs, vocab).collect()), key=str)
    want = []
    for i, t in awkward:
        ids = _ids(library, t)
        text = library.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_decode_gives_the_text_back(awkward_docs, awkward, vocab):
    back = bpe.decode(bpe.encode(awkward_docs, vocab), vocab).collect()
    assert sorted((str(i), t or "") for i, t in awkward) == sorted((str(r.doc_id), r.decoded) for r in back)


def test_empty_tables(no_docs, vocab):
    assert bpe.round_trip(no_docs, vocab).count() == 0
    assert packing.pack_documents(no_docs, vocab).count() == 0


def test_shared_chunks_are_encoded_once(spark, vocab):
    passage = " ".join(f"word{i * 7919 % 1000}" for i in range(900))
    docs = spark.createDataFrame([(i, f"start{i} " * (i + 1) + passage) for i in range(6)], "doc_id long, text string")
    rows = bpe._joined(docs, vocab).collect()
    carried = {r.doc_id: len(r.carried or ()) for r in rows}
    assert carried[0] == 0 and all(carried[i] > 0 for i in range(1, 6))


def test_first_fit_decreasing_by_brute_force():
    rng = random.Random(3)
    for _ in range(200):
        lengths = [rng.randint(1, 20) for _ in range(rng.randint(0, 40))]
        bins, offsets = packing.first_fit_decreasing(lengths, 20)
        room, want = [], [0] * len(lengths)
        for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
            b = next((k for k, r in enumerate(room) if r >= lengths[i]), len(room))
            if b == len(room):
                room.append(20)
            want[i] = b
            room[b] -= lengths[i]
        assert bins == want
        for b in set(bins):
            at = 0
            for o, n in sorted((offsets[i], lengths[i]) for i in range(len(bins)) if bins[i] == b):
                assert o == at
                at += n


def test_packing_holds_every_id_once(awkward_docs, awkward, vocab, library):
    rows = packing.pack_documents(awkward_docs, vocab, capacity=64).collect()
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id, r.doc_tokens].append((r.start, r.length, r.ids_crc32))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    whole = defaultdict(list)
    for i, t in awkward:
        ids = _ids(library, t) + [1]
        whole[i, len(ids)] += [
            (s, len(ids[s:s + 64]), zlib.crc32(np.array(ids[s:s + 64], dtype="<u4").tobytes())) for s in range(0, len(ids), 64)]
    assert {k: sorted(v) for k, v in pieces.items()} == {k: sorted(v) for k, v in whole.items()}


def test_packing_leaves_little_room(spark, small, vocab):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = packing.pack_documents(docs, vocab).collect()
    assert sum(r.length for r in rows) / (2048 * len({r.sequence_id for r in rows})) > 0.95


def test_repeated_ids_carry_each_chunk_once(spark, vocab, library):
    text = " ".join(f"word{i} of a long text" for i in range(400))
    rows = [(7, text)] * 10 + [(8, text + " end")]
    carried = bpe._joined(spark.createDataFrame(rows, "doc_id long, text string"), vocab).select("doc_id", "carried").collect()
    once = bpe._joined(spark.createDataFrame([rows[0], rows[-1]], "doc_id long, text string"), vocab).select("doc_id", "carried").collect()
    sizes = lambda got: {r.doc_id: len(r.carried or ()) for r in got}
    assert sizes(carried) == sizes(once) and len({c["chunk"] for r in carried for c in r.carried or ()}) == max(sizes(once).values())


def test_rows_alike_are_dealt_to_many_groups(spark, vocab, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_PIECES", 10)
    docs = spark.createDataFrame([(None, "the same text")] * 200, "doc_id long, text string").repartition(4)
    got = packing.pack_documents(docs, vocab).collect()
    assert len(got) == 200 and len({r.sequence_id >> 32 for r in got}) > 10
    long = spark.createDataFrame([(1, "many words " * 9000), (2, "few")], "doc_id long, text string")
    parts = packing.pack_documents(long, vocab).collect()
    assert len({r.sequence_id >> 32 for r in parts if r.doc_id == 1}) == 1  # a document is dealt whole
