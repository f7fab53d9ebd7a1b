"""Byte-level BPE with the results of the tokenizers library.

Where the ids of the merged tokens grow in the order of the merges, ranks stand for merges and the
faster encoder for rank files gives the same ids; otherwise, and for texts that hold the string of a
special token, the tokenizers library encodes. The vocabulary file is a parameter; its properties are
checked when it is loaded.
"""

from __future__ import annotations

import json
import re

import numpy as np

from sensorquery.llm.text import worker_cache
from sensorquery.session import ship_functions

# Fixed value of byte-level vocabularies: how a text is split before merging.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_of_char() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 bytes stand for
    themselves, the others follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteTokenizer:
    """Encodes and decodes like ``Tokenizer.from_file(path)`` without truncation, padding or added
    special tokens. A special token's string inside a text becomes its id, as in the library."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        before, model = spec.get("pre_tokenizer") or {}, spec["model"]
        added = spec.get("added_tokens") or []
        if (
            spec.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space")
            or not before.get("use_regex", True) or model.get("type") != "BPE"
            or any(re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] or t["single_word"] for t in added)
        ):
            raise ValueError("a byte-level BPE file without normalizer and prefix space is needed")
        self.path, self._library = path, None
        to_byte = _byte_of_char()
        vocab = {bytes(to_byte[c] for c in k): v for k, v in model["vocab"].items()
                 if all(c in to_byte for c in k)}
        self.special = [t["content"] for t in added]
        self.table = [b""] * (max([*model["vocab"].values(), *(t["id"] for t in added)]) + 1)
        for k, v in vocab.items():
            self.table[v] = k
        for t in added:
            self.table[t["id"]] = t["content"].encode()
        self.lengths = np.array([len(x) for x in self.table], dtype=np.int64)
        self.bytes = _Pieces(self.table)
        self.decimal = _Pieces([b",%d" % i for i in range(len(self.table))])
        merged = [model["vocab"].get("".join(m if isinstance(m, list) else m.split(" ", 1)))
                  for m in model["merges"]]
        self.fast = None
        # Ranks may stand for merges where the ids of merged tokens grow in the order of the merges.
        if None not in merged and all(a < b for a, b in zip(merged, merged[1:])) and len(vocab) == len(merged) + 256:
            single = {k: v for k, v in vocab.items() if len(k) == 1}
            if len(single) == 256 and max(single.values()) < merged[0]:
                self.fast = tiktoken.Encoding("bytes", pat_str=_SPLIT, mergeable_ranks=vocab, special_tokens={})

    @property
    def library(self):
        """The tokenizers library's object, loaded when a text needs it."""
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
            self._library.no_truncation()
            self._library.no_padding()
        return self._library

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if self.fast is None or any(s in text for s in self.special):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the text, special tokens included; broken sequences become U+FFFD."""
        raw = self.bytes.joined(ids)
        return raw.decode("utf-8", "replace").encode()

    def listed(self, ids: np.ndarray) -> bytes:
        """The ids in decimal, joined by commas."""
        return self.decimal.joined(ids)[1:]


class _Pieces:
    """Byte strings by number, end to end, so that many can be joined without a loop."""

    def __init__(self, pieces: list[bytes]):
        self.flat = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        self.length = np.array([len(p) for p in pieces], dtype=np.int64)
        self.start = np.cumsum(self.length) - self.length

    def joined(self, numbers: np.ndarray) -> bytes:
        length = self.length[numbers]
        ends = np.cumsum(length)
        if not len(ends):
            return b""
        return self.flat[np.arange(ends[-1]) + np.repeat(self.start[numbers] - ends + length, length)].tobytes()


def tokenizer(path: str) -> ByteTokenizer:
    """The worker's tokenizer of this file, loaded once."""
    cache = worker_cache()
    key = ("tokenizer", path)
    if key not in cache:
        cache[key] = ByteTokenizer(path)
    return cache[key]


ship_functions(__name__)
