"""Removal of repeated passages by suffix automata.

A window is WINDOW consecutive words. A word goes if some window over it also starts in a document
with a smaller ``doc_id``; windows are judged on the input, not on what is left.

The reference is the whole corpus, which no broadcast can hold, so it is sharded by content and the
passages are brought to the automata instead. Every window is named by its anchor, the smallest hash
among its runs of ANCHOR words: equal windows have equal anchors. First the anchors alone are
shuffled (packed, one per slice and anchor) and those found in a single document are dropped; what
is left are passages that may repeat. Neighbouring windows with one anchor form a passage. In the
shard of its anchor, passages arrive in the order of ``doc_id``: an automaton of the passages of
smaller documents gives the matching statistics of each passage, every match of WINDOW words or more
marks a span, and a passage that is not one match as a whole is added to the automaton. Equal passages of one slice are
settled there, so a large group of copies sends one of them per slice.

An anchor with more than MANY passages, counted once a slice where they are equal, has no automaton
of its own: its passages are cut into their windows, each dealt by a hash of all its words. A common
line in many surroundings is then spread over the shards, and one automaton holds equal windows only.

Null texts count as empty; texts with fewer words than a window lose nothing. Rows that share an id
are judged alone against smaller ids, never against each other. A row with a null id is neither
changed nor used as reference. Extra columns are not looked at. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorquery.llm.text import mix, runs_hash, shard_count, slices
from sensorquery.session import ship_functions

WINDOW = 13
ANCHOR = 4
DOCS_PER_SHARD = 4096
MANY = 2048
_CUT = np.uint64(1 << 63)  # marks a place whose passages are cut into windows


class Passages:
    """The passages of a slice: words ``low`` to ``high`` (exclusive, counted over the slice), the text
    ``doc`` and the anchor ``key`` of each; ``windows``: a hash per window of the slice."""

    def __init__(self, words, window: int):
        n, width = len(words), window - ANCHOR + 1
        none = np.zeros(0, dtype=np.int64)
        self.low = self.high = self.doc = none
        self.key = self.windows = none.astype(np.uint64)
        if n < window:
            return
        hashes = words.hashes()
        grams, self.windows = runs_hash(hashes, ANCHOR), runs_hash(hashes, window)
        doc = words.doc
        at = np.flatnonzero(doc[:n - window + 1] == doc[window - 1:])
        if not len(at):
            return
        place = at + np.lib.stride_tricks.sliding_window_view(grams, width)[at].argmin(axis=1)
        begin = np.ones(len(at), dtype=bool)
        begin[1:] = (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)
        first = np.flatnonzero(begin)
        last = np.append(first[1:], len(at)) - 1
        self.low, self.high = at[first], at[last] + window
        self.doc, self.key = doc[at[first]], grams[place[first]]


def _place(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard and 32 bits of an anchor in one number."""
    shard = (keys >> np.uint64(32)) % np.uint64(shards)
    return (shard << np.uint64(32)) | (keys & np.uint64(0xFFFFFFFF))


def _packed(table, name: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_buffer() for x in table.column(name).combine_chunks()), dtype=kind)


def _anchors(window: int, shards: int):
    """Per slice and shard: one row id per anchor, and the (row id, anchor) that met in the slice."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rid = batch.column(batch.schema.get_field_index("rid")).to_numpy()
            for texts in slices(batch):
                found = Passages(texts.words(), window)
                place, row = _place(found.key, shards), rid[texts.rows][found.doc]
                # A passage is shorter than two windows: its first and last one tell it from others.
                alike = mix(found.windows[found.low] * np.uint64(3) + found.windows[found.high - window]) if len(place) else place
                order = np.lexsort((alike, place))
                kinds, alike = place[order], alike[order]
                fresh = np.ones(len(kinds), dtype=bool)
                fresh[1:] = (kinds[1:] != kinds[:-1]) | (alike[1:] != alike[:-1])
                often, times = np.unique(kinds[fresh], return_counts=True)
                often, times = often[times > 1], times[times > 1].astype(np.uint32)
                order = np.lexsort((row, place))
                place, row = place[order], row[order]
                fresh = np.ones(len(place), dtype=bool)
                fresh[1:] = (place[1:] != place[:-1]) | (row[1:] != row[:-1])
                place, row = place[fresh], row[fresh]
                head = np.ones(len(place), dtype=bool)
                head[1:] = place[1:] != place[:-1]
                start = np.flatnonzero(head)
                count = np.diff(np.append(start, len(place)))
                many = np.repeat(count > 1, count)
                out = [[] for _ in range(7)]
                one, several = (place[head], row[head]), (place[many], row[many])
                # Only the shards that this slice has anchors of.
                used = np.unique(one[0] >> np.uint64(32))
                borders = [np.searchsorted(p >> np.uint64(32), np.append(used, used[-1:] + np.uint64(1))) for p, _ in (one, several, (often, times))]
                for k, s in enumerate(used.tolist()):
                    out[0].append(s)
                    for col, (p, r), cut in ((1, one, borders[0]), (3, several, borders[1]), (5, (often, times), borders[2])):
                        a, b = cut[k], cut[k + 1]
                        out[col].append(p[a:b].astype(np.uint32).tobytes())
                        out[col + 1].append(r[a:b].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[0], pa.int32()), *[pa.array(c, pa.binary()) for c in out[1:]]],
                    ["shard", "keys", "rows", "met_keys", "met_rows", "often_keys", "often"])

    return run


_ANCHORS = "shard int, keys binary, rows binary, met_keys binary, met_rows binary, often_keys binary, often binary"


def _grouped(row: np.ndarray, values: np.ndarray, names: tuple[str, str]):
    """One Arrow row per row id with its values packed."""
    import pyarrow as pa

    order = np.argsort(row, kind="stable")
    row, values = row[order], values[order]
    start = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, int)
    ends = np.append(start[1:], len(row))
    return pa.table({
        names[0]: pa.array(row[start], pa.int64()),
        names[1]: pa.array([values[a:b].tobytes() for a, b in zip(start.tolist(), ends.tolist())], pa.binary()),
    })


def _repeated(many: int):
    """(row id, places): the anchors of a shard that more than one row has."""

    def run(table):
        shard = np.uint64(table.column("shard")[0].as_py())
        key, row = _packed(table, "keys", np.uint32), _packed(table, "rows", np.int64)
        met_key, met_row = _packed(table, "met_keys", np.uint32), _packed(table, "met_rows", np.int64)
        order = np.argsort(key, kind="stable")
        key, row = key[order], row[order]
        head = np.ones(len(key), dtype=bool)
        head[1:] = key[1:] != key[:-1]
        start = np.flatnonzero(head)
        low = np.minimum.reduceat(row, start) if len(start) else row
        high = np.maximum.reduceat(row, start) if len(start) else row
        count = np.diff(np.append(start, len(key)))
        passages = count.copy()
        often_at = np.searchsorted(key[start], _packed(table, "often_keys", np.uint32))
        np.add.at(passages, often_at, _packed(table, "often", np.uint32).astype(np.int64) - 1)
        cut = key[start][passages > many]
        several = np.repeat(low != high, count)
        key, row = np.concatenate([key[several], met_key]), np.concatenate([row[several], met_row])
        place = key.astype(np.uint64) | (shard << np.uint64(32))
        place[np.isin(key, cut)] |= _CUT
        return _grouped(row, place, ("rid", "places"))

    return run


def _unpacked(batch):
    """The batch's texts from their compressed form, a slice each."""
    import pyarrow as pa
    import zstandard

    plain = zstandard.ZstdDecompressor()
    for at in range(0, batch.num_rows, 256):
        part = batch.slice(at, 256)
        packed = part.column(part.schema.get_field_index("packed"))
        text = pa.array([plain.decompress(x.as_buffer()) for x in packed], pa.large_binary()).cast(pa.large_string())
        few = pa.RecordBatch.from_arrays([text], ["text"])
        for texts in slices(few):
            yield part.slice(texts.rows.start, len(texts)), texts


def _get(batch, name: str):
    return batch.column(batch.schema.get_field_index(name))


def _passages(window: int, shards: int):
    """Per slice and shard: passages with a repeated anchor, or their windows where the anchor is cut. Of
    equal ones in a slice only the smallest document's go on; the others' words are marked here."""

    def run(batches):
        import pyarrow as pa
        import zstandard

        packer = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for part, texts in _unpacked(batch.filter(_get(batch, "places").is_valid())):
                words = texts.words()
                found = Passages(words, window)
                rid, docs = _get(part, "rid").to_numpy(), _get(part, "doc_id").to_numpy()
                place = _place(found.key, shards)
                want, split = np.zeros((2, len(place)), dtype=bool)
                border = np.searchsorted(found.doc, np.arange(len(texts) + 1))
                for i, blobs in enumerate(_get(part, "places")):
                    a, b = border[i], border[i + 1]
                    if a < b:
                        have = np.frombuffer(b"".join(blobs.as_py()), dtype=np.uint64)
                        want[a:b] = np.isin(place[a:b], have & ~_CUT)
                        split[a:b] = np.isin(place[a:b] | _CUT, have)
                whole, split = np.flatnonzero(want & ~split), np.flatnonzero(split)
                if not len(whole) + len(split):
                    continue
                count = found.high[split] - found.low[split] - window + 1
                at = np.repeat(found.low[split] - np.append(0, np.cumsum(count)[:-1]), count) + np.arange(count.sum())
                low = np.concatenate([found.low[whole], at])
                high = np.concatenate([found.high[whole], at + window])
                doc = np.concatenate([found.doc[whole], np.repeat(found.doc[split], count)])
                key = np.concatenate([found.key[whole], found.windows[at]])
                raw = texts.data
                text = [b" ".join(raw[a:b].tobytes().split())
                        for a, b in zip(words.starts[low].tolist(), words.ends[high - 1].tolist())]
                own, row = docs[doc], rid[doc]
                start = low - words.first[doc]
                least: dict[bytes, int] = {}
                for t, d in zip(text, own.tolist()):
                    if d < least.get(t, d + 1):
                        least[t] = d
                sent = np.fromiter((least[t] == d for t, d in zip(text, own.tolist())), bool, len(text))
                here = ~sent
                marks = np.stack([row[here], own[here], start[here], (start + high - low)[here]], axis=1).astype(np.int64)
                index = np.flatnonzero(sent)
                home = _place(key, shards)[index] >> np.uint64(32)
                by_home = np.argsort(home, kind="stable")
                index, home = index[by_home], home[by_home]
                used = np.unique(home).tolist()
                cut = dict(zip(used, zip(np.searchsorted(home, used).tolist(), np.searchsorted(home, used, side="right").tolist())))
                fields = np.stack([key.view(np.int64), row, own, start], axis=1)
                yield pa.RecordBatch.from_arrays([
                    pa.array(used, pa.int32()),
                    pa.array([fields[index[slice(*cut[s])]].tobytes() for s in used], pa.binary()),
                    pa.array([packer.compress(b"\n".join(text[i] for i in index[slice(*cut[s])].tolist())) for s in used], pa.binary()),
                    pa.array([marks.tobytes() if s == used[0] else b"" for s in used], pa.binary()),
                ], ["shard", "fields", "texts", "marks"])

    return run


_PASSAGES = "shard int, fields binary, texts binary, marks binary"


class SuffixAutomaton:
    """The smallest automaton of all word runs of the sequences added to it."""

    def __init__(self):
        self.follow: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]

    def add(self, sequence) -> None:
        follow, link, length = self.follow, self.link, self.length
        last = 0
        for word in sequence:
            known = follow[last].get(word)
            if known is not None and length[known] == length[last] + 1:
                last = known
                continue
            fresh = len(follow)
            if known is None:
                follow.append({})
                link.append(0)
                length.append(length[last] + 1)
                p = last
                while p >= 0 and word not in follow[p]:
                    follow[p][word] = fresh
                    p = link[p]
                last = fresh
                if p < 0:
                    continue
                q = follow[p][word]
                if length[p] + 1 == length[q]:
                    link[fresh] = q
                    continue
                inner = fresh
            else:
                p, q, inner = last, known, None
            copy = len(follow)
            follow.append(dict(follow[q]))
            link.append(link[q])
            length.append(length[p] + 1)
            while p >= 0 and follow[p].get(word) == q:
                follow[p][word] = copy
                p = link[p]
            link[q] = copy
            if inner is None:
                last = copy
            else:
                link[inner] = copy

    def statistics(self, sequence):
        """For each word the length of the longest run ending with it that some sequence holds."""
        follow, link, length = self.follow, self.link, self.length
        state = run = 0
        for word in sequence:
            while state and word not in follow[state]:
                state = link[state]
                run = length[state]
            known = follow[state].get(word)
            if known is None:
                run = 0
            else:
                state = known
                run += 1
            yield run


def matched_spans(runs: list[int], window: int) -> list[tuple[int, int]]:
    """Maximal spans of words inside matches of at least ``window`` words, from matching statistics."""
    spans: list[tuple[int, int]] = []
    for i, run in enumerate(runs):
        if run >= window:
            low = i - run + 1
            if spans and low <= spans[-1][1]:
                spans[-1] = (min(low, spans[-1][0]), i + 1)
            else:
                spans.append((low, i + 1))
    return spans


def _matched(window: int):
    """(row id, marks): the spans of a shard's passages that smaller documents have too."""

    def run(table):
        import zstandard

        plain = zstandard.ZstdDecompressor()
        fields = _packed(table, "fields", np.int64).reshape(-1, 4)
        texts = [t for x in table.column("texts").combine_chunks() for t in plain.decompress(x.as_buffer()).split(b"\n")]
        marks = [_packed(table, "marks", np.int64).reshape(-1, 4)]
        found: list[tuple[int, int, int, int]] = []
        order = np.lexsort((fields[:, 3], fields[:, 2], fields[:, 0]))
        key, doc = fields[order, 0], fields[order, 2]
        start = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, int)
        for a, b in zip(start.tolist(), np.append(start[1:], len(key)).tolist()):
            group = order[a:b].tolist()
            if doc[a] == doc[b - 1]:
                continue
            automaton, known, waiting, current = SuffixAutomaton(), set(), [], None
            for i in group:
                _, row, own, at = fields[i].tolist()
                if own != current:
                    for words in waiting:
                        automaton.add(words)
                    known.update(tuple(w) for w in waiting)
                    waiting, current = [], own
                words = texts[i].split(b" ")
                if tuple(words) in known:  # a passage met before is one match
                    found.append((row, own, at, at + len(words)))
                    continue
                runs = list(automaton.statistics(words))
                found += [(row, own, at + x, at + y) for x, y in matched_spans(runs, window)]
                # Overlapping matches may cover a passage and yet not hold each of its windows.
                if runs[-1] < len(words):
                    waiting.append(words)
        if found:
            marks.append(np.array(found, dtype=np.int64))
        marks = np.concatenate(marks)
        return _grouped(marks[:, 0], np.ascontiguousarray(marks[:, 1:]), ("rid", "marks"))

    return run


def _squeeze(batches):
    """Texts travel compressed."""
    import pyarrow as pa
    import zstandard

    packer = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        for texts in slices(batch):
            packed = [packer.compress(texts.text(i)) for i in range(len(texts))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)[texts.rows], _get(batch, "rid")[texts.rows], pa.array(packed, pa.binary())],
                ["doc_id", "rid", "packed"])


def _removed(digest: bool):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part, texts in _unpacked(batch):
                words = texts.words()
                n, gone, out = [], [], []
                for i, (doc, blobs) in enumerate(zip(_get(part, "doc_id"), _get(part, "marks"))):
                    a, b = int(words.first[i]), int(words.first[i + 1])
                    keep = np.ones(b - a, dtype=bool)
                    for own, low, high in np.frombuffer(b"".join(blobs.as_py() or ()), np.int64).reshape(-1, 3).tolist():
                        if own == doc.as_py():
                            keep[low:high] = False
                    split = texts.text(i).split()
                    kept = b" ".join(split if keep.all() else [w for w, k in zip(split, keep.tolist()) if k])
                    n.append(b - a)
                    gone.append(int(b - a - keep.sum()))
                    out.append(hashlib.sha256(kept).hexdigest().encode() if digest else kept)
                yield pa.RecordBatch.from_arrays(
                    [_get(part, "doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()),
                     pa.array(out, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return run


def _sent(docs: DataFrame, window: int, many: int) -> tuple[DataFrame, DataFrame]:
    """The compressed texts, and the passages that go to the shards."""
    shards = shard_count(docs.count(), DOCS_PER_SHARD)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    own = own.withColumn("rid", F.xxhash64("doc_id", "text"))
    places = (
        own.where("doc_id is not null").mapInArrow(_anchors(window, shards), _ANCHORS)
        .groupBy("shard").applyInArrow(_repeated(many), "rid long, places binary")
        .groupBy("rid").agg(F.collect_list("places").alias("places"))
    )
    packed = own.mapInArrow(_squeeze, "doc_id long, rid long, packed binary")
    return packed, packed.join(places, "rid", "left").mapInArrow(_passages(window, shards), _PASSAGES)


def remove_repeats(docs: DataFrame, *, window: int = WINDOW, digest: bool = False, many: int = MANY) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) per row: the words left, joined by single blanks, or with
    ``digest`` the SHA-256 of that text, made where the text is so that it need not travel."""
    packed, sent = _sent(docs, window, many)
    marks = (
        sent.groupBy("shard").applyInArrow(_matched(window), "rid long, marks binary")
        .groupBy("rid").agg(F.collect_list("marks").alias("marks"))
    )
    return packed.join(marks, "rid", "left").mapInArrow(
        _removed(digest), "doc_id long, n_words long, n_removed long, kept string")


ship_functions(__name__)
