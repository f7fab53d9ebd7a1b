"""Toxicity scores from a factorization machine over hashed terms.

Terms are the words of a text (letters, digits and bytes above 127, A-Z lower-cased) and the first
PREFIXES bytes of longer words, hashed to BUCKETS; a document has a term or not. The value of a term
is its evidence in the labelled documents, the log ratio of its shares in toxic and other documents,
drawn towards zero where it was seen in few; weak terms have none in the linear part. The machine adds
to that part the products of all pairs of terms, weak ones too, through factor vectors, so that two
terms together can mean more, or less, than each alone. In pairs a weak term has a value of up to 1
that grows with the deviations by which its count in toxic documents is off, from CLEAR to twice
that; below, it is faint: the faint terms of a document share a sum of squares of 1, so that hundreds
of them do not drown the others. It is trained by AdaGrad on at most about SAMPLE_ROWS labelled rows.

Labels are learned from rows whose crc32(doc_id as text) mod FOLDS is not 0. Neither labels nor
language, source or id enter a score. Null and empty texts have no terms and get the score of the
bias alone; without labelled rows of both kinds the machine is only that bias. Repeated rows each
give their row; labels that disagree about one id count as toxic; a null label or id is not learned.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorquery.llm.text import _powers, mix, slices
from sensorquery.session import ship_functions

FOLDS = 5
SAMPLE_ROWS = 20_000  # expected labelled rows that are learned from, at most
BUCKETS = 1 << 17
PREFIXES = (4, 6)
FACTORS, EPOCHS, RATE, SHRINK = 4, 3, 0.05, 1e-5
LEAST_EVIDENCE, DRAWN = 1.5, 5.0
CLEAR = 3.0
_BLANK = np.ones(256, dtype=bool)
_BLANK[48:58] = _BLANK[65:91] = _BLANK[97:123] = _BLANK[128:] = False


def held_out(doc_id: Column) -> Column:
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.pmod(F.crc32(text.cast("binary")), F.lit(FOLDS)) == 0


def document_terms(texts, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of the distinct terms of a slice, only of the buckets marked in ``wanted``."""
    words = texts.lowered().words(_BLANK)
    prefix = words.texts.prefix_hash()
    _, inverse = _powers(len(words.texts.data) + 1)
    doc, length = words.doc, words.ends - words.starts
    hashed, owner = [words.hashes()], [doc]
    for n in PREFIXES:
        longer = length > n
        at = words.starts[longer]
        hashed.append(mix((prefix[at + n] - prefix[at]) * inverse[at] + np.uint64(n * 77777)))
        owner.append(doc[longer])
    bucket = (np.concatenate(hashed) % np.uint64(BUCKETS)).astype(np.int64)
    owner = np.concatenate(owner)
    if wanted is not None:
        some = wanted[bucket]
        bucket, owner = bucket[some], owner[some]
    both = np.unique(owner * BUCKETS + bucket)
    return both // BUCKETS, both % BUCKETS


def _hashed(batches):
    import pyarrow as pa

    for batch in batches:
        for texts in slices(batch):
            doc, bucket = document_terms(texts)
            cut = np.searchsorted(doc, np.arange(len(texts) + 1))
            packed = [bucket[a:b].astype(np.int32).tobytes() for a, b in zip(cut, cut[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)[texts.rows], batch.column(1)[texts.rows], pa.array(packed, pa.binary())],
                ["doc_id", "toxic", "terms"])


class Machine:
    """The terms, their evidence, linear weights and factors, and the bias; the value of each in pairs
    (its evidence if not given), and which of them are faint."""

    def __init__(self, buckets, evidence, linear, factors, bias, value=None, faint=None):
        self.buckets, self.evidence, self.linear, self.factors, self.bias = buckets, evidence, linear, factors, bias
        self.value = evidence if value is None else value
        self.faint = np.zeros(len(buckets), dtype=bool) if faint is None else faint

    def margins(self, doc: np.ndarray, bucket: np.ndarray, n: int) -> np.ndarray:
        """Log-odds of n documents from their (document, bucket) pairs, all of the machine's buckets."""
        at = np.searchsorted(self.buckets, bucket)
        out = self.bias + np.bincount(doc, weights=self.linear[at] * self.evidence[at], minlength=n)
        faint = self.faint[at]
        many = np.sqrt(np.maximum(np.bincount(doc, weights=faint, minlength=n), 1))
        x = np.where(faint, self.value[at] / many[doc], self.value[at])
        for f in range(self.factors.shape[1]):
            v = self.factors[at, f] * x
            total = np.bincount(doc, weights=v, minlength=n)
            out = out + 0.5 * (total * total - np.bincount(doc, weights=v * v, minlength=n))
        return out


def train_machine(rows: list[tuple[np.ndarray, int]], seed: int = 0) -> Machine:
    """``rows``: buckets and label of each document, in a fixed order."""
    seen = {k: np.zeros(BUCKETS) for k in (0, 1)}
    total = {0: 0, 1: 0}
    for bucket, label in rows:
        seen[label][bucket] += 1
        total[label] += 1
    rng = np.random.default_rng(seed)
    ratio = np.log((seen[1] + 0.5) / (total[1] + 1)) - np.log((seen[0] + 0.5) / (total[0] + 1))
    often = seen[0] + seen[1]
    ratio *= often / (often + DRAWN)
    ratio[np.abs(ratio) < LEAST_EVIDENCE] = 0
    if not total[0] or not total[1]:
        often[:] = 0
    buckets = np.flatnonzero(often)
    x_of = ratio[buckets]
    share, often = often[buckets] / max(len(rows), 1), often[buckets]
    spread = np.sqrt(1 + often * (1 - share) * total[1] * total[0] / max(len(rows), 1) ** 2)
    clear = np.clip(np.abs(seen[1][buckets] - share * total[1]) / spread / CLEAR - 1, 0, 1)
    value = np.where(x_of != 0, x_of, clear)
    faint = value == 0
    value[faint] = 1
    linear, factors, bias = np.full(len(buckets), 0.5), rng.standard_normal((len(buckets), FACTORS)) * 0.05, -2.0
    step_linear, step_factors, step_bias = np.full(len(buckets), 1e-2), np.full((len(buckets), FACTORS), 1e-2), 1e-2
    place = np.full(BUCKETS, -1, dtype=np.int32)
    place[buckets] = np.arange(len(buckets))
    data = []
    for bucket, label in rows:
        at = place[bucket]
        data.append((at[at >= 0], label))
    for _ in range(EPOCHS):
        for i in rng.permutation(len(data)):
            at, label = data[i]
            x = x_of[at]
            many = np.sqrt(max(np.count_nonzero(faint[at]), 1))
            y = np.where(faint[at], value[at] / many, value[at])
            v = factors[at] * y[:, None]
            total_v = v.sum(axis=0)
            z = bias + (linear[at] * x).sum() + 0.5 * ((total_v * total_v).sum() - (v * v).sum())
            error = 1 / (1 + np.exp(-min(max(z, -30.0), 30.0))) - label
            g = error * x + SHRINK * linear[at]
            step_linear[at] += g * g
            linear[at] -= RATE * g / np.sqrt(step_linear[at])
            g = error * y[:, None] * (total_v[None, :] - v) + SHRINK * factors[at]
            step_factors[at] += g * g
            factors[at] -= RATE * g / np.sqrt(step_factors[at])
            step_bias += error * error
            bias -= RATE * error / np.sqrt(step_bias)
    return Machine(buckets, x_of, linear, factors, bias, value, faint)


def _train(batches):
    """One row: the machine learned from all rows of the sample."""
    import pickle

    import pyarrow as pa

    rows = []
    for batch in batches:
        rows += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist())
    rows.sort()
    m = train_machine([(np.frombuffer(t, dtype=np.int32), y) for _, y, t in rows])
    half = [np.asarray(x, np.float32) for x in (m.evidence, m.linear, m.factors, m.value)]
    raw = pickle.dumps((m.buckets, *half[:3], m.bias, half[3], m.faint))
    yield pa.RecordBatch.from_arrays([pa.array([raw], pa.binary())], ["model"])


def learn(docs: DataFrame, labels: DataFrame, *, sample_rows: int = SAMPLE_ROWS) -> Machine:
    """Trains on labelled rows that are not held out, chosen by a hash of their id.

    The chosen labels are broadcast: their number is bounded by the parameter. Training is a single
    task over that bounded sample; the machine has at most BUCKETS terms.
    """
    import pickle

    told = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(
        "doc_id is not null and toxic is not null")
    told = told.where(~held_out(F.col("doc_id")))
    every = max(1, -(-told.count() // sample_rows))
    chosen = told.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).groupBy("doc_id").agg(
        F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = own.join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text")
    hashed = rows.mapInArrow(_hashed, "doc_id long, toxic int, terms binary")
    return Machine(*pickle.loads(hashed.repartition(1).mapInArrow(_train, "model binary").first()["model"]))


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """(doc_id, score) of every row: the probability that it is toxic."""

    def run(batches):
        import pyarrow as pa

        wanted = np.zeros(BUCKETS, dtype=bool)
        wanted[machine.buckets] = True
        for batch in batches:
            for texts in slices(batch):
                doc, bucket = document_terms(texts, wanted)
                z = np.clip(machine.margins(doc, bucket, len(texts)), -30, 30)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[texts.rows], pa.array(1 / (1 + np.exp(-z)))], ["doc_id", "score"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return own.mapInArrow(run, "doc_id long, score double")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    scored = score(docs, learn(docs, labels))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


ship_functions(__name__)
