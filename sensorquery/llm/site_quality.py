"""Quality decisions from document evidence and the sites that documents come from.

A logistic classifier over shape features of the text (symbols, capitals, repeated words, ...) gives
each document its log-odds of good quality. Sites are judged by empirical Bayes: the mean quality of
a path is drawn towards its host's, a host's towards the mean of all documents, each as strongly as
the level's means vary beyond chance (a beta-binomial prior whose strength is matched to the moments
of the observed means). What a document's path deviates from the global mean is added to its
log-odds, its own contribution taken out. Sparse sites therefore hardly count; so do sites that do
not differ.

The sums per path, host and level are partial aggregations over all documents, so a site with a
third of all rows combines in the map tasks. A null host or path is a site of its own. Null and empty
texts count as texts without words. Without labels of both kinds every document has the log-odds 0.
Repeated rows each count and each give their row. Labels are learned from at most about SAMPLE_ROWS
labelled rows; if labels of one id disagree, it counts as bad.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorquery.llm.components import written
from sensorquery.llm.text import slices
from sensorquery.session import ship_functions

SAMPLE_ROWS = 20_000
LEAST_QUALITY = 0.5  # documents below this probability are rejected
MOST_STRENGTH = 1e6  # prior documents of a level whose sites do not differ
_RIDGE = 1e-2


def _bytes_in(*ranges: tuple[int, int]) -> np.ndarray:
    flags = np.zeros(256, dtype=bool)
    for a, b in ranges:
        flags[a:b] = True
    return flags


_LETTER, _UPPER, _DIGIT = _bytes_in((65, 91), (97, 123), (128, 256)), _bytes_in((65, 91)), _bytes_in((48, 58))
_SPACE, _STOP = _bytes_in((9, 14), (32, 33)), _bytes_in((44, 45), (46, 47))


def shape_features(texts) -> np.ndarray:
    """One row per text of the slice."""
    n, offsets = len(texts), texts.offsets
    length = np.maximum(np.diff(offsets).astype(float), 1)

    def number(flags):
        total = np.concatenate([[0], np.cumsum(flags[texts.data])])
        return (total[offsets[1:]] - total[offsets[:-1]]).astype(float)

    letters, upper, digits, space, stops = map(number, (_LETTER, _UPPER, _DIGIT, _SPACE, _STOP))
    words = texts.lowered().words()
    hashed, doc, count = words.hashes(), words.doc, np.diff(words.first).astype(float)
    order = np.lexsort((hashed, doc))
    h, d = hashed[order], doc[order]
    fresh = np.ones(len(h), dtype=bool)
    fresh[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    distinct = np.bincount(d[fresh], minlength=n).astype(float)
    often = np.zeros(n)
    np.maximum.at(often, d[fresh], np.diff(np.append(np.flatnonzero(fresh), len(h))))
    again = np.zeros(len(h), dtype=bool)
    again[1:] = (hashed[1:] == hashed[:-1]) & (doc[1:] == doc[:-1])
    symbol_end = ~(_LETTER | _DIGIT | _STOP)[texts.data[words.ends - 1]]
    symbol_start = ~_LETTER[texts.data[words.starts]]
    c = np.maximum(count, 1)
    size = np.log1p(count) / 10
    return np.stack([
        (length - letters - digits - space - stops) / length, upper / np.maximum(letters, 1), digits / length,
        space / length, stops / length, distinct / c, often / c, np.bincount(doc[again], minlength=n) / c,
        np.bincount(doc, weights=words.ends - words.starts, minlength=n) / c / 10,
        np.bincount(doc[symbol_end], minlength=n) / c, np.bincount(doc[symbol_start], minlength=n) / c,
        size, size * distinct / c,
    ], axis=1)


class Classifier:
    """Logistic regression on standardised features and their squares."""

    def __init__(self, middle, spread, weights):
        self.middle, self.spread, self.weights = middle, spread, weights

    def design(self, features: np.ndarray) -> np.ndarray:
        z = np.clip((features - self.middle) / self.spread, -6, 6)
        return np.concatenate([np.ones((len(z), 1)), z, z * z], axis=1)

    def log_odds(self, texts) -> np.ndarray:
        return np.clip(self.design(shape_features(texts)) @ self.weights, -30, 30)


def fit(features: np.ndarray, good: np.ndarray) -> Classifier:
    """Newton's method with a ridge; a fixed number of steps."""
    width = features.shape[1]
    if not len(good) or good.min() == good.max():
        return Classifier(np.zeros(width), np.ones(width), np.zeros(2 * width + 1))
    out = Classifier(features.mean(axis=0), features.std(axis=0) + 1e-6, np.zeros(2 * width + 1))
    x, ridge = out.design(features), _RIDGE * len(good) / 100
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ out.weights, -30, 30)))
        gradient = x.T @ (good - p) - ridge * out.weights
        curve = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + ridge * np.eye(x.shape[1])
        out.weights = out.weights + np.linalg.solve(curve, gradient)
    return out


def _sample_features(batches):
    import pyarrow as pa

    for batch in batches:
        for texts in slices(batch):
            rows = [f.tobytes() for f in shape_features(texts)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)[texts.rows], batch.column(1)[texts.rows], pa.array(rows, pa.binary())],
                ["doc_id", "good", "features"])


def _fit(batches):
    import pickle

    import pyarrow as pa

    rows = []
    for batch in batches:
        rows += zip(*[batch.column(i).to_pylist() for i in range(3)])
    rows.sort()
    width = len(rows[0][2]) // 8 if rows else 13
    features = np.array([np.frombuffer(f) for _, _, f in rows]).reshape(-1, width)
    c = fit(features, np.array([g for _, g, _ in rows], dtype=float))
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((c.middle, c.spread, c.weights))], pa.binary())], ["model"])


def learn(docs: DataFrame, labels: DataFrame, *, sample_rows: int = SAMPLE_ROWS) -> Classifier:
    """Fits the classifier on labelled rows chosen by a hash of their id; the chosen labels are
    broadcast, their number is bounded by the parameter."""
    import pickle

    told = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("good")).where(
        "doc_id is not null and good is not null")
    every = max(1, -(-told.count() // sample_rows))
    chosen = told.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).groupBy("doc_id").agg(
        F.min((F.col("good") > 0).cast("int")).alias("good"))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = own.join(F.broadcast(chosen), "doc_id").select("doc_id", "good", "text")
    features = rows.mapInArrow(_sample_features, "doc_id long, good int, features binary")
    return Classifier(*pickle.loads(features.repartition(1).mapInArrow(_fit, "model binary").first()["model"]))


def with_log_odds(docs: DataFrame, classifier: Classifier, name: str = "log_odds") -> DataFrame:
    """The rows of ``docs`` with the classifier's log-odds."""
    place = docs.columns.index("text")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            odds = [classifier.log_odds(texts) for texts in slices(batch.select([batch.schema.names[place]]), batch.schema.names[place])]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.concatenate(odds) if odds else np.zeros(0))], [*batch.schema.names, name])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{fields}, `{name}` double")


def _strength(count: Column, mean: Column, prior_mean: Column) -> Column:
    """Prior documents of a level by the moments of its sites' means: sum of squared deviations of the
    means beyond what chance gives, each site weighted by its documents. Each site's chance follows its
    own prior mean; all are sums over sites, so the order of rows does not matter."""
    chance = prior_mean * (1 - prior_mean)
    beyond = F.sum(count * (mean - prior_mean) ** 2) - F.sum(chance)
    usual = F.sum(count * chance) / F.sum(count)
    spread = F.greatest(beyond / F.greatest(F.sum(count) - F.sum(count * count) / F.sum(count), F.lit(1.0)), F.lit(0.0))
    return F.least(F.lit(MOST_STRENGTH), usual / F.greatest(spread, usual / MOST_STRENGTH))


def site_posteriors(scored: DataFrame, host: str, path: str) -> DataFrame:
    """One row per (host, path): documents and sum of quality of the path, the posterior mean of its
    host, and both levels' prior strengths. ``scored`` has ``log_odds``."""
    p = 1 / (1 + F.exp(-F.col("log_odds")))
    paths = written(
        scored.select(F.col(host).alias("host"), F.col(path).alias("path"), p.alias("p"))
        .groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("s").alias("host_s"))
    whole = paths.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()  # one row
    mean = min(max((whole["s"] or 0.5) / (whole["n"] or 1), 1e-3), 1 - 1e-3)
    level = hosts.agg(_strength(F.col("host_n"), F.col("host_s") / F.col("host_n"), F.lit(mean)).alias("k")).first()
    host_k = level["k"] or MOST_STRENGTH
    hosts = hosts.withColumn("host_mean", (F.col("host_s") + host_k * mean) / (F.col("host_n") + host_k))
    joined = paths.join(hosts, paths["host"].eqNullSafe(hosts["host"])).drop(hosts["host"])
    level = joined.agg(_strength(F.col("n"), F.col("s") / F.col("n"), F.col("host_mean")).alias("k")).first()
    path_k = level["k"] or MOST_STRENGTH
    return written(
        joined.select("host", "path", "n", "s", "host_mean").withColumns(
            {"path_strength": F.lit(float(path_k)), "global_mean": F.lit(float(mean))}), "sites")


def _judged(docs: DataFrame, labels: DataFrame, host: Column, path: Column) -> DataFrame:
    """(row, text, log_odds, site_mean, quality): the other columns of ``docs`` travel in the struct
    ``row``, so none of their names can meet one that is made here."""
    classifier = learn(docs, labels)
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    named = docs.select(F.struct(*rest).alias("row"), host.alias("host"), path.alias("path"), "text")
    sites = site_posteriors(with_log_odds(named.select("host", "path", "text"), classifier).drop("text"), "host", "path")
    held = sites.select(F.struct(*sites.columns).alias("site"))
    scored = with_log_odds(named, classifier)
    joined = scored.join(held, F.col("host").eqNullSafe(F.col("site.host")) & F.col("path").eqNullSafe(F.col("site.path")))
    own = 1 / (1 + F.exp(-F.col("log_odds")))
    k, mean = F.col("site.path_strength"), F.col("site.global_mean")
    drawn = (F.greatest(F.col("site.s") - own, F.lit(0.0)) + k * F.col("site.host_mean")) / (F.greatest(F.col("site.n") - 1, F.lit(0)) + k)
    drawn = F.least(F.lit(1 - 1e-3), F.greatest(F.lit(1e-3), drawn))
    shift = F.log(drawn / (1 - drawn)) - F.log(mean / (1 - mean))
    quality = 1 / (1 + F.exp(-(F.col("log_odds") + shift)))
    return joined.select("row", "text", "log_odds", drawn.alias("site_mean"), quality.alias("quality"))


def _own_columns(docs: DataFrame, leave: tuple[str, ...] = ()) -> list[Column]:
    return [F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in leave]


def judge(docs: DataFrame, labels: DataFrame, host: Column, path: Column) -> DataFrame:
    """The rows of ``docs`` with ``log_odds`` (of the text), ``site_mean`` (posterior of the path without
    the document itself) and ``quality`` (probability that the document is good); these three take the
    place of columns of the same name, all others are returned as they were.

    The small table of sites is written first, so Spark knows its size when it joins.
    """
    made = ("log_odds", "site_mean", "quality")
    return _judged(docs, labels, host, path).select(*_own_columns(docs, made), *made)


def accepted(docs: DataFrame, labels: DataFrame, host: Column, path: Column, least: float = LEAST_QUALITY) -> DataFrame:
    """The rows of ``docs`` whose quality is at least ``least``, with all their columns."""
    return _judged(docs, labels, host, path).where(F.col("quality") >= least).select(*_own_columns(docs))


ship_functions(__name__)
