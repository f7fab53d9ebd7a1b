from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorquery.llm import fingerprint, lm_score, secrets, site_quality, toxicity

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# -- language model ----------------------------------------------------------------------------


def _tokens(text):
    return [*WORD.findall((text or "").translate(LOWER)), None]


def test_base_scores_by_brute_force(awkward_docs, awkward):
    got = lm_score.score(awkward_docs, filter_bits=1 << 20).collect()
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0
    counts = Counter()
    for i, t in awkward:
        if not held(i):
            counts.update(_tokens(t))
    total, kinds = sum(counts.values()), len(counts)
    want = []
    for i, t in awkward:
        w = _tokens(t)
        base = sum(math.log10((counts[x] + 0.1) / (total + 0.1 * (kinds + 1))) for x in w)
        want.append((str(i), held(i), len(w), sum(counts[x] > 0 for x in w), total, round(base, 6)))
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == sorted(want)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_filter_returns_quantised_counts():
    rng = np.random.default_rng(2)
    pair = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    count = np.where(rng.random(4000) < 0.5, 1, rng.integers(2, 5000, 4000))
    shards, bits = 16, 1 << 16
    shard, key = (pair >> np.uint64(32)) % np.uint64(shards), pair & np.uint64(0xFFFFFFFF)
    raw = b"".join(lm_score.filter_segment(key[shard == s], count[shard == s], bits) for s in range(shards))
    read = lm_score.BloomCounts(raw, shards, bits).counts(pair)
    seen = count >= 2
    assert (read[seen] >= count[seen] / 1.5).all()  # never too low by more than a level
    assert (read[seen] <= count[seen] * 1.5).mean() > 0.95 and (read[~seen] == 0).mean() > 0.9


def test_pairs_help_on_held_out_copies(spark, small):
    rows = lm_score.score(spark.read.parquet(f"{small}/documents.parquet"), filter_bits=1 << 24).where("held_out")
    both = rows.agg(F.sum("score"), F.sum("base_score")).first()
    assert both[0] > both[1]


def test_scores_follow_exact_pair_counts_whatever_the_filter(spark):
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choice(words, 30))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    single, pairs = Counter(), Counter()
    for i, t in rows:
        if not held(i):
            w = _tokens(t)
            single.update(w)
            single["begin"] += 1
            pairs.update(zip(["begin", *w], w))
    total, kinds = sum(n for w, n in single.items() if w != "begin"), len(single) - 1

    def p(v, w, level):
        c = (1.5 ** (level - 1) + 1.5 ** level) / 2 if level else 0.0
        c = min(c, single[v], single[w])
        return math.log10(0.2 * c / single[v] + 0.8 * (single[w] + 0.1) / (total + 0.1 * (kinds + 1)))

    level = lambda n: 1 + math.floor(math.log(n) / math.log(1.5) + 1e-9) if n else 0
    got = {r.doc_id: r.score for r in lm_score.score(docs, filter_bits=1 << 10).collect()}
    near = 0
    for i, t in rows:
        w = _tokens(t)
        near += abs(got[i] - sum(p(v, x, level(pairs[v, x])) for v, x in zip(["begin", *w], w))) < 1e-6
    assert near >= 0.8 * len(rows)  # a miss passes a level once in 256 probes


def test_segments_grow_with_the_pairs():
    rng = np.random.default_rng(7)
    for n in (1000, 300_000):
        key, count = np.unique(rng.integers(0, 1 << 32, n, dtype=np.uint64)), rng.integers(1, 30, n)
        count = count[:len(key)]
        bits = lm_score.sized_segment(count)
        raw = lm_score.filter_segment(key, count, bits, least=1)
        assert np.unpackbits(np.frombuffer(raw, np.uint8)).mean() < 0.27
        read = lm_score.BloomCounts(raw, 1, bits)
        assert (read.levels(key) == lm_score._levels(count)).mean() > 0.98
        assert (read.levels(rng.integers(0, 1 << 32, 5000, dtype=np.uint64)) == 0).mean() > 0.98


def test_no_document_is_lost_when_scans_differ(spark):
    def dealt_anew(batches):  # as after a shuffle: every scan sees another order of rows
        import random

        import pyarrow as pa

        rows = [r for b in batches for r in b.to_pylist()]
        random.SystemRandom().shuffle(rows)
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("doc_id", pa.int64()), ("text", pa.string())]))

    rows = [(i, f"word{i} and word{i % 7}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").mapInArrow(dealt_anew, "doc_id long, text string")
    assert sorted(r.doc_id for r in lm_score.score(docs).select("doc_id").collect()) == list(range(300))


# -- secrets -------------------------------------------------------------------------------------

ASSIGN = re.compile(r"((?ai:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]+")


def _base(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m.group()) >= 20]
    return sorted(out + [(m.start(), 2, m.end()) for m in HEX.finditer(text) if len(m.group()) >= 24])


TRICKY = [
    "secret: token: abcdefgh", "api-key=abcdef apikey=abcdef API_KEY = \"abcdef\"", "token==abcdef", "é token=abcdef 日 token=abcde",
    "AKIAAKIA" + "A" * 12 + " xAKIA" + "B" * 15, "f" * 24 + "g" + "f" * 23, "password:'" + "a1" * 15 + "'" + "password=xyz123",
    "token=" + "0" * 30, "a token = \nabcdef", None, "",
]


@pytest.fixture(scope="module")
def model(spark, small):
    return secrets.train(spark.read.parquet(f"{small}/documents.parquet"))


def test_base_spans_by_brute_force(spark, awkward, model):
    rows = [*awkward, *enumerate(TRICKY, 100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("base", F.lit(1)).drop("base")
    got = sorted((str(r.doc_id), r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in secrets.report(docs).collect())
    want = []
    for i, t in rows:
        spans = _base(t or "")
        joined = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        kinds = [sum(k == n for _, k, _ in spans) for n in range(3)]
        want.append((str(i), *kinds, hashlib.sha256(joined.encode()).hexdigest()))
    assert got == sorted(want)


def test_models_tell_random_strings_from_words(spark, model):
    rng = np.random.default_rng(3)
    letters = list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
    random = ["".join(rng.choice(letters, 32)) for _ in range(40)]
    words = ["thewhntouesorinerononha", "ofthtioninorononanthreti", "un_long_identifier_of_words", "ciónquellaentedelaración"]
    docs = spark.createDataFrame(list(enumerate(random + words)), "doc_id long, text string")
    spans = {r.doc_id: r.n for r in secrets.scan(docs, model).select("doc_id", F.size("spans").alias("n")).collect()}
    assert sum(spans[i] for i in range(40)) >= 36 and not any(spans[i] for i in range(40, 44))


def test_redaction_masks_every_span(spark, model):
    text = "a password=abcdefgh b " + "0f" * 16 + " é AKIA" + "Q" * 20 + " end"
    docs = spark.createDataFrame([(1, text, 5), (2, None, 5), (3, "clean text", 10)], "doc_id long, text string, n_chars long")
    rows = {r.doc_id: r for r in secrets.redact(docs).collect()}
    assert rows[1].text == "a [SECRET] b [SECRET] é [SECRET] end" and rows[1].n_chars == len(rows[1].text)
    assert rows[2].text is None and (rows[3].text, rows[3].n_chars) == ("clean text", 10)


# -- fingerprints --------------------------------------------------------------------------------


def test_edits_and_order_by_brute_force(awkward_docs, awkward):
    got = fingerprint.compare_edits(awkward_docs).collect()
    assert len(got) == len(awkward)
    distinct = sorted({(i, t or "") for i, t in awkward if i is not None}, key=lambda x: -x[0])
    by_id = {}
    for i, t in distinct:
        by_id.setdefault(i, []).append(t)
    single = [i for i in by_id if len(by_id[i]) == 1]
    ids = sorted(by_id, reverse=True)
    rows = {(r.doc_id, r.n_chars): r for r in got}
    for i, j in zip(ids, ids[1:]):
        if i in single and j in single:
            t, u = by_id[i][0], by_id[j][0]
            edited = t[:len(t) - len(t) // 2] + u[:len(t) // 2]
            assert rows[i, len(t)].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest(), i
    prints = {}
    for r, n in ((r, r.n_chars) for r in got):
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    for i, t in awkward:
        if i in single:
            prints.setdefault(t or "", set()).add(rows[i, len(t or "")].fingerprint)
    assert all(len(p) == 1 for p in prints.values()) and len({min(p) for p in prints.values()}) == len(prints)


def test_fingerprints_are_sums_of_paragraphs(spark):
    rows = [(1, "one two\nthree four\nfive"), (2, "five\none two\nthree four"), (3, "five"), (4, "one two\nthree four"), (5, "")]
    docs = spark.createDataFrame(rows, "k long, text string")
    p = {r.k: r for r in fingerprint.fingerprints(docs, ["k"]).collect()}
    assert (p[1].exact, p[1].signs) == (p[2].exact, p[2].signs)
    assert [(a + b) % 2**32 for a, b in zip(p[3].exact, p[4].exact)] == p[1].exact
    assert [(a + b) % 2**16 for a, b in zip(p[3].signs, p[4].signs)] == p[1].signs
    both = fingerprint.fingerprints(docs, ["k"]).where("k = 1").select(
        fingerprint.combine(F.col("exact"), F.array(*map(F.lit, p[3].exact)), 32, -1).alias("e")).first()
    assert both.e == p[4].exact
    again = spark.createDataFrame(rows + [rows[0]] * 2, "k long, text string")
    q = {r.k: r for r in fingerprint.fingerprints(again, ["k"]).collect()}
    assert q[1].signs == p[1].signs and q[1].exact == p[1].exact


def test_likeness_follows_the_shared_part(spark, small):
    rows = fingerprint.compare_edits(spark.read.parquet(f"{small}/documents.parquet")).where("n_chars > 400").collect()
    assert np.mean([r.near_edited for r in rows]) > 0.35 and np.mean([r.near_next for r in rows]) < 0.2


def test_native_operators_run_no_python(awkward_docs, model):
    for df in (secrets.scan(awkward_docs, model), fingerprint.fingerprints(fingerprint._keyed(awkward_docs), ["k1", "k2"])):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# -- classifiers ---------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def labelled(spark):
    folder = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")


def test_toxicity_on_held_out_rows(labelled):
    docs, labels = labelled
    rows = toxicity.report(docs, labels).join(labels, "doc_id").collect()
    clean = [r for r in rows if not r.toxic]
    toxic = [r for r in rows if r.toxic]
    assert sum(r.predicted for r in clean) <= 0.02 * len(clean)
    assert sum(r.predicted for r in toxic) >= 0.6 * len(toxic)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


def test_pairs_of_terms_can_mean_more_than_each(monkeypatch):
    # Toxic only where both terms meet: no linear weights can say that and stay below zero for each.
    monkeypatch.setattr(toxicity, "LEAST_EVIDENCE", 0.1)
    monkeypatch.setattr(toxicity, "EPOCHS", 30)
    rng = np.random.default_rng(0)
    rows = [
        (np.array([1] * bool(a) + [2] * bool(b) + [3], dtype=np.int64), int(a and b))
        for a, b in rng.random((1200, 2)) < 0.5
    ]
    m = toxicity.train_machine(rows)
    assert {1, 2} <= set(m.buckets.tolist())
    doc, bucket = np.array([0, 1, 2, 2]), np.array([1, 2, 1, 2])
    one, two, both = m.margins(doc, bucket, 3)
    assert both > 0 > max(one, two)


def test_pairs_of_weak_terms_with_the_production_parameters():
    rng = np.random.default_rng(0)
    rows = [
        (np.array([1] * bool(a) + [2] * bool(b) + [3], dtype=np.int64), int(a and b))
        for a, b in rng.random((1200, 2)) < 0.5
    ]
    m = toxicity.train_machine(rows)
    doc, bucket = np.array([0, 0, 1, 1, 2, 2, 2]), np.array([1, 3, 2, 3, 1, 2, 3])
    one, two, both = m.margins(doc, bucket, 3)
    assert both > 0 > max(one, two)


def test_pairs_of_weak_terms_among_common_words():
    # Texts of a hundred words; toxic where two terms meet that are often alone in clean texts.
    rng = np.random.default_rng(1)
    rows, sides = [], []
    for _ in range(6000):
        a, b = rng.random(2) < 0.3
        words = rng.zipf(1.3, 100) % 20_000 + 10
        rows.append((np.unique(np.concatenate([words, np.array([1] * int(a) + [2] * int(b), dtype=np.int64)])), int(a and b)))
        sides.append((a, b))
    m = toxicity.train_machine(rows[:4500])
    known = [b[np.isin(b, m.buckets)] for b, _ in rows[4500:]]
    z = m.margins(np.repeat(np.arange(len(known)), list(map(len, known))), np.concatenate(known), len(known))
    both = np.array([y for _, y in rows[4500:]]) == 1
    assert (z[both] > 0).mean() > 0.8 and (z[~both] > 0).mean() < 0.05


def test_margins_equal_the_sum_over_pairs():
    rng = np.random.default_rng(4)
    m = toxicity.Machine(np.arange(9), rng.random(9), rng.random(9), rng.random((9, 4)), -1.0)
    terms = [1, 4, 7]
    want = -1 + sum(m.linear[i] * m.evidence[i] for i in terms)
    want += sum(m.factors[i] @ m.factors[j] * m.evidence[i] * m.evidence[j] for i in terms for j in terms if i < j)
    assert m.margins(np.zeros(3, int), np.array(terms), 1)[0] == pytest.approx(want)


def test_classifiers_on_awkward_rows(spark, awkward_docs, awkward, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (5, 0, 0), (None, 1, 1), (99, 1, 1), (9, 1, None), (10, None, 0)],
                                   "doc_id long, quality int, toxic int")
    for told in (labels, labels.limit(0)):
        rows = toxicity.report(awkward_docs, told).collect()
        assert len(rows) == len(awkward) and all(0 <= r.score <= 1 for r in rows)
        judged = site_quality.judge(awkward_docs, told, F.col("source"), F.col("lang"))
        made = ["log_odds", "site_mean", "quality"]
        assert judged.columns == [*[c for c in awkward_docs.columns if c not in made], *made]
        assert judged.count() == len(awkward) and judged.where("quality is null").count() == 0
    assert toxicity.report(no_docs, labels).count() == 0
    assert site_quality.judge(no_docs, labels, F.col("source"), F.col("lang")).count() == 0


def test_quality_on_the_labelled_rows(labelled):
    docs, labels = labelled
    told = labels.select("doc_id", F.col("quality").alias("good"))
    rows = site_quality.judge(docs, labels, F.col("source"), F.col("lang")).join(told, "doc_id").collect()
    assert not [r.doc_id for r in rows if r.good and r.quality < 0.5]
    assert sum((r.quality >= 0.5) == bool(r.good) for r in rows) >= 0.97 * len(rows)


def test_sites_that_differ_move_their_documents(spark):
    rows = [(h, p, o) for h, p, good, n in (("a", "x", 3.0, 400), ("a", "y", 2.5, 300), ("b", "x", -3.0, 400), ("b", "z", -2.0, 5),
                                            (None, None, 0.0, 3)) for o in [good] * n]
    scored = spark.createDataFrame(rows, "host string, path string, log_odds double")
    sites = {(r.host, r.path): r for r in site_quality.site_posteriors(scored, "host", "path").collect()}
    assert len(sites) == 5
    assert sites["a", "x"].host_mean > 0.9 and sites["b", "x"].host_mean < 0.1
    assert sites["b", "x"].path_strength > 0
    # Three documents of a site without evidence stay nearer to the global mean than 400 do.
    alone = sites[None, None]
    assert abs(alone.host_mean - alone.global_mean) < abs(sites["a", "x"].host_mean - alone.global_mean)


def test_sites_by_brute_force_in_any_order(spark):
    """Both levels of the hierarchy, computed plainly; the order of rows does not matter."""
    rng = np.random.default_rng(12)
    rows = []
    for h in range(6):
        for p in range(int(rng.integers(1, 5))):
            for _ in range(int(rng.integers(1, 30))):
                rows.append((f"h{h}" if h else None, f"p{p}" if p else None, float(rng.normal(h / 3 - 1 + p / 4, 1))))

    def strength(count, mean, prior):
        chance = prior * (1 - prior)
        beyond = (count * (mean - prior) ** 2).sum() - chance.sum()
        usual = (count * chance).sum() / count.sum()
        spread = max(beyond / max(count.sum() - (count ** 2).sum() / count.sum(), 1), 0)
        return min(site_quality.MOST_STRENGTH, usual / max(spread, usual / site_quality.MOST_STRENGTH))

    paths, hosts = {}, {}
    for h, p, x in rows:
        q = 1 / (1 + math.exp(-x))
        for held, key in ((paths, (h, p)), (hosts, h)):
            n, s = held.get(key, (0, 0.0))
            held[key] = (n + 1, s + q)
    total = sum(n for n, _ in hosts.values())
    mean = min(max(sum(s for _, s in hosts.values()) / total, 1e-3), 1 - 1e-3)
    count, sums = (np.array(x, dtype=float) for x in zip(*hosts.values()))
    k = strength(count, sums / count, np.full(len(count), mean))
    host_mean = {h: (s + k * mean) / (n + k) for h, (n, s) in hosts.items()}
    count, sums = (np.array(x, dtype=float) for x in zip(*paths.values()))
    path_k = strength(count, sums / count, np.array([host_mean[h] for h, _ in paths]))
    for seed in range(3):
        dealt = [rows[i] for i in np.random.default_rng(seed).permutation(len(rows))]
        df = spark.createDataFrame(dealt, "a string, b string, log_odds double").repartition(seed + 1)
        got = {(r.host, r.path): r for r in site_quality.site_posteriors(df, "a", "b").collect()}
        assert set(got) == set(paths)
        for key, r in got.items():
            assert (r.n, r.s) == (paths[key][0], pytest.approx(paths[key][1]))
            assert r.host_mean == pytest.approx(host_mean[key[0]], rel=1e-9)
            assert (r.path_strength, r.global_mean) == (pytest.approx(path_k, rel=1e-9), pytest.approx(mean))
