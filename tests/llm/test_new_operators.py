"""Embedding whitening, the filter audit and the MinHash index, against plain computations."""

from __future__ import annotations

import itertools
import math
import random
import re
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorquery.llm import filter_audit, linking, minhash_index, ngram_join, whitening

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# -- whitening -------------------------------------------------------------------------------


def _check_pairs(matrix, most=8):
    values, vectors = whitening.leading_pairs(matrix, most)
    want = np.linalg.eigvalsh(matrix)[::-1]
    scale = max(want[0], 1e-300)
    want = want[:most][want[:most] > 1e-12 * scale]
    assert len(values) == len(want) and np.allclose(values, want, rtol=0, atol=1e-12 * scale)
    assert np.allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-10)
    assert np.abs(matrix @ vectors - vectors * values).max(initial=0) <= 1e-11 * scale


@pytest.mark.parametrize("size, rows", [(64, 3000), (64, 6), (1, 5), (90, 500), (3, 2)])
def test_leading_pairs_equal_the_dense_solver(size, rows):
    x = np.random.default_rng(size).standard_normal((rows, size)) * np.linspace(300, 1, size)
    x -= x.mean(axis=0)
    _check_pairs(x.T @ x / rows)


@pytest.mark.parametrize("spectrum", [
    [5, 5, 5, 3, 3, 1, 1, 0.5, 0.5, 0.5], [1] * 12, [4, 4 - 1e-9, 4 - 2e-9, 1, 0.1, 0.01, 1e-3, 1e-4, 0], [7, 0, 0],
    [1e12, 1, 1e-6],
])
def test_repeated_close_and_zero_eigenvalues(spectrum):
    q, _ = np.linalg.qr(np.random.default_rng(3).standard_normal((len(spectrum), len(spectrum))))
    matrix = (q * np.array(spectrum, float)) @ q.T
    matrix = (matrix + matrix.T) / 2
    values, vectors = whitening.leading_pairs(matrix, 8)
    assert np.allclose(values, sorted(spectrum, reverse=True)[:len(values)], rtol=1e-9, atol=1e-9 * max(spectrum))
    assert np.allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-8)
    assert np.abs(matrix @ vectors - vectors * values).max() <= 1e-9 * max(spectrum)


def test_inertia_counts_with_and_without_pivots():
    rng = np.random.default_rng(1)
    for size in (1, 2, 5, 40, 70):
        a = rng.standard_normal((size, size))
        a = a + a.T
        assert whitening.inertia(a) == (np.linalg.eigvalsh(a) > 0).sum()
    hard = np.zeros((80, 80))
    hard[:40, 40:] = np.eye(40)
    hard += hard.T  # no pivot on the diagonal at all
    assert whitening.inertia(hard) == 40


def test_whitening_equals_plain_numpy(spark, small):
    table = spark.read.parquet(f"{small}/embeddings.parquet")
    got = whitening.whiten(table).toPandas()
    raw = table.toPandas()
    x = np.floor(np.array(raw["embedding"].tolist(), dtype=float) * 1024) + 100000
    n = len(x)
    centred = x - x.sum(axis=0) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1][:8], axes[:, ::-1][:, :8]
    want = dict(zip(raw["vec_id"], centred @ axes / np.sqrt(values)))
    exact = {i: sum((n * int(v) - int(s)) ** 2 for v, s in zip(row, x.sum(axis=0))) for i, row in zip(raw["vec_id"], x)}
    assert len(got) == 8 * n and (got["n"] == n).all() and got["identity_error"].max() <= 1e-9
    wide = got.pivot(index="vec_id", columns="component", values="whitened")
    for k in range(8):
        a, b = wide[k + 1].to_numpy(), np.array([want[i][k] for i in wide.index])
        assert np.allclose(a, b * np.sign((a * b).sum()), atol=1e-9)
    assert all(int(d) == exact[i] for i, d in zip(got["vec_id"], got["deviation"]))
    share = got.groupby("component")["explained"].first().to_numpy()
    assert np.allclose(share, values / np.trace(centred.T @ centred / n), rtol=1e-9)


def test_unusable_vectors_and_clashing_names(spark):
    bad = [None, [1.0, None, 2.0], [float("nan"), 0.0, 0.0], [float("inf"), 0.0, 0.0], [1e20, 0.0, 0.0], [1.0], []]
    good = [[0.1, 0.2, 0.3], [0.4, 0.1, -0.7], [0.4, 0.1, -0.7], [-0.5, 0.9, 0.0]]
    rows = [(i, v, "x", 3, 0.5) for i, v in enumerate(bad + good)] + [(None, [0.3, 0.3, 0.3], "y", 1, 0.1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, x string, component int, whitened double")
    got = whitening.whiten(df).collect()
    ids = sorted((-1 if r.vec_id is None else r.vec_id) for r in got if r.component == 1)
    assert ids == [-1, 7, 8, 9, 10] and {r.n for r in got} == {5} and max(r.component for r in got) == 3
    assert got[0].identity_error < 1e-9
    assert whitening.whiten(df.where("vec_id = 7")).count() == 0  # one vector has no variance
    assert whitening.whiten(df.where("vec_id < 5")).count() == 0
    assert whitening.whiten(df.where("vec_id > 99")).count() == 0


def test_deviations_beyond_64_bits():
    x = np.array([[1 << 49, 0], [0, 1 << 49], [5, 5]])
    sums = [int(s) for s in x.sum(axis=0)]
    n = 10**9
    assert whitening.exact_deviation(x, n, sums) == [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums)) for row in x]
    assert whitening.exact_deviation(x[:0], n, sums) == []


# -- the filter audit ------------------------------------------------------------------------


def _audit(rows, labels):
    """Every order applied to every document, nothing shared."""
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, t in labels if i is not None and t == 1}
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    docs = []
    for i, t, part in rows:
        t = t or ""
        ws = WORD.findall(t)
        fails = {
            "A": len(ws) < 200, "B": 100 * len(set(ws)) < 50 * len(ws), "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t),
            "D": any(c in "#$%&*|" for c in t), "E": i is not None and least[t] < i}
        docs.append((part or "", fails, i in good, i in toxic))
    out = {}
    for part in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [d for d in left if d[1][f]]
                left = [d for d in left if not d[1][f]]
                fail = [d for d in mine if d[1][f]]
                total[f] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), len(fail) - len(gone), sum(sum(d[1].values()) == 1 for d in fail),
                    sum(d[2] for d in gone), sum(d[3] for d in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(total[order[step - 1]])
    return out


def test_audit_equals_applying_every_order(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(400)] + ["Big", "NASA", "cash$", "a|b"]
    texts = [None, "", "  ", "AB", "x" * 50, "p & q"]
    for _ in range(60):
        pool = rng.sample(vocabulary, rng.choice([5, 60, 300]))
        texts.append(" ".join(rng.choice(pool) for _ in range(rng.choice([3, 199, 200, 320]))))
    texts.append(" ".join(rng.choice(vocabulary) for _ in range(60000)))
    rows = [(rng.randrange(90), rng.choice(texts), rng.choice(["en", "de", "", None])) for _ in range(200)]
    rows += [(None, texts[7], "en"), (None, None, None), (3, texts[7], "en"), (3, texts[7], "de")]
    labels = [(rng.randrange(90), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(70)] + [(None, 1, 1)]
    docs = spark.createDataFrame([(*r, 1, "p", 5) for r in rows], "doc_id long, text string, lang string, n int, part string, mask int")
    told = spark.createDataFrame([(*r, "z") for r in labels], "doc_id long, quality int, toxic int, lang string")
    got = filter_audit.audit(docs.repartition(4), told)
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    found = {(r.part, r.filter_order, r.step): [r[n] for n in names] for r in got.collect()}
    assert found == _audit(rows, labels)
    assert filter_audit.audit(docs.where("n = 9"), told).count() == 0
    assert filter_audit.audit(docs, told.where("lang = 'no'")).agg(F.sum("good_lost")).first()[0] == 0


def test_least_squares_give_the_shapley_values():
    rng = random.Random(4)
    for k in (2, 3, 5):
        game = [0] + [rng.randrange(1000) for _ in range((1 << k) - 1)]
        want = [Fraction(0)] * k
        for order in itertools.permutations(range(k)):
            at = 0
            for i in order:
                want[i] += Fraction(game[at | 1 << i] - game[at], math.factorial(k))
                at |= 1 << i
        assert filter_audit.shapley_values(game, k) == want


def test_a_text_in_a_third_of_the_rows_is_summed_before_it_meets(spark):
    docs = spark.range(3000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "the same").otherwise(F.concat(F.lit("t"), "id")).alias("text"),
        F.lit("en").alias("lang"))
    told = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    row = filter_audit.audit(docs, told).where("filter_order = 'EABCD' and step = 1").first()
    assert (row.removed, row.kept) == (999, 2001)


# -- the MinHash index -----------------------------------------------------------------------


def _groups(rows, width, per_cent):
    """n_shingles per row and the component of each id, by comparing all pairs."""
    sets = []
    for _, t in rows:
        ws = WORD.findall((t or "").translate(LOWER))
        sets.append({" ".join(ws[i:i + width]) for i in range(max(len(ws) - width + 1, 1))} if ws else set())
    ids = {i for i, _ in rows if i is not None}
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (x, (i, _)), (y, (j, _)) in itertools.combinations(enumerate(rows), 2):
        if i is not None and j is not None and sets[x] and sets[y]:
            both = len(sets[x] & sets[y])
            if 100 * both >= per_cent * (len(sets[x]) + len(sets[y]) - both):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return sorted(((i, len(s), None if i is None else root(i)) for (i, _), s in zip(rows, sets)), key=str)


def _found(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


def test_index_on_awkward_rows(awkward_docs, awkward, no_docs):
    for width in (2, 5):
        got = minhash_index.similar_documents(awkward_docs, width=width)
        assert _found(got) == _groups(awkward, width, 80)
        assert all(r.kept == (None if r.doc_id is None else r.doc_id == r.component_id) for r in got.collect())
    assert minhash_index.similar_documents(no_docs).count() == 0


def test_index_on_families_chains_and_strangers(spark):
    """Copies of a base, chains whose ends are far apart, families too far apart to link, repeated ids."""
    rng = random.Random(21)
    words = [f"v{i}" for i in range(3000)]
    rows = []

    def edited(text, share):
        return [rng.choice(words) if rng.random() < share else w for w in text]

    for _ in range(6):
        base = [rng.choice(words) for _ in range(rng.choice([30, 120, 400]))]
        rows += [base] + [edited(base, rng.choice([0.005, 0.02, 0.04])) for _ in range(20)]
        rows += [edited(base, 0.07) for _ in range(10)]
        for _ in range(8):
            base = edited(base, 0.02)
            rows.append(base)
    rows += [[rng.choice(words) for _ in range(rng.randrange(1, 60))] for _ in range(60)]
    ids = list(range(len(rows)))
    rng.shuffle(ids)
    table = [(i, " ".join(t)) for i, t in zip(ids, rows)]
    table += [(ids[3], " ".join(rows[-1])), (ids[-2], " ".join(rows[45]))]  # an id with two texts ties their groups
    docs = spark.createDataFrame(table, "doc_id long, text string").repartition(5)
    assert _found(minhash_index.similar_documents(docs, width=2)) == _groups(table, 2, 80)


def test_blocks_of_a_crowded_cell_lose_no_pair(spark, monkeypatch):
    rng = random.Random(5)
    words = [f"v{i}" for i in range(500)]
    base = [rng.choice(words) for _ in range(200)]
    rows = [(i, " ".join(rng.choice(words) if rng.random() < 0.06 else w for w in base)) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = _groups(rows, 2, 80)
    for block in (7, 50):
        monkeypatch.setattr(linking, "BLOCK", block)
        assert _found(minhash_index.similar_documents(docs, width=2)) == want


def test_all_pairs_within_the_distance_share_a_key():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 256, (3000, minhash_index.SYMBOLS), dtype=np.uint8)
    b = a.copy()
    for row in b:
        at = rng.choice(minhash_index.SYMBOLS, rng.integers(0, minhash_index.DISTANCE + 1), replace=False)
        row[at] ^= rng.integers(1, 256, len(at), dtype=np.uint8)
    assert (minhash_index.index_keys(a) == minhash_index.index_keys(b)).any(axis=1).all()


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(7)
    apart = []
    for _ in range(40):
        words = rng.integers(0, 10**6, 400)
        other = words.copy()
        other[rng.choice(400, 45, replace=False)] = rng.integers(10**6, 2 * 10**6, 45)
        import pyarrow as pa

        from sensorquery.llm.text import slices

        batch = pa.RecordBatch.from_arrays([pa.array([" ".join(map(str, t)) for t in (words, other)])], ["text"])
        sets = ngram_join.ShingleSets(next(iter(slices(batch))), 1)
        x, y = (set(sets.hashes[a:b].tolist()) for a, b in zip(sets.first, sets.first[1:]))
        sig = minhash_index.signatures(sets)
        apart.append((sig[0] != sig[1]).mean() - (1 - len(x & y) / len(x | y)) * 255 / 256)
    assert abs(np.mean(apart)) < 0.02 and np.max(np.abs(apart)) < 0.15
