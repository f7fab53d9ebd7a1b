from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorquery.llm import components, exact_dedup, linking, ngram_join, substring_dedup

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_exact_copies_of_awkward_rows(awkward_docs, awkward):
    got = exact_dedup.dedup(awkward_docs).collect()
    assert len(got) == len(awkward)
    groups = defaultdict(list)
    for i, t in awkward:
        groups[hashlib.sha256((t or "").translate(LOWER).encode()).hexdigest()].append(i)
    kept = defaultdict(int)
    for r in got:
        members = groups[r.text_sha256]
        known = [m for m in members if m is not None]
        assert r.keep_id == (max(known) if known else None) and r.group_size == len(members)
        kept[r.text_sha256] += r.kept
        assert not r.kept or r.doc_id == r.keep_id
    assert set(kept.values()) == {1}


def test_collided_digests_are_parted(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    cols = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    want = sorted(map(tuple, exact_dedup.dedup(docs).select(cols).collect()))
    assert sorted(map(tuple, exact_dedup.dedup(docs, digest_bytes=1).select(cols).collect())) == want


@pytest.mark.parametrize("digest_bytes", [32, 1])
def test_state_goes_on_over_runs(spark, tmp_path, digest_bytes):
    """Copies across runs are found, the largest id stays over all runs, and with digests of one byte
    the texts of earlier runs are compared too."""
    state, every = str(tmp_path / "state"), []
    deliveries = [
        [(1, "a"), (2, "b"), (30, "c"), *[(100 + i, f"text {i}") for i in range(60)]],
        [(3, "A"), (4, "d"), (5, "C"), *[(200 + i, f"text {i}") for i in range(30, 90)]],
        [(3, "a"), (2, "B"), (6, "e"), *[(300 + i, f"other {i}") for i in range(60)]],
    ]
    for number, rows in enumerate(deliveries):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
        got = exact_dedup.dedup(docs, state=state, digest_bytes=digest_bytes).collect()
        every += [(i, number, t.translate(LOWER)) for i, t in rows]
        assert len(got) == len(rows)
        by_sha = {hashlib.sha256(t.translate(LOWER).encode()).hexdigest(): t.translate(LOWER) for _, t in rows}
        for r in got:
            group = [(i, n) for i, n, t in every if t == by_sha[r.text_sha256]]
            assert (r.keep_id, r.keep_run, r.group_size) == (*max(group), len(group))
            assert r.kept == ((r.doc_id, number) == max(group))


def test_runs_without_a_state_stand_alone(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "A")], "doc_id long, text string")
    for _ in range(2):
        assert {(r.keep_id, r.group_size) for r in exact_dedup.dedup(docs).collect()} == {(2, 2)}


def test_distinct_documents_keep_one_row_each(awkward_docs, awkward):
    rows = exact_dedup.distinct_documents(awkward_docs)
    assert rows.columns == awkward_docs.columns
    texts = [(r.text or "").translate(LOWER) for r in rows.collect()]
    assert sorted(texts) == sorted({(t or "").translate(LOWER) for _, t in awkward})


def test_empty_tables(no_docs):
    assert exact_dedup.dedup(no_docs).count() == 0
    assert ngram_join.similar_groups(no_docs).count() == 0
    assert substring_dedup.remove_repeats(no_docs).count() == 0


def test_components_by_brute_force(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(900 + i, 901 + i) for i in range(40)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame([*edges, (None, 3)], "a long, b long")
    for local in (0, 1 << 20):  # by rounds, and in one task
        assert {(r.node, r.label) for r in components.components(df, local).collect()} == {(x, root(x)) for x in parent}
    assert components.components(df.limit(0)).count() == 0


def _sets(rows, width):
    out = []
    for i, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        out.append((i, {tuple(w[k:k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()))
    return out


def _components(rows, width, per_cent):
    sets = _sets(rows, width)
    parent = {i: i for i, _ in sets if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[n + 1:]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= per_cent * len(a | b):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return sorted(((i, len(a), None if i is None else root(i)) for i, a in sets), key=str)


def _near_copies(seed, groups, most):
    rng = random.Random(seed)
    rows = []
    for g in range(groups):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(4, 120))]
        for _ in range(rng.randint(1, most)):
            w = list(words)
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                w[rng.randrange(len(w))] = f"e{rng.randrange(100000)}"
            rows.append((len(rows), " ".join(w)))
    return rows


def test_groups_of_awkward_rows(awkward_docs, awkward):
    for width, per_cent in ((5, 80), (4, 85)):
        got = ngram_join.similar_groups(awkward_docs, width=width, per_cent=per_cent).collect()
        assert sorted(map(tuple, got), key=str) == _components(awkward, width, per_cent)


def test_groups_of_near_copies_lose_no_link(spark, monkeypatch):
    # Groups in which many members are linked to others but not to the smallest; tiny blocks.
    monkeypatch.setattr(linking, "BLOCK", 4)
    rows = _near_copies(4, 25, 25)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted(map(tuple, ngram_join.similar_groups(docs, width=4, per_cent=85).collect()), key=str)
    assert got == _components(rows, 4, 85)


def test_linked_sets_share_a_key():
    from sensorquery.llm.text import Texts

    rng = random.Random(8)
    for _ in range(60):
        n = rng.randint(4, 400)
        words = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        other = list(words)
        for _ in range(rng.randint(0, max(1, n // 40))):
            other[rng.randrange(n)] = f"e{rng.randrange(10**6)}"
        texts = [" ".join(w).encode() for w in (words, other)]
        data = np.frombuffer(b"".join(texts), np.uint8)
        sets = ngram_join.ShingleSets(Texts(data, np.cumsum([0, *map(len, texts)]), slice(0, 2)), 4)
        a, b = (set(sets.hashes[sets.doc == i].tolist()) for i in (0, 1))
        keys, who = ngram_join.block_keys(sets, np.ones(2, bool), 85)
        if 100 * len(a & b) >= 85 * len(a | b):
            assert set(keys[who == 0].tolist()) & set(keys[who == 1].tolist())


def test_passages_that_many_share_make_no_cells(spark, monkeypatch):
    rng = random.Random(12)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    common, stars = fresh(60), []
    rows = [(i, " ".join(common + fresh(300))) for i in range(60)]
    rows += [(100 + i, text + " " + " ".join(fresh(10 + i))) for i, text in rows[:20]]
    known = linking.starred
    monkeypatch.setattr(linking, "starred", lambda entries: stars.append(known(entries)) or stars[-1])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.similar_groups(docs, width=5, per_cent=80).collect()}
    assert got == {i: i - 100 if i >= 100 else i for i, _ in rows}
    assert stars[0].count() <= 60  # the cells of 80 documents around one hub, or several, hold more


def test_linked_sets_share_a_kept_key():
    from sensorquery.llm.text import Texts

    rng = random.Random(9)
    for _ in range(60):
        n = rng.randint(4, 1500)
        words = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        other = list(words)
        for _ in range(rng.randint(0, max(1, n // 40))):
            other[rng.randrange(n)] = f"e{rng.randrange(10**6)}"
        texts = [" ".join(w).encode() for w in (words, other)]
        data = np.frombuffer(b"".join(texts), np.uint8)
        sets = ngram_join.ShingleSets(Texts(data, np.cumsum([0, *map(len, texts)]), slice(0, 2)), 5)
        a, b = (set(sets.hashes[sets.doc == i].tolist()) for i in (0, 1))
        if 100 * len(a & b) < 80 * len(a | b):
            continue
        keys, who = ngram_join.block_keys(sets, np.ones(2, bool), 80)
        both = set(keys[who == 0].tolist()) & set(keys[who == 1].tolist())
        # The worst case: every shared key is in more documents than those of one text alone.
        kept = [set(), set()]
        for odd, spare in enumerate(ngram_join.spare_keys(sets, 80)):
            for i in (0, 1):
                own = sorted((k not in both, k) for k in keys[who == i].tolist() if k % 2 == odd)
                kept[i] |= {k for _, k in own[int(spare[i]):]}
        assert kept[0] & kept[1]


def test_tree_finds_all_that_may_link():
    rng = np.random.default_rng(1)
    vectors = rng.poisson(3, (200, ngram_join.DIMENSIONS)).astype(np.int64)
    vectors[100:] = np.maximum(vectors[:100] + rng.integers(-1, 2, (100, ngram_join.DIMENSIONS)), 0)
    sizes = vectors.sum(axis=1)
    tree = ngram_join.CountTree(vectors, sizes)
    for i in range(200):
        fit = (np.minimum(sizes, sizes[i]) * 100 >= 80 * np.maximum(sizes, sizes[i]))
        want = np.flatnonzero(fit & (np.minimum(vectors, vectors[i]).sum(axis=1) * 180 >= 80 * (sizes + sizes[i])))
        assert sorted(tree.search(vectors[i], int(sizes[i]), 80).tolist()) == want.tolist()


def test_tree_has_levels_and_leaves_boxes_out():
    rng = np.random.default_rng(2)
    size = np.repeat(np.arange(100, 4100, 100), 100)
    vectors = np.array([rng.multinomial(n, np.full(ngram_join.DIMENSIONS, 1 / ngram_join.DIMENSIONS)) for n in size])
    tree = ngram_join.CountTree(vectors, vectors.sum(axis=1))
    assert [len(least) for _, least, _ in tree.levels] == [4000, 250, 16, 1]
    tree.search(vectors[2000], int(size[2000]), 80)
    assert tree.visited < 1500  # of 4,267 points and boxes


def test_repeated_ids_keep_the_links_of_all_their_texts(spark):
    rng = random.Random(6)
    a, b = (" ".join(f"w{rng.randrange(9000)}" for _ in range(60)) for _ in range(2))
    rows = [(3, a), (5, a), (5, b), (9, b + " end"), (11, "alone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.component_id) for r in ngram_join.similar_groups(docs).collect())
    assert got == [(3, 3), (5, 3), (5, 3), (9, 3), (11, 11)]


def test_links_of_the_query_come_out_of_the_trees(spark, small, monkeypatch):
    """With trees that find nothing the registered query has no link between different texts."""
    from sensorquery.llm import registry

    def links():
        rows = registry.queries()["op5_ngram_jaccard"](spark, small).collect()
        return {r.doc_id for r in rows if r.doc_id != r.component_id}

    def blind(per_cent):
        return lambda size, packed: lambda i, wanted: np.zeros(0, dtype=np.int64)

    found = links()
    monkeypatch.setattr(ngram_join, "through_tree", blind)
    equal_only = links()
    assert len(found) > len(equal_only)
    docs = {r.doc_id: r.text for r in registry.documents(spark, small).collect()}
    words = {i: tuple(WORD.findall((t or "").translate(LOWER))) for i, t in docs.items()}
    texts = list(words.values())
    assert all(texts.count(words[i]) > 1 for i in equal_only)


def test_bound_is_never_below_the_overlap():
    from sensorquery.llm.text import Texts

    rng = random.Random(3)
    for n in (5, 60, 700, 6000):
        words = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        other = words[:n - n // 20] + [f"e{i}" for i in range(n // 3)]
        texts = [" ".join(w).encode() for w in (words, other)]
        sets = ngram_join.ShingleSets(
            Texts(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]), slice(0, 2)), 4)
        x, y = ngram_join.vectors(sets)
        length = min(len(x), len(y))
        both = len(np.intersect1d(sets.hashes[sets.doc == 0], sets.hashes[sets.doc == 1]))
        bound = np.minimum(*(ngram_join.counts(v, int(s), length) for v, s in zip((x, y), sets.size))).sum()
        assert bound >= both
        assert sum(ngram_join.counts(x, int(sets.size[0]))) >= sets.size[0]


def test_one_of_each_group_keeps_the_columns(awkward_docs):
    rows = ngram_join.one_of_each_group(awkward_docs)
    assert rows.columns == awkward_docs.columns
    ids = [r.doc_id for r in rows.select("doc_id").collect()]
    assert 1 in ids and not {2, 3, 14} & set(ids) and ids.count(None) == 2


def _repeats(rows, window):
    out = []
    for i, t in rows:
        w = WORD.findall(t or "")
        smaller = {tuple(v[k:k + window]) for j, s in rows if i is not None and j is not None and j < i
                   for v in [WORD.findall(s or "")] for k in range(len(v) - window + 1)}
        gone = set()
        for k in range(len(w) - window + 1):
            if tuple(w[k:k + window]) in smaller:
                gone |= set(range(k, k + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


def test_repeated_passages_of_awkward_rows(awkward_docs, awkward):
    assert sorted(map(tuple, substring_dedup.remove_repeats(awkward_docs).collect()), key=str) == _repeats(awkward, 13)


def test_repeated_passages_by_brute_force(spark):
    rng = random.Random(6)
    passages = [[f"p{rng.randrange(30)}" for _ in range(rng.randint(8, 40))] for _ in range(6)]
    rows = []
    for i in range(60):
        w = [f"u{rng.randrange(9)}" for _ in range(rng.randint(0, 12))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            w += p[a:a + rng.randint(3, 40)] + [f"u{rng.randrange(500)}"]
        rows.append((i, rng.choice([" ", "\n", "  "]).join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert sorted(map(tuple, substring_dedup.remove_repeats(docs).collect()), key=str) == _repeats(rows, 13)


def test_matches_that_overlap_do_not_hold_every_window(spark):
    rows = []
    for k in range(80):  # in some of these the passages have one anchor, words 7 to 10
        p = [f"k{k}x{j}" for j in range(20)]
        parts = (p[:14], p[7:], p, [f"u{k}", *p[3:17], f"v{k}"])
        rows += [(4 * k + n, " ".join(w)) for n, w in enumerate(parts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert sorted(map(tuple, substring_dedup.remove_repeats(docs).collect()), key=str) == _repeats(rows, 13)


@pytest.mark.parametrize("many", [0, 3])
def test_anchors_cut_into_windows_by_brute_force(spark, awkward_docs, awkward, many):
    rng = random.Random(8)
    line = [f"l{j}" for j in range(20)]
    rows = []
    for i in range(90):
        w = [f"u{rng.randrange(40)}" for _ in range(rng.randint(0, 12))]
        for _ in range(rng.randint(0, 3)):
            a = rng.randrange(8)
            w += line[a:a + rng.randint(6, 20)] + [f"u{rng.randrange(40)}" for _ in range(rng.randint(1, 3))]
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert sorted(map(tuple, substring_dedup.remove_repeats(docs, many=many).collect()), key=str) == _repeats(rows, 13)
    got = substring_dedup.remove_repeats(awkward_docs, many=many)
    assert sorted(map(tuple, got.collect()), key=str) == _repeats(awkward, 13)


def test_no_automaton_holds_a_common_line_in_all_surroundings(spark):
    rows = [(i, " ".join([*(f"a{i}x{j}" for j in range(12)), *(f"l{j}" for j in range(13)), *(f"b{i}x{j}" for j in range(12))]))
            for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    _, sent = substring_dedup._sent(docs, 13, substring_dedup.MANY)
    held = Counter(k for r in sent.select("fields").collect() for k in np.frombuffer(r.fields, np.int64).reshape(-1, 4)[:, 0].tolist())
    assert max(held.values()) <= substring_dedup.MANY
    done = substring_dedup.remove_repeats(docs).where("doc_id > 0").agg(F.min("n_removed"), F.max("n_removed")).first()
    assert tuple(done) == (13, 13)


def test_digest_form_equals_the_text_form(awkward_docs):
    texts = substring_dedup.remove_repeats(awkward_docs).withColumn("kept", F.sha2(F.col("kept").cast("binary"), 256))
    digests = substring_dedup.remove_repeats(awkward_docs, digest=True)
    assert sorted(map(tuple, texts.collect()), key=str) == sorted(map(tuple, digests.collect()), key=str)


def test_automaton_statistics_by_brute_force():
    rng = random.Random(9)
    for _ in range(150):
        automaton, known = substring_dedup.SuffixAutomaton(), []
        for _ in range(rng.randint(0, 5)):
            known.append([rng.choice("abc") for _ in range(rng.randint(0, 12))])
            automaton.add(known[-1])
        query = [rng.choice("abcd") for _ in range(15)]
        runs = {tuple(k[i:j]) for k in known for i in range(len(k)) for j in range(i + 1, len(k) + 1)}
        want = [max((n for n in range(1, i + 2) if tuple(query[i + 1 - n:i + 1]) in runs), default=0) for i in range(15)]
        assert list(automaton.statistics(query)) == want
