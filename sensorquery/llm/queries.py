"""The registered queries: thin calls of the operators on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorquery.llm import (
    bpe, exact_dedup, filter_audit, fingerprint, lm_score, minhash_index, ngram_join, packing, secrets, site_quality,
    substring_dedup, toxicity, whitening,
)
from sensorquery.llm.registry import documents, labels, query


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op3_bpe_chunk_reuse")
def op3(spark, folder):
    return bpe.round_trip(documents(spark, folder), vocabulary())


@query("op4_packing")
def op4(spark, folder):
    return packing.pack_documents(documents(spark, folder), vocabulary())


@query("op7_exact_dedup", sql="""
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept,
       sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
FROM documents
WINDOW g AS (PARTITION BY translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))
""")
def op7(spark, folder):
    found = exact_dedup.dedup(documents(spark, folder))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query("op10_multiset_fingerprint")
def op10(spark, folder):
    return fingerprint.compare_edits(documents(spark, folder))


@query("op6_secret_scan")
def op6(spark, folder):
    return secrets.report(documents(spark, folder))


@query("op5_ngram_jaccard", sql=r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 4
    THEN list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id
      GROUP BY 1, 2),
e AS (SELECT x, y FROM i JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 85 * (p.n + q.n - k)),
b AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT r.node, b.y FROM r JOIN b ON b.x = r.seen)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM documents LEFT JOIN n USING (doc_id)
JOIN (SELECT node AS doc_id, min(seen) AS component_id FROM r GROUP BY 1) c USING (doc_id)
""")
def op5(spark, folder):
    return ngram_join.similar_groups(documents(spark, folder), width=4, per_cent=85)


@query("op8_substring_dedup", sql=r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(ws) - 11)) AS i, ws FROM w WHERE len(ws) >= 13),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS t FROM p),
f AS (SELECT t, min(doc_id) AS first FROM g GROUP BY t HAVING min(doc_id) <> max(doc_id)),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j FROM g JOIN f USING (t) WHERE first < doc_id),
r AS (SELECT doc_id, count(*) AS n, list(j) AS js FROM c GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(n, 0) AS n_removed,
       sha256(CASE WHEN n IS NULL THEN array_to_string(ws, ' ') ELSE
         coalesce((SELECT string_agg(ws[k], ' ' ORDER BY k) FROM (SELECT unnest(range(1, len(ws) + 1)) AS k)
          WHERE NOT list_contains(js, k)), '') END) AS kept_sha256
FROM w LEFT JOIN r USING (doc_id)
""")
def op8(spark, folder):
    found = substring_dedup.remove_repeats(documents(spark, folder), digest=True)
    return found.withColumnRenamed("kept", "kept_sha256")


@query("op9_lm_score")
def op9(spark, folder):
    return lm_score.score(documents(spark, folder))


@query("op1_toxicity")
def op1(spark, folder):
    return toxicity.report(documents(spark, folder), labels(spark, folder))


@query("op2_site_quality")
def op2(spark, folder):
    docs = documents(spark, folder).select("doc_id", "text", "lang", "source")
    judged = site_quality.judge(docs, labels(spark, folder), F.col("source"), F.col("lang"))
    return judged.select(
        "doc_id", "log_odds", "site_mean", "quality", (F.col("quality") >= site_quality.LEAST_QUALITY).alias("accepted"))


@query("op11_embedding_whitening")
def op11(spark, folder):
    found = whitening.whiten(spark.read.parquet(f"{folder}/embeddings.parquet"))
    return found.withColumn("deviation", whitening.as_long("deviation"))


@query("op12_filter_audit", sql=r"""
WITH w AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
f AS (
  SELECT w.doc_id, part, len(ws) < 200 AS a, 100 * len(list_distinct(ws)) < 50 * len(ws) AS b,
         100 * (length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 3 * length(t) AS c,
         regexp_matches(t, '[#$%&*|]') AS d, doc_id > min(doc_id) OVER (PARTITION BY t) AS e
  FROM w),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
      FROM labels GROUP BY doc_id),
m AS (
  SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * coalesce(e, false)::INT AS mask, count(*) AS n,
         sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
s AS (SELECT range AS coalition FROM range(32)),
v AS (
  SELECT part, coalition, sum(n) FILTER (WHERE mask & coalition <> 0) AS n, sum(good) FILTER (WHERE mask & coalition <> 0) AS good,
         sum(toxic) FILTER (WHERE mask & coalition <> 0) AS toxic, sum(n) AS total FROM m, s GROUP BY ALL),
x AS (SELECT part, coalition, coalesce(n, 0) AS n, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, total FROM v),
i AS (SELECT range AS k FROM range(5)),
o AS (
  SELECT p.k AS k1, q.k AS k2, r.k AS k3, u.k AS k4, z.k AS k5 FROM i p, i q, i r, i u, i z
  WHERE len(list_distinct([p.k, q.k, r.k, u.k, z.k])) = 5),
g AS (
  SELECT [k1, k2, k3, k4, k5] AS ks, array_to_string([substr('ABCDE', j + 1, 1) FOR j IN [k1, k2, k3, k4, k5]], '') AS filter_order FROM o),
t AS (
  SELECT filter_order, step, ks[step] AS k, list_sum([1 << j FOR j IN ks[1:step]])::INT AS after
  FROM (SELECT *, unnest(range(1, 6)) AS step FROM g)),
d AS (
  SELECT hi.part, filter_order, step, t.k, hi.total - hi.n AS kept, hi.n - lo.n AS removed,
         one.n - (hi.n - lo.n) AS redundant, hi.good - lo.good AS good_lost, hi.toxic - lo.toxic AS toxic_lost
  FROM t JOIN x hi ON hi.coalition = t.after JOIN x lo ON lo.coalition = t.after - (1 << t.k) AND lo.part = hi.part
  JOIN x one ON one.coalition = 1 << t.k AND one.part = hi.part)
SELECT d.part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       coalesce(m.n, 0)::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       sum(removed) OVER (PARTITION BY d.part, d.k)::BIGINT AS shapley
FROM d LEFT JOIN m ON m.part = d.part AND m.mask = 1 << d.k
""")
def op12(spark, folder):
    return filter_audit.audit(documents(spark, folder), labels(spark, folder))


@query("op13_minhash_near_dedup", sql=r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 2
    THEN list_transform(range(1, len(ws)), lambda i: array_to_string(ws[i:i + 1], ' '))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id
      GROUP BY 1, 2),
e AS (SELECT x, y FROM i JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 80 * (p.n + q.n - k)),
b AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT r.node, b.y FROM r JOIN b ON b.x = r.seen)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, doc_id = c.component_id AS kept
FROM documents LEFT JOIN n USING (doc_id)
JOIN (SELECT node AS doc_id, min(seen) AS component_id FROM r GROUP BY 1) c USING (doc_id)
""")
def op13(spark, folder):
    return minhash_index.similar_documents(documents(spark, folder), width=2, per_cent=80)
