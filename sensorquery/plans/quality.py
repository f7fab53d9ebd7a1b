"""Queries for windows over series and quality control."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorquery.operators import identity, loading, mutations, quality, series, versions
from sensorquery.plans.registry import query
from sensorquery.plans.testbed import property_id

us = F.unix_micros


def dense(t):
    """Five long series, one per event type, with missing values."""
    obs = t.observations()
    number = F.when(F.col("id") % 17 != 0, F.col("result_number"))
    return obs.withColumn("datastream_id", property_id(F.col("event_type"))).withColumn("result_number", number)


_DENSE = """
WITH s AS (SELECT id, datastream_id % 5 AS ds, event_type, phenomenon_start AS ts, result_quality,
                  CASE WHEN id % 17 <> 0 THEN result_number END AS v FROM observation)"""
_DAY = "OVER (PARTITION BY ds ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW)"
_WINDOWED = _DENSE + f""",
w AS (SELECT *, count(v) {_DAY} AS n, max(v) {_DAY} - min(v) {_DAY} AS spread, avg(v) {_DAY} AS mean,
             stddev_pop(v) {_DAY} AS dev FROM s)"""


@query("win_01_top_per_parent", """
SELECT datastream_id, id, rn FROM (SELECT datastream_id, id, row_number() OVER (
  PARTITION BY datastream_id ORDER BY result_number DESC, id) AS rn FROM observation) WHERE rn <= 5""")
def win_01(t):
    order = [F.col("result_number").desc(), F.col("id")]
    return series.top_per_key(t.observations(), ["datastream_id"], order, 5).select("datastream_id", "id", "rn")


@query("win_01_long_top_per_parent", _DENSE + """
SELECT ds AS datastream_id, id, rn FROM (SELECT ds, id, row_number() OVER (PARTITION BY ds ORDER BY ts DESC, id) AS rn FROM s)
WHERE rn <= 1500""")
def win_01_long(t):
    order = [F.col("phenomenon_start").desc(), F.col("id")]
    return series.top_per_key(dense(t), ["datastream_id"], order, 1500).select("datastream_id", "id", "rn")


@query("win_02_rolling_mean", """
WITH r AS (SELECT datastream_id % 5 AS ds, id, avg(result_number) OVER w AS m, count(*) OVER w AS n FROM observation
  WINDOW w AS (PARTITION BY datastream_id % 5 ORDER BY phenomenon_start, id ROWS BETWEEN 23 PRECEDING AND CURRENT ROW))
SELECT ds AS datastream_id, id, round(m, 6) AS rolling_mean FROM r WHERE n = 24""")
def win_02(t):
    rows = t.observations().withColumn("datastream_id", property_id(F.col("event_type")))
    return quality.rolling_mean(rows, 24).select("datastream_id", "id", F.round("rolling_mean", 6).alias("rolling_mean"))


@query("win_04_keep_first", """
SELECT l_orderkey AS datastream_id, l_linenumber, l_partkey, l_suppkey FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_extendedprice) AS rn
  FROM lineitem) WHERE rn = 1""")
def win_04(t):
    lines = t.raw("lineitem").withColumnsRenamed({"l_orderkey": "datastream_id", "l_linenumber": "phenomenon_start"})
    first = loading.dedup_first(lines, ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"])
    return first.select("datastream_id", F.col("phenomenon_start").alias("l_linenumber"), "l_partkey", "l_suppkey")


@query("win_05_neighbour_repair", """
SELECT id, CASE WHEN result_number > 60 THEN (lag(result_number) OVER w + lead(result_number) OVER w) / 2 ELSE result_number END AS repaired
FROM observation WINDOW w AS (PARTITION BY datastream_id ORDER BY phenomenon_start, id)""")
def win_05(t):
    return quality.repair_neighbours(t.observations(), F.col("result_number") > 60).select("id", "repaired")


@query("win_06_day_spread", _WINDOWED + "SELECT id, n, round(spread, 6) AS spread FROM w")
def win_06(t):
    stats = quality.with_day_statistics(dense(t))
    return stats.select("id", "n", F.round(F.col("highest") - F.col("lowest"), 6).alias("spread"))


@query("win_07_day_zscore", _WINDOWED + "SELECT id, CASE WHEN dev > 1e-6 THEN round((v - mean) / dev, 6) END AS z FROM w")
def win_07(t):
    stats = quality.with_day_statistics(dense(t)).withColumn("z", quality.zscore_of_window())
    spread = F.sqrt(F.col("m2") / F.when(F.col("n") > 0, F.col("n")))
    # Below that the deviation is rounding; such readings stay, without a score.
    return stats.select("id", F.when(spread > 1e-6, F.round("z", 6)).alias("z"))


@query("qc_01_missing", _DENSE + "SELECT id, CASE WHEN v IS NULL THEN 90 END AS flag FROM s")
def qc_01(t):
    return quality.flag_missing(dense(t)).select("id", "flag")


@query("qc_02_constant", """
WITH w AS (SELECT id, count(*) OVER d AS n, max(result_number) OVER d - min(result_number) OVER d AS spread FROM observation
  WINDOW d AS (PARTITION BY datastream_id ORDER BY phenomenon_start RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW))
SELECT id, CASE WHEN n >= 2 AND spread <= 2.005 THEN 91 END AS flag FROM w""")
def qc_02(t):
    return quality.flag_constants(t.observations(), 2.005).select("id", "flag")


@query("qc_03_zscore", _WINDOWED + "SELECT id, CASE WHEN abs((v - mean) / nullif(dev, 0)) > 3 THEN 92 END AS flag FROM w")
def qc_03(t):
    return quality.flag_zscore(dense(t)).select("id", "flag")


@query("qc_04_range", _DENSE + "SELECT id, CASE WHEN v NOT BETWEEN 1 AND 50 THEN 93 END AS flag FROM s")
def qc_04(t):
    return quality.flag_range(dense(t), 1.0, 50.0).select("id", "flag")


def by_kind(t):
    kind = F.when(F.col("event_type") == "click", "temperature").when(F.col("event_type") == "error", "humidity").when(
        F.col("event_type") == "view", "rain"
    ).otherwise("other")
    return dense(t).withColumn("kind", kind)


_FLAGGED = _WINDOWED + """,
flagged AS (SELECT id, result_quality, CASE WHEN v IS NULL THEN 90
  WHEN event_type IN ('click', 'error') AND n >= 2 AND spread <= 0.1 THEN 91
  WHEN event_type IN ('click', 'error') AND abs((v - mean) / nullif(dev, 0)) > 3 THEN 92
  WHEN event_type = 'click' AND v NOT BETWEEN -20 AND 50 THEN 93 WHEN event_type = 'error' AND v NOT BETWEEN 0 AND 100 THEN 93
  WHEN event_type = 'view' AND v NOT BETWEEN 0.2 AND 0.2 THEN 91 END AS flag FROM w)"""


@query("qc_05_chain", _FLAGGED + "SELECT id, flag FROM flagged")
def qc_05(t):
    return quality.run_qc(by_kind(t), "kind").select("id", "flag")


@query("qc_05_write_back", _FLAGGED + """,
changed AS (SELECT *, flag IS NOT NULL AND CAST(flag AS VARCHAR) <> result_quality AS hit FROM flagged)
SELECT id, 'old' AS state, result_quality, CAST(NULL AS BIGINT) AS commit_id FROM changed WHERE hit
UNION ALL SELECT id, 'current', CASE WHEN hit THEN CAST(flag AS VARCHAR) ELSE result_quality END, CASE WHEN hit THEN 5 END FROM changed""")
def qc_05_write(t):
    """Flags become a change set under one commit; a flag that is stored already opens no version."""
    obs = by_kind(t)
    stored = obs.withColumns(
        {
            "valid_from": F.lit("2024-01-01T00:00:00Z").cast("timestamp"),
            "valid_to": F.lit(None).cast("timestamp"), "commit_id": F.lit(None).cast("long"),
        }
    )
    changes = quality.flag_changes(quality.run_qc(obs, "kind"))
    hit = obs.join(changes.select("id"), "id", "left_semi")
    news = mutations.patch("observation", hit, changes).withColumn("action", F.lit("UPDATE"))
    after = versions.apply_changes("observation", stored, news, "2024-03-01T00:00:00Z", F.lit(5).cast("long"))
    state = F.when(F.col("valid_to").isNull(), "current").otherwise("old")
    return after.select("id", state.alias("state"), "result_quality", "commit_id")


_QUARTILES = """
WITH q AS (SELECT datastream_id % 5 AS ds, quantile_cont(result_number, 0.25) AS q1, quantile_cont(result_number, 0.75) AS q3
           FROM observation GROUP BY 1)"""


@query("qc_06_iqr_outliers", _QUARTILES + """
SELECT id, round(q1 - 1.5 * (q3 - q1), 9) AS low, round(q3 + 1.5 * (q3 - q1), 9) AS high FROM observation JOIN q ON q.ds = datastream_id % 5
WHERE result_number < q1 - 1.5 * (q3 - q1) OR result_number > q3 + 1.5 * (q3 - q1)""")
def qc_06(t):
    rows = t.observations().withColumn("datastream_id", property_id(F.col("event_type")))
    return quality.outliers_iqr(rows).select("id", F.round("low", 9).alias("low"), F.round("high", 9).alias("high"))


@query("qc_07_zscore_outliers", """
WITH m AS (SELECT datastream_id AS ds, avg(result_number) AS mean, stddev_pop(result_number) AS dev FROM observation GROUP BY 1)
SELECT id, round((result_number - mean) / dev, 6) AS zscore FROM observation JOIN m ON ds = datastream_id
WHERE dev > 0 AND abs((result_number - mean) / dev) > 2""")
def qc_07(t):
    return quality.outliers_zscore(t.observations(), 2.0).select("id", F.round("zscore", 6).alias("zscore"))


@query("qc_08_null_outliers", """
WITH m AS (SELECT datastream_id AS ds, avg(result_number) AS mean, stddev_samp(result_number) AS dev FROM observation GROUP BY 1)
SELECT id, CASE WHEN dev > 0 AND abs((result_number - mean) / dev) > 3 THEN NULL ELSE result_number END AS result_number
FROM observation JOIN m ON ds = datastream_id""")
def qc_08(t):
    return quality.null_outliers(t.observations()).select("id", "result_number")


@query("qc_09_split_quality", """
SELECT id, CASE WHEN result_quality = '100' AND id % 5 <> 0 AND id % 6 <> 0 THEN 'good' ELSE 'flagged' END AS part FROM observation""")
def qc_09(t):
    known = F.when(F.col("id") % 5 == 0, F.lit(None)).when(F.col("id") % 6 == 0, "unknown").otherwise(F.col("result_quality"))
    good, flagged = quality.split_quality(t.observations().withColumn("result_quality", known))
    return good.select("id", F.lit("good").alias("part")).unionByName(flagged.select("id", F.lit("flagged").alias("part")))


@query("qc_10_flatten_properties", """
SELECT id, properties->>'$.segment' AS segment, properties->>'$.nation.key' AS "nation/key" FROM thing""")
def qc_10(t):
    return quality.flatten_props(t.things(), "properties", ["segment", "nation/key"]).select("id", "segment", "nation/key")


@query("set_01_union", """
SELECT id, description FROM thing_version WHERE id % 2 = 0 UNION SELECT id, description FROM thing_version WHERE id % 3 = 0""")
def set_01(t):
    from sensorquery.catalog import Catalog

    rows = t.thing_versions().select("id", "description")
    catalog = Catalog(t.spark, {"thing": rows.where(F.col("id") % 2 == 0)}, history={"thing": rows.where(F.col("id") % 3 == 0)})
    return catalog.traveltime("thing")


@query("ids_stay_dense", "SELECT count(*) AS n, 1 AS first_id, count(*) AS last_id, count(*) AS distinct_ids FROM observation")
def ids_dense(t):
    named = identity.assign_ids(t.observations().withColumnRenamed("id", "event"), ["datastream_id", "event"])
    return named.agg(
        F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"),
        F.count_distinct("id").alias("distinct_ids"),
    )
