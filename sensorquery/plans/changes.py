"""Queries for derived state, versions and changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorquery.functions import predicates as P
from sensorquery.functions import values
from sensorquery.operators import summaries
from sensorquery.operators import identity, loading, maintain, mutations, versions
from sensorquery.operators.query import Query
from sensorquery.plans.registry import query
from sensorquery.sources.documents import bulk_insert, deep_insert, flatten_documents
from sensorquery.session import scratch_path

us = F.unix_micros
CHANGE_TIME = "2002-01-01T00:00:00Z"
MOVE_TIME = "2024-02-01T00:00:00Z"


def extent_columns():
    return [us(c).alias(c) for c in maintain.EXTENT_COLUMNS]


def bare_streams(t):
    """Datastreams without stored extents."""
    empty = {c: F.lit(None).cast("timestamp") for c in maintain.EXTENT_COLUMNS}
    return t.datastreams().withColumns(empty)


def extent_sql(where: str) -> str:
    return f"""
SELECT d.id, epoch_us(min(o.phenomenon_start)) AS phenomenon_start, epoch_us(max(o.interval_end)) AS phenomenon_end,
       epoch_us(min(o.result_time)) AS result_start, epoch_us(max(o.result_time)) AS result_end
FROM datastream d LEFT JOIN observation o ON o.datastream_id = d.id AND ({where}) GROUP BY d.id"""


# -- extents ---------------------------------------------------------------------------------


@query("agg_06_extents", extent_sql("TRUE"))
def agg_06(t):
    return maintain.extents(t.observations("intervals")).select(F.col("datastream_id").alias("id"), *extent_columns())


@query("agg_07_merge_extents", extent_sql("o.id % 10 <> 7"))
def agg_07(t):
    obs = t.observations("intervals")
    stored = maintain.merge_extents(bare_streams(t), obs.where(F.col("id") % 10 < 7))
    return maintain.merge_extents(stored, obs.where(F.col("id") % 10 > 7)).select("id", *extent_columns())


@query("agg_08_shrink_extents", extent_sql("NOT (o.result_number > 20 OR o.id % 3 = 0)"))
def agg_08(t):
    obs = t.observations("intervals")
    gone = (F.col("result_number") > 20) | (F.col("id") % 3 == 0)
    left = maintain.shrink_extents(t.datastreams(), obs.where(gone), obs.where(~gone))
    return left.select("id", *extent_columns())


@query("agg_09_widen_extents", """
SELECT d.id, epoch_us(d.phenomenon_start) AS phenomenon_start,
       epoch_us(greatest(d.phenomenon_end, max(o.phenomenon_start + INTERVAL 2 DAY))) AS phenomenon_end
FROM datastream d LEFT JOIN observation o ON o.datastream_id = d.id AND o.id % 4 = 0
GROUP BY d.id, d.phenomenon_start, d.phenomenon_end""")
def agg_09(t):
    moved = t.observations().where(F.col("id") % 4 == 0)
    later = F.col("phenomenon_start") + F.expr("INTERVAL 2 DAY")
    changed = moved.withColumns({"phenomenon_start": later, "phenomenon_end": later})
    wide = maintain.widen_extents(t.datastreams(), changed)
    return wide.select("id", us("phenomenon_start").alias("phenomenon_start"), us("phenomenon_end").alias("phenomenon_end"))


# -- areas -----------------------------------------------------------------------------------


def roaming(t):
    """Observations whose feature changes from reading to reading."""
    return t.observations().withColumn("feature_of_interest_id", F.col("id") % 25)


_POINTS = """
WITH pts AS (SELECT DISTINCT o.datastream_id AS ds, p.lon AS x, p.lat AS y
             FROM observation o JOIN place p ON p.id = o.id % 25 {where})"""


@query("agg_10_area_hull", _POINTS.format(where="") + """,
sizes AS (SELECT ds, count(*) AS n FROM pts GROUP BY ds),
turns AS (
  SELECT a.ds, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by,
         min((b.x - a.x) * (r.y - a.y) - (b.y - a.y) * (r.x - a.x)) AS least_turn
  FROM pts a JOIN pts b ON a.ds = b.ds AND (a.x <> b.x OR a.y <> b.y) JOIN pts r ON r.ds = a.ds
  GROUP BY ALL),
between_two AS (
  SELECT DISTINCT p.ds, p.x, p.y FROM pts p JOIN pts a ON a.ds = p.ds JOIN pts b ON b.ds = p.ds
  WHERE (a.x - p.x) * (b.y - p.y) = (a.y - p.y) * (b.x - p.x)
    AND (a.x - p.x) * (b.x - p.x) + (a.y - p.y) * (b.y - p.y) < 0),
corners AS (
  SELECT DISTINCT ds, ax AS x, ay AS y FROM turns WHERE least_turn >= 0
  UNION SELECT p.ds, x, y FROM pts p JOIN sizes s ON s.ds = p.ds WHERE s.n = 1)
SELECT c.ds AS datastream_id, c.x, c.y FROM corners c ANTI JOIN between_two b ON b.ds = c.ds AND b.x = c.x AND b.y = c.y""")
def agg_10(t):
    area = maintain.observed_area(roaming(t), t.features())
    corners = area.select("datastream_id", F.explode(F.flatten("observed_area.coords")).alias("p")).distinct()
    return corners.select("datastream_id", F.get("p", F.lit(0)).alias("x"), F.get("p", F.lit(1)).alias("y"))


_BOX = "SELECT ds AS datastream_id, min(x) AS xmin, min(y) AS ymin, max(x) AS xmax, max(y) AS ymax FROM pts GROUP BY ds"


def box(area):
    return area.select("datastream_id", *[F.col(f"observed_area.{c}").alias(c) for c in ("xmin", "ymin", "xmax", "ymax")])


@query("agg_11_area_envelope", _POINTS.format(where="") + _BOX)
def agg_11(t):
    return box(maintain.observed_area(roaming(t), t.features(), "envelope"))


@query("agg_12_area_without_feature", _POINTS.format(where="WHERE p.id NOT IN (3, 24)") + _BOX)
def agg_12(t):
    gone = t.features().where(F.col("id").isin(3, 24)).select("id")
    return box(maintain.observed_area(roaming(t), t.features(), exclude=gone))


@query("agg_13_touched", """
SELECT DISTINCT datastream_id FROM observation WHERE feature_of_interest_id IN (3, 7)""")
def agg_13(t):
    return maintain.touched_by_feature(t.observations(), t.features().where(F.col("id").isin(3, 7)))


# -- versions --------------------------------------------------------------------------------

_VERSION_ROW = "id, description, epoch_us(valid_from) AS valid_from, epoch_us(valid_to) AS valid_to, commit_id"


def version_row(df):
    return df.select(
        "id", "description", us("valid_from").alias("valid_from"), us("valid_to").alias("valid_to"), "commit_id"
    )


@query("win_03_change_feed_versions", f"SELECT {_VERSION_ROW} FROM thing_version")
def win_03(t):
    return version_row(t.thing_versions())


def batch(t):
    """Changes of customers: new ids, real updates, updates without effect, and deletes."""
    now = t.thing_versions().where(F.col("valid_to").isNull())
    kind = F.col("id") % 10
    fresh = now.where(kind == 0).withColumn("id", F.col("id") + 1_000_000).withColumn("action", F.lit("CREATE"))
    changed = now.where(kind == 1).withColumn("description", F.lit("X")).withColumn("action", F.lit("UPDATE"))
    same = now.where(kind == 2).withColumn("action", F.lit("UPDATE"))
    gone = now.where(kind == 3).withColumn("action", F.lit("DELETE"))
    return fresh.unionByName(changed).unionByName(same).unionByName(gone)


_AT = "TIMESTAMP '2002-01-01'"
_BATCH_SQL = f"""
WITH now AS (SELECT * FROM thing_version WHERE valid_to IS NULL),
fresh AS (SELECT id + 1000000 AS id, description, {_AT} AS valid_from, CAST(NULL AS TIMESTAMP) AS valid_to,
                 CAST(77 AS BIGINT) AS commit_id FROM now WHERE id % 10 = 0),
opened AS (SELECT id, 'X' AS description, {_AT} AS valid_from, CAST(NULL AS TIMESTAMP) AS valid_to,
                  CAST(77 AS BIGINT) AS commit_id FROM now WHERE id % 10 = 1),
closed AS (SELECT id, description, valid_from, {_AT} AS valid_to, commit_id FROM now WHERE id % 10 IN (1, 3)),
kept AS (SELECT id, description, valid_from, valid_to, commit_id FROM now WHERE id % 10 NOT IN (1, 3)),
past AS (SELECT id, description, valid_from, valid_to, commit_id FROM thing_version WHERE valid_to IS NOT NULL)
"""


def changed(t):
    return versions.apply_changes("thing", t.thing_versions(), batch(t), CHANGE_TIME, F.lit(77).cast("long"))


@query("ver_01_insert_opens", _BATCH_SQL + f"SELECT {_VERSION_ROW} FROM fresh")
def ver_01(t):
    return version_row(changed(t).where(F.col("id") >= 1_000_000))


@query("ver_02_update_closes_and_opens", _BATCH_SQL + f"""
SELECT {_VERSION_ROW} FROM (SELECT * FROM past UNION ALL SELECT * FROM kept UNION ALL SELECT * FROM closed
                            UNION ALL SELECT * FROM opened UNION ALL SELECT * FROM fresh)""")
def ver_02(t):
    return version_row(changed(t))


@query("ver_02_feed_chain", """
WITH now AS (SELECT * FROM thing_version WHERE valid_to IS NULL),
c AS (SELECT id, description, valid_from, commit_id, -1 AS seq FROM now WHERE id % 3 = 0
  UNION ALL SELECT id, 'X', TIMESTAMP '2002-01-01', 1, 1 FROM now WHERE id % 3 = 0
  UNION ALL SELECT id, 'Z', TIMESTAMP '2002-01-02', 3, 3 FROM now WHERE id % 3 = 0
  UNION ALL SELECT id, 'gone', TIMESTAMP '2002-01-03', 4, 4 FROM now WHERE id % 6 = 0),
l AS (SELECT id, description, valid_from, lead(valid_from) OVER (PARTITION BY id ORDER BY valid_from, seq) AS valid_to, commit_id FROM c)
SELECT id, description, epoch_us(valid_from) AS valid_from, epoch_us(valid_to) AS valid_to, commit_id FROM (
  SELECT * FROM l WHERE description <> 'gone'
  UNION ALL SELECT id, description, valid_from, valid_to, commit_id FROM thing_version WHERE valid_to IS NOT NULL OR id % 3 <> 0)""")
def ver_02_feed(t):
    """Up to four changes of one id in a batch, two of them at one instant."""
    now = t.thing_versions().where(F.col("valid_to").isNull() & (F.col("id") % 3 == 0)).drop("valid_from", "valid_to", "commit_id")

    def change(rows, text, at, seq, action="UPDATE"):
        return rows.withColumns({
            "description": F.lit(text), "ts": F.lit(at).cast("timestamp"), "seq": F.lit(seq).cast("long"),
            "commit_id": F.lit(seq).cast("long"), "action": F.lit(action)})

    feed = (
        change(now, "X", "2002-01-01T00:00:00Z", 1).unionByName(change(now, "Y", "2002-01-02T00:00:00Z", 2))
        .unionByName(change(now, "Z", "2002-01-02T00:00:00Z", 3))
        .unionByName(change(now.where(F.col("id") % 6 == 0), "gone", "2002-01-03T00:00:00Z", 4, "DELETE"))
    )
    return version_row(versions.apply_feed("thing", t.thing_versions(), feed))


@query("ver_02_id_change_refused", "SELECT id FROM thing WHERE id % 50 = 0")
def ver_02_ids(t):
    wanted = t.things().withColumn("new_id", F.when(F.col("id") % 50 == 0, F.col("id") + 1).otherwise(F.col("id")))
    return versions.id_violations(wanted, "new_id").select("id")


@query("ver_03_delete_closes", _BATCH_SQL + f"SELECT {_VERSION_ROW} FROM closed WHERE id % 10 = 3")
def ver_03(t):
    """Of all ids. Open versions are marked, since others may have ended at the instant of the batch before."""
    stored = t.thing_versions().withColumn("held", F.col("valid_to").isNull())
    news = batch(t).withColumn("held", F.lit(True))
    after = versions.apply_changes("thing", stored, news, CHANGE_TIME, F.lit(77).cast("long"))
    return version_row(after.where((F.col("id") % 10 == 3) & F.col("held") & F.col("valid_to").isNotNull()))


@query("ver_04_derived_changes", """
SELECT id, CASE WHEN id % 2 = 0 THEN 1 ELSE 2 END AS versions, id % 2 = 0 AS updated_in_place FROM datastream""")
def ver_04(t):
    never = F.lit(None).cast("timestamp")
    rows = t.datastreams().withColumns(
        {"valid_from": F.lit("2023-01-01T00:00:00Z").cast("timestamp"), "valid_to": never, "commit_id": F.lit(None).cast("long")}
    )
    moved = F.lit(MOVE_TIME).cast("timestamp")
    renamed = F.when(F.col("id") % 2 == 0, F.col("name")).otherwise(F.lit("renamed"))
    news = t.datastreams().withColumns({"phenomenon_end": moved, "name": renamed, "action": F.lit("UPDATE")})
    after = versions.apply_changes("datastream", rows, news, MOVE_TIME)
    return after.groupBy("id").agg(
        F.count("*").alias("versions"), F.min(F.col("phenomenon_end") == moved).alias("updated_in_place")
    )


@query("ver_05_overlap_check", """
SELECT id, description FROM thing_version v
WHERE valid_to IS NOT NULL AND id % 5 = 0 AND EXISTS (SELECT 1 FROM thing_version n WHERE n.id = v.id AND n.valid_from = v.valid_to)""")
def ver_05(t):
    later = F.col("valid_to") + F.expr("INTERVAL 1 SECOND")
    broken = t.thing_versions().withColumn(
        "valid_to", F.when(F.col("id") % 5 == 0, later).otherwise(F.col("valid_to"))
    )
    return versions.check_versions(broken).select("id", "description")


@query("ver_06_history_append", _BATCH_SQL + f"""
SELECT {_VERSION_ROW} FROM (SELECT * FROM past UNION ALL SELECT * FROM closed)""")
def ver_06(t):
    path = scratch_path(t.spark, "history")
    stored = t.thing_versions()
    versions.append_history(stored.where(F.col("valid_to").isNotNull()), path)
    rows = versions.change_rows("thing", stored.where(F.col("valid_to").isNull()), batch(t), CHANGE_TIME)
    current, closed = versions.split_versions(rows)
    versions.append_history(closed.select(*stored.columns), path)
    return version_row(t.spark.read.schema(stored.schema).parquet(path))


@query("ver_07_as_of", f"""
SELECT {_VERSION_ROW} FROM thing_version
WHERE valid_from <= TIMESTAMP '1997-06-01 10:00:00' AND (valid_to IS NULL OR valid_to > TIMESTAMP '1997-06-01 10:00:00')""")
def ver_07(t):
    return version_row(t.catalog(versioned=True).as_of("1997-06-01T12:00:00+02:00").table("thing"))


@query("ver_08_from_to", f"""
SELECT {_VERSION_ROW} FROM thing_version
WHERE valid_from < TIMESTAMP '1998-01-01' AND (valid_to IS NULL OR valid_to > TIMESTAMP '1997-01-01')""")
def ver_08(t):
    return version_row(t.catalog(versioned=True).from_to("1997-01-01T00:00:00Z", "1998-01-01T00:00:00Z").table("thing"))


@query("ver_09_commit", _BATCH_SQL + """
SELECT id, 'clerk' AS author, 'price round' AS message, 'UPDATE' AS action_type FROM opened
UNION ALL SELECT id, 'clerk', 'price round', 'UPDATE' FROM fresh""")
def ver_09(t):
    number = 10_000_000
    log = t.commits().unionByName(versions.commit(t.spark, number, "price round", "clerk", "UPDATE", CHANGE_TIME))
    stamp = F.lit(number).cast("long")
    after = versions.apply_changes("thing", t.thing_versions(), batch(t), CHANGE_TIME, stamp)
    stamped = after.where(F.col("valid_from") == F.lit(CHANGE_TIME).cast("timestamp"))
    named = log.select(F.col("id").alias("commit_id"), "author", "message", "action_type")
    return stamped.join(named, "commit_id").select("id", "author", "message", "action_type")


@query("ver_10_history", """
SELECT v.id, epoch_us(v.valid_from) AS valid_from, v.description, c.author, c.message, c.action_type
FROM thing_version v LEFT JOIN commit_log c ON c.id = v.commit_id""")
def ver_10(t):
    rows = versions.history(t.catalog(versioned=True), "Things")
    return rows.select("id", us("valid_from").alias("valid_from"), "description", "author", "message", "action_type")


# -- inserts ---------------------------------------------------------------------------------


@query("mut_01_insert_defaults", """
SELECT id, CASE WHEN id % 9 = 0 THEN epoch_us(TIMESTAMP '2024-02-01') ELSE epoch_us(phenomenon_start) END AS lo,
       CASE WHEN id % 9 = 0 THEN epoch_us(TIMESTAMP '2024-02-01') ELSE epoch_us(phenomenon_start) END AS hi
FROM observation""")
def mut_01(t):
    start = F.when(F.col("id") % 9 != 0, F.col("phenomenon_start"))
    rows = t.observations().withColumns({"phenomenon_start": start, "phenomenon_end": F.lit(None).cast("timestamp")})
    done = loading.normalise_observations(rows, F.lit(MOVE_TIME).cast("timestamp"))
    return done.select("id", us("phenomenon_start").alias("lo"), us("phenomenon_end").alias("hi"))


@query("mut_02_parse_times", """
SELECT id, CASE WHEN id % 4 = 3 THEN NULL ELSE epoch_us(date_trunc('second', phenomenon_start)) END AS lo,
       CASE id % 4 WHEN 3 THEN NULL WHEN 1 THEN epoch_us(date_trunc('second', phenomenon_start) + INTERVAL 1 HOUR)
         ELSE epoch_us(date_trunc('second', phenomenon_start)) END AS hi FROM observation""")
def mut_02(t):
    start = F.date_format("phenomenon_start", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    end = F.date_format(F.col("phenomenon_start") + F.expr("INTERVAL 2 HOUR"), "yyyy-MM-dd'T'HH:mm:ss'+01:00'")
    kind = F.col("id") % 4
    text = (
        F.when(kind == 0, start).when(kind == 1, F.concat(start, F.lit("/"), end))
        .when(kind == 2, F.concat(start, F.lit("/"), start)).otherwise(F.concat(start, F.lit("/yesterday")))
    )
    x = values.parse_time(text)
    return t.observations().select("id", us(x.lower).alias("lo"), us(x.upper).alias("hi"))


@query("mut_03_result_typing", """
SELECT id, CASE id % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 END AS result_type,
       CASE id % 5 WHEN 0 THEN CAST(id AS VARCHAR) WHEN 1 THEN 'true' WHEN 3 THEN event_type END AS result_string,
       CASE WHEN id % 5 = 0 THEN CAST(id AS DOUBLE) END AS result_number,
       CASE WHEN id % 5 = 1 THEN TRUE END AS result_boolean,
       CASE WHEN id % 5 = 2 THEN replace(parameters, ' ', '') END AS result_json FROM observation""")
def mut_03(t):
    kind = F.col("id") % 5
    text = (
        F.when(kind == 0, F.col("id").cast("string")).when(kind == 1, F.lit("true"))
        .when(kind == 2, F.col("parameters")).when(kind == 3, F.concat(F.lit('"'), F.col("event_type"), F.lit('"')))
        .otherwise(F.lit("null"))
    )
    return t.observations().select("id", *[c.alias(n) for n, c in values.typed_text_result(text).items()])


def datastream_docs(t):
    """Datastream documents with every kind of fault."""
    kind = F.col("id") % 6
    relations = F.concat(
        F.lit('"Thing":{"@iot.id":'), F.col("thing_id").cast("string"), F.lit('},"Sensor":{"@iot.id":'),
        F.col("sensor_id").cast("string"), F.lit('},"ObservedProperty":{"name":"'), F.col("description"), F.lit('"}'),
    )
    text = (
        F.when(kind == 0, F.concat(F.lit('{"name":"a",'), relations, F.lit("}")))
        .when(kind == 1, F.concat(F.lit('{"colour":"red",'), relations, F.lit("}")))
        .when(kind == 2, F.lit('{"name":"a","Thing":{"@iot.id":1}}'))
        .when(kind == 3, F.lit("[1, 2]"))
        .when(kind == 4, F.lit('{"Thing":7,"Sensor":{"@iot.id":1},"ObservedProperty":{"@iot.id":1}}'))
        .otherwise(F.lit('{"Thing":{"@iot.id":"x"},"Sensor":{"@iot.id":1},"ObservedProperty":{"@iot.id":1}}'))
    )
    return t.datastreams().select("id", text.alias("doc"))


@query("mut_04_validate", """
SELECT id, CASE id % 6 WHEN 1 THEN 'unknown: colour' WHEN 2 THEN 'missing: Sensor,ObservedProperty'
  WHEN 3 THEN 'not an object' WHEN 4 THEN 'not an object: Thing' WHEN 5 THEN 'id is not an integer: Thing' END AS reason
FROM datastream""")
def mut_04(t):
    return mutations.validate(datastream_docs(t), "Datastream").select("id", "reason")


@query("mut_05_assign_ids", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 1000 + row_number() OVER (
  ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id
FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem)""")
def mut_05(t):
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return identity.assign_ids(t.raw("lineitem").select(*keys).distinct(), keys, 1001)


@query("mut_06_link_or_create", """
SELECT id, CASE WHEN id % 6 IN (0, 1) THEN thing_id WHEN id % 6 = 2 THEN 1 END AS existing_id,
       CASE WHEN id % 6 IN (0, 1) THEN description END AS inline_name FROM datastream""")
def mut_06(t):
    docs = datastream_docs(t)
    things = mutations.link_relations(docs, "Thing").select("id", "existing_id")
    inline = mutations.link_relations(docs, "ObservedProperty").select(
        "id", F.get_json_object("inline", "$.name").alias("inline_name")
    )
    return things.join(inline, "id")


def thing_docs(t):
    """One nested document per customer: a location, one or two datastreams with readings."""
    key = F.col("c_custkey").cast("string")
    reading = F.concat(F.lit('{"phenomenonTime":"2015-03-03T00:00:00Z","result":'), key, F.lit("}"))
    stream = F.concat(
        F.lit('{"name":"s'), key, F.lit('","description":"d","observationType":"o","unitOfMeasurement":{"name":"Lumen","symbol":"lm"},'
              '"Sensor":{"name":"n'), key, F.lit('","description":"d","encodingType":"text","metadata":"m"},'
              '"ObservedProperty":{"@iot.id":4},"Observations":['), reading, F.lit(","), reading, F.lit("]}"),
    )
    streams = F.when(F.col("c_custkey") % 2 == 0, F.concat(stream, F.lit(","), stream)).otherwise(stream)
    doc = F.concat(
        F.lit('{"name":"'), F.col("c_name"), F.lit('","description":"deep","properties":{"k":'), key,
        F.lit('},"Locations":[{"name":"l'), key, F.lit('","description":"d","encodingType":"geo","location":{"type":"Point","coordinates":['), key,
        F.lit(',1.5]}}],"Datastreams":['), streams, F.lit("]}"),
    )
    return t.raw("customer").select(F.col("c_custkey").alias("doc_id"), doc.alias("doc"))


_STREAM_COUNT = "CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 1 END"


@query("src_07_nested_documents", f"""
WITH s AS (SELECT c_custkey, c_name, unnest(range({_STREAM_COUNT})) AS pos FROM customer),
d AS (SELECT *, row_number() OVER (ORDER BY c_custkey, pos) AS datastream_id FROM s),
th AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS thing_id FROM customer)
SELECT datastream_id, 's' || d.c_custkey AS datastream, thing_id, c_name AS thing, datastream_id AS sensor_id,
       'n' || d.c_custkey AS sensor, 4 AS observed_property_id, 2 AS readings, CAST(2 * d.c_custkey AS DOUBLE) AS result_sum,
       CAST(d.c_custkey AS DOUBLE) AS lon
FROM d JOIN th ON th.c_custkey = d.c_custkey""")
def src_07(t):
    parts = flatten_documents(thing_docs(t))
    streams = parts["datastream"].select(
        F.col("id").alias("datastream_id"), F.col("name").alias("datastream"), "thing_id", "sensor_id", "observed_property_id"
    )
    things = parts["thing"].select(F.col("id").alias("thing_id"), F.col("name").alias("thing"))
    sensors = parts["sensor"].select(F.col("id").alias("sensor_id"), F.col("name").alias("sensor"))
    readings = parts["observation"].groupBy("datastream_id").agg(
        F.count("*").alias("readings"), F.sum("result_number").alias("result_sum")
    )
    places = parts["thing_location"].join(
        parts["location"].select(F.col("id").alias("location_id"), F.col("location.xmin").alias("lon")), "location_id"
    ).select("thing_id", "lon")
    return (
        streams.join(things, "thing_id").join(sensors, "sensor_id").join(readings, "datastream_id").join(places, "thing_id")
    )


@query("mut_07_deep_insert", f"""
SELECT 'thing' AS table_name, 2 * count(*) AS n, max(c_custkey) + 1 + count(*) AS last_id FROM customer
UNION ALL SELECT 'datastream', (SELECT count(*) FROM datastream) + sum({_STREAM_COUNT}),
                 (SELECT max(id) FROM datastream) + sum({_STREAM_COUNT}) FROM customer
UNION ALL SELECT 'historical_location', (SELECT count(*) FROM historical_location) + count(*),
                 (SELECT max(id) FROM historical_location) + count(*) FROM customer""".replace("max(c_custkey) + 1 + count(*)", "max(c_custkey) + count(*)"))
def mut_07(t):
    catalog = t.catalog()
    names = ("thing", "location", "historical_location", "sensor", "datastream", "observation")
    starts = {n: identity.next_id(catalog.table(n)) for n in names}
    parts = flatten_documents(thing_docs(t), starts)
    state = catalog.replace(**{n: catalog.table(n).unionByName(parts[n], allowMissingColumns=True) for n in names})
    counts = [
        state.table(n).agg(F.lit(n).alias("table_name"), F.count("*").alias("n"), F.max("id").alias("last_id"))
        for n in ("thing", "datastream", "historical_location")
    ]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


def deep_docs(t):
    """The documents of ``thing_docs``, and among them some that may not be inserted."""
    key = F.col("doc_id") % 5
    return thing_docs(t).withColumn("doc", F.when(key == 0, F.lit("{oops")).when(
        key == 1, F.concat(F.lit('{"colour":1,'), F.substring("doc", 2, 1_000_000))).otherwise(F.col("doc")))


@query("mut_07_deep_insert_rows", f"""
WITH ok AS (SELECT c_custkey, c_name, row_number() OVER (ORDER BY c_custkey) AS rn FROM customer WHERE c_custkey % 5 > 1)
SELECT c_name AS name, (SELECT max(id) FROM thing) + rn AS thing_id, 'l' || c_custkey AS location,
       epoch_us(TIMESTAMP '2024-05-01') AS visited, 's' || c_custkey AS datastream, (SELECT max(s_suppkey) FROM supplier) > 0 AS has_sensor,
       1 AS readings, epoch_us(TIMESTAMP '2015-03-03') AS lo, epoch_us(TIMESTAMP '2015-03-03') AS hi, TRUE AS has_feature, TRUE AS has_area
FROM ok JOIN (SELECT unnest([1, 2]) AS k) ON k <= {_STREAM_COUNT}""")
def mut_07_rows(t):
    """Each inserted datastream with its thing, place, visit, readings, extents, feature and area."""
    catalog = t.catalog()
    state, parts, _ = deep_insert(catalog, deep_docs(t), "2024-05-01T00:00:00Z")
    new = parts["thing"].select(F.col("id").alias("thing_id"), "name")
    place = state.table("thing_location").join(
        state.table("location").select(F.col("id").alias("location_id"), F.col("name").alias("location")), "location_id")
    visit = state.table("historical_location").select("thing_id", us("time").alias("visited"))
    readings = state.table("observation").groupBy("datastream_id").agg(
        F.count("*").alias("readings"), F.bool_and(F.col("feature_of_interest_id").isNotNull()).alias("has_feature"))
    streams = state.table("datastream").select(
        F.col("id").alias("datastream_id"), F.col("name").alias("datastream"), "thing_id",
        F.col("sensor_id").isNotNull().alias("has_sensor"), us("phenomenon_start").alias("lo"), us("phenomenon_end").alias("hi"),
        F.col("observed_area").isNotNull().alias("has_area"))
    return (
        streams.join(new, "thing_id").join(place, "thing_id").join(visit, "thing_id").join(readings, "datastream_id")
        .drop("datastream_id", "location_id")
    )


@query("mut_07_deep_insert_rejects", f"""
SELECT c_custkey AS doc_id, CASE c_custkey % 5 WHEN 0 THEN 'not an object' ELSE 'unknown: colour' END AS reason FROM customer WHERE c_custkey % 5 < 2
UNION ALL SELECT NULL, 'duplicate' FROM customer JOIN (SELECT unnest([1, 2]) AS k) ON k <= {_STREAM_COUNT} WHERE c_custkey % 5 > 1""")
def mut_07_rejects(t):
    return deep_insert(t.catalog(), deep_docs(t), "2024-05-01T00:00:00Z")[2]


@query("mut_07_location_roots", """
WITH doc AS (SELECT n_nationkey AS k, row_number() OVER (ORDER BY n_nationkey) AS rn FROM nation),
spot AS (SELECT k, rn, (SELECT max(n_nationkey) FROM nation) + rn AS location_id FROM doc),
held AS (SELECT location_id, k + 1 AS thing_id, 'old' AS kind FROM spot
         UNION ALL SELECT location_id, (SELECT max(id) FROM thing) + rn, 'new' FROM spot)
SELECT location_id, thing_id, kind, 1 AS places, epoch_us(TIMESTAMP '2024-05-01') AS visited FROM held""")
def mut_07_locations(t):
    """New locations, each with a stored thing that moves there and a new one."""
    key = F.col("n_nationkey").cast("string")
    doc = F.concat(
        F.lit('{"name":"new'), key, F.lit('","description":"d","encodingType":"geo","location":{"type":"Point","coordinates":['), key,
        F.lit(',1]},"Things":[{"@iot.id":'), (F.col("n_nationkey") + 1).cast("string"), F.lit('},{"name":"under'), key,
        F.lit('","description":"d"}]}'))
    catalog = t.catalog()
    docs = t.raw("nation").select(F.col("n_nationkey").alias("doc_id"), doc.alias("doc"))
    state, parts, _ = deep_insert(catalog, docs, "2024-05-01T00:00:00Z", "Location")
    links = state.table("thing_location")
    places = links.groupBy("thing_id").agg(F.count("*").alias("places"))
    fresh = parts["thing"].select(F.col("id").alias("thing_id"), F.lit("new").alias("kind"))
    visits = parts["historical_location"].join(
        parts["location_historical_location"].withColumnRenamed("historical_location_id", "id"), "id")
    return (
        links.join(parts["location"].select(F.col("id").alias("location_id")), "location_id").join(places, "thing_id")
        .join(fresh, "thing_id", "left").withColumn("kind", F.coalesce("kind", F.lit("old")))
        .join(visits.select("thing_id", "location_id", us("time").alias("visited")), ["thing_id", "location_id"])
        .select("location_id", "thing_id", "kind", "places", "visited")
    )


@query("mut_07_sensor_and_property_roots", """
WITH s AS (SELECT s_suppkey AS k, row_number() OVER (ORDER BY s_suppkey) AS rn FROM supplier),
p AS (SELECT id, row_number() OVER (ORDER BY id) AS rn FROM datastream WHERE id % 7 = 0)
SELECT (SELECT max(id) FROM datastream) + rn AS id, 's' || k AS name, k AS thing_id,
       (SELECT max(s_suppkey) FROM supplier) + rn AS sensor_id,
       (SELECT max(id) FROM observed_property) + rn AS observed_property_id, CAST(k AS DOUBLE) AS reading FROM s
UNION ALL
SELECT d.id, d.name, d.thing_id, d.sensor_id, (SELECT max(id) FROM observed_property) + (SELECT count(*) FROM supplier) + p.rn, NULL
FROM datastream d JOIN p USING (id)""")
def mut_07_sensors(t):
    """Sensors with a new datastream each, and observed properties that take over stored datastreams."""
    key = F.col("s_suppkey").cast("string")
    sensor = F.concat(
        F.lit('{"name":"n'), key, F.lit('","description":"d","encodingType":"text","metadata":"m","Datastreams":[{"name":"s'), key,
        F.lit('","description":"d","observationType":"o","unitOfMeasurement":{"name":"u"},"Thing":{"@iot.id":'), key,
        F.lit('},"ObservedProperty":{"name":"p'), key, F.lit('","description":"d","definition":"x"},'
              '"Observations":[{"phenomenonTime":"2015-03-03T00:00:00Z","result":'), key,
        F.lit(',"FeatureOfInterest":{"@iot.id":3}}]}]}'))
    owner = F.concat(
        F.lit('{"name":"q","description":"d","definition":"x","Datastreams":[{"@iot.id":'), F.col("id").cast("string"), F.lit("}]}"))
    catalog = t.catalog()
    last = F.lit(10**12).cast("long")
    docs = t.raw("supplier").select(
        F.col("s_suppkey").alias("doc_id"), F.lit("Sensor").alias("entity"), sensor.alias("doc")
    ).unionByName(catalog.table("datastream").where("id % 7 = 0").select(
        (last + F.col("id")).alias("doc_id"), F.lit("ObservedProperties").alias("entity"), owner.alias("doc")))
    state, parts, _ = deep_insert(catalog, docs, "2024-05-01T00:00:00Z")
    news = parts["datastream"].select("id", F.lit(True).alias("new"))
    readings = parts["observation"].select(F.col("datastream_id").alias("id"), F.col("result_number").alias("reading"))
    streams = state.table("datastream").join(news, "id", "left").where("new or id % 7 = 0")
    return streams.join(readings, "id", "left").select("id", "name", "thing_id", "sensor_id", "observed_property_id", "reading")


_BROKEN = {
    0: ('"phenomenonTime":"2015-03-03T00:00:00Z"', '"phenomenonTime":"some day"', "bad time: Datastreams.Observations.phenomenonTime"),
    1: (r'"result":\d+', '"resultQuality":1', "missing: Datastreams.Observations.result"),
    2: (r'"result":\d+', '"result":[1]', "result has no type: Datastreams.Observations.result"),
    3: ('"ObservedProperty":\\{"@iot.id":4\\},', "", "missing: Datastreams.ObservedProperty"),
    4: ('"@iot.id":4', '"@iot.id":4,"name":"x"', "more than an id: Datastreams.ObservedProperty"),
    5: ('"@iot.id":4', '"@iot.id":444', "unknown id: Datastreams.ObservedProperty.444"),
    6: (r'"Locations":\[(.*?)\],"Datastreams"', '"Locations":$1,"Datastreams"', "not a list: Locations"),
    7: (r'"coordinates":\[.*?\]', '"coordinates":"here"', "not a geometry: Locations.location"),
    8: ('"encodingType":"text"', '"encodingType":"text","colour":1', "unknown: Datastreams.Sensor.colour"),
    9: ('"symbol":"lm"', '"symbol":"lm"},"properties":{', None),
}


@query("mut_07_strict_rejects", "SELECT c_custkey AS doc_id, CASE c_custkey % 10 " + " ".join(
    f"WHEN {k} THEN '{reason}'" for k, (_, _, reason) in _BROKEN.items() if reason
) + " END AS reason FROM customer WHERE c_custkey % 10 <> 9")
def mut_07_strict(t):
    """One defect per document, deep inside; every tenth document is sound."""
    doc = F.col("doc")
    for k, (pattern, text, _) in _BROKEN.items():
        doc = F.when(F.col("doc_id") % 10 == k, F.regexp_replace("doc", pattern, text)).otherwise(doc)
    rejects = deep_insert(t.catalog(), thing_docs(t).withColumn("doc", doc), "2024-05-01T00:00:00Z")[2]
    return rejects.where("doc_id is not null")


@query("mut_08_relocate", """
WITH moved AS (SELECT id AS thing_id, (id * 7) % 25 AS location_id FROM thing WHERE id % 4 = 0),
steps AS (SELECT *, (SELECT max(id) FROM historical_location) + row_number() OVER (ORDER BY thing_id) AS hl FROM moved)
SELECT 'link' AS kind, thing_id AS a, location_id AS b FROM thing_location WHERE thing_id % 4 <> 0
UNION ALL SELECT 'link', thing_id, location_id FROM moved
UNION ALL SELECT 'visit', thing_id, hl FROM steps
UNION ALL SELECT 'visited', location_id, hl FROM steps""")
def mut_08(t):
    catalog = t.catalog()
    moved = catalog.table("thing").where(F.col("id") % 4 == 0).select(
        F.col("id").alias("thing_id"), ((F.col("id") * 7) % 25).alias("location_id")
    )
    last = identity.next_id(catalog.table("historical_location"))
    state = mutations.relocate(catalog, moved, MOVE_TIME)
    links = state.table("thing_location").select(F.lit("link").alias("kind"), F.col("thing_id").alias("a"), F.col("location_id").alias("b"))
    visits = state.table("historical_location").where(F.col("id") >= last).select(
        F.lit("visit").alias("kind"), F.col("thing_id").alias("a"), F.col("id").alias("b")
    )
    visited = state.table("location_historical_location").where(F.col("historical_location_id") >= last).select(
        F.lit("visited").alias("kind"), F.col("location_id").alias("a"), F.col("historical_location_id").alias("b")
    )
    return links.unionByName(visits).unionByName(visited)


_FIRST_PLACE = """
WITH chain AS (SELECT d.id AS ds, min(l.location_id) AS loc FROM datastream d
               LEFT JOIN thing_location l ON l.thing_id = d.thing_id GROUP BY d.id)"""


@query("jn_13_default_feature", _FIRST_PLACE + """
SELECT ds AS datastream_id, loc AS location_id, gen_foi_id FROM chain LEFT JOIN place ON place.id = loc""")
def jn_13(t):
    catalog = t.catalog()
    return mutations.default_feature(catalog, catalog.table("datastream"))


@query("mut_09_generated_features", _FIRST_PLACE + """,
fresh AS (SELECT loc, 24 + row_number() OVER (ORDER BY loc) AS foi FROM (SELECT DISTINCT loc FROM chain WHERE loc % 2 = 1))
SELECT o.id, CASE WHEN o.id % 2 = 0 THEN o.feature_of_interest_id WHEN chain.loc % 2 = 0 THEN chain.loc ELSE fresh.foi END AS foi
FROM observation o JOIN chain ON chain.ds = o.datastream_id LEFT JOIN fresh ON fresh.loc = chain.loc
WHERE o.user_id % 11 <> 0 OR o.id % 2 = 0""")
def mut_09(t):
    catalog = t.catalog()
    homeless = catalog.table("thing_location").where(F.col("thing_id") % 11 != 0)
    lacking = F.when(F.col("id") % 2 == 0, F.col("feature_of_interest_id"))
    obs = catalog.table("observation").withColumn("feature_of_interest_id", lacking)
    _, ready, _ = mutations.ensure_feature(catalog.replace(thing_location=homeless), obs)
    return ready.select("id", F.col("feature_of_interest_id").alias("foi"))


@query("mut_09_rejects", "SELECT id, 'the thing has no location' AS reason FROM observation WHERE user_id % 11 = 0")
def mut_09_rejects(t):
    catalog = t.catalog()
    homeless = catalog.table("thing_location").where(F.col("thing_id") % 11 != 0)
    obs = catalog.table("observation").withColumn("feature_of_interest_id", F.lit(None).cast("long"))
    _, _, rejects = mutations.ensure_feature(catalog.replace(thing_location=homeless), obs)
    return rejects.select("id", "reason")


@query("mut_10_last_feature", """
SELECT d.id, arg_max(o.id % 25, o.id) AS last_foi_id FROM datastream d
LEFT JOIN observation o ON o.datastream_id = d.id AND o.id % 3 = 0 GROUP BY d.id""")
def mut_10(t):
    return maintain.update_last_feature(t.datastreams(), roaming(t).where(F.col("id") % 3 == 0)).select("id", "last_foi_id")


@query("mut_11_unique", """
WITH l AS (SELECT l_orderkey, l_linenumber, l_shipdate, l_partkey, l_suppkey, l_extendedprice, row_number() OVER (
             PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_extendedprice) AS rn FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       CASE WHEN l_orderkey % 10 = 0 THEN 'exists' WHEN rn = 1 THEN 'accepted' ELSE 'duplicate' END AS status FROM l""")
def mut_11(t):
    lines = t.raw("lineitem")
    keys = ["l_orderkey", "l_linenumber"]
    stored = lines.where(F.col("l_orderkey") % 10 == 0)
    judged = identity.enforce_unique(
        lines, stored, keys, ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"]
    )
    return judged.select(*keys, "l_partkey", "l_suppkey", "status")


@query("mut_11_null_keys", """
WITH l AS (SELECT l_orderkey, l_linenumber, l_shipdate, l_partkey, l_suppkey, l_extendedprice, row_number() OVER (
             PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_extendedprice) AS rn FROM lineitem)
SELECT CASE WHEN l_orderkey % 4 <> 1 THEN l_orderkey END AS l_orderkey, l_linenumber, l_partkey, l_suppkey,
       CASE WHEN l_orderkey % 4 = 1 THEN 'accepted' WHEN l_orderkey % 10 = 0 THEN 'exists'
            WHEN rn = 1 THEN 'accepted' ELSE 'duplicate' END AS status FROM l""")
def mut_11_null(t):
    lines = t.raw("lineitem").withColumn("l_orderkey", F.when(F.col("l_orderkey") % 4 != 1, F.col("l_orderkey")))
    keys = ["l_orderkey", "l_linenumber"]
    stored = lines.where((F.col("l_orderkey") % 10 == 0) | F.col("l_orderkey").isNull())
    judged = identity.enforce_unique(
        lines, stored, keys, ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"]
    )
    return judged.select(*keys, "l_partkey", "l_suppkey", "status")


def bulk_docs(t):
    """Bulk documents of the events, at most 200 readings each."""
    row = F.concat(
        F.lit("["), F.col("result_number").cast("string"), F.lit(',"'),
        F.date_format("phenomenon_start", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), F.lit('"]'),
    )
    rows = t.observations().select("datastream_id", F.expr("id div 200").alias("part"), "id", row.alias("row"))
    listed = rows.groupBy("datastream_id", "part").agg(F.array_sort(F.collect_list(F.struct("id", "row"))).alias("rows"))
    return listed.select(
        "part",
        F.concat(
            F.lit('[{"Datastream":{"@iot.id":'), F.col("datastream_id").cast("string"),
            F.lit('},"components":["result","phenomenonTime"],"dataArray":['),
            F.array_join(F.transform("rows", lambda r: r["row"]), ","), F.lit("]}]"),
        ).alias("doc"),
    )


@query("mut_12_bulk_insert", _FIRST_PLACE + """,
got AS (SELECT datastream_id AS ds, count(*) AS n, min(phenomenon_start) AS lo, max(phenomenon_start) AS hi,
               min(result_number) AS least, max(result_number) AS most
        FROM observation WHERE id % 3 <> 0 GROUP BY datastream_id)
SELECT d.id, coalesce(n, 0) AS inserted, epoch_us(lo) AS phenomenon_start, epoch_us(hi) AS phenomenon_end, least, most
FROM datastream d LEFT JOIN got ON got.ds = d.id""")
def mut_12(t):
    catalog = t.catalog()
    half = catalog.table("observation").where(F.col("id") % 3 == 0)
    state = catalog.replace(observation=half, datastream=bare_streams(t))
    state, inserted, _ = bulk_insert(state, bulk_docs(t), ["part"])
    got = inserted.groupBy(F.col("datastream_id").alias("id")).agg(
        F.count("*").alias("inserted"), F.min("result_number").alias("least"), F.max("result_number").alias("most")
    )
    streams = state.table("datastream").select("id", us("phenomenon_start").alias("phenomenon_start"), us("phenomenon_end").alias("phenomenon_end"))
    return streams.join(got, "id", "left").withColumn("inserted", F.coalesce("inserted", F.lit(0)))


# -- updates ---------------------------------------------------------------------------------


@query("mut_13_merge_patch", """
SELECT id, CASE WHEN id % 3 = 0 THEN 'renamed ' || id ELSE name END AS name,
       CASE WHEN id % 3 = 1 THEN NULL ELSE properties END AS properties, description FROM thing""")
def mut_13(t):
    things = t.things()
    news = things.where(F.col("id") % 3 != 2).select(
        "id", F.concat(F.lit("renamed "), F.col("id").cast("string")).alias("name"), F.lit(None).cast("string").alias("properties"),
        F.when(F.col("id") % 3 == 0, F.array(F.lit("name"))).otherwise(F.array(F.lit("properties"))).alias("present"),
    )
    return mutations.patch("thing", things, news)


@query("mut_13_location_patch", """
SELECT id, CASE WHEN id % 4 <> 0 THEN gen_foi_id END AS gen_foi_id,
       CASE WHEN id % 4 = 0 THEN 0.0 ELSE lon END AS lon FROM place""")
def mut_13_location(t):
    from sensorquery.functions import geometry

    places = t.locations()
    news = places.where(F.col("id") % 4 == 0).select(
        "id", geometry.point(F.lit(0.0), F.lit(1.0)).alias("location"), F.array(F.lit("location")).alias("present")
    )
    return mutations.patch("location", places, news).select("id", "gen_foi_id", F.col("location.xmin").alias("lon"))


@query("mut_14_time_move", """
SELECT DISTINCT strftime(DATE '1970-01-01' + CAST(c AS INTEGER), '%Y-%m-%d') AS chunk FROM (
  SELECT epoch_us(phenomenon_start) // 86400000000 // 30 * 30 AS c FROM observation WHERE id % 7 = 0
  UNION SELECT epoch_us(phenomenon_start + INTERVAL 90 DAY) // 86400000000 // 30 * 30 FROM observation WHERE id % 7 = 0)""")
def mut_14(t):
    from sensorquery.catalog import chunk_start

    rows = t.observations().withColumn("chunk", chunk_start(F.col("phenomenon_start")))
    later = F.col("phenomenon_start") + F.expr("INTERVAL 90 DAY")
    news = rows.where(F.col("id") % 7 == 0).select(
        "id", later.alias("phenomenon_start"), later.alias("phenomenon_end"),
        F.array(F.lit("phenomenon_start"), F.lit("phenomenon_end")).alias("present"),
    )
    after = mutations.patch("observation", rows, news)
    return mutations.moved_chunks(rows, after).select(F.date_format("chunk", "yyyy-MM-dd").alias("chunk"))


@query("mut_15_replace", """
SELECT id, CASE WHEN id % 3 = 0 THEN 'new ' || id ELSE name END AS name,
       CASE WHEN id % 3 = 0 THEN 'replaced' ELSE description END AS description,
       CASE WHEN id % 3 = 0 THEN NULL ELSE properties END AS properties FROM thing""")
def mut_15(t):
    things = t.things()
    news = things.where(F.col("id") % 3 != 2).select(
        "id", F.concat(F.lit("new "), F.col("id").cast("string")).alias("name"),
        F.when(F.col("id") % 3 == 0, "replaced").alias("description"),
    )
    state, _ = mutations.replace("thing", things, news)
    return state


@query("mut_15_replace_refused", "SELECT id FROM thing WHERE id % 3 = 1")
def mut_15_refused(t):
    things = t.things()
    news = things.where(F.col("id") % 3 != 2).select(
        "id", "name", F.when(F.col("id") % 3 == 0, "replaced").alias("description")
    )
    return mutations.replace("thing", things, news)[1].select("id")


@query("mut_16_json_patch", """
SELECT id, CASE WHEN id % 4 = 1 THEN parameters WHEN id % 4 = 3 THEN parameters
       WHEN id % 4 = 0 THEN '{"k":' || (parameters->>'$.k') || ',"tag":"a"}'
       ELSE '{"copy":' || (parameters->>'$.k') || '}' END AS doc, id % 4 IN (0, 2) AS patched,
       id % 4 = 1 AS rejected FROM observation""")
def mut_16(t):
    obs = t.observations()
    docs = obs.select("id", F.col("parameters").alias("doc"))
    none = F.lit(None).cast("string")
    key = F.col("id") % 4

    def step(seq: int, op: str, path: str, origin=none, value=none):
        return F.struct(
            F.lit(seq).cast("long").alias("seq"), F.lit(op).alias("op"), F.lit(path).alias("path"),
            origin.alias("origin"), value.alias("value"),
        )

    steps = (
        F.when(key == 0, F.array(step(1, "add", "/tag", value=F.lit('"a"')), step(2, "test", "/tag", value=F.lit('"a"'))))
        .when(key == 1, F.array(step(1, "add", "/tag", value=F.lit("1")), step(2, "remove", "/absent")))
        .when(key == 2, F.array(step(1, "copy", "/copy", F.lit("/k")), step(2, "remove", "/k")))
    )
    ops = obs.select("id", F.explode(steps).alias("s")).select("id", "s.*")
    done = mutations.json_patch(docs, ops)
    return done.select("id", "doc", "patched", F.col("reason").isNotNull().alias("rejected"))


@query("mut_16_malformed_values", """
SELECT id, CASE WHEN id % 4 = 3 THEN '{"k":' || (parameters->>'$.k') || ',"ü":[true]}' WHEN id % 4 = 2 THEN 'no json' ELSE parameters END AS doc,
       CASE id % 4 WHEN 0 THEN 'the value is not JSON' WHEN 1 THEN 'no such element: ²' WHEN 2 THEN 'the document is not JSON' END AS reason
FROM observation""")
def mut_16_malformed(t):
    """A malformed value, place or document rejects its own id and no other."""
    obs = t.observations()
    key = F.col("id") % 4
    docs = obs.select("id", F.when(key == 2, F.lit("no json")).otherwise(F.col("parameters")).alias("doc"))
    steps = obs.select(
        "id", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(2).cast("long"))).alias("seq"), key.alias("kind")
    ).select(
        "id", "seq", F.lit("add").alias("op"),
        F.when(F.col("seq") == 1, "/ü").when(F.col("kind") == 1, "/ü/²").otherwise("/ü/-").alias("path"),
        F.lit(None).cast("string").alias("origin"),
        F.when(F.col("seq") == 1, "[]").when(F.col("kind") == 0, "{oops").otherwise("true").alias("value"),
    )
    return mutations.json_patch(docs, steps).select("id", "doc", "reason")


@query("mut_17_relink", """
SELECT id, CASE WHEN id % 3 = 0 THEN (thing_id + 1) % 10 ELSE thing_id END AS thing_id FROM datastream""")
def mut_17(t):
    streams = t.datastreams()
    pairs = streams.where(F.col("id") % 3 == 0).select("id", ((F.col("thing_id") + 1) % 10).alias("parent_id"))
    return mutations.relink(streams, pairs, "thing_id").select("id", "thing_id")


# -- deletes ---------------------------------------------------------------------------------


def sizes(state, names):
    counts = [
        state.table(n).agg(F.lit(n).alias("table_name"), F.count("*").alias("n")) for n in names
    ]
    total = counts[0]
    for c in counts[1:]:
        total = total.unionByName(c)
    return total


@query("mut_18_cascade_delete", """
SELECT 'thing' AS table_name, count(*) AS n FROM thing WHERE id % 5 <> 0
UNION ALL SELECT 'datastream', count(*) FROM datastream WHERE thing_id % 5 <> 0
UNION ALL SELECT 'observation', count(*) FROM observation WHERE user_id % 5 <> 0
UNION ALL SELECT 'thing_location', count(*) FROM thing_location WHERE thing_id % 5 <> 0
UNION ALL SELECT 'historical_location', count(*) FROM historical_location WHERE thing_id % 5 <> 0
UNION ALL SELECT 'location_historical_location', count(*) FROM historical_location WHERE thing_id % 5 <> 0""")
def mut_18(t):
    catalog = t.catalog()
    gone = catalog.table("thing").where(F.col("id") % 5 == 0)
    state = mutations.delete(catalog, "Thing", gone)
    names = ("thing", "datastream", "observation", "thing_location", "historical_location", "location_historical_location")
    return sizes(state, names)


@query("mut_18_cascade_sensor", """
SELECT 'sensor' AS table_name, count(*) AS n FROM sensor WHERE id <> 4
UNION ALL SELECT 'datastream', count(*) FROM datastream WHERE sensor_id <> 4
UNION ALL SELECT 'observation', count(*) FROM observation WHERE user_id % 10 <> 4""")
def mut_18_sensor(t):
    catalog = t.catalog()
    state = mutations.delete(catalog, "Sensor", catalog.table("sensor").where(F.col("id") == 4))
    return sizes(state, ("sensor", "datastream", "observation"))


@query("mut_19_location_delete", """
WITH gone AS (SELECT DISTINCT thing_id FROM thing_location WHERE location_id IN (3, 8))
SELECT 'location' AS table_name, count(*) AS n FROM place WHERE id NOT IN (3, 8)
UNION ALL SELECT 'thing_location', count(*) FROM thing_location WHERE location_id NOT IN (3, 8)
UNION ALL SELECT 'historical_location', count(*) FROM historical_location WHERE thing_id NOT IN (SELECT thing_id FROM gone)
UNION ALL SELECT 'location_historical_location', count(*) FROM historical_location
  WHERE location_id NOT IN (3, 8) AND thing_id NOT IN (SELECT thing_id FROM gone)""")
def mut_19(t):
    catalog = t.catalog()
    state = mutations.delete(catalog, "Location", catalog.table("location").where(F.col("id").isin(3, 8)))
    return sizes(state, ("location", "thing_location", "historical_location", "location_historical_location"))


@query("mut_20_filtered_delete", extent_sql("NOT (o.result_number < 10 AND d.description = 'click')"))
def mut_20(t):
    state, _ = mutations.delete_where(
        t.catalog("intervals"),
        lambda r: P.lt(r("result"), 10) & P.eq(r("Datastream/description"), "click"),
    )
    return state.table("datastream").select("id", *extent_columns())


@query("mut_20_deleted_count", """
SELECT count(*) AS deleted FROM observation WHERE result_number < 10 AND event_type = 'click'""")
def mut_20_count(t):
    _, lost = mutations.delete_where(
        t.catalog(), lambda r: P.lt(r("result"), 10) & P.eq(r("Datastream/description"), "click")
    )
    return lost.agg(F.count("*").alias("deleted"))


@query("mut_21_feature_delete", """
SELECT d.id, epoch_us(min(o.phenomenon_start)) AS phenomenon_start, epoch_us(max(o.interval_end)) AS phenomenon_end,
       min(p.lon) AS xmin, max(p.lat) AS ymax
FROM datastream d LEFT JOIN (SELECT * FROM observation WHERE id % 25 NOT IN (3, 24)) o ON o.datastream_id = d.id
LEFT JOIN place p ON p.id = o.id % 25 GROUP BY d.id""")
def mut_21(t):
    catalog = t.catalog("intervals")
    obs = catalog.table("observation").withColumn("feature_of_interest_id", F.col("id") % 25)
    features = catalog.table("feature_of_interest")
    streams = maintain.set_area(catalog.table("datastream"), maintain.observed_area(obs, features))
    gone = features.where(F.col("id").isin(3, 24))
    state = mutations.delete(catalog.replace(observation=obs, datastream=streams), "FeatureOfInterest", gone)
    return state.table("datastream").select(
        "id", us("phenomenon_start").alias("phenomenon_start"), us("phenomenon_end").alias("phenomenon_end"),
        F.col("observed_area.xmin").alias("xmin"), F.col("observed_area.ymax").alias("ymax"),
    )


@query("mut_22_observation_delete", extent_sql("o.id % 6 <> 0"))
def mut_22(t):
    catalog = t.catalog("intervals")
    state = mutations.delete(catalog, "Observation", catalog.table("observation").where(F.col("id") % 6 == 0))
    return state.table("datastream").select("id", *extent_columns())


def summarised(t):
    """The stored catalog with its summaries written, as a run before the delete left them."""
    catalog = t.catalog("intervals")
    path = scratch_path(t.spark, "summaries")
    made = summaries.summarise(catalog.table("observation"), catalog.table("feature_of_interest"))
    made.write.parquet(path)
    return catalog.replace(**{summaries.TABLE: t.spark.read.schema(made.schema).parquet(path)})


@query("mut_20_delete_by_summaries", extent_sql("NOT (o.result_number < 10 AND d.description = 'click')"))
def mut_20_summaries(t):
    state, _ = summaries.delete_where(
        summarised(t), lambda r: P.lt(r("result"), 10) & P.eq(r("Datastream/description"), "click"))
    touched = state.table("datastream").where("description = 'click'")
    # Datastreams that lost nothing keep what is stored; their extents come from their summaries.
    rest = summaries.derived(state.table(summaries.TABLE)).withColumnRenamed("datastream_id", "id").join(touched, "id", "left_anti")
    return touched.select("id", *extent_columns()).unionByName(rest.select("id", *extent_columns()))


@query("mut_21_delete_by_summaries", """
SELECT d.id, epoch_us(min(o.phenomenon_start)) AS phenomenon_start, epoch_us(max(o.interval_end)) AS phenomenon_end,
       min(p.lon) AS xmin, max(p.lat) AS ymax, count(o.id) AS n
FROM datastream d LEFT JOIN (SELECT * FROM observation WHERE id % 25 NOT IN (3, 24)) o ON o.datastream_id = d.id
LEFT JOIN place p ON p.id = o.id % 25 GROUP BY d.id""")
def mut_21_summaries(t):
    catalog = t.catalog("intervals")
    obs = catalog.table("observation").withColumn("feature_of_interest_id", F.col("id") % 25)
    features = catalog.table("feature_of_interest")
    streams = maintain.set_area(catalog.table("datastream"), maintain.observed_area(obs, features))
    state = summaries.with_summaries(catalog.replace(observation=obs, datastream=streams))
    after = summaries.delete_features(state, features.where(F.col("id").isin(3, 24)))
    n = after.table(summaries.TABLE).groupBy(F.col("datastream_id").alias("id")).agg(F.sum("n").alias("n"))
    return after.table("datastream").join(n, "id", "left").select(
        "id", us("phenomenon_start").alias("phenomenon_start"), us("phenomenon_end").alias("phenomenon_end"),
        F.col("observed_area.xmin").alias("xmin"), F.col("observed_area.ymax").alias("ymax"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


@query("agg_12_summaries_after_insert", """
SELECT datastream_id, count(*) AS n, epoch_us(min(phenomenon_start)) AS lo, epoch_us(max(interval_end)) AS hi
FROM observation GROUP BY datastream_id""")
def agg_12_summaries(t):
    """Summaries of seven tenths of the readings, the rest merged in."""
    catalog = t.catalog("intervals")
    obs = catalog.table("observation")
    early = summaries.with_summaries(catalog.replace(observation=obs.where("id % 10 < 7")))
    state = summaries.add_to_summaries(early, obs.where("id % 10 >= 7"))
    return state.table(summaries.TABLE).groupBy("datastream_id").agg(
        F.sum("n").alias("n"), us(F.min("phenomenon_start")).alias("lo"), us(F.max("phenomenon_end")).alias("hi"))


@query("agg_04_estimate_by_sketches", """
SELECT event_type, count(*) AS exact, TRUE AS close_enough FROM observation GROUP BY event_type""")
def agg_04_sketches(t):
    """Counts from stored sketches of each chunk, within five percent of the exact ones."""
    path = scratch_path(t.spark, "sketches")
    made = summaries.sketches(t.observations(), "event_type")
    made.write.parquet(path)
    found = summaries.estimate(t.spark.read.schema(made.schema).parquet(path), "event_type")
    exact = t.observations().groupBy("event_type").agg(F.count("*").alias("exact"))
    return found.join(exact, "event_type").select(
        "event_type", "exact", (F.abs(F.col("count") - F.col("exact")) <= F.greatest(F.lit(2.0), 0.05 * F.col("exact"))).alias("close_enough"))


@query("mut_22_current_state", "SELECT count(*) AS n FROM observation WHERE id % 6 <> 0")
def mut_22_state(t):
    catalog = t.catalog()
    state = mutations.delete(catalog, "Observation", catalog.table("observation").where(F.col("id") % 6 == 0))
    return Query.on(state, "Observations").count_total().withColumnRenamed("count", "n")
