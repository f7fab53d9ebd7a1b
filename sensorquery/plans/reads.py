"""Queries for scans, projections, filters, relations, counts, order, paging and output forms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from sensorquery.functions import geometry, render
from sensorquery.functions import predicates as P
from sensorquery.functions.values import Interval
from sensorquery.operators import series, versions
from sensorquery.operators.query import Expand, Query, filter_rows
from sensorquery.plans.registry import query
from sensorquery.plans.testbed import BASE, Testbed
from sensorquery.session import scratch_path
from sensorquery.sources import sinks

# Fixed instants of the queries, inside the range of the events and orders.
T = "2024-01-15T12:00:00Z"
T1, T2 = "1997-01-01T00:00:00Z", "1998-01-01T00:00:00Z"
us = F.unix_micros


def on(t: Testbed, name: str, kind: str = "instants", **options) -> Query:
    return Query.on(t.catalog(kind, **options), name, BASE)


# -- scans -----------------------------------------------------------------------------------


@query("src_01_table_scan", "SELECT id, name, description, properties FROM thing")
def src_01(t):
    return t.catalog().table("thing")


@query("src_02_traveltime", """
SELECT id, description, epoch_us(valid_from) AS valid_from, epoch_us(valid_to) AS valid_to, commit_id
FROM thing_version""")
def src_02(t):
    rows = t.thing_versions()
    still_open = F.col("valid_to").isNull()
    # Current rows, history rows, and a repeated half that the union has to drop.
    catalog = t.catalog().replace(thing=rows.where(still_open | (F.col("id") % 2 == 0)))
    catalog = catalog._with(history={"thing": rows.where(~still_open)})
    return catalog.traveltime("thing").select(
        "id", "description", us("valid_from").alias("valid_from"), us("valid_to").alias("valid_to"),
        "commit_id",
    )


# -- projections -----------------------------------------------------------------------------


@query("prj_01_select", """
SELECT id AS "@iot.id", name, sensor_metadata AS metadata FROM sensor""")
def prj_01(t):
    return on(t, "Sensors").select("id", "name", "metadata").projected()


@query("prj_02_default_select", """
SELECT id AS "@iot.id", 'http://localhost/v1.1/Networks(' || id || ')' AS "@iot.selfLink",
       'http://localhost/v1.1/Networks(' || id || ')/Datastreams' AS "Datastreams@iot.navigationLink", name
FROM network""")
def prj_02(t):
    return on(t, "Networks").projected()


@query("prj_03_json_path", """
SELECT id AS "@iot.id", properties->>'$.nation.key' AS "properties/nation/key",
       properties->>'$.segment' AS "properties/segment" FROM thing""")
def prj_03(t):
    return on(t, "Things").select("id", "properties/nation/key", "properties/segment").projected()


@query("prj_04_navigation_select", """
SELECT id AS "@iot.id", 'http://localhost/v1.1/Things(' || id || ')/Datastreams' AS "Datastreams@iot.navigationLink"
FROM thing""")
def prj_04(t):
    return on(t, "Things").select("id", "Datastreams").projected()


@query("prj_05_links", """
SELECT id, '/Observations(' || id || ')' AS self_link,
       '/Observations(' || id || ')/Datastream' AS datastream_link,
       '/Observations(' || id || ')/FeatureOfInterest' AS feature_link
FROM observation""")
def prj_05(t):
    key = F.col("id")
    return t.observations().select(
        "id", render.self_link("observation", key).alias("self_link"),
        render.nav_link("observation", "Datastream", key).alias("datastream_link"),
        render.nav_link("observation", "FeatureOfInterest", key).alias("feature_link"),
    )


@query("prj_06_commit_links", """
SELECT id, CASE WHEN id IN (SELECT commit_id FROM thing_version WHERE valid_to IS NULL)
                THEN '/Commits(' || id || ')/Things' END AS "Things@iot.navigationLink",
       CASE WHEN id IN (SELECT id * 3 FROM sensor) THEN '/Commits(' || id || ')/Sensors' END
         AS "Sensors@iot.navigationLink"
FROM commit_log""")
def prj_06(t):
    catalog = t.catalog(versioned=True)
    sensors = catalog.table("sensor").withColumn("commit_id", F.col("id") * 3)
    linked = versions.commit_links(
        catalog.table("commit_log"), {"thing": catalog.table("thing"), "sensor": sensors}
    )
    return linked.select("id", "`Things@iot.navigationLink`", "`Sensors@iot.navigationLink`")


@query("prj_07_time_text", """
SELECT id, CASE WHEN phenomenon_start = interval_end THEN strftime(phenomenon_start, '%Y-%m-%dT%H:%M:%SZ')
            ELSE strftime(phenomenon_start, '%Y-%m-%dT%H:%M:%SZ') || '/' || strftime(interval_end, '%Y-%m-%dT%H:%M:%SZ') END
            AS "phenomenonTime",
       strftime(result_time, '%Y-%m-%dT%H:%M:%SZ') AS "resultTime",
       strftime(valid_start, '%Y-%m-%dT%H:%M:%SZ') || '/' || strftime(valid_end, '%Y-%m-%dT%H:%M:%SZ') AS "validTime"
FROM observation""")
def prj_07(t):
    q = on(t, "Observations", "intervals").select("id", "phenomenonTime", "resultTime", "validTime")
    return q.projected().withColumnRenamed("@iot.id", "id")


@query("prj_07_validity_text", """
SELECT id, strftime(valid_from, '%Y-%m-%dT%H:%M:%SZ') || '/' ||
       coalesce(strftime(valid_to, '%Y-%m-%dT%H:%M:%SZ'), 'infinity') AS validity
FROM thing_version""")
def prj_07_validity(t):
    span = Interval(F.col("valid_from"), F.col("valid_to"), "validity")
    return t.thing_versions().select("id", render.interval_text(span).alias("validity"))


@query("prj_08_result_json", """
SELECT id, CASE mixed_type WHEN 0 THEN CASE WHEN result_number = floor(result_number)
                                            THEN CAST(CAST(result_number AS BIGINT) AS VARCHAR)
                                            ELSE CAST(result_number AS VARCHAR) END
                WHEN 1 THEN CASE WHEN result_number > 50 THEN 'true' ELSE 'false' END
                WHEN 2 THEN parameters ELSE '"' || event_type || '"' END AS result
FROM observation""")
def prj_08(t):
    return on(t, "Observations", "mixed").select("id", "result").projected().withColumnRenamed("@iot.id", "id")


@query("prj_09_geojson", """
SELECT id, '{"type":"Point","coordinates":[' || lon || ',' || lat || ']}' AS location FROM place""")
def prj_09(t):
    return on(t, "Locations").select("id", "location").projected().withColumnRenamed("@iot.id", "id")


@query("prj_10_output_names", """
SELECT id AS "@iot.id", sensor_metadata AS metadata, 'application/pdf' AS "encodingType" FROM sensor""")
def prj_10(t):
    return on(t, "Sensors").select("id", "metadata", "encodingType").projected()


@query("prj_11_as_of_stamp", """
SELECT id AS "@iot.id", description, '1997-01-01T00:00:00+00:00' AS "@iot.as_of",
       'http://localhost/v1.1/Things(' || id || ')/Datastreams?$as_of=1997-01-01T00:00:00+00:00'
         AS "Datastreams@iot.navigationLink"
FROM thing_version
WHERE valid_from <= TIMESTAMP '1997-01-01' AND (valid_to IS NULL OR valid_to > TIMESTAMP '1997-01-01')""")
def prj_11(t):
    q = on(t, "Things", versioned=True).as_of(T1)
    return q.select("id", "description", "Datastreams").projected()


# -- filters ---------------------------------------------------------------------------------


@query("flt_01_compare", """
SELECT id, name = 'Customer#000000007' AS is_eq, name <> 'Customer#000000007' AS is_ne,
       name > 'Customer#000000500' AS is_gt, name >= 'Customer#000000500' AS is_ge,
       id < 100 AS is_lt, id <= 100 AS is_le, name = 'customer#000000007' AS is_other_case FROM thing""")
def flt_01(t):
    name, key = F.col("name"), F.col("id")
    return t.things().select(
        "id", P.eq(name, "Customer#000000007").alias("is_eq"),
        P.ne(name, "Customer#000000007").alias("is_ne"), P.gt(name, "Customer#000000500").alias("is_gt"),
        P.ge(name, "Customer#000000500").alias("is_ge"),
        P.lt(key, 100).alias("is_lt"), P.ge(100, key).alias("is_le"),
        P.eq(name, "customer#000000007").alias("is_other_case"),
    )


@query("flt_02_logic", """
SELECT id FROM observation
WHERE (result_number > 50 OR result_number < 2) AND NOT (event_type = 'view')""")
def flt_02(t):
    q = on(t, "Observations").filter(
        lambda r: (P.gt(r("result"), 50) | P.lt(r("result"), 2)) & ~P.eq(F.col("event_type"), "view")
    )
    return q.rows().select("id")


@query("flt_03_in", """
SELECT id FROM datastream WHERE description IN ('click', 'error')""")
def flt_03(t):
    return on(t, "Datastreams").filter(lambda r: P.in_(r("description"), ["click", "error"])).rows().select("id")


@query("flt_03_result_in", """
SELECT id FROM observation WHERE (mixed_type = 0 AND result_number IN (6.55, 12.31))
   OR (mixed_type = 3 AND event_type = 'view') OR (mixed_type = 1 AND result_number > 50)""")
def flt_03_result(t):
    q = on(t, "Observations", "mixed").filter(lambda r: P.in_(r("result"), [6.55, 12.31, "view", True]))
    return q.rows().select("id")


@query("flt_04_null", """
SELECT id, result_time IS NULL AS no_result_time, valid_start IS NOT NULL AS has_valid,
       FALSE AS no_time FROM observation""")
def flt_04(t):
    valid = Interval(F.col("valid_start"), F.col("valid_end"), "range")
    time = Interval(F.col("phenomenon_start"), F.col("phenomenon_end"))
    return t.observations().select(
        "id", P.eq(F.col("result_time"), None).alias("no_result_time"),
        P.ne(valid, None).alias("has_valid"), P.is_null(time).alias("no_time"),
    )


@query("flt_05_arithmetic", """
SELECT id FROM observation
WHERE result_number + 1 > 20 AND result_number - 1 < 300 AND result_number * 2 <= 400
  AND result_number / 2 >= 12 AND result_number % 2 < 1 AND -result_number < -5""")
def flt_05(t):
    def wanted(r):
        x = r("result")
        return (
            P.gt(P.add(x, 1), 20) & P.lt(P.sub(x, 1), 300) & P.le(P.mul(x, 2), 400)
            & P.ge(P.div(x, 2), 12) & P.lt(P.mod(x, 2), 1) & P.lt(P.neg(x), -5)
        )

    return on(t, "Observations").filter(wanted).rows().select("id")


@query("flt_06_mixed_result", """
SELECT id, coalesce(CASE WHEN mixed_type = 3 THEN event_type = 'click'
                         WHEN mixed_type = 1 THEN FALSE END, FALSE)
        OR FALSE AS is_click,
       mixed_type = 0 AND result_number > 50 AS above,
       mixed_type = 1 AND result_number > 50 AS is_true,
       mixed_type = 0 AND result_number = 7 AS is_seven_text FROM observation""")
def flt_06(t):
    rows = t.observations("mixed")
    r = render.property_value("observation", "result", F.col)

    def sure(test):
        return F.coalesce(test, F.lit(False))

    return rows.select(
        "id", sure(P.eq(r, "click")).alias("is_click"), sure(P.gt(r, 50)).alias("above"),
        sure(P.eq(r, True)).alias("is_true"), sure(P.eq(r, "7")).alias("is_seven_text"),
    )


_INSTANT = "TIMESTAMP '2024-01-15 12:00:00'"


@query("flt_07_time_compare", f"""
SELECT id, (phenomenon_start <= {_INSTANT} AND interval_end >= {_INSTANT}) AS is_eq,
       NOT (phenomenon_start <= {_INSTANT} AND interval_end >= {_INSTANT}) AS is_ne,
       phenomenon_start > {_INSTANT} AS is_gt, phenomenon_start >= {_INSTANT} AS is_ge,
       interval_end < {_INSTANT} AS is_lt, interval_end <= {_INSTANT} AS is_le FROM observation""")
def flt_07(t):
    x = Interval(F.col("phenomenon_start"), F.col("phenomenon_end"))
    tests = {"is_eq": P.eq, "is_ne": P.ne, "is_gt": P.gt, "is_ge": P.ge, "is_lt": P.lt, "is_le": P.le}
    return t.observations("intervals").select("id", *[f(x, T).alias(n) for n, f in tests.items()])


@query("flt_07_datastream_time", f"""
SELECT id FROM datastream WHERE phenomenon_start <= {_INSTANT} AND phenomenon_end >= {_INSTANT}""")
def flt_07_datastream(t):
    return on(t, "Datastreams").filter(lambda r: P.eq(r("phenomenonTime"), T)).rows().select("id")


@query("flt_08_literal_left", f"""
SELECT id FROM observation WHERE phenomenon_start >= {_INSTANT} AND result_number > 20""")
def flt_08(t):
    q = on(t, "Observations").filter(lambda r: P.le(T, r("phenomenonTime")) & P.lt(20, r("result")))
    return q.rows().select("id")


@query("flt_09_bounds", f"""
SELECT id FROM observation
WHERE interval_end >= {_INSTANT} AND phenomenon_start < TIMESTAMP '2024-01-16'""")
def flt_09(t):
    q = on(t, "Observations", "intervals").filter(
        lambda r: P.ge(r("phenomenonTime").upper, T) & P.lt(r("phenomenonTime").lower, "2024-01-16T00:00:00Z")
    )
    return q.rows().select("id")


@query("flt_10_range_order", f"""
SELECT id, valid_start = {_INSTANT} AND valid_end = {_INSTANT} AS is_eq,
       valid_start > {_INSTANT} OR (valid_start = {_INSTANT} AND valid_end > {_INSTANT}) AS is_gt,
       valid_start < {_INSTANT} OR (valid_start = {_INSTANT} AND valid_end < {_INSTANT}) AS is_lt
FROM observation""")
def flt_10(t):
    x = Interval(F.col("valid_start"), F.col("valid_end"), "range")
    return t.observations().select(
        "id", P.eq(x, T).alias("is_eq"), P.gt(x, T).alias("is_gt"), P.lt(x, T).alias("is_lt")
    )


@query("flt_11_validity", """
SELECT id, commit_id,
  valid_from <= TIMESTAMP '1997-01-01' AND (valid_to IS NULL OR valid_to > TIMESTAMP '1997-01-01') AS at,
  valid_from < TIMESTAMP '1998-01-01' AND (valid_to IS NULL OR valid_to > TIMESTAMP '1997-01-01') AS overlaps,
  NOT (valid_from <= TIMESTAMP '1997-01-01' AND (valid_to IS NULL OR valid_to > TIMESTAMP '1997-01-01')) AS not_at,
  FALSE AS empty_span
FROM thing_version""")
def flt_11(t):
    x = Interval(F.col("valid_from"), F.col("valid_to"), "validity")
    return t.thing_versions().select(
        "id", "commit_id", P.eq(x, T1).alias("at"), P.eq(x, (T1, T2)).alias("overlaps"),
        P.ne(x, T1).alias("not_at"), P.eq(x, (T1, T1)).alias("empty_span"),
    )


@query("flt_12_json_member", """
SELECT id, properties->>'$.segment' = 'BUILDING' AS is_building,
       CAST(properties->>'$.nation.key' AS DOUBLE) >= 20 AS high_key,
       (properties->>'$.absent') IS NULL AS no_member FROM thing""")
def flt_12(t):
    doc = F.col("properties")
    return t.things().select(
        "id", P.json_eq(doc, "segment", "BUILDING").alias("is_building"),
        P.json_compare("ge", doc, "nation/key", 20).alias("high_key"),
        P.json_compare("eq", doc, "absent", None).alias("no_member"),
    )


@query("flt_13_any", """
SELECT id FROM datastream d
WHERE EXISTS (SELECT 1 FROM observation o WHERE o.datastream_id = d.id AND o.result_number > 100)""")
def flt_13_any(t):
    return on(t, "Datastreams").where_any("Observations", lambda r: P.gt(r("result"), 100)).rows().select("id")


@query("flt_13_all", """
SELECT id FROM datastream d
WHERE NOT EXISTS (SELECT 1 FROM observation o WHERE o.datastream_id = d.id AND NOT (o.result_number < 100))""")
def flt_13_all(t):
    return on(t, "Datastreams").where_all("Observations", lambda r: P.lt(r("result"), 100)).rows().select("id")


@query("flt_14_by_id", "SELECT id, name FROM thing WHERE id = 17")
def flt_14(t):
    return on(t, "Things").by_id(17).rows().select("id", "name")


@query("flt_15_shifted_time", f"""
SELECT id FROM observation
WHERE phenomenon_start + INTERVAL 1 DAY + INTERVAL 2 HOUR > {_INSTANT}
  AND phenomenon_start - INTERVAL 1 MONTH < TIMESTAMP '2023-12-20'""")
def flt_15(t):
    def wanted(r):
        start = r("phenomenonTime").lower
        return P.gt(P.shift(start, days=1, hours=2), T) & P.lt(
            P.shift(start, months=1, sign=-1), "2023-12-20T00:00:00Z"
        )

    return on(t, "Observations").filter(wanted).rows().select("id")


@query("flt_16_literals", """
SELECT id FROM observation
WHERE result_time >= TIMESTAMP '2024-01-15 10:00:00' AND result_number >= 5""")
def flt_16(t):
    q = on(t, "Observations").filter(
        lambda r: P.ge(r("resultTime"), "2024-01-15T12:00:00+02:00") & P.ge(r("result"), 5)
    )
    return q.rows().select("id")


@query("flt_17_geometry_type", "SELECT id FROM place")
def flt_17(t):
    return on(t, "FeaturesOfInterest").filter(lambda r: P.eq(r("feature/type"), "Point")).rows().select("id")


@query("flt_17_mixed_geometry_types", """
SELECT id, CASE id % 3 WHEN 0 THEN 'Point' WHEN 1 THEN 'LineString' ELSE 'Polygon' END AS kind FROM place WHERE id % 3 <> 2""")
def flt_17_mixed(t):
    """Features of three geometry types, of which two are asked for."""
    key = F.col("id").cast("string")
    line = F.concat(F.lit('{"type":"LineString","coordinates":[[0,0],[1,'), key, F.lit("]]}"))
    ring = F.concat(F.lit('{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,'), key, F.lit("],[0,0]]]}"))
    catalog = t.catalog()
    features = catalog.table("feature_of_interest")
    mixed = features.withColumn("feature", F.when(F.col("id") % 3 == 1, geometry.from_geojson(line)).when(
        F.col("id") % 3 == 2, geometry.from_geojson(ring)).otherwise(F.col("feature")))
    found = Query.on(catalog.replace(feature_of_interest=mixed), "FeaturesOfInterest").filter(
        lambda r: P.eq(r("feature/type"), "Point") | P.eq(r("feature/type"), "LineString")).rows()
    return found.select("id", F.col("feature.type").alias("kind"))


# -- relations -------------------------------------------------------------------------------


@query("jn_01_to_one_path", """
SELECT o.id FROM observation o JOIN datastream d ON o.datastream_id = d.id
WHERE d.name = 'ds-42' OR d.description = 'error'""")
def jn_01(t):
    q = on(t, "Observations").filter(
        lambda r: P.eq(r("Datastream/name"), "ds-42") | P.eq(r("Datastream/description"), "error")
    )
    return q.rows().select("id")


@query("jn_02_to_many_path", """
SELECT id, name FROM thing t
WHERE EXISTS (SELECT 1 FROM datastream d WHERE d.thing_id = t.id AND d.description = 'purchase')""")
def jn_02(t):
    q = on(t, "Things").filter(lambda r: P.eq(r("Datastreams/description"), "purchase"))
    return q.rows().select("id", "name")


@query("jn_02_link_path", """
SELECT id FROM thing t WHERE EXISTS (
  SELECT 1 FROM thing_location l JOIN place p ON l.location_id = p.id
  WHERE l.thing_id = t.id AND p.name IN ('NATION_3', 'NATION_4'))""")
def jn_02_link(t):
    q = on(t, "Things").filter(lambda r: P.in_(r("Locations/name"), ["NATION_3", "NATION_4"]))
    return q.rows().select("id")


@query("jn_03_multi_hop", """
SELECT o.id FROM observation o JOIN datastream d ON o.datastream_id = d.id
JOIN thing t ON d.thing_id = t.id JOIN sensor s ON d.sensor_id = s.id
WHERE t.segment = 'BUILDING' AND s.name < 'Supplier#000000005' AND o.result_number > 10""")
def jn_03(t):
    q = on(t, "Observations").filter(
        lambda r: P.json_eq(r("Datastream/Thing/properties"), "segment", "BUILDING")
        & P.lt(r("Datastream/Sensor/name"), "Supplier#000000005") & P.gt(r("result"), 10)
    )
    return q.rows().select("id")


@query("jn_04_navigate", """
SELECT o.id FROM observation o JOIN datastream d ON o.datastream_id = d.id
WHERE d.thing_id = 3 AND d.id = 19""")
def jn_04(t):
    return on(t, "Things").by_id(3).navigate("Datastreams", 19).navigate("Observations").rows().select("id")


@query("jn_04_navigate_link", """
SELECT DISTINCT t.id FROM place p JOIN thing_location l ON l.location_id = p.id
JOIN thing t ON t.id = l.thing_id WHERE p.id = 5""")
def jn_04_link(t):
    return on(t, "Locations").by_id(5).navigate("Things").rows().select("id")


@query("jn_04_navigate_to_one", """
SELECT s.id, s.name FROM datastream d JOIN sensor s ON d.sensor_id = s.id WHERE d.id = 42""")
def jn_04_one(t):
    return on(t, "Datastreams").by_id(42).navigate("Sensor").rows().select("id", "name")


@query("jn_05_expand_to_one", """
SELECT d.id, '{"@iot.id":' || s.id || ',"name":"' || s.name || '"}' AS sensor
FROM datastream d LEFT JOIN sensor s ON d.sensor_id = s.id""")
def jn_05(t):
    q = on(t, "Datastreams").select("id").expand(Expand("Sensor", select=("id", "name")))
    return q.all_documents().select("id", F.get_json_object("json", "$.Sensor").alias("sensor"))


_TOP_CHILDREN = """
SELECT datastream_id AS parent_id, rn - {skip} AS rn, id, total FROM (
  SELECT *, row_number() OVER (PARTITION BY datastream_id ORDER BY phenomenon_start DESC, id) AS rn,
         count(*) OVER (PARTITION BY datastream_id) AS total
  FROM observation WHERE result_number > 5) WHERE rn > {skip} AND rn <= {skip} + {top}"""


@query("jn_06_expand_to_many", _TOP_CHILDREN.format(skip=2, top=3))
def jn_06(t):
    option = Expand(
        "Observations", filter=lambda r: P.gt(r("result"), 5), order=("phenomenonTime desc",),
        skip=2, top=3, count=True,
    )
    return on(t, "Datastreams").expand_rows(option).select("parent_id", "rn", "id", "total")


@query("jn_06_expand_documents", """
SELECT d.id, coalesce(string_agg(o.id, ',' ORDER BY rn) FILTER (rn <= 2), '') AS children,
       coalesce(max(total), 0) AS total, coalesce(max(rn) > 2, FALSE) AS more
FROM datastream d LEFT JOIN (
  SELECT id, datastream_id, row_number() OVER (PARTITION BY datastream_id ORDER BY phenomenon_start DESC, id) AS rn,
         count(*) OVER (PARTITION BY datastream_id) AS total
  FROM observation WHERE result_number > 60) o ON o.datastream_id = d.id
GROUP BY d.id""")
def jn_06_documents(t):
    option = Expand(
        "Observations", filter=lambda r: P.gt(r("result"), 60), order=("phenomenonTime desc",),
        select=("id",), top=2, count=True,
    )
    docs = on(t, "Datastreams").select("id").expand(option).all_documents()
    children = F.from_json(F.get_json_object("json", "$.Observations"), "array<struct<`@iot.id`:long>>")
    return docs.select(
        "id", F.array_join(F.transform(children, lambda c: c["@iot.id"].cast("string")), ",").alias("children"),
        F.get_json_object("json", "$['Observations@iot.count']").cast("long").alias("total"),
        F.get_json_object("json", "$['Observations@iot.nextLink']").isNotNull().alias("more"),
    )


@query("jn_06_all_children", """
SELECT thing_id AS parent_id, o.id, result_number FROM observation o JOIN datastream d ON o.datastream_id = d.id
WHERE result_number > 1""")
def jn_06_all(t):
    # Every reading of every datastream, far more than a page holds, as rows.
    option = Expand("Observations", filter=lambda r: P.gt(r("result"), 1))
    rows = on(t, "Datastreams").children(option).select(F.col("parent_id").alias("datastream"), "id", "result_number")
    owners = t.datastreams().select(F.col("id").alias("datastream"), F.col("thing_id").alias("parent_id"))
    return rows.join(owners, "datastream").select("parent_id", "id", "result_number")


@query("jn_07_expand_link", """
SELECT thing_id AS parent_id, rn, id, name, total FROM (
  SELECT l.thing_id, p.id, p.name, row_number() OVER (PARTITION BY l.thing_id ORDER BY p.name DESC, p.id) AS rn,
         count(*) OVER (PARTITION BY l.thing_id) AS total
  FROM thing_location l JOIN place p ON l.location_id = p.id) WHERE rn <= 1""")
def jn_07(t):
    option = Expand("Locations", order=("name desc",), top=1, count=True)
    return on(t, "Things").expand_rows(option).select("parent_id", "rn", "id", "name", "total")


@query("jn_08_nested_expand", """
SELECT t.id AS thing, d.id AS datastream, coalesce(string_agg(o.id, ',' ORDER BY o.rn), '') AS readings
FROM thing t JOIN datastream d ON d.thing_id = t.id LEFT JOIN (
  SELECT id, datastream_id, row_number() OVER (PARTITION BY datastream_id ORDER BY result_number DESC, id) AS rn
  FROM observation WHERE phenomenon_start >= TIMESTAMP '2024-01-15 12:00:00') o
  ON o.datastream_id = d.id AND o.rn <= 2
WHERE d.description = 'click' GROUP BY t.id, d.id""")
def jn_08(t):
    readings = Expand(
        "Observations", filter=lambda r: P.ge(r("phenomenonTime"), T), order=("result desc",),
        select=("id",), top=2,
    )
    streams = Expand(
        "Datastreams", filter=lambda r: P.eq(r("description"), "click"), select=("id",), top=10, expand=(readings,)
    )
    docs = on(t, "Things").select("id").expand(streams).all_documents()
    layout = "array<struct<`@iot.id`:long,Observations:array<struct<`@iot.id`:long>>>>"
    rows = docs.select("id", F.explode(F.from_json(F.get_json_object("json", "$.Datastreams"), layout)).alias("d"))
    ids = F.transform("d.Observations", lambda o: o["@iot.id"].cast("string"))
    return rows.select(
        F.col("id").alias("thing"), F.col("d.`@iot.id`").alias("datastream"),
        F.array_join(ids, ",").alias("readings"),
    )


@query("jn_09_as_of_expand", """
SELECT d.id, v.description AS state
FROM datastream d LEFT JOIN (SELECT * FROM thing_version
  WHERE valid_from <= TIMESTAMP '1997-01-01' AND (valid_to IS NULL OR valid_to > TIMESTAMP '1997-01-01')) v
  ON v.id = d.thing_id""")
def jn_09(t):
    q = on(t, "Datastreams", versioned=True).as_of(T1).select("id").expand(Expand("Thing", select=("description",)))
    return q.all_documents().select("id", F.get_json_object("json", "$.Thing.description").alias("state"))


@query("jn_10_span_expand_commit", """
SELECT v.id, c.author, c.message FROM thing_version v LEFT JOIN commit_log c ON v.commit_id = c.id
WHERE valid_from < TIMESTAMP '1998-01-01' AND (valid_to IS NULL OR valid_to > TIMESTAMP '1997-01-01')""")
def jn_10(t):
    q = on(t, "Things", versioned=True).from_to(T1, T2).select("id")
    docs = q.expand(Expand("Commit", select=("author", "message"))).all_documents()
    return docs.select(
        "id", F.get_json_object("json", "$.Commit.author").alias("author"),
        F.get_json_object("json", "$.Commit.message").alias("message"),
    )


@query("jn_15_snapshot_join", """
SELECT o.id, v.description AS state, o.result_number
FROM observation o JOIN datastream d ON o.datastream_id = d.id JOIN thing_version v ON v.id = d.thing_id
WHERE valid_from <= TIMESTAMP '1998-01-01' AND (valid_to IS NULL OR valid_to > TIMESTAMP '1998-01-01')
  AND v.description = 'F'""")
def jn_15(t):
    catalog = t.catalog(versioned=True).as_of(T2)
    rows = catalog.table("observation").withColumn("thing_id", F.col("user_id"))
    things = catalog.table("thing").select(F.col("id").alias("thing_id"), F.col("description").alias("state"))
    return rows.join(things.where(F.col("state") == "F"), "thing_id").select("id", "state", "result_number")


# -- counts ----------------------------------------------------------------------------------


@query("agg_01_count", "SELECT count(*) AS count FROM observation WHERE result_number > 10")
def agg_01(t):
    return on(t, "Observations").filter(lambda r: P.gt(r("result"), 10)).top(2).skip(3).count_total()


@query("agg_02_version_count", """
SELECT count(*) AS count FROM thing_version
WHERE valid_from < TIMESTAMP '1998-01-01' AND (valid_to IS NULL OR valid_to > TIMESTAMP '1997-01-01')""")
def agg_02(t):
    return on(t, "Things", versioned=True).from_to(T1, T2).count_total()


@query("agg_03_capped_count", """
SELECT 'things' AS of, least(count(*), 100) AS count, count(*) > 100 AS capped FROM thing
UNION ALL SELECT 'sensors', least(count(*), 1000000), count(*) > 1000000 FROM sensor""")
def agg_03(t):
    things = on(t, "Things").count_capped(100).withColumn("of", F.lit("things"))
    return things.unionByName(on(t, "Sensors").count_capped(1_000_000).withColumn("of", F.lit("sensors")))


@query("agg_04_estimated_count", """
SELECT event_type, count(*) AS exact, TRUE AS close_enough FROM observation GROUP BY event_type""")
def agg_04(t):
    def both(kind):
        q = on(t, "Observations").filter(lambda r: P.eq(r("Datastream/description"), kind))
        rows = q.count_estimate().unionByName(q.count_total().withColumnRenamed("count", "exact"), allowMissingColumns=True)
        near = F.abs(F.max("count") - F.max("exact")) <= 0.1 * F.max("exact")
        return rows.agg(F.max("exact").alias("exact"), near.alias("close_enough")).withColumn("event_type", F.lit(kind))

    kinds = [both(kind) for kind in ("view", "click", "purchase", "signup", "error")]
    return reduce(lambda a, b: a.unionByName(b), kinds).where("exact > 0")


@query("agg_05_count_per_parent", """
SELECT d.id, count(o.id) AS total FROM datastream d
LEFT JOIN observation o ON o.datastream_id = d.id AND o.result_number > 60 GROUP BY d.id""")
def agg_05(t):
    option = Expand("Observations", filter=lambda r: P.gt(r("result"), 60), select=("id",), top=1, count=True)
    docs = on(t, "Datastreams").select("id").expand(option).all_documents()
    return docs.select("id", F.get_json_object("json", "$['Observations@iot.count']").cast("long").alias("total"))


# -- order and pages -------------------------------------------------------------------------


def placed(q: Query):
    """Every row of a query with its 0-based place in the order."""
    rows = q.rows()
    return series.global_positions(rows, q.sort_keys(rows), "rn").select("id", "rn")


@query("srt_01_order_by", """
SELECT id, row_number() OVER (ORDER BY result_quality DESC, result_time ASC NULLS LAST, id) - 1 AS rn FROM observation""")
def srt_01(t):
    return placed(on(t, "Observations").order_by("resultQuality desc", "resultTime"))


@query("srt_02_default_order", """
SELECT id, row_number() OVER (ORDER BY id, valid_from) - 1 AS rn FROM thing_version
WHERE valid_from < TIMESTAMP '1998-01-01' AND (valid_to IS NULL OR valid_to > TIMESTAMP '1997-01-01')""")
def srt_02(t):
    return placed(on(t, "Things", versioned=True).from_to(T1, T2))


@query("srt_03_order_by_result", """
SELECT id, rn FROM (SELECT id, row_number() OVER (ORDER BY
  CASE mixed_type WHEN 3 THEN 0 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 4 END,
  CASE WHEN mixed_type = 3 THEN event_type END, CASE WHEN mixed_type = 0 THEN result_number END,
  CASE WHEN mixed_type = 1 THEN result_number > 50 END, CASE WHEN mixed_type = 2 THEN parameters END, id) - 1 AS rn
FROM observation)""")
def srt_03(t):
    return placed(on(t, "Observations", "mixed").order_by("result"))


@query("srt_04_top_skip", "SELECT id, name FROM thing ORDER BY name LIMIT 50 OFFSET 25")
def srt_04(t):
    return on(t, "Things").order_by("name").top(50).skip(25).page_rows().select("id", "name")


@query("srt_05_page", """
SELECT count(*) AS n, min(id) AS first_id, max(id) AS last_id, 60 AS next_skip
FROM (SELECT id FROM thing ORDER BY id LIMIT 40 OFFSET 20)""")
def srt_05(t):
    rows, following = on(t, "Things").top(40).skip(20).page()
    seen = rows.agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))
    return seen.unionByName(following, allowMissingColumns=True).agg(
        *[F.max(c).alias(c) for c in ("n", "first_id", "last_id", "next_skip")]
    )


@query("srt_06_all_pages", """
SELECT id, (row_number() OVER (ORDER BY result_number DESC, id) - 1) // 128 AS page FROM observation""")
def srt_06(t):
    return on(t, "Observations").order_by("result desc").pages(128).select("id", "page")


@query("srt_06_keyset_walk", """
WITH s AS (SELECT id, row_number() OVER (ORDER BY result_time DESC NULLS FIRST, result_quality ASC NULLS LAST, id) - 1 AS rn
           FROM observation)
SELECT id, rn // ((SELECT count(*) FROM observation) // 4 + 1) AS page FROM s""")
def srt_06_keyset(t):
    """A whole walk in four pages over keys with nulls, in an order that descends first."""
    q = on(t, "Observations").order_by("resultTime desc", "resultQuality")
    size = q.count_total().first()["count"] // 4 + 1
    pages, seen = [], None
    for number in range(4):
        folder = scratch_path(t.spark, "page")
        q.page_after(seen, size).withColumn("page", F.lit(number)).write.parquet(folder)
        page = t.spark.read.parquet(folder)
        keys = [c for c in page.columns if c.startswith("_k")]
        order = [F.col("_k0").asc_nulls_last(), F.col("_k1").desc_nulls_first(), F.col("_k2").desc()]
        last = page.orderBy(*order).select(*keys).first()  # the last row seen
        pages.append(page.select("id", "page"))
        if last is None:
            break
        seen = last.asDict()
    return reduce(lambda a, b: a.unionByName(b), pages)


@query("srt_07_combination", """
SELECT id, result_number, total FROM (
  SELECT o.id, result_number, count(*) OVER () AS total FROM observation o
  JOIN datastream d ON o.datastream_id = d.id WHERE d.description = 'purchase' AND result_number > 30)
ORDER BY result_number DESC, id LIMIT 10 OFFSET 5""")
def srt_07(t):
    q = on(t, "Observations").filter(
        lambda r: P.eq(r("Datastream/description"), "purchase") & P.gt(r("result"), 30)
    )
    page = q.order_by("result desc").skip(5).top(10)
    total = page.count_total().first()["count"]
    return page.page_rows().select("id", "result_number", F.lit(total).alias("total"))


# -- output forms ----------------------------------------------------------------------------


@query("snk_01_page", """
SELECT count(*) OVER () AS total, id, name, 'http://localhost/v1.1/Sensors?$top=5&$skip=8' AS next_link
FROM sensor ORDER BY name DESC LIMIT 5 OFFSET 3""")
def snk_01(t):
    page = sinks.to_page(on(t, "Sensors").select("id", "name").order_by("name desc").top(5).skip(3), count=True)
    layout = "`@iot.count` long, `@iot.nextLink` string, value array<struct<`@iot.id`:long,name:string>>"
    p = page.select(F.from_json("page", layout).alias("p"))
    return p.select(
        F.col("p.`@iot.count`").alias("total"), F.col("p.`@iot.nextLink`").alias("next_link"),
        F.inline("p.value").alias("id", "name"),
    )


@query("snk_02_data_array", """
SELECT datastream_id, part, count(*) AS count,
       '[' || string_agg('[' || id || ',"' || strftime(phenomenon_start, '%Y-%m-%dT%H:%M:%SZ') || '",' || parameters || ']', ','
              ORDER BY id) || ']' AS data_array
FROM (SELECT *, (row_number() OVER (PARTITION BY datastream_id ORDER BY id) - 1) // 10 AS part FROM observation)
GROUP BY datastream_id, part""")
def snk_02(t):
    groups = sinks.to_data_array(
        t.observations(), ("id", "phenomenonTime", "parameters"), BASE, rows_per_part=10, id_width=1000
    )
    return groups.select("datastream_id", "part", "count", "data_array")


@query("agg_14_group_to_arrays", """
SELECT datastream_id, part, count(*) AS count, string_agg('[' || id || ',' || parameters || ']', ',' ORDER BY id) AS rows
FROM (SELECT *, (row_number() OVER (PARTITION BY datastream_id ORDER BY id) - 1) // 25 AS part
      FROM observation) GROUP BY datastream_id, part""")
def agg_14(t):
    groups = sinks.to_data_array(t.observations(), ("id", "parameters"), BASE, rows_per_part=25, id_width=1000)
    inner = F.expr("substring(data_array, 2, length(data_array) - 2)")
    return groups.select("datastream_id", "part", "count", inner.alias("rows"))


@query("snk_03_chunked_write", """
SELECT strftime(DATE '1970-01-01' + CAST(epoch_us(phenomenon_start) // 86400000000 // 30 * 30 AS INTEGER), '%Y-%m-%d') AS chunk,
       phenomenon_start >= TIMESTAMP '2024-01-15 12:00:00' AS late, count(*) AS n, min(id) AS first_id, max(id) AS last_id
FROM observation GROUP BY ALL""")
def snk_03(t):
    folder = scratch_path(t.spark, "observation")
    sinks.write_observations(t.observations(), f"{folder}/observation")
    from sensorquery.catalog import Catalog

    stored = Catalog.read(t.spark, folder)
    late = stored.observations_between(start=T).withColumn("late", F.lit(True))
    early = stored.table("observation").where(F.col("phenomenon_start") < F.lit(T).cast("timestamp")).withColumn("late", F.lit(False))
    rows = late.unionByName(early)
    return rows.groupBy(F.date_format("chunk", "yyyy-MM-dd").alias("chunk"), "late").agg(
        F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id")
    )


@query("snk_04_refs", """
SELECT id, 'http://localhost/v1.1/Things(' || id || ')' AS "@iot.selfLink" FROM thing""")
def snk_04(t):
    return sinks.refs(on(t, "Things").rows(), "Things", BASE)


@query("snk_05_raw_value", """
SELECT id, CASE mixed_type WHEN 0 THEN CASE WHEN result_number = floor(result_number)
                                            THEN CAST(CAST(result_number AS BIGINT) AS VARCHAR)
                                            ELSE CAST(result_number AS VARCHAR) END
                WHEN 1 THEN CASE WHEN result_number > 50 THEN 'true' ELSE 'false' END
                WHEN 2 THEN parameters ELSE event_type END AS value,
       coalesce(strftime(result_time, '%Y-%m-%dT%H:%M:%SZ'), 'null') AS result_time
FROM observation""")
def snk_05(t):
    rows = t.observations("mixed")
    results = sinks.raw_value(rows, "Observation", "result")
    times = sinks.raw_value(rows, "Observation", "resultTime").withColumnRenamed("value", "result_time")
    return results.join(times, "id")


@query("snk_06_series", """
SELECT datastream_id, o.id, epoch_us(o.phenomenon_start) AS at, result_number AS result, symbol
FROM observation o JOIN datastream d ON o.datastream_id = d.id""")
def snk_06(t):
    frame = sinks.series_frame(t.observations(), t.datastreams())
    return frame.select("datastream_id", "id", us("phenomenon_start").alias("at"), "result", "symbol")


def flagship(t: Testbed):
    """For each thing, its purchase datastreams with the five latest readings above a value since an
    instant, their total and whether there are more."""
    catalog = t.catalog()
    streams = filter_rows(
        catalog.table("datastream"), "datastream", lambda r: P.eq(r("ObservedProperty/name"), "purchase"), catalog
    )
    readings = Expand(
        "Observations", filter=lambda r: P.ge(r("phenomenonTime"), "2024-01-08T00:00:00Z") & P.gt(r("result"), 5),
        order=("phenomenonTime desc",), top=5, count=True,
    )
    rows = Query.on(catalog.replace(datastream=streams), "Datastreams").expand_rows(readings)
    owners = streams.select(F.col("id").alias("parent_id"), "thing_id")
    names = catalog.table("thing").select(F.col("id").alias("thing_id"), F.col("name").alias("thing"))
    return rows.join(owners, "parent_id").join(names, "thing_id").select(
        "thing_id", "thing", F.col("parent_id").alias("datastream_id"), "rn", "id",
        us("phenomenon_start").alias("at"), "result_number", "total", (F.col("total") > 5).alias("more"),
    )


query("things_latest_readings", """
SELECT t.id AS thing_id, t.name AS thing, datastream_id, rn, o.id, epoch_us(o.phenomenon_start) AS at,
       result_number, total, total > 5 AS more
FROM (SELECT *, row_number() OVER (PARTITION BY datastream_id ORDER BY phenomenon_start DESC, interval_end DESC, id) AS rn,
             count(*) OVER (PARTITION BY datastream_id) AS total
      FROM observation WHERE event_type = 'purchase' AND result_number > 5
        AND phenomenon_start >= TIMESTAMP '2024-01-08') o
JOIN thing t ON t.id = o.user_id WHERE rn <= 5""")(flagship)
