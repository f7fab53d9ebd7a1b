"""Queries for the scalar, JSON and geometry functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorquery.functions import geometry as G
from sensorquery.functions import scalars as S
from sensorquery.functions.values import Interval
from sensorquery.plans.registry import query

us = F.unix_micros


# -- text ------------------------------------------------------------------------------------


@query("str_01_substringof", "SELECT id FROM thing WHERE contains(name, '0042')")
def str_01(t):
    return t.things().where(S.substringof("0042", F.col("name"))).select("id")


@query("str_02_startswith", "SELECT id FROM thing WHERE starts_with(name, 'Customer#0000001')")
def str_02(t):
    return t.things().where(S.startswith(F.col("name"), "Customer#0000001")).select("id")


@query("str_03_endswith", "SELECT id FROM thing WHERE ends_with(name, '7')")
def str_03(t):
    return t.things().where(S.endswith(F.col("name"), "7")).select("id")


@query("str_04_length", "SELECT doc_id, length(text) AS size FROM documents")
def str_04(t):
    docs = t.spark.read.schema("doc_id long, text string").parquet(f"{t.folder}/documents.parquet")
    return docs.select("doc_id", S.length(F.col("text")).alias("size"))


@query("str_05_indexof", """
SELECT doc_id, instr(text, 'the') AS at, instr(text, 'no such text') AS absent FROM documents""")
def str_05(t):
    docs = t.spark.read.schema("doc_id long, text string").parquet(f"{t.folder}/documents.parquet")
    return docs.select("doc_id", S.indexof(F.col("text"), "the").alias("at"), S.indexof(F.col("text"), "no such text").alias("absent"))


@query("str_06_substring", """
SELECT id, substr(name, 10) AS tail, substr(name, 1, 8) AS head, substr(name, 1, 2) AS early FROM thing""")
def str_06(t):
    return t.things().select(
        "id", S.substring(F.col("name"), 9).alias("tail"), S.substring(F.col("name"), 0, 8).alias("head"),
        S.substring(F.col("name"), -3, 5).alias("early"),
    )


@query("str_07_case", "SELECT id, lower(name) AS low, upper(name) AS up FROM thing")
def str_07(t):
    return t.things().select("id", S.tolower(F.col("name")).alias("low"), S.toupper(F.col("name")).alias("up"))


@query("str_08_trim", "SELECT id, trim('  ' || name || ' ', ' ') AS text FROM thing")
def str_08(t):
    padded = F.concat(F.lit("  "), F.col("name"), F.lit(" "))
    return t.things().select("id", S.trim(padded).alias("text"))


@query("str_09_concat", """
SELECT id, concat(parameters, strftime(result_time, '%H')) AS text FROM observation""")
def str_09(t):
    return t.observations().select(
        "id", S.concat(F.col("parameters"), F.date_format("result_time", "HH")).alias("text")
    )


# -- time ------------------------------------------------------------------------------------


@query("dt_01_parts", """
SELECT id, year(phenomenon_start) AS y, month(phenomenon_start) AS mo, day(phenomenon_start) AS d,
       hour(phenomenon_start) AS h, minute(phenomenon_start) AS mi FROM observation""")
def dt_01(t):
    return t.observations().select(
        "id", S.year(F.col("phenomenon_start")).alias("y"), S.month(F.col("phenomenon_start")).alias("mo"), S.day(F.col("phenomenon_start")).alias("d"),
        S.hour(F.col("phenomenon_start")).alias("h"), S.minute(F.col("phenomenon_start")).alias("mi"),
    )


@query("dt_02_second", """
SELECT id, CAST((epoch_us(phenomenon_start) % 60000000) / 1000000.0 AS DOUBLE) AS s FROM observation""")
def dt_02(t):
    return t.observations().select("id", S.second(F.col("phenomenon_start")).cast("double").alias("s"))


@query("dt_03_fractionalseconds", """
SELECT id, CAST((epoch_us(phenomenon_start) % 1000000) / 1000000.0 AS DOUBLE) AS s FROM observation""")
def dt_03(t):
    return t.observations().select("id", S.fractionalseconds(F.col("phenomenon_start")).cast("double").alias("s"))


@query("dt_04_totaloffsetminutes", "SELECT id, 0 AS offset_minutes FROM observation")
def dt_04(t):
    return t.observations().select("id", S.totaloffsetminutes(F.col("phenomenon_start")).alias("offset_minutes"))


@query("dt_05_date", "SELECT id, strftime(phenomenon_start, '%Y-%m-%d') AS d FROM observation")
def dt_05(t):
    return t.observations().select("id", S.date(F.col("phenomenon_start")).cast("string").alias("d"))


@query("dt_06_time", "SELECT id, strftime(phenomenon_start, '%H:%M:%S.%f') AS clock FROM observation")
def dt_06(t):
    return t.observations().select("id", S.time(F.col("phenomenon_start")).alias("clock"))


@query("dt_07_now", "SELECT id FROM observation WHERE phenomenon_start < TIMESTAMP '2025-01-01'")
def dt_07(t):
    return t.observations().where(F.col("phenomenon_start") < S.now()).select("id")


@query("dt_08_extremes", """
SELECT id FROM observation
WHERE phenomenon_start > TIMESTAMP '0001-01-01' AND phenomenon_start < TIMESTAMP '9999-12-31'""")
def dt_08(t):
    return t.observations().where((F.col("phenomenon_start") > S.mindatetime()) & (F.col("phenomenon_start") < S.maxdatetime())).select("id")


@query("dt_07_past_and_future", "SELECT id, id % 3 <> 1 AS past FROM observation")
def dt_07_future(t):
    """A third of the readings is moved a thousand years ahead."""
    moved = F.col("phenomenon_start") + F.when(F.col("id") % 3 == 1, F.expr("INTERVAL 1000 YEAR")).otherwise(F.expr("INTERVAL 0 YEAR"))
    return t.observations().select("id", (moved < S.now()).alias("past"))


@query("dt_08_open_ends", "SELECT id FROM observation WHERE id % 4 > 1")
def dt_08_ends(t):
    """Readings at the very first and last instant lie outside the open span between them."""
    at = F.when(F.col("id") % 4 == 0, S.mindatetime()).when(F.col("id") % 4 == 1, S.maxdatetime()).otherwise(F.col("phenomenon_start"))
    return t.observations().withColumn("at", at).where((F.col("at") > S.mindatetime()) & (F.col("at") < S.maxdatetime())).select("id")


@query("dt_09_bounds", """
SELECT id, epoch_us(phenomenon_start) AS lo, epoch_us(interval_end) AS hi FROM observation""")
def dt_09(t):
    x = Interval(F.col("phenomenon_start"), F.col("phenomenon_end"))
    return t.observations("intervals").select("id", us(S.lower(x)).alias("lo"), us(S.upper(x)).alias("hi"))


# -- numbers ---------------------------------------------------------------------------------


@query("ma_01_round", """
SELECT id, round_even(result_number, 0) AS r, round_even(floor(result_number) + 0.5, 0) AS tie FROM observation""")
def ma_01(t):
    x = F.col("result_number")
    return t.observations().select("id", S.round(x).alias("r"), S.round(F.floor(x) + 0.5).alias("tie"))


@query("ma_02_floor_ceiling", """
SELECT id, CAST(floor(result_number) AS BIGINT) AS lo, CAST(ceil(-result_number) AS BIGINT) AS hi FROM observation""")
def ma_02(t):
    x = F.col("result_number")
    return t.observations().select("id", S.floor(x).alias("lo"), S.ceiling(-x).alias("hi"))


# -- geometry --------------------------------------------------------------------------------

# A square with a hole, a line and a point, in degrees, and the same figures as SQL tests.
SQUARE = "POLYGON((-100 -60, 100 -60, 100 60, -100 60, -100 -60), (-20 -20, 20 -20, 20 20, -20 20, -20 -20))"
LINE = "LINESTRING(-170 -80, 30 120)"
SPOT = "POINT(-100 25)"
_BOX = "lon BETWEEN -100 AND 100 AND lat BETWEEN -60 AND 60"
_IN_BOX = "lon > -100 AND lon < 100 AND lat > -60 AND lat < 60"
_HOLE = "lon > -20 AND lon < 20 AND lat > -20 AND lat < 20"
_IN_HOLE = "lon BETWEEN -20 AND 20 AND lat BETWEEN -20 AND 20"
_COVERED = f"({_BOX}) AND NOT ({_HOLE})"
_INSIDE = f"({_IN_BOX}) AND NOT ({_IN_HOLE})"
_ON_LINE = "lon BETWEEN -170 AND 30 AND lat = lon + 90"
_END = "(lon = -170 AND lat = -80) OR (lon = 30 AND lat = 120)"
_SPOT = "lon = -100 AND lat = 25"


def geom():
    return F.col("location")


def places(t):
    """Every thing at every location it is linked to, so that the work grows with the things."""
    points = t.locations().select(F.col("id").alias("location_id"), "location")
    return t.thing_locations().join(points, "location_id")


def placed(expressions: str) -> str:
    return f"""
SELECT thing_id, location_id, {expressions}
FROM thing_location l JOIN place p ON l.location_id = p.id"""


def place_query(name: str, expressions: str, columns):
    @query(name, placed(expressions))
    def run(t):
        return places(t).select("thing_id", "location_id", *[c.alias(n) for n, c in columns().items()])

    return run


place_query(
    "geo_01_distance",
    "round(sqrt((lon + 100) * (lon + 100) + (lat - 25) * (lat - 25)), 9) AS to_spot, "
    "CASE WHEN lon + lat BETWEEN -250 AND 150 THEN abs(lon - lat + 90) / sqrt(2) "
    "     WHEN lon + lat < -250 THEN sqrt((lon + 170) * (lon + 170) + (lat + 80) * (lat + 80)) "
    "     ELSE sqrt((lon - 30) * (lon - 30) + (lat - 120) * (lat - 120)) END < 40 AS near_line",
    lambda: {"to_spot": F.round(G.distance(geom(), SPOT, points=True), 9), "near_line": G.distance(geom(), LINE, points=True) < 40},
)
place_query(
    "geo_02_length", "0.0 AS own, round(sqrt(200.0 * 200 + 200 * 200), 6) AS of_line",
    lambda: {"own": G.length(geom()), "of_line": F.round(G.length(LINE), 6)},
)
place_query(
    "geo_03_intersects", f"{_COVERED} AS area, ({_ON_LINE}) AS line, ({_SPOT}) AS spot",
    lambda: {"area": G.intersects(geom(), SQUARE, points=True), "line": G.intersects(geom(), LINE, points=True), "spot": G.intersects(geom(), SPOT, points=True)},
)
place_query(
    "geo_04_equals", f"({_SPOT}) AS spot, FALSE AS line",
    lambda: {"spot": G.equals(geom(), SPOT, points=True), "line": G.equals(geom(), LINE, points=True)},
)
place_query(
    "geo_05_disjoint", f"NOT ({_COVERED}) AS area, NOT ({_ON_LINE}) AS line",
    lambda: {"area": G.disjoint(geom(), SQUARE, points=True), "line": G.disjoint(geom(), LINE, points=True)},
)
place_query(
    "geo_06_touches", f"({_COVERED}) AND NOT ({_INSIDE}) AS area, ({_END}) AS line, FALSE AS spot",
    lambda: {"area": G.touches(geom(), SQUARE, points=True), "line": G.touches(geom(), LINE, points=True), "spot": G.touches(geom(), SPOT, points=True)},
)
place_query(
    "geo_07_within", f"{_INSIDE} AS area, ({_ON_LINE}) AND NOT ({_END}) AS line, ({_SPOT}) AS spot",
    lambda: {"area": G.within(geom(), SQUARE, points=True), "line": G.within(geom(), LINE, points=True), "spot": G.within(geom(), SPOT, points=True)},
)
place_query(
    "geo_08_overlaps", "FALSE AS area, FALSE AS line",
    lambda: {"area": G.overlaps(geom(), SQUARE, points=True), "line": G.overlaps(geom(), LINE, points=True)},
)
place_query(
    "geo_09_crosses", "FALSE AS area, FALSE AS line",
    lambda: {"area": G.crosses(geom(), SQUARE, points=True), "line": G.crosses(geom(), LINE, points=True)},
)
place_query(
    "geo_10_contains", f"({_SPOT}) AS spot, FALSE AS area",
    lambda: {"spot": G.contains(geom(), SPOT, points=True), "area": G.contains(geom(), SQUARE, points=True)},
)
place_query(
    "geo_11_relate",
    f"CASE WHEN {_INSIDE} THEN '0FFFFF212' WHEN {_COVERED} THEN 'F0FFFF212' ELSE 'FF0FFF212' END AS matrix, "
    f"({_SPOT}) AS same_spot",
    lambda: {"matrix": G.relate(geom(), SQUARE, points=True), "same_spot": G.relate(geom(), SPOT, "T********", points=True)},
)


# -- shapes that grow with the tables: one square per thing around its place ------------------


def squares(t):
    """A square of 10 degrees around every linked location."""
    x, y = geom()["xmin"], geom()["ymin"]

    def at(dx, dy):
        return F.array(x + dx, y + dy)

    ring = F.array(at(-5, -5), at(5, -5), at(5, 5), at(-5, 5), at(-5, -5))
    return places(t).withColumn("square", G.geometry(F.lit("Polygon"), F.array(ring)))


_WINDOW = "POLYGON((-60 -30, 60 -30, 60 30, -60 30, -60 -30))"


@query("geo_12_area_relations", """
SELECT thing_id, location_id, lon - 5 >= -60 AND lon + 5 <= 60 AND lat - 5 >= -30 AND lat + 5 <= 30 AS within_window,
       lon + 5 < -60 OR lon - 5 > 60 OR lat + 5 < -30 OR lat - 5 > 30 AS apart,
       (lon - 5 <= 60 AND lon + 5 >= -60 AND lat - 5 <= 30 AND lat + 5 >= -30)
         AND (lon + 5 = -60 OR lon - 5 = 60 OR lat + 5 = -30 OR lat - 5 = 30) AS touching,
       (lon - 5 < 60 AND lon + 5 > -60 AND lat - 5 < 30 AND lat + 5 > -30)
         AND NOT (lon - 5 >= -60 AND lon + 5 <= 60 AND lat - 5 >= -30 AND lat + 5 <= 30) AS overlapping
FROM thing_location l JOIN place p ON l.location_id = p.id""")
def geo_12(t):
    related = squares(t).withColumn("r", G.relations(F.col("square"), _WINDOW))
    return related.select(
        "thing_id", "location_id", F.col("r.within").alias("within_window"), F.col("r.disjoint").alias("apart"),
        F.col("r.touches").alias("touching"), F.col("r.overlaps").alias("overlapping"),
    )


@query("geo_09_lines_cross_area", """
SELECT thing_id, location_id, lat > -30 AND lat < 30 AND ((lon - 5 < -60 AND lon + 5 > -60) OR (lon - 5 < 60 AND lon + 5 > 60)) AS crossing,
       lat >= -30 AND lat <= 30 AND lon - 5 >= -60 AND lon + 5 <= 60 AND NOT lat IN (-30, 30) AS inside
FROM thing_location l JOIN place p ON l.location_id = p.id""")
def geo_09_lines(t):
    x, y = geom()["xmin"], geom()["ymin"]
    line = G.geometry(F.lit("LineString"), F.array(F.array(F.array(x - 5, y), F.array(x + 5, y))))
    related = places(t).withColumn("line", line).withColumn("r", G.relations(F.col("line"), _WINDOW))
    return related.select("thing_id", "location_id", F.col("r.crosses").alias("crossing"), F.col("r.within").alias("inside"))


# -- JSON ------------------------------------------------------------------------------------


@query("js_01_extract", "SELECT id, properties->>'$.nation.key' AS key FROM thing")
def js_01(t):
    return t.things().select("id", S.json_path(F.col("properties"), "nation", "key").alias("key"))


@query("js_02_element_text", "SELECT id, parameters->>'$.k' AS k FROM observation")
def js_02(t):
    return t.observations().select("id", S.json_path(F.col("parameters"), "k").alias("k"))


@query("js_03_build", """
SELECT datastream_id, '{"first":' || min(id) || ',"ids":[' || min(id) || ',' || max(id) || ']}' AS doc
FROM observation GROUP BY datastream_id""")
def js_03(t):
    lo, hi = F.min("id"), F.max("id")
    doc = F.to_json(F.struct(lo.alias("first"), F.array(lo, hi).alias("ids")))
    return t.observations().groupBy("datastream_id").agg(doc.alias("doc"))


@query("js_04_feature_geometry", """
SELECT thing_id, location_id, lon AS x, lat AS y FROM thing_location l JOIN place p ON l.location_id = p.id""")
def js_04(t):
    from sensorquery.functions.render import geojson

    feature = F.concat(F.lit('{"type":"Feature","properties":{},"geometry":'), geojson(geom()), F.lit("}"))
    text = F.when(F.col("thing_id") % 2 == 0, feature).otherwise(geojson(geom()))
    parsed = places(t).withColumn("parsed", G.from_geojson(text))
    return parsed.select("thing_id", "location_id", F.col("parsed.xmin").alias("x"), F.col("parsed.ymin").alias("y"))


@query("js_05_reference_system", "SELECT id, id % 3 <> 2 AS accepted FROM thing")
def js_05(t):
    def named(code: int):
        return F.lit(f'{{"type":"Point","crs":{{"properties":{{"name":"urn:ogc:def:crs:EPSG::{code}"}}}}}}')

    key = F.col("id") % 3
    text = F.when(key == 0, F.lit('{"type":"Point"}')).when(key == 1, named(4326)).otherwise(named(3857))
    return t.things().select("id", G.crs_matches(text, 4326).alias("accepted"))
