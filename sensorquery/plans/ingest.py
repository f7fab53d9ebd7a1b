"""Queries for documents, files, messages and load rules."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import functions as F

from sensorquery.functions import values
from sensorquery.operators import identity, loading
from sensorquery.plans.registry import query
from sensorquery.session import scratch_path, ship_functions
from sensorquery.sources import documents, files, sheets
from sensorquery.streaming import messages

ship_functions(__name__)

us = F.unix_micros
ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"


# -- data arrays -----------------------------------------------------------------------------


def array_docs(t):
    """Data-array documents of the events, at most 100 rows each, with short and faulty rows."""
    key = F.col("id")
    stamp = F.concat(F.lit('"'), F.date_format("phenomenon_start", ISO), F.lit('"'))
    value = F.col("result_number").cast("string")
    row = (
        F.when(key % 7 == 0, F.concat_ws(",", stamp, value))
        .when(key % 11 == 0, F.concat_ws(",", stamp, F.lit("null"), F.lit('"100"')))
        .when(key % 13 == 0, F.concat_ws(",", F.lit('"some day"'), value, F.lit('"100"')))
        .otherwise(F.concat_ws(",", stamp, value, F.lit('"100"'), key.cast("string")))
    )
    rows = t.observations().select(
        "datastream_id", F.expr("id div 100").alias("part"), "id", F.concat(F.lit("["), row, F.lit("]")).alias("row")
    )
    listed = rows.groupBy("datastream_id", "part").agg(F.array_sort(F.collect_list(F.struct("id", "row"))).alias("rows"))
    return listed.select(
        F.concat(
            F.lit('[{"Datastream":{"@iot.id":'), F.col("datastream_id").cast("string"),
            F.lit('},"components":["phenomenonTime","result","resultQuality","FeatureOfInterest/id"],"dataArray":['),
            F.array_join(F.transform("rows", lambda r: r["row"]), ","), F.lit("]}]"),
        ).alias("doc"),
    )


_FAULT = "id % 7 <> 0 AND (id % 11 = 0 OR id % 13 = 0)"


@query("src_03_data_array", f"""
SELECT datastream_id, epoch_us(phenomenon_start) AS at, result_number,
       CASE WHEN id % 7 <> 0 THEN '100' END AS result_quality, CASE WHEN id % 7 <> 0 THEN id END AS feature
FROM observation WHERE NOT ({_FAULT})""")
def src_03(t):
    rows, _ = documents.read_data_array(array_docs(t))
    return rows.select(
        "datastream_id", us("phenomenon_start").alias("at"), "result_number", "result_quality",
        F.col("feature_of_interest_id").alias("feature"),
    )


@query("src_03_data_array_errors", f"""
SELECT datastream_id, CASE WHEN id % 11 = 0 THEN 'result has no type' ELSE 'bad time' END AS reason, 'error' AS status,
       count(*) AS n FROM observation WHERE {_FAULT} GROUP BY ALL""")
def src_03_errors(t):
    _, errors = documents.read_data_array(array_docs(t))
    return errors.groupBy("datastream_id", "reason", "status").agg(F.count("*").alias("n"))


@query("src_03_unreadable_documents", """
SELECT id, CASE id % 5 WHEN 0 THEN 'not a data array document' WHEN 1 THEN 'missing datastream' WHEN 2 THEN 'no data array'
  WHEN 3 THEN 'missing component' END AS reason, id % 5 = 4 AS accepted FROM observation""")
def src_03_unreadable(t):
    """Every reading as a document of its own: accepted and refused rows together are all that came."""
    row = F.concat(F.lit('[["2024-01-01T00:00:00Z",'), F.col("result_number").cast("string"), F.lit("]]"))
    head = F.lit('[{"Datastream":{"@iot.id":1},"components":["phenomenonTime","result"]')
    key = F.col("id") % 5
    doc = (
        F.when(key == 0, F.lit("[{this is no JSON")).when(key == 1, F.concat(F.lit('[{"components":["phenomenonTime","result"],"dataArray":'), row, F.lit("}]")))
        .when(key == 2, F.concat(head, F.lit("}]")))
        .when(key == 3, F.concat(F.lit('[{"Datastream":{"@iot.id":1},"components":["phenomenonTime"],"dataArray":'), row, F.lit("}]")))
        .otherwise(F.concat(head, F.lit(',"dataArray":'), row, F.lit("}]")))
    )
    rows, errors = documents.read_data_array(t.observations().select("id", doc.alias("doc")))
    good = rows.select("id", F.lit(None).cast("string").alias("reason"), F.lit(True).alias("accepted"))
    return good.unionByName(errors.select("id", "reason", F.lit(False).alias("accepted")))


@query("src_09_unreadable_documents", """
SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'not a list of observations' WHEN 1 THEN 'missing position' ELSE 'missing time' END AS reason
FROM customer""")
def src_09_unreadable(t):
    key = F.col("c_custkey") % 3
    doc = F.when(key == 0, F.lit('{"nothing":1')).when(key == 1, F.lit('[{"id":"a"}]')).otherwise(F.lit('{"value":[{"lat":1,"lon":2}]}'))
    _, errors = documents.read_citizen_json(t.raw("customer").select(F.col("c_custkey").alias("id"), doc.alias("doc")))
    return errors.select("id", "reason")


@query("src_04_bulk", """
SELECT datastream_id, epoch_us(phenomenon_start) AS at, result_number, 0 AS result_type FROM observation""")
def src_04(t):
    from sensorquery.plans.changes import bulk_docs

    return documents.read_bulk(bulk_docs(t)).select(
        "datastream_id", us("phenomenon_start").alias("at"), "result_number", "result_type"
    )


# -- files -----------------------------------------------------------------------------------

STATION = files.StationConfig(
    columns=(
        files.StationColumn(0, "datetime", "dd.MM.yyyy HH:mm:ss"),
        files.StationColumn(1, "float", name="level"),
        files.StationColumn(3, "int", name="count"),
        files.StationColumn(4, "string", name="kind"),
    ),
    delimiter=";",
)


def station_lines(t):
    """Events as lines of a station file, with blank, missing and faulty cells."""
    key = F.col("event_id")
    stamp = F.when(key % 19 == 0, "no time").otherwise(F.date_format("ts", "dd.MM.yyyy HH:mm:ss"))
    level = F.when(key % 5 == 0, "").when(key % 5 == 1, "inf").otherwise(F.col("value").cast("string"))
    count = F.when(key % 3 == 0, "x").otherwise(key.cast("string"))
    full = F.concat_ws(";", stamp, level, F.lit("ignored"), count, F.col("event_type"))
    short = F.concat_ws(";", stamp, level)
    return t.raw("events").select("event_id", F.when(key % 4 == 0, short).otherwise(full).alias("value"))


_STATION_SQL = """
WITH e AS (SELECT *, epoch_us(date_trunc('second', ts)) AS t_us FROM events WHERE event_id % 19 <> 0)
SELECT 'level' AS name, t_us, CASE WHEN event_id % 5 IN (0, 1) THEN -999.9 ELSE value END AS result_number,
       CAST(NULL AS VARCHAR) AS result_string, CASE WHEN event_id % 5 IN (0, 1) THEN '0' ELSE '3' END AS result_quality FROM e
UNION ALL SELECT 'count', t_us, CASE WHEN event_id % 3 = 0 THEN -999.9 ELSE event_id END, NULL,
       CASE WHEN event_id % 3 = 0 THEN '0' ELSE '3' END FROM e WHERE event_id % 4 <> 0
UNION ALL SELECT 'kind', t_us, NULL, event_type, '3' FROM e WHERE event_id % 4 <> 0"""


def station_row(df):
    return df.select("name", us("phenomenon_start").alias("t_us"), "result_number", "result_string", "result_quality")


@query("src_05_station_files", _STATION_SQL)
def src_05(t):
    path = scratch_path(t.spark, "station")
    station_lines(t).select("value").write.text(path)
    return station_row(files.read_station_files(t.spark, path, STATION))


@query("src_05_rejects", """
WITH lines AS (SELECT event_id, event_id % 19 = 0 AS lost, event_id % 4 = 0 AS short FROM events)
SELECT event_id, NULL AS name, 'bad time' AS reason FROM lines WHERE lost
UNION ALL SELECT event_id, unnest(['count', 'kind']), 'missing cell' FROM lines WHERE short AND NOT lost""")
def src_05_rejects(t):
    return files.refused_station_lines(station_lines(t), STATION).select("event_id", "name", "reason")


def _zip_lines(batches):
    """One archive per batch of lines: a station member and one that no layout wants."""
    for number, batch in enumerate(batches):
        packed = io.BytesIO()
        with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as archive:
            archive.writestr("data/a_level.txt", ("﻿" + "\n".join(batch["value"])).encode())
            archive.writestr("readme.md", "not a station file")
        yield pd.DataFrame({"path": [f"archive-{number}.zip"], "content": [packed.getvalue()]})


@query("src_06_zipped_files", _STATION_SQL)
def src_06(t):
    archives = station_lines(t).mapInPandas(_zip_lines, "path string, content binary")
    configs = {"_level.txt": STATION}
    return station_row(files.parse_zipped_stations(files.unzip_lines(archives, list(configs)), configs))


def _zip_files(folder: str):
    """Writes an archive per batch of lines into a folder of the shared store."""

    def run(batches):
        for number, batch in enumerate(batches):
            part = TaskContext.get().partitionId()
            packed = io.BytesIO()
            with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as archive:
                half = len(batch) // 2
                archive.writestr("data/a_level.txt", ("\ufeff" + "\n".join(batch["value"][:half])).encode())
                archive.writestr("data/b_level.txt", ("\r\n".join(batch["value"][half:]) + "\r\n").encode("latin-1"))
                archive.writestr("readme.md", "not a station file")
            store, inner = fs.FileSystem.from_uri(folder.replace("file:/", "/", 1) if folder.startswith("file:/") and not folder.startswith("file://") else folder)
            store.create_dir(inner)
            with store.open_output_stream(f"{inner}/{part}-{number}.zip") as out:
                out.write(packed.getvalue())
            yield pd.DataFrame({"n": [len(batch)]})

    return run


@query("src_06_archive_members", _STATION_SQL)
def src_06_members(t):
    """Archives read by path, a member to a task at a time."""
    folder = scratch_path(t.spark, "archives")
    station_lines(t).repartition(3).mapInPandas(_zip_files(folder), "n long").agg(F.sum("n")).collect()  # writes them
    configs = {"_level.txt": STATION}
    return station_row(files.read_zipped_stations(t.spark, folder, configs))


@query("src_10_series_csv", """
SELECT 42 AS datastream_id, epoch_us(date_trunc('second', ts)) AS at, value AS result_number,
       CAST(event_id AS VARCHAR) AS result_quality FROM events""")
def src_10(t):
    path = scratch_path(t.spark, "series")
    t.raw("events").select(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("time"), F.lit("x").alias("other"), "value",
        F.col("event_id").alias("quality"),
    ).write.option("header", True).csv(path)
    rows = files.read_series_csv(t.spark, path, 42)
    return rows.select("datastream_id", us("result_time").alias("at"), "result_number", "result_quality")


@query("src_10_rejects", """
SELECT 42 AS datastream_id, 'day ' || event_id AS time, CAST(value AS VARCHAR) AS value, 'bad time' AS reason FROM events WHERE event_id % 10 = 3""")
def src_10_rejects(t):
    path = scratch_path(t.spark, "series")
    late = F.concat(F.lit("day "), F.col("event_id").cast("string"))
    t.raw("events").select(
        F.when(F.col("event_id") % 10 == 3, late).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("time"),
        F.lit("x").alias("other"), "value", F.col("event_id").alias("quality"),
    ).write.option("header", True).csv(path)
    return files.refused_series_rows(t.spark, path, 42)


# -- citizen observations and sheets ---------------------------------------------------------


DOCS_PER_PART = 20_000


def citizen_docs(t):
    """One document per customer: bare or wrapped lists, positions in different places."""
    key = F.col("c_custkey")
    text = key.cast("string")
    position = (
        F.when(key % 4 == 0, F.concat(F.lit('"lat":1.5,"lon":'), text))
        .when(key % 4 == 1, F.concat(F.lit('"gps":{"latitude":"1.5","lng":'), text, F.lit("}")))
        .when(key % 4 == 2, F.concat(F.lit('"geometry":{"type":"Point","coordinates":['), text, F.lit(",1.5]}")))
        .otherwise(F.lit('"lat":1.5'))
    )
    item = F.concat(
        F.lit('{"id":'), text, F.lit(","), position, F.lit(',"image":{"date_photo":"2020-05-06T07:08:09Z"},'),
        F.lit('"user":{"user_n_code":"u'), text, F.lit('"},"device":{"model":"m"},"water":{"fu_value":'), text,
        F.lit(',"p_ph":null,"colour":3,"sd_depth":0.5}}'),
    )
    doc = F.when(key % 2 == 0, F.concat(F.lit("["), item, F.lit("]"))).otherwise(
        F.concat(F.lit('{"results":['), item, F.lit("]}"))
    )
    # A file of a few key columns makes few partitions, its documents are long to read: they are dealt out.
    parts = t.raw("customer").count() // DOCS_PER_PART
    docs = t.raw("customer").select(doc.alias("doc"))
    return docs.repartition(parts) if parts > 1 else docs


@query("src_09_citizen_json", """
WITH w AS (SELECT c_custkey AS k, unnest(['fu_value', 'sd_depth']) AS attribute FROM customer WHERE c_custkey % 4 <> 3)
SELECT CAST(k AS VARCHAR) AS source_id, attribute, CASE attribute WHEN 'fu_value' THEN CAST(k AS VARCHAR) ELSE '0.5' END AS value,
       1.5 AS lat, CAST(k AS DOUBLE) AS lon, 'u' || k AS "user", 'm' AS sensor, 1588748889000000 AS at,
       '100' AS result_quality FROM w""")
def src_09(t):
    rows, _ = documents.read_citizen_json(citizen_docs(t))
    return rows.select(
        "source_id", "attribute", "value", "lat", "lon", "user", "sensor", us("phenomenon_start").alias("at"), "result_quality"
    )


@query("src_09_unknown_attributes", """
SELECT CAST(c_custkey AS VARCHAR) AS source_id, 'unknown attribute: colour' AS reason, '3' AS value FROM customer WHERE c_custkey % 4 <> 3""")
def src_09_unknown(t):
    return documents.refused_attributes(citizen_docs(t)).select("source_id", "reason", "value")


@query("src_09_loaded", """
WITH w AS (SELECT c_custkey AS k, unnest(['fu_value', 'sd_depth']) AS attribute FROM customer WHERE c_custkey % 4 <> 3)
SELECT 'CitizenDatastream_' || attribute AS stream, CASE attribute WHEN 'fu_value' THEN 'FU' ELSE 'm' END AS symbol,
       CASE attribute WHEN 'fu_value' THEN 'Fluorescence' ELSE 'Depth' END AS property, 'waters' AS network, 'm' AS sensor, CAST(k AS DOUBLE) AS lon,
       CASE attribute WHEN 'fu_value' THEN CAST(k AS DOUBLE) ELSE 0.5 END AS result FROM w""")
def src_09_loaded(t):
    """Citizen observations with the entities that they need, each created once by its name; positions
    of one observation each, so that no two fall on one time and datastream."""
    rows, _ = documents.read_citizen_json(citizen_docs(t))
    apart = rows.withColumn("phenomenon_start", F.timestamp_seconds(F.col("source_id").cast("long")))
    state, inserted, _ = documents.load_citizen(t.catalog(), apart, 1, "waters")

    def named(table, *more):
        return state.table(table).select(F.col("id").alias(f"{table}_id"), *more)

    return (
        inserted.join(named("datastream", F.col("name").alias("stream"), "unit_of_measurement.symbol", "observed_property_id", "network_id", "sensor_id"), "datastream_id")
        .join(named("observed_property", F.col("name").alias("property")), "observed_property_id")
        .join(named("network", F.col("name").alias("network")), "network_id").join(named("sensor", F.col("name").alias("sensor")), "sensor_id")
        .join(named("feature_of_interest", F.col("feature.xmin").alias("lon")), "feature_of_interest_id")
        .select("stream", "symbol", "property", "network", "sensor", "lon", F.col("result_number").alias("result"))
    )


def sheet_rows(t):
    """One metadata row per supplier, with lists of one to three properties."""
    key = F.col("s_suppkey")
    text = key.cast("string")
    names = F.when(key % 3 == 0, "rain").when(key % 3 == 1, " rain , level ").otherwise("rain,level,flow")
    return t.raw("supplier").select(
        F.concat(F.lit("t"), text).alias("thing_name"), F.concat(F.lit("l"), text).alias("location_name"),
        F.when(key % 2 == 0, F.concat(text, F.lit(", 46.5"))).otherwise(F.concat(F.lit("POINT("), text, F.lit(" 46.5)"))).alias("location_coordinates"),
        F.concat(F.lit("s"), text).alias("sensor_name"), F.when(key % 2 == 0, text).alias("model_number"),
        names.alias("observed_property_name"), F.lit("d1,d2").alias("observed_property_definition"),
        F.lit("mm,m").alias("datastream_uom"), F.lit("n1,n2").alias("network_name"),
        F.when(key % 2 == 1, "10 min").alias("sampling_frequency"),
    )


@query("src_11_sheet_rows", """
WITH s AS (SELECT s_suppkey AS k, unnest(['rain', 'level', 'flow'][1:k % 3 + 1]) AS name,
                  generate_subscripts(['rain', 'level', 'flow'][1:k % 3 + 1], 1) AS i FROM supplier)
SELECT 't' || k AS thing, 's' || k AS sensor, name AS property, network, CASE WHEN i = 1 THEN 'Millimeter' ELSE 'Meter' END AS unit,
       CASE WHEN i = 1 THEN 'mm' ELSE 'm' END AS symbol, CASE WHEN k % 2 = 1 THEN '{"samplingFrequency":"10 min"}' END AS properties
FROM s, (SELECT unnest(['n1', 'n2']) AS network)""")
def src_11(t):
    streams = sheets.metadata_from_rows(sheet_rows(t))["datastream"]
    return streams.select(
        F.col("thing_name").alias("thing"), F.col("sensor_name").alias("sensor"), F.col("observed_property_name").alias("property"),
        F.col("network_name").alias("network"), F.col("unit_of_measurement.name").alias("unit"),
        F.col("unit_of_measurement.symbol").alias("symbol"), "properties",
    )


@query("src_11_sheet_places", """
SELECT 'l' || s_suppkey AS name, CAST(s_suppkey AS DOUBLE) AS lon, 46.5 AS lat,
       CASE WHEN s_suppkey % 2 = 0 THEN 'http://example.org/' || s_suppkey || '.pdf' END AS manual FROM supplier""")
def src_11_places(t):
    parts = sheets.metadata_from_rows(sheet_rows(t))
    places = parts["location"].select("name", F.col("location.xmin").alias("lon"), F.col("location.ymin").alias("lat"))
    manuals = parts["sensor"].select(
        F.concat(F.lit("l"), F.substring("name", 2, 20)).alias("name"), F.col("sensor_metadata").alias("manual")
    )
    return places.join(manuals, "name")


# -- messages --------------------------------------------------------------------------------

MAPPING = {
    "site/+/click": ["Skip", "clicks"],
    "site/8/error": ["special", "second"],
    "site/9/#": ["nine"],
    "site/+/view": ["views", "skip", "third"],
}
MESSAGES = messages.MessageConfig(mapping=MAPPING, separator=";")


def message_rows(t):
    """Events as messages ``time;value;id`` with null tokens, decimal commas and faults."""
    key = F.col("event_id")
    stamp = F.when(key % 17 == 0, "soon").otherwise(F.date_format("ts", ISO))
    value = (
        F.when(key % 5 == 0, " NaN ").when(key % 5 == 1, F.replace(F.col("value").cast("string"), F.lit("."), F.lit(",")))
        .when(key % 5 == 2, "broken").otherwise(F.col("value").cast("string"))
    )
    payload = F.when(key % 13 == 0, stamp).otherwise(F.concat_ws(";", stamp, value, key.cast("string")))
    topic = F.concat(F.lit("site/"), F.col("user_id").cast("string"), F.lit("/"), F.col("event_type"))
    return t.raw("events").select("event_id", topic.alias("topic"), payload.alias("payload"))


_ROUTE = """CASE WHEN user_id = 8 AND event_type = 'error' THEN 'special,second' WHEN event_type = 'click' THEN 'Skip,clicks'
            WHEN user_id = 9 THEN 'nine' WHEN event_type = 'view' THEN 'views,skip,third' END"""


@query("ing_01_route", f"SELECT event_id, {_ROUTE} AS names FROM events")
def ing_01(t):
    return messages.route(message_rows(t), MAPPING).select("event_id", F.array_join("names", ",").alias("names"))


@query("ing_01_topic_table", """
SELECT event_id, 'user ' || user_id || ',' || event_type AS names FROM events""")
def ing_01_table(t):
    """A mapping with a topic per user and event type, as a table."""
    rows = message_rows(t)
    pairs = t.raw("events").select("user_id", "event_type").distinct()
    exact = pairs.select(
        F.concat_ws("/", F.lit("site"), F.col("user_id").cast("string"), "event_type").alias("_topic"),
        F.array(F.concat(F.lit("user "), F.col("user_id").cast("string")), F.col("event_type")).alias("_exact"),
    )
    routed = messages.route_by(rows, exact, {"site/#": ["other"]})
    return routed.select("event_id", F.array_join("names", ",").alias("names"))


@query("ing_02_split_payload", """
SELECT event_id, CASE WHEN event_id % 13 <> 0 AND event_id % 17 = 0 THEN 'soon'
            WHEN event_id % 13 <> 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') END AS time_text,
       CASE WHEN event_id % 13 = 0 THEN -1 ELSE 2 END AS fields FROM events""")
def ing_02(t):
    split = messages.split_payload(message_rows(t), ";")
    return split.select("event_id", "time_text", F.coalesce(F.size("fields"), F.lit(-1)).alias("fields"))


_RAW = """CASE event_id % 5 WHEN 0 THEN 'NaN' WHEN 1 THEN replace(CAST(value AS VARCHAR), '.', ',')
          WHEN 2 THEN 'broken' ELSE CAST(value AS VARCHAR) END"""
_PAIRED = f"""
WITH routed AS (SELECT *, {_ROUTE} AS names, {_RAW} AS raw_value FROM events WHERE event_id % 13 <> 0),
pairs AS (SELECT event_id, ts, value, unnest([1, 2]) AS i, string_split(names, ',') AS n, raw_value FROM routed WHERE names IS NOT NULL),
named AS (SELECT event_id, ts, value, i, n[i] AS name, CASE i WHEN 1 THEN raw_value ELSE CAST(event_id AS VARCHAR) END AS raw
          FROM pairs WHERE i <= len(n) AND lower(n[i]) <> 'skip')"""


@query("ing_03_pair_values", _PAIRED + "SELECT event_id, name, raw FROM named")
def ing_03(t):
    paired = messages.pair_values(messages.split_payload(messages.route(message_rows(t), MAPPING), ";"))
    return paired.select("event_id", "name", "raw")


@query("ing_04_null_policy", """
SELECT event_id, CASE event_id % 5 WHEN 0 THEN -999.0 WHEN 2 THEN NULL ELSE value END AS result_number,
       CASE WHEN event_id % 5 = 0 THEN '00' ELSE '11' END AS result_quality FROM events WHERE event_id % 13 <> 0""")
def ing_04(t):
    split = messages.split_payload(message_rows(t), ";").where(F.col("fields").isNotNull())
    judged = messages.null_policy(split.withColumn("raw", F.get("fields", F.lit(0))))
    return judged.select("event_id", "result_number", "result_quality")


@query("ing_05_to_number", """
SELECT event_id, CASE WHEN event_id % 4 < 2 THEN value END AS n FROM events""")
def ing_05(t):
    plain = F.col("value").cast("string")
    key = F.col("event_id") % 4
    text = (
        F.when(key == 0, F.concat(F.lit(" "), plain)).when(key == 1, F.replace(plain, F.lit("."), F.lit(",")))
        .when(key == 2, F.concat(F.lit("1,"), plain)).otherwise(F.lit("high"))
    )
    return t.raw("events").select("event_id", values.to_number(text).alias("n"))


@query("ing_06_station_value", """
SELECT event_id, CASE event_id % 4 WHEN 0 THEN value WHEN 1 THEN event_id ELSE -999.9 END AS number,
       CASE WHEN event_id % 4 IN (0, 1) THEN 3 ELSE 0 END AS quality FROM events""")
def ing_06(t):
    key = F.col("event_id")
    text = (
        F.when(key % 4 == 0, F.col("value").cast("string")).when(key % 4 == 1, key.cast("string"))
        .when(key % 4 == 2, F.lit("")).otherwise(F.lit("-inf"))
    )
    as_float, as_int = values.parse_station_value(text, "float"), values.parse_station_value(text, "int")
    whole = key % 4 == 1
    return t.raw("events").select(
        "event_id", F.when(whole, as_int.number).otherwise(as_float.number).alias("number"),
        F.when(whole, as_int.quality).otherwise(as_float.quality).alias("quality"),
    )


@query("ing_07_quality_mask", """
SELECT event_id, event_id % 4 + (event_id // 4 % 4) * 4 + 3 * 16 AS mask, event_id % 4 AS first, event_id // 4 % 4 AS second,
       3 AS third, 0 AS fourth FROM events""")
def ing_07(t):
    key = F.col("event_id")
    mask = values.quality_mask(key % 4, F.expr("(event_id div 4) % 4"), values.QC_OK)
    parts = {n: values.quality_state(F.col("mask"), i) for i, n in enumerate(("first", "second", "third", "fourth"))}
    return t.raw("events").select("event_id", mask.alias("mask")).withColumns(parts)


@query("ing_08_station_time", """
SELECT o_orderkey, CASE o_orderkey % 3 WHEN 2 THEN epoch_us(o_orderdate)
         ELSE epoch_us(timezone('Europe/Rome', o_orderdate)) END AS at FROM orders""")
def ing_08(t):
    key = F.col("o_orderkey") % 3
    text = (
        F.when(key == 0, F.date_format("o_orderdate", "dd/MM/yyyy HH:mm")).when(key == 1, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    )
    return t.raw("orders").select(
        "o_orderkey", us(values.parse_station_time(text, "dd/MM/yyyy HH:mm", "Europe/Rome")).alias("at")
    )


@query("src_08_messages", _PAIRED + """
SELECT name, epoch_us(ts) AS at, CASE WHEN i = 2 THEN CAST(event_id AS DOUBLE) WHEN event_id % 5 = 0 THEN -999.0 ELSE value END AS result_number,
       CASE WHEN i = 1 AND event_id % 5 = 0 THEN '00' ELSE '11' END AS result_quality
FROM named WHERE event_id % 17 <> 0 AND NOT (i = 1 AND event_id % 5 = 2)""")
def src_08(t):
    rows = messages.observations_from_messages(message_rows(t), MESSAGES)
    return rows.select("name", us("phenomenon_start").alias("at"), "result_number", "result_quality")


@query("src_08_message_status", f"""
SELECT CASE WHEN {_ROUTE} IS NULL THEN 'no mapping' WHEN event_id % 13 = 0 THEN 'bad payload'
            WHEN event_id % 17 = 0 THEN 'bad time' ELSE 'ok' END AS status, count(*) AS rows FROM events GROUP BY 1""")
def src_08_status(t):
    return loading.load_report(messages.parse_messages(message_rows(t), MESSAGES))


# -- load rules ------------------------------------------------------------------------------


def stored_and_new(t):
    """Stored readings and an arriving batch that overlaps them."""
    obs = t.observations()
    key = F.col("id") % 10
    changed = F.when(key == 6, F.col("result_number") + 1).otherwise(F.col("result_number"))
    return obs.where(key < 7), obs.where(key >= 5).withColumn("result_number", changed)


@query("jn_12_missing_only", "SELECT id FROM observation WHERE id % 10 >= 7")
def jn_12(t):
    stored, new = stored_and_new(t)
    return loading.missing_only(new, stored).select("id")


@query("ing_09_append_mode", """
SELECT o.id FROM observation o LEFT JOIN (SELECT datastream_id, max(phenomenon_start) AS e FROM observation
  WHERE phenomenon_start < TIMESTAMP '2024-01-15 12:00:00' AND id % 3 = 0
  GROUP BY 1) s ON s.datastream_id = o.datastream_id WHERE s.e IS NULL OR o.phenomenon_start > s.e""")
def ing_09(t):
    from sensorquery.operators import maintain
    from sensorquery.plans.changes import bare_streams

    obs = t.observations()
    early = obs.where((F.col("phenomenon_start") < F.lit("2024-01-15T12:00:00Z").cast("timestamp")) & (F.col("id") % 3 == 0))
    return loading.append_only(obs, maintain.merge_extents(bare_streams(t), early)).select("id")


@query("ing_10_backfill_mode", "SELECT status, n FROM (VALUES ('missing', (SELECT count(*) FROM observation WHERE id % 10 >= 7))) v(status, n)")
def ing_10(t):
    stored, new = stored_and_new(t)
    return loading.missing_only(new, stored).agg(F.lit("missing").alias("status"), F.count("*").alias("n"))


@query("ing_11_update_mode", """
SELECT id, CASE WHEN id % 10 >= 7 THEN 'new' WHEN id % 10 = 6 THEN 'updated' ELSE 'unchanged' END AS status,
       CASE WHEN id % 10 < 7 THEN id END AS existing_id FROM observation WHERE id % 10 >= 5""")
def ing_11(t):
    stored, new = stored_and_new(t)
    return loading.upsert(new, stored).select("id", "status", "existing_id")


@query("ing_11_text_results", """
SELECT id, CASE WHEN id % 4 = 0 THEN 'updated' WHEN id % 4 = 3 THEN 'new' ELSE 'unchanged' END AS status,
       CASE WHEN id % 4 <> 3 THEN id END AS existing_id FROM observation""")
def ing_11_text(t):
    """Text results, and two stored readings at each time that differ in their end."""
    obs = t.observations().where("datastream_id is not null").withColumn("result_type", F.lit(3)).withColumn(
        "result_string", F.concat(F.lit("text "), F.col("id").cast("string"))).withColumn("result_number", F.lit(None).cast("double"))
    longer = obs.withColumn("id", F.col("id") + 10_000_000).withColumn(
        "phenomenon_end", F.col("phenomenon_start") + F.make_dt_interval(F.lit(9))).withColumn("result_string", F.lit("other"))
    stored = obs.unionByName(longer).where(F.col("id") % 4 != 3).withColumn(
        "result_string", F.when((F.col("id") % 4 == 0) & (F.col("id") < 10_000_000), "changed").otherwise(F.col("result_string")))
    return loading.upsert(obs, stored).select("id", "status", "existing_id")


@query("ing_12_drop_nodata", "SELECT id FROM observation WHERE id % 6 NOT IN (0, 1)")
def ing_12(t):
    key = F.col("id") % 6
    text = (
        F.when(key == 0, "-999.9").when(key == 1, "-999.9000000001").when(key == 2, "text").when(key == 3, "-999.8")
        .otherwise(F.col("result_number").cast("string"))
    )
    return loading.drop_nodata(t.observations().withColumn("reading", text), -999.9, "reading").select("id")


@query("ing_13_clamp", """
SELECT id FROM observation WHERE phenomenon_start BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-12'""")
def ing_13(t):
    return loading.clamp(t.observations(), "2024-01-10T00:00:00Z", "2024-01-12T00:00:00Z").select("id")


@query("ing_13_windows", """
SELECT id, epoch_us(w) AS lo, epoch_us(least(w + INTERVAL 7 DAY, phenomenon_end)) AS hi
FROM (SELECT id, phenomenon_end, unnest(range(phenomenon_start, phenomenon_end, INTERVAL 7 DAY)) AS w
      FROM datastream WHERE phenomenon_start < phenomenon_end)""")
def ing_13_windows(t):
    steps = loading.windows(t.datastreams(), "phenomenon_start", "phenomenon_end", 7)
    return steps.select("id", us("window_start").alias("lo"), us("window_end").alias("hi"))


def legacy_rows(t):
    key = F.col("event_id")
    value = F.when(key % 4 == 0, "12.0").when(key % 4 == 1, F.col("value").cast("string")).when(key % 4 == 2, " low ").otherwise("")
    return t.raw("events").select(
        key.alias("datastream_id"), F.date_format("ts", ISO).alias("time"), value.alias("value"), (key % 3).cast("string").alias("quality")
    )


@query("ing_14_parse_result", """
SELECT event_id AS datastream_id, CASE event_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN 3 END AS result_type,
       CASE event_id % 4 WHEN 0 THEN 12.0 WHEN 1 THEN value END AS result_number,
       CASE event_id % 4 WHEN 0 THEN '12' WHEN 1 THEN CASE WHEN value = floor(value) THEN CAST(CAST(value AS BIGINT) AS VARCHAR)
         ELSE CAST(value AS VARCHAR) END WHEN 2 THEN 'low' END AS result_string FROM events""")
def ing_14(t):
    typed = values.parse_result(F.col("value"))
    return legacy_rows(t).select("datastream_id", *[c.alias(n) for n, c in typed.items()])


@query("ing_16_legacy_rows", """
SELECT event_id AS datastream_id, epoch_us(ts) AS at, epoch_us(ts) AS result_at, CAST(event_id % 3 AS VARCHAR) AS result_quality FROM events""")
def ing_16(t):
    rows = loading.from_legacy(legacy_rows(t))
    return rows.select(
        "datastream_id", us("phenomenon_start").alias("at"), us("result_time").alias("result_at"), "result_quality"
    )


def name_mapping(t):
    """Source names to target names: some twice, some without a target."""
    key = F.col("id")
    target = F.when(key % 10 == 1, F.lit("nowhere")).otherwise(F.concat(F.lit("copy-"), key.cast("string")))
    pairs = t.datastreams().where(key % 2 == 1).select(F.col("name").alias("source_name"), target.alias("target_name"))
    return pairs.unionByName(pairs.where(F.substring("source_name", -1, 1) == "3"))


def targets(t):
    return t.datastreams().select(
        (F.col("id") + 100_000).alias("id"), F.concat(F.lit("copy-"), F.col("id").cast("string")).alias("name")
    )


_MAPPED = """
WITH mapped AS (SELECT id, CASE WHEN id % 10 = 3 THEN 'duplicate mapping' WHEN id % 10 = 1 THEN 'missing target' ELSE 'ok' END AS status
                FROM datastream WHERE id % 2 = 1)"""


@query("jn_14_name_mapping", _MAPPED + """
SELECT 'ds-' || id AS source_name, CASE WHEN id % 10 = 1 THEN 'nowhere' ELSE 'copy-' || id END AS target_name, id AS source_id,
       CASE WHEN id % 10 <> 1 THEN id + 100000 END AS target_id, status FROM mapped""")
def jn_14(t):
    return loading.map_datastreams(t.datastreams(), targets(t), name_mapping(t))


def copied(t):
    mapping = loading.map_datastreams(t.datastreams(), targets(t), name_mapping(t))
    obs = t.observations()
    held = obs.where(F.col("id") % 4 == 0).withColumn("datastream_id", F.col("datastream_id") + 100_000)
    odd = F.when(F.col("id") % 5 == 0, F.lit(-999.9)).otherwise(F.col("result_number"))
    return loading.copy_series(
        obs.withColumn("result_number", odd), held, mapping, start="2024-01-05T00:00:00Z", end="2024-01-25T00:00:00Z", nodata=-999.9
    )


_COPIED = _MAPPED + """,
moved AS (SELECT o.id, o.datastream_id + 100000 AS datastream_id, CASE WHEN o.id % 4 = 0 THEN 'exists' WHEN o.id % 5 = 0 THEN 'nodata' ELSE 'copied' END AS status
  FROM observation o JOIN mapped m ON m.id = o.datastream_id
  WHERE m.status = 'ok' AND phenomenon_start BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25')"""


@query("ing_15_copy_series", _COPIED + "SELECT id, datastream_id, status FROM moved")
def ing_15(t):
    return copied(t).select("id", "datastream_id", "status")


@query("agg_15_load_report", _COPIED + "SELECT status, count(*) AS rows FROM moved GROUP BY status")
def agg_15(t):
    return loading.load_report(copied(t))


@query("jn_11_resolve_names", """
WITH dim AS (SELECT id, CASE WHEN id % 9 = 0 THEN 'shared' ELSE name END AS name FROM sensor),
known AS (SELECT name, min(id) AS id, count(*) AS n FROM dim GROUP BY name),
asked AS (SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'shared' WHEN p_partkey % 4 = 1 THEN 'unknown'
                 ELSE 'Supplier#' || lpad(CAST(p_partkey % 90 AS VARCHAR), 9, '0') END AS name FROM part)
SELECT p_partkey, a.name, CASE WHEN n = 1 THEN id END AS sensor_id,
       CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'ambiguous' ELSE 'ok' END AS status
FROM asked a LEFT JOIN known k ON k.name = a.name""")
def jn_11(t):
    key = F.col("p_partkey")
    asked = F.when(key % 4 == 0, "shared").when(key % 4 == 1, "unknown").otherwise(
        F.concat(F.lit("Supplier#"), F.lpad((key % 90).cast("string"), 9, "0"))
    )
    dim = t.sensors().withColumn("name", F.when(F.col("id") % 9 == 0, "shared").otherwise(F.col("name")))
    rows = t.raw("part").select("p_partkey", asked.alias("name"))
    return identity.resolve_ids(rows, "name", dim, "sensor_id").select("p_partkey", "name", "sensor_id", "status")


@query("ing_17_get_or_create", """
WITH asked AS (SELECT DISTINCT 'Supplier#' || lpad(CAST(p_partkey % 150 AS VARCHAR), 9, '0') AS name FROM part),
fresh AS (SELECT name, (SELECT max(id) FROM sensor) + row_number() OVER (ORDER BY name) AS id FROM asked ANTI JOIN sensor USING (name))
SELECT name, id, FALSE AS created FROM asked JOIN sensor USING (name) UNION ALL SELECT name, id, TRUE FROM fresh""")
def ing_17(t):
    name = F.concat(F.lit("Supplier#"), F.lpad((F.col("p_partkey") % 150).cast("string"), 9, "0"))
    asked = t.raw("part").select("p_partkey", name.alias("name"))
    _, keys = identity.get_or_create(asked, t.sensors(), "name", ["p_partkey"])
    return keys


@query("ing_18_lat_lon", """
SELECT c_custkey AS k, 1.5 AS lat, CASE WHEN c_custkey % 4 <> 3 THEN CAST(c_custkey AS DOUBLE) END AS lon FROM customer""")
def ing_18(t):
    lat, lon = values.extract_lat_lon(F.col("item"))
    items = documents.citizen_items(citizen_docs(t))
    return items.select(F.get_json_object("item", "$.id").cast("long").alias("k"), lat.alias("lat"), lon.alias("lon"))


@query("ing_18_missing_position", "SELECT CAST(c_custkey AS VARCHAR) AS source_id, 'missing position' AS reason FROM customer WHERE c_custkey % 4 = 3")
def ing_18_missing(t):
    _, errors = documents.read_citizen_json(citizen_docs(t))
    return errors.select("source_id", "reason")


@query("ing_19_pair_lists", """
SELECT s_suppkey AS k, i - 1 AS i, ['d1', 'd2'][least(i, 2)] AS definition
FROM supplier, (SELECT unnest([1, 2, 3]) AS i) WHERE i <= s_suppkey % 3 + 1""")
def ing_19(t):
    listed = sheet_rows(t).select(
        F.substring("thing_name", 2, 20).cast("long").alias("k"), values.split_list(F.col("observed_property_definition")).alias("d"),
        F.posexplode(values.split_list(F.col("observed_property_name"))).alias("i", "name"),
    )
    return listed.select("k", "i", values.list_value(F.col("d"), F.col("i")).alias("definition"))


@query("ing_20_short_key", "SELECT id, substr(sha1(name), 1, 12) AS short FROM thing")
def ing_20(t):
    return t.things().select("id", values.short_key(F.col("name")).alias("short"))


@query("ing_21_unit_name", """
SELECT l_orderkey, l_linenumber, l_partkey, CASE l_linenumber % 4 WHEN 0 THEN 'Celsius degree' WHEN 1 THEN 'Percentage' WHEN 2 THEN 'Millimeter'
         ELSE l_returnflag END AS unit,
       CASE WHEN l_linenumber % 2 = 0 THEN '{"flag":"' || l_returnflag || '"}' END AS properties FROM lineitem""")
def ing_21(t):
    key = F.col("l_linenumber") % 4
    symbol = F.when(key == 0, "°C").when(key == 1, "%").when(key == 2, "mm").otherwise(F.col("l_returnflag"))
    flag = F.when(F.col("l_linenumber") % 2 == 0, F.col("l_returnflag"))
    return t.raw("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", values.unit_name(symbol).alias("unit"),
        values.properties_json(flag=flag, absent=F.lit(None).cast("string")).alias("properties"),
    )


@query("ing_22_coordinates", """
SELECT s_suppkey AS k, CASE WHEN s_suppkey % 3 <> 2 THEN CAST(s_suppkey AS DOUBLE) END AS x,
       CASE WHEN s_suppkey % 3 <> 2 THEN -46.25 END AS y FROM supplier""")
def ing_22(t):
    key = F.col("s_suppkey")
    text = (
        F.when(key % 3 == 0, F.concat(key.cast("string"), F.lit(" , -46.25"))).when(key % 3 == 1, F.concat(F.lit("Point ("), key.cast("string"), F.lit(" -46.25)")))
        .otherwise(F.lit("north, south"))
    )
    xy = values.parse_coordinates(text)
    return t.raw("supplier").select(key.alias("k"), F.get(xy, F.lit(0)).alias("x"), F.get(xy, F.lit(1)).alias("y"))
