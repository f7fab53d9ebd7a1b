"""Hand-made edge rows: nulls, touching bounds, mixed results, shapes, payloads and time zones."""

import json
from datetime import datetime, timezone

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from sensorquery.catalog import Catalog
from sensorquery.functions import geometry as G
from sensorquery.functions import predicates as P
from sensorquery.functions import render, values
from sensorquery.functions.values import Interval, Result
from sensorquery.operators import loading, mutations, quality, versions
from sensorquery.operators.query import Expand, Query, result_order
from sensorquery.sources import documents, files
from sensorquery.streaming import messages

T = "2024-01-01T12:00:00Z"


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def interval(lo, hi, rule="closed"):
    return Interval(F.lit(lo).cast("timestamp"), F.lit(hi).cast("timestamp"), rule)


@pytest.mark.parametrize(
    "lo, hi, op, expected",
    [
        (T, T, "eq", True), (T, "2024-01-01T13:00:00Z", "eq", True), ("2024-01-01T11:00:00Z", T, "eq", True),
        (T, T, "gt", False), (T, T, "ge", True), (T, T, "le", True), (T, T, "lt", False),
        ("2024-01-01T11:00:00Z", "2024-01-01T13:00:00Z", "gt", False),
        ("2024-01-01T11:00:00Z", "2024-01-01T13:00:00Z", "lt", False),
        ("2024-01-01T11:00:00Z", "2024-01-01T13:00:00Z", "ne", False),
        (None, None, "eq", None), (None, None, "ne", None), (None, None, "gt", None),
    ],
)
def test_closed_intervals(spark, lo, hi, op, expected):
    assert one(spark, P.compare(op, interval(lo, hi), T).alias("x")).x is expected


def test_validity(spark):
    half = interval(T, "2024-01-02T12:00:00Z", "validity")
    still = interval(T, None, "validity")
    empty = interval(T, T, "validity")
    row = one(
        spark, P.eq(half, T).alias("start"), P.eq(half, "2024-01-02T12:00:00Z").alias("end"),
        P.eq(still, "2030-01-01T00:00:00Z").alias("open"), P.eq(empty, T).alias("empty"),
        P.eq(half, ("2024-01-02T12:00:00Z", "2024-01-03T00:00:00Z")).alias("after"),
        P.eq(half, ("2024-01-02T00:00:00Z", "2024-01-03T00:00:00Z")).alias("over"),
        P.eq(empty, ("2024-01-01T00:00:00Z", "2024-01-03T00:00:00Z")).alias("empty_over"),
        P.eq(half, ("2024-01-02T00:00:00Z", "2024-01-02T00:00:00Z")).alias("no_span"),
    )
    assert list(row) == [True, False, True, False, False, True, False, False]
    with pytest.raises(ValueError):
        P.gt(half, T)
    assert one(spark, render.interval_text(still).alias("x")).x == "2024-01-01T12:00:00Z/infinity"


MIXED = [
    (1, 3, "4", None, None, None), (2, 0, None, 4.0, None, None), (3, 3, "4.0", None, None, None),
    (4, 1, "true", None, True, None), (5, 2, None, None, None, '{"a":1}'), (6, 2, None, None, None, "[1]"),
    (7, 0, None, 10.0, None, None), (8, 3, "Zebra", None, None, None), (9, 3, "apple", None, None, None),
]
MIXED_DDL = "id long, result_type int, result_string string, result_number double, result_boolean boolean, result_json string"


def test_mixed_results(spark):
    df = spark.createDataFrame(MIXED, MIXED_DDL)
    r = Result.of(F.col)

    def ids(test):
        return sorted(x.id for x in df.where(test).collect())

    assert ids(P.eq(r, "4")) == [1, 2]
    assert ids(P.eq(r, 4)) == [2]
    assert ids(P.eq(r, True)) == [4]
    assert ids(P.gt(r, 4)) == [7]
    assert ids(P.in_(r, ["apple", 10, True])) == [4, 7, 9]
    ordered = df.orderBy(*[c.asc_nulls_last() for c in result_order(r)], "id")
    assert [x.id for x in ordered.collect()] == [1, 3, 8, 9, 2, 7, 4, 6, 5]
    texts = {x.id: x.t for x in df.select("id", values.result_json(r).alias("t")).collect()}
    assert texts[1] == '"4"' and texts[2] == "4" and texts[4] == "true" and texts[5] == '{"a":1}'


def test_json_members(spark):
    docs = [('{"a":1}',), ('{"a":"1"}',), ('{"b":{"c":true}}',), ("not json",), (None,)]
    df = spark.createDataFrame(docs, "d string")
    d = F.col("d")
    rows = df.select(
        P.json_eq(d, "a", 1).alias("n"), P.json_eq(d, "a", "1").alias("s"), P.json_eq(d, "b/c", True).alias("b")
    ).collect()
    assert [r.n for r in rows] == [True, True, None, None, None]
    assert [r.s for r in rows] == [True, True, None, None, None]
    assert [r.b for r in rows] == [None, None, True, None, None]


SQUARE = "POLYGON((0 0, 10 0, 10 10, 0 10, 0 0), (4 4, 6 4, 6 6, 4 6, 4 4))"


# Figures with their relation matrix and the predicates that hold, against a square with a hole.
RELATIONS = [
    ("POINT(2 2)", "0FFFFF212", "within intersects"),
    ("POINT(0 5)", "F0FFFF212", "touches intersects"),
    ("POINT(0 0)", "F0FFFF212", "touches intersects"),
    ("POINT(5 5)", "FF0FFF212", "disjoint"),
    ("POINT(4 5)", "F0FFFF212", "touches intersects"),
    ("POINT(20 5)", "FF0FFF212", "disjoint"),
    ("MULTIPOINT((2 2), (20 20))", "0F0FFF212", "crosses intersects"),
    ("LINESTRING(1 1, 3 3)", "1FF0FF212", "within intersects"),
    ("LINESTRING(-1 5, 11 5)", "101FF0212", "crosses intersects"),
    ("LINESTRING(0 0, 10 0)", "F1FF0F212", "touches intersects"),
    ("LINESTRING(-5 -5, -1 -1)", "FF1FF0212", "disjoint"),
    ("POLYGON((4 4, 6 4, 6 6, 4 6, 4 4))", "FF2F1F212", "touches intersects"),
    ("POLYGON((1 1, 2 1, 2 2, 1 2, 1 1))", "2FF1FF212", "within intersects"),
    ("POLYGON((5 -5, 15 -5, 15 5, 5 5, 5 -5))", "212101212", "overlaps intersects"),
    ("POLYGON((-5 -5, 15 -5, 15 15, -5 15, -5 -5))", "212FF1FF2", "contains intersects"),
    (SQUARE, "2FFF1FFF2", "equals within contains intersects"),
]


def test_relations_with_a_holed_square(spark):
    def geojson(wkt):
        lit = G.literal(wkt)
        flat = {"Point": lit.parts[0][0], "MultiPoint": [p[0] for p in lit.parts], "LineString": lit.parts[0]}
        return json.dumps({"type": lit.type, "coordinates": flat.get(lit.type, lit.parts)})

    tests = (G.within, G.touches, G.disjoint, G.crosses, G.overlaps, G.contains, G.equals, G.intersects)
    df = spark.createDataFrame([(w, geojson(w)) for w, _, _ in RELATIONS], "wkt string, j string")
    shapes = df.select("wkt", G.from_geojson(F.col("j")).alias("g")).cache()
    g = F.col("g")
    rows = shapes.select("wkt", G.relate(g, SQUARE).alias("m"), *[f(g, SQUARE).alias(f.__name__) for f in tests]).collect()
    got = {r.wkt: (r.m, {f.__name__ for f in tests if r[f.__name__]}) for r in rows}
    assert got == {w: (m, set(flags.split())) for w, m, flags in RELATIONS}


def test_points_promise(spark):
    line = G.from_geojson(F.lit('{"type":"LineString","coordinates":[[0,0],[1,1]]}'))
    spot = G.point(F.lit(1.0), F.lit(1.0))
    row = one(spark, G.within(line, SQUARE, points=True).alias("a"), G.within(spot, SQUARE, points=True).alias("b"))
    assert row.a is None and row.b is True


def test_line_measures(spark):
    line = G.from_geojson(F.lit('{"type":"LineString","coordinates":[[0,0],[3,4],[3,10]]}'))
    row = one(spark, G.length(line).alias("l"), G.distance(line, "POINT(6 4)").alias("d"), G.distance(line, "LINESTRING(0 4, 6 4)").alias("z"))
    assert row.l == pytest.approx(11.0) and row.d == pytest.approx(3.0) and row.z == 0.0


@pytest.mark.parametrize(
    "pattern, topic, matches",
    [
        ("a/b", "a/b", True), ("a/b", "a/c", False), ("a/+/c", "a/x/c", True), ("a/+/c", "a/x/y/c", False),
        ("a/+", "a/", True), ("a/#", "a", True), ("a/#", "a/b/c", True), ("a/#", "ab", False), ("#", "x/y", True),
        ("a.b/+", "aXb/c", False), ("+/b", "a/b", True), ("a/+/#", "a", False),
    ],
)
def test_topics(spark, pattern, topic, matches):
    assert one(spark, F.lit(topic).rlike(messages.topic_regex(pattern)).alias("x")).x is matches


def test_topic_order_and_bad_patterns(spark):
    mapping = {"a/+": ["first"], "a/#": ["second"], "a/b": ["exact"]}
    df = spark.createDataFrame([("a/b",), ("a/c",), ("a/c/d",), ("b",)], "topic string")
    assert [r.names for r in messages.route(df, mapping).collect()] == [["exact"], ["first"], ["second"], None]
    with pytest.raises(ValueError):
        messages.topic_regex("a/#/b")


def test_payloads(spark):
    cfg = messages.MessageConfig({"t": ["one", "Skip", "two"]})
    stamp = "2024-01-01T00:00:00Z"
    payloads = [
        f"{stamp},1,2,3,4", f"{stamp},1", stamp, f"{stamp};1", "soon,1", f"{stamp},NaN,x,n/a", f"{stamp},1.234.5", f" {stamp} , 7 ",
        f"{stamp},abc,1,2",
    ]
    df = spark.createDataFrame([("t", p) for p in payloads] + [("other", f"{stamp},1")], "topic string, payload string")
    rows = messages.observations_from_messages(df, cfg).collect()
    got = sorted((r.name, r.result_number, r.result_quality) for r in rows)
    assert got == sorted(
        [("one", 1.0, "11"), ("two", 3.0, "11"), ("one", 1.0, "11"), ("one", -999.0, "00"), ("two", -999.0, "00"), ("one", 7.0, "11"),
         ("two", 2.0, "11")]
    )
    status = {r.status: r.n for r in messages.parse_messages(df, cfg).groupBy("status").agg(F.count("*").alias("n")).collect()}
    assert status == {"ok": 6, "bad payload": 2, "bad time": 1, "no mapping": 1}


def test_numbers(spark):
    texts = ["1,5", "1,234.5", " 7 ", "", "NaN", "1e3", "-0,25"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(values.to_number(F.col("t")).alias("n"))
    got = [r.n for r in df.collect()]
    assert got[0] == 1.5 and got[1] is None and got[2] == 7.0 and got[3] is None and got[5] == 1000.0 and got[6] == -0.25


@pytest.mark.parametrize(
    "text, kind, number, quality",
    [
        ("", "float", -999.9, 0), ("abc", "float", -999.9, 0), ("inf", "float", -999.9, 0), ("nan", "float", -999.9, 0),
        ("1.5", "float", 1.5, 3), ("7", "int", 7.0, 3), ("7.5", "int", -999.9, 0), ("", "string", -999.9, 0), ("dry", "string", None, 3),
    ],
)
def test_station_values(spark, text, kind, number, quality):
    v = values.parse_station_value(F.lit(text), kind)
    row = one(spark, v.number.alias("n"), v.quality.alias("q"))
    assert (row.n, row.q) == (number, quality)


def test_local_time_across_daylight_saving(spark):
    texts = ["31.03.2024 01:30", "31.03.2024 03:30", "2024-01-01T00:00:00", "2024-01-01T00:00:00+05:00", "never"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    micros = F.unix_micros(values.parse_station_time(F.col("t"), "dd.MM.yyyy HH:mm", "Europe/Rome"))
    got = [r.m for r in df.select(micros.alias("m")).collect()]

    def at(*parts):
        return int(datetime(*parts, tzinfo=timezone.utc).timestamp() * 1e6)

    assert got == [at(2024, 3, 31, 0, 30), at(2024, 3, 31, 1, 30), at(2023, 12, 31, 23), at(2023, 12, 31, 19), None]


@pytest.mark.parametrize(
    "text, expected", [("-999.9", True), ("-999.9000000001", True), ("-999.8", False), ("text", False), (None, False)]
)
def test_nodata(spark, text, expected):
    assert one(spark, values.is_nodata(F.lit(text).cast("string"), -999.9).alias("x")).x is expected


def test_bulk_refuses_bad_documents(spark):
    def load(doc):
        return documents.read_bulk(spark.createDataFrame([(json.dumps(doc),)], "doc string"))

    good = {"Datastream": {"@iot.id": 1}, "components": ["phenomenonTime", "result"], "dataArray": [[T, 1], [T + "/" + T, "a"], [T, True]]}
    rows = load([good]).orderBy("row").collect()
    assert [r.result_type for r in rows] == [0, 3, 1] and rows[1].result_string == "a" and rows[2].result_boolean is True
    for fault in ({"components": ["result"]}, {"Datastream": {}}, {"components": ["phenomenonTime", "result", "featureOfInterest"]}):
        with pytest.raises(ValueError):
            load([good, {**good, **fault}])


def test_station_config_needs_one_time_column():
    with pytest.raises(ValueError):
        files.StationConfig((files.StationColumn(0, "float", name="a"),)).time


def test_station_lines_find_their_delimiter(spark):
    cfg = files.StationConfig((files.StationColumn(0, "datetime"), files.StationColumn(1, "string", name="s")))
    lines = ["2024-01-01T00:00:00\ta;b", "2024-01-01T00:00:00;c,d", '2024-01-01T00:00:00,"e,f"', "", "  ", "2024-01-01T00:00:00"]
    got = files.parse_station_lines(spark.createDataFrame([(x,) for x in lines], "value string"), cfg).collect()
    assert [r.result_string for r in got] == ["a;b", "c,d", "e,f"]


def test_zip_files(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x/one.txt", "2024-01-01T00:00:00;1\n2024-01-01T00:01:00;è".encode("latin-1"))
        z.writestr("two.csv", "no")
    cfg = files.StationConfig((files.StationColumn(0, "datetime"), files.StationColumn(1, "string", name="s")), ";")
    got = files.read_zipped_stations(spark, str(tmp_path), {"one.txt": cfg}).orderBy("phenomenon_start").collect()
    assert [r.result_string for r in got] == ["1", "è"]


def patched(spark, doc, *ops):
    docs = spark.createDataFrame([(1, json.dumps(doc)), (2, "{}")], "id long, doc string")
    rows = [(1, i, o["op"], o.get("path"), o.get("from"), json.dumps(o["value"]) if "value" in o else None) for i, o in enumerate(ops)]
    steps = spark.createDataFrame(rows, "id long, seq long, op string, path string, origin string, value string")
    return {r.id: r for r in mutations.json_patch(docs, steps).collect()}


def test_json_patch_operations(spark):
    doc = {"a": [1, 2], "b": {"c": 1}, "x/y": 0}
    row = patched(
        spark, doc, {"op": "add", "path": "/a/-", "value": 3}, {"op": "add", "path": "/a/0", "value": 0},
        {"op": "replace", "path": "/b/c", "value": None}, {"op": "move", "from": "/b", "path": "/d"},
        {"op": "copy", "from": "/a", "path": "/e"}, {"op": "remove", "path": "/a/1"}, {"op": "remove", "path": "/x~1y"},
        {"op": "test", "path": "/e", "value": [0, 1, 2, 3]},
    )[1]
    assert row.patched and json.loads(row.doc) == {"a": [0, 2, 3], "d": {"c": None}, "e": [0, 1, 2, 3]}


@pytest.mark.parametrize(
    "op",
    [
        {"op": "test", "path": "/a", "value": 2}, {"op": "remove", "path": "/z"}, {"op": "replace", "path": "/z", "value": 1},
        {"op": "add", "path": "/z/y", "value": 1}, {"op": "add", "path": "z", "value": 1}, {"op": "add", "path": "/z"},
        {"op": "move", "from": "/o", "path": "/o/p"}, {"op": "spin", "path": "/a"}, {"op": "remove", "path": ""},
        {"op": "add", "path": "/l/9", "value": 1}, {"op": "test", "path": "/t", "value": 1},
    ],
)
def test_json_patch_rejects_all_of_an_id(spark, op):
    doc = {"a": 1, "o": {"p": 1}, "l": [], "t": True}
    rows = patched(spark, doc, {"op": "add", "path": "/new", "value": 1}, op)
    assert not rows[1].patched and rows[1].reason and json.loads(rows[1].doc) == doc
    assert not rows[2].patched and rows[2].reason is None


def test_time_travel_rules(spark):
    rows = spark.createDataFrame([(1, "a")], "id long, name string").selectExpr(
        "*", "timestamp'2020-01-01' AS valid_from", "CAST(NULL AS timestamp) AS valid_to", "1L AS commit_id"
    )
    catalog = Catalog(spark, {"thing": rows, "datastream": rows})
    assert catalog.as_of("2020-01-01T00:00:00").table("thing").count() == 1
    assert catalog.as_of("2019-12-31T23:59:59Z").table("thing").count() == 0
    assert catalog.from_to("2021-01-01T00:00:00Z", "2021-01-01T00:00:00Z").table("thing").count() == 0
    with pytest.raises(ValueError):
        catalog.as_of("2999-01-01T00:00:00Z")
    with pytest.raises(ValueError):
        catalog.from_to("2021-01-02T00:00:00Z", "2021-01-01T00:00:00Z")
    with pytest.raises(ValueError):
        catalog.as_of("2021-01-01T00:00:00Z").from_to("2020-01-01T00:00:00Z", "2021-01-01T00:00:00Z")
    with pytest.raises(ValueError):
        Query.on(catalog, "Things").from_to("2020-01-01T00:00:00Z", "2021-01-01T00:00:00Z").expand(Expand("Datastreams")).rows()


def test_commit_rules(spark):
    with pytest.raises(ValueError):
        versions.commit(spark, 1, "", "me", "UPDATE", T)
    with pytest.raises(ValueError):
        versions.commit(spark, 1, "why", "me", "PATCH", T)
    assert versions.commit(spark, 1, "why", "me", "DELETE", T).first().action_type == "DELETE"


def test_two_changes_in_one_batch(spark):
    feed = [(1, "2024-01-01", 1, "CREATE", "a"), (1, "2024-01-01", 2, "UPDATE", "b"), (1, "2024-02-01", 3, "DELETE", "b"), (1, "2024-03-01", 4, "CREATE", "c")]
    df = spark.createDataFrame(feed, "id long, day string, seq long, action string, name string").withColumn("ts", F.to_timestamp("day")).drop("day")
    got = [(r.name, str(r.valid_from.date()), r.valid_to and str(r.valid_to.date())) for r in versions.to_versions(df).orderBy("valid_from").collect()]
    assert got == [("b", "2024-01-01", "2024-02-01"), ("c", "2024-03-01", None)]


def test_unmatched_changes(spark):
    current = spark.createDataFrame([(1,)], "id long")
    changes = spark.createDataFrame([(1, "UPDATE"), (2, "DELETE"), (3, "CREATE")], "id long, action string")
    assert [r.id for r in versions.unmatched(current, changes).collect()] == [2]


def test_shared_location_gives_one_feature(spark):
    spot = G.point(F.lit(1.0), F.lit(2.0))
    place = spark.range(1).select(
        F.lit(7).cast("long").alias("id"), F.lit("p").alias("name"), F.lit("").alias("description"), F.lit("e").alias("encoding_type"),
        spot.alias("location"), F.lit(None).cast("string").alias("properties"), F.lit(None).cast("long").alias("gen_foi_id"),
    )
    catalog = Catalog(spark, {
        "location": place, "thing_location": spark.createDataFrame([(1, 7), (2, 7)], "thing_id long, location_id long"),
        "datastream": spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "id long, thing_id long"),
        "feature_of_interest": spark.createDataFrame([], "id long, name string, description string, encoding_type string, feature " + G_DDL + ", properties string"),
    })
    obs = spark.createDataFrame([(1, 1, None), (2, 2, None), (3, 3, None)], "id long, datastream_id long, feature_of_interest_id long")
    state, ready, rejects = mutations.ensure_feature(catalog, obs)
    assert {r.feature_of_interest_id for r in ready.collect()} == {1}
    assert [r.id for r in rejects.collect()] == [3]
    assert state.table("feature_of_interest").count() == 1 and state.table("location").first().gen_foi_id == 1


G_DDL = "struct<type:string,coords:array<array<array<double>>>,xmin:double,ymin:double,xmax:double,ymax:double>"


def test_quality_flags_win_in_order(spark):
    def at(hour):
        return datetime(2024, 1, 1, hour, tzinfo=timezone.utc)

    rows = [(i, 1, at(i), v, "temperature") for i, v in enumerate([None, float("nan"), 20.0, 20.05, 99.0, 21.0])]
    df = spark.createDataFrame(rows, "id long, datastream_id long, phenomenon_start timestamp, result_number double, kind string")
    assert [r.flag for r in quality.run_qc(df, "kind").orderBy("id").collect()] == [90, 90, None, 91, 93, None]


def test_load_report_and_legacy(spark):
    df = spark.createDataFrame([Row(status="copied"), Row(status="copied"), Row(status="exists")])
    assert {r.status: r.rows for r in loading.load_report(df).collect()} == {"copied": 2, "exists": 1}
    legacy = spark.createDataFrame([(1, T, "3.0", "210"), (1, T, " wet ", "0")], "datastream_id long, time string, value string, quality string")
    got = loading.from_legacy(legacy).collect()
    assert got[0].result_string == "3" and got[1].result_type == 3 and got[1].result_string == "wet"
