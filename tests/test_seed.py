"""The conformance seed tree: one thing, two datastreams, four observations."""

import json
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from sensorquery import schema
from sensorquery.catalog import Catalog
from sensorquery.functions import geometry as G
from sensorquery.functions import predicates as P
from sensorquery.functions import scalars as S
from sensorquery.operators import maintain, mutations
from sensorquery.operators.query import Expand, Query
from sensorquery.sources import sinks
from sensorquery.sources.documents import flatten_documents

OBSERVATION_TYPE = "http://www.opengis.net/def/observationType/OGC-OM/2.0/OM_Measurement"


def stream(number, unit, symbol, observed, sensor, readings):
    return {
        "name": f"datastream name {number}", "description": f"datastream {number}",
        "observationType": OBSERVATION_TYPE,
        "unitOfMeasurement": {"name": unit, "symbol": symbol, "definition": "u"},
        "ObservedProperty": {"name": observed, "definition": "d", "description": f"observedProperty {number}"},
        "Sensor": {
            "name": f"sensor name {number}", "description": f"sensor {number}",
            "encodingType": "application/pdf", "metadata": sensor,
        },
        "Observations": [{"phenomenonTime": t, "result": r} for t, r in readings],
    }


TREE = {
    "name": "thing name 1", "description": "thing 1", "properties": {"reference": "firstThing"},
    "Locations": [
        {
            "name": "location name 1", "description": "location 1",
            "properties": {"reference": "firstLocation"},
            "location": {"type": "Point", "coordinates": [-117.05, 51.05]},
            "encodingType": "application/vnd.geo+json",
        }
    ],
    "Datastreams": [
        stream(1, "Lumen", "lm", "Luminous Flux", "Light flux sensor",
               [("2015-03-03T00:00:00Z", 3), ("2015-03-04T00:00:00Z", 4)]),
        stream(2, "Centigrade", "C", "Tempretaure", "Tempreture sensor",
               [("2015-03-05T00:00:00Z", 5), ("2015-03-06T00:00:00Z", 6)]),
    ],
}


@pytest.fixture(scope="module")
def catalog(spark):
    docs = spark.createDataFrame([(1, json.dumps(TREE))], "doc_id long, doc string")
    parts = flatten_documents(docs)
    tables = {}
    for name in schema.TABLES:
        rows = spark.createDataFrame([], schema.struct(name))
        if name in parts:
            rows = rows.unionByName(parts[name], allowMissingColumns=True)
        tables[name] = rows.select(*schema.columns(name)).cache()
    state = Catalog(spark, tables)
    obs = tables["observation"]
    state, ready, rejects = mutations.ensure_feature(state, obs)
    assert rejects.count() == 0
    streams = maintain.merge_extents(state.table("datastream"), ready)
    streams = maintain.set_area(streams, maintain.observed_area(ready, state.table("feature_of_interest")))
    return state.replace(observation=ready.cache(), datastream=streams.cache())


@pytest.fixture
def q(catalog):
    return SimpleNamespace(
        obs=Query.on(catalog, "Observations"), ds=Query.on(catalog, "Datastreams"), things=Query.on(catalog, "Things"),
        places=Query.on(catalog, "Locations"), features=Query.on(catalog, "FeaturesOfInterest"),
    )


def results(query):
    return sorted(r[0] for r in query.rows().select("result_number").collect())


def x(r):
    return r("result")


@pytest.mark.parametrize(
    "predicate, expected",
    [
        (lambda r: P.eq(x(r), 4), [4]),
        (lambda r: P.ne(x(r), 4), [3, 5, 6]),
        (lambda r: P.gt(x(r), 4), [5, 6]),
        (lambda r: P.ge(x(r), 4), [4, 5, 6]),
        (lambda r: P.lt(x(r), 5), [3, 4]),
        (lambda r: P.le(x(r), 4), [3, 4]),
        (lambda r: P.gt(x(r), 3) & P.lt(x(r), 6), [4, 5]),
        (lambda r: P.lt(x(r), 4) | P.gt(x(r), 5), [3, 6]),
        (lambda r: ~P.gt(x(r), 4), [3, 4]),
        (lambda r: P.gt(x(r), 5) | P.gt(x(r), 3) & P.lt(x(r), 5), [4, 6]),
        (lambda r: (P.gt(x(r), 5) | P.gt(x(r), 3)) & P.lt(x(r), 5), [4]),
        (lambda r: P.eq(P.add(x(r), 1), 5), [4]),
        (lambda r: P.eq(P.sub(x(r), 1), 4), [5]),
        (lambda r: P.eq(P.mul(x(r), 2), 8), [4]),
        (lambda r: P.eq(P.div(x(r), 2), 2), [4]),
        (lambda r: P.eq(P.mod(x(r), 2), 0), [4, 6]),
        (lambda r: P.eq(S.day(r("phenomenonTime")), 3), [3]),
        (lambda r: P.ge(S.day(r("phenomenonTime")), 5), [5, 6]),
        (lambda r: P.gt(r("phenomenonTime"), "2015-03-04T12:00:00Z"), [5, 6]),
        (lambda r: P.lt("2015-03-04T12:00:00Z", r("phenomenonTime")), [5, 6]),
        (lambda r: P.eq(x(r), "4"), [4]),
        (lambda r: P.is_null(r("resultTime")), [3, 4, 5, 6]),
        (lambda r: P.eq(r("Datastream/name"), "datastream name 2"), [5, 6]),
        (lambda r: P.eq(r("Datastream/Thing/id"), 1) & P.gt(x(r), 4), [5, 6]),
        (lambda r: P.eq(S.round(x(r)), 3), [3]),
        (lambda r: P.eq(S.floor(x(r)), 3) | P.eq(S.ceiling(x(r)), 6), [3, 6]),
        (lambda r: P.in_(x(r), [3, 6]), [3, 6]),
        (lambda r: P.gt(r("phenomenonTime").lower, S.now()), []),
    ],
)
def test_observation_filters(q, predicate, expected):
    assert results(q.obs.filter(predicate)) == expected


@pytest.mark.parametrize(
    "predicate, expected",
    [
        (lambda r: P.eq(S.indexof(r("name"), "name"), 12), [1, 2]),
        (lambda r: P.eq(S.length(r("name")), 17), [1, 2]),
        (lambda r: S.startswith(r("name"), "datastream"), [1, 2]),
        (lambda r: S.endswith(r("name"), "1"), [1]),
        (lambda r: S.substringof("name 2", r("name")), [2]),
        (lambda r: P.eq(S.substring(r("name"), 11), "name 1"), [1]),
        (lambda r: P.eq(S.substring(r("name"), 0, 4), "data"), [1, 2]),
        (lambda r: P.eq(S.toupper(r("name")), "DATASTREAM NAME 1"), [1]),
        (lambda r: P.eq(S.concat(r("name"), "!"), "datastream name 2!"), [2]),
        (lambda r: P.eq(r("Observations/id"), 3), [2]),
        (lambda r: P.eq(r("Sensor/name"), "sensor name 1"), [1]),
        (lambda r: P.eq(r("unitOfMeasurement/symbol"), "C"), [2]),
        (lambda r: P.eq(r("phenomenonTime"), "2015-03-03T12:00:00Z"), [1]),
    ],
)
def test_datastream_filters(q, predicate, expected):
    assert sorted(r.id for r in q.ds.filter(predicate).rows().collect()) == expected


INSIDE = "POLYGON((-118 50,-116 50,-116 52,-118 52,-118 50))"
APART = "POLYGON((0 0,1 0,1 1,0 1,0 0))"
SPOT, FAR = "POINT(-117.05 51.05)", "POINT(0 0)"


@pytest.mark.parametrize(
    "test, expected",
    [
        (lambda g: G.intersects(g, INSIDE), True), (lambda g: G.intersects(g, APART), False),
        (lambda g: G.distance(g, FAR) > 1, True), (lambda g: G.distance(g, SPOT) < 1, True),
        (lambda g: G.length(g) < 1, True), (lambda g: G.length("LINESTRING(0 0, 0 1)") > 0, True),
        (lambda g: G.within(g, INSIDE), True), (lambda g: G.within(g, APART), False),
        (lambda g: G.disjoint(g, APART), True), (lambda g: G.disjoint(g, INSIDE), False),
        (lambda g: G.equals(g, SPOT), True), (lambda g: G.equals(g, FAR), False),
        (lambda g: G.contains(g, SPOT), True), (lambda g: G.touches(g, INSIDE), False),
        (lambda g: G.overlaps(g, INSIDE), False), (lambda g: G.crosses(g, INSIDE), False),
        (lambda g: G.relate(g, SPOT, "T********"), True), (lambda g: G.relate(g, FAR, "T********"), False),
    ],
)
def test_geometry_filters(q, test, expected):
    assert q.places.filter(lambda r: test(r("location"))).rows().count() == int(expected)
    assert q.features.filter(lambda r: test(r("feature"))).rows().count() == int(expected)


def test_order_and_pages(q):
    ordered = q.obs.order_by("result desc").top(10)
    assert [r.result_number for r in ordered.page_rows().collect()] == [6, 5, 4, 3]
    with pytest.raises(ValueError):
        q.obs.page_rows()
    rows, following = q.obs.order_by("result").top(2).page()
    assert [r.result_number for r in rows.collect()] == [3, 4]
    assert following.first().next_skip == 2
    last, following = q.obs.order_by("result").top(2).skip(2).page()
    assert [r.result_number for r in last.collect()] == [5, 6]
    assert following.first().next_skip is None
    assert q.obs.top(0).page_rows().count() == 0
    assert q.obs.top(9).skip(99).page_rows().count() == 0


def test_counts(q):
    assert q.obs.top(2).count_total().first()["count"] == 4
    assert q.obs.skip(3).count_total().first()["count"] == 4
    assert q.obs.filter(lambda r: P.gt(x(r), 99)).count_total().first()["count"] == 0
    assert tuple(q.obs.count_capped(10).first()) == (4, False) and tuple(q.obs.count_capped(3).first()) == (3, True)
    assert tuple(q.obs.count_capped(4).first()) == (4, False) and q.obs.count_estimate().first()["count"] == 4


def test_combination(q):
    query = q.obs.filter(lambda r: P.gt(x(r), 3)).order_by("result desc").skip(1).top(2).select("result")
    page = json.loads(sinks.to_page(query, count=True).first().page)
    assert [v["result"] for v in page["value"]] == [5, 4]
    assert page["@iot.count"] == 3
    assert "@iot.nextLink" not in page


def test_navigation(q):
    assert [r.id for r in q.things.by_id(1).navigate("Datastreams", 2).navigate("Observations").rows().orderBy("id").collect()] == [3, 4]
    assert q.obs.by_id(1).navigate("Datastream").navigate("Sensor").rows().first().name == "sensor name 1"
    assert q.things.by_id(1).navigate("Locations").navigate("Things").rows().count() == 1
    assert q.things.by_id(2).navigate("Datastreams").rows().count() == 0


def test_nested_expand(q):
    readings = Expand("Observations", order=("result desc",), top=1, count=True, select=("id", "result"))
    streams = Expand("Datastreams", top=100, expand=(readings, Expand("Sensor")))
    page = sinks.to_page(q.things.top(100).expand(streams, Expand("Locations", top=100)))
    thing = json.loads(page.first().page)["value"][0]
    assert thing["properties"] == {"reference": "firstThing"}
    assert thing["Locations"][0]["location"] == {"type": "Point", "coordinates": [-117.05, 51.05]}
    first, second = thing["Datastreams"]
    assert first["Sensor"]["name"] == "sensor name 1" and second["Sensor"]["metadata"] == "Tempreture sensor"
    assert [o["result"] for o in first["Observations"]] == [4]
    assert first["Observations@iot.count"] == 2
    assert first["Observations@iot.nextLink"].endswith("/Datastreams(1)/Observations?$top=1&$skip=1")
    assert first["phenomenonTime"] == "2015-03-03T00:00:00Z/2015-03-04T00:00:00Z"
    assert first["observedArea"] == {"type": "Point", "coordinates": [-117.05, 51.05]}


def test_expand_without_match(catalog):
    lonely = catalog.replace(sensor=catalog.table("sensor").where(F.lit(False)))
    doc = json.loads(Query.on(lonely, "Datastreams").expand("Sensor").top(1).documents().first().json)
    assert doc["Sensor"] == {}
    empty = Query.on(catalog, "Datastreams").top(5).expand(Expand("Observations", filter=lambda r: P.gt(x(r), 99), top=5, count=True))
    doc = json.loads(empty.documents().first().json)
    assert doc["Observations"] == [] and doc["Observations@iot.count"] == 0


def test_skip_past_the_end_keeps_the_count(q):
    doc = json.loads(q.ds.top(1).expand(Expand("Observations", top=5, skip=50, count=True)).documents().first().json)
    assert doc["Observations"] == [] and doc["Observations@iot.count"] == 2


def test_any_and_all(q):
    assert [r.id for r in q.ds.where_any("Observations", lambda r: P.gt(x(r), 4)).rows().collect()] == [2]
    assert [r.id for r in q.ds.where_all("Observations", lambda r: P.lt(x(r), 5)).rows().collect()] == [1]
    assert q.things.where_any("Locations", lambda r: P.eq(r("name"), "location name 1")).rows().count() == 1


def test_data_array(q):
    groups = sinks.to_data_array(q.obs.filter(lambda r: P.eq(r("Datastream/id"), 1)).rows(), ("id", "phenomenonTime", "result"))
    row = groups.first()
    assert row["count"] == 2
    assert json.loads(row.data_array) == [[1, "2015-03-03T00:00:00Z", 3], [2, "2015-03-04T00:00:00Z", 4]]
    with pytest.raises(ValueError):
        sinks.to_data_array(q.obs.rows(), ("colour",))


def test_unknown_names_are_refused(q):
    with pytest.raises(ValueError):
        q.things.select("colour").projected()
    with pytest.raises(ValueError):
        q.things.filter(lambda r: r("colour") == 1).rows()
    with pytest.raises(ValueError):
        q.things.navigate("Observations")
    with pytest.raises(ValueError):
        q.obs.order_by("result upwards").top(1).page_rows()


def test_links_and_raw_values(q, catalog):
    row = sinks.refs(q.things.rows(), "Things", "http://h").first()
    assert row["@iot.selfLink"] == "http://h/Things(1)"
    values = sinks.raw_value(catalog.table("observation"), "Observation", "result").orderBy("id").collect()
    assert [r.value for r in values] == ["3", "4", "5", "6"]
    assert sinks.raw_value(catalog.table("observation"), "Observation", "resultTime").first().value == "null"


def test_one_feature_per_location(catalog):
    assert catalog.table("feature_of_interest").count() == 1
    assert catalog.table("location").first().gen_foi_id == 1
    assert catalog.table("historical_location").count() == 1


def test_delete_with_upkeep(spark, catalog):
    """Deleting by filter repairs the extent and the area of the datastream."""
    lonlat = [(-80.0, -60.0), (80.0, 70.0), (10.0, 45.0), (10.4, 45.0), (10.2, 45.4)]
    features = spark.createDataFrame([(i, *p) for i, p in enumerate(lonlat)], "id long, x double, y double").select(
        "id", G.point(F.col("x"), F.col("y")).alias("feature")
    )
    times = ["2000-01-01", "2000-01-02", "2020-06-01", "2020-06-02", "2020-06-03"]
    rows = [(i, t, r, i) for i, (t, r) in enumerate(zip(times, [1.0, 2.0, 10.0, 11.0, 12.0]))]
    obs = spark.createDataFrame(rows, "id long, day string, result_number double, feature_of_interest_id long").select(
        "id", F.to_timestamp("day").alias("phenomenon_start"), F.to_timestamp("day").alias("phenomenon_end"),
        F.lit(None).cast("timestamp").alias("result_time"), F.lit(0).alias("result_type"),
        F.lit(None).cast("string").alias("result_string"), "result_number", F.lit(None).cast("boolean").alias("result_boolean"),
        F.lit(None).cast("string").alias("result_json"), F.lit(1).cast("long").alias("datastream_id"), "feature_of_interest_id",
    )
    streams = maintain.merge_extents(catalog.table("datastream").where("id = 1"), obs)
    state = catalog.replace(observation=obs, datastream=streams, feature_of_interest=features)
    after, lost = mutations.delete_where(state, lambda r: P.lt(x(r), 10))
    assert lost.count() == 2
    ds = after.table("datastream").first()
    assert str(ds.phenomenon_start.date()) == "2020-06-01" and str(ds.phenomenon_end.date()) == "2020-06-03"
    area = ds.observed_area
    assert 9 < area.xmin <= area.xmax < 11 and 44 < area.ymin <= area.ymax < 46
    with pytest.raises(ValueError):
        mutations.delete_where(state, None)
    none, _ = mutations.delete_where(state, lambda r: P.ge(x(r), 0))
    ds = none.table("datastream").first()
    assert ds.phenomenon_start is None and ds.phenomenon_end is None and ds.observed_area is None
