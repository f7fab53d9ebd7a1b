"""Deep inserts from every root: links in both directions, ids in document order, nothing half stored."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from sensorquery import schema
from sensorquery.catalog import Catalog
from sensorquery.operators import identity
from sensorquery.sources import documents, nested

AT = "2024-05-01T00:00:00Z"
POINT = {"type": "Point", "coordinates": [1, 2]}
SENSOR = {"name": "n", "description": "d", "encodingType": "text", "metadata": "m"}
PROPERTY = {"name": "p", "description": "d", "definition": "x"}
PLACE = {"name": "l", "description": "d", "encodingType": "geo", "location": POINT}
FEATURE = {"name": "f", "description": "d", "encodingType": "geo", "feature": POINT}
READING = {"phenomenonTime": "2024-01-01T00:00:00Z", "result": 1}


def stream(**more):
    return {"name": "s", "description": "d", "observationType": "o", "unitOfMeasurement": {"name": "u"}, **more}


def thing(**more):
    return {"name": "t", "description": "d", **more}


@pytest.fixture
def catalog(spark):
    def table(name, rows, layout):
        return spark.createDataFrame([], schema.struct(name)).unionByName(spark.createDataFrame(rows, layout), allowMissingColumns=True)

    held = {
        "thing": ([(7, "old thing")], "id long, name string"), "location": ([(4, "old place")], "id long, name string"),
        "thing_location": ([(7, 4)], "thing_id long, location_id long"), "sensor": ([(3, "old")], "id long, name string"),
        "observed_property": ([(2, "old")], "id long, name string"), "feature_of_interest": ([(9, "old")], "id long, name string"),
        "datastream": ([(11, "old", 7, 3, 2)], "id long, name string, thing_id long, sensor_id long, observed_property_id long"),
        "observation": ([(100, 11, 9)], "id long, datastream_id long, feature_of_interest_id long"),
    }
    return Catalog(spark, {n: table(n, *held.get(n, ([], "id long" if "id" in schema.columns(n) else schema.TABLES[n]))) for n in schema.TABLES})


def insert(spark, catalog, *docs, root="Thing", **more):
    rows = [(i, d if isinstance(d, str) else json.dumps(d)) for i, d in enumerate(docs, 1)]
    return documents.deep_insert(catalog, spark.createDataFrame(rows, "doc_id long, doc string"), AT, root, **more)


def reasons(rejects):
    return {r.doc_id: r.reason for r in rejects.collect()}


def test_location_root_moves_stored_things_and_creates_new_ones(spark, catalog):
    inner = thing(Datastreams=[stream(Sensor=SENSOR, ObservedProperty={"@iot.id": 2}, Observations=[READING])])
    state, parts, rejects = insert(spark, catalog, {**PLACE, "Things": [{"@iot.id": 7}, inner]}, root="Locations")
    assert rejects.count() == 0
    assert sorted(map(tuple, state.table("thing_location").collect())) == [(7, 5), (8, 5)]
    visits = state.table("historical_location").collect()
    assert sorted(r.thing_id for r in visits) == [7, 8] and all(r.time is not None for r in visits)
    assert sorted((r.location_id, r.historical_location_id) for r in state.table("location_historical_location").collect()) == [(5, 1), (5, 2)]
    new = parts["datastream"].first()
    assert (new.id, new.thing_id, new.sensor_id, new.observed_property_id) == (12, 8, 4, 2)
    assert [r.datastream_id for r in parts["observation"].collect()] == [12]


def test_sensor_property_network_and_datastream_roots(spark, catalog):
    docs = [
        ("Sensor", {**SENSOR, "Datastreams": [stream(Thing={"@iot.id": 7}, ObservedProperty=PROPERTY), {"@iot.id": 11}]}),
        ("ObservedProperties", {**PROPERTY, "name": "p2", "Datastreams": [stream(Thing=thing(), Sensor={"@iot.id": 3})]}),
        ("Network", {"name": "net", "Datastreams": [{"@iot.id": 11}]}),
        ("Datastream", stream(Thing=thing(name="t2", Locations=[PLACE]), Sensor=SENSOR, ObservedProperty={"@iot.id": 2}, Observations=[READING])),
    ]
    rows = spark.createDataFrame([(i, e, json.dumps(d)) for i, (e, d) in enumerate(docs)], "doc_id long, entity string, doc string")
    state, parts, rejects = documents.deep_insert(catalog, rows, AT)
    assert rejects.count() == 0
    new = sorted((r.id, r.thing_id, r.sensor_id, r.observed_property_id) for r in parts["datastream"].collect())
    assert new == [(12, 7, 4, 3), (13, 8, 3, 4), (14, 9, 5, 2)]
    old = state.table("datastream").where("id = 11").first()
    assert (old.sensor_id, old.network_id, old.thing_id) == (4, 1, 7)
    assert state.table("thing").where("id = 9").first().name == "t2"
    made = parts["observation"].first()
    feature = state.table("feature_of_interest").where(F.col("id") == made.feature_of_interest_id).first()
    assert made.datastream_id == 14 and feature.name == "l"  # taken from the place of the thing


def test_feature_and_observation_roots(spark, catalog):
    state, parts, rejects = insert(
        spark, catalog, {**FEATURE, "Observations": [{**READING, "Datastream": {"@iot.id": 11}}, {"@iot.id": 100}]}, root="FeatureOfInterest")
    assert rejects.count() == 0 and parts["feature_of_interest"].first().id == 10
    assert {r.id: r.feature_of_interest_id for r in state.table("observation").collect()} == {100: 10, 101: 10}
    late = {**READING, "Datastream": {"@iot.id": 11}, "FeatureOfInterest": {"@iot.id": 9}, "validTime": "2024-01-01T00:00:00Z/2024-01-02T00:00:00Z"}
    _, parts, rejects = insert(spark, catalog, {k: v for k, v in late.items() if k != "phenomenonTime"}, root="Observation")
    made = parts["observation"].first()
    assert rejects.count() == 0 and made.valid_end is not None
    assert parts["observation"].select(F.unix_seconds("phenomenon_start")).first()[0] == 1714521600  # dated by the insert


def test_historical_locations_with_their_time(spark, catalog):
    past = {"time": "2020-01-01T00:00:00Z", "Locations": [{"@iot.id": 4}]}
    state, _, rejects = insert(spark, catalog, thing(HistoricalLocations=[past]), {**past, "Thing": {"@iot.id": 7}, "time": "noon"})
    assert reasons(rejects)[2].startswith("unknown: Thing,time")
    row = state.table("historical_location").select("thing_id", F.year("time").alias("y")).first()
    assert tuple(row) == (8, 2020)
    assert state.table("thing_location").count() == 1  # a past place is no present one
    _, _, rejects = insert(spark, catalog, {**past, "Thing": {"@iot.id": 7}, "time": "noon"}, root="HistoricalLocation")
    assert reasons(rejects) == {1: "bad time: time"}


@pytest.mark.parametrize("broken, reason", [
    (thing(Datastreams=[stream()]), "missing: Datastreams.Sensor,Datastreams.ObservedProperty"),
    (thing(Datastreams=[{"Sensor": SENSOR, "ObservedProperty": PROPERTY}]),
     "missing: Datastreams.name,Datastreams.description,Datastreams.unitOfMeasurement,Datastreams.observationType"),
    (thing(Locations=PLACE), "not a list: Locations"),
    (thing(Locations=["here"]), "not an object: Locations"),
    (thing(Locations=[{**PLACE, "location": {"type": "Point", "coordinates": []}}]), "not a geometry: Locations.location"),
    (thing(Locations=[{**PLACE, "location": {**POINT, "crs": {"properties": {"name": "EPSG:3857"}}}}]),
     "other reference system: Locations.location"),
    (thing(Locations=[{"@iot.id": 5}]), "unknown id: Locations.5"),
    (thing(Locations=[{"@iot.id": "4"}]), "id is not an integer: Locations"),
    (thing(Locations=[{"@iot.id": 4, "name": "x"}]), "more than an id: Locations"),
    (thing(Locations=[{**PLACE, "Things": [thing(colour=1)]}]), "unknown: Locations.Things.colour"),
    (thing(Datastreams=[stream(Sensor=SENSOR, ObservedProperty=PROPERTY, Thing={"@iot.id": 7})]), "given by its parent: Datastreams.Thing"),
    (thing(Datastreams=[stream(Sensor=SENSOR, ObservedProperty=PROPERTY, Observations=[{**READING, "phenomenonTime": "some day"}])]),
     "bad time: Datastreams.Observations.phenomenonTime"),
    (thing(Datastreams=[stream(Sensor=SENSOR, ObservedProperty=PROPERTY, Observations=[{"phenomenonTime": "2024-01-01T00:00:00Z"}])]),
     "missing: Datastreams.Observations.result"),
    (thing(Datastreams=[stream(Sensor=SENSOR, ObservedProperty=PROPERTY, Observations=[{**READING, "result": [1]}])]),
     "result has no type: Datastreams.Observations.result"),
    (thing(Datastreams=[stream(Sensor={**SENSOR, "name": 3}, ObservedProperty=PROPERTY)]), "wrong type: Datastreams.Sensor.name"),
    ("[1]", "not an object: document"), ("{oops", "not an object"), ('{"name": NaN}', "not an object"), ("", "not an object"),
])
def test_a_defect_at_any_depth_rejects_its_document_whole(spark, broken, reason):
    text = broken if isinstance(broken, str) else json.dumps(broken)
    docs = spark.createDataFrame([(1, text), (2, json.dumps(thing(name="sound")))], "doc_id long, doc string")
    found = nested.members(docs)
    known = {t: spark.createDataFrame([(i,)], "id long") for t, i in (("location", 4), ("thing", 7))}
    rejects = nested.judged(found).unionByName(nested.unknown_links(found.where("reason is null"), known).select("part", "nr", "doc_id", "reason"))
    assert reasons(rejects) == {1: reason}


def test_rejected_documents_take_no_ids_and_commits_are_stamped(spark, catalog):
    committed = {n: catalog.table(n).withColumn("commit_id", F.lit(1).cast("long")) for n in ("thing", "observation")}
    state, parts, rejects = insert(
        spark, catalog.replace(**committed), thing(name="a"), thing(colour=1), None, thing(name="b"),
        commit={"author": "me", "message": "load"})
    assert set(reasons(rejects)) == {2, 3}
    assert sorted((r.id, r.name) for r in parts["thing"].select("id", "name").collect()) == [(8, "a"), (9, "b")]
    assert {r.commit_id for r in state.table("thing").where("id > 7").collect()} == {1}
    log = state.table("commit_log").first()
    assert (log.id, log.author, log.action_type) == (1, "me", "CREATE")


def test_readings_are_parsed_once(spark, catalog, monkeypatch):
    given, known = [], documents.mutations.insert_observations
    monkeypatch.setattr(documents.mutations, "insert_observations", lambda state, rows: given.append(rows) or known(state, rows))
    docs = (stream(Thing=thing(Locations=[PLACE]), Sensor=SENSOR, ObservedProperty={"@iot.id": 2}, Observations=[READING]),)
    insert(spark, catalog, *docs, root="Datastream")
    assert given[0].count() == 1
    plan = given[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" in plan and "from_json" not in plan  # written rows, not the documents again


def test_repeated_and_missing_document_ids(spark, catalog):
    text = json.dumps(thing(Locations=[PLACE]))
    docs = spark.createDataFrame([(5, text), (5, text), (None, text), (5, "{")], "doc_id long, doc string")
    state, parts, rejects = documents.deep_insert(catalog, docs, AT)
    assert parts["thing"].count() == 3 and parts["location"].count() == 3 and state.table("thing_location").count() == 4
    assert reasons(rejects) == {5: "not an object"}
    _, parts, rejects = documents.deep_insert(catalog, docs.where("doc_id = 99"), AT)
    assert parts["thing"].count() == 0 and rejects.count() == 0


def test_ids_of_several_tables_in_one_allocation(spark):
    rows = spark.range(1000).select(
        F.when(F.col("id") % 3 == 0, "x").otherwise("y").alias("kind"), (F.col("id") / 100).cast("int").alias("part"), F.col("id").alias("nr"))
    got = identity.allocate_ids(rows.repartition(5), "kind", "part", ["nr"], {"x": 50}).collect()
    for kind, start in (("x", 50), ("y", 1)):
        mine = sorted((r.nr, r.id) for r in got if r.kind == kind)
        assert [i for _, i in mine] == list(range(start, start + len(mine)))
