"""Entity tables, property names and the relation graph of the sensor data model."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import types as T

GEOMETRY = (
    "struct<type:string,coords:array<array<array<double>>>,"
    "xmin:double,ymin:double,xmax:double,ymax:double>"
)
UNIT = "struct<name:string,symbol:string,definition:string>"

# Table columns. Version columns (valid_from, valid_to, commit_id) are added by versioned tables.
TABLES = {
    "thing": "id long, name string, description string, properties string",
    "location": (
        "id long, name string, description string, encoding_type string, "
        f"location {GEOMETRY}, properties string, gen_foi_id long"
    ),
    "thing_location": "thing_id long, location_id long",
    "historical_location": "id long, time timestamp, thing_id long",
    "location_historical_location": "location_id long, historical_location_id long",
    "observed_property": (
        "id long, name string, definition string, description string, properties string"
    ),
    "sensor": (
        "id long, name string, description string, encoding_type string, "
        "sensor_metadata string, properties string"
    ),
    "datastream": (
        f"id long, name string, description string, unit_of_measurement {UNIT}, "
        f"observation_type string, observed_area {GEOMETRY}, "
        "phenomenon_start timestamp, phenomenon_end timestamp, "
        "result_start timestamp, result_end timestamp, properties string, "
        "thing_id long, sensor_id long, observed_property_id long, network_id long, last_foi_id long"
    ),
    "feature_of_interest": (
        "id long, name string, description string, encoding_type string, "
        f"feature {GEOMETRY}, properties string"
    ),
    "observation": (
        "id long, phenomenon_start timestamp, phenomenon_end timestamp, result_time timestamp, "
        "result_type int, result_string string, result_number double, result_boolean boolean, "
        "result_json string, result_quality string, valid_start timestamp, valid_end timestamp, "
        "parameters string, datastream_id long, feature_of_interest_id long"
    ),
    "network": "id long, name string",
    "commit_log": (
        "id long, author string, encoding_type string, message string, date timestamp, "
        "action_type string"
    ),
}

# Observation chunks cover this many days.
CHUNK_DAYS = 30

# Result tags.
RESULT_NUMBER, RESULT_BOOLEAN, RESULT_JSON, RESULT_STRING = 0, 1, 2, 3


@dataclass(frozen=True)
class Relation:
    """Edge of the relation graph: source.near = target.far, or through a link table."""

    target: str
    many: bool
    near: str
    far: str
    link: str | None = None
    link_near: str | None = None
    link_far: str | None = None


@dataclass(frozen=True)
class Entity:
    table: str
    collection: str
    singular: str
    # (property name, column) pairs of the default select, in output order.
    properties: tuple[str, ...]
    relations: dict[str, Relation] = field(default_factory=dict)
    # Required on create, additionally required on replace, null when a replace omits them.
    create: tuple[str, ...] = ()
    replace: tuple[str, ...] = ()
    optional: tuple[str, ...] = ()
    not_null: tuple[str, ...] = ()


def _one(target: str, near: str) -> Relation:
    return Relation(target, False, near, "id")


def _many(target: str, far: str) -> Relation:
    return Relation(target, True, "id", far)


def _linked(target: str, link: str, near: str, far: str) -> Relation:
    return Relation(target, True, "id", "id", link, near, far)


_ENTITIES = (
    Entity(
        "thing", "Things", "Thing", ("name", "description", "properties"),
        {
            "Locations": _linked("location", "thing_location", "thing_id", "location_id"),
            "HistoricalLocations": _many("historical_location", "thing_id"),
            "Datastreams": _many("datastream", "thing_id"),
        },
        create=("name",), replace=("name", "description"), optional=("properties",),
        not_null=("name", "description"),
    ),
    Entity(
        "location", "Locations", "Location",
        ("name", "description", "encodingType", "location", "properties"),
        {
            "Things": _linked("thing", "thing_location", "location_id", "thing_id"),
            "HistoricalLocations": _linked(
                "historical_location", "location_historical_location",
                "location_id", "historical_location_id",
            ),
        },
        create=("name", "encodingType", "location"),
        replace=("name", "description", "encodingType", "location"), optional=("properties",),
        not_null=("name", "description", "encodingType", "location"),
    ),
    Entity(
        "historical_location", "HistoricalLocations", "HistoricalLocation", ("time",),
        {
            "Locations": _linked(
                "location", "location_historical_location",
                "historical_location_id", "location_id",
            ),
            "Thing": _one("thing", "thing_id"),
        },
        create=("Thing",), replace=("time",), not_null=("time", "Thing"),
    ),
    Entity(
        "observed_property", "ObservedProperties", "ObservedProperty",
        ("name", "description", "definition", "properties"),
        {"Datastreams": _many("datastream", "observed_property_id")},
        create=("name", "definition", "description"),
        replace=("name", "definition", "description"), optional=("properties",),
        not_null=("name", "definition", "description"),
    ),
    Entity(
        "sensor", "Sensors", "Sensor",
        ("name", "description", "encodingType", "metadata", "properties"),
        {"Datastreams": _many("datastream", "sensor_id")},
        create=("name", "encodingType", "metadata"),
        replace=("name", "description", "encodingType", "metadata"), optional=("properties",),
        not_null=("name", "description", "encodingType", "metadata"),
    ),
    Entity(
        "datastream", "Datastreams", "Datastream",
        (
            "name", "description", "unitOfMeasurement", "observationType", "observedArea",
            "phenomenonTime", "resultTime", "properties",
        ),
        {
            "Thing": _one("thing", "thing_id"),
            "Sensor": _one("sensor", "sensor_id"),
            "ObservedProperty": _one("observed_property", "observed_property_id"),
            "Observations": _many("observation", "datastream_id"),
            "Network": _one("network", "network_id"),
        },
        create=("Thing", "Sensor", "ObservedProperty"),
        replace=("name", "description", "unitOfMeasurement", "observationType"),
        optional=("observedArea", "phenomenonTime", "resultTime", "properties"),
        not_null=(
            "name", "description", "unitOfMeasurement", "observationType",
            "Thing", "Sensor", "ObservedProperty",
        ),
    ),
    Entity(
        "feature_of_interest", "FeaturesOfInterest", "FeatureOfInterest",
        ("name", "description", "encodingType", "feature", "properties"),
        {"Observations": _many("observation", "feature_of_interest_id")},
        create=("name", "encodingType", "feature"),
        replace=("name", "description", "encodingType", "feature"), optional=("properties",),
        not_null=("name", "description", "encodingType", "feature"),
    ),
    Entity(
        "observation", "Observations", "Observation",
        ("phenomenonTime", "resultTime", "result", "resultQuality", "validTime", "parameters"),
        {
            "FeatureOfInterest": _one("feature_of_interest", "feature_of_interest_id"),
            "Datastream": _one("datastream", "datastream_id"),
        },
        create=("Datastream",), replace=("phenomenonTime", "resultTime", "result"),
        optional=("resultQuality", "validTime", "parameters"),
        not_null=("result", "Datastream"),
    ),
    Entity(
        "network", "Networks", "Network", ("name",),
        {"Datastreams": _many("datastream", "network_id")},
        create=("name",), replace=("name",), not_null=("name",),
    ),
    Entity(
        "commit_log", "Commits", "Commit",
        ("author", "encodingType", "message", "date", "actionType"),
        create=("author", "message", "actionType"), not_null=("author", "message", "actionType"),
    ),
)

ENTITIES = {e.table: e for e in _ENTITIES}
VERSIONED = tuple(t for t in ENTITIES if t != "commit_log")
COMMIT = Relation("commit_log", False, "commit_id", "id")

_BY_NAME = {n: e for e in _ENTITIES for n in (e.table, e.collection, e.singular)}

# Properties whose column name does not follow from the camelCase rule.
_COLUMN_NAMES = {"metadata": "sensor_metadata", "@iot.id": "id"}

# Properties stored as a pair of bound columns: (lower, upper, comparison rule).
INTERVALS = {
    ("observation", "phenomenonTime"): ("phenomenon_start", "phenomenon_end", "closed"),
    ("observation", "validTime"): ("valid_start", "valid_end", "range"),
    ("datastream", "phenomenonTime"): ("phenomenon_start", "phenomenon_end", "closed"),
    ("datastream", "resultTime"): ("result_start", "result_end", "range"),
}

GEOMETRY_PROPERTIES = {"location", "feature", "observedArea"}
TIME_PROPERTIES = {"time", "date", "resultTime"}
JSON_PROPERTIES = {"properties", "parameters", "resultQuality"}


def entity(name: str) -> Entity:
    """Entity by table, collection or singular name."""
    try:
        return _BY_NAME[name]
    except KeyError:
        raise ValueError(f"unknown entity: {name}") from None


def relation(table: str, navigation: str) -> Relation:
    if navigation == "Commit" and table in VERSIONED:
        return COMMIT
    relations = ENTITIES[table].relations
    if navigation not in relations:
        raise ValueError(f"{ENTITIES[table].singular} has no relation {navigation}")
    return relations[navigation]


def column_name(prop: str) -> str:
    return _COLUMN_NAMES.get(prop) or re.sub(r"([A-Z])", lambda m: "_" + m.group(1).lower(), prop)


def is_property(table: str, prop: str) -> bool:
    known = ("id", "@iot.id", "selfLink", "systemTimeValidity")
    return prop in known or prop in ENTITIES[table].properties


def check_property(table: str, prop: str) -> str:
    if not is_property(table, prop):
        raise ValueError(f"{ENTITIES[table].singular} has no property {prop}")
    return prop


def default_select(table: str, *, versioned: bool = False, data_array: bool = False) -> list[str]:
    """Names of the default output: id, links, own properties; wider for version reads."""
    e = ENTITIES[table]
    if data_array:
        return ["id", *e.properties]
    names = ["id", "selfLink", *e.relations, *e.properties]
    if versioned and table in VERSIONED:
        names += ["Commit", "systemTimeValidity"]
    return names


def struct(table: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[table])


def columns(table: str) -> list[str]:
    return struct(table).names
