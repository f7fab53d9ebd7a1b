"""Output forms: time text, links, GeoJSON and entity documents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sensorquery import schema
from sensorquery.functions.values import Interval, Result, result_json

TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def time_text(t: Column) -> Column:
    return F.date_format(t, TIME_FORMAT)


def interval_text(x: Interval) -> Column:
    """``start`` or ``start/end`` for closed intervals, ``start/end`` for ranges, and
    ``start/infinity`` for an open validity."""
    lower, upper = time_text(x.lower), time_text(x.upper)
    both = F.concat(lower, F.lit("/"), upper)
    if x.rule == "range":
        return both
    instant = F.when(x.lower == x.upper, lower)
    if x.rule == "validity":
        instant = instant.when(x.upper.isNull(), F.concat(lower, F.lit("/infinity")))
    return instant.otherwise(both)


def self_link(table: str, id_column: Column, base: str = "") -> Column:
    collection = schema.ENTITIES[table].collection
    return F.concat(F.lit(f"{base}/{collection}("), id_column.cast("string"), F.lit(")"))


def nav_link(
    table: str, navigation: str, id_column: Column, base: str = "", as_of: str | None = None
) -> Column:
    """Link to a relation; carries the read instant, except towards the commit log."""
    schema.relation(table, navigation)
    stamp = f"?$as_of={as_of}" if as_of and navigation != "Commit" else ""
    return F.concat(self_link(table, id_column, base), F.lit(f"/{navigation}{stamp}"))


def geojson(g: Column) -> Column:
    """GeoJSON text of a geometry struct."""
    kind, coords = g["type"], g["coords"]
    body = (
        F.when(kind == "Point", F.to_json(F.get(F.get(coords, F.lit(0)), F.lit(0))))
        .when(kind == "MultiPoint", F.to_json(F.transform(coords, lambda part: F.get(part, F.lit(0)))))
        .when(kind == "LineString", F.to_json(F.get(coords, F.lit(0))))
        .otherwise(F.to_json(coords))
    )
    return F.when(
        g.isNotNull(),
        F.concat(F.lit('{"type":"'), kind, F.lit('","coordinates":'), body, F.lit("}")),
    )


def property_value(table: str, prop: str, resolve):
    """Value of a property by its API name: Column, Interval or Result. ``resolve`` maps a column
    name to a Column."""
    if prop == "systemTimeValidity":
        return Interval(resolve("valid_from"), resolve("valid_to"), "validity")
    if prop == "result" and table == "observation":
        return Result.of(resolve)
    if (table, prop) in schema.INTERVALS:
        lower, upper, rule = schema.INTERVALS[(table, prop)]
        return Interval(resolve(lower), resolve(upper), rule)
    return resolve(schema.column_name(prop))


def output_column(
    table: str, prop: str, resolve, *, base: str = "", as_of: str | None = None
) -> Column:
    """One output column of a property, JSON sub-path (``properties/a/b``) or relation link."""
    if "/" in prop:
        root, *path = prop.split("/")
        schema.check_property(table, root)
        where = "$" + "".join(f"['{p}']" for p in path)
        return F.get_json_object(resolve(schema.column_name(root)), where).alias(prop)
    if prop == "selfLink":
        stamp = F.lit(f"?$as_of={as_of}" if as_of else "")
        link = F.concat(self_link(table, resolve("id"), base), stamp)
        return link.alias("@iot.selfLink")
    if prop == "Commit" or prop in schema.ENTITIES[table].relations:
        link = nav_link(table, prop, resolve("id"), base, as_of)
        return link.alias(f"{prop}@iot.navigationLink")
    schema.check_property(table, prop)
    value = property_value(table, prop, resolve)
    if isinstance(value, Interval):
        value = interval_text(value)
    elif isinstance(value, Result):
        value = result_json(value)
    elif prop in schema.GEOMETRY_PROPERTIES:
        value = geojson(value)
    elif prop in schema.TIME_PROPERTIES:
        value = time_text(value)
    return value.alias("id" if prop == "@iot.id" else prop)


def parsed_member(name: str) -> bool:
    """Output columns that hold JSON text and are embedded as JSON in a document."""
    return name in schema.JSON_PROPERTIES | schema.GEOMETRY_PROPERTIES | {"result"}


def document(columns: dict[str, Column], json_members: set[str] = frozenset()) -> Column:
    """JSON object text of named columns; members listed as JSON are embedded unquoted."""
    parts = [
        (F.try_parse_json(c) if n in json_members or parsed_member(n) else c).alias(n)
        for n, c in columns.items()
    ]
    return F.to_json(F.struct(*parts), {"ignoreNullFields": "false"})
