"""Planar geometry on Columns.

A geometry column is a struct (type, coords, bounding box); coords is a list of parts, each a list
of [x, y] positions: points for Point and MultiPoint, one line for LineString, rings for Polygon.
The literal side is a small Python value that is unrolled into the expression, so every predicate
stays inside generated code and tests the bounding box first.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from sensorquery.functions import shapes

INTERIOR, BOUNDARY, EXTERIOR = "I", "B", "E"


@dataclass(frozen=True)
class Literal:
    """Geometry literal: type and parts of (x, y) positions."""

    type: str
    parts: tuple[tuple[tuple[float, float], ...], ...]

    @property
    def bounds(self) -> tuple[float, float, float, float]:
        xs = [p[0] for part in self.parts for p in part]
        ys = [p[1] for part in self.parts for p in part]
        return min(xs), min(ys), max(xs), max(ys)

    @property
    def segments(self):
        return [s for part in self.parts for s in zip(part, part[1:])]

    @property
    def dimension(self) -> int:
        return {"Point": 0, "MultiPoint": 0, "LineString": 1, "Polygon": 2}[self.type]


_NAMES = {
    "POINT": "Point", "MULTIPOINT": "MultiPoint", "LINESTRING": "LineString", "POLYGON": "Polygon"
}


def literal(value) -> Literal:
    """Literal from WKT text, GeoJSON text or a GeoJSON dict."""
    if isinstance(value, Literal):
        return value
    if isinstance(value, str) and value.lstrip().startswith("{"):
        value = json.loads(value)
    if isinstance(value, dict):
        kind, c = value["type"], value["coordinates"]
        depth = {"Point": [[c]], "MultiPoint": [[p] for p in c], "LineString": [c], "Polygon": c}
        parts = depth[kind]
    else:
        head = re.match(r"\s*([A-Za-z]+)", value).group(1).upper()
        if head not in _NAMES:
            raise ValueError(f"unsupported geometry: {head}")
        kind = _NAMES[head]
        body = value[value.index("(") + 1 : value.rindex(")")]
        rings = re.findall(r"\(([^()]*)\)", body) or [body]
        positions = [[p.split() for p in ring.split(",")] for ring in rings]
        if kind == "MultiPoint":
            positions = [[p] for ring in positions for p in ring]
        parts = positions
    if any(len(p) != 2 for part in parts for p in part):
        raise ValueError("positions of a geometry literal have two coordinates")
    return Literal(
        kind, tuple(tuple((float(p[0]), float(p[1])) for p in part) for part in parts)
    )


def point(x: Column, y: Column) -> Column:
    """Point geometry struct."""
    x, y = x.cast("double"), y.cast("double")
    return F.struct(
        F.lit("Point").alias("type"), F.array(F.array(F.array(x, y))).alias("coords"),
        x.alias("xmin"), y.alias("ymin"), x.alias("xmax"), y.alias("ymax"),
    )


def geometry(kind: Column, coords: Column) -> Column:
    """Geometry struct of a type name and parts, with its bounding box."""
    flat = F.flatten(coords)
    xs = F.transform(flat, lambda p: F.get(p, F.lit(0)))
    ys = F.transform(flat, lambda p: F.get(p, F.lit(1)))
    return F.struct(
        kind.alias("type"), coords.alias("coords"),
        F.array_min(xs).alias("xmin"), F.array_min(ys).alias("ymin"),
        F.array_max(xs).alias("xmax"), F.array_max(ys).alias("ymax"),
    )


def from_geojson(text: Column) -> Column:
    """Geometry struct of GeoJSON text; a Feature gives its geometry, bad text gives null."""
    body = F.when(
        F.get_json_object(text, "$.type") == "Feature", F.get_json_object(text, "$.geometry")
    ).otherwise(text)
    kind = F.get_json_object(body, "$.type")
    raw = F.get_json_object(body, "$.coordinates")
    one = F.from_json(raw, "array<double>")
    two = F.from_json(raw, "array<array<double>>")
    three = F.from_json(raw, "array<array<array<double>>>")
    coords = (
        F.when(kind == "Point", F.array(F.array(one)))
        .when(kind == "MultiPoint", F.transform(two, lambda p: F.array(p)))
        .when(kind == "LineString", F.array(two))
        .when(kind == "Polygon", three)
    )
    first = F.get(F.get(F.get(coords, F.lit(0)), F.lit(0)), F.lit(1))
    return F.when(first.isNotNull(), geometry(kind, coords))


def crs_matches(text: Column, epsg: int) -> Column:
    """True if the GeoJSON names no reference system, or names the given EPSG code."""
    name = F.get_json_object(text, "$.crs.properties.name")
    code = F.regexp_extract(name, r"(\d+)\s*$", 1)
    return name.isNull() | (code == str(epsg))


# -- positions -------------------------------------------------------------------------------
#
# Lambdas over positions and segments are SQL text with the literal written into it: a position p is
# [x, y], a segment s has ax, ay, bx, by. Arithmetic is exact as written, without a tolerance.


def _lambda(function: str, values: Column, body: str) -> Column:
    return F.call_function(function, values, F.expr(body))


def _positions(g: Column) -> Column:
    return F.flatten(g["coords"])


def _segments(g: Column) -> Column:
    """Segments of a geometry: neighbouring positions of each part."""
    pair = "struct(part[i][0] AS ax, part[i][1] AS ay, b[0] AS bx, b[1] AS by)"
    pairs = f"part -> transform(slice(part, 2, greatest(size(part) - 1, 0)), (b, i) -> {pair})"
    return F.flatten(_lambda("transform", g["coords"], pairs))


def _segment_text(lit_: Literal) -> str:
    each = [
        f"struct({ax!r}D AS ax, {ay!r}D AS ay, {bx!r}D AS bx, {by!r}D AS by)"
        for (ax, ay), (bx, by) in lit_.segments
    ]
    return f"array({', '.join(each)})"


def _cross(s: str, x: str, y: str) -> str:
    return f"(({s}.bx - {s}.ax) * ({y} - {s}.ay) - ({s}.by - {s}.ay) * ({x} - {s}.ax))"


def _in_box(s: str, x: str, y: str) -> str:
    return (
        f"({x} BETWEEN least({s}.ax, {s}.bx) AND greatest({s}.ax, {s}.bx) "
        f"AND {y} BETWEEN least({s}.ay, {s}.by) AND greatest({s}.ay, {s}.by))"
    )


def _on_segment(s: str, x: str, y: str) -> str:
    return f"({_in_box(s, x, y)} AND {_cross(s, x, y)} = 0)"


def _ray_hits(s: str, x: str, y: str) -> str:
    at = f"({s}.bx - {s}.ax) * ({y} - {s}.ay) / nullif({s}.by - {s}.ay, 0D) + {s}.ax"
    return f"((({s}.ay > {y}) <> ({s}.by > {y})) AND {x} < {at})"


def _is_one_of(points, x: str, y: str) -> str:
    tests = [f"({x} = {px!r}D AND {y} = {py!r}D)" for px, py in points]
    return f"({' OR '.join(tests)})" if tests else "FALSE"


def _any(tests) -> Column:
    found = F.lit(False)
    for test in tests:
        found = found | test
    return found


def _line_ends(lit_: Literal) -> tuple:
    """Boundary points of a line literal: its two ends, none if it is closed."""
    first, last = lit_.parts[0][0], lit_.parts[0][-1]
    return () if first == last else (first, last)


def _locate(lit_: Literal, x: str, y: str) -> str:
    """Where a position lies in a literal: I, B or E."""
    if lit_.dimension == 0:
        points = [part[0] for part in lit_.parts]
        return f"CASE WHEN {_is_one_of(points, x, y)} THEN 'I' ELSE 'E' END"
    xmin, ymin, xmax, ymax = lit_.bounds
    boxed = f"({x} BETWEEN {xmin!r}D AND {xmax!r}D AND {y} BETWEEN {ymin!r}D AND {ymax!r}D)"
    segments = _segment_text(lit_)
    on_edge = f"exists({segments}, s -> {_on_segment('s', x, y)})"
    if lit_.dimension == 1:
        on_end = _is_one_of(_line_ends(lit_), x, y)
        return f"CASE WHEN NOT {boxed} THEN 'E' WHEN {on_end} THEN 'B' WHEN {on_edge} THEN 'I' ELSE 'E' END"
    odd = f"size(filter({segments}, s -> {_ray_hits('s', x, y)})) % 2 = 1"
    return f"CASE WHEN NOT {boxed} THEN 'E' WHEN {on_edge} THEN 'B' WHEN {odd} THEN 'I' ELSE 'E' END"


def locations(g: Column, other) -> Column:
    """Distinct locations (I, B, E) of the positions of a geometry in a literal."""
    where = _locate(literal(other), "p[0]", "p[1]")
    return F.array_distinct(_lambda("transform", _positions(g), f"p -> {where}"))


def _edges_meet(g: Column, lit_: Literal) -> Column:
    """Some segment of a geometry shares a position with some segment of a literal."""
    d1, d2 = _cross("t", "s.ax", "s.ay"), _cross("t", "s.bx", "s.by")
    d3, d4 = _cross("s", "t.ax", "t.ay"), _cross("s", "t.bx", "t.by")
    tests = [f"(signum({d1}) * signum({d2}) < 0 AND signum({d3}) * signum({d4}) < 0)"]
    tests += [_on_segment("t", "s.ax", "s.ay"), _on_segment("t", "s.bx", "s.by")]
    tests += [_on_segment("s", "t.ax", "t.ay"), _on_segment("s", "t.bx", "t.by")]
    inner = f"exists({_segment_text(lit_)}, t -> {' OR '.join(tests)})"
    return _lambda("exists", _segments(g), f"s -> {inner}")


def _covers_position(g: Column, p: tuple[float, float]) -> Column:
    """A line or polygon column covers a literal position (boundary included)."""
    x, y = (f"{c!r}D" for c in p)
    on_edge = _lambda("exists", _segments(g), f"s -> {_on_segment('s', x, y)}")
    hits = _lambda("filter", _segments(g), f"s -> {_ray_hits('s', x, y)}")
    return on_edge | ((g["type"] == "Polygon") & (F.size(hits) % 2 == 1))


def _boxes_meet(g: Column, lit_: Literal) -> Column:
    xmin, ymin, xmax, ymax = lit_.bounds
    return (g["xmin"] <= xmax) & (g["xmax"] >= xmin) & (g["ymin"] <= ymax) & (g["ymax"] >= ymin)


def _pointlike(g: Column) -> Column:
    return g["type"].isin("Point", "MultiPoint")


# ``points=True`` promises a column of Point and MultiPoint values. It keeps the plan small by leaving
# out the line and polygon branches; other shapes then give null.


def intersects(g: Column, other, *, points: bool = False) -> Column:
    lit_ = literal(other)
    where = _locate(lit_, "p[0]", "p[1]")
    touched = _lambda("exists", _positions(g), f"p -> {where} <> 'E'")
    if points:
        return F.when(_pointlike(g), _boxes_meet(g, lit_) & touched)
    covered = _any(_covers_position(g, part[0]) for part in lit_.parts)
    if lit_.segments:
        covered = covered | _edges_meet(g, lit_)
    return F.when(g.isNotNull(), _boxes_meet(g, lit_) & (touched | (~_pointlike(g) & covered)))


def disjoint(g: Column, other, *, points: bool = False) -> Column:
    return ~intersects(g, other, points=points)


def _to_segment(s: str, x: str, y: str) -> str:
    """Distance of a position from a segment."""
    dx, dy = f"({s}.bx - {s}.ax)", f"({s}.by - {s}.ay)"
    squared = f"({dx} * {dx} + {dy} * {dy})"
    along = f"coalesce((({x} - {s}.ax) * {dx} + ({y} - {s}.ay) * {dy}) / nullif({squared}, 0D), 0D)"
    t = f"greatest(0D, least(1D, {along}))"
    return f"hypot({x} - ({s}.ax + {t} * {dx}), {y} - ({s}.ay + {t} * {dy}))"


def distance(g: Column, other, *, points: bool = False) -> Column:
    """Planar distance in coordinate units; 0 where the geometries meet."""
    lit_ = literal(other)
    vertices = sorted({p for part in lit_.parts for p in part})
    if lit_.segments:
        nearest = f"array_min(transform({_segment_text(lit_)}, s -> {_to_segment('s', 'p[0]', 'p[1]')}))"
    else:
        each = [f"hypot(p[0] - {x!r}D, p[1] - {y!r}D)" for x, y in vertices]
        nearest = f"array_min(array({', '.join(each)}))"
    near = F.array_min(_lambda("transform", _positions(g), f"p -> {nearest}"))
    if points:
        inside = intersects(g, lit_, points=True)
        return F.when(_pointlike(g), F.when(inside, 0.0).otherwise(near))
    each = [_to_segment("s", f"{x!r}D", f"{y!r}D") for x, y in vertices]
    edge = F.array_min(
        _lambda("transform", _segments(g), f"s -> array_min(array({', '.join(each)}))")
    )
    apart = F.when(_pointlike(g), near).otherwise(F.least(near, edge))
    return F.when(g.isNull(), None).when(intersects(g, lit_), 0.0).otherwise(apart)


def length(g: Column | str) -> Column:
    """Length of a line; 0 for points and areas. Accepts a column or a literal."""
    if not isinstance(g, Column):
        lit_ = literal(g)
        if lit_.dimension != 1:
            return F.lit(0.0)
        total = sum(((bx - ax) ** 2 + (by - ay) ** 2) ** 0.5 for (ax, ay), (bx, by) in lit_.segments)
        return F.lit(float(total))
    steps = _lambda("transform", _segments(g), "s -> hypot(s.bx - s.ax, s.by - s.ay)")
    measured = F.call_function("aggregate", steps, F.lit(0.0), F.expr("(total, step) -> total + step"))
    return F.when(g["type"] == "LineString", measured).when(g.isNotNull(), 0.0)


# -- relation matrix -------------------------------------------------------------------------


def _points_left_over(g: Column, targets) -> Column:
    """At least one literal position is not among the positions of a point geometry."""
    return _any(
        ~_lambda("exists", _positions(g), f"p -> {_is_one_of([t], 'p[0]', 'p[1]')}") for t in targets
    )


def _point_matrix(g: Column, lit_: Literal) -> Column:
    """DE-9IM text of a Point or MultiPoint column against a literal, row by row."""
    where = locations(g, lit_)

    def zero(place: str) -> Column:
        return F.when(F.array_contains(where, place), "0").otherwise("F")

    if lit_.dimension == 0:
        left = F.when(_points_left_over(g, [p[0] for p in lit_.parts]), "0").otherwise("F")
        edge = F.lit("F")
    elif lit_.dimension == 1:
        left = F.lit("1")
        ends = _line_ends(lit_)
        edge = F.when(_points_left_over(g, ends), "0").otherwise("F") if ends else F.lit("F")
    else:
        left, edge = F.lit("2"), F.lit("1")
    rows = (zero(INTERIOR), zero(BOUNDARY), zero(EXTERIOR), F.lit("FFF"), left, edge, F.lit("2"))
    return F.concat(*rows)


def _coords(lit_: Literal) -> str:
    """Literal positions as SQL text; folded into a constant array."""
    parts = [", ".join(f"array({x!r}D, {y!r}D)" for x, y in part) for part in lit_.parts]
    return f"array({', '.join(f'array({p})' for p in parts)})"


def _shape_matrix(g: Column, lit_: Literal) -> Column:
    """DE-9IM text of a line or polygon column against a literal."""
    return shapes.matrix(g["type"], g["coords"], lit_.type, _coords(lit_))


def relate(g: Column, other, pattern: str | None = None, *, points: bool = False) -> Column:
    """DE-9IM matrix text, or a test of it against a pattern of ``T F * 0 1 2``."""
    lit_ = literal(other)
    matrix = F.when(_pointlike(g), _point_matrix(g, lit_))
    if not points:
        matrix = matrix.when(g.isNotNull(), _shape_matrix(g, lit_))
    return matrix if pattern is None else matches(matrix, pattern)


def _rule(pattern: str) -> str:
    return "^" + "".join({"T": "[012]", "*": "."}.get(c, c) for c in pattern.upper()) + "$"


def matches(matrix: Column, *patterns: str) -> Column:
    """The matrix fits one of the patterns."""
    return matrix.rlike("|".join(_rule(p) for p in patterns))


def relations(g: Column, other) -> Column:
    """All relations of a geometry to a literal as one struct: ``matrix`` (null where the boxes are
    apart), equals, disjoint, intersects, touches, within, contains, overlaps, crosses.

    The matrix is made once per row, and only where the bounding boxes meet; every test reads it.
    """
    lit_ = literal(other)
    meet = _boxes_meet(g, lit_)
    size = F.when(g["type"] == "Polygon", 2).when(g["type"].isin("LineString", "MultiLineString"), 1).otherwise(0)
    alike = _rule("1*T***T**" if lit_.dimension == 1 else "T*T***T**")
    across = (
        F.when(size < lit_.dimension, _rule("T*T******")).when(size > lit_.dimension, _rule("T*****T**"))
        .otherwise(_rule("0********") if lit_.dimension == 1 else "^$")
    )

    def tests(m: Column) -> Column:
        known = {
            "equals": matches(m, "T*F**FFF*"), "intersects": ~matches(m, "FF*FF****"),
            "touches": matches(m, "FT*******", "F**T*****", "F***T****"), "within": matches(m, "T*F**F***"),
            "contains": matches(m, "T*****FF*"), "overlaps": (size == lit_.dimension) & F.rlike(m, F.lit(alike)),
            "crosses": F.rlike(m, across),
        }
        fields = {name: F.coalesce(test, F.lit(False)) for name, test in known.items()}
        return F.struct(
            m.alias("matrix"), (~fields["intersects"]).alias("disjoint"), *[f.alias(n) for n, f in fields.items()])

    once = F.transform(F.array(F.when(meet, relate(g, lit_))), tests)
    return F.when(g.isNotNull(), F.get(once, F.lit(0)))


def _by_kind(g: Column, other, point_test, pattern_test, points: bool) -> Column:
    """Point columns use location tests only; other shapes go through the matrix."""
    lit_ = literal(other)
    test = F.when(_pointlike(g), point_test(lit_))
    if points:
        return test
    return test.when(g.isNotNull(), _boxes_meet(g, lit_) & pattern_test(_shape_matrix(g, lit_)))


def equals(g: Column, other, *, points: bool = False) -> Column:
    def at_points(lit_: Literal) -> Column:
        if lit_.dimension:
            return F.lit(False)
        targets = [p[0] for p in lit_.parts]
        outside = F.array_contains(locations(g, lit_), EXTERIOR)
        return ~outside & ~_points_left_over(g, targets)

    return _by_kind(g, other, at_points, lambda m: matches(m, "T*F**FFF*"), points)


def touches(g: Column, other, *, points: bool = False) -> Column:
    def at_points(lit_: Literal) -> Column:
        where = locations(g, lit_)
        return F.array_contains(where, BOUNDARY) & ~F.array_contains(where, INTERIOR)

    def by_matrix(m: Column) -> Column:
        return matches(m, "FT*******", "F**T*****", "F***T****")

    return _by_kind(g, other, at_points, by_matrix, points)


def within(g: Column, other, *, points: bool = False) -> Column:
    def at_points(lit_: Literal) -> Column:
        where = locations(g, lit_)
        return F.array_contains(where, INTERIOR) & ~F.array_contains(where, EXTERIOR)

    return _by_kind(g, other, at_points, lambda m: matches(m, "T*F**F***"), points)


def contains(g: Column, other, *, points: bool = False) -> Column:
    def at_points(lit_: Literal) -> Column:
        if lit_.dimension:
            return F.lit(False)
        return ~_points_left_over(g, [p[0] for p in lit_.parts])

    return _by_kind(g, other, at_points, lambda m: matches(m, "T*****FF*"), points)


def overlaps(g: Column, other, *, points: bool = False) -> Column:
    lit_ = literal(other)
    size = F.when(g["type"] == "Polygon", 2).when(g["type"] == "LineString", 1).otherwise(0)

    def at_points(target: Literal) -> Column:
        if target.dimension:
            return F.lit(False)
        where = locations(g, target)
        mixed = F.array_contains(where, INTERIOR) & F.array_contains(where, EXTERIOR)
        return mixed & _points_left_over(g, [p[0] for p in target.parts])

    def by_matrix(m: Column) -> Column:
        rule = "1*T***T**" if lit_.dimension == 1 else "T*T***T**"
        return (size == lit_.dimension) & matches(m, rule)

    return _by_kind(g, other, at_points, by_matrix, points)


def crosses(g: Column, other, *, points: bool = False) -> Column:
    lit_ = literal(other)
    size = F.when(g["type"] == "Polygon", 2).when(g["type"] == "LineString", 1).otherwise(0)

    def at_points(target: Literal) -> Column:
        if target.dimension == 0:
            return F.lit(False)
        where = locations(g, target)
        return F.array_contains(where, INTERIOR) & F.array_contains(where, EXTERIOR)

    def by_matrix(m: Column) -> Column:
        same = _rule("0********") if lit_.dimension == 1 else "^$"
        rule = (
            F.when(size < lit_.dimension, _rule("T*T******"))
            .when(size > lit_.dimension, _rule("T*****T**")).otherwise(same)
        )
        return F.rlike(m, rule)

    return _by_kind(g, other, at_points, by_matrix, points)
