"""Relation matrix of line and polygon columns, as array expressions.

Both sides are lists of segments. Every segment is cut where it meets the other side; the location
of each piece (by its midpoint) and of each vertex and meeting point gives the nine entries.
Positions closer than ``TOLERANCE`` coordinate units count as equal.

The expressions are written as SQL text, one lambda for the whole matrix, because they are deep:
building them call by call costs seconds per query. Each function below returns the text of one
expression over named lambda variables.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOLERANCE = "1e-9D"


def apply(value: Column, body: str) -> Column:
    """Evaluates ``value`` once and applies the lambda text ``body`` to it."""
    return F.get(F.call_function("transform", F.array(value), F.expr(body)), F.lit(0))


def _let(name: str, value: str, body: str) -> str:
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _positions(coords: str) -> str:
    return f"array_distinct(transform(flatten({coords}), p -> struct(p[0] AS x, p[1] AS y)))"


def _segments(coords: str) -> str:
    pair = "struct(part[i][0] AS ax, part[i][1] AS ay, b[0] AS bx, b[1] AS by)"
    tail = "slice(part, 2, greatest(size(part) - 1, 0))"
    return f"flatten(transform({coords}, part -> transform({tail}, (b, i) -> {pair})))"


def _ends(kind: str, coords: str) -> str:
    """Boundary positions of a line: both ends, none if it is closed."""
    first, last = f"{coords}[0][0]", f"element_at({coords}[0], -1)"
    both = f"transform(array({first}, {last}), p -> struct(p[0] AS x, p[1] AS y))"
    return f"filter({both}, p -> {kind} = 'LineString' AND {first} <> {last})"


def _side(kind: str, coords: str) -> str:
    """Everything the matrix needs to know about one geometry."""
    return (
        f"struct({kind} AS kind, {_segments(coords)} AS segs, {_positions(coords)} AS points, "
        f"{_ends(kind, coords)} AS ends)"
    )


def _near(p: str, q: str) -> str:
    return f"(abs({p}.x - {q}.x) <= {TOLERANCE} AND abs({p}.y - {q}.y) <= {TOLERANCE})"


def _on(p: str, s: str) -> str:
    """A position lies on a segment."""
    dx, dy = f"({s}.bx - {s}.ax)", f"({s}.by - {s}.ay)"
    boxed = " AND ".join(
        f"{p}.{c} BETWEEN least({s}.a{c}, {s}.b{c}) - {TOLERANCE} AND greatest({s}.a{c}, {s}.b{c}) + {TOLERANCE}"
        for c in "xy"
    )
    off = f"abs({dx} * ({p}.y - {s}.ay) - {dy} * ({p}.x - {s}.ax))"
    return f"({boxed} AND {off} <= {TOLERANCE} * hypot({dx}, {dy}))"


def _ray_hits(p: str, s: str) -> str:
    """The ray from a position to the right crosses a segment."""
    at = f"{s}.ax + ({p}.y - {s}.ay) * ({s}.bx - {s}.ax) / nullif({s}.by - {s}.ay, 0D)"
    return f"((({s}.ay > {p}.y) <> ({s}.by > {p}.y)) AND {p}.x < {at})"


def _locate(p: str, g: str) -> str:
    """I, B or E of a position in a geometry side."""
    on_edge = f"exists({g}.segs, s -> {_on(p, 's')})"
    odd = f"size(filter({g}.segs, s -> {_ray_hits(p, 's')})) % 2 = 1"
    on_point = f"exists({g}.points, q -> {_near(p, 'q')})"
    on_end = f"exists({g}.ends, q -> {_near(p, 'q')})"
    return (
        f"CASE {g}.kind WHEN 'Polygon' THEN CASE WHEN {on_edge} THEN 'B' WHEN {odd} THEN 'I' ELSE 'E' END "
        f"WHEN 'LineString' THEN CASE WHEN {on_end} THEN 'B' WHEN {on_edge} THEN 'I' ELSE 'E' END "
        f"ELSE CASE WHEN {on_point} THEN 'I' ELSE 'E' END END"
    )


def _meetings(s: str, g: str, pointlike: bool) -> str:
    """Parameters strictly inside a segment where it meets the other side."""
    dx, dy = f"({s}.bx - {s}.ax)", f"({s}.by - {s}.ay)"
    squared = f"({dx} * {dx} + {dy} * {dy})"

    def along(x: str, y: str) -> str:
        return f"((({x}) - {s}.ax) * {dx} + (({y}) - {s}.ay) * {dy}) / nullif({squared}, 0D)"

    if pointlike:
        found = f"transform({g}.points, q -> CASE WHEN {_on('q', s)} THEN {along('q.x', 'q.y')} END)"
    else:
        ex, ey = "(t.bx - t.ax)", "(t.by - t.ay)"
        wx, wy = f"(t.ax - {s}.ax)", f"(t.ay - {s}.ay)"
        turn = f"({dx} * {ey} - {dy} * {ex})"
        u = f"({wx} * {ey} - {wy} * {ex}) / nullif({turn}, 0D)"
        v = f"({wx} * {dy} - {wy} * {dx}) / nullif({turn}, 0D)"
        parallel = f"abs({turn}) <= {TOLERANCE} * sqrt({squared}) * hypot({ex}, {ey})"
        meets = f"CASE WHEN {v} BETWEEN -{TOLERANCE} AND 1 + {TOLERANCE} THEN {u} END"
        of_segment = (
            f"CASE WHEN {parallel} THEN array({along('t.ax', 't.ay')}, {along('t.bx', 't.by')}) "
            f"ELSE array({meets}) END"
        )
        near = f"filter({g}.segs, t -> {_boxes_touch(s, 't')})"
        found = f"flatten(transform({near}, t -> {of_segment}))"
    return f"filter({found}, u -> u > 0 AND u < 1)"


def _boxes_touch(s: str, t: str) -> str:
    return " AND ".join(
        f"least({s}.a{c}, {s}.b{c}) <= greatest({t}.a{c}, {t}.b{c}) + {TOLERANCE} "
        f"AND greatest({s}.a{c}, {s}.b{c}) >= least({t}.a{c}, {t}.b{c}) - {TOLERANCE}"
        for c in "xy"
    )


def _at(s: str, u: str) -> str:
    return f"struct({s}.ax + {u} * ({s}.bx - {s}.ax) AS x, {s}.ay + {u} * ({s}.by - {s}.ay) AS y)"


def _pieces(g: str, other: str, pointlike: bool = False) -> str:
    """Midpoints of the pieces of all segments, cut by the other side."""
    cuts = f"array_sort(array_distinct(concat(array(0D, 1D), {_meetings('e', other, pointlike)})))"
    spans = "transform(slice(cuts, 2, size(cuts) - 1), (hi, i) -> struct(cuts[i] AS lo, hi AS hi))"
    long_enough = f"filter({spans}, c -> c.hi - c.lo > {TOLERANCE})"
    middles = f"transform({long_enough}, c -> {_at('e', '((c.lo + c.hi) / 2)')})"
    return f"flatten(transform({g}.segs, e -> {_let('cuts', cuts, middles)}))"


def _nodes(a: str, b: str, pointlike: bool) -> str:
    """Vertices of both sides and the positions where the edges meet."""
    meetings = f"transform({_meetings('e', b, pointlike)}, u -> {_at('e', 'u')})"
    return f"concat({a}.points, {b}.points, flatten(transform({a}.segs, e -> {meetings})))"


def _entries(other_kind: str) -> str:
    """The nine entries from the locations found: ``f.pa``, ``f.pb``, ``f.nodes``, ``f.area``."""
    area_a, line_a = "f.area", "NOT f.area"
    area_b = str(other_kind == "Polygon").upper()
    line_b = str(other_kind == "LineString").upper()

    def in_a(place: str) -> str:
        return f"array_contains(f.pb, '{place}')"

    def in_b(place: str) -> str:
        return f"array_contains(f.pa, '{place}')"

    def entry(pair: str, one: str = "FALSE", two: str = "FALSE", node: bool = True) -> str:
        zero = f"array_contains(f.nodes, '{pair}')" if node else "FALSE"
        return f"CASE WHEN {two} THEN '2' WHEN {one} THEN '1' WHEN {zero} THEN '0' ELSE 'F' END"

    # A pure coincidence of both boundaries means equal areas.
    same = f"NOT ({in_b('I')} OR {in_b('E')} OR {in_a('I')} OR {in_a('E')})"
    shared = f"({area_a} AND {area_b} AND ({in_b('I')} OR {in_a('I')} OR {same}))"
    rest_a = f"({area_a} AND (NOT {area_b} OR {in_b('E')} OR {in_a('I')} OR NOT {shared}))"
    rest_b = f"({area_b} AND ({line_a} OR {in_a('E')} OR {in_b('I')} OR NOT {shared}))"
    cells = (
        entry("II", f"({line_a} AND {in_b('I')}) OR ({line_b} AND {in_a('I')})", shared),
        entry("IB", f"({line_a} AND {area_b} AND {in_b('B')}) OR ({area_b} AND {in_a('I')})"),
        entry("IE", f"{line_a} AND {in_b('E')}", rest_a),
        entry("BI", f"({area_a} AND {in_b('I')}) OR ({area_a} AND {line_b} AND {in_a('B')})"),
        entry("BB", f"{area_a} AND {area_b} AND {in_b('B')}"),
        entry("BE", f"{area_a} AND {in_b('E')}"),
        entry("EI", f"{line_b} AND {in_a('E')}", rest_b),
        entry("EB", f"{area_b} AND {in_a('E')}", node=other_kind not in ("Point", "MultiPoint")),
    )
    return f"concat({', '.join(cells)}, '2')"


def matrix(kind: Column, coords: Column, other_kind: str, other_coords: str) -> Column:
    """DE-9IM text of a line or polygon column against a literal of any type.

    ``other_coords`` is the SQL text of the literal's position array.
    """
    spots = other_kind in ("Point", "MultiPoint")
    found = (
        f"struct(array_distinct(transform({_pieces('a', 'b', spots)}, m -> {_locate('m', 'b')})) AS pa, "
        f"array_distinct(transform({_pieces('b', 'a')}, m -> {_locate('m', 'a')})) AS pb, "
        f"array_distinct(transform({_nodes('a', 'b', spots)}, m -> concat({_locate('m', 'a')}, {_locate('m', 'b')}))) AS nodes, "
        "a.kind = 'Polygon' AS area)"
    )
    body = _let("f", found, _entries(other_kind))
    with_b = _let("b", _side(f"'{other_kind}'", other_coords), body)
    with_a = _let("a", _side("g.kind", "g.coords"), with_b)
    return apply(F.struct(kind.alias("kind"), coords.alias("coords")), f"g -> {with_a}")
