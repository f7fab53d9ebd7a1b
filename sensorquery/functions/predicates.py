"""Comparisons with the interval and mixed-type result rules of the data model.

Operands are Columns, ``Interval`` or ``Result`` values, or Python literals on either side.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sensorquery.functions.scalars import instant, json_path, json_value
from sensorquery.functions.values import Interval, Result, num_text

_MIRROR = {"eq": "eq", "ne": "ne", "gt": "lt", "ge": "le", "lt": "gt", "le": "ge"}


def _apply(op: str, a, b) -> Column:
    if op == "eq":
        return a == b
    if op == "ne":
        return a != b
    if op == "gt":
        return a > b
    if op == "ge":
        return a >= b
    if op == "lt":
        return a < b
    if op == "le":
        return a <= b
    raise ValueError(f"unknown comparison: {op}")


def _moment(value) -> Column:
    return value if isinstance(value, Column) else instant(value)


def _pair(value) -> bool:
    return isinstance(value, (tuple, list)) and len(value) == 2


def closed_compare(op: str, x: Interval, t) -> Column:
    """Closed interval against an instant: eq is containment, order needs the whole interval."""
    t = _moment(t)
    inside = (x.lower <= t) & (x.upper >= t)
    if op == "eq":
        return inside
    if op == "ne":
        return ~inside
    return _apply(op, x.lower if op in ("gt", "ge") else x.upper, t)


def range_compare(op: str, x: Interval, t) -> Column:
    """Range order against [t, t]: lower bounds first, then upper bounds."""
    t = _moment(t)
    ranged = F.when(x.lower.isNotNull(), F.struct(x.lower.alias("lo"), x.upper.alias("hi")))
    return _apply(op, ranged, F.struct(t.alias("lo"), t.alias("hi")))


def valid_at(x: Interval, t) -> Column:
    t = _moment(t)
    return (x.lower <= t) & (x.upper.isNull() | (t < x.upper))


def valid_overlaps(x: Interval, t1, t2) -> Column:
    """Half-open overlap; an empty interval on either side overlaps nothing."""
    t1, t2 = _moment(t1), _moment(t2)
    open_or_after = x.upper.isNull() | ((t1 < x.upper) & (x.lower < x.upper))
    return (x.lower < t2) & open_or_after & (t1 < t2)


def _validity_compare(op: str, x: Interval, value) -> Column:
    if op not in ("eq", "ne"):
        raise ValueError("validity supports eq and ne; compare its lower or upper bound instead")
    test = valid_overlaps(x, *value) if _pair(value) else valid_at(x, value)
    return test if op == "eq" else ~test


def _result_compare(op: str, r: Result, value) -> Column:
    if isinstance(value, Column):
        return _apply(op, r.number, value)
    if isinstance(value, bool):
        return _apply(op, r.boolean, F.lit(value))
    if isinstance(value, (int, float)):
        return _apply(op, r.number, F.lit(value))
    text = F.lit(value)
    return _apply(op, r.string, text) | _apply(op, num_text(r.number), text)


def compare(op: str, a, b) -> Column:
    """One entry for all comparisons; a literal on the left mirrors the operator."""
    if isinstance(b, (Interval, Result)) and not isinstance(a, (Interval, Result)):
        return compare(_MIRROR[op], b, a)
    if b is None or a is None:
        known = b if a is None else a
        if isinstance(known, Interval):
            known = known.lower
        elif isinstance(known, Result):
            known = known.type
        if op not in ("eq", "ne"):
            return F.lit(None).cast("boolean")
        return known.isNull() if op == "eq" else known.isNotNull()
    if isinstance(a, Interval):
        rule = {"closed": closed_compare, "range": range_compare, "validity": _validity_compare}
        return rule[a.rule](op, a, b)
    if isinstance(a, Result):
        return _result_compare(op, a, b)
    if not isinstance(a, Column):
        return _apply(_MIRROR[op], b, F.lit(a))
    return _apply(op, a, b if isinstance(b, Column) else F.lit(b))


def eq(a, b) -> Column:
    return compare("eq", a, b)


def ne(a, b) -> Column:
    return compare("ne", a, b)


def gt(a, b) -> Column:
    return compare("gt", a, b)


def ge(a, b) -> Column:
    return compare("ge", a, b)


def lt(a, b) -> Column:
    return compare("lt", a, b)


def le(a, b) -> Column:
    return compare("le", a, b)


def is_null(x) -> Column:
    return compare("eq", x, None)


def is_not_null(x) -> Column:
    return compare("ne", x, None)


def in_(x, values) -> Column:
    if not isinstance(x, Result):
        return x.isin(*values)
    tests = [compare("eq", x, v) for v in values]
    found = F.lit(False)
    for test in tests:
        found = found | F.coalesce(test, F.lit(False))
    return found


def number(x) -> Column:
    return x.number if isinstance(x, Result) else (x if isinstance(x, Column) else F.lit(x))


def add(a, b) -> Column:
    return number(a) + number(b)


def sub(a, b) -> Column:
    return number(a) - number(b)


def mul(a, b) -> Column:
    return number(a) * number(b)


def div(a, b) -> Column:
    return number(a) / number(b)


def mod(a, b) -> Column:
    return number(a) % number(b)


def neg(a) -> Column:
    return F.negative(number(a))


def json_eq(doc: Column, path: str, value) -> Column:
    """JSON sub-path against a literal, compared in the literal's type."""
    return json_compare("eq", doc, path, value)


def json_compare(op: str, doc: Column, path: str, value) -> Column:
    steps = tuple(path.split("/"))
    if value is None:
        return compare(op, json_path(doc, *steps), None)
    return _apply(op, json_value(doc, steps, value), F.lit(value))


def shift(x: Column, *, years=0, months=0, days=0, hours=0, minutes=0, seconds=0, sign=1) -> Column:
    """Instant moved by an ISO duration: calendar part first, then the clock part."""
    moved = x
    if years or months:
        moved = moved + F.make_ym_interval(F.lit(sign * years), F.lit(sign * months))
    clock = F.make_dt_interval(
        F.lit(sign * days), F.lit(sign * hours), F.lit(sign * minutes),
        F.lit(sign * seconds).cast("decimal(18,6)"),
    )
    return moved + clock


def geometry_type(g: Column) -> Column:
    return g["type"]
