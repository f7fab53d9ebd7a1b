"""Filter functions with the exact behaviour of the query language they come from."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sensorquery.functions.values import Interval, Result

MIN_DATETIME = "0001-01-01T00:00:00Z"
MAX_DATETIME = "9999-12-31T23:59:59.999999Z"


def _text(x) -> Column:
    """String argument: literal, column, or the string column of a result."""
    if isinstance(x, Result):
        return x.string
    return x if isinstance(x, Column) else F.lit(x)


def _number(x) -> Column:
    if isinstance(x, Result):
        return x.number
    return x if isinstance(x, Column) else F.lit(x)


def _instant(x) -> Column:
    if isinstance(x, Interval):
        return x.lower
    return x if isinstance(x, Column) else instant(x)


def instant(text) -> Column:
    """Timestamp literal of an ISO text with a zone, or of an aware datetime."""
    return F.lit(text).cast("timestamp")


def substringof(needle, haystack) -> Column:
    return F.contains(_text(haystack), _text(needle))


def startswith(s, prefix) -> Column:
    return F.startswith(_text(s), _text(prefix))


def endswith(s, suffix) -> Column:
    return F.endswith(_text(s), _text(suffix))


def length(s) -> Column:
    return F.char_length(_text(s))


def indexof(s, t) -> Column:
    """1-based position, 0 if absent."""
    return F.locate(t, _text(s)) if isinstance(t, str) else F.instr(_text(s), _text(t))


def substring(s, start: int, count: int | None = None) -> Column:
    """``start`` counts from 0; positions before the text are empty and use up ``count``."""
    s = _text(s)
    if count is None:
        return F.substr(s, F.lit(max(start, 0) + 1))
    if count < 0:
        raise ValueError("negative substring length")
    end = max(start + count, 0)
    begin = max(start, 0)
    return F.substr(s, F.lit(begin + 1), F.lit(max(end - begin, 0)))


def tolower(s) -> Column:
    return F.lower(_text(s))


def toupper(s) -> Column:
    return F.upper(_text(s))


def trim(s) -> Column:
    return F.trim(_text(s))


def concat(a, b) -> Column:
    return F.concat(F.coalesce(_text(a), F.lit("")), F.coalesce(_text(b), F.lit("")))


def year(x) -> Column:
    return F.year(_instant(x))


def month(x) -> Column:
    return F.month(_instant(x))


def day(x) -> Column:
    return F.day(_instant(x))


def hour(x) -> Column:
    return F.hour(_instant(x))


def minute(x) -> Column:
    return F.minute(_instant(x))


def second(x) -> Column:
    """Seconds with their fraction."""
    return F.extract(F.lit("SECOND"), _instant(x))


def fractionalseconds(x) -> Column:
    return F.extract(F.lit("SECOND"), _instant(x)) % 1


def totaloffsetminutes(x) -> Column:
    """Offset of the session zone at the instant, in minutes."""
    offset = F.date_format(_instant(x), "xxx")
    minutes = F.substring(offset, 2, 2).cast("int") * 60 + F.substring(offset, 5, 2).cast("int")
    return F.when(offset.startswith("-"), -minutes).otherwise(minutes)


def date(x) -> Column:
    return F.to_date(_instant(x))


def time(x) -> Column:
    return F.date_format(_instant(x), "HH:mm:ss.SSSSSS")


def now() -> Column:
    return F.current_timestamp()


def mindatetime() -> Column:
    return instant(MIN_DATETIME)


def maxdatetime() -> Column:
    return instant(MAX_DATETIME)


def lower(x: Interval) -> Column:
    return x.lower


def upper(x: Interval) -> Column:
    return x.upper


def round(x) -> Column:
    """Half to even."""
    return F.rint(_number(x))


def floor(x) -> Column:
    return F.floor(_number(x))


def ceiling(x) -> Column:
    return F.ceil(_number(x))


def json_path(doc: Column, *path: str) -> Column:
    """Element of a JSON text, as text."""
    return F.get_json_object(doc, "$" + "".join(f"['{p}']" for p in path))


def json_value(doc: Column, path: tuple[str, ...], like) -> Column:
    """Element of a JSON text in the type of the literal it is compared with."""
    if isinstance(like, bool):
        kind = "boolean"
    elif isinstance(like, (int, float)):
        kind = "double"
    else:
        return json_path(doc, *path)
    where = "$" + "".join(f"['{p}']" for p in path)
    return F.try_variant_get(F.try_parse_json(doc), where, kind)
