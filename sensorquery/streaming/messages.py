"""Messages (topic, payload) to observations; the same operators serve batches and streams."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sensorquery.functions import values
from sensorquery.operators import identity


@dataclass(frozen=True)
class MessageConfig:
    """Topic patterns with their datastream names by position, and the payload layout."""

    mapping: dict[str, list[str]] = field(default_factory=dict)
    separator: str = ","
    time_format: str | None = None
    zone: str = "UTC"


def topic_regex(pattern: str) -> str:
    """``+`` stands for one level, a trailing ``#`` for any number of levels."""
    levels = pattern.split("/")
    if "#" in levels[:-1]:
        raise ValueError(f"'#' must be the last level: {pattern}")
    parts = ["[^/]*" if level == "+" else re.escape(level) for level in levels]
    if levels[-1] != "#":
        return f"^{'/'.join(parts)}$"
    head = "/".join(parts[:-1])
    return f"^{head}(/.*)?$" if head else "^.*$"


def route(df: DataFrame, mapping: dict[str, list[str]], topic: str = "topic") -> DataFrame:
    """Adds ``names``: the datastream names of the topic, null without a mapping.

    An exact topic wins, then the first pattern in the order of the mapping. Exact topics are a table
    joined by topic, of any length; only patterns with wildcards are part of the expression.
    """
    wild = {p: n for p, n in mapping.items() if set(p.split("/")) & {"+", "#"}}
    exact = [(p, n) for p, n in mapping.items() if p not in wild]
    table = df.sparkSession.createDataFrame(exact, "_topic string, _exact array<string>")
    return route_by(df, F.broadcast(table), wild, topic)  # a mapping that the driver holds; rows stay where they are


def route_by(
    df: DataFrame, exact: DataFrame, patterns: dict[str, list[str]], topic: str = "topic"
) -> DataFrame:
    """``route`` with the exact topics in a table (``_topic`` unique, ``_exact`` the names)."""
    nothing = F.lit(None).cast("array<string>")
    tests = [
        F.when(F.col(topic).rlike(topic_regex(p)), F.array(*map(F.lit, names))) for p, names in patterns.items()
    ]
    joined = df.join(exact, F.col(topic) == F.col("_topic"), "left")
    return joined.withColumn("names", F.coalesce("_exact", *tests, nothing)).drop("_topic", "_exact")


def split_payload(df: DataFrame, separator: str = ",", payload: str = "payload") -> DataFrame:
    """Adds ``time_text`` and ``fields``; ``fields`` is null for payloads of fewer than two parts."""
    parts = F.transform(F.split(F.col(payload).cast("string"), re.escape(separator), -1), lambda p: F.trim(p))
    long_enough = F.size(parts) >= 2
    return df.withColumn("time_text", F.when(long_enough, F.get(parts, F.lit(0)))).withColumn(
        "fields", F.when(long_enough, F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))))
    )


def pair_values(df: DataFrame) -> DataFrame:
    """One row per value with its datastream name, by position; extra values and names are ignored,
    values mapped to the skip name are dropped."""
    count = F.least(F.size("names"), F.size("fields"))
    pairs = F.arrays_zip(
        F.slice("names", 1, count).alias("name"), F.slice("fields", 1, count).alias("raw")
    )
    rows = df.where(F.col("names").isNotNull() & F.col("fields").isNotNull()).withColumn(
        "_pair", F.explode(pairs)
    )
    return rows.select(
        *df.columns, F.col("_pair.name").alias("name"), F.col("_pair.raw").alias("raw")
    ).where(F.lower(F.trim("name")) != values.SKIP_NAME)


def null_policy(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Adds ``result_number`` and ``result_quality``: null tokens become the no-data value, texts
    that are no number become null."""
    missing = values.is_null_token(F.col(raw))
    number = F.when(missing, F.lit(values.MESSAGE_NODATA)).otherwise(values.to_number(F.col(raw)))
    quality = F.when(missing, values.MESSAGE_NODATA_QUALITY).otherwise(values.MESSAGE_GOOD_QUALITY)
    return df.withColumn("result_number", number).withColumn("result_quality", quality)


def message_status(df: DataFrame) -> Column:
    """Why a message yields nothing, or ``ok``; needs the columns of ``route`` and ``split_payload``."""
    return (
        F.when(F.col("names").isNull(), "no mapping")
        .when(F.col("fields").isNull(), "bad payload")
        .when(F.col("phenomenon_start").isNull(), "bad time")
        .otherwise("ok")
    )


def parse_messages(df: DataFrame, cfg: MessageConfig) -> DataFrame:
    """Messages with their names, fields, time and status."""
    routed = split_payload(route(df, cfg.mapping), cfg.separator)
    stamp = values.parse_station_time(F.col("time_text"), cfg.time_format, cfg.zone)
    timed = routed.withColumn("phenomenon_start", stamp)
    return timed.withColumn("status", message_status(timed))


def refused_messages(df: DataFrame, cfg: MessageConfig, datastreams: DataFrame | None = None) -> DataFrame:
    """What the ingest does not load, with its ``reason``: (topic, payload, name, raw, reason).

    A message without mapping, with a bad payload or time is one row; of a message that parses, each
    value that is no number, and with ``datastreams`` each value whose name is missing or ambiguous.
    """
    parsed = parse_messages(df, cfg)
    none = F.lit(None).cast("string")
    whole = parsed.where(F.col("status") != "ok").select(
        "topic", F.col("payload").cast("string").alias("payload"), none.alias("name"), none.alias("raw"),
        F.col("status").alias("reason"))
    paired = null_policy(pair_values(parsed.where(F.col("status") == "ok").drop("status")))
    judged = paired.withColumn("reason", F.when(F.col("result_number").isNull(), "not a number"))
    if datastreams is not None:
        named = identity.resolve_ids(judged, "name", datastreams, "datastream_id")
        unknown = F.when(F.col("status") != "ok", F.concat(F.lit("name is "), F.col("status")))
        judged = named.withColumn("reason", F.coalesce("reason", unknown))
    return whole.unionByName(judged.where(F.col("reason").isNotNull()).select(
        "topic", F.col("payload").cast("string").alias("payload"), "name", "raw", "reason"))


def observations_from_messages(df: DataFrame, cfg: MessageConfig) -> DataFrame:
    """Observations (by datastream name) of the messages that parse."""
    good = parse_messages(df, cfg).where(F.col("status") == "ok")
    rows = null_policy(pair_values(good)).where(F.col("result_number").isNotNull())
    return rows.select(
        "topic", "name", "phenomenon_start", F.col("phenomenon_start").alias("phenomenon_end"),
        "result_number", "result_quality",
    )


def start_ingest(
    stream: DataFrame, cfg: MessageConfig, datastreams: DataFrame,
    sink: Callable[[DataFrame, int], None], checkpoint: str, *,
    rejects: Callable[[DataFrame, int], None], once: bool = False,
) -> StreamingQuery:
    """Continuous ingest: messages to observations with datastream ids, handed to ``sink`` per batch;
    what is not loaded goes to ``rejects`` with its reason.

    The checkpoint makes restarts resume where they stopped; both sinks get the batch number so that
    they can write idempotently.
    """

    def write(batch: DataFrame, number: int) -> None:
        rows = observations_from_messages(batch, cfg)
        resolved = identity.resolve_ids(rows, "name", datastreams, "datastream_id")
        sink(resolved.where(F.col("status") == "ok").drop("status"), number)
        rejects(refused_messages(batch, cfg, datastreams), number)

    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if once else writer).start()
