"""Load rules of the feeders: append, backfill, update, copy and report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorquery.catalog import chunk_start
from sensorquery.functions import values
from sensorquery.operators import identity, series

SERIES_KEY = ["datastream_id", "phenomenon_start"]


def within_span(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Existing observations in the time chunks of a batch. Where the store is laid out by chunk, the
    join prunes its partitions while it runs; nothing is computed beforehand."""
    if "chunk" not in existing.columns:
        return existing
    chunks = new.select(chunk_start(F.col("phenomenon_start")).alias("chunk")).distinct()
    return existing.join(chunks, "chunk", "left_semi").select(*existing.columns)


def missing_only(new: DataFrame, existing: DataFrame) -> DataFrame:
    """Backfill: readings whose datastream and time are not stored yet."""
    held = within_span(existing, new).select(*SERIES_KEY)
    return new.join(held, SERIES_KEY, "left_anti")


def append_only(new: DataFrame, datastreams: DataFrame) -> DataFrame:
    """Readings after the end of their datastream."""
    ends = datastreams.select(F.col("id").alias("datastream_id"), F.col("phenomenon_end").alias("_end"))
    later = F.col("_end").isNull() | (F.col("phenomenon_start") > F.col("_end"))
    return new.join(ends, "datastream_id", "left").where(later).drop("_end")


RESULT_COLUMNS = ("result_type", "result_number", "result_string", "result_boolean", "result_json", "result_quality")


def upsert(new: DataFrame, existing: DataFrame) -> DataFrame:
    """Readings with a ``status``: unchanged, updated (with the stored id) or new; one row out for
    every row in.

    All result columns that the readings have are compared, of whatever type. Of several stored
    readings at one time the one with the same end counts first, then the one with the smallest id.
    """
    compared = [c for c in RESULT_COLUMNS if c in new.columns]
    ends = [c for c in ("phenomenon_end",) if c in new.columns and c in existing.columns]
    stored = F.struct(F.col("id").alias("id"), *[
        (F.col(c) if c in existing.columns else F.lit(None).cast(new.schema[c].dataType)).alias(c) for c in compared
    ])
    near = within_span(existing, new)
    first = near.groupBy(*SERIES_KEY).agg(F.min_by(stored, "id").alias("_first"))
    joined = new.join(first, SERIES_KEY, "left")
    held = F.col("_first")
    if ends:
        exact = near.groupBy(*SERIES_KEY, *ends).agg(F.min_by(stored, "id").alias("_exact"))
        joined = joined.join(exact, [*SERIES_KEY, *ends], "left")
        held = F.coalesce("_exact", "_first")
    judged = joined.withColumn("_held", held)
    same = reduce(lambda a, b: a & b, [F.col(f"_held.{c}").eqNullSafe(F.col(c)) for c in compared], F.lit(True))
    status = F.when(F.col("_held").isNull(), "new").when(same, "unchanged").otherwise("updated")
    return judged.withColumn("existing_id", F.col("_held.id")).withColumn("status", status).select(
        *new.columns, "existing_id", "status")


def dedup_first(obs: DataFrame, order: list[str]) -> DataFrame:
    """First reading per datastream and time."""
    return series.first_per_key(obs, SERIES_KEY, order)


def drop_nodata(obs: DataFrame, sentinel: float, column: str = "result_number") -> DataFrame:
    return obs.where(~values.is_nodata(F.col(column).cast("string"), sentinel))


def clamp(df: DataFrame, start: str | None, end: str | None, column: str = "phenomenon_start") -> DataFrame:
    """Readings within the configured window, both ends included."""
    if start is not None:
        df = df.where(F.col(column) >= F.lit(start).cast("timestamp"))
    if end is not None:
        df = df.where(F.col(column) <= F.lit(end).cast("timestamp"))
    return df


def windows(df: DataFrame, lower: str, upper: str, days: int) -> DataFrame:
    """Steps of ``days`` covering [lower, upper) of each row: ``window_start``, ``window_end``."""
    step = F.make_dt_interval(F.lit(days))
    begin, end = F.col(lower), F.col(upper)
    starts = F.filter(F.sequence(begin, end, step), lambda t: t < end)
    return df.where(begin < end).withColumn("window_start", F.explode(starts)).withColumn(
        "window_end", F.least(F.col("window_start") + step, end)
    )


def load_report(result: DataFrame, status: str = "status") -> DataFrame:
    """Rows per status of a load."""
    return result.groupBy(F.col(status).alias("status")).agg(F.count("*").alias("rows"))


def map_datastreams(source: DataFrame, target: DataFrame, mapping: DataFrame) -> DataFrame:
    """``source_name, target_name, source_id, target_id, status`` for a name mapping.

    A source name listed twice, or a name held by several datastreams, is a conflict; names without
    a datastream are reported as missing.
    """
    listed = mapping.groupBy("source_name").agg(
        F.min("target_name").alias("target_name"), F.count("*").alias("_listed")
    )

    def index(df: DataFrame, side: str) -> DataFrame:
        return df.groupBy(F.col("name").alias(f"{side}_name")).agg(
            F.min("id").alias(f"{side}_id"), F.count("*").alias(f"_{side}_n")
        )

    joined = listed.join(index(source, "source"), "source_name", "left").join(
        index(target, "target"), "target_name", "left"
    )
    status = (
        F.when(F.col("_listed") > 1, "duplicate mapping")
        .when(F.col("_source_n").isNull(), "missing source")
        .when(F.col("_target_n").isNull(), "missing target")
        .when((F.col("_source_n") > 1) | (F.col("_target_n") > 1), "duplicate name")
        .otherwise("ok")
    )
    return joined.select("source_name", "target_name", "source_id", "target_id", status.alias("status"))


def copy_series(
    source: DataFrame, stored: DataFrame, mapping: DataFrame, *,
    start: str | None = None, end: str | None = None, nodata: float | None = None,
) -> DataFrame:
    """Observations of mapped datastreams with their fate: copied, exists or nodata.

    ``mapping`` is the result of ``map_datastreams``. Rows with status ``copied`` are the ones to
    append to the target; counting the status gives the load report.
    """
    pairs = mapping.where(F.col("status") == "ok").select(
        F.col("source_id").alias("datastream_id"), F.col("target_id").alias("_target")
    )
    moved = (
        clamp(source, start, end).join(pairs, "datastream_id")
        .withColumn("datastream_id", F.col("_target")).drop("_target")
    )
    held = within_span(stored, moved).select(*SERIES_KEY).distinct().withColumn("_held", F.lit(True))
    status = F.when(F.col("_held"), "exists")
    if nodata is not None:
        status = status.when(values.is_nodata(F.col("result_number").cast("string"), nodata), "nodata")
    return moved.join(held, SERIES_KEY, "left").withColumn(
        "status", status.otherwise("copied")
    ).drop("_held")


def from_legacy(rows: DataFrame) -> DataFrame:
    """Rows (datastream_id, time, value, quality) of text to observations; time is also resultTime."""
    t = F.try_to_timestamp("time")
    typed = values.parse_result(F.col("value"))
    return rows.select(
        "datastream_id", t.alias("phenomenon_start"), t.alias("phenomenon_end"), t.alias("result_time"),
        *[c.alias(n) for n, c in typed.items()],
        F.col("quality").cast("string").alias("result_quality"),
    )


def normalise_observations(df: DataFrame, now: Column | None = None) -> DataFrame:
    """Insert defaults: the phenomenon time is now, and ends where it starts."""
    start = F.coalesce("phenomenon_start", now if now is not None else F.current_timestamp())
    return df.withColumn("phenomenon_start", start).withColumn(
        "phenomenon_end", F.coalesce("phenomenon_end", "phenomenon_start")
    )


def reject_duplicates(new: DataFrame, existing: DataFrame, order: list[str]) -> DataFrame:
    """Observations judged by the unique key (datastream, start, end)."""
    return identity.enforce_unique(
        new, existing, ["datastream_id", "phenomenon_start", "phenomenon_end"], order
    )
