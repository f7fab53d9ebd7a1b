"""Output forms of whole results: pages, data arrays, links, raw values and stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorquery import schema
from sensorquery.catalog import chunk_start
from sensorquery.functions import render
from sensorquery.functions.values import Interval, Result, result_json
from sensorquery.operators import series
from sensorquery.operators.query import Query

ROWS_PER_FILE = 4_000_000  # some 100 to 200 MB of observations
DATA_ARRAY_COMPONENTS = (
    "id", "phenomenonTime", "resultTime", "result", "resultQuality", "validTime", "parameters"
)


def to_page(query: Query, count: bool = False) -> DataFrame:
    """One row ``page``: the envelope of a result page. At most ``top`` + 1 documents meet here."""
    if query.limit is None:
        raise ValueError("a page needs top()")
    docs = query.documents(extra=1)
    listed = docs.agg(F.array_sort(F.collect_list(F.struct("position", "json"))).alias("docs"))
    shown = F.transform(F.slice("docs", 1, query.limit), lambda d: d["json"])
    collection = schema.ENTITIES[query.table].collection
    link = f"{query.base}/{collection}?$top={query.limit}&$skip={query.offset + query.limit}"
    members = []
    if query.catalog.instant is not None:
        members.append(F.lit(f'"@iot.as_of":"{query.catalog.instant}"'))
    if count:
        totals = query.count_total()
        listed = listed.unionByName(totals, allowMissingColumns=True).agg(
            F.first("docs", ignorenulls=True).alias("docs"), F.max("count").alias("count")
        )
        members.append(F.concat(F.lit('"@iot.count":'), F.col("count").cast("string")))
    members += [
        F.when(F.size("docs") > query.limit, F.lit(f'"@iot.nextLink":"{link}"')),
        F.concat(F.lit('"value":['), F.array_join(shown, ","), F.lit("]")),
    ]
    return listed.select(F.concat(F.lit("{"), F.concat_ws(",", *members), F.lit("}")).alias("page"))


def _component_json(name: str) -> Column:
    value = render.property_value("observation", name, F.col) if name != "id" else F.col("id")
    if isinstance(value, Interval):
        value = render.interval_text(value)
    elif isinstance(value, Result):
        return F.coalesce(result_json(value), F.lit("null"))
    elif name in schema.TIME_PROPERTIES:
        value = render.time_text(value)
    elif name in schema.JSON_PROPERTIES:
        return F.coalesce(value, F.lit("null"))
    quoted = F.regexp_replace(F.to_json(F.array(value.cast("string"))), r"^\[|\]$", "")
    return F.coalesce(value.cast("string") if name == "id" else quoted, F.lit("null"))


def to_data_array(
    obs: DataFrame, components: tuple[str, ...] = DATA_ARRAY_COMPONENTS, base: str = "",
    rows_per_part: int = 10_000, id_width: int = 1_000_000,
) -> DataFrame:
    """Data-array groups: per datastream its link, components, row count and the rows in id order.

    A datastream with more than ``rows_per_part`` rows is written as several groups (``part``), so
    no group outgrows a task. Ids are cut into ranges of ``id_width`` to number the rows.
    """
    known = ("id", *schema.ENTITIES["observation"].properties)
    unknown = [c for c in components if c not in known]
    if unknown:
        raise ValueError(f"not an observation component: {unknown[0]}")
    placed = series.positions(
        obs, ["datastream_id"], ["id"], series.range_of(F.col("id"), id_width), "_pos"
    )
    row = F.concat(F.lit("["), F.concat_ws(",", *[_component_json(c) for c in components]), F.lit("]"))
    grouped = (
        placed.select("datastream_id", "id", series.range_of(F.col("_pos"), rows_per_part).alias("part"), row.alias("_row"))
        .groupBy("datastream_id", "part")
        .agg(
            F.count("*").alias("count"),
            F.array_sort(F.collect_list(F.struct("id", "_row"))).alias("_rows"),
        )
    )
    link = render.self_link("datastream", F.col("datastream_id"), base)
    rows = F.transform("_rows", lambda r: r["_row"])
    return grouped.select(
        "datastream_id", "part", link.alias("datastream_link"),
        F.array(*[F.lit(c) for c in components]).alias("components"), "count",
        F.concat(F.lit("["), F.array_join(rows, ","), F.lit("]")).alias("data_array"),
    )


def write_observations(obs: DataFrame, path: str, mode: str = "append", rows_per_file: int = ROWS_PER_FILE) -> None:
    """Observations in 30-day chunks, clustered by datastream and time.

    The number of files follows the rows, not the session: as many ranges as ``rows_per_file`` asks for,
    so a crowded chunk or datastream is split and none is larger than twice that. Each file covers a
    narrow range, so its statistics prune well. Counting reads a key column only.
    """
    chunked = obs.withColumn("chunk", chunk_start(F.col("phenomenon_start")))
    order = ["chunk", "datastream_id", "phenomenon_start", "id"]
    ranges = max(1, -(-obs.select("id").count() // rows_per_file))
    (
        chunked.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
        .write.mode(mode).option("maxRecordsPerFile", 2 * rows_per_file).partitionBy("chunk").parquet(path)
    )


def refs(df: DataFrame, name: str, base: str = "") -> DataFrame:
    """Self links only."""
    table = schema.entity(name).table
    return df.select("id", render.self_link(table, F.col("id"), base).alias("@iot.selfLink"))


def raw_value(df: DataFrame, name: str, prop: str) -> DataFrame:
    """One property as plain text; null becomes the text ``null``."""
    table = schema.entity(name).table
    column = render.output_column(table, prop, F.col)
    out = df.select("id", column.cast("string").alias("value"))
    if prop == "result":
        text = F.when(F.col("result_type") == schema.RESULT_STRING, F.col("result_string")).otherwise(column)
        out = df.select("id", text.alias("value"))
    return out.withColumn("value", F.coalesce("value", F.lit("null")))


def series_frame(obs: DataFrame, datastreams: DataFrame) -> DataFrame:
    """Numeric readings with the unit symbol of their datastream, sorted by datastream and time.

    The sort is global by range partitions, so it writes out in order without a single task.
    """
    units = datastreams.select(
        F.col("id").alias("datastream_id"), F.col("unit_of_measurement.symbol").alias("symbol")
    )
    frame = obs.join(units, "datastream_id").select(
        "datastream_id", "id", "phenomenon_start", F.col("result_number").cast("double").alias("result"),
        "result_quality", "symbol",
    )
    return frame.orderBy("datastream_id", "phenomenon_start", "id")
