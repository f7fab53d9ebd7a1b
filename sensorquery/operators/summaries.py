"""Stored summaries of observations per datastream and time chunk, merged upward.

A summary row holds what a datastream derives from the readings of one chunk: their number, time extents
and the hull of their features' places; extents of extents and hulls of hulls are those of the whole.
After a delete only the chunks that lost readings are summarised again; the derived state of a
datastream comes from its summaries, one row per chunk, and the chunks that lost nothing are not read.
A summary of each chunk's ids (a HyperLogLog sketch) answers estimated counts without reading readings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorquery.catalog import Catalog, chunk_start
from sensorquery.operators import maintain
from sensorquery.operators.query import Predicate, filter_rows
from sensorquery.schema import CHUNK_DAYS
from sensorquery.session import materialize

TABLE = "observation_summary"
KEY = ["datastream_id", "chunk"]
_SPAN, _ORIGIN = 1 << 16, 1 << 15  # chunk numbers lie within 2,700 years of 1970
SKETCH_BITS = 12  # about 1.6 percent


def with_chunk(obs: DataFrame) -> DataFrame:
    return obs if "chunk" in obs.columns else obs.withColumn("chunk", chunk_start(F.col("phenomenon_start")))


def _cell() -> Column:
    """Datastream and chunk in one number, for the hulls, which have one key."""
    number = F.floor(F.datediff("chunk", F.lit("1970-01-01").cast("date")) / F.lit(CHUNK_DAYS)).cast("long")
    return F.col("datastream_id") * _SPAN + number + _ORIGIN


def summarise(obs: DataFrame, features: DataFrame) -> DataFrame:
    """(datastream_id, chunk, n, time extents, area) of the readings, one row per datastream and chunk."""
    rows = with_chunk(obs)
    spans = rows.groupBy(*KEY).agg(
        F.count("*").alias("n"), F.min("phenomenon_start").alias("phenomenon_start"),
        F.max("phenomenon_end").alias("phenomenon_end"), F.min("result_time").alias("result_start"),
        F.max("result_time").alias("result_end"))
    cells = rows.select(_cell().alias("datastream_id"), "feature_of_interest_id")
    areas = maintain.observed_area(cells, features).select(
        F.col("datastream_id").alias("_cell"), F.col("observed_area").alias("area"))
    return spans.withColumn("_cell", _cell()).join(areas, "_cell", "left").drop("_cell")


def derived(summary: DataFrame) -> DataFrame:
    """(datastream_id, time extents, observed_area) of whole datastreams, from their summaries."""
    spans = summary.groupBy("datastream_id").agg(
        F.min("phenomenon_start").alias("phenomenon_start"), F.max("phenomenon_end").alias("phenomenon_end"),
        F.min("result_start").alias("result_start"), F.max("result_end").alias("result_end"))
    corners = summary.where("area is not null").select("datastream_id", F.explode(F.flatten("area.coords")).alias("p"))
    areas = maintain.hulls(corners.select("datastream_id", F.get("p", F.lit(0)).alias("x"), F.get("p", F.lit(1)).alias("y")))
    return spans.join(areas, "datastream_id", "left")


def with_summaries(catalog: Catalog) -> Catalog:
    """The catalog with the summaries of its observations, computed once over all of them."""
    return catalog.replace(**{TABLE: summarise(catalog.table("observation"), catalog.table("feature_of_interest"))})


def add_to_summaries(catalog: Catalog, inserted: DataFrame) -> Catalog:
    """The summaries after an insert: those of the new readings are merged into the ones of their chunks."""
    fresh = summarise(inserted, catalog.table("feature_of_interest"))
    held = catalog.table(TABLE)
    touched = held.join(fresh.select(*KEY), KEY, "left_semi")
    both = touched.unionByName(fresh)
    spans = both.groupBy(*KEY).agg(
        F.sum("n").alias("n"), F.min("phenomenon_start").alias("phenomenon_start"), F.max("phenomenon_end").alias("phenomenon_end"),
        F.min("result_start").alias("result_start"), F.max("result_end").alias("result_end"))
    corners = both.where("area is not null").select(_cell().alias("datastream_id"), F.explode(F.flatten("area.coords")).alias("p"))
    areas = maintain.hulls(corners.select("datastream_id", F.get("p", F.lit(0)).alias("x"), F.get("p", F.lit(1)).alias("y"))).select(
        F.col("datastream_id").alias("_cell"), F.col("observed_area").alias("area"))
    merged = spans.withColumn("_cell", _cell()).join(areas, "_cell", "left").drop("_cell")
    return catalog.replace(**{TABLE: held.join(merged.select(*KEY), KEY, "left_anti").unionByName(merged.select(*held.columns))})


def after_delete(catalog: Catalog, lost: DataFrame) -> Catalog:
    """State after the readings ``lost`` (id, datastream_id, chunk) went: observations without them,
    summaries of their chunks taken anew, extents and area of their datastreams merged from summaries.

    ``lost`` should be fixed (a table or checkpoint), as it is read several times. The days on which the
    touched chunks begin, some twelve for each year, prune the scan of the readings that remain.
    """
    obs = with_chunk(catalog.table("observation"))
    touched = lost.select(*KEY).distinct()
    days = [r[0] for r in lost.select("chunk").distinct().collect()]
    remaining = obs.join(lost.select("id"), "id", "left_anti")
    near = obs.where(F.col("chunk").isin(days)).join(touched, KEY, "left_semi").join(lost.select("id"), "id", "left_anti")
    held = catalog.table(TABLE)
    summary = held.join(touched, KEY, "left_anti").unionByName(
        summarise(near, catalog.table("feature_of_interest")).select(*held.columns))
    hit = touched.select("datastream_id").distinct()
    fresh = derived(summary.join(hit, "datastream_id", "left_semi"))
    streams = catalog.table("datastream")
    named = hit.join(fresh, "datastream_id", "left").select(
        F.col("datastream_id").alias("id"), F.lit(True).alias("_hit"),
        *[F.col(c).alias(f"_new_{c}") for c in (*maintain.EXTENT_COLUMNS, "observed_area")])
    both = streams.join(named, "id", "left")
    kept = {c: F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)) for c in (*maintain.EXTENT_COLUMNS, "observed_area")}
    return catalog.replace(**{
        TABLE: summary, "datastream": both.withColumns(kept).select(*streams.columns),
        "observation": remaining.select(*catalog.table("observation").columns)})


def delete_where(catalog: Catalog, predicate: Predicate | None) -> tuple[Catalog, DataFrame]:
    """(state, deleted observations) for a filter, by summaries. What is deleted is found once: ids and
    chunks are fixed by a checkpoint."""
    if predicate is None:
        raise ValueError("a delete needs a filter")
    hit = with_chunk(filter_rows(catalog.table("observation"), "observation", predicate, catalog))
    lost = materialize(hit.select("id", *KEY))
    gone = catalog.table("observation").join(lost.select("id"), "id", "left_semi")
    return after_delete(catalog, lost), gone


def delete_features(catalog: Catalog, features: DataFrame) -> Catalog:
    """State after deleting features of interest (column ``id``) with their readings; the locations that
    generated them forget them."""
    keys = features.select(F.col("id").alias("feature_of_interest_id")).distinct()
    lost = materialize(with_chunk(catalog.table("observation")).join(keys, "feature_of_interest_id", "left_semi").select("id", *KEY))
    kept = catalog.table("feature_of_interest").join(features.select("id"), "id", "left_anti")
    places = catalog.table("location")
    gone = features.select(F.col("id").alias("gen_foi_id"), F.lit(True).alias("_gone"))
    marked = places.join(gone, "gen_foi_id", "left").withColumn(
        "gen_foi_id", F.when(F.col("_gone").isNull(), F.col("gen_foi_id"))).select(*places.columns)
    return after_delete(catalog.replace(feature_of_interest=kept, location=marked), lost)


# -- estimated counts ------------------------------------------------------------------------


def sketches(obs: DataFrame, *by: str) -> DataFrame:
    """(chunk, ``by``, sketch): a mergeable sketch of the distinct ids of each chunk and value of ``by``."""
    return with_chunk(obs).groupBy("chunk", *by).agg(F.hll_sketch_agg("id", SKETCH_BITS).alias("sketch"))


def estimate(stored: DataFrame, *by: str) -> DataFrame:
    """(``by``, count): estimated numbers of readings from stored sketches, which filters on chunk and
    ``by`` may have cut before; no reading is looked at."""
    merged = stored.groupBy(*by).agg(F.hll_union_agg("sketch").alias("sketch"))
    return merged.select(*by, F.hll_sketch_estimate("sketch").alias("count"))
