"""Observation and entity documents to rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorquery import schema
from sensorquery.catalog import Catalog
from sensorquery.functions import geometry, values
from sensorquery.operators import identity, loading, mutations
from sensorquery.session import materialize
from sensorquery.sources import nested

_BATCH = (
    "array<struct<Datastream:struct<`@iot.id`:long>,components:array<string>,"
    "dataArray:array<array<variant>>>>"
)


def _component_rows(docs: DataFrame, column: str) -> DataFrame:
    """One row per data array entry: its document's keys, position and a component map. A document or
    set that holds no array at all stays as one row without values; empty arrays hold no rows."""
    parsed = docs.withColumn("_sets", F.from_json(column, _BATCH))
    sets = parsed.where(F.col("_sets").isNull() | (F.size("_sets") > 0)).withColumn("_set", F.explode_outer("_sets"))
    filled = sets.where(F.col("_set.dataArray").isNull() | (F.size("_set.dataArray") > 0))
    return filled.select(
        *[c for c in docs.columns if c != column],
        F.col("_set.Datastream.`@iot.id`").alias("datastream_id"),
        F.col("_set.components").alias("_components"),
        F.col("_sets").isNull().alias("_unread"),
        F.posexplode_outer("_set.dataArray").alias("row", "_values"),
    )


def _component(name: str) -> Column:
    """Value of a named component; null where the row is too short to hold it."""
    where = F.array_position("_components", name)
    return F.when(where > 0, F.get("_values", (where - 1).cast("int")))


def _text(name: str) -> Column:
    return F.try_variant_get(_component(name), "$", "string")


def _observation_columns() -> dict[str, Column]:
    times = values.parse_time(_text("phenomenonTime"))
    valid = values.parse_time(_text("validTime"))
    return {
        "phenomenon_start": times.lower, "phenomenon_end": times.upper,
        "result_time": F.try_to_timestamp(_text("resultTime")),
        **values.typed_result(_component("result")),
        "result_quality": _text("resultQuality"),
        "valid_start": valid.lower, "valid_end": valid.upper,
        "parameters": F.to_json(_component("parameters")),
        "feature_of_interest_id": F.try_variant_get(_component("FeatureOfInterest/id"), "$", "long"),
    }


def _row_reason() -> Column:
    """Why a single row cannot become an observation."""
    required = F.array_contains("_components", "phenomenonTime") & F.array_contains(
        "_components", "result"
    )
    return (
        F.when(F.col("_unread"), "not a data array document")
        .when(F.col("datastream_id").isNull(), "missing datastream")
        .when(F.col("_values").isNull(), "no data array")
        .when(~F.coalesce(required, F.lit(False)), "missing component")
        .when(F.col("result_type").isNull(), "result has no type")
        .when(_text("phenomenonTime").isNotNull() & F.col("phenomenon_start").isNull(), "bad time")
    )


def read_data_array(docs: DataFrame, column: str = "doc") -> tuple[DataFrame, DataFrame]:
    """(rows, errors) of data-array documents; a bad row does not stop the others. A document that
    does not parse is one error, so rows and errors together are all that came in.

    Components missing at the end of a short row are null. Other columns of ``docs`` are kept.
    """
    rows = _component_rows(docs, column).withColumns(_observation_columns())
    judged = rows.withColumn("reason", _row_reason()).drop("_components", "_values", "_unread")
    good = judged.where(F.col("reason").isNull()).drop("reason")
    return good, judged.where(F.col("reason").isNotNull()).withColumn("status", F.lit("error"))


def read_bulk(docs: DataFrame, column: str = "doc") -> DataFrame:
    """Rows of bulk documents; the whole load fails on a document that breaks the rules.

    Every document must parse and needs a datastream, ``phenomenonTime`` and ``result``, may not carry
    ``featureOfInterest``, and its rows need a typed result and a time that can be read. The check is
    one aggregate over the rows: one line per reason comes back. Rows are written, so that documents
    are parsed once, however often their rows are read.
    """
    rows = _component_rows(docs, column).withColumns(_observation_columns())
    extra = F.array_contains("_components", "featureOfInterest")
    reason = F.coalesce(_row_reason(), F.when(extra, "featureOfInterest is not allowed"))
    judged = materialize(rows.withColumn("_reason", reason).drop("_components", "_values", "_unread"))
    broken = judged.groupBy(F.col("_reason").alias("reason")).agg(F.count("*").alias("n")).where("reason is not null")
    found = sorted(f"{r['n']} rows: {r['reason']}" for r in broken.collect())  # one line per reason
    if found:
        raise ValueError("; ".join(found))
    return judged.drop("_reason")


# -- nested entity documents -----------------------------------------------------------------


def flatten_documents(
    docs: DataFrame, start_ids: dict[str, int] | None = None, root: str = "Thing"
) -> dict[str, DataFrame]:
    """Documents (doc_id, doc) of any root with everything nested in them, as one row set per table.

    Ids follow document and position order. Linked entities (``@iot.id``) are used as they are; inline
    ones are created. A thing with locations gets one historical location per document, linked to all
    of them. Nothing is judged here but the shape: a document that breaks a rule of ``nested.members``
    gives no rows; ``deep_insert`` returns it with its reason.
    """
    parts = nested.rows_of(nested.members(docs, root).where("reason is null"), start_ids or {})
    parts.pop("relinked")
    return {n: rows.drop("moved") for n, rows in parts.items()}


def _observation_rows(rows: DataFrame, order: list, at: Column | None = None) -> DataFrame:
    """Observation columns without ids, with ``seq``: the order they came in. A missing time is ``at``."""
    own = [c for c in schema.columns("observation") if c != "id"]
    placed = rows.withColumn("seq", F.struct(*order))
    missing = {c: F.lit(None).cast(schema.struct("observation")[c].dataType) for c in own if c not in rows.columns}
    filled = loading.normalise_observations(placed.withColumns(missing), at)
    return filled.select(*own, "seq")


def bulk_insert(
    catalog: Catalog, docs: DataFrame, order: list[str], column: str = "doc"
) -> tuple[Catalog, DataFrame, DataFrame]:
    """(catalog, inserted, rejects) of bulk documents: all documents must be sound (``read_bulk``), then
    features, uniqueness, ids, extents, area and last feature follow as for any insert. ``order``: the
    columns of ``docs`` that tell which document came first."""
    rows = read_bulk(docs, column)
    return mutations.insert_observations(catalog, _observation_rows(rows, [*order, "row"]))


def _relink(catalog: Catalog, relinked: DataFrame) -> dict[str, DataFrame]:
    """Tables whose stored rows got other parents: the last document that says so counts."""
    used = sorted((r[0], r[1]) for r in relinked.select("table", "fk").distinct().collect())  # names of the schema
    state: dict[str, DataFrame] = {}
    for table, fk in used:
        pairs = relinked.where((F.col("table") == table) & (F.col("fk") == fk)).groupBy("id").agg(
            F.max_by("target", "order").alias("parent_id"))
        state[table] = mutations.relink(state.get(table, catalog.table(table)), pairs, fk)
    return state


def deep_insert(
    catalog: Catalog, docs: DataFrame, at: str, root: str = "Thing", commit: dict[str, str] | None = None
) -> tuple[Catalog, dict[str, DataFrame], DataFrame]:
    """(catalog, inserted rows per table, rejects) of documents (doc_id, doc) with all they hold.

    ``root`` names the entity of the documents; a column ``entity`` in ``docs`` names it per document.
    A document is rejected whole, with the first reason in document order, if any member breaks the
    rules of ``nested`` (unknown or missing members, wrong types, times, results or geometries that
    cannot be read) or links to an id that is not stored. A linked Datastream or Observation nested
    under a new parent moves there; a stored Thing under a new Location moves there too, and its visit
    is recorded. An observation refused on its own (no location to take a feature from, or not unique)
    is a reject without a ``doc_id``. Visits and readings without a time are dated ``at``. Readings go
    the way of every insert, so features, extents, areas and last features are kept. ``commit``
    (author, message, encodingType) adds a row to the commit log and stamps new rows of tables that
    carry a commit.
    """
    found = nested.members(docs, root)
    stored = {n: catalog.table(n) for n in schema.ENTITIES if catalog.has(n)}
    broken = nested.judged(found)
    lost = nested.unknown_links(found.where("reason is null"), stored)
    refused = materialize(broken.unionByName(lost.select(*broken.columns)).groupBy("part", "nr").agg(
        F.first("doc_id").alias("doc_id"), F.first("reason").alias("reason")))
    accepted = found.join(refused.select("part", "nr"), ["part", "nr"], "left_anti")
    highest = [rows.agg(F.lit(n).alias("n"), F.max("id").alias("last")) for n, rows in stored.items()]
    starts = {r["n"]: (r["last"] or 0) + 1 for r in reduce(DataFrame.unionByName, highest).collect()}  # one row per table
    parts = nested.rows_of(accepted, starts)
    moment = F.lit(at).cast("timestamp")
    parts["historical_location"] = parts["historical_location"].withColumn("time", F.coalesce("time", moment))
    if commit is not None:
        number = starts.get("commit_log", 1)
        parts["commit_log"] = catalog.spark.createDataFrame(
            [(number, commit["author"], commit.get("encodingType", "text/plain"), commit["message"])],
            "id long, author string, encoding_type string, message string",
        ).withColumns({"date": moment, "action_type": F.lit("CREATE")})
    readings, relinked, links = parts.pop("observation"), parts.pop("relinked"), parts["thing_location"]
    state = catalog.replace(**_relink(catalog, relinked))
    moved = links.where("moved").select("thing_id").distinct()
    if catalog.has("thing_location"):
        state = state.replace(thing_location=state.table("thing_location").join(moved, "thing_id", "left_anti"))
    parts["thing_location"] = links.drop("moved")

    def stamped(name: str, rows: DataFrame) -> DataFrame:
        had = state.table(name).columns if state.has(name) else []
        extra = {"valid_from": moment} if "valid_from" in had else {}
        if commit is not None and "commit_id" in had:
            extra["commit_id"] = F.lit(number).cast("long")
        return rows.withColumns(extra) if extra else rows

    parts = {n: stamped(n, rows) for n, rows in parts.items()}
    state = state.replace(**{
        n: state.table(n).unionByName(rows, allowMissingColumns=True) if state.has(n) else rows for n, rows in parts.items()
    })
    rows = materialize(stamped("observation", _observation_rows(readings, ["id"], moment)))
    state, inserted, late = mutations.insert_observations(state, rows)
    rejects = refused.select("doc_id", "reason").unionByName(
        late.select(F.lit(None).cast("long").alias("doc_id"), "reason"))
    return state, {**parts, "observation": inserted}, rejects


# -- citizen observations --------------------------------------------------------------------

# The water attributes that become observations, with the name of their observed property
# and unit, the symbol, and the last part of the unit's and the property's definition.
WATER_ATTRIBUTES = {
    "fu_value": ("Fluorescence", "FU", "FluorescenceUnit", "Fluorescence"),
    "fu_observed": ("Forel-Ule observed", "FU", "FluorescenceUnit", "ForelUleObserved"),
    "fu_processed": ("Forel-Ule processed", "FU", "FluorescenceUnit", "ForelUleProcessed"),
    "hue_angle": ("Hue Angle", "°", "Degree", "HueAngle"),
    "p_chla": ("Chlorophyll-a concentration", "µg/L", "MicrogramPerLiter", "ChlorophyllAConcentration"),
    "p_conductivity": ("Conductivity", "µS/cm", "MicroSiemensPerCentimeter", "Conductivity"),
    "p_dissolved_oxygen": ("Dissolved Oxygen", "mg/L", "MilligramPerLiter", "DissolvedOxygenConcentration"),
    "p_ph": ("pH", "pH", "pH", "pH"),
    "p_phycocyanin": ("Phycocyanin concentration", "µg/L", "MicrogramPerLiter", "PhycocyaninConcentration"),
    "p_salinity": ("Salinity", "PSU", "PracticalSalinityUnit", "Salinity"),
    "p_temperature": ("Temperature", "°C", "DegreeCelsius", "Temperature"),
    "sd_depth": ("Depth", "m", "Meter", "Depth"),
    "p_cloud_cover": ("Cloud Cover", "%", "Percent", "CloudCover"),
    "macrophytes": ("Macrophytes", "count", "Count", "MacrophyteCount"),
}
# Where the definitions lie, and the type of the readings.
UNIT_BASE = "http://www.qudt.org/qudt/owl/1.0.0/unit/Instances.html/"
PROPERTY_BASE = "http://www.qudt.org/qudt/owl/1.0.0/quantity/Instances.html/"
MEASUREMENT = "http://www.opengis.net/def/observationType/OGC-OM/2.0/OM_Measurement"
# Members that may hold the list of observations.
WRAPPERS = ("value", "results", "observations", "data")


def citizen_items(docs: DataFrame, column: str = "doc") -> DataFrame:
    """One JSON item per citizen observation of list documents, bare or under a wrapper member. A
    document that holds no list stays as one row without an item."""
    text = F.trim(F.col(column))
    listed = F.when(text.startswith("["), text)
    wrapped = [
        F.when(F.get_json_object(text, f"$.{w}").startswith("["), F.get_json_object(text, f"$.{w}"))
        for w in WRAPPERS
    ]
    items = docs.withColumn("_items", F.from_json(F.coalesce(listed, *wrapped), "array<string>"))
    held = items.where(F.col("_items").isNull() | (F.size("_items") > 0))
    return held.withColumn("item", F.explode_outer("_items")).drop("_items", column)


def read_citizen_json(docs: DataFrame, column: str = "doc") -> tuple[DataFrame, DataFrame]:
    """(observations, errors): one observation per known water attribute with a value. Errors are items
    without position or time and documents that hold no list; ``refused_attributes`` returns the
    attributes that are not known. An attribute without a value is not a reading."""
    held, errors = _citizen_values(docs, column)
    return held.where(F.col("attribute").isin(*WATER_ATTRIBUTES)).withColumn("result_quality", F.lit("100")), errors


def refused_attributes(docs: DataFrame, column: str = "doc") -> DataFrame:
    """Values of attributes that are not known, with the ``reason``; the other columns as of observations."""
    held, _ = _citizen_values(docs, column)
    return held.where(~F.col("attribute").isin(*WATER_ATTRIBUTES)).withColumn(
        "reason", F.concat(F.lit("unknown attribute: "), F.col("attribute")))


def _citizen_values(docs: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    item = F.col("item")
    lat, lon = values.extract_lat_lon(item)
    key = F.coalesce(F.get_json_object(item, "$.id"), F.get_json_object(item, "$.uuid"))
    placed = F.format_string("%.7f_%.7f", lat, lon)
    user = F.coalesce(F.get_json_object(item, "$.user.user_n_code"), F.lit("unknown"))
    device = values.first_present(
        *[F.get_json_object(item, f"$.device.{n}") for n in ("device_model", "model", "name")],
        F.lit("unknown device"),
    )
    when = F.get_json_object(item, "$.image.date_photo")
    read = citizen_items(docs, column).select(
        "*", key.alias("source_id"), lat.alias("lat"), lon.alias("lon"), user.alias("user"),
        device.alias("sensor"), F.try_to_timestamp(when).alias("phenomenon_start"),
        values.short_key(F.coalesce(key, placed)).alias("feature_key"),
        F.from_json(F.get_json_object(item, "$.water"), "map<string,string>").alias("_water"),
    )
    reason = F.when(F.col("item").isNull(), "not a list of observations").when(F.col("lat").isNull() | F.col("lon").isNull(), "missing position").when(
        F.col("phenomenon_start").isNull(), "missing time"
    )
    judged = read.withColumn("reason", reason).drop("item")
    good = judged.where(F.col("reason").isNull()).drop("reason")
    held = good.select("*", F.explode("_water").alias("attribute", "value")).drop("_water").where(F.col("value").isNotNull())
    return held, judged.where(F.col("reason").isNotNull()).drop("_water")


def water_attributes(catalog_or_spark) -> DataFrame:
    """(attribute, name, unit_of_measurement, definition) of the known water attributes."""
    spark = getattr(catalog_or_spark, "spark", catalog_or_spark)
    rows = [(k, name, (name, symbol, UNIT_BASE + unit), PROPERTY_BASE + prop) for k, (name, symbol, unit, prop) in WATER_ATTRIBUTES.items()]
    return spark.createDataFrame(rows, f"attribute string, name string, unit_of_measurement {schema.UNIT}, definition string")


def load_citizen(
    catalog: Catalog, rows: DataFrame, thing_id: int, network: str, prefix: str = "Citizen"
) -> tuple[Catalog, DataFrame, DataFrame]:
    """(catalog, inserted, rejects) of citizen observations (the first result of ``read_citizen_json``).

    Network, sensors, features, observed properties and datastreams are looked up by name and created
    where they are missing: one datastream per attribute, with its unit and property, under the thing and
    with the sensor of the first observation that needs it. A name that several stored rows share is a
    conflict: readings that need it are rejected. Readings then go the way of every insert.
    """
    text = F.lit("Citizen observation")
    point = F.format_string('{"type":"Point","coordinates":[%s,%s]}', F.col("lon").cast("string"), F.col("lat").cast("string"))
    about = water_attributes(catalog).withColumnRenamed("name", "property")
    sure = materialize(rows.join(about, "attribute").withColumns({
        "foi": F.concat(F.lit(f"{prefix}_FOI_"), "feature_key"), "stream": F.concat(F.lit(f"{prefix}Datastream_"), "attribute"),
        "network": F.lit(network), "place": geometry.from_geojson(point)}))
    order = F.struct("source_id", "phenomenon_start")
    # Per table: the column that holds the names, and what a new row of the first that needs it is made of.
    asked = {
        "network": ("network", {}),
        "sensor": ("sensor", {"description": text, "encoding_type": F.lit("text/plain"), "sensor_metadata": F.lit("")}),
        "feature_of_interest": ("foi", {"description": text, "encoding_type": F.lit("application/vnd.geo+json"), "feature": F.col("place")}),
        "observed_property": ("property", {"description": F.col("property"), "definition": F.col("definition")}),
        "datastream": ("stream", {
            "description": text, "observation_type": F.lit(MEASUREMENT), "unit_of_measurement": F.col("unit_of_measurement"),
            "thing_id": F.lit(thing_id).cast("long"), "sensor": F.col("sensor"), "property": F.col("property")}),
    }
    found, made = identity.get_or_create_all(
        {t: sure.groupBy(F.col(n).alias("name")).agg(F.min_by(F.struct(F.lit(0).alias("_"), *[c.alias(k) for k, c in cols.items()]), order).alias("_row"))
         for t, (n, cols) in asked.items()},
        {t: catalog.table(t) for t in asked})

    def ids(table: str, column: str, name: str) -> DataFrame:
        return found.where(F.col("table") == table).select(F.col("name").alias(column), F.col("id").alias(name))

    state = {}
    for table, (_, cols) in asked.items():
        fresh = made[table].select("id", "name", *[F.col(f"_row.{k}").alias(k) for k in cols])
        if table == "datastream":
            fresh = (
                fresh.join(ids("sensor", "sensor", "sensor_id"), "sensor", "left")
                .join(ids("observed_property", "property", "observed_property_id"), "property", "left")
                .withColumn("network", F.lit(network)).join(ids("network", "network", "network_id"), "network", "left")
                .drop("sensor", "property", "network"))
        state[table] = catalog.table(table).unionByName(fresh, allowMissingColumns=True)
    streams, features = ids("datastream", "name", "id"), ids("feature_of_interest", "name", "id")
    ready = (
        sure.join(streams.select(F.col("name").alias("stream"), F.col("id").alias("datastream_id")), "stream", "left")
        .join(features.select(F.col("name").alias("foi"), F.col("id").alias("feature_of_interest_id")), "foi", "left")
        .withColumns({"result_time": F.col("phenomenon_start"), "phenomenon_end": F.col("phenomenon_start"),
                      **values.typed_text_result(F.col("value"))}))
    reason = F.when(F.col("datastream_id").isNull() | F.col("feature_of_interest_id").isNull(), "name held twice").when(
        F.col("result_type").isNull(), "result has no type")
    judged = ready.withColumn("reason", reason)
    good = judged.where("reason is null").drop("reason")
    after, inserted, late = mutations.insert_observations(
        catalog.replace(**state), _observation_rows(good, ["source_id", "attribute", "phenomenon_start"]))
    refused = judged.where("reason is not null").select("source_id", "attribute", "reason")
    return after, inserted, refused.unionByName(late.select(F.col("seq.source_id"), F.col("seq.attribute"), "reason"))
