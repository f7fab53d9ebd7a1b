"""Metadata sheet rows to entity rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorquery.functions import geometry, values

OBSERVATION_TYPE = "http://www.opengis.net/def/observationType/OGC-OM/2.0/OM_Measurement"


def _clean(df: DataFrame, name: str) -> Column:
    """Trimmed cell; blank or absent cells are null."""
    if name not in df.columns:
        return F.lit(None).cast("string")
    text = F.trim(F.col(name).cast("string"))
    return F.when(text != "", text)


def _json(cell: Column) -> Column:
    return F.to_json(F.try_parse_json(cell))


def metadata_from_rows(df: DataFrame) -> dict[str, DataFrame]:
    """Rows of a metadata sheet as Thing, Location, Sensor, ObservedProperty, Network and Datastream
    rows, related by name. Comma lists pair by position and the last value repeats."""
    c = {
        name: _clean(df, name)
        for name in (
            "thing_name", "thing_description", "thing_properties", "location_name",
            "location_description", "location_coordinates", "location_epsg", "sensor_name",
            "sensor_description", "sensor_metadata", "sensor_encoding_type", "model_number", "brand",
            "type", "serial_number", "transmission_serial_number", "cable_length",
            "observed_property_name", "observed_property_description",
            "observed_property_definition", "observed_property_properties", "datastream_name",
            "datastream_description", "datastream_uom", "datastream_begin", "network_name",
            "sampling_frequency", "acquisition_frequency", "constraint_1", "constraint_2", "constraint_3",
        )
    }
    filled = df.where(c["thing_name"].isNotNull() | c["sensor_name"].isNotNull())
    xy = values.parse_coordinates(c["location_coordinates"])
    blank = F.lit("")
    locations = filled.select(
        c["location_name"].alias("name"), F.coalesce(c["location_description"], blank).alias("description"),
        F.lit("application/json").alias("encoding_type"),
        geometry.point(F.get(xy, F.lit(0)), F.get(xy, F.lit(1))).alias("location"),
        c["location_epsg"].alias("epsg"),
    )
    things = filled.select(
        c["thing_name"].alias("name"), F.coalesce(c["thing_description"], blank).alias("description"),
        _json(c["thing_properties"]).alias("properties"), c["location_name"].alias("location_name"),
    )
    described = values.properties_json(
        modelNumber=c["model_number"], brand=c["brand"], type=c["type"], serialNumber=c["serial_number"],
        transmissionSerialNumber=c["transmission_serial_number"], cableLength=c["cable_length"],
    )
    manual = F.concat(F.lit("http://example.org/"), c["model_number"], F.lit(".pdf"))
    sensors = filled.select(
        c["sensor_name"].alias("name"), F.coalesce(c["sensor_description"], blank).alias("description"),
        F.coalesce(c["sensor_encoding_type"], F.lit("application/pdf")).alias("encoding_type"),
        F.coalesce(c["sensor_metadata"], manual).alias("sensor_metadata"), described.alias("properties"),
    )
    names = values.split_list(c["observed_property_name"])
    base = filled.select(
        c["thing_name"].alias("thing_name"), c["sensor_name"].alias("sensor_name"),
        F.explode(values.split_list(c["network_name"])).alias("network_name"), names.alias("_names"),
        values.split_list(c["observed_property_description"]).alias("_descriptions"),
        values.split_list(c["observed_property_definition"]).alias("_definitions"),
        values.split_list(c["datastream_name"]).alias("_datastreams"),
        values.split_list(c["datastream_description"]).alias("_texts"),
        values.split_list(c["datastream_uom"]).alias("_units"),
        _json(c["observed_property_properties"]).alias("_properties"),
        c["datastream_begin"].alias("_begin"),
        values.properties_json(
            samplingFrequency=c["sampling_frequency"], acquisitionFrequency=c["acquisition_frequency"],
            constraints=_constraints(c),
        ).alias("properties"),
    )
    paired = base.select("*", F.posexplode("_names").alias("i", "observed_property_name"))
    i = F.col("i")
    observed = paired.select(
        F.col("observed_property_name").alias("name"),
        values.list_value(F.col("_descriptions"), i, F.col("observed_property_name")).alias("description"),
        values.list_value(F.col("_definitions"), i).alias("definition"),
        F.col("_properties").alias("properties"),
    ).distinct()
    unit = values.list_value(F.col("_units"), i)
    datastreams = paired.select(
        values.list_value(F.col("_datastreams"), i, F.col("observed_property_name")).alias("name"),
        values.list_value(F.col("_texts"), i, blank).alias("description"),
        F.lit(OBSERVATION_TYPE).alias("observation_type"),
        F.struct(values.unit_name(unit).alias("name"), unit.alias("symbol")).alias("unit_of_measurement"),
        "properties", F.try_to_timestamp("_begin").alias("phenomenon_start"),
        "thing_name", "sensor_name", "observed_property_name", "network_name",
    )
    networks = paired.select(F.col("network_name").alias("name")).distinct()
    return {
        "thing": things, "location": locations, "sensor": sensors, "observed_property": observed,
        "network": networks, "datastream": datastreams,
    }


def _constraints(c: dict[str, Column]) -> Column:
    cells = F.array_compact(F.array(*[_json(c[f"constraint_{n}"]) for n in (1, 2, 3)]))
    return F.when(F.size(cells) > 0, F.transform(cells, lambda x: F.try_parse_json(x)))
