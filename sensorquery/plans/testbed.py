"""The sensor data model over the given parquet tables, for Spark and as SQL definitions.

Customers are things, nations are locations and features, suppliers are sensors, regions are
networks, events are observations and orders are historical locations, commits and versions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorquery.catalog import Catalog
from sensorquery.functions import geometry
from sensorquery.session import configure

# Schemas of the given tables; times are read as UTC instants.
RAW = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": (
        "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    ),
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": (
        "p_partkey long, p_name string, p_brand string, p_type string, p_size int, "
        "p_retailprice double"
    ),
    "orders": (
        "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
        "l_linestatus string, l_shipdate timestamp"
    ),
    "events": (
        "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    ),
}

# Observed property of each event type.
PROPERTY_IDS = {"click": 0, "error": 1, "purchase": 2, "signup": 3, "view": 4}
BASE = "http://localhost/v1.1"
VERSION_START = "1995-01-01T00:00:00Z"


def property_id(event_type: Column) -> Column:
    pairs = [F.lit(x) for name, key in PROPERTY_IDS.items() for x in (name, key)]
    return F.create_map(*pairs)[event_type].cast("long")


def minutes(n: Column) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), n.cast("int"))


class Testbed:
    """Model tables derived from the given tables of one folder."""

    __test__ = False

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = configure(spark)
        self.folder = folder

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.schema(RAW[name]).parquet(f"{self.folder}/{name}.parquet")

    def catalog(self, kind: str = "instants", versioned: bool = False) -> Catalog:
        """``kind`` of observations: instants, intervals or mixed result types."""
        tables = {
            "network": self.networks, "location": self.locations, "thing": self.things,
            "thing_location": self.thing_locations, "historical_location": self.historical_locations,
            "location_historical_location": self.location_links, "sensor": self.sensors,
            "observed_property": self.observed_properties, "datastream": self.datastreams,
            "feature_of_interest": self.features, "observation": lambda: self.observations(kind),
            "commit_log": self.commits,
        }
        if versioned:
            tables["thing"] = self.thing_versions
        return Catalog(self.spark, tables)

    def networks(self) -> DataFrame:
        return self.raw("region").select(F.col("r_regionkey").cast("long").alias("id"), F.col("r_name").alias("name"))

    def _places(self, geometry_name: str) -> DataFrame:
        key = F.col("n_nationkey").cast("long")
        lon, lat = -170 + 14 * key, (37 * key) % 160 - 80
        return self.raw("nation").select(
            key.alias("id"), F.col("n_name").alias("name"), F.lit("place").alias("description"),
            F.lit("application/geo+json").alias("encoding_type"),
            geometry.point(lon, lat).alias(geometry_name),
            F.concat(F.lit('{"region":'), F.col("n_regionkey").cast("string"), F.lit("}")).alias("properties"),
        )

    def locations(self) -> DataFrame:
        places = self._places("location")
        return places.withColumn("gen_foi_id", F.when(F.col("id") % 2 == 0, F.col("id")))

    def features(self) -> DataFrame:
        return self._places("feature")

    def things(self) -> DataFrame:
        return self.raw("customer").select(
            F.col("c_custkey").alias("id"), F.col("c_name").alias("name"),
            F.concat(F.lit("customer "), F.col("c_custkey").cast("string")).alias("description"),
            F.concat(
                F.lit('{"segment":"'), F.col("c_mktsegment"), F.lit('","nation":{"key":'),
                F.col("c_nationkey").cast("string"), F.lit("}}"),
            ).alias("properties"),
        )

    def thing_locations(self) -> DataFrame:
        key, nation = F.col("c_custkey"), F.col("c_nationkey").cast("long")
        homes = F.when(key % 3 == 0, F.array(nation, (nation + 1) % 25)).otherwise(F.array(nation))
        return self.raw("customer").select(key.alias("thing_id"), F.explode(homes).alias("location_id"))

    def historical_locations(self) -> DataFrame:
        return self.raw("orders").select(
            F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("time"),
            F.col("o_custkey").alias("thing_id"),
        )

    def location_links(self) -> DataFrame:
        return self.raw("orders").select(
            (F.col("o_orderkey") % 25).alias("location_id"),
            F.col("o_orderkey").alias("historical_location_id"),
        )

    def sensors(self) -> DataFrame:
        return self.raw("supplier").select(
            F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"),
            F.lit("supplier").alias("description"), F.lit("application/pdf").alias("encoding_type"),
            F.concat(F.lit("nation "), F.col("s_nationkey").cast("string")).alias("sensor_metadata"),
            F.lit(None).cast("string").alias("properties"),
        )

    def observed_properties(self) -> DataFrame:
        kinds = self.raw("events").select("event_type").distinct()
        return kinds.select(
            property_id(F.col("event_type")).alias("id"), F.col("event_type").alias("name"),
            F.concat(F.lit("http://example.org/"), F.col("event_type")).alias("definition"),
            F.upper("event_type").alias("description"), F.lit(None).cast("string").alias("properties"),
        )

    def datastreams(self) -> DataFrame:
        """One per (user, event type) with its extents."""
        extent = self.observations("intervals").groupBy(
            F.col("datastream_id").alias("id"), "user_id", "event_type"
        ).agg(
            F.min("phenomenon_start").alias("phenomenon_start"),
            F.max("phenomenon_end").alias("phenomenon_end"),
            F.min("result_time").alias("result_start"), F.max("result_time").alias("result_end"),
        )
        no_area = F.lit(None).cast(
            "struct<type:string,coords:array<array<array<double>>>,"
            "xmin:double,ymin:double,xmax:double,ymax:double>"
        )
        return extent.select(
            "id", F.concat(F.lit("ds-"), F.col("id").cast("string")).alias("name"),
            F.col("event_type").alias("description"),
            F.struct(
                F.col("event_type").alias("name"), F.substring("event_type", 1, 2).alias("symbol"),
                F.lit(None).cast("string").alias("definition"),
            ).alias("unit_of_measurement"),
            F.lit("measurement").alias("observation_type"), no_area.alias("observed_area"),
            "phenomenon_start", "phenomenon_end", "result_start", "result_end",
            F.lit(None).cast("string").alias("properties"), F.col("user_id").alias("thing_id"),
            (F.col("user_id") % 10).alias("sensor_id"),
            property_id(F.col("event_type")).alias("observed_property_id"),
            (F.col("user_id") % 5).alias("network_id"), F.lit(None).cast("long").alias("last_foi_id"),
        )

    def observations(self, kind: str = "instants") -> DataFrame:
        """Events as observations, with ``user_id`` and ``event_type`` kept beside."""
        key, ts, value = F.col("event_id"), F.col("ts"), F.col("value")
        end = ts + minutes(key % 4) if kind == "intervals" else ts
        mixed = kind == "mixed"
        tag = (key % 4).cast("int") if mixed else F.lit(0)
        number = F.when(tag == 0, value) if mixed else value
        boolean = F.when(tag == 1, value > 50)
        text = F.when(tag == 3, F.col("event_type")).when(tag == 1, (value > 50).cast("string"))
        return self.raw("events").select(
            key.alias("id"), ts.alias("phenomenon_start"), end.alias("phenomenon_end"),
            F.when(key % 5 != 0, ts + minutes(key % 3)).alias("result_time"),
            tag.alias("result_type"), (text if mixed else F.lit(None).cast("string")).alias("result_string"),
            number.alias("result_number"), boolean.alias("result_boolean"),
            F.when(tag == 2, F.col("props")).alias("result_json"),
            F.when(key % 7 == 0, "90").otherwise("100").alias("result_quality"),
            F.when(key % 2 == 0, ts).alias("valid_start"),
            F.when(key % 2 == 0, ts + minutes(F.lit(60))).alias("valid_end"),
            F.col("props").alias("parameters"),
            (F.col("user_id") * 5 + property_id(F.col("event_type"))).alias("datastream_id"),
            (F.col("user_id") % 25).alias("feature_of_interest_id"), "user_id", "event_type",
        )

    def commits(self) -> DataFrame:
        action = F.when(F.col("o_orderstatus") == "F", "CREATE").when(
            F.col("o_orderstatus") == "O", "UPDATE"
        ).otherwise("DELETE")
        return self.raw("orders").select(
            F.col("o_orderkey").alias("id"),
            F.concat(F.lit("clerk-"), (F.col("o_custkey") % 10).cast("string")).alias("author"),
            F.lit("text/plain").alias("encoding_type"), F.col("o_orderpriority").alias("message"),
            F.col("o_orderdate").alias("date"), action.alias("action_type"),
        )

    def thing_changes(self) -> DataFrame:
        """Order history of each customer as a change feed."""
        return self.raw("orders").select(
            F.col("o_custkey").alias("id"), F.col("o_orderdate").alias("ts"),
            F.col("o_orderkey").alias("seq"),
            F.concat(F.lit("thing-"), F.col("o_custkey").cast("string")).alias("name"),
            F.col("o_orderstatus").alias("description"), F.col("o_orderpriority").alias("properties"),
            F.col("o_orderkey").alias("commit_id"),
        )

    def thing_versions(self) -> DataFrame:
        from sensorquery.operators.versions import to_versions

        return to_versions(self.thing_changes())


# The same tables as SQL definitions.
MODEL_SQL = """
network AS (SELECT CAST(r_regionkey AS BIGINT) AS id, r_name AS name FROM region),
place AS (
  SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name,
         CAST(-170 + 14 * n_nationkey AS DOUBLE) AS lon,
         CAST((37 * n_nationkey) % 160 - 80 AS DOUBLE) AS lat, n_regionkey,
         CASE WHEN n_nationkey % 2 = 0 THEN CAST(n_nationkey AS BIGINT) END AS gen_foi_id
  FROM nation),
thing AS (
  SELECT c_custkey AS id, c_name AS name, 'customer ' || c_custkey AS description,
         '{"segment":"' || c_mktsegment || '","nation":{"key":' || c_nationkey || '}}' AS properties,
         c_mktsegment AS segment, c_nationkey AS nation_key
  FROM customer),
thing_location AS (
  SELECT c_custkey AS thing_id, CAST(c_nationkey AS BIGINT) AS location_id FROM customer
  UNION ALL
  SELECT c_custkey, CAST((c_nationkey + 1) % 25 AS BIGINT) FROM customer WHERE c_custkey % 3 = 0),
historical_location AS (
  SELECT o_orderkey AS id, o_orderdate AS time, o_custkey AS thing_id, o_orderkey % 25 AS location_id
  FROM orders),
sensor AS (
  SELECT s_suppkey AS id, s_name AS name, 'nation ' || s_nationkey AS sensor_metadata FROM supplier),
observation AS (
  SELECT event_id AS id, ts AS phenomenon_start, ts AS phenomenon_end,
         ts + to_minutes(event_id % 4) AS interval_end,
         CASE WHEN event_id % 5 <> 0 THEN ts + to_minutes(event_id % 3) END AS result_time,
         event_id % 4 AS mixed_type, value AS result_number,
         CASE WHEN event_id % 7 = 0 THEN '90' ELSE '100' END AS result_quality,
         CASE WHEN event_id % 2 = 0 THEN ts END AS valid_start,
         CASE WHEN event_id % 2 = 0 THEN ts + to_minutes(60) END AS valid_end,
         props AS parameters, user_id, event_type,
         user_id * 5 + CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1
           WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS datastream_id,
         user_id % 25 AS feature_of_interest_id
  FROM events),
observed_property AS (
  SELECT DISTINCT datastream_id % 5 AS id, event_type AS name FROM observation),
datastream AS (
  SELECT datastream_id AS id, 'ds-' || datastream_id AS name, event_type AS description,
         substr(event_type, 1, 2) AS symbol, user_id AS thing_id, user_id % 10 AS sensor_id,
         datastream_id % 5 AS observed_property_id, user_id % 5 AS network_id,
         min(phenomenon_start) AS phenomenon_start, max(interval_end) AS phenomenon_end,
         min(result_time) AS result_start, max(result_time) AS result_end
  FROM observation GROUP BY datastream_id, event_type, user_id),
commit_log AS (
  SELECT o_orderkey AS id, 'clerk-' || (o_custkey % 10) AS author, o_orderpriority AS message,
         o_orderdate AS date,
         CASE o_orderstatus WHEN 'F' THEN 'CREATE' WHEN 'O' THEN 'UPDATE' ELSE 'DELETE' END AS action_type
  FROM orders),
thing_change AS (
  SELECT o_custkey AS id, o_orderdate AS ts, o_orderkey AS seq, o_orderstatus AS description,
         o_orderpriority AS properties, o_orderkey AS commit_id
  FROM orders),
thing_version AS (
  SELECT id, description, properties, commit_id, ts AS valid_from, valid_to
  FROM (SELECT *, lead(ts) OVER (PARTITION BY id ORDER BY ts, seq) AS valid_to FROM thing_change)
  WHERE valid_to IS NULL OR valid_to > ts)
""".strip()
