"""Sensor-observation analytics as Spark DataFrame and Structured Streaming operators."""

from sensorquery.catalog import Catalog
from sensorquery.operators.query import Expand, Query

__all__ = ["Catalog", "Expand", "Query"]
