"""Session settings and the shared scratch folder."""

from __future__ import annotations

import sys
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

# Runtime settings every job of this library expects. Times are UTC; adaptive execution sizes the
# shuffle partitions and splits skewed join partitions even where that costs one more shuffle. Shuffles
# start from many partitions, which adaptive execution joins up to the advised size: what one task sorts
# is bounded by that size and not by the input.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "1000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def ship_functions(module: str) -> None:
    """Sends the Python functions of a module to the executors by value, so that they run where the
    package is not installed."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where that is unset, one beside the tables of the
    warehouse, if that is configured to lie in a store of the cluster; a session on one machine takes
    the warehouse as it is. Never a temporary folder of one machine: a cluster without either is told so."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        local = spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"
        given = spark.sparkContext.getConf().contains("spark.sql.warehouse.dir")
        if not local and not given:
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = f"{warehouse}/_scratch"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


_USED: list[str] = []


def scratch_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    _USED.append(path)
    return path


def drop_scratch(spark: SparkSession) -> None:
    """Removes the scratch tables written so far, in whatever store they are. Results that were not
    yet collected or written read from them, so call it between jobs."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _USED:
        path = jvm.org.apache.hadoop.fs.Path(_USED.pop())
        path.getFileSystem(conf).delete(path, True)


def materialize(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: fixes row placement and cuts the lineage."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
