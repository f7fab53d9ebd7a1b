"""Running state over observation streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sensorquery.catalog import chunk_start
from sensorquery.operators import loading, maintain
from sensorquery.streaming.keyed import keyed_state

UNIQUE_KEY = ["datastream_id", "phenomenon_start", "phenomenon_end"]


def dedup_stream(stream: DataFrame, delay: str) -> DataFrame:
    """One reading per datastream, start and end among readings at most ``delay`` apart.

    State is bounded by the watermark; older duplicates are caught against the stored table by
    ``append_missing``.
    """
    return stream.withWatermark("phenomenon_start", delay).dropDuplicatesWithinWatermark(UNIQUE_KEY)


def stream_extents(stream: DataFrame) -> DataFrame:
    """Running time extents per datastream; for update mode."""
    return maintain.extents(stream)


def latest(stream: DataFrame) -> DataFrame:
    """Latest reading per datastream; of readings at one time the highest id counts."""
    rank = F.struct("phenomenon_start", "id")
    return stream.groupBy("datastream_id").agg(
        F.max("phenomenon_start").alias("phenomenon_start"),
        F.max_by("result_number", rank).alias("result_number"),
    )


def run_batches(
    stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, *,
    mode: str = "append", once: bool = True,
) -> StreamingQuery:
    """Hands every micro-batch to ``write`` with its number. Aggregates run in mode ``update``: a
    batch then holds the keys it changed."""
    writer = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint).foreachBatch(write)
    )
    with keyed_state(stream.sparkSession):
        return (writer.trigger(availableNow=True) if once else writer).start()


def missing_per_batch(
    spark: SparkSession, stored: DataFrame, write: Callable[[DataFrame, int], None], folder: str
) -> Callable[[DataFrame, int], None]:
    """Readings not yet stored over a stream: each batch also sees what earlier batches accepted.

    The keys that batch n accepted are ``folder/part=n``, laid out by time chunk; running a batch again
    replaces its part and looks at earlier parts only. Where ``stored`` has a ``chunk``, only the
    chunks of the batch are read, of it and of the parts.
    """
    own = [*loading.SERIES_KEY, *[c for c in ("chunk",) if c in stored.columns]]
    keys = stored.select(*own)

    def run(batch: DataFrame, number: int) -> None:
        held = keys
        if number > 0:
            layout = f"{keys._jdf.schema().toDDL()}, part INT"
            held = held.unionByName(spark.read.schema(layout).parquet(folder).where(F.col("part") < number).drop("part"))
        if "chunk" in own:
            # The chunks of a batch, some twelve for each year it spans, prune the scans.
            days = [r[0] for r in batch.select(chunk_start(F.col("phenomenon_start"))).distinct().collect()]
            held = held.where(F.col("chunk").isin([d for d in days if d is not None]))
        accepted = append_missing(batch, held)
        write(accepted, number)
        made = accepted.select(*loading.SERIES_KEY)
        if "chunk" in own:
            made = made.withColumn("chunk", chunk_start(F.col("phenomenon_start")))
            made.repartitionByRange("chunk").write.mode("overwrite").partitionBy("chunk").parquet(f"{folder}/part={number}")
        else:
            made.write.mode("overwrite").parquet(f"{folder}/part={number}")

    return run


def append_newer(batch: DataFrame, datastreams: DataFrame) -> DataFrame:
    """Late-data rule: only readings after the end of their datastream, one per time."""
    return loading.append_only(loading.dedup_first(batch, ["id"]), datastreams)


def append_missing(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """Readings of a batch that are not stored yet, one per time."""
    return loading.missing_only(loading.dedup_first(batch, ["id"]), stored)
