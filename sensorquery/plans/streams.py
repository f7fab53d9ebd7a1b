"""Queries that run the streaming operators to the end of files written from the given tables."""

from __future__ import annotations

import json

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorquery.operators import maintain
from sensorquery.plans.changes import bare_streams
from sensorquery.plans.ingest import message_rows
from sensorquery.plans.registry import query
from sensorquery.session import scratch_path, ship_functions
from sensorquery.sources import message_log, sinks
from sensorquery.streaming import keyed, messages, state

ship_functions(__name__)

us = F.unix_micros


def stream_of(t, rows: DataFrame, files_per_batch: int | None = 1) -> DataFrame:
    """A file stream over rows, written as a few files spread over time."""
    path = scratch_path(t.spark, "stream")
    rows.write.parquet(path)
    reader = t.spark.readStream.schema(rows.schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def readings(t) -> DataFrame:
    wanted = ["id", "datastream_id", "phenomenon_start", "phenomenon_end", "result_time", "result_number"]
    return t.observations("intervals").select(*wanted).repartitionByRange(4, "phenomenon_start")


def drain(run) -> None:
    """Waits for the end of an available-now run and raises its failure."""
    run.awaitTermination()
    if run.exception() is not None:
        raise run.exception()


class Parts:
    """Batch results as one folder per batch number; writing a batch again replaces it."""

    def __init__(self, t, label: str):
        self.spark, self.path = t.spark, scratch_path(t.spark, label)
        self.checkpoint = scratch_path(t.spark, f"{label}-state")
        self.last = -1

    def write(self, batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{self.path}/part={number}")
        self.last = number

    def read(self, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self.path)

    def part(self, number: int, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/part={number}")


LOG_ROWS = 100_000  # of one written log
STREAM_MAPPING = {"site/+/click": ["Skip", "click"], "site/8/error": ["error"], "site/+/view": ["view", "skip", "signup"]}


@query("stm_01_message_ingest", """
SELECT datastream_id, epoch_us(ts) AS t_us, result_number FROM (
  SELECT ts, 0 AS datastream_id, CAST(event_id AS DOUBLE) AS result_number FROM events
  WHERE event_type = 'click' AND event_id % 13 <> 0 AND event_id % 17 <> 0
  UNION ALL
  SELECT ts, CASE event_type WHEN 'view' THEN 4 ELSE 1 END, CASE WHEN event_id % 5 = 0 THEN -999.0 ELSE value END FROM events
  WHERE (event_type = 'view' OR (event_type = 'error' AND user_id = 8)) AND event_id % 13 <> 0 AND event_id % 17 <> 0
    AND event_id % 5 <> 2)""")
def stm_01(t):
    stream = stream_of(t, message_rows(t).repartitionByRange(4, "event_id"))
    parts = Parts(t, "ingest")
    cfg = messages.MessageConfig(mapping=STREAM_MAPPING, separator=";")
    refused = Parts(t, "refused")
    drain(messages.start_ingest(
        stream, cfg, t.observed_properties(), parts.write, parts.checkpoint, rejects=refused.write, once=True))
    rows = parts.read("datastream_id long, phenomenon_start timestamp, result_number double, result_quality string")
    return rows.select("datastream_id", us("phenomenon_start").alias("t_us"), "result_number")


@query("stm_01_rejects", """
WITH m AS (SELECT *, CASE WHEN event_type NOT IN ('click', 'view') AND NOT (event_type = 'error' AND user_id = 8) THEN 'no mapping'
  WHEN event_id % 13 = 0 THEN 'bad payload' WHEN event_id % 17 = 0 THEN 'bad time' END AS whole FROM events)
SELECT whole AS reason, CAST(NULL AS VARCHAR) AS name, count(*) AS n FROM m WHERE whole IS NOT NULL GROUP BY 1
UNION ALL SELECT 'not a number', event_type, count(*) FROM m WHERE whole IS NULL AND event_id % 5 = 2 AND event_type IN ('view', 'error') GROUP BY 2
UNION ALL SELECT 'name is missing', 'nobody', count(*) FROM m WHERE whole IS NULL AND event_type = 'click' GROUP BY event_type""")
def stm_01_rejects(t):
    stream = stream_of(t, message_rows(t).repartitionByRange(4, "event_id"))
    loaded, refused = Parts(t, "ingest"), Parts(t, "refused")
    cfg = messages.MessageConfig(mapping=STREAM_MAPPING | {"site/+/click": ["skip", "nobody"]}, separator=";")
    drain(messages.start_ingest(
        stream, cfg, t.observed_properties(), loaded.write, loaded.checkpoint, rejects=refused.write, once=True))
    rows = refused.read("topic string, payload string, name string, raw string, reason string")
    return rows.groupBy("reason", "name").agg(F.count("*").alias("n"))


def _append_logs(folder: str, cut: int, whole: bool):
    """Appends the messages of a task to its log, a file per partition. ``whole``: the last line ends."""

    def run(batches):
        part = TaskContext.get().partitionId()
        store, inner = message_log._store(folder)
        store.create_dir(inner)
        lines = [json.dumps({"topic": t, "payload": p}) for b in batches for t, p in zip(b["topic"], b["payload"])]
        path, half = f"{inner}/{part}.log", len(lines) * cut // 4
        with store.open_output_stream(path) as out:
            for line in lines[:half]:
                out.write(f"{line}\n".encode())
            # A writer that is in the middle of a line: the reader must wait for its end.
            out.write(b"" if whole or half == len(lines) else lines[half][:5].encode())
        yield pd.DataFrame({"n": [half]})

    return run


@query("src_08_message_log", """
SELECT datastream_id, epoch_us(ts) AS t_us, result_number FROM (
  SELECT ts, 0 AS datastream_id, CAST(event_id AS DOUBLE) AS result_number FROM events
  WHERE event_type = 'click' AND event_id % 13 <> 0 AND event_id % 17 <> 0
  UNION ALL
  SELECT ts, CASE event_type WHEN 'view' THEN 4 ELSE 1 END, CASE WHEN event_id % 5 = 0 THEN -999.0 ELSE value END FROM events
  WHERE (event_type = 'view' OR (event_type = 'error' AND user_id = 8)) AND event_id % 13 <> 0 AND event_id % 17 <> 0
    AND event_id % 5 <> 2)""")
def src_08_log(t):
    """Logs that grow between three runs of the ingest, which goes on from its checkpoint each time."""
    folder = scratch_path(t.spark, "logs")
    rows = message_rows(t).select("topic", F.col("payload").cast("string").alias("payload"))
    logs = max(3, t.raw("events").count() // LOG_ROWS)  # a task holds the lines of one log
    rows = rows.repartition(logs, "payload").sortWithinPartitions("payload", "topic")
    loaded, refused = Parts(t, "ingest"), Parts(t, "refused")
    cfg = messages.MessageConfig(mapping=STREAM_MAPPING, separator=";")
    for cut in (1, 3, 4):
        rows.mapInPandas(_append_logs(folder, cut, cut == 4), "n long").agg(F.sum("n")).collect()  # writes them
        drain(messages.start_ingest(
            message_log.read_log(t.spark, folder), cfg, t.observed_properties(), loaded.write, loaded.checkpoint,
            rejects=refused.write, once=True))
    got = loaded.read("datastream_id long, phenomenon_start timestamp, result_number double, result_quality string")
    return got.select("datastream_id", us("phenomenon_start").alias("t_us"), "result_number")


@query("stm_02_unique", """
SELECT DISTINCT datastream_id, epoch_us(phenomenon_start) AS lo, epoch_us(phenomenon_end) AS hi FROM observation""")
def stm_02(t):
    parts = Parts(t, "unique")
    # A delivery repeats readings of the one before it, at most two quarters of the whole time back.
    rows = deliver(t, parts, parts.write, lambda stream: state.dedup_stream(stream, "16 days"))
    return rows.select("datastream_id", us("phenomenon_start").alias("lo"), us("phenomenon_end").alias("hi"))


@query("stm_03_running_extents", """
SELECT datastream_id, epoch_us(min(phenomenon_start)) AS lo, epoch_us(max(interval_end)) AS hi, epoch_us(max(result_time)) AS result_hi
FROM observation GROUP BY datastream_id""")
def stm_03(t):
    parts = Parts(t, "extents")
    drain(state.run_batches(state.stream_extents(stream_of(t, readings(t))), parts.write, parts.checkpoint, mode="update"))
    rows = parts.read("datastream_id long, phenomenon_start timestamp, phenomenon_end timestamp, result_start timestamp, result_end timestamp, part int")
    last = rows.groupBy("datastream_id").agg(F.max_by(F.struct("phenomenon_start", "phenomenon_end", "result_end"), "part").alias("e"))
    return last.select(
        "datastream_id", us("e.phenomenon_start").alias("lo"), us("e.phenomenon_end").alias("hi"), us("e.result_end").alias("result_hi")
    )


@query("stm_04_latest", """
SELECT datastream_id, epoch_us(max(phenomenon_start)) AS t_us, arg_max(result_number, (phenomenon_start, id)) AS result_number
FROM observation GROUP BY datastream_id""")
def stm_04(t):
    parts = Parts(t, "latest")
    drain(state.run_batches(state.latest(stream_of(t, readings(t))), parts.write, parts.checkpoint, mode="update"))
    rows = parts.read("datastream_id long, phenomenon_start timestamp, result_number double, part int")
    last = rows.groupBy("datastream_id").agg(F.max_by(F.struct("phenomenon_start", "result_number"), "part").alias("e"))
    return last.select("datastream_id", us("e.phenomenon_start").alias("t_us"), F.col("e.result_number").alias("result_number"))


@query("stm_04_latest_n", """
SELECT datastream_id, id FROM (SELECT datastream_id, id, row_number() OVER (PARTITION BY datastream_id ORDER BY phenomenon_start DESC, id) AS rn
FROM observation) WHERE rn <= 3""")
def stm_04_n(t):
    parts = Parts(t, "latest-n")
    layout = readings(t).schema
    # Every delivery is a run of its own that goes on from the state of the last.
    lists = deliver(t, parts, parts.write, lambda stream: keyed.latest_lists(stream, 3), mode="update",
                    layout="datastream_id long, salt int, doc string, part int")
    return keyed.latest_of(lists, 3, layout).select("datastream_id", "id")


@query("stm_04_latest_n_stored", """
SELECT datastream_id, id FROM (SELECT datastream_id, id, row_number() OVER (PARTITION BY datastream_id ORDER BY phenomenon_start DESC, id) AS rn
FROM observation WHERE datastream_id IN (SELECT DISTINCT datastream_id FROM observation WHERE id % 4 = 1)) WHERE rn <= 2""")
def stm_04_n_stored(t):
    """Readings that are stored already are the initial state; lists come out for touched datastreams."""
    rows = readings(t)
    parts = Parts(t, "latest-stored")
    lists = keyed.latest_lists(
        stream_of(t, rows.where("id % 4 = 1")), 2, stored=rows.where("id % 4 <> 1"), salts=1)
    drain(state.run_batches(lists, parts.write, parts.checkpoint, mode="update"))
    return keyed.latest_of(parts.read("datastream_id long, salt int, doc string, part int"), 2, rows.schema).select("datastream_id", "id")


def deliveries(t):
    """Four deliveries of readings in the order of time; each but the first repeats a part of the one
    before it, so readings come late and twice."""
    rows = t.observations().select("id", "datastream_id", "phenomenon_start", "phenomenon_end", "result_time", "result_number")
    span = rows.agg(F.min(us("phenomenon_start")).alias("lo"), F.max(us("phenomenon_start")).alias("hi")).first()
    width = ((span["hi"] or 0) - (span["lo"] or 0)) // 4 + 1
    cut = F.floor((us("phenomenon_start") - F.lit(span["lo"] or 0)) / F.lit(width))
    return rows, [rows.where((cut == k) | ((cut == k - 1) & (F.col("id") % 3 == 0))) for k in range(4)]


def deliver(t, parts: Parts, write, through=lambda stream: stream, mode="append", layout=None) -> DataFrame:
    """Runs the stream anew after each delivery; every run goes on from the checkpoint of the last."""
    rows, batches = deliveries(t)
    path = scratch_path(t.spark, "deliveries")
    for batch in batches:
        batch.write.mode("append").parquet(path)
        stream = t.spark.readStream.schema(rows.schema).parquet(path)
        drain(state.run_batches(through(stream), write, parts.checkpoint, mode=mode))
    return parts.read(layout or rows.schema)


@query("stm_05_late_data", """
SELECT min(o.id) AS id FROM observation o LEFT JOIN (SELECT datastream_id, max(phenomenon_start) AS e FROM observation
  WHERE phenomenon_start < TIMESTAMP '2024-01-08' GROUP BY 1) s ON s.datastream_id = o.datastream_id
WHERE s.e IS NULL OR o.phenomenon_start > s.e GROUP BY o.datastream_id, o.phenomenon_start""")
def stm_05(t):
    early = t.observations().where(F.col("phenomenon_start") < F.lit("2024-01-08T00:00:00Z").cast("timestamp"))
    streams = maintain.merge_extents(bare_streams(t), early)
    parts = Parts(t, "late")
    return deliver(t, parts, parts.write, lambda stream: keyed.newer_readings(stream, streams)).select("id")


@query("stm_05_stored_duplicates", """
SELECT min(id) AS id FROM observation o WHERE NOT EXISTS (SELECT 1 FROM observation s WHERE s.id % 10 < 7
  AND s.datastream_id = o.datastream_id AND s.phenomenon_start = o.phenomenon_start) GROUP BY datastream_id, phenomenon_start""")
def stm_05_stored(t):
    path = scratch_path(t.spark, "stored")
    sinks.write_observations(t.observations().where(F.col("id") % 10 < 7), path)
    stored = t.spark.read.schema("datastream_id long, phenomenon_start timestamp, chunk date").parquet(path)
    parts = Parts(t, "missing")
    write = state.missing_per_batch(t.spark, stored, parts.write, scratch_path(t.spark, "keys"))
    return deliver(t, parts, write).select("id")
