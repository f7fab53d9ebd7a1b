"""Rules over streams whose memory is keyed state: a batch reads and writes the buckets of the keys it
brings, no others.

State lives in the RocksDB store of the query's checkpoint, so a restart goes on where the last run
ended and a batch that is run again starts from the state before it. What is stored already enters as
initial state with the first batch. A call into Python costs milliseconds whatever it carries, so keys are
dealt to a fixed number of buckets by their hash, and one call takes a whole bucket; a checkpoint stays
with the number of buckets that it began with.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from sensorquery.operators import series
from sensorquery.session import ship_functions

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BUCKETS = 2048  # calls into Python of one batch at most
_TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


@contextmanager
def keyed_state(spark: SparkSession):
    """Queries started inside use the store that keyed state needs; the session's own setting returns after."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


class _Latest(StatefulProcessor):
    """The n latest readings of each datastream and salt of a bucket, one per time (of equal times the
    smallest id), as one value of equally long arrays."""

    COLUMNS = ["datastream_id", "salt", "t", "id", "doc"]

    def __init__(self, n: int):
        self.n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState(
            "latest", "datastream_id array<long>, salt array<int>, t array<long>, id array<long>, doc array<string>")

    def best(self, rows: pd.DataFrame) -> pd.DataFrame:
        ordered = rows.sort_values(self.COLUMNS[:4], ascending=[True, True, False, True], kind="stable")
        return ordered.drop_duplicates(["datastream_id", "salt", "t"]).groupby(["datastream_id", "salt"], sort=False).head(self.n)

    def merged(self, frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
        """The lists of the keys that came; those of the others stay as they are."""
        kept = self.kept.get()
        held = pd.DataFrame(dict(zip(self.COLUMNS, kept or [[]] * 5)))
        came = []
        for frame in frames:
            if frame.empty:  # a bucket that only the initial state brings
                continue
            came.append(frame[["datastream_id", "salt"]].drop_duplicates())
            held = self.best(pd.concat([held, frame[self.COLUMNS]]) if len(held) else frame[self.COLUMNS])
        if not came:
            return held.head(0)
        self.kept.update(tuple(held[c].tolist() for c in self.COLUMNS))
        return held.merge(pd.concat(came).drop_duplicates(), on=["datastream_id", "salt"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        lists = self.merged(rows)
        if len(lists):
            yield lists[["datastream_id", "salt", "doc"]]

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.merged(iter([initialState]))

    def close(self) -> None:
        pass


def _bucket(buckets: int, *key) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int").alias("_bucket")


def _salted(rows: DataFrame, salts: int, buckets: int) -> DataFrame:
    """Rows as (_bucket, datastream_id, salt, t, id, doc). The salt follows the time, so that readings of
    one time stay together while those of a crowded datastream are dealt to many tasks."""
    t = F.unix_micros("phenomenon_start")
    salted = rows.where("datastream_id is not null and phenomenon_start is not null").select(
        F.col("datastream_id").cast("long").alias("datastream_id"), F.pmod(F.xxhash64(t), F.lit(salts)).cast("int").alias("salt"),
        t.alias("t"), F.coalesce(F.col("id").cast("long"), F.lit((1 << 63) - 1)).alias("id"), F.struct(*rows.columns).alias("doc"))
    return salted.select(_bucket(buckets, "datastream_id", "salt"), *salted.columns)


def _as_json(rows: DataFrame) -> DataFrame:
    return rows.withColumn("doc", F.to_json("doc", _TIMES))


def latest_lists(
    stream: DataFrame, n: int, *, salts: int = 8, stored: DataFrame | None = None, buckets: int = BUCKETS
) -> DataFrame:
    """(datastream_id, salt, doc): after each batch, for the keys it touched only, the whole list of the
    ``n`` latest readings per datastream and salt, as JSON; for update mode. ``stored`` readings are the
    initial state, of which only the lists reach it. A list holds at most n readings, whatever the stream
    brings; a task holds the lists of one bucket."""
    first = None
    if stored is not None:
        key = ["_bucket", "datastream_id", "salt"]
        single = series.first_per_key(_salted(stored.select(*stream.columns), salts, buckets), [*key, "t"], ["id"])
        first = _as_json(series.top_per_key(single, key, [F.col("t").desc()], n).drop("rn")).groupBy("_bucket")
    return _as_json(_salted(stream, salts, buckets)).groupBy("_bucket").transformWithStateInPandas(
        _Latest(n), "datastream_id long, salt int, doc string", "update", "none", first)


def latest_of(lists: DataFrame, n: int, layout) -> DataFrame:
    """The ``n`` latest readings per datastream from the lists of all batches (with their number,
    ``part``): of each datastream and salt the last list counts."""
    last = lists.groupBy("datastream_id", "salt").agg(F.max("part").alias("part"))
    rows = lists.join(last, ["datastream_id", "salt", "part"]).select(F.from_json("doc", layout, _TIMES).alias("r")).select("r.*")
    return series.top_per_key(rows, ["datastream_id"], [F.col("phenomenon_start").desc(), F.col("id")], n).drop("rn")


class _Newer(StatefulProcessor):
    """Readings behind the end of their datastream, one per time; the ends move on with every batch. The
    ends of a bucket are one value of two arrays."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ends = handle.getValueState("ends", "datastream_id array<long>, end array<long>")

    def held(self) -> dict[int, int]:
        ends = self.ends.get()
        return dict(zip(*ends)) if ends else {}

    def moved(self, ends: dict[int, int], moves: pd.Series) -> None:
        ends.update((int(d), int(e)) for d, e in moves.items())
        self.ends.update((list(ends), list(ends.values())))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        ends = self.held()
        fresh = None
        for frame in rows:
            if frame.empty:  # a bucket that only the initial state brings
                continue
            known = [ends.get(d) for d in frame["datastream_id"].tolist()]
            later = frame[[e is None or s > e for s, e in zip(frame["start_us"].tolist(), known)]]
            both = later if fresh is None else pd.concat([fresh, later])
            fresh = both.sort_values("id", kind="stable").drop_duplicates(["datastream_id", "start_us"])
        if fresh is not None and len(fresh):
            self.moved(ends, fresh.groupby("datastream_id")["end_us"].max())
            yield fresh.drop(columns=["_bucket", "start_us", "end_us"], errors="ignore")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        ends = self.held()
        given = initialState.dropna(subset=["end"]).groupby("datastream_id")["end"].max()
        if len(given):
            self.moved(ends, given)

    def close(self) -> None:
        pass


def newer_readings(stream: DataFrame, datastreams: DataFrame, *, buckets: int = BUCKETS) -> DataFrame:
    """The late-data rule over a stream: only readings that start after the end of their datastream as it
    was before the batch, one per time (the smallest id). ``datastreams`` (id, phenomenon_end) is the
    initial state. A task holds the ends and the accepted readings of one bucket of one batch, which the
    trigger bounds (``maxFilesPerTrigger``)."""
    own = _bucket(buckets, F.col("datastream_id").cast("long"))
    ends = datastreams.where("id is not null and phenomenon_end is not null").groupBy(
        F.col("id").cast("long").alias("datastream_id")).agg(F.max(F.unix_micros("phenomenon_end")).alias("end"))
    start = F.unix_micros("phenomenon_start")
    end = F.coalesce(F.unix_micros("phenomenon_end"), start) if "phenomenon_end" in stream.columns else start
    timed = stream.where("datastream_id is not null and phenomenon_start is not null").withColumns({"start_us": start, "end_us": end})
    return timed.select(own, *timed.columns).groupBy("_bucket").transformWithStateInPandas(
        _Newer(), stream.schema, "append", "none", ends.select(own, *ends.columns).groupBy("_bucket"))


ship_functions(__name__)
