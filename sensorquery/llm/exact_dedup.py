"""Exact deduplication with disk-backed streaming state that never expires.

Texts are equal when identical after lower-casing A-Z. A stream of (digest, doc_id, locator) rows
feeds a stateful aggregation whose RocksDB state keeps, per digest, the row that stays, where its
content lies and how many rows there were; there is no watermark, so no state is ever dropped and a
later run on the same folder goes on where the last one ended. Copies combine in the map tasks before
they reach the state. A digest alone proves nothing: the full normalised texts of equal digests are
compared, and rows whose bytes differ are parted again. Where the state is kept for later runs, each
run also keeps one normalised text per digest that is new (``contents/run=n``, to which the locator of
its row points); a later run compares its texts with those of the digests that it hits.

Null texts count as empty, and empty texts equal each other. Of equal texts the row with the largest
``doc_id`` stays (a null id counts as the smallest; of repeated ids one row stays). An empty table
gives no rows. Extra columns are not looked at.
"""

from __future__ import annotations

import hashlib
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorquery.session import scratch_path, ship_functions

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_CONF = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # Many small stores: without this each reserves megabytes of disk before it holds a row.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
}
BYTES_PER_TRIGGER = 16 << 30  # digest rows of one micro-batch
ARRIVALS = "doc_id long, digest binary, sha binary, other binary, locator string, row_no long"
_STREAMED = f"{ARRIVALS}, run int"


@contextmanager
def _settings(spark: SparkSession):
    before = {k: spark.conf.get(k, None) for k in _CONF}
    try:
        for k, v in _CONF.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _normalised(column):
    """Lower-cases A-Z in UTF-8 and leaves every other byte alone; null is empty."""
    return [(v.as_buffer().to_pybytes() if v.is_valid else b"").lower() for v in column]


def _digest_rows(digest_bytes: int):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            body = _normalised(b.column(1))
            sha = [hashlib.sha256(x).digest() for x in body]
            other = [hashlib.blake2b(x, digest_size=32).digest() for x in body]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([x[:digest_bytes] for x in sha], pa.binary()), pa.array(sha, pa.binary()),
                 pa.array(other, pa.binary()), b.column(2)], ["doc_id", "digest", "sha", "other", "locator"])

    return run


def _bodies(digest_bytes: int):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            body = _normalised(b.column(1))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([hashlib.sha256(x).digest()[:digest_bytes] for x in body], pa.binary()),
                 pa.array(body, pa.binary())], ["doc_id", "digest", "body"])

    return run


def arrivals(docs: DataFrame, digest_bytes: int = 32) -> DataFrame:
    """One row per document: its id, digest and content locator (the file it was read from)."""
    own = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"),
        F.input_file_name().alias("locator"),
    )
    return own.mapInArrow(
        _digest_rows(digest_bytes), "doc_id long, digest binary, sha binary, other binary, locator string"
    ).withColumn("row_no", F.monotonically_increasing_id())


def advance_state(spark: SparkSession, arrived: str, state: str) -> DataFrame:
    """Streams all arrivals not yet seen into the state and returns the state:
    (digest, keep_id, keep_run, keep_row, keep_locator, group_size). ``arrived`` holds a folder ``run=n``
    per run."""
    stream = (
        spark.readStream.schema(_STREAMED).option("maxBytesPerTrigger", str(BYTES_PER_TRIGGER)).parquet(arrived)
    )
    kept = stream.groupBy("digest").agg(
        F.max(F.struct("doc_id", "run", "row_no", "locator")).alias("keeper"), F.count("*").alias("n")
    )
    with _settings(spark):
        run = (
            kept.writeStream.outputMode("update").format("noop")
            .option("checkpointLocation", state).trigger(availableNow=True).start()
        )
        run.awaitTermination()
        stored = spark.read.format("statestore").load(state)
    value = [f"value.`{f.name}`" for f in stored.schema["value"].dataType.fields]
    return stored.select(
        F.col("key.digest").alias("digest"), F.col(f"{value[0]}.doc_id").alias("keep_id"),
        F.col(f"{value[0]}.run").alias("keep_run"), F.col(f"{value[0]}.row_no").alias("keep_row"),
        F.col(f"{value[0]}.locator").alias("keep_locator"), F.col(value[1]).alias("group_size"),
    )


def _collisions(docs: DataFrame, digest_bytes: int) -> DataFrame:
    """Digests whose rows hold different texts, found by comparing the full bytes of equal digests. The
    copies of one text combine in the map tasks, so a large group sends one text per task, and the
    texts of one digest are counted afterwards, as numbers."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    bodies = own.mapInArrow(_bodies(digest_bytes), "doc_id long, digest binary, body binary")
    different = bodies.groupBy("digest", "body").agg(F.count("*").alias("n")).select("digest")
    return different.groupBy("digest").agg(F.count("*").alias("texts")).where("texts > 1").select("digest")


def _earlier_runs(spark: SparkSession, arrived: str) -> int:
    """Number of runs whose arrivals a state folder holds; it lists one folder per run."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(arrived)
    store = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(folder):
        return 0
    return sum(1 for f in store.listStatus(folder) if f.getPath().getName().startswith("run="))


def _with_contents(docs: DataFrame, collided: DataFrame, groups: DataFrame, folder: str, run: int, digest_bytes: int):
    """(collided, bodies): digests of this run whose text differs from the one an earlier run kept are
    collided too; the texts of new digests are kept for later runs."""
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    bodies = own.mapInArrow(_bodies(digest_bytes), "doc_id long, digest binary, body binary").select("digest", "body").distinct()
    if run:
        past = spark.read.schema("digest binary, body binary, run int").parquet(f"{folder}/contents").where(F.col("run") < run)
        met = bodies.join(past.select("digest", F.col("body").alias("held")), "digest")
        collided = collided.unionByName(met.groupBy("digest").agg(
            F.max((F.col("body") != F.col("held")).cast("int")).alias("apart")).where("apart = 1").select("digest")).distinct()
        bodies = bodies.join(past.select("digest", "body"), ["digest", "body"], "left_anti")
    bodies.write.mode("overwrite").parquet(f"{folder}/contents/run={run}")
    return collided


def dedup(docs: DataFrame, *, state: str | None = None, digest_bytes: int = 32) -> DataFrame:
    """One row per document of this run: doc_id, keep_id, group_size, kept, text_sha256, row_no,
    keep_run, keep_locator.

    ``state``: a folder, in a store that the whole cluster shares, in which a later call goes on. Runs
    are numbered from 0; groups then count and keep over all runs, and a row of an earlier run that a
    later one replaces is told by ``keep_run``. Without it the run stands alone.
    """
    spark = docs.sparkSession
    folder = state or scratch_path(spark, "dedup-state")
    arrived = f"{folder}/arrivals"
    run = _earlier_runs(spark, arrived) if state else 0
    arrivals(docs, digest_bytes).write.parquet(f"{arrived}/run={run}")
    groups = advance_state(spark, arrived, f"{folder}/checkpoint")
    with _settings(spark):
        stored = scratch_path(spark, "dedup-groups")
        groups.write.parquet(stored)
    groups = spark.read.parquet(stored)
    every = spark.read.schema(_STREAMED).parquet(arrived)
    collided = _collisions(docs, digest_bytes)
    if state:
        collided = _with_contents(docs, collided, groups, folder, run, digest_bytes)
        known = f"{folder}/collided"
        collided.write.mode("append").parquet(known)  # once apart, always apart
        collided = spark.read.schema("digest binary").parquet(known).distinct()
    seen = scratch_path(spark, "dedup-collided")
    collided.write.parquet(seen)
    collided = spark.read.schema("digest binary").parquet(seen)
    if collided.take(1):
        groups, every = _parted(every, groups, collided)
    rows = every.where(F.col("run") == run)
    return rows.join(groups, "digest").select(
        "doc_id", "keep_id", "group_size",
        ((F.col("row_no") == F.col("keep_row")) & (F.col("keep_run") == run)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"), "row_no", "keep_run", "keep_locator",
    )


def _free(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have."""
    while name in docs.columns:
        name += "_"
    return name


def _sha_column(place: int, name: str):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            sha = [hashlib.sha256(x).hexdigest() for x in _normalised(b.column(place).cast(pa.binary()))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sha, pa.string())], [*b.schema.names, name])

    return run


def distinct_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stay; of rows equal in id and text one stays."""
    key, sha = _free(docs, "_id"), _free(docs, "_sha")
    # Nulls have no equal in a join: ids become text, a null id an empty one.
    stay = dedup(docs, **options).where("kept").select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias(key), F.col("text_sha256").alias(sha))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    own = docs.mapInArrow(_sha_column(docs.columns.index("text"), sha), f"{fields}, `{sha}` string")
    own = own.withColumn(key, F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return own.join(stay, [key, sha], "left_semi").dropDuplicates([key, sha]).select(*[F.col(f"`{c}`") for c in docs.columns])


def _parted(rows: DataFrame, groups: DataFrame, collided: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups and rows with those of collided digests keyed by two whole digests instead."""
    apart = rows.join(collided, "digest", "left_semi").withColumn("digest", F.concat("sha", "other"))
    regrouped = apart.groupBy("digest").agg(
        F.max(F.struct("doc_id", "run", "row_no", "locator")).alias("k"), F.count("*").alias("group_size")
    ).select("digest", F.col("k.doc_id").alias("keep_id"), F.col("k.run").alias("keep_run"), F.col("k.row_no").alias("keep_row"),
             F.col("k.locator").alias("keep_locator"), "group_size")
    return (
        groups.join(collided, "digest", "left_anti").unionByName(regrouped),
        rows.join(collided, "digest", "left_anti").unionByName(apart),
    )


ship_functions(__name__)
