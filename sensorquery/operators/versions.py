"""System-versioned tables: change batches in, version rows out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorquery import schema
from sensorquery.catalog import CLOSED_MONTH, VERSION_COLUMNS, Catalog
from sensorquery.operators import series

# Columns that are kept up to date by the engine; a change of these alone opens no version.
UNTRACKED = {
    "datastream": (
        "phenomenon_start", "phenomenon_end", "result_start", "result_end",
        "observed_area", "last_foi_id",
    ),
    "location": ("gen_foi_id",),
}
ACTIONS = ("CREATE", "UPDATE", "DELETE")
# Versions of one entity are chained in chunks of this length.
VERSION_CHUNK = 365 * series.DAY


def to_versions(
    changes: DataFrame, *, key: str = "id", ts: str = "ts", seq: str = "seq",
    chunk_seconds: int = VERSION_CHUNK,
) -> DataFrame:
    """Versions of a change feed: each change holds until the next one of the same entity.

    A delete closes the chain without opening a version. Changes at the same instant leave only the
    last one, since the earlier ones would be valid for no time.
    """
    feed = changes.withColumn("_chunk", series.chunk_of(F.col(ts), chunk_seconds))
    chained = series.with_edges(feed, [key], [ts, seq], {"valid_to": (ts, 1)})
    lasting = F.col("valid_to").isNull() | (F.col("valid_to") > F.col(ts))
    rows = chained.where(lasting)
    if "action" in rows.columns:
        rows = rows.where(F.col("action") != "DELETE").drop("action")
    return rows.withColumnRenamed(ts, "valid_from").drop(seq)


def _same(columns: list[str]) -> Column:
    equal = F.lit(True)
    for c in columns:
        equal = equal & F.col(f"_old.{c}").eqNullSafe(F.col(f"_new.{c}"))
    return equal


def change_rows(
    table: str, current: DataFrame, changes: DataFrame, ts: str | Column, commit_id: Column | None = None
) -> DataFrame:
    """Version rows after one batch of changes, from the open versions of a table.

    ``changes`` has ``id``, ``action`` (CREATE, UPDATE, DELETE) and full new rows, one per id
    (``apply_feed`` takes several; a second one here ends the job rather than open two versions). The
    result holds the open versions (``valid_to`` null) and the versions closed by this batch.
    Updates and deletes of unknown ids change nothing; see ``unmatched``.
    """
    at = F.lit(ts).cast("timestamp") if isinstance(ts, str) else ts
    own = [c for c in current.columns if c not in VERSION_COLUMNS]
    tracked = [c for c in own if c != "id" and c not in UNTRACKED.get(table, ())]
    stamp = F.lit(None).cast("long") if commit_id is None else commit_id

    old = current.select("id", F.struct(*[c for c in current.columns]).alias("_old"))
    both = old.join(_single_changes(changes, own), "id", "full_outer")
    return both.select(F.explode(_version_rows(own, tracked, at, stamp)).alias("_row")).select("_row.*")


def _single_changes(changes: DataFrame, own: list[str]) -> DataFrame:
    """(id, action, _new): the one change of each id."""
    grouped = changes.groupBy("id").agg(
        F.first("action").alias("action"), F.first(F.struct(*own)).alias("_new"), F.count("*").alias("_n"))
    single = F.when(F.col("_n") > 1, F.raise_error(F.lit("several changes of one id; use apply_feed"))).otherwise(F.col("action"))
    return grouped.select("id", single.cast("string").alias("action"), "_new")


def _version_rows(own: list[str], tracked: list[str], at: Column, stamp: Column) -> Column:
    """The version rows that come of an open version (``_old``) and its change (``action``, ``_new``)."""

    def row(source: str, valid_from: Column, valid_to: Column, commit: Column) -> Column:
        return F.struct(
            *[F.col(f"{source}.{c}").alias(c) for c in own],
            valid_from.alias("valid_from"), valid_to.alias("valid_to"), commit.alias("commit_id"),
        )

    never = F.lit(None).cast("timestamp")
    since, before = F.col("_old.valid_from"), F.col("_old.commit_id")
    kept = row("_old", since, never, before)
    closed = row("_old", since, at, before)
    opened = row("_new", at, never, stamp)
    derived = row("_new", since, never, before)
    return (
        F.when(F.col("_new").isNull(), F.array(kept))
        .when(F.col("_old").isNull(), F.when(F.col("action") == "CREATE", F.array(opened)))
        .when(F.col("action") == "DELETE", F.array(closed))
        .when(_same(tracked), F.array(derived))
        .otherwise(F.array(closed, opened))
    )


def apply_feed(
    table: str, versions: DataFrame, feed: DataFrame, *, ts: str = "ts", seq: str = "seq",
    chunk_seconds: int = VERSION_CHUNK,
) -> DataFrame:
    """Full version table after a feed with any number of changes per id, chained by (ts, seq).

    ``feed`` has ``id``, ``action``, the instant and order of each change, full new rows and, where
    the versions have one, ``commit_id``. Each change closes what was open before it; of changes at
    one instant the last holds. Ids without changes are carried over untouched, changes of ids that
    are neither stored nor created in the feed change nothing.
    """
    touched = feed.select("id").distinct()
    still_open = F.col("valid_to").isNull()
    own = [c for c in versions.columns if c not in VERSION_COLUMNS]
    stamp = [c for c in ("commit_id",) if c in versions.columns]
    past = versions.where(~still_open)
    current = versions.where(still_open)
    kept = current.join(touched, "id", "left_anti")
    started = current.join(touched, "id", "left_semi").select(
        *own, *stamp, F.col("valid_from").alias(ts), F.lit(-1).cast("long").alias(seq), F.lit("CREATE").alias("action"))
    known = current.select("id").unionByName(feed.where(F.col("action") == "CREATE").select("id")).distinct()
    extra = [c if c in feed.columns else F.lit(None).cast("long").alias(c) for c in stamp]
    coming = feed.join(known, "id", "left_semi").select(
        *own, *extra, F.col(ts), F.col(seq).cast("long").alias(seq), "action")
    chained = to_versions(started.unionByName(coming), ts=ts, seq=seq, chunk_seconds=chunk_seconds)
    return past.unionByName(kept).unionByName(chained.select(*versions.columns))


def apply_changes(
    table: str, versions: DataFrame, changes: DataFrame, ts, commit_id: Column | None = None
) -> DataFrame:
    """Full version table after a batch of changes: closed versions are carried over untouched.

    The versions are read once with the changes beside their open rows, so a batch small enough to be
    broadcast moves none of them; a larger one deals all versions by id, closed ones too. A second look,
    at ids only, tells which creations are new.
    """
    at = F.lit(ts).cast("timestamp") if isinstance(ts, str) else ts
    own = [c for c in versions.columns if c not in VERSION_COLUMNS]
    tracked = [c for c in own if c != "id" and c not in UNTRACKED.get(table, ())]
    stamp = F.lit(None).cast("long") if commit_id is None else commit_id
    new = _single_changes(changes, own)
    is_change = (F.col("id") == F.col("_changed")) & F.col("valid_to").isNull()
    beside = versions.join(new.withColumnRenamed("id", "_changed"), is_change, "left")
    rows = beside.withColumn("_old", F.struct(*versions.columns))
    changed = F.when(F.col("_new").isNull(), F.array(F.struct(*versions.columns))).otherwise(
        F.transform(_version_rows(own, tracked, at, stamp), lambda r: F.struct(*[r[c].alias(c) for c in versions.columns])))
    carried = rows.select(F.explode(changed).alias("_row")).select("_row.*")
    held = versions.where(F.col("valid_to").isNull()).select("id")
    opened = new.where(F.col("action") == "CREATE").join(held, "id", "left_anti").withColumn("_old", F.lit(None).cast(rows.schema["_old"].dataType))
    first = opened.select(F.explode(_version_rows(own, tracked, at, stamp)).alias("_row")).select("_row.*")
    return carried.unionByName(first.select(*versions.columns))


def split_versions(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(current, closed): the new current state and the rows to append to the history."""
    return rows.where(F.col("valid_to").isNull()), rows.where(F.col("valid_to").isNotNull())


def append_history(closed: DataFrame, path: str) -> None:
    """History is append-only, laid out by the month in which versions ended: a read as of an instant
    leaves out the months before it."""
    rows = closed.where(F.col("valid_to").isNotNull()).withColumn(CLOSED_MONTH, F.trunc("valid_to", "month"))
    order = [CLOSED_MONTH, "id", "valid_from"]
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("append").partitionBy(CLOSED_MONTH).parquet(path)


def read_history(spark: SparkSession, path: str, layout) -> DataFrame:
    """A history with its months, for ``Catalog(history=...)``; ``layout`` is that of the versions."""
    fields = layout if isinstance(layout, T.StructType) else T.StructType.fromDDL(layout)
    return spark.read.schema(T.StructType([*fields.fields, T.StructField(CLOSED_MONTH, T.DateType())])).parquet(path)


def unmatched(current: DataFrame, changes: DataFrame) -> DataFrame:
    """Updates and deletes of ids that have no open version."""
    return changes.where(F.col("action") != "CREATE").join(current.select("id"), "id", "left_anti")


def id_violations(changes: DataFrame, new_id: str) -> DataFrame:
    """Changes that try to give an entity another id."""
    return changes.where(F.col(new_id).isNotNull() & (F.col(new_id) != F.col("id")))


def check_versions(versions: DataFrame, chunk_seconds: int = VERSION_CHUNK) -> DataFrame:
    """Versions that overlap the next version of the same entity; empty for a sound table."""
    cut = versions.withColumn("_chunk", series.chunk_of(F.col("valid_from"), chunk_seconds))
    end = F.coalesce("valid_to", F.lit("9999-12-31T23:59:59Z").cast("timestamp"))
    chained = series.with_edges(
        cut.withColumn("_end", end), ["id"], ["valid_from", "_end"], {"next_from": ("valid_from", 1)}
    )
    return chained.where(F.col("_end") > F.col("next_from")).drop("_end")


def commit(
    spark: SparkSession, commit_id: int, message: str | None, author: str, action: str, ts: str
) -> DataFrame:
    """One commit row; a change without a message is refused."""
    if not message:
        raise ValueError("a commit needs a message")
    if action not in ACTIONS:
        raise ValueError(f"unknown action: {action}")
    return spark.range(1).select(
        F.lit(commit_id).cast("long").alias("id"), F.lit(author).alias("author"),
        F.lit("text/plain").alias("encoding_type"), F.lit(message).alias("message"),
        F.lit(ts).cast("timestamp").alias("date"), F.lit(action).alias("action_type"),
    )


def history(catalog: Catalog, name: str, key: int | None = None) -> DataFrame:
    """All versions of an entity kind (or of one entity) with the commit that made them."""
    rows = catalog.traveltime(schema.entity(name).table)
    if key is not None:
        rows = rows.where(F.col("id") == key)
    log = catalog.table("commit_log").select(
        F.col("id").alias("commit_id"), "author", "message", "date", "action_type"
    )
    return rows.join(log, "commit_id", "left")


def commit_links(commits: DataFrame, tables: dict[str, DataFrame], base: str = "") -> DataFrame:
    """Links from each commit to the entity kinds it touched; null for the others."""
    linked = commits
    for table, rows in tables.items():
        collection = schema.ENTITIES[table].collection
        touched = rows.select(F.col("commit_id").alias("_commit")).where(
            F.col("_commit").isNotNull()
        ).distinct()
        link = F.concat(F.lit(f"{base}/Commits("), F.col("id").cast("string"), F.lit(f")/{collection}"))
        linked = (
            linked.join(touched, F.col("id") == F.col("_commit"), "left")
            .withColumn(f"{collection}@iot.navigationLink", F.when(F.col("_commit").isNotNull(), link))
            .drop("_commit")
        )
    return linked
