"""Ids, natural keys and uniqueness."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sensorquery.operators import series
from sensorquery.session import materialize


def next_id(df: DataFrame, column: str = "id") -> int:
    """One past the highest id in use; a single aggregated value."""
    return (df.agg(F.max(column)).first()[0] or 0) + 1


def assign_ids(df: DataFrame, order: list[str], start: int = 1) -> DataFrame:
    """Consecutive ids in the order of a unique key, without a single-task window."""
    placed = series.global_positions(df, [F.col(c) for c in order], "_pos")
    return placed.withColumn("id", F.col("_pos") + start).drop("_pos")


def allocate_ids(
    rows: DataFrame, kind: str, part: str, order: list[str], starts: dict[str, int]
) -> DataFrame:
    """Consecutive ids for several tables at once, each from its start (1 if not given).

    ``kind`` names the table of a row. Rows come in parts that follow one another in the wanted order,
    and ``order`` is unique within a part. Every part takes a block of each table: its size is counted,
    the blocks are laid end to end, and rows are numbered inside their block. One shuffle serves all
    tables; parts and tables, not rows, bound the block table.
    """
    blocks = rows.groupBy(kind, part).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(kind).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    first = F.create_map(*[F.lit(x) for pair in starts.items() for x in pair])[F.col(kind)] if starts else F.lit(None)
    offsets = blocks.select(
        kind, part, (F.coalesce(F.sum("_n").over(before), F.lit(0)) + F.coalesce(first.cast("long"), F.lit(1))).alias("_offset"))
    rank = F.row_number().over(Window.partitionBy(kind, part).orderBy(*order))
    return rows.withColumn("_rank", rank).join(offsets, [kind, part]).withColumn(
        "id", (F.col("_offset") + F.col("_rank") - 1).cast("long")).drop("_offset", "_rank")


def enforce_unique(
    new: DataFrame, existing: DataFrame, keys: list[str], order: list[str]
) -> DataFrame:
    """New rows with a ``status``: accepted, duplicate (within the batch) or exists (already stored).

    A key with a null in it equals no other, so such rows are all accepted. The winner of each key
    comes from a partial aggregate, so copies of one key never meet in one task; the join back is
    split by the skew handling of the session.
    """
    whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    open_keys = new.where(~whole).withColumn("status", F.lit("accepted"))
    new = new.where(whole)
    winners = new.groupBy(*keys).agg(F.min(F.struct(*order)).alias("_first"))
    stored = existing.select(*keys).distinct().withColumn("_stored", F.lit(True))
    judged = winners.join(stored, keys, "left")
    status = (
        F.when(F.col("_stored"), "exists")
        .when(F.struct(*order) == F.col("_first"), "accepted")
        .otherwise("duplicate")
    )
    found = new.join(judged, keys).withColumn("status", status).drop("_first", "_stored")
    return found.select(*new.columns, "status").unionByName(open_keys)


def resolve_ids(df: DataFrame, name_column: str, dim: DataFrame, id_column: str) -> DataFrame:
    """Ids of names, with a ``status``: ok, missing or ambiguous (several rows share the name)."""
    known = dim.groupBy(F.col("name").alias(name_column)).agg(
        F.min("id").alias(id_column), F.count("*").alias("_n")
    )
    joined = df.join(known, name_column, "left")
    status = F.when(F.col("_n").isNull(), "missing").when(F.col("_n") > 1, "ambiguous").otherwise("ok")
    return joined.withColumn("status", status).withColumn(
        id_column, F.when(F.col("status") == "ok", F.col(id_column))
    ).drop("_n")


def get_or_create(
    new: DataFrame, dim: DataFrame, key: str, order: list[str]
) -> tuple[DataFrame, DataFrame]:
    """(rows to create, all requested keys with their ids) by natural key.

    Requests with the same key create one row, the first in the given order. A key held by several
    stored rows is a conflict: its id is null.
    """
    wanted = series.first_per_key(new, [key], order)
    held = dim.groupBy(key).agg(F.min("id").alias("id"), F.count("*").alias("_n"))
    created = assign_ids(wanted.join(held, key, "left_anti"), [key], next_id(dim))
    found = wanted.select(key).join(held, key).select(
        key, F.when(F.col("_n") == 1, F.col("id")).alias("id"), F.lit(False).alias("created")
    )
    added = created.select(key, "id", F.lit(True).alias("created"))
    return created, found.unionByName(added)


def get_or_create_all(
    wanted: dict[str, DataFrame], tables: dict[str, DataFrame]
) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Several tables by name at once: ((table, name, id) of all wanted names, rows to create per table).

    ``wanted`` has one row per ``name`` and a struct ``_row`` with what a new row is made of. New names
    of all tables get their ids in the order of the names from one allocation, over one range shuffle.
    A name held by several stored rows is a conflict: its id is null.
    """
    def union(parts: list[DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionByName, parts)

    asked = union([rows.where("name is not null").select(F.lit(t).alias("table"), "name") for t, rows in wanted.items()])
    stored = union([rows.select(F.lit(t).alias("table"), "name", "id") for t, rows in tables.items()])
    held = stored.join(asked, ["table", "name"], "left_semi").groupBy("table", "name").agg(
        F.min("id").alias("id"), F.count("*").alias("_n"))
    fresh = materialize(
        asked.join(held, ["table", "name"], "left_anti").repartitionByRange("table", "name").withColumn("_part", F.spark_partition_id()))
    last = stored.groupBy("table").agg(F.max("id").alias("id")).collect()  # one row per table
    starts = dict.fromkeys(wanted, 1) | {r["table"]: r["id"] + 1 for r in last}
    created = materialize(allocate_ids(fresh, "table", "_part", ["name"], starts).select("table", "name", "id"))
    known = held.select("table", "name", F.when(F.col("_n") == 1, F.col("id")).alias("id"))
    made = {t: rows.join(created.where(F.col("table") == t).drop("table"), "name") for t, rows in wanted.items()}
    return known.unionByName(created), made
