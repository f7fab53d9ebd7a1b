"""Windows over long series without ever gathering a whole series in one task.

A series may hold a large share of all rows. Every operator here therefore works on bounded groups:
time chunks of a series, or blocks of consecutive positions. What a group needs from its neighbours
comes from small per-chunk summaries (one row per chunk) or from a copy of the few rows at the edge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorquery.session import materialize, scratch_path

CHUNK_ROWS = 1 << 20  # of one series in one group
_PIECES = 1 << 24  # more than a chunk has seconds
DAY = 86_400
SALTS = 64
ROWS_PER_PART = 2_000_000


def chunk_of(ts: Column, seconds: int) -> Column:
    """Number of the fixed-length time chunk of an instant."""
    micros = F.unix_micros(ts)
    width = F.lit(seconds * 1_000_000)
    return ((micros - F.pmod(micros, width)) / width).cast("long")


def range_of(number: Column, width: int) -> Column:
    """Number of the fixed-width range of an integer."""
    return ((number - F.pmod(number, F.lit(width))) / F.lit(width)).cast("long")


def positions(
    df: DataFrame, key: list[str], order: list[str], chunk: Column, name: str = "pos"
) -> DataFrame:
    """0-based position of each row in its series.

    ``chunk`` must grow with the order columns. Counts per chunk give the offset of each chunk, so
    the full rows are shuffled once, by (key, chunk).
    """
    cut = df.withColumn("_chunk", chunk)
    sizes = cut.groupBy(*key, "_chunk").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *key, "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    inside = Window.partitionBy(*key, "_chunk").orderBy(*order)
    return (
        cut.join(offsets, [*key, "_chunk"])
        .withColumn(name, F.col("_offset") + F.row_number().over(inside) - 1)
        .drop("_chunk", "_offset")
    )


def global_positions(df: DataFrame, order: list[Column], name: str = "pos") -> DataFrame:
    """0-based position of each row in a total order over the whole table.

    Rows are range-partitioned and sorted, about ROWS_PER_PART to a partition; the checkpoint pins
    the placement. The offsets table has one row per partition, which bounds what the join
    broadcasts.
    """
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // ROWS_PER_PART))
    placed = materialize(
        df.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    # One row per partition, so this single-group window and the broadcast are bounded by `parts`.
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + F.col("_row"))
        .drop("_part", "_row", "_offset")
    )


def top_per_key(
    df: DataFrame, key: list[str], order: list[Column], limit: int, row_id: str = "id"
) -> DataFrame:
    """First ``limit`` rows per key with their rank ``rn``, in two steps.

    The first ranks within SALTS groups of each key, and Spark trims those in the map tasks too; the
    second ranks what is left. A hot key thus sends at most SALTS * limit rows to one task, however
    many map tasks hold it.
    """
    rank = F.row_number()
    salt = F.pmod(F.xxhash64(F.col(row_id)), F.lit(SALTS))
    salted = Window.partitionBy(*key, "_salt").orderBy(*order)
    df = (
        df.withColumn("_salt", salt).withColumn("rn", rank.over(salted))
        .where(F.col("rn") <= limit).drop("_salt", "rn")
    )
    return df.withColumn("rn", rank.over(Window.partitionBy(*key).orderBy(*order))).where(
        F.col("rn") <= limit
    )


def first_per_key(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row per key in the given order, by a partial aggregate (hot keys combine early)."""
    rest = [c for c in df.columns if c not in key]
    picked = F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*key).agg(picked).select(
        *[F.col(c) if c in key else F.col("_row")[c].alias(c) for c in df.columns]
    )


def equi_depth_chunks(
    df: DataFrame, key: list[str], ts: str, *, chunk_seconds: int = DAY, rows: int = CHUNK_ROWS
) -> DataFrame:
    """Adds ``_chunk``: chunks of time that hold about ``rows`` rows at most, in the order of time.

    A chunk of ``chunk_seconds`` with more rows is cut where its counted seconds add up to ``rows``;
    one second is the smallest piece. Only crowded chunks are counted by the second, and the table of
    borders holds a row for each of their seconds. It is written first, so Spark knows its size when it
    joins: where no chunk is crowded it is empty, and the rows are not moved for it.
    """
    whole = chunk_of(F.col(ts), chunk_seconds)
    timed = df.withColumns({"_whole": whole, "_second": F.floor(F.unix_micros(ts) / F.lit(1_000_000)).cast("long")})
    counts = timed.groupBy(*key, "_whole").agg(F.count("*").alias("_n")).where(F.col("_n") > rows).select(*key, "_whole")
    seconds = timed.select(*key, "_whole", "_second").join(counts, [*key, "_whole"], "left_semi").groupBy(
        *key, "_whole", "_second").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*key, "_whole").orderBy("_second").rowsBetween(Window.unboundedPreceding, -1)
    borders = seconds.select(
        *key, "_second", F.floor(F.coalesce(F.sum("_n").over(before), F.lit(0)) / F.lit(rows)).cast("long").alias("_piece"))
    path = scratch_path(df.sparkSession, "borders")
    borders.write.parquet(path)
    held = df.sparkSession.read.schema(borders.schema).parquet(path)
    return timed.join(held, [*key, "_second"], "left").withColumn(
        "_chunk", F.col("_whole").cast("long") * F.lit(_PIECES) + F.coalesce("_piece", F.lit(0))
    ).select(*df.columns, "_chunk")


def neighbours(
    df: DataFrame, key: str, ts: str, tie: str, value: str, *, chunk_seconds: int = DAY, rows: int = CHUNK_ROWS
) -> DataFrame:
    """Adds ``prev`` and ``next``: the value of the neighbouring rows of the series. No task holds more
    than about ``rows`` rows of a series, however often it reads."""
    chunked = equi_depth_chunks(df, [key], ts, chunk_seconds=chunk_seconds, rows=rows)
    return with_edges(chunked, [key], [ts, tie], {"prev": (value, -1), "next": (value, 1)})


def with_edges(
    df: DataFrame, key: list[str], order: list[str], picks: dict[str, tuple[str, int]]
) -> DataFrame:
    """lag (-1) and lead (+1) columns over series cut into the chunks of column ``_chunk``.

    Inside a chunk this is an ordinary window; across chunks the value comes from a summary with the
    first and last row of each chunk. Drops ``_chunk``.
    """
    rank = F.struct(*order)
    edges = df.groupBy(*key, "_chunk").agg(
        *[F.min_by(F.struct(c), rank).alias(f"_first_{n}") for n, (c, d) in picks.items() if d > 0],
        *[F.max_by(F.struct(c), rank).alias(f"_last_{n}") for n, (c, d) in picks.items() if d < 0],
    )
    across = Window.partitionBy(*key).orderBy("_chunk")
    linked = edges.select(
        *key, "_chunk",
        *[
            F.lead(f"_first_{n}").over(across)[c].alias(f"_edge_{n}")
            if d > 0
            else F.lag(f"_last_{n}").over(across)[c].alias(f"_edge_{n}")
            for n, (c, d) in picks.items()
        ],
    )
    inside = Window.partitionBy(*key, "_chunk").orderBy(*order)
    joined = df.join(linked, [*key, "_chunk"])
    for name, (column, direction) in picks.items():
        shifted = F.lead if direction > 0 else F.lag
        at_edge = shifted(F.lit(1)).over(inside).isNull()
        joined = joined.withColumn(
            name, F.when(at_edge, F.col(f"_edge_{name}")).otherwise(shifted(column).over(inside))
        )
    return joined.drop("_chunk", *[f"_edge_{n}" for n in picks])


def trailing_rows(
    df: DataFrame, key: str, ts: str, tie: str, size: int, aggregates: dict[str, Column],
    *, chunk_seconds: int = DAY, block: int = 65_536,
) -> DataFrame:
    """Aggregates over each row and the ``size - 1`` rows before it.

    Positions cut a series into blocks; the last ``size - 1`` rows of a block are copied into the
    next one, so every frame is complete within its group of at most ``block + size - 1`` rows.
    Adds ``rows_in_frame`` so that incomplete heads can be dropped.
    """
    block = max(block, size)
    placed = positions(df, [key], [ts, tie], chunk_of(F.col(ts), chunk_seconds), "_pos")
    own = range_of(F.col("_pos"), block)
    at_end = F.pmod(F.col("_pos"), F.lit(block)) >= block - (size - 1)
    homes = F.when(at_end, F.array(own, own + 1)).otherwise(F.array(own))
    spread = placed.withColumn("_own", own).withColumn("_block", F.explode(homes))
    frame = Window.partitionBy(key, "_block").orderBy("_pos").rowsBetween(-(size - 1), 0)
    return (
        spread.withColumns({name: agg.over(frame) for name, agg in aggregates.items()})
        .withColumn("rows_in_frame", F.count(F.lit(1)).over(frame))
        .where(F.col("_block") == F.col("_own"))
        .drop("_pos", "_own", "_block")
    )


def trailing_span(
    df: DataFrame, key: str, ts: str, value: str, seconds: int, *, splits: int = 24
) -> DataFrame:
    """Count, mean, spread, min and max of ``value`` over the closed span [t - seconds, t].

    The span is cut into blocks of ``seconds / splits``. A frame is the tail of its oldest block,
    the blocks in between (from a summary with one row per block) and the head of its own block.
    Head and tail come from running windows over at most two blocks of rows, so the cost per row
    does not grow with the number of readings in the span, and full rows are shuffled once, by
    (key, block). Means and squared deviations are merged part by part, which keeps them accurate.

    Adds ``n, mean, m2, lowest, highest`` (``m2`` is the sum of squared deviations from the mean);
    null values take no part.
    """
    whole = seconds * 1_000_000
    if splits < 2 or whole % splits:
        raise ValueError("the span must consist of two or more whole blocks")
    width, lag = whole // splits, splits

    base = df.withColumn("_t", F.unix_micros(ts)).withColumn("_own", range_of(F.col("_t"), width))
    middle = _middle_blocks(base, key, value, lag)

    # Each row joins its own block as a reading and the block one span later as context.
    payload = [c for c in df.columns if c not in (key, ts)]
    spread = base.select(
        key, "_t", F.col(value).alias("_v"), "_own",
        F.explode(F.array(F.col("_own"), F.col("_own") + lag)).alias("_block"),
        F.struct(ts, *payload).alias("_row"),
    ).withColumn("_late", F.col("_block") != F.col("_own"))
    spread = spread.withColumn("_row", F.when(~F.col("_late"), F.col("_row")))
    # Context sits at the instant it leaves the frame; it is visible up to and including that one.
    spread = spread.withColumn(
        "_at", F.when(F.col("_late"), F.col("_t") + whole).otherwise(F.col("_t"))
    ).join(middle, [key, "_block"], "left")

    group = Window.partitionBy(key, "_block", "_late")
    head = group.orderBy("_t").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    tail = group.orderBy(F.col("_t").desc()).rangeBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    partials = _partials("_v")
    parts = spread.withColumns(
        {
            f"_{name}_part": F.when(F.col("_late"), agg.over(tail)).otherwise(agg.over(head))
            for name, agg in partials.items()
        }
    )
    squares = F.col("_variance_part") * F.col("_n_part")
    part = F.struct(*[F.col(f"_{n}_part").alias(n) for n in partials], squares.alias("m2"))
    # Walking back in time, the last context row seen is the first one still inside the frame.
    walk = (
        Window.partitionBy(key, "_block")
        .orderBy(F.col("_at").desc(), F.col("_late").desc(), F.col("_t").desc())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    context = F.last(F.when(F.col("_late"), part), ignorenulls=True).over(walk)
    seen = parts.withColumn("_tail", context).where(~F.col("_late"))
    own, between, before = part, F.col("_middle"), F.col("_tail")
    three = (own, between, before)
    weights = [F.coalesce(p["n"], F.lit(0)) for p in three]
    n = sum(weights, F.lit(0))
    sums = [w * F.coalesce(p["mean"], F.lit(0.0)) for w, p in zip(weights, three)]
    mean = sum(sums, F.lit(0.0)) / F.when(n > 0, n)
    merged = seen.withColumn("_n", n).withColumn("_mean", mean)
    shifts = [
        F.coalesce(p["m2"] + w * (p["mean"] - F.col("_mean")) * (p["mean"] - F.col("_mean")), F.lit(0.0))
        for w, p in zip(weights, three)
    ]
    return merged.select(
        F.col(key), *[F.col("_row")[c].alias(c) for c in (ts, *payload)],
        F.col("_n").alias("n"), F.col("_mean").alias("mean"), sum(shifts, F.lit(0.0)).alias("m2"),
        F.least(*[p["lowest"] for p in three]).alias("lowest"),
        F.greatest(*[p["highest"] for p in three]).alias("highest"),
    ).select(*df.columns, "n", "mean", "m2", "lowest", "highest")


def _partials(value: str) -> dict[str, Column]:
    v = F.col(value)
    return {
        "n": F.count(v), "mean": F.avg(v), "variance": F.var_pop(v),
        "lowest": F.min(v), "highest": F.max(v),
    }


def _middle_blocks(base: DataFrame, key: str, value: str, lag: int) -> DataFrame:
    """Per block the merged statistics of the ``lag - 1`` blocks before it, as struct ``_middle``.

    Works on the summary only. Deviations are taken from one center per series.
    """
    summary = base.groupBy(key, F.col("_own").alias("_block")).agg(
        *[agg.alias(name) for name, agg in _partials(value).items()]
    ).withColumn("m2", F.col("variance") * F.col("n"))
    weighted = F.col("n") * F.coalesce("mean", F.lit(0.0))
    series_window = Window.partitionBy(key)
    total = F.sum("n").over(series_window)
    centered = summary.withColumn(
        "_center", F.sum(weighted).over(series_window) / F.when(total > 0, total)
    )
    shift = F.coalesce(F.col("mean") - F.col("_center"), F.lit(0.0))
    between = Window.partitionBy(key).orderBy("_block").rangeBetween(-(lag - 1), -1)
    n = F.sum("n").over(between)
    first = F.sum(F.col("n") * shift).over(between)
    second = F.sum(F.coalesce("m2", F.lit(0.0)) + F.col("n") * shift * shift).over(between)
    moved = first / F.when(n > 0, n)
    return centered.select(
        key, "_block",
        F.struct(
            n.alias("n"), (F.col("_center") + moved).alias("mean"),
            F.greatest(second - n * moved * moved, F.lit(0.0)).alias("m2"),
            F.min("lowest").over(between).alias("lowest"), F.max("highest").over(between).alias("highest"),
        ).alias("_middle"),
    )


def exact_percentiles(
    df: DataFrame, key: list[str], value: str, probs: dict[str, float], *, accuracy: int = 20_000
) -> DataFrame:
    """Exact percentiles per key with linear interpolation, for groups of any size.

    A sketch brackets each wanted rank (its rank error is at most n / accuracy). A second pass counts
    what lies below the bracket and gathers only the distinct values inside it, pre-counted. Groups
    of up to 2 * accuracy rows are small enough to take their whole range as the bracket.
    """
    names = list(probs)
    margin = 2.0 / accuracy
    edges = [
        min(max(p + side, 0.0), 1.0) for p in probs.values() for side in (-margin, margin)
    ]
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(value)).select(*key, F.col(value).alias("_v"))
    sketch = rows.groupBy(*key).agg(
        F.percentile_approx("_v", edges, accuracy).alias("_edges"), F.count("*").alias("_n"),
        F.min("_v").alias("_min"), F.max("_v").alias("_max"),
    )
    small = F.col("_n") <= 2 * accuracy
    # Ranks (0-based) below and above each wanted position, one row per key and percentile.
    wanted = F.array(
        *[
            F.struct(
                F.lit(i).alias("which"),
                (F.floor(F.lit(p) * (F.col("_n") - 1))).cast("long").alias("lo_rank"),
                (F.ceil(F.lit(p) * (F.col("_n") - 1))).cast("long").alias("hi_rank"),
                (F.lit(p) * (F.col("_n") - 1) % 1).alias("share"),
                F.when(small | F.lit(p - margin <= 0), F.col("_min"))
                .otherwise(F.get("_edges", F.lit(2 * i)))
                .alias("low"),
                F.when(small | F.lit(p + margin >= 1), F.col("_max"))
                .otherwise(F.get("_edges", F.lit(2 * i + 1)))
                .alias("high"),
            )
            for i, p in enumerate(probs.values())
        ]
    )
    brackets = sketch.select(*key, wanted.alias("_wanted"))
    # Every row lands once per percentile: below the bracket (one bucket) or at its own value.
    spread = rows.join(brackets, key).select(*key, "_v", F.explode("_wanted").alias("_w")).where(
        F.col("_v") <= F.col("_w.high")
    )
    counted = spread.groupBy(
        *key, F.col("_w.which").alias("_which"),
        F.when(F.col("_v") >= F.col("_w.low"), F.col("_v")).alias("_at"),
    ).agg(
        F.count("*").alias("_c"), F.first("_w.lo_rank").alias("_lo"),
        F.first("_w.hi_rank").alias("_hi"), F.first("_w.share").alias("_share"),
    )
    order = Window.partitionBy(*key, "_which").orderBy(F.col("_at").asc_nulls_first())
    reach = counted.withColumn("_upto", F.sum("_c").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    inside = F.col("_at").isNotNull()
    picked = reach.groupBy(*key, "_which").agg(
        F.min(F.when(inside & (F.col("_upto") > F.col("_lo")), F.col("_at"))).alias("_a"),
        F.min(F.when(inside & (F.col("_upto") > F.col("_hi")), F.col("_at"))).alias("_b"),
        F.first("_share").alias("_share"),
    )
    value_at = F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_share")
    return picked.groupBy(*key).agg(
        *[F.max(F.when(F.col("_which") == i, value_at)).alias(n) for i, n in enumerate(names)]
    )
