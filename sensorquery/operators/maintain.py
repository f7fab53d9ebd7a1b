"""Derived state of a datastream: time extents and observed area."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorquery.functions import geometry
from sensorquery.session import ship_functions

ship_functions(__name__)

EXTENT_COLUMNS = ("phenomenon_start", "phenomenon_end", "result_start", "result_end")


def extents(obs: DataFrame) -> DataFrame:
    """Time extents per datastream, over non-null bounds."""
    return obs.groupBy("datastream_id").agg(
        F.min("phenomenon_start").alias("phenomenon_start"),
        F.max("phenomenon_end").alias("phenomenon_end"),
        F.min("result_time").alias("result_start"),
        F.max("result_time").alias("result_end"),
    )


def _beside(datastreams: DataFrame, side: DataFrame, prefix: str) -> DataFrame:
    """Datastreams with the columns of a per-datastream table, prefixed; kept without a match."""
    named = side.select(
        *[
            F.col(c).alias("_ds" if c == "datastream_id" else f"{prefix}{c}")
            for c in side.columns
        ]
    )
    return datastreams.join(named, datastreams["id"] == F.col("_ds"), "left").drop("_ds")


def merge_extents(datastreams: DataFrame, batch: DataFrame) -> DataFrame:
    """Extents widened by a batch of observations; a bound the batch lacks stays as it is."""
    both = _beside(datastreams, extents(batch), "_new_")
    pick = {
        "phenomenon_start": F.least, "phenomenon_end": F.greatest,
        "result_start": F.least, "result_end": F.greatest,
    }
    return both.withColumns({c: f(c, f"_new_{c}") for c, f in pick.items()}).select(
        *datastreams.columns
    )


def widen_extents(datastreams: DataFrame, changed: DataFrame) -> DataFrame:
    """After an update extents only grow."""
    return merge_extents(datastreams, changed)


def shrink_extents(datastreams: DataFrame, deleted: DataFrame, remaining: DataFrame) -> DataFrame:
    """Extents after a delete: only bounds a deleted reading held are computed again.

    Only datastreams that lost such a bound re-read their remaining observations. A pair of bounds
    becomes null when nothing is left to hold it.
    """
    marked = _beside(datastreams, extents(deleted), "_gone_")
    held = {c: F.coalesce(F.col(c) == F.col(f"_gone_{c}"), F.lit(False)) for c in EXTENT_COLUMNS}
    any_held = held["phenomenon_start"]
    for test in list(held.values())[1:]:
        any_held = any_held | test
    affected = marked.where(any_held).select(F.col("id").alias("datastream_id"))
    left = extents(remaining.join(affected, "datastream_id", "left_semi"))
    both = _beside(marked, left, "_left_")
    fresh = {
        c: F.when(held[c], F.col(f"_left_{c}")).otherwise(F.col(c)) for c in EXTENT_COLUMNS
    }
    paired = {
        "phenomenon_start": "phenomenon_end", "phenomenon_end": "phenomenon_start",
        "result_start": "result_end", "result_end": "result_start",
    }
    final = {c: F.when(fresh[other].isNotNull(), fresh[c]) for c, other in paired.items()}
    return both.withColumns(final).select(*datastreams.columns)


def recompute_extents(datastreams: DataFrame, touched: DataFrame, remaining: DataFrame) -> DataFrame:
    """Extents of touched datastreams taken anew from their remaining observations."""
    left = extents(remaining.join(touched, "datastream_id", "left_semi"))
    flagged = touched.select("datastream_id").distinct().withColumn("hit", F.lit(True))
    both = _beside(_beside(datastreams, flagged, "_"), left, "_left_")
    return both.withColumns(
        {c: F.when(F.col("_hit"), F.col(f"_left_{c}")).otherwise(F.col(c)) for c in EXTENT_COLUMNS}
    ).select(*datastreams.columns)


def touched(obs: DataFrame) -> DataFrame:
    """Distinct datastreams of some observations."""
    return obs.select("datastream_id").distinct()


def touched_by_feature(obs: DataFrame, features: DataFrame) -> DataFrame:
    """Distinct datastreams with an observation of one of the features (column ``id``)."""
    keys = features.select(F.col("id").alias("feature_of_interest_id"))
    return touched(obs.join(keys, "feature_of_interest_id", "left_semi"))


def _features_of(obs: DataFrame, features: DataFrame, exclude: DataFrame | None) -> DataFrame:
    """Distinct (datastream, feature) pairs with the feature geometry."""
    pairs = obs.select("datastream_id", "feature_of_interest_id").distinct()
    if exclude is not None:
        gone = exclude.select(F.col("id").alias("feature_of_interest_id"))
        pairs = pairs.join(gone, "feature_of_interest_id", "left_anti")
    shapes = features.select(F.col("id").alias("feature_of_interest_id"), "feature")
    return pairs.join(shapes, "feature_of_interest_id")


def observed_area(
    obs: DataFrame, features: DataFrame, how: str = "hull", exclude: DataFrame | None = None
) -> DataFrame:
    """``datastream_id`` and ``observed_area`` of the distinct features of each datastream.

    ``envelope`` is a native aggregate. ``hull`` reduces every partition to partial hulls before the
    shuffle, since the hull of hulls is the hull of all.
    """
    located = _features_of(obs, features, exclude)
    if how == "envelope":
        box = located.groupBy("datastream_id").agg(
            F.min("feature.xmin").alias("xmin"), F.min("feature.ymin").alias("ymin"),
            F.max("feature.xmax").alias("xmax"), F.max("feature.ymax").alias("ymax"),
        )
        return box.select("datastream_id", envelope(*(F.col(c) for c in ("xmin", "ymin", "xmax", "ymax"))).alias("observed_area"))
    if how != "hull":
        raise ValueError(f"unknown area: {how}")
    points = located.select(
        "datastream_id", F.explode(F.flatten("feature.coords")).alias("p")
    ).select("datastream_id", F.get("p", F.lit(0)).alias("x"), F.get("p", F.lit(1)).alias("y"))
    return hulls(points)


def envelope(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    """Box geometry: a point, a line or a ring, by its extent."""
    def at(x, y):
        return F.array(x, y)

    ring = F.array(F.array(at(xmin, ymin), at(xmin, ymax), at(xmax, ymax), at(xmax, ymin), at(xmin, ymin)))
    flat = (xmin == xmax) | (ymin == ymax)
    single = (xmin == xmax) & (ymin == ymax)
    kind = F.when(single, "Point").when(flat, "LineString").otherwise("Polygon")
    coords = (
        F.when(single, F.array(F.array(at(xmin, ymin))))
        .when(flat, F.array(F.array(at(xmin, ymin), at(xmax, ymax))))
        .otherwise(ring)
    )
    return F.when(xmin.isNotNull(), geometry.geometry(kind, coords))


def hulls(points: DataFrame) -> DataFrame:
    """Convex hull per datastream of points (datastream_id, x, y)."""
    layout = "datastream_id long, x double, y double"
    partial = points.mapInPandas(_partial_hulls, layout)
    merged = (
        partial.repartition(F.xxhash64("datastream_id"))
        .sortWithinPartitions("datastream_id")
        .mapInPandas(_final_hulls, "datastream_id long, ring array<array<double>>")
    )
    size = F.size("ring")
    kind = F.when(size == 1, "Point").when(size == 2, "LineString").otherwise("Polygon")
    ring = F.when(size > 2, F.concat("ring", F.slice("ring", 1, 1))).otherwise(F.col("ring"))
    return merged.select(
        "datastream_id", geometry.geometry(kind, F.array(ring)).alias("observed_area")
    )


def _hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Hull corners, counter-clockwise from the lowest x, y; collinear points collapse to two."""
    points = sorted(set(points))
    if len(points) <= 2:
        return points

    def chain(ordered):
        kept: list = []
        for p in ordered:
            while len(kept) >= 2:
                (ax, ay), (bx, by) = kept[-2], kept[-1]
                if (bx - ax) * (p[1] - ay) - (by - ay) * (p[0] - ax) > 0:
                    break
                kept.pop()
            kept.append(p)
        return kept

    lower, upper = chain(points), chain(points[::-1])
    return lower[:-1] + upper[:-1]


def _groups(batch: pd.DataFrame):
    """(key, points) for each run of rows with the same datastream."""
    keys = batch["datastream_id"].to_numpy()
    points = list(zip(batch["x"].tolist(), batch["y"].tolist()))
    cuts = (np.flatnonzero(np.diff(keys)) + 1).tolist()
    for a, b in zip([0, *cuts], [*cuts, len(keys)]):
        yield int(keys[a]), points[a:b]


def _partial_hulls(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        if batch.empty:
            continue
        ordered = batch.sort_values("datastream_id", kind="stable")
        rows = [(key, *p) for key, points in _groups(ordered) for p in _hull(points)]
        yield pd.DataFrame(rows, columns=["datastream_id", "x", "y"])


def _final_hulls(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows arrive grouped by datastream; only one hull is held at a time."""
    current, ring = None, []
    for batch in batches:
        if batch.empty:
            continue
        done = []
        for key, points in _groups(batch):
            if key != current and current is not None:
                done.append((current, ring))
                ring = []
            current, ring = key, _hull(ring + points)
        if done:
            yield pd.DataFrame(done, columns=["datastream_id", "ring"])
    if current is not None:
        yield pd.DataFrame([(current, ring)], columns=["datastream_id", "ring"])


def merge_area(stored: DataFrame, added: DataFrame) -> DataFrame:
    """Stored areas (datastream_id, observed_area) extended by new ones: the hull of both."""
    corners = stored.unionByName(added).where(F.col("observed_area").isNotNull()).select(
        "datastream_id", F.explode(F.flatten("observed_area.coords")).alias("p")
    )
    return hulls(
        corners.select("datastream_id", F.get("p", F.lit(0)).alias("x"), F.get("p", F.lit(1)).alias("y"))
    )


def set_area(datastreams: DataFrame, areas: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """Datastreams with new areas. Datastreams in ``among`` without an area get none."""
    both = _beside(datastreams, areas, "_new_")
    if among is None:
        fresh = F.coalesce("_new_observed_area", "observed_area")
    else:
        hit = among.select("datastream_id").distinct().withColumn("hit", F.lit(True))
        both = _beside(both, hit, "_")
        fresh = F.when(F.col("_hit"), F.col("_new_observed_area")).otherwise(F.col("observed_area"))
    return both.withColumn("observed_area", fresh).select(*datastreams.columns)


def update_last_feature(datastreams: DataFrame, obs: DataFrame) -> DataFrame:
    """Datastreams remember the feature of their latest stored observation (highest id)."""
    last = obs.groupBy("datastream_id").agg(
        F.max_by("feature_of_interest_id", "id").alias("last_foi_id")
    )
    both = _beside(datastreams, last, "_new_")
    return both.withColumn("last_foi_id", F.coalesce("_new_last_foi_id", "last_foi_id")).select(
        *datastreams.columns
    )
