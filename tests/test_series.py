"""Series operators against brute force, with one series holding most rows and chunks of any size."""

import random
from datetime import datetime, timedelta, timezone

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sensorquery.operators import identity, series
from sensorquery.operators.maintain import _hull, hulls

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


@pytest.fixture(scope="module")
def rows():
    """900 readings: a hot series, sparse ones, equal instants, gaps of many chunks, nulls."""
    rng = random.Random(7)
    out = []
    for i in range(900):
        key = 1 if i % 3 else rng.randint(2, 6)
        seconds = rng.choice([rng.randint(0, 40_000), rng.randint(0, 400) * 100, 9_000_000 + rng.randint(0, 5000)])
        out.append((i, key, START + timedelta(seconds=seconds), None if i % 11 == 0 else round(rng.gauss(20, 5), 1)))
    return out


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "id long, k long, ts timestamp, v double").repartition(5).cache()


@pytest.fixture(scope="module")
def frame(rows):
    return pd.DataFrame(rows, columns=["id", "k", "ts", "v"]).sort_values(["k", "ts", "id"])


@pytest.mark.parametrize("chunk", [60, 3600, 10_000_000])
def test_positions(df, frame, chunk):
    placed = series.positions(df, ["k"], ["ts", "id"], series.chunk_of(F.col("ts"), chunk))
    got = {r.id: r.pos for r in placed.collect()}
    assert got == dict(zip(frame["id"], frame.groupby("k").cumcount()))


@pytest.mark.parametrize("chunk", [60, 86_400])
def test_neighbours(df, frame, chunk):
    got = {r.id: (r.prev, r.next) for r in series.neighbours(df, "k", "ts", "id", "v", chunk_seconds=chunk).collect()}
    grouped = frame.groupby("k")["v"]
    clean = [
        (None if pd.isna(p) else p, None if pd.isna(n) else n) for p, n in zip(grouped.shift(1), grouped.shift(-1))
    ]
    assert got == dict(zip(frame["id"], clean))


@pytest.mark.parametrize("size, block", [(1, 1), (5, 7), (24, 24), (24, 1000)])
def test_trailing_rows(df, frame, size, block):
    got = series.trailing_rows(
        df.where("v IS NOT NULL"), "k", "ts", "id", size, {"m": F.avg("v"), "top": F.max("v")}, chunk_seconds=600, block=block
    ).collect()
    clean = frame.dropna()
    rolled = clean.groupby("k")["v"].rolling(size, min_periods=1)
    mean = dict(zip(clean["id"], rolled.mean()))
    top = dict(zip(clean["id"], rolled.max()))
    assert len(got) == len(clean)
    for r in got:
        assert r.m == pytest.approx(mean[r.id]) and r.top == top[r.id]


@pytest.mark.parametrize("seconds, splits", [(3600, 2), (3600, 24), (86_400, 24), (600, 60)])
def test_trailing_span(df, frame, seconds, splits):
    got = {r.id: r for r in series.trailing_span(df, "k", "ts", "v", seconds, splits=splits).collect()}
    assert len(got) == len(frame)
    width = pd.Timedelta(seconds=seconds)
    for _, part in frame.groupby("k"):
        times, values = part["ts"].to_numpy(), part["v"].to_numpy()
        for key, t in zip(part["id"], part["ts"]):
            inside = values[(times >= t - width) & (times <= t)]
            inside = inside[~np.isnan(inside)]
            r = got[key]
            assert r.n == len(inside)
            if len(inside):
                assert r.lowest == pytest.approx(inside.min()) and r.highest == pytest.approx(inside.max())
                assert r.mean == pytest.approx(inside.mean())
                assert r.m2 / r.n == pytest.approx(inside.var(), abs=1e-9)


def test_span_must_be_whole_blocks(df):
    with pytest.raises(ValueError):
        series.trailing_span(df, "k", "ts", "v", 100, splits=3_000_001)


@pytest.mark.parametrize("accuracy", [20, 100_000])
def test_exact_percentiles(spark, accuracy):
    """A low accuracy forces the bracket path; the result stays exact."""
    rng = np.random.default_rng(3)
    hot = np.round(rng.normal(0, 1, 4000), 2)
    data = [(1, float(v)) for v in hot] + [(1, 1e9)] * 3 + [(2, 5.0)] * 300 + [(3, float(i)) for i in range(10)]
    df = spark.createDataFrame(data, "k long, v double").repartition(6)
    probs = {"q1": 0.25, "mid": 0.5, "q3": 0.75, "low": 0.0, "high": 1.0}
    got = {r.k: r for r in series.exact_percentiles(df, ["k"], "v", probs, accuracy=accuracy).collect()}
    for key in (1, 2, 3):
        values = [v for k, v in data if k == key]
        for name, p in probs.items():
            assert got[key][name] == pytest.approx(np.percentile(values, p * 100), abs=1e-12)


@pytest.mark.parametrize("limit", [1, 5, 1200])
def test_top_per_key(spark, limit):
    data = [(i, 1 if i % 4 else 2, (i * 37) % 101) for i in range(5000)]
    df = spark.createDataFrame(data, "id long, k long, v long").repartition(7)
    got = series.top_per_key(df, ["k"], [F.col("v").desc(), F.col("id")], limit).collect()
    expected = set()
    for key in (1, 2):
        ranked = sorted((r for r in data if r[1] == key), key=lambda r: (-r[2], r[0]))[:limit]
        expected |= {(r[0], rank + 1) for rank, r in enumerate(ranked)}
    assert {(r.id, r.rn) for r in got} == expected


def test_global_positions_and_ids(spark):
    data = [(f"n{(i * 7919) % 2003:05d}", i) for i in range(2003)]
    df = spark.createDataFrame(data, "name string, x long").repartition(5)
    got = {r.name: r.id for r in identity.assign_ids(df, ["name"], 10).collect()}
    assert got == {name: 10 + i for i, name in enumerate(sorted(d[0] for d in data))}


def test_first_per_key(spark):
    data = [(i % 3, i % 7, i) for i in range(100)]
    df = spark.createDataFrame(data, "k long, o long, i long")
    got = {(r.k, r.o, r.i) for r in series.first_per_key(df, ["k"], ["o", "i"]).collect()}
    assert got == {min((d for d in data if d[0] == k), key=lambda d: (d[1], d[2])) for k in range(3)}


def test_unique_with_a_hot_key(spark):
    data = [(1, i) for i in range(500)] + [(k, 1000 + k) for k in range(2, 50)]
    df = spark.createDataFrame(data, "k long, o long").repartition(6)
    stored = spark.createDataFrame([(5,), (6,)], "k long")
    counts = {
        r.status: r["count"] for r in identity.enforce_unique(df, stored, ["k"], ["o"]).groupBy("status").count().collect()
    }
    assert counts == {"accepted": 47, "duplicate": 499, "exists": 2}


def test_hulls(spark):
    rng = random.Random(1)
    cloud = [(1, rng.uniform(-9, 9), rng.uniform(-9, 9)) for _ in range(500)]
    data = cloud + [(1, -10.0, -10.0), (1, 10.0, -10.0), (1, 10.0, 10.0), (1, -10.0, 10.0), (1, 0.0, -10.0)]
    data += [(2, 1.0, 1.0), (3, 0.0, 0.0), (3, 1.0, 1.0), (3, 2.0, 2.0), (4, 5.0, 5.0), (4, 5.0, 5.0)]
    df = spark.createDataFrame(data, "datastream_id long, x double, y double").repartition(7)
    got = {r.datastream_id: r.observed_area for r in hulls(df).collect()}
    assert got[1].type == "Polygon" and sorted(set(map(tuple, got[1].coords[0]))) == [
        (-10.0, -10.0), (-10.0, 10.0), (10.0, -10.0), (10.0, 10.0)
    ]
    assert got[1].coords[0][0] == got[1].coords[0][-1]
    assert got[2].type == "Point" and got[4].type == "Point"
    assert got[3].type == "LineString" and got[3].coords == [[[0.0, 0.0], [2.0, 2.0]]]


def test_hull_of_hulls():
    rng = random.Random(5)
    points = [(rng.randint(0, 20), rng.randint(0, 20)) for _ in range(200)]
    parts = _hull(points[:70]) + _hull(points[70:130]) + _hull(points[130:])
    assert _hull(parts) == _hull(points)
