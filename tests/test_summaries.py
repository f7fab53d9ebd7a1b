"""Summaries per datastream and chunk, equi-depth chunks, names of several tables at once, sketches."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from sensorquery import schema
from sensorquery.catalog import Catalog
from sensorquery.functions import geometry
from sensorquery.functions import predicates as P
from sensorquery.operators import identity, maintain, series, summaries
from sensorquery.sources import sinks

MONTH = 30 * 86400


def stored(spark, tmp_path, n=400):
    """Readings of three datastreams over eight chunks at eleven places, laid out by chunk."""
    rng = random.Random(3)
    rows = [(i, rng.randrange(3), rng.randrange(8) * MONTH + rng.randrange(MONTH), rng.randrange(11), float(rng.randrange(100))) for i in range(n)]
    obs = spark.createDataFrame(rows, "id long, datastream_id long, s long, feature_of_interest_id long, result_number double").select(
        "id", "datastream_id", F.timestamp_seconds("s").alias("phenomenon_start"), F.timestamp_seconds(F.col("s") + 5).alias("phenomenon_end"),
        F.timestamp_seconds("s").alias("result_time"), "feature_of_interest_id", "result_number", F.lit(0).alias("result_type"))
    sinks.write_observations(obs, str(tmp_path / "obs"), rows_per_file=100)
    obs = spark.read.schema(spark.createDataFrame([], obs.schema).withColumn("chunk", F.lit(None).cast("date")).schema).parquet(str(tmp_path / "obs"))
    places = spark.createDataFrame([(i, f'{{"type":"Point","coordinates":[{i * 7 % 11},{i * 5 % 11}]}}') for i in range(11)], "id long, g string").select(
        "id", geometry.from_geojson(F.col("g")).alias("feature"))
    streams = spark.createDataFrame([(i,) for i in range(4)], "id long")
    empty = lambda t: spark.createDataFrame([], schema.struct(t))
    tables = {"observation": obs, "feature_of_interest": places, "datastream": empty("datastream").unionByName(streams, allowMissingColumns=True),
              "location": empty("location")}
    return summaries.with_summaries(Catalog(spark, tables))


def whole(obs, features):
    """Extents and area of each datastream from all its readings."""
    return maintain.extents(obs).join(maintain.observed_area(obs, features), "datastream_id", "left")


def plain(df):
    return {r.datastream_id: (r.phenomenon_start, r.phenomenon_end, r.result_end, sorted(map(tuple, r.observed_area.coords[0]))) for r in df.collect()}


def test_deletes_by_summaries_equal_the_whole_computation(spark, tmp_path):
    catalog = stored(spark, tmp_path)
    features = catalog.table("feature_of_interest")
    assert plain(summaries.derived(catalog.table(summaries.TABLE))) == plain(whole(catalog.table("observation"), features))
    state, gone = summaries.delete_where(catalog, lambda r: P.gt(r("result"), 60))
    left = catalog.table("observation").where("result_number <= 60")
    assert gone.count() == catalog.table("observation").where("result_number > 60").count()
    assert state.table("observation").count() == left.count() and state.table("observation").columns == left.columns
    assert plain(summaries.derived(state.table(summaries.TABLE))) == plain(whole(left, features))
    want = {r.datastream_id: r.phenomenon_end for r in maintain.extents(left).collect()}
    assert {r.id: r.phenomenon_end for r in state.table("datastream").collect()} == {**want, 3: None}
    all_gone, _ = summaries.delete_where(state, lambda r: P.ge(r("result"), 0))
    assert all_gone.table(summaries.TABLE).count() == 0
    assert all_gone.table("datastream").where("phenomenon_start is not null or observed_area is not null").count() == 0
    by_place = summaries.delete_features(catalog, features.where("id in (1, 2)"))
    rest = catalog.table("observation").where("feature_of_interest_id not in (1, 2)")
    assert plain(summaries.derived(by_place.table(summaries.TABLE))) == plain(whole(rest, features))


def test_a_delete_reads_the_chunks_it_touched_only(spark, tmp_path):
    catalog = stored(spark, tmp_path)
    obs = catalog.table("observation")
    lost = obs.where("chunk = date '1970-01-31' and datastream_id = 1").select("id", "datastream_id", "chunk")
    state = summaries.after_delete(catalog, lost)
    plan = state.table(summaries.TABLE)._jdf.queryExecution().executedPlan().toString()
    reads = [p for p in plan.split("FileScan")[1:] if "1970-01-31" in p.split("ReadSchema")[0]]
    assert reads and all("PartitionFilters: [" in p for p in reads)
    untouched = state.table(summaries.TABLE).where("datastream_id <> 1 or chunk <> date '1970-01-31'")
    assert untouched.count() == catalog.table(summaries.TABLE).count() - 1


def test_inserts_merge_into_summaries(spark, tmp_path):
    catalog = stored(spark, tmp_path)
    obs, features = catalog.table("observation"), catalog.table("feature_of_interest")
    early = summaries.with_summaries(catalog.replace(observation=obs.where("id < 150")))
    state = summaries.add_to_summaries(early, obs.where("id >= 150"))
    got = {(r.datastream_id, r.chunk): (r.n, r.phenomenon_start, r.phenomenon_end) for r in state.table(summaries.TABLE).collect()}
    want = {(r.datastream_id, r.chunk): (r.n, r.phenomenon_start, r.phenomenon_end) for r in summaries.summarise(obs, features).collect()}
    assert got == want
    assert plain(summaries.derived(state.table(summaries.TABLE))) == plain(whole(obs, features))


def test_estimates_read_sketches_only(spark, tmp_path):
    obs = spark.range(60_000).select(
        "id", (F.col("id") % 2).alias("datastream_id"), F.timestamp_seconds(F.col("id") * 300).alias("phenomenon_start"))
    made = summaries.sketches(obs, "datastream_id")
    made.write.parquet(str(tmp_path / "s"))
    held = spark.read.parquet(str(tmp_path / "s"))
    got = summaries.estimate(held, "datastream_id")
    assert all(abs(r["count"] - 30_000) < 1500 for r in got.collect())
    part = summaries.estimate(held.where("chunk < date '1970-03-01'")).first()["count"]
    exact = summaries.with_chunk(obs).where("chunk < date '1970-03-01'").count()
    assert abs(part - exact) <= 0.06 * exact
    assert summaries.estimate(held.where("false"), "datastream_id").count() == 0


def test_a_fast_series_is_cut_by_its_rows(spark):
    """A kilohertz series beside a slow one: no group holds more than the bound and a second."""
    fast = spark.range(120_000).select(F.lit(1).cast("long").alias("k"), (F.col("id") * 1000 + 86_000_000_000 * 3).alias("us"), F.col("id").alias("tie"))
    slow = spark.range(500).select(F.lit(2).cast("long").alias("k"), (F.col("id") * 10_000_000_000).alias("us"), F.col("id").alias("tie"))
    df = fast.unionByName(slow).select("k", F.timestamp_micros("us").alias("t"), "tie", F.col("tie").cast("double").alias("v"))
    chunks = series.equi_depth_chunks(df, ["k"], "t", rows=5000).groupBy("k", "_chunk").count()
    sizes = {(r.k, r._chunk): r["count"] for r in chunks.collect()}
    assert max(sizes.values()) <= 6000 and sum(sizes.values()) == 120_500
    assert sum(n for (k, _), n in sizes.items() if k == 2) == 500
    got = series.neighbours(df, "k", "t", "tie", "v", rows=5000)
    wrong = got.where("not (prev <=> if(v > 0, v - 1, null)) or not (next <=> if(v < if(k = 1, 119999, 499), v + 1, null))")
    assert got.count() == 120_500 and wrong.count() == 0


def test_names_of_several_tables_get_ids_at_once(spark):
    tables = {
        "sensor": spark.createDataFrame([(4, "a"), (5, "twice"), (6, "twice")], "id long, name string"),
        "network": spark.createDataFrame([], "id long, name string"),
    }
    wanted = {
        "sensor": spark.createDataFrame([("a", (1,)), ("c", (2,)), ("b", (3,)), ("twice", (4,)), (None, (5,))], "name string, _row struct<x: int>"),
        "network": spark.createDataFrame([("n", (9,))], "name string, _row struct<x: int>"),
    }
    found, made = identity.get_or_create_all(wanted, tables)
    assert sorted(map(tuple, found.collect()), key=str) == [
        ("network", "n", 1), ("sensor", "a", 4), ("sensor", "b", 7), ("sensor", "c", 8), ("sensor", "twice", None)]
    assert sorted((r.id, r.name, r._row.x) for r in made["sensor"].collect()) == [(7, "b", 3), (8, "c", 2)]
