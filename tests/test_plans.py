"""Shapes of the physical plans that decide whether a query survives scale."""

import re

import pytest
from pyspark.sql import functions as F

from sensorquery.catalog import Catalog
from sensorquery.functions import predicates as P
from sensorquery.operators import loading, mutations, quality, series, versions
from sensorquery.operators.query import Expand, Query
from sensorquery.plans.testbed import Testbed
from sensorquery.session import scratch_path
from sensorquery.sources import sinks


def plan(df) -> str:
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


@pytest.fixture
def t(spark, small):
    return Testbed(spark, small)


def test_filter_and_columns_reach_the_scan(t):
    q = Query.on(t.catalog(), "Observations").filter(
        lambda r: P.ge(r("phenomenonTime"), "2024-01-15T00:00:00Z") & P.gt(r("result"), 5)
    )
    text = plan(q.rows().select("id"))
    assert "GreaterThanOrEqual(ts,2024-01-15" in text and "GreaterThan(value,5.0)" in text
    assert re.search(r"ReadSchema: struct<event_id:bigint,ts:timestamp,value:double>", text)


def test_to_one_path_is_a_plain_join_and_keeps_the_time_filter(t):
    q = Query.on(t.catalog(), "Observations").filter(
        lambda r: P.eq(r("Datastream/name"), "ds-1") & P.ge(r("phenomenonTime"), "2024-01-15T00:00:00Z")
    )
    text = plan(q.rows().select("id"))
    assert "Inner" in text and "LeftSemi" not in text and "GreaterThanOrEqual(ts,2024-01-15" in text


def test_to_many_path_is_a_semi_join(t):
    q = Query.on(t.catalog(), "Things").filter(lambda r: P.eq(r("Datastreams/id"), 7))
    assert "LeftSemi" in plan(q.rows())


def test_children_are_trimmed_before_the_shuffle(t):
    rows = Query.on(t.catalog(), "Datastreams").expand_rows(Expand("Observations", top=5, count=True))
    text = plan(rows)
    assert text.count("WindowGroupLimit") >= 2


def test_totals_of_an_expansion_read_the_children_of_the_page_only(t):
    option = Expand("Observations", top=2, count=True)
    page = Query.on(t.catalog(), "Datastreams").top(2).expand(option)
    # Once for the children and once for their totals.
    assert plan(page.documents()).count("LeftSemi") >= 2


def test_a_count_shuffles_partial_counts_only(t):
    text = plan(Query.on(t.catalog(), "Observations").count_total())
    assert "hashpartitioning" not in text


def test_a_small_batch_moves_no_versions(t):
    versions_ = t.thing_versions()
    change = versions_.where(F.col("id") == 1).where(F.col("valid_to").isNull()).withColumn("action", F.lit("DELETE"))
    text = plan(versions.apply_changes("thing", versions_, change, "2002-01-01T00:00:00Z"))
    # One read with the changes beside the open rows, and ids only for what is new.
    assert "LeftOuter" in text and "LeftAnti" in text and "FullOuter" not in text
    assert "SortMergeJoin LeftOuter" not in text


def test_loads_prune_the_store_without_reading_the_batch_first(t):
    folder = scratch_path(t.spark, "store")
    sinks.write_observations(t.observations(), f"{folder}/observation")
    stored = Catalog.read(t.spark, folder).table("observation")
    batch = t.observations().where(F.col("phenomenon_start") < "2024-01-03")
    before = t.spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    rows = loading.missing_only(batch, stored)
    assert t.spark.sparkContext.statusTracker().getJobIdsForGroup(None) == before
    assert rows.count() == 0


def test_page_is_a_top_n(t):
    assert "TakeOrderedAndProject" in plan(Query.on(t.catalog(), "Things").order_by("name").top(5).page_rows())


def test_stored_observations_are_pruned_by_chunk(t):
    folder = scratch_path(t.spark, "pruned")
    sinks.write_observations(t.observations(), f"{folder}/observation")
    text = plan(Catalog.read(t.spark, folder).observations_between("2024-01-20T00:00:00Z", "2024-01-21T00:00:00Z"))
    assert re.search(r"PartitionFilters: \[[^\n]*chunk", text)
    assert "GreaterThanOrEqual(phenomenon_start" in text


def test_neighbours_do_not_gather_a_series(t):
    text = plan(series.neighbours(t.observations(), "datastream_id", "phenomenon_start", "id", "result_number"))
    assert "SinglePartition" not in text
    # The window over full rows is partitioned by series and chunk, never by the series alone.
    wide = [w for w in re.findall(r"Input \[[^\n]*parameters[^\n]*\n(?:Arguments: [^\n]*hashpartitioning\(([^)]*)\))", text)]
    assert wide and all("_chunk" in keys for keys in wide)


@pytest.mark.parametrize("name", ["run_qc", "delete", "iqr"])
def test_no_pairwise_joins(t, name):
    obs = t.observations()
    if name == "run_qc":
        df = quality.run_qc(obs.withColumn("kind", F.lit("rain")), "kind")
    elif name == "delete":
        df = mutations.delete_where(t.catalog(), lambda r: P.lt(r("result"), 3))[0].table("datastream")
    else:
        df = quality.outliers_iqr(obs)
    text = plan(df)
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_adaptive_execution_cannot_undo_the_patch_grouping(spark):
    """Small inputs used to lose the grouping by id; every document must see all its operations."""
    docs = spark.createDataFrame([(i, '{"n":0}') for i in range(40)], "id long, doc string")
    rows = [(i, s, "add", f"/k{s}", None, str(s)) for i in range(40) for s in range(5)]
    ops = spark.createDataFrame(rows, "id long, seq long, op string, path string, origin string, value string")
    done = mutations.json_patch(docs, ops.repartition(7)).collect()
    assert len(done) == 40 and {r.doc for r in done} == {'{"n":0,"k0":0,"k1":1,"k2":2,"k3":3,"k4":4}'}


def test_closed_versions_do_not_meet_in_one_task(t):
    held = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: t.spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            t.spark.conf.set(k, v)
        now = t.thing_versions()
        change = now.where(F.col("valid_to").isNull()).withColumn("action", F.lit("DELETE"))
        after = versions.apply_changes("thing", now, change, "2002-01-01T00:00:00Z")
        closed = after.where(F.col("valid_to") < "2002-01-01").withColumn("at", F.spark_partition_id())
        assert closed.select("at").distinct().count() > 1
    finally:
        for k, v in before.items():
            t.spark.conf.set(k, v)


def test_a_long_page_is_not_gathered_in_one_task(t, monkeypatch):
    q = Query.on(t.catalog(), "Observations").order_by("resultTime desc", "resultQuality")
    short = q.page_after(None, 60)
    assert "TakeOrderedAndProject" in plan(short)
    rows = short.collect()
    monkeypatch.setattr("sensorquery.operators.query.PAGE_ROWS", 10)
    long = q.page_after(None, 60)
    assert "TakeOrderedAndProject" not in plan(long) and "GlobalLimit" not in plan(long)
    assert long.columns == short.columns and long.collect() == rows
    assert q.page_after(rows[19].asDict(), 40).collect() == rows[20:]


def test_window_statistics_start_from_many_partitions(t):
    assert re.search(r"hashpartitioning\(datastream_id#\d+L, _block#\d+L, 1000\)", plan(quality.flag_zscore(t.observations())))
