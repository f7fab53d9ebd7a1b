"""Keyed stream state: restarts go on where they ended, initial state counts, only touched keys come out."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorquery.catalog import chunk_start
from sensorquery.streaming import keyed, state

LAYOUT = "id long, datastream_id long, phenomenon_start timestamp, result_number double"


def rows_of(spark, *rows):
    df = spark.createDataFrame([(i, d, t, float(i)) for i, d, t in rows], "id long, datastream_id long, s long, result_number double")
    return df.select("id", "datastream_id", F.timestamp_seconds("s").alias("phenomenon_start"), "result_number")


class Runs:
    """Each delivery is a run of its own over one folder and one checkpoint."""

    def __init__(self, spark, tmp_path, through, mode="append"):
        self.spark, self.path, self.through, self.mode, self.out = spark, tmp_path, through, mode, {}

    def run(self, *rows):
        rows_of(self.spark, *rows).write.mode("append").parquet(str(self.path / "in"))
        stream = self.through(self.spark.readStream.schema(LAYOUT).parquet(str(self.path / "in")))
        query = state.run_batches(stream, self.keep, str(self.path / "checkpoint"), mode=self.mode)
        query.awaitTermination()
        assert query.exception() is None
        return self.out[max(self.out)]

    def keep(self, batch, number):
        self.out[number] = [r.asDict() for r in batch.collect()]


def test_late_readings_are_judged_by_the_end_before_their_batch(spark, tmp_path):
    ends = rows_of(spark, (1, 1, 100), (2, 9, 5)).select(F.col("datastream_id").alias("id"), F.col("phenomenon_start").alias("phenomenon_end"))
    ends = ends.unionByName(spark.createDataFrame([(4, None)], "id long, phenomenon_end timestamp"))
    runs = Runs(spark, tmp_path, lambda s: keyed.newer_readings(s, ends))
    got = runs.run((10, 1, 90), (11, 1, 100), (12, 1, 110), (13, 1, 105), (14, 2, 1), (16, 1, 110), (15, 1, 110), (17, 4, 3))
    assert sorted(r["id"] for r in got) == [12, 13, 14, 17]
    assert sorted(r["id"] for r in runs.run((20, 1, 107), (21, 1, 111), (22, 2, 1))) == [21]
    assert sorted(r["id"] for r in runs.run((30, 9, 5), (31, 9, 6), (32, None, 7))) == [31]


def test_latest_lists_hold_n_and_come_out_for_touched_keys_only(spark, tmp_path):
    stored = rows_of(spark, (1, 1, 10), (2, 1, 20), (3, 7, 10))
    runs = Runs(spark, tmp_path, lambda s: keyed.latest_lists(s, 2, salts=1, stored=stored), mode="update")

    def lists(got):
        out = {}
        for r in got:
            out.setdefault(r["datastream_id"], []).append(int(r["doc"].split('"id":')[1].split(",")[0]))
        return out

    assert lists(runs.run((11, 1, 15), (12, 2, 5))) == {1: [2, 11], 2: [12]}
    assert lists(runs.run((13, 1, 20), (14, 1, 30))) == {1: [14, 2]}  # of equal times the smallest id
    assert lists(runs.run((15, 2, 1))) == {2: [12, 15]}


def test_salted_lists_merge_to_the_latest(spark, tmp_path):
    runs = Runs(spark, tmp_path, lambda s: keyed.latest_lists(s, 3, salts=4), mode="update")
    runs.run(*[(i, 1, i) for i in range(40)])
    runs.run((50, 1, 38), (51, 1, 60))
    flat = [(n, r["datastream_id"], r["salt"], r["doc"]) for n, rows in runs.out.items() for r in rows]
    lists = spark.createDataFrame(flat, "part int, datastream_id long, salt int, doc string")
    got = keyed.latest_of(lists, 3, LAYOUT)
    assert sorted(r.id for r in got.collect()) == [38, 39, 51]
    assert {str(r.phenomenon_start)[:4] for r in got.collect()} == {"1970"}


def test_a_bucket_holds_many_keys(spark, tmp_path):
    """One call into Python takes all keys of its bucket; each is judged on its own."""
    ends = rows_of(spark, (1, 1, 100), (2, 2, 5), (3, 2, 7)).select(
        F.col("datastream_id").alias("id"), F.col("phenomenon_start").alias("phenomenon_end"))
    late = Runs(spark, tmp_path / "late", lambda s: keyed.newer_readings(s, ends, buckets=1))
    assert sorted(r["id"] for r in late.run((10, 1, 100), (11, 2, 7), (12, 2, 8), (13, 3, 8), (14, 1, 101))) == [12, 13, 14]
    assert sorted(r["id"] for r in late.run((20, 1, 102), (21, 2, 8), (22, 3, 9))) == [20, 22]
    stored = rows_of(spark, (1, 1, 10), (2, 2, 10), (3, 2, 10), (4, 3, 10))
    runs = Runs(spark, tmp_path / "lists", lambda s: keyed.latest_lists(s, 2, salts=1, stored=stored, buckets=1), mode="update")
    runs.run((5, 1, 20), (6, 2, 5), (7, 2, 4))
    assert {r["datastream_id"] for r in runs.run((8, 2, 30))} == {2}
    flat = [(n, r["datastream_id"], r["salt"], r["doc"]) for n, rows in runs.out.items() for r in rows]
    lists = spark.createDataFrame(flat, "part int, datastream_id long, salt int, doc string")
    assert sorted(r.id for r in keyed.latest_of(lists, 2, LAYOUT).collect()) == [1, 2, 5, 8]


def test_the_session_gets_its_setting_back(spark):
    before = spark.conf.get(keyed.PROVIDER, None)
    with keyed.keyed_state(spark):
        assert spark.conf.get(keyed.PROVIDER) == keyed.ROCKSDB
    assert spark.conf.get(keyed.PROVIDER, None) == before


def test_missing_per_batch_prunes_the_store_and_the_parts_by_chunk(spark, tmp_path):
    day = 86400
    stored = rows_of(spark, (1, 1, 0), (2, 1, 400 * day)).withColumn("chunk", chunk_start(F.col("phenomenon_start")))
    stored.write.partitionBy("chunk").parquet(str(tmp_path / "stored"))
    held = spark.read.schema("datastream_id long, phenomenon_start timestamp, chunk date").parquet(str(tmp_path / "stored"))
    out = {}
    run = state.missing_per_batch(spark, held, lambda b, n: out.update({n: sorted(r.id for r in b.collect())}), str(tmp_path / "keys"))
    run(rows_of(spark, (10, 1, 0), (11, 1, 5), (12, 2, 0)), 0)
    run(rows_of(spark, (13, 1, 5), (14, 1, 400 * day), (15, 1, 401 * day)), 1)
    run(rows_of(spark, (13, 1, 5), (14, 1, 400 * day), (15, 1, 401 * day)), 1)  # again: the same
    assert out == {0: [11, 12], 1: [15]}
    read = []
    run = state.missing_per_batch(spark, held, lambda b, n: read.append(b._jdf.queryExecution().executedPlan().toString()), str(tmp_path / "keys"))
    run(rows_of(spark, (20, 1, 5)), 2)
    assert read[0].count("chunk") > 2 and all("PartitionFilters: [" in p and "chunk" in p for p in read[0].split("FileScan")[1:])
