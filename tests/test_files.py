"""Station lines, archives, message logs, version layout and file sizes."""

from __future__ import annotations

import io
import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from sensorquery.catalog import Catalog
from sensorquery.operators import versions
from sensorquery.sources import files, message_log, sinks
from sensorquery.streaming import state


def test_cells_of_quoted_and_long_lines(spark):
    lines = ['a;"b;c";d', '"x;y";;"z"', 'plain;;', '"a ""b"" c";d', "one"]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    got = [r[0] for r in df.select(files._cells(F.col("value"), ";")).collect()]
    assert got == [["a", "b;c", "d"], ["x;y", "", "z"], ["plain", "", ""], ['a ""b"" c', "d"], ["one"]]
    tabs = spark.createDataFrame([('1\t"2\t3"\t4;5,6',), ('1;"2;3",4',), ('1,"2,3",4',)], "value string")
    assert [r[0] for r in tabs.select(files._cells(F.col("value"), None)).collect()] == [
        ["1", "2\t3", "4;5,6"], ["1", '"2;3",4'], ["1", "2,3", "4"]]
    # A line of 400,000 cells: the look-ahead of a regular expression would go over the rest once per cell.
    wide = spark.createDataFrame([(";".join(['"1;2"'] * 400_000),)], "value string")
    assert wide.select(F.size(files._cells(F.col("value"), ";"))).first()[0] == 400_000


STATION = files.StationConfig((files.StationColumn(0, "datetime"), files.StationColumn(1, "float", name="x"), files.StationColumn(2, "int", name="y")), ";")


def test_readings_and_refused_lines_are_all_that_came(spark):
    rows = ["2024-01-01T00:00:00Z;1;2", "noon;1;2", "2024-01-01T00:00:00Z;1", "2024-01-01T00:00:00Z", "", "  ", ";1;2"]
    df = spark.createDataFrame(list(enumerate(rows)), "nr long, value string")
    read = sorted((r.nr, r.name) for r in files.parse_station_lines(df, STATION).collect())
    lost = sorted((r.nr, r.name or "", r.reason) for r in files.refused_station_lines(df, STATION).collect())
    assert read == [(0, "x"), (0, "y"), (2, "x")]
    assert lost == [(1, "", "bad time"), (2, "y", "missing cell"), (3, "x", "missing cell"), (3, "y", "missing cell"), (6, "", "bad time")]


def test_archive_members_by_path(spark, tmp_path):
    texts = {
        "a/one_level.txt": "﻿ä;1\nb;2\n".encode(), "two_level.txt": "ü;3\r\n\r\nlast".encode("latin-1"),
        "empty_level.txt": b"", "other.md": b"no",
    }
    with zipfile.ZipFile(tmp_path / "x.zip", "w", zipfile.ZIP_DEFLATED) as archive:
        for name, content in texts.items():
            archive.writestr(name, content)
    with zipfile.ZipFile(tmp_path / "none.zip", "w") as archive:
        archive.writestr("readme.md", "no")
    (tmp_path / "y.txt").write_text("no archive")
    want = {("a/one_level.txt", 0, "ä;1"), ("a/one_level.txt", 1, "b;2"), ("two_level.txt", 0, "ü;3"), ("two_level.txt", 1, ""), ("two_level.txt", 2, "last")}
    by_path = files.read_zipped_files(spark, str(tmp_path), ["_level.txt"])
    assert {(r.member, r.line, r.value) for r in by_path.collect()} == want
    content = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(str(tmp_path))
    assert {(r.member, r.line, r.value) for r in files.unzip_lines(content, ["_level.txt"]).collect()} == want
    sizes = {r.member: r.size for r in files.archive_members(spark, str(tmp_path), ["_level.txt"]).collect()}
    assert sizes["empty_level.txt"] == 0 and len(sizes) == 3


def test_a_large_member_is_read_in_batches(monkeypatch):
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr("m.txt", "\n".join(str(i) for i in range(1000)))
    monkeypatch.setattr(files, "LINES_PER_BATCH", 300)
    with zipfile.ZipFile(packed) as archive:
        parts = list(files._lines(archive, "p", "m.txt", ".txt"))
    assert [len(p) for p in parts] == [300, 300, 300, 100]
    assert [v for p in parts for v in p["line"]] == list(range(1000)) and parts[-1]["value"].iloc[-1] == "999"


@pytest.mark.parametrize("size", [1, 2, 3, 5, 7, 64])
def test_every_line_lies_in_exactly_one_range(size, monkeypatch):
    monkeypatch.setattr(message_log, "_CHUNK", 4)
    text = b"a\n\nlong line here\nb\nlast"
    handle = io.BytesIO(text)
    end = message_log.complete_bytes(handle, 0, len(text))
    assert text[:end] == b"a\n\nlong line here\nb\n" and message_log.complete_bytes(handle, end, len(text)) == end
    got = [x for at in range(0, end, size) for x in message_log.lines_from(handle, at, min(at + size, end))]
    assert got == [(0, b"a\n"), (2, b"\n"), (3, b"long line here\n"), (18, b"b\n")]


def test_a_growing_log_is_read_once_across_restarts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(message_log, "PART_BYTES", 40)
    log, seen = tmp_path / "logs" / "in" / "a.log", []
    os.makedirs(log.parent)

    def run():
        stream = message_log.read_log(spark, str(tmp_path / "logs"))
        query = state.run_batches(stream, lambda b, n: seen.extend((r.topic, r.payload, r.position) for r in b.collect()), str(tmp_path / "ck"))
        query.awaitTermination()
        assert query.exception() is None

    line = lambda i: json.dumps({"topic": "t", "payload": f"ü{i}"}, ensure_ascii=False)
    log.write_text(line(0) + "\n" + line(1) + "\nno json\n" + line(2)[:7])
    run()
    assert [(t, p) for t, p, _ in seen] == [("t", "ü0"), ("t", "ü1"), (None, "no json")]
    run()
    assert len(seen) == 3
    with open(log, "a") as out:
        out.write(line(2)[7:] + "\n" + '{"topic": "u", "payload": {"a": 1}}\n{"payload": 3}\n')
    (log.parent / "b.log").write_text(line(9) + "\n")
    run()
    assert sorted((str(t), p) for t, p, _ in seen[3:]) == [("None", '{"payload": 3}'), ("t", "ü2"), ("t", "ü9"), ("u", '{"a": 1}')]


def test_versions_are_united_without_a_comparison_and_pruned_by_month(spark, tmp_path):
    layout = "id long, name string, valid_from timestamp, valid_to timestamp, commit_id long"
    rows = spark.createDataFrame(
        [(1, "a", 0, 10, 1), (1, "b", 10, 100 * 86400, 2), (1, "c", 100 * 86400, None, 3), (2, "d", 5, None, 1)],
        "id long, name string, f long, t long, commit_id long").select(
        "id", "name", F.timestamp_seconds("f").alias("valid_from"), F.timestamp_seconds("t").alias("valid_to"), "commit_id")
    path = str(tmp_path / "history")
    versions.append_history(rows, path)  # open versions do not enter it
    open_rows = rows.where("valid_to is null")
    catalog = Catalog(spark, {"thing": open_rows}, history={"thing": versions.read_history(spark, path, layout)})
    every = catalog.traveltime("thing")
    assert every.columns == open_rows.columns and sorted(r.name for r in every.collect()) == ["a", "b", "c", "d"]
    assert "Exchange" not in every._jdf.queryExecution().executedPlan().toString()
    past = catalog.as_of("1970-02-01T00:00:00Z").table("thing")
    assert sorted(r.name for r in past.collect()) == ["b", "d"]
    plan = past._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(closed_month" in plan
    assert sorted(r.name for r in catalog.table("thing").collect()) == ["c", "d"]
    span = catalog.from_to("1970-01-01T00:00:05Z", "1970-01-01T00:00:20Z").table("thing")
    assert sorted(r.name for r in span.collect()) == ["a", "b", "d"]


def test_files_follow_the_rows_not_the_session(spark, tmp_path):
    obs = spark.range(1000).select(
        "id", (F.col("id") % 3).alias("datastream_id"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id")).alias("phenomenon_start"))
    counts = []
    for partitions in ("2", "16"):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        path = str(tmp_path / partitions)
        sinks.write_observations(obs, path, rows_per_file=100)
        spark.conf.set("spark.sql.shuffle.partitions", before)
        sizes = [r["count"] for r in spark.read.parquet(path).groupBy(F.input_file_name()).count().collect()]
        assert sum(sizes) == 1000 and max(sizes) <= 200
        counts.append(len(sizes))
    assert abs(counts[0] - counts[1]) <= 2


def test_message_logs_are_as_many_as_their_lines_need(spark, small, monkeypatch):
    from pathlib import Path

    from sensorquery.plans import streams
    from sensorquery.plans.testbed import Testbed
    from sensorquery.session import shared_folder

    folder, t = Path(shared_folder(spark).removeprefix("file:")), Testbed(spark, small)
    want = sorted(map(tuple, streams.src_08_log(t).collect()), key=repr)
    before = set(folder.glob("logs-*"))
    monkeypatch.setattr(streams, "LOG_ROWS", 100)
    got = sorted(map(tuple, streams.src_08_log(t).collect()), key=repr)
    (logs,) = set(folder.glob("logs-*")) - before
    assert got == want and len(list(logs.glob("*.log"))) > 3


def test_citizen_documents_are_dealt_to_many_tasks(spark, small, monkeypatch):
    from sensorquery.plans import ingest
    from sensorquery.plans.testbed import Testbed

    t = Testbed(spark, small)
    want = sorted(r.doc for r in ingest.citizen_docs(t).collect())
    monkeypatch.setattr(ingest, "DOCS_PER_PART", 10)
    docs = ingest.citizen_docs(t)
    assert docs.rdd.getNumPartitions() > 1 and sorted(r.doc for r in docs.collect()) == want
