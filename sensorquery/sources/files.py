"""Station files, archives and series tables of text."""

from __future__ import annotations

import codecs
import posixpath
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from io import BytesIO, TextIOWrapper
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorquery.functions import values
from sensorquery.session import ship_functions


@dataclass(frozen=True)
class StationColumn:
    """Column of a station file: 0-based index, type (datetime, float, int, string), format, name."""

    idx: int
    type: str
    format: str | None = None
    name: str | None = None


@dataclass(frozen=True)
class StationConfig:
    """Layout of one set of station files. A null delimiter is found per line (tab, ``;``, ``,``)."""

    columns: tuple[StationColumn, ...]
    delimiter: str | None = None
    zone: str = "UTC"

    @property
    def time(self) -> StationColumn:
        found = [c for c in self.columns if c.type == "datetime"]
        if len(found) != 1:
            raise ValueError("exactly one datetime column is required")
        return found[0]

    @property
    def readings(self) -> list[StationColumn]:
        return [c for c in self.columns if c.type != "datetime" and c.name is not None]


_HELD = "\x01"  # stands for a delimiter inside quotes while a line is cut


def _cells(line: Column, delimiter: str | None) -> Column:
    """Cells of a line; a delimiter inside double quotes does not split. Every line is gone over a fixed
    number of times: in lines with quotes the delimiters of every second piece between them are covered
    up first."""

    def split(mark: str) -> Column:
        inside = lambda piece, i: F.when(i % 2 == 1, F.replace(piece, F.lit(mark), F.lit(_HELD))).otherwise(piece)
        covered = F.array_join(F.transform(F.split(line, '"', -1), inside), '"')
        cut = F.split(F.when(line.contains('"'), covered).otherwise(line), re.escape(mark), -1)
        plain = F.transform(cut, lambda c: F.regexp_replace(F.trim(c), r'^"(.*)"$', "$1"))
        return F.when(line.contains('"'), F.transform(plain, lambda c: F.replace(c, F.lit(_HELD), F.lit(mark)))).otherwise(plain)

    if delimiter is not None:
        return split(delimiter)
    return F.when(line.contains("\t"), split("\t")).when(line.contains(";"), split(";")).otherwise(
        split(",")
    )


def _timed(lines: DataFrame, cfg: StationConfig, column: str) -> DataFrame:
    """Lines that are not blank with ``_cells`` and the time, null where it cannot be read."""
    cells = lines.where(F.trim(column) != "").withColumn("_cells", _cells(F.col(column), cfg.delimiter))
    stamp = F.trim(F.get("_cells", F.lit(cfg.time.idx)))
    return cells.withColumn("phenomenon_start", values.parse_station_time(stamp, cfg.time.format, cfg.zone))


def parse_station_lines(lines: DataFrame, cfg: StationConfig, column: str = "value") -> DataFrame:
    """Lines to readings: ``name, phenomenon_start, result_number, result_string, result_quality``.

    Blank lines are skipped. Lines without a readable time and missing cells give no reading here;
    ``refused_station_lines`` returns them.
    """
    kept = [c for c in lines.columns if c != column]
    timed = _timed(lines, cfg, column).where(F.col("phenomenon_start").isNotNull())

    def reading(c: StationColumn) -> Column:
        raw = F.get("_cells", F.lit(c.idx))
        parsed = values.parse_station_value(raw, c.type)
        return F.when(
            raw.isNotNull(),
            F.struct(
                F.lit(c.name).alias("name"), parsed.number.alias("result_number"),
                parsed.text.alias("result_string"), parsed.quality.cast("string").alias("result_quality"),
            ),
        )

    wide = timed.withColumn("_r", F.explode(F.array(*[reading(c) for c in cfg.readings])))
    return wide.where(F.col("_r").isNotNull()).select(*kept, "phenomenon_start", "_r.*")


def refused_station_lines(lines: DataFrame, cfg: StationConfig, column: str = "value") -> DataFrame:
    """What the readings leave out, with a ``reason``: lines whose time is missing or cannot be read
    (``name`` null), and the cells that a line is too short to hold, one row each."""
    timed = _timed(lines, cfg, column)
    lost = F.when(F.size("_cells") <= cfg.time.idx, "no time").when(F.col("phenomenon_start").isNull(), "bad time")
    short = F.filter(
        F.array(*[F.when(F.size("_cells") <= c.idx, F.struct(F.lit(c.name).alias("name"), F.lit("missing cell").alias("reason")))
                  for c in cfg.readings]), lambda r: r.isNotNull())
    whole = F.array(F.struct(F.lit(None).cast("string").alias("name"), lost.alias("reason")))
    found = timed.withColumn("_lost", F.explode(F.when(lost.isNotNull(), whole).otherwise(short)))
    return found.select(*lines.columns, "_lost.name", "_lost.reason")


def read_station_files(spark: SparkSession, path: str, cfg: StationConfig) -> DataFrame:
    lines = spark.read.text(path).withColumn("file", F.input_file_name())
    return parse_station_lines(lines, cfg)


LINES_PER_BATCH = 20_000


def _wanted(archive: zipfile.ZipFile, suffixes: list[str]) -> Iterator[tuple[str, str]]:
    """(member, suffix) of the members whose name ends with a suffix, the first one that fits."""
    for member in archive.namelist():
        name = posixpath.basename(member)
        suffix = next((s for s in suffixes if name.endswith(s)), None)
        if suffix is not None and not member.endswith("/"):
            yield member, suffix


def _encoding(archive: zipfile.ZipFile, member: str) -> str:
    """UTF-8 (with or without a mark) if the whole member reads as that, else Latin-1; read in pieces."""
    decoder = codecs.getincrementaldecoder("utf-8")()
    with archive.open(member) as stream:
        try:
            while piece := stream.read(1 << 20):
                decoder.decode(piece)
            decoder.decode(b"", True)
        except UnicodeDecodeError:
            return "latin-1"
    return "utf-8-sig"


def _lines(archive: zipfile.ZipFile, path: str, member: str, suffix: str) -> Iterator[pd.DataFrame]:
    """The lines of a member in batches; the member is never whole in memory."""
    number = 0
    with archive.open(member) as raw, TextIOWrapper(raw, _encoding(archive, member), newline=None) as text:
        while batch := list(islice(text, LINES_PER_BATCH)):
            lines = [line.removesuffix("\n") for line in batch]
            yield pd.DataFrame({
                "path": path, "member": member, "suffix": suffix, "line": range(number, number + len(lines)), "value": lines})
            number += len(lines)


def _unzip(suffixes: list[str]):
    """Lines of archives given by their content."""

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                with zipfile.ZipFile(BytesIO(content)) as archive:
                    for member, suffix in _wanted(archive, suffixes):
                        yield from _lines(archive, path, member, suffix)

    return members


def _open(path: str):
    from pyarrow import fs

    if path.startswith("file:/") and not path.startswith("file://"):
        path = path.removeprefix("file:")
    store, inner = fs.FileSystem.from_uri(path)
    return store.open_input_file(inner)


def _list_members(suffixes: list[str]):
    """(path, member, suffix, size); of an archive only the directory at its end is read."""

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                with _open(path) as handle, zipfile.ZipFile(handle) as archive:
                    found = [(path, m, s, archive.getinfo(m).file_size) for m, s in _wanted(archive, suffixes)]
                yield pd.DataFrame(found, columns=["path", "member", "suffix", "size"])

    return listed


def _read_members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, member, suffix in zip(batch["path"], batch["member"], batch["suffix"]):
            with _open(path) as handle, zipfile.ZipFile(handle) as archive:
                yield from _lines(archive, path, member, suffix)


_LINE = "path string, member string, suffix string, line long, value string"


def archive_members(spark: SparkSession, path: str, suffixes: list[str]) -> DataFrame:
    """(path, member, suffix, size) of the wanted members of the zip archives in a folder."""
    archives = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path", "length")
    # Small files share a partition when they are listed; every archive may go to another task.
    return archives.repartition("path").mapInPandas(_list_members(suffixes), "path string, member string, suffix string, size long")


def read_zipped_files(spark: SparkSession, path: str, suffixes: list[str]) -> DataFrame:
    """Lines of the archive members whose name ends with a suffix: ``path, member, suffix, line,
    value``.

    Members, not archives, are dealt to the tasks, which open them by path (any store that pyarrow
    opens) and stream their lines: neither an archive nor a member is ever whole in memory. Where only
    Spark can open the store, ``unzip_lines`` takes the content that Spark has read.
    """
    members = archive_members(spark, path, suffixes)
    dealt = members.repartition(F.xxhash64("path", "member")).select("path", "member", "suffix")
    return dealt.mapInPandas(_read_members, _LINE)


def unzip_lines(archives: DataFrame, suffixes: list[str]) -> DataFrame:
    """Lines of zip archives given as (path, content): an archive is a value of a row, its members are
    streamed."""
    return archives.select("path", "content").mapInPandas(_unzip(suffixes), _LINE)


def read_zipped_stations(
    spark: SparkSession, path: str, configs: dict[str, StationConfig]
) -> DataFrame:
    """Readings of zipped station files, one layout per member suffix."""
    return parse_zipped_stations(read_zipped_files(spark, path, list(configs)), configs)


def parse_zipped_stations(lines: DataFrame, configs: dict[str, StationConfig]) -> DataFrame:
    """Readings of unzipped lines, by the layout of their suffix."""
    parts = [
        parse_station_lines(lines.where(F.col("suffix") == suffix), cfg)
        for suffix, cfg in configs.items()
    ]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union


def _series_rows(spark: SparkSession, path: str, datastream_id: int) -> DataFrame:
    layout = "time string, skipped string, value string, quality string"
    raw = spark.read.schema(layout).option("header", True).option("enforceSchema", True).csv(path)
    return raw.select(
        F.lit(datastream_id).cast("long").alias("datastream_id"), F.try_to_timestamp("time").alias("phenomenon_start"),
        F.col("time"), F.col("value").alias("text"), F.col("value").try_cast("double").alias("result_number"),
        F.col("quality").alias("result_quality"))


def read_series_csv(spark: SparkSession, path: str, datastream_id: int) -> DataFrame:
    """Series table with a header: time, (ignored), value, quality. The time is also resultTime.
    ``loading.clamp`` bounds a load by time; ``refused_series_rows`` returns the rows without a time."""
    rows = _series_rows(spark, path, datastream_id).where(F.col("phenomenon_start").isNotNull())
    t = F.col("phenomenon_start")
    return rows.select(
        "datastream_id", t, t.alias("phenomenon_end"), t.alias("result_time"), "result_number", "result_quality")


def refused_series_rows(spark: SparkSession, path: str, datastream_id: int) -> DataFrame:
    """(datastream_id, time, value, reason) of the rows whose time is missing or cannot be read."""
    reason = F.when(F.col("time").isNull(), "no time").otherwise("bad time")
    return _series_rows(spark, path, datastream_id).where(F.col("phenomenon_start").isNull()).select(
        "datastream_id", "time", F.col("text").alias("value"), reason.alias("reason"))


ship_functions(__name__)
