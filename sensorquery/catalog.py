"""Tables of the data model, read now, at an instant, or over a span of validity."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorquery import schema
from sensorquery.functions.predicates import valid_at, valid_overlaps
from sensorquery.functions.values import Interval

VERSION_COLUMNS = ("valid_from", "valid_to", "commit_id")
CLOSED_MONTH = "closed_month"  # partition of a history: the month in which a version ended
_VERSION_DDL = "valid_from timestamp, valid_to timestamp, commit_id long"


class Catalog:
    """Named tables with an optional point (``as_of``) or span (``from_to``) of validity.

    A versioned table carries ``valid_from``, ``valid_to`` (null while valid) and ``commit_id``;
    a plain table has no versions and is the same at every instant.
    """

    def __init__(
        self,
        spark: SparkSession,
        tables: dict[str, DataFrame | Callable[[], DataFrame]],
        *,
        history: dict[str, DataFrame] | None = None,
        instant: str | None = None,
        span: tuple[str, str] | None = None,
    ):
        self.spark = spark
        self._tables = dict(tables)
        self._history = history or {}
        self.instant = instant
        self.span = span

    @classmethod
    def read(cls, spark: SparkSession, path: str, *, versioned: bool = False) -> Catalog:
        """Parquet tables ``path/<table>`` with the fixed schema; nothing is inferred."""

        def reader(name: str) -> Callable[[], DataFrame]:
            ddl = schema.TABLES[name]
            if versioned and name in schema.VERSIONED:
                ddl = f"{ddl}, {_VERSION_DDL}"
            if name == "observation":
                ddl = f"{ddl}, chunk date"
            return lambda: spark.read.schema(ddl).parquet(f"{path}/{name}")

        return cls(spark, {name: reader(name) for name in schema.TABLES})

    def names(self) -> list[str]:
        return list(self._tables)

    def has(self, name: str) -> bool:
        return name in self._tables

    def _stored(self, name: str) -> DataFrame:
        stored = self._tables[name]
        df = stored() if callable(stored) else stored
        self._tables[name] = df
        return df

    def _closed(self, past: DataFrame, since: str | None) -> DataFrame:
        """Closed versions that were still valid at ``since``; only the months of closing from then on
        are read where the history is laid out by them (``versions.append_history``)."""
        closed = past.where(F.col("valid_to").isNotNull())
        if CLOSED_MONTH not in past.columns:
            return closed
        if since is not None:
            closed = closed.where(F.col(CLOSED_MONTH) >= self._moment(since).date().replace(day=1))
        return closed.drop(CLOSED_MONTH)

    def _versions(self, name: str, since: str | None = None) -> DataFrame:
        df, past = self._stored(name), self._history.get(name)
        if past is None:
            return df
        if "valid_to" not in df.columns:
            return df.unionByName(past).distinct()
        return df.where(F.col("valid_to").isNull()).unionByName(self._closed(past, since))

    def traveltime(self, name: str) -> DataFrame:
        """All versions of a table, each once.

        Where a history is kept beside the table, the table counts for the open versions and the history
        for the closed ones, so the two are disjoint and nothing has to be compared. Tables without
        validity are united as sets.
        """
        return self._versions(name)

    def table(self, name: str) -> DataFrame:
        """Rows of a table at the catalog's instant, in its span, or valid now."""
        df = self._stored(name)
        if "valid_to" not in df.columns:
            return self._versions(name)
        validity = Interval(F.col("valid_from"), F.col("valid_to"), "validity")
        if self.instant is not None:
            return self._versions(name, self.instant).where(valid_at(validity, self.instant))
        if self.span is not None:
            return self._versions(name, self.span[0]).where(valid_overlaps(validity, *self.span))
        return df.where(F.col("valid_to").isNull())

    def _moment(self, value) -> datetime:
        t = value if isinstance(value, datetime) else datetime.fromisoformat(value)
        if t.tzinfo is None:
            t = t.replace(tzinfo=ZoneInfo(self.spark.conf.get("spark.sql.session.timeZone")))
        return t.astimezone(timezone.utc)

    def _with(self, **changes) -> Catalog:
        state = {
            "tables": self._tables, "history": self._history,
            "instant": self.instant, "span": self.span, **changes,
        }
        return Catalog(self.spark, state.pop("tables"), **state)

    def as_of(self, t) -> Catalog:
        """State at an instant. A time without a zone is local; the future is refused."""
        if self.span is not None:
            raise ValueError("as_of cannot be combined with from_to")
        moment = self._moment(t)
        if moment > datetime.now(timezone.utc):
            raise ValueError("as_of lies in the future")
        return self._with(instant=moment.isoformat())

    def from_to(self, start, end) -> Catalog:
        """All versions that overlap the half-open span."""
        if self.instant is not None:
            raise ValueError("from_to cannot be combined with as_of")
        lo, hi = self._moment(start), self._moment(end)
        if lo > hi:
            raise ValueError("from_to starts after it ends")
        return self._with(span=(lo.isoformat(), hi.isoformat()))

    def replace(self, **tables: DataFrame) -> Catalog:
        """Catalog with new states of some tables."""
        return self._with(tables={**self._tables, **tables})

    def observations_between(self, start: str | None = None, end: str | None = None) -> DataFrame:
        """Observations that start in [start, end]; prunes the 30-day chunks of the stored table."""
        df = self.table("observation")
        for bound, op in ((start, "ge"), (end, "le")):
            if bound is None:
                continue
            t = F.lit(bound).cast("timestamp")
            df = df.where(F.col("phenomenon_start") >= t if op == "ge" else F.col("phenomenon_start") <= t)
            if "chunk" in df.columns:
                edge = chunk_start(t)
                df = df.where(F.col("chunk") >= edge if op == "ge" else F.col("chunk") <= edge)
        return df

    def register_views(self) -> None:
        for name in self._tables:
            self.table(name).createOrReplaceTempView(name)


def chunk_start(t):
    """First day of the time chunk of an instant."""
    days = F.datediff(F.to_date(t), F.lit("1970-01-01").cast("date"))
    return F.date_add(F.lit("1970-01-01").cast("date"), days - F.pmod(days, F.lit(schema.CHUNK_DAYS)))
