"""Quality control and outlier analytics over observation series."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorquery.functions.scalars import json_path
from sensorquery.operators import series

# Flags of the tests, in the order in which they are tried.
FLAG_MISSING, FLAG_CONSTANT, FLAG_ZSCORE, FLAG_RANGE = 90, 91, 92, 93
GOOD = 100

VALUE, TIME, KEY = "result_number", "phenomenon_start", "datastream_id"


@dataclass(frozen=True)
class Rule:
    """Tests for one kind of datastream; ``None`` switches a test off."""

    constant: float | None = None
    zscore: float | None = None
    low: float | None = None
    high: float | None = None
    range_flag: int = FLAG_RANGE


# Limits per kind of datastream.
RULES = {
    "temperature": Rule(constant=0.1, zscore=3.0, low=-20.0, high=50.0),
    "humidity": Rule(constant=0.1, zscore=3.0, low=0.0, high=100.0),
    "rain": Rule(low=0.2, high=0.2, range_flag=FLAG_CONSTANT),
}


def _present() -> Column:
    return F.col(VALUE).isNotNull() & ~F.isnan(VALUE)


def is_missing() -> Column:
    return F.col(VALUE).isNull() | F.isnan(VALUE)


def out_of_range(low: float, high: float) -> Column:
    return F.coalesce(~F.col(VALUE).between(low, high), F.lit(False)) & ~is_missing()


def flag_missing(obs: DataFrame) -> DataFrame:
    return obs.withColumn("flag", F.when(is_missing(), FLAG_MISSING))


def flag_range(obs: DataFrame, low: float, high: float, flag: int = FLAG_RANGE) -> DataFrame:
    return obs.withColumn("flag", F.when(out_of_range(low, high), flag))


def with_day_statistics(obs: DataFrame, seconds: int = series.DAY, splits: int = 24) -> DataFrame:
    """Adds the statistics of the trailing window over present readings."""
    clean = obs.withColumn("_clean", F.when(_present(), F.col(VALUE)))
    return series.trailing_span(clean, KEY, TIME, "_clean", seconds, splits=splits)


_STATISTICS = ("_clean", "n", "mean", "m2", "lowest", "highest")


def is_constant(threshold: float) -> Column:
    """At least two present readings in the window, within the threshold of each other."""
    return (F.col("n") >= 2) & (F.col("highest") - F.col("lowest") <= threshold) & _present()


def zscore_of_window() -> Column:
    """Deviation of the reading from its window, in population standard deviations."""
    variance = F.col("m2") / F.when(F.col("n") > 0, F.col("n"))
    return (F.col("_clean") - F.col("mean")) / F.sqrt(F.when(variance > 0, variance))


def is_deviant(threshold: float) -> Column:
    return F.coalesce(F.abs(zscore_of_window()) > threshold, F.lit(False))


def flag_constants(obs: DataFrame, threshold: float = 0.1, seconds: int = series.DAY) -> DataFrame:
    flagged = with_day_statistics(obs, seconds).withColumn(
        "flag", F.when(is_constant(threshold), FLAG_CONSTANT)
    )
    return flagged.drop(*_STATISTICS)


def flag_zscore(obs: DataFrame, threshold: float = 3.0, seconds: int = series.DAY) -> DataFrame:
    flagged = with_day_statistics(obs, seconds).withColumn(
        "flag", F.when(is_deviant(threshold), FLAG_ZSCORE)
    )
    return flagged.drop(*_STATISTICS)


def run_qc(obs: DataFrame, kind: str, rules: dict[str, Rule] = RULES) -> DataFrame:
    """One ``flag`` per reading, the first failing test of its kind (column ``kind``); null is good.

    All kinds share one pass over the window statistics; kinds without a rule are only tested for
    missing values.
    """
    flag = F.when(is_missing(), FLAG_MISSING)

    def of(name: str) -> Column:
        return F.col(kind) == name

    for name, rule in rules.items():
        if rule.constant is not None:
            flag = flag.when(of(name) & is_constant(rule.constant), FLAG_CONSTANT)
        if rule.zscore is not None:
            flag = flag.when(of(name) & is_deviant(rule.zscore), FLAG_ZSCORE)
        if rule.low is not None:
            flag = flag.when(of(name) & out_of_range(rule.low, rule.high), rule.range_flag)
    return with_day_statistics(obs).withColumn("flag", flag).drop(*_STATISTICS)


def flag_changes(flagged: DataFrame) -> DataFrame:
    """Change set that writes the flags back as the result quality of the flagged readings."""
    return flagged.where(F.col("flag").isNotNull()).select(
        "id", F.array(F.lit("result_quality")).alias("present"),
        F.col("flag").cast("string").alias("result_quality"),
    )


def outliers_iqr(obs: DataFrame) -> DataFrame:
    """Readings outside [Q1 - 1.5 IQR, Q3 + 1.5 IQR] of their datastream, with the bounds."""
    quartiles = series.exact_percentiles(obs, [KEY], VALUE, {"q1": 0.25, "q3": 0.75})
    spread = F.col("q3") - F.col("q1")
    bounds = quartiles.select(
        KEY, (F.col("q1") - 1.5 * spread).alias("low"), (F.col("q3") + 1.5 * spread).alias("high")
    )
    value = F.col(VALUE)
    return obs.join(bounds, KEY).where((value < F.col("low")) | (value > F.col("high")))


def _moments(obs: DataFrame, deviation) -> DataFrame:
    return obs.where(_present()).groupBy(KEY).agg(
        F.avg(VALUE).alias("mean"), deviation(VALUE).alias("deviation")
    )


def outliers_zscore(obs: DataFrame, threshold: float = 3.0) -> DataFrame:
    """Readings more than ``threshold`` population deviations from the mean of their datastream."""
    scored = obs.join(_moments(obs, F.stddev_pop), KEY)
    score = (F.col(VALUE) - F.col("mean")) / F.when(F.col("deviation") > 0, F.col("deviation"))
    return scored.withColumn("zscore", score).where(F.abs("zscore") > threshold)


def null_outliers(obs: DataFrame, threshold: float = 3.0) -> DataFrame:
    """Readings beyond ``threshold`` sample deviations become null."""
    scored = obs.join(_moments(obs, F.stddev_samp), KEY, "left")
    score = (F.col(VALUE) - F.col("mean")) / F.when(F.col("deviation") > 0, F.col("deviation"))
    keep = ~F.coalesce(F.abs(score) > threshold, F.lit(False))
    return scored.withColumn(VALUE, F.when(keep, F.col(VALUE))).select(*obs.columns)


def split_quality(obs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, flagged) readings by their numeric quality. What is not known to be good is flagged: a
    missing quality, or one that is no number."""
    good = F.coalesce(F.col("result_quality").try_cast("int") >= GOOD, F.lit(False))
    return obs.where(good), obs.where(~good)


def flatten_props(df: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """Members of a JSON column as columns of their own; nested ones as ``a/b``."""
    return df.withColumns({k: json_path(F.col(column), *k.split("/")) for k in keys})


def rolling_mean(obs: DataFrame, size: int = 24) -> DataFrame:
    """Mean over each reading and those before it; heads with fewer than ``size`` are dropped."""
    smoothed = series.trailing_rows(
        obs, KEY, TIME, "id", size, {"rolling_mean": F.avg(VALUE)}
    )
    return smoothed.where(F.col("rows_in_frame") == size).drop("rows_in_frame")


def repair_neighbours(obs: DataFrame, flag: Column, chunk_seconds: int = series.DAY) -> DataFrame:
    """Flagged readings become the mean of the readings before and after them."""
    beside = series.neighbours(obs, KEY, TIME, "id", VALUE, chunk_seconds=chunk_seconds)
    repaired = F.when(flag, (F.col("prev") + F.col("next")) / 2).otherwise(F.col(VALUE))
    return beside.withColumn("repaired", repaired).drop("prev", "next")
