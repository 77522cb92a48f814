"""The fail-closed quality gate over daily candles."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.indicators import by_key
from tidemark.schemas import KEY


def invalid_ohlc() -> Column:
    """True if a bar can't be: no positive close, high below low, or a close more than 0.1 % outside them.

    A bar without a high or a low can only be judged by its close.
    """
    outside = (F.col("close") > F.col("high") * 1.001) | (F.col("close") < F.col("low") * 0.999)
    ranged = F.col("high").isNotNull() & F.col("low").isNotNull()
    return F.coalesce(F.col("close") <= 0, F.lit(True)) | (ranged & ((F.col("high") < F.col("low")) | outside))


def anomaly(max_daily_jump: float, zero_volume_min_avg_volume: float) -> Column:
    """The first that applies: invalid_ohlc, jump (of the adjusted close), zero_volume (where volume was usual)."""
    before = F.lag("adj_close").over(by_key())
    jump = F.when(before > 0, F.abs(F.col("adj_close") / before - 1) > max_daily_jump)
    usual = F.avg(F.coalesce(F.col("volume"), F.lit(0)).cast("double")).over(by_key().rowsBetween(-20, -1))
    silent = (F.coalesce(F.col("volume"), F.lit(0)) == 0) & (usual >= zero_volume_min_avg_volume)
    return F.when(invalid_ohlc(), "invalid_ohlc").when(jump, "jump").when(silent, "zero_volume")


def find_anomalies(window: DataFrame, day=None, *, max_daily_jump: float, zero_volume_min_avg_volume: float) -> DataFrame:
    """ticker, mic, date, reason of anomalous bars (of one day, or of all)."""
    found = window.withColumn("reason", anomaly(max_daily_jump, zero_volume_min_avg_volume)).where("reason is not null")
    return (found if day is None else found.where(F.col("date") == F.lit(day))).select(*KEY, "date", "reason")


def coverage(keys: DataFrame, window: DataFrame, anomalies: DataFrame, day) -> DataFrame:
    """expected, with_bar, quarantined, coverage of one day."""
    there = window.where(F.col("date") == F.lit(day)).select(*KEY).distinct().withColumn("_bar", F.lit(1))
    bad = anomalies.where(F.col("date") == F.lit(day)).select(*KEY).distinct().withColumn("_bad", F.lit(1))
    joined = keys.join(there, KEY, "left").join(bad, KEY, "left")
    return joined.agg(F.count("*").alias("expected"), F.count("_bar").alias("with_bar"), F.count("_bad").alias("quarantined")).withColumn("coverage", F.try_divide(F.col("with_bar") - F.col("quarantined"), F.col("expected")))


@dataclass
class QualityReport:
    passed: bool
    coverage: float | None
    failures: list[str] = field(default_factory=list)


def run_quality(keys: DataFrame, window: DataFrame, day, *, max_daily_jump: float = 0.4, zero_volume_min_avg_volume: float = 100_000, min_coverage: float = 0.98) -> tuple[QualityReport, DataFrame]:
    """The gate's verdict and the quarantined keys with their reasons. It fails on a stale feed or low coverage."""
    found = find_anomalies(window.where(F.col("date") <= F.lit(day)), day, max_daily_jump=max_daily_jump, zero_volume_min_avg_volume=zero_volume_min_avg_volume)
    last = window.agg(F.max("date").alias("d")).first().d
    share = coverage(keys, window, found, day).first().coverage
    failures = []
    if last != day:
        failures.append(f"the feed ends on {last}, not {day}")
    if share is None or share < min_coverage:
        failures.append(f"coverage {share} is below {min_coverage}")
    return QualityReport(not failures, share, failures), found


def promote(window: DataFrame, day, quarantined: DataFrame) -> DataFrame:
    """The rows that go to production: all but the day's bars of quarantined keys."""
    bad = quarantined.select(*KEY).distinct().withColumn("date", F.lit(day).cast("date"))
    return window.join(bad, [*KEY, "date"], "left_anti").select(*window.columns)
