"""Incremental ingest: what to fetch, what is missing, the rescue by a second provider."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.schemas import KEY
from tidemark.sources.tables import normalize_prices


def plan_fetch(keys: DataFrame, last_dates: DataFrame, as_of, default_start, force_start=None) -> DataFrame:
    """keys with start: the day after the last bar, the default without bars, or the forced day; null if up to date."""
    day = F.lit(as_of).cast("date")
    own = F.lit(force_start).cast("date") if force_start else F.coalesce(F.date_add("last_date", 1), F.lit(default_start).cast("date"))
    return keys.join(last_dates, KEY, "left").withColumn("start", F.when(own <= day, own)).select(*keys.columns, "start")


def without_bar(planned: DataFrame, fetched: DataFrame, as_of) -> DataFrame:
    """Planned keys that have no bar on the day."""
    return planned.where("start is not null").join(fetched.where(F.col("date") == F.lit(as_of)).select(*KEY), KEY, "left_anti")


def stale_keys(keys: DataFrame, last_dates: DataFrame, as_of) -> DataFrame:
    """Keys without bars, or whose last one is before the day."""
    return keys.join(last_dates, KEY, "left").where(F.col("last_date").isNull() | (F.col("last_date") < F.lit(as_of).cast("date")))


@dataclass(frozen=True)
class IngestReport:
    requested: int
    received: int
    missing: int
    rescued: int


def ingest_prices(keys: DataFrame, as_of, *, provider, store, default_start, fallback=None, fallback_markets: list[str] | None = None, force_start=None) -> IngestReport:
    """Fetches what is missing, asks the fallback for keys of its markets that lack the day's bar, and upserts both.

    A provider is a callable (planned keys with start, as_of) -> candles.
    """
    planned = plan_fetch(keys, store.read("prices").groupBy(*KEY).agg(F.max("date").alias("last_date")), as_of, default_start, force_start).where("start is not null").cache()
    fetched = normalize_prices(provider(planned, as_of)).cache()
    lacking = without_bar(planned, fetched, as_of)
    rescued = None
    if fallback is not None:
        wanted = lacking.where(F.col("mic").isin(fallback_markets)) if fallback_markets is not None else lacking
        rescued = normalize_prices(fallback(wanted, as_of)).cache()
    everything = fetched if rescued is None else fetched.unionByName(rescued, allowMissingColumns=True)
    store.upsert("prices", everything)
    got = everything.where(F.col("date") == F.lit(as_of)).select(*KEY).distinct().count()
    n = planned.count()
    report = IngestReport(n, got, n - got, 0 if rescued is None else rescued.select(*KEY).distinct().count())
    for df in (planned, fetched, rescued):
        if df is not None:
            df.unpersist()
    return report
