"""Point-in-time universes: membership intervals, rolls, repairs."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.schemas import KEY, conform


def universe_keys(universe: DataFrame) -> DataFrame:
    """Distinct keys; a missing market is UNKNOWN."""
    return universe.select("ticker", F.coalesce("mic", F.lit("UNKNOWN")).alias("mic")).distinct()


def members_as_of(table: DataFrame, day) -> DataFrame:
    """Members on a day: start <= day < end, where a null bound is open; one row per key, of the earliest interval."""
    d = F.lit(day).cast("date")
    inside = (F.col("start").isNull() | (F.col("start") <= d)) & (F.col("end").isNull() | (F.col("end") > d))
    return _first(table.where(inside))


def members_between(table: DataFrame, start, end) -> DataFrame:
    """Members at any time between two days, both included."""
    a, b = F.lit(start).cast("date"), F.lit(end).cast("date")
    inside = (F.col("start").isNull() | (F.col("start") <= b)) & (F.col("end").isNull() | (F.col("end") > a))
    return _first(table.where(inside))


def _first(df: DataFrame) -> DataFrame:
    w = Window.partitionBy("ticker", "mic").orderBy(F.col("start").asc_nulls_last(), F.col("end").asc_nulls_last())
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def universe_members(universe: DataFrame) -> DataFrame:
    """One row per key with the panel's attributes; those that the universe lacks are null."""
    own = universe.withColumn("mic", F.coalesce("mic", F.lit("UNKNOWN")))
    for c in ("name", "sector", "sub_industry", "currency"):
        if c not in own.columns:
            own = own.withColumn(c, F.lit(None).cast("string"))
    w = Window.partitionBy(*KEY).orderBy(F.col("name").asc_nulls_last(), F.col("sector").asc_nulls_last())
    return own.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(*KEY, "name", "sector", "sub_industry", "currency")


def open_markets(universe: DataFrame, mics: list[str]) -> DataFrame:
    """Members whose market is open or unknown (before unknown markets get their name)."""
    return universe.where(F.col("mic").isNull() | F.col("mic").isin(mics))


def merge_fill(left: DataFrame, right: DataFrame, columns: list[str], key: str = "ticker") -> DataFrame:
    """Nulls of left's columns are filled from right's first row of the key, in the order of the columns' values."""
    w = Window.partitionBy(key).orderBy(*columns)
    first = right.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(key, *[F.col(c).alias(f"_r_{c}") for c in columns])
    out = left.join(first, key, "left")
    return out.select(*[F.coalesce(c, f"_r_{c}").alias(c) if c in columns else F.col(c) for c in left.columns], *[F.col(f"_r_{c}").alias(c) for c in columns if c not in left.columns])


def roll_snapshot(previous: DataFrame, fresh: DataFrame, today) -> DataFrame:
    """Membership intervals after a fresh listing: open ones that it lacks end today, new ones start today. A no-op if repeated."""
    d = F.lit(today).cast("date")
    key = lambda df: [F.col("ticker").alias("_t"), F.coalesce("mic", F.lit("")).alias("_m")]
    marked = previous.select("*", *key(previous))
    here = fresh.select(*key(fresh), F.lit(True).alias("_here")).distinct()
    old = marked.join(here, ["_t", "_m"], "left").withColumn("end", F.when(F.col("end").isNull() & F.col("_here").isNull(), d).otherwise(F.col("end"))).select(*previous.columns)
    open_ = marked.where("end is null").select("_t", "_m")
    new = fresh.select("*", *key(fresh)).dropDuplicates(["_t", "_m"]).join(open_, ["_t", "_m"], "left_anti")
    new = new.drop("_t", "_m", "start", "end").withColumn("start", d).withColumn("end", F.lit(None).cast("date"))
    return old.unionByName(new, allowMissingColumns=True)


def new_listings(table: DataFrame, listed: DataFrame, today) -> DataFrame:
    """The table with intervals that start today for listed tickers that aren't open, and listed attributes for the open ones."""
    open_ = table.where("end is null").select("ticker")
    new = listed.join(open_, "ticker", "left_anti").withColumn("start", F.lit(today).cast("date")).withColumn("end", F.lit(None).cast("date"))
    filled = merge_fill(table, listed, [c for c in ("name", "sector", "sub_industry", "cik") if c in listed.columns])
    return filled.unionByName(new, allowMissingColumns=True)


def repair_symbols(table: DataFrame, known: DataFrame, resolved: DataFrame) -> DataFrame:
    """Keys with recent candles stay; others take what the search found; not found ones go, failed searches stay.

    resolved: ticker, mic, status (found, missing, failed), new_ticker, new_mic.
    """
    seen = table.join(known.select(*KEY).distinct(), KEY, "left_semi").select(*table.columns)
    rest = table.join(known.select(*KEY).distinct(), KEY, "left_anti").join(resolved, KEY, "left")
    rest = rest.where(F.coalesce("status", F.lit("failed")) != "missing")
    found = F.col("status") == "found"
    rest = rest.select(*[F.coalesce(F.when(found, F.col(f"new_{c}")), F.col(c)).alias(c) if c in KEY else F.col(c) for c in table.columns])
    return seen.unionByName(rest).dropDuplicates(KEY)


def finalize(table: DataFrame, *, mic: str | None = None, currency: str | None = None, source: str) -> DataFrame:
    out = table
    for c, v in (("mic", mic), ("currency", currency), ("source", source)):
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(v)) if c in out.columns else F.lit(v))
    return conform(out, "constituents").orderBy("ticker", "start")


def build_reason(built: date | None, snapshot: bool, today: date) -> str | None:
    """Why a universe must be built: it is missing, or a snapshot is older than today."""
    if built is None:
        return "missing"
    return "stale" if snapshot and built < today else None


def canonical_ticker(c: Column) -> Column:
    return F.nullif(F.translate(F.upper(F.trim(c)), "-", "."), F.lit(""))


def code_ticker(c: Column, width: int) -> Column:
    """An exchange's code of fixed width, after the exchange's name: `SEHK: 5` is 0005, `285A` stays; null if it has another width."""
    own = F.upper(F.regexp_replace(_after_exchange(c), "[^0-9A-Za-z]", ""))
    own = F.when(own.rlike("^[0-9]+$") & (F.length(own) < width), F.lpad(own, width, "0")).otherwise(own)
    return F.when(F.length(own) == width, own)


def exchange_code_ticker(c: Column) -> Column:
    """The part after the exchange's name without signs but `&`: `BMV: GFNORTE O` is GFNORTEO; null if nothing is left."""
    return F.nullif(F.upper(F.regexp_replace(_after_exchange(c), "[^0-9A-Za-z&]", "")), F.lit(""))


def _after_exchange(c: Column) -> Column:
    return F.element_at(F.split(c, ":"), -1)


def feed_symbol(ticker: Column, mic: Column, suffixes: dict[str, str]) -> Column:
    """A vendor's symbol: the ticker with `-` for spaces and dots, and the market's suffix; null for a market without one."""
    table = F.create_map(*[F.lit(x) for kv in suffixes.items() for x in kv]) if suffixes else F.create_map().cast("map<string,string>")
    return F.concat(F.translate(F.upper(F.trim(ticker)), " .", "--"), F.try_element_at(table, mic))


def lookback_start(as_of: date, sessions: int) -> date:
    """A date that has at least so many sessions between it and as_of."""
    return as_of - timedelta(days=-(-sessions * 366 // 252) + 7)
