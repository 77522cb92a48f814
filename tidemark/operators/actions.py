"""Corporate actions: from the feed, and inferred from prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.indicators import by_key
from tidemark.schemas import KEY

#: Splits that are looked for in this order, new shares for old ones: common splits, then reverse ones (fixed values).
RATIOS = [
    1.5, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 10.0, 15.0, 20.0, 25.0, 50.0,
    1 / 2, 1 / 3, 1 / 4, 1 / 5, 1 / 6, 1 / 8, 1 / 10, 1 / 15, 1 / 20, 1 / 25, 1 / 50,
]
TOLERANCE, LEAST_MOVE = 0.03, 0.25
IDENTITY = [*KEY, "date", "kind"]


def from_feed(window: DataFrame) -> DataFrame:
    """Splits and dividends that the feed declares."""
    split = window.where(F.col("split").isNotNull() & (F.col("split") > 0) & (F.col("split") != 1)).select(*KEY, "date", F.lit("split").alias("kind"), F.col("split").alias("value"), F.lit("feed").alias("source"))
    paid = window.where(F.col("dividend") > 0).select(*KEY, "date", F.lit("dividend").alias("kind"), F.col("dividend").alias("value"), F.lit("feed").alias("source"))
    return split.unionByName(paid)


def split_ratio(close: Column, before: Column, adj_close: Column, adj_before: Column) -> Column:
    """The known ratio that explains an unadjusted jump, or null.

    The move must be at least 25 %, the adjusted close must show the same move, and the ratio must fit within 3 %.
    """
    real, adjusted = F.when(before > 0, close / before), F.when(adj_before > 0, adj_close / adj_before)
    fits = F.filter(F.array(*map(F.lit, RATIOS)), lambda r: F.abs(1 / adjusted / r - 1) <= TOLERANCE)
    plain = (F.abs(adjusted - 1) >= LEAST_MOVE) & (F.abs(real / adjusted - 1) <= TOLERANCE)
    return F.when(plain & (real > 0) & (adjusted > 0), F.get(fits, F.lit(0)))


def by_ratio(window: DataFrame, day=None) -> DataFrame:
    """Splits inferred from prices, of rows without a value from the feed."""
    before = lambda c: F.lag(c).over(by_key())
    found = window.withColumn("value", split_ratio(F.col("close"), before("close"), F.col("adj_close"), before("adj_close")))
    if "split" in window.columns:
        found = found.where("split is null")
    found = found.where("value is not null")
    return (found if day is None else found.where(F.col("date") == F.lit(day))).select(*KEY, "date", F.lit("split").alias("kind"), "value", F.lit("ratio").alias("source"))


def needs_reingest(window: DataFrame, actions: DataFrame) -> DataFrame:
    """Keys with an event whose older rows were read over an hour before the event's own row: their history is stale."""
    older = Window.partitionBy(*KEY).orderBy(F.unix_date("date")).rangeBetween(Window.unboundedPreceding, -1)
    own = window.select(*KEY, "date", "ingested_at", F.min("ingested_at").over(older).alias("_oldest"))
    stale = own.where(F.col("_oldest") < F.col("ingested_at") - F.expr("INTERVAL 1 HOUR"))
    return stale.join(actions.select(*KEY, "date"), [*KEY, "date"], "left_semi").select(*KEY).distinct()


def new_events(detected: DataFrame, recorded: DataFrame) -> DataFrame:
    return detected.join(recorded.select(*IDENTITY), IDENTITY, "left_anti").select(*detected.columns)


def released(quarantine: DataFrame, detected: DataFrame, day) -> DataFrame:
    """Keys quarantined for a jump that a split of the day explains."""
    splits = detected.where((F.col("kind") == "split") & (F.col("date") == F.lit(day))).select(*KEY).distinct()
    return quarantine.where("reason = 'jump'").join(splits, KEY, "left_semi")


def rows_to_promote(window: DataFrame, refreshed: DataFrame, free: DataFrame, day, still: DataFrame) -> DataFrame:
    """All rows of re-read keys and the day's rows of released ones, without the day's rows of those still in quarantine."""
    all_of = window.join(refreshed.select(*KEY).distinct(), KEY, "left_semi").select(*window.columns)
    only = free.select(*KEY).distinct().join(refreshed.select(*KEY), KEY, "left_anti")
    day_of = window.where(F.col("date") == F.lit(day)).join(only, KEY, "left_semi").select(*window.columns)
    bad = still.select(*KEY).distinct().withColumn("date", F.lit(day).cast("date"))
    return all_of.unionByName(day_of).join(bad, [*KEY, "date"], "left_anti").select(*window.columns)


def ratio_text(value: Column) -> Column:
    """10:1 for a split, 1:2 for a reverse one."""
    whole = lambda x: F.bround(x, 4)
    shown = lambda x: F.regexp_replace(F.format_string("%.4f", whole(x)), r"\.?0+$", "")
    return F.when(value >= 1, F.concat(shown(value), F.lit(":1"))).otherwise(F.concat(F.lit("1:"), shown(1 / value)))
