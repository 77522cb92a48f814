"""Joins in time: each row with the nearest one before or after it, and days with the intervals that hold them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Days in a cell of an as-of join.
CELL_DAYS = 32


def _micros(c: str, df: DataFrame) -> Column:
    """A date or a time as a number that keeps its order."""
    kind = dict(df.dtypes)[c]
    if kind == "date":
        return F.unix_date(c).cast("long") * 86_400_000_000
    return F.unix_micros(c) if kind.startswith("timestamp") and kind != "timestamp_ntz" else F.unix_micros(F.col(c).cast("timestamp")) if kind == "timestamp_ntz" else F.col(c).cast("long")


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_on: str, right_on: str, columns: list[str], *, after: bool = False, strict: bool = False, cell_days: int = CELL_DAYS) -> DataFrame:
    """left with the columns of the nearest row of right at or before its time (at or after it, if `after`), within the keys `by`.

    Strict leaves out rows at the same time. Rows of left without such a row, or without a time, get nulls; among right's
    rows at one time the least by their columns counts; those without a time are left out. Null keys meet null keys.

    Both sides are united and sorted within cells of time of a key, so that a key that holds most rows is still many
    tasks: a window takes the last row of right that it has seen. Where a cell has none before the row, the nearest cell
    that has one is looked up: cells, not rows, are carried over a key's whole time.
    """
    width = cell_days * 86_400_000_000
    value = F.struct(*[F.col(c).alias(c) for c in columns])
    mine = left.withColumn("_t", _micros(left_on, left)).withColumn("_cell", F.floor(F.col("_t") / width))
    other = right.where(F.col(right_on).isNotNull()).select(*by, _micros(right_on, right).alias("_t"), value.alias("_v"))
    other = other.groupBy(*by, "_t").agg(F.min("_v").alias("_v")).withColumn("_cell", F.floor(F.col("_t") / width))
    kind = other.schema["_v"].dataType
    names = left.columns
    # at one time rows of right come before those of left, unless they must not count
    rows = mine.select(*by, "_t", "_cell", F.lit(0 if strict else 1).alias("_side"), F.lit(None).cast(kind).alias("_v"), F.struct(*names).alias("_row"))
    seen = other.select(*by, "_t", "_cell", F.lit(1 if strict else 0).alias("_side"), "_v", F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"))
    order = [F.desc("_t") if after else F.asc("_t"), F.asc("_side")]
    w = Window.partitionBy(*by, "_cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    both = rows.union(seen).withColumn("_near", F.last("_v", ignorenulls=True).over(w)).where("_row is not null")

    edge = F.min_by("_v", "_t") if after else F.max_by("_v", "_t")
    cells = other.groupBy(*by, "_cell").agg(edge.alias("_v")).union(mine.where("_cell is not null").select(*by, "_cell", F.lit(None).cast(kind)).distinct())
    cells = cells.groupBy(*by, "_cell").agg(F.first("_v", ignorenulls=True).alias("_v"))
    over = Window.partitionBy(*by).orderBy(F.desc("_cell") if after else F.asc("_cell")).rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("_far", F.last("_v", ignorenulls=True).over(over)).select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_cell").alias("_c"), "_far")
    same = F.col("_cell") == F.col("_c")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    found = F.when(F.col("_t").isNotNull(), F.coalesce("_near", "_far"))
    return both.join(cells, same, "left").select("_row.*", *[found[c].alias(c) for c in columns])


def next_sessions(rows: DataFrame, sessions: DataFrame, on: str, name: str = "session") -> DataFrame:
    """rows with their market's first session after their own day. sessions: mic, session."""
    return asof_join(rows, sessions.select("mic", F.col("session").alias(name)), ["mic"], on, name, [name], after=True, strict=True)


def days_within(intervals: DataFrame, days: DataFrame, day: str = "day", start: str = "start", end: str = "end") -> DataFrame:
    """Each day with each interval that holds it: start <= day < end, where a null bound is open.

    Intervals are cut into the months that they touch between the first and the last of the days; days meet the pieces of
    their month by an equal join, and the bounds are then tested. Columns of both sides, which must differ in name.
    """
    month = lambda c: F.year(c) * 12 + F.month(c)
    first = F.greatest(F.col(start), days.select(F.min(day)).scalar())
    last = F.least(F.date_sub(F.col(end), 1), days.select(F.max(day)).scalar())
    own = intervals.withColumn("_first", first).withColumn("_last", last).where("_first <= _last")
    pieces = own.withColumn("_month", F.explode(F.sequence(month(F.col("_first")), month(F.col("_last"))))).drop("_first", "_last")
    # a few intervals may touch very many days: their pieces are dealt out before they meet them
    pieces = pieces.repartition(int(intervals.sparkSession.conf.get("spark.sql.shuffle.partitions")), *intervals.columns, "_month")
    met = days.withColumn("_month", month(F.col(day))).join(pieces, "_month").drop("_month")
    return met.where((F.col(start).isNull() | (F.col(start) <= F.col(day))) & (F.col(end).isNull() | (F.col(end) > F.col(day))))


def earliest_only(table: DataFrame) -> DataFrame:
    """table with _from and _to, the days at most that each interval holds for itself: of intervals of one ticker and mic
    the earliest has a day, those without a start come last. A row may be cut into several; a null bound is open.

    Behind an interval's start the earlier ones hold one stretch, which ends where the last of them does, so an interval
    begins there. Intervals without a start share, one after another, the gaps that the others leave.
    """
    far, ago = F.lit(1 << 30), F.lit(-(1 << 30))
    rest = [c for c in table.columns if c not in ("ticker", "mic", "start", "end")]
    own = table.withColumn("_s", F.coalesce(F.unix_date("start"), ago)).withColumn("_e", F.coalesce(F.unix_date("end"), far)).where("_s < _e")
    key = Window.partitionBy("ticker", "mic", F.col("start").isNull())
    before = key.orderBy("_s", F.col("end").isNull(), "_e", *rest).rowsBetween(Window.unboundedPreceding, -1)
    held = own.withColumn("_from", F.greatest("_s", F.coalesce(F.max("_e").over(before), ago))).where("_from < _e")
    begun, open_ = held.where("start is not null"), held.where("start is null")
    runs = begun.select(F.col("ticker").alias("_t"), F.col("mic").alias("_m"), F.col("_from").alias("_z"), F.col("_e").alias("_a"))
    # what lies before the first and behind each
    gaps = runs.withColumn("_z", F.lead("_z", 1, 1 << 30).over(Window.partitionBy("_t", "_m").orderBy("_z"))).select("_t", "_m", "_a", "_z")
    gaps = gaps.union(runs.groupBy("_t", "_m").agg(ago.alias("_a"), F.min("_z").alias("_z")).select("_t", "_m", "_a", "_z")).where("_a < _z")
    same = F.col("ticker").eqNullSafe(F.col("_t")) & F.col("mic").eqNullSafe(F.col("_m"))
    some = runs.select("_t", "_m").distinct()
    cut = open_.join(gaps, same).select(*table.columns, F.greatest("_from", "_a").alias("_from"), F.least("_e", "_z").alias("_to")).where("_from < _to")
    free = open_.join(some, same, "left_anti").select(*table.columns, "_from", F.col("_e").alias("_to"))
    out = begun.select(*table.columns, "_from", F.col("_e").alias("_to")).union(cut).union(free)
    day = lambda c, none: F.when(F.col(c) != none, F.date_from_unix_date(c)).alias(c)
    return out.select(*table.columns, day("_from", ago), day("_to", far))


def members_per_day(table: DataFrame, days: DataFrame) -> DataFrame:
    """day with each member of that day, one row per key and day, of its earliest interval. days: day.

    Whose a day is follows from the intervals alone, so rows of members and days are neither sorted nor grouped.
    """
    rest = [c for c in table.columns if c not in ("ticker", "mic")]
    held = days_within(earliest_only(table), F.broadcast(days.select("day").distinct()), start="_from", end="_to")
    return held.select("day", "ticker", "mic", *rest)
