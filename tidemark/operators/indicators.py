"""Technical indicators over candles keyed (ticker, mic) in date order, and the incremental choice of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from tidemark.schemas import INDICATOR_COLUMNS, KEY

#: Bars that a value needs before it: with them it doesn't depend on where the history starts.
WARMUP = {"rsi_14": 14, "sma_20": 19, "sma_50": 49, "sma_200": 199, "macd": 33, "atr_14": 14, "avg_volume_20": 19, "ret_20d": 20, "patterns": 150}

#: Rows over which a recursive mean is summed at a time: the weights of a block stay far from the limits of a double.
BLOCK = 512


def by_key(*order: str) -> WindowSpec:
    return Window.partitionBy(*KEY).orderBy(*(order or ("date",)))


def sma(column: str, length: int) -> Column:
    """Mean of the last `length` values; null until all of them are there."""
    w = by_key().rowsBetween(1 - length, 0)
    return F.when(F.count(column).over(w) == length, F.avg(column).over(w))


def ret(column: str, length: int) -> Column:
    before = F.lag(column, length).over(by_key())
    return F.when(before != 0, F.col(column) / before - 1)


def true_range(high: Column, low: Column, close: Column) -> Column:
    before = F.lag(close).over(by_key())
    return F.greatest(high - low, F.abs(high - before), F.abs(low - before))


def with_means(df: DataFrame, means: dict[str, str], alpha: float, length: int, block: int = BLOCK) -> DataFrame:
    """df with recursive means: columns named by `means`, each of the column it names, y = (1 - alpha) y' + alpha x.

    A mean starts as the plain mean of its column's first `length` values; nulls are left out, and have no mean. All the
    columns of one call are null in the same rows.

    The recursion is linear, so it composes: within a block of rows the values are summed with weights that undo the
    decay, which windows do, and a block is one pair (decay, value) to those after it. A row folds the pairs of the
    blocks before its own, of which there is one in `block` rows; blocks of a long series are sorted and summed apart.
    """
    keep = 1.0 - alpha
    first = next(iter(means.values()))
    so_far = by_key().rowsBetween(Window.unboundedPreceding, 0)
    x = df.withColumn("_k", F.when(F.col(first).isNotNull(), F.count(first).over(so_far)))
    x = x.withColumns({f"_m_{y}": F.avg(F.when(F.col("_k") <= length, F.col(c))).over(so_far) for y, c in means.items()})
    after = F.col("_k") - length - 1
    x = x.withColumn("_b", F.when(after >= 0, F.floor(after / block))).withColumn("_o", F.when(after >= 0, F.pmod(after, F.lit(block))))
    of_block = Window.partitionBy(*KEY, "_b").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    weight = F.pow(F.lit(keep), F.col("_o").cast("double"))
    x = x.withColumns({f"_s_{y}": weight * F.sum(alpha * F.col(c) / weight).over(of_block) for y, c in means.items()})
    before = Window.partitionBy(*KEY).orderBy("_b").rangeBetween(Window.unboundedPreceding, -1)
    ends = lambda y: F.collect_list(F.when(F.col("_o") == block - 1, F.struct("_b", f"_s_{y}"))).over(before)
    x = x.withColumns({f"_e_{y}": ends(y) for y in means})
    carry = lambda y: F.aggregate(F.transform(F.array_sort(f"_e_{y}"), lambda e: e[f"_s_{y}"]), F.col(f"_m_{y}"), lambda c, e: c * keep**block + e)
    value = lambda y: F.when(F.col("_k") == length, F.col(f"_m_{y}")).when(F.col("_k") > length, weight * keep * carry(y) + F.col(f"_s_{y}"))
    x = x.withColumns({y: value(y) for y in means})
    return x.drop("_k", "_b", "_o", *[f"_{t}_{y}" for t in "mse" for y in means])


def indicators(bars: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """bars with the catalog but the chart patterns, or with those of its columns that are named; one shuffle by key.

    Adjusted closes serve for means, returns, RSI and MACD; the adjusted range for ATR. RSI and ATR are Wilder means
    (alpha 1/14), MACD's means have spans 12, 26 and 9; all start with a plain mean (with_means). Values are null until
    they have their warm-up. Everything is a window function.
    """
    wanted = set(INDICATOR_COLUMNS if columns is None else columns)
    factor = F.when(F.col("close") != 0, F.col("adj_close") / F.col("close"))
    windows = {f"sma_{n}": sma("adj_close", n) for n in (20, 50, 200)} | {"avg_volume_20": sma("volume", 20)} | {f"ret_{n}d": ret("adj_close", n) for n in (1, 5, 20)}
    x = bars.withColumns({c: v for c, v in windows.items() if c in wanted})
    made = [c for c in ("rsi_14", "macd", "macd_hist", "macd_signal", "atr_14") if c in wanted]
    own = x.columns
    if "rsi_14" in made:
        x = x.withColumn("_d", F.col("adj_close") - F.lag("adj_close").over(by_key()))
        x = x.withColumn("_up", F.greatest("_d", F.lit(0.0)) + 0 * F.col("_d")).withColumn("_down", F.greatest(-F.col("_d"), F.lit(0.0)) + 0 * F.col("_d"))
        x = with_means(x, {"_gain": "_up", "_loss": "_down"}, 1 / 14, 14)
        moved = F.col("_gain") + F.col("_loss")
        x = x.withColumn("rsi_14", F.when(moved == 0, 50.0).when(moved.isNotNull(), 100 * F.col("_gain") / F.when(moved != 0, moved)))
    if {"macd", "macd_hist", "macd_signal"} & set(made):
        x = with_means(with_means(x, {"_fast": "adj_close"}, 2 / 13, 12), {"_slow": "adj_close"}, 2 / 27, 26)
        x = with_means(x.withColumn("_line", F.col("_fast") - F.col("_slow")), {"_signal": "_line"}, 2 / 10, 9)
        found = {"macd": F.when(F.col("_signal").isNotNull(), F.col("_line")), "macd_hist": F.col("_line") - F.col("_signal"), "macd_signal": F.col("_signal")}
        x = x.withColumns({c: v for c, v in found.items() if c in made})
    if "atr_14" in made:
        x = x.withColumn("_h", F.col("high") * factor).withColumn("_l", F.col("low") * factor)
        x = x.withColumn("_tr", F.when(F.lag("adj_close").over(by_key()).isNotNull(), true_range(F.col("_h"), F.col("_l"), F.col("adj_close"))))
        x = with_means(x, {"atr_14": "_tr"}, 1 / 14, 14)
    return x.select(*own, *made)


def pattern_atr(length: int = 14) -> Column:
    """Plain mean of the column _tr (see true_range) over full windows; the first bar's range has no previous close."""
    return sma("_tr", length)


def prior_max(column: str, length: int = 20) -> Column:
    return F.max(column).over(by_key().rowsBetween(-length, -1))


def select_rows(computed: DataFrame, stored: DataFrame, forced: DataFrame | None = None, *, warmup: int = 199) -> DataFrame:
    """Rows to write: past their warm-up (or of short histories), and newer than what is stored, or forced.

    stored has ticker, mic, last_date; forced has ticker, mic.
    """
    n = F.count("*").over(Window.partitionBy(*KEY))
    rows = computed.withColumn("_pos", F.row_number().over(by_key()) - 1).withColumn("_n", n)
    rows = rows.where((F.col("_pos") >= warmup) | (F.col("_n") <= warmup)).join(stored.select(*KEY, "last_date"), KEY, "left")
    new = F.col("last_date").isNull() | (F.col("date") > F.col("last_date"))
    if forced is not None:
        rows = rows.join(forced.select(*KEY, F.lit(True).alias("_forced")).distinct(), KEY, "left")
        new = new | F.coalesce("_forced", F.lit(False))
    return rows.where(new).select(*computed.columns)


def tail(df: DataFrame, sessions: int) -> DataFrame:
    """The last `sessions` rows per key, with recency 0 for the latest."""
    w = Window.partitionBy(*KEY).orderBy(F.desc("date"))
    return df.withColumn("recency", F.row_number().over(w) - 1).where(F.col("recency") < sessions)
