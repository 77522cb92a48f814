"""Panels, signals, their reconciliation with the next open, and what is recommended."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.schemas import KEY, require_columns

#: An open exactly at the limit isn't deviated; this absorbs rounding (fixed value).
GAP_TOLERANCE = 1e-9


def build_panel(members: DataFrame, today: DataFrame) -> DataFrame:
    return members.join(today, KEY).select(*KEY, *[c for c in members.columns if c not in KEY], *[c for c in today.columns if c not in KEY])


def row_hash(columns: list[str]) -> Column:
    """A hash of a row's values; -0.0 equals 0.0, and missing values have their own mark."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce((F.col(c) + F.lit(0.0) if k == "double" else F.col(c)).cast("string"), F.lit("\x00")) for c, k in columns]), 256)


def panel_hash(panel: DataFrame, columns: list[str] | None = None) -> str:
    """A hash that doesn't depend on the rows' order and changes with any value.

    Row hashes are added up as numbers, so nothing is gathered in one place.
    """
    kinds = dict(panel.dtypes)
    names = sorted(columns or panel.columns)
    h = row_hash([(c, kinds[c]) for c in names])
    parts = [F.sum(F.conv(F.substring(h, 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)")).alias(f"p{i}") for i in range(5)]
    row = panel.agg(F.count("*").alias("n"), *parts).select(F.sha2(F.concat_ws("|", F.lit(",".join(names)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("n", "p0", "p1", "p2", "p3", "p4")]), 256).alias("h"))
    return row.first().h


def run_snapshot(members: DataFrame, today: DataFrame, *, min_coverage: float = 0.95) -> tuple[DataFrame, str, float]:
    """The panel, its hash and its coverage; an error if too few members have a row."""
    panel = build_panel(members, today)
    expected, rows = members.count(), panel.count()
    share = rows / expected if expected else 0.0
    if share < min_coverage:
        raise ValueError(f"the panel covers {share:.3f} of {expected} members; {min_coverage} is asked for")
    return panel, panel_hash(panel), share


def _complete(df: DataFrame, column: str, what: str) -> DataFrame:
    bad = df.where(F.col(column).isNull()).select("ticker").limit(5).collect()
    if bad:
        raise ValueError(f"{what} missing for {', '.join(r.ticker for r in bad)}")
    return df


def build_signals(candidates: DataFrame, panel: DataFrame, sessions: DataFrame, as_of, *, region: str, snapshot_hash: str, verdicts: DataFrame | None = None, model: str | None = None) -> DataFrame:
    """Signals of the day: candidates with currency, execution session and verdict; each market needs a session, each ticker a verdict."""
    out = candidates.join(panel.select(*KEY, "currency").dropDuplicates(KEY), KEY, "left").join(sessions.select("mic", F.col("session").alias("execute_on")), "mic", "left")
    out = _complete(out, "execute_on", "execution session")
    if verdicts is not None:
        out = _complete(out.join(verdicts.select("ticker", "verdict", "confidence", "headline", "rationale", "risks"), "ticker", "left"), "verdict", "verdict")
    return out.withColumns({"date": F.lit(as_of).cast("date"), "region": F.lit(region), "snapshot_hash": F.lit(snapshot_hash), "llm_model": F.lit(model).cast("string")})


def reconcile(signals: DataFrame, candles: DataFrame, *, max_open_gap: float = 0.02) -> DataFrame:
    """signals with execution_open, open_gap and reconcile_status: sin_precio, desviada or conciliada (fixed values)."""
    if not 0 < max_open_gap < 1:
        raise ValueError(f"max_open_gap must be between 0 and 1: {max_open_gap}")
    require_columns(signals, [*KEY, "execute_on", "close"])
    if signals.where(~F.coalesce(F.col("close") > 0, F.lit(False))).limit(1).count():
        raise ValueError("signals whose reference close isn't positive")
    return reconciled(signals, candles, max_open_gap=max_open_gap)


def reconciled(signals: DataFrame, candles: DataFrame, *, max_open_gap: float) -> DataFrame:
    order = [F.col(c).desc() for c in candles.columns if c not in (*KEY, "date")]
    # only the days on which a signal executes are ranked
    due = signals.select(*KEY, F.col("execute_on").alias("date")).distinct()
    candles = candles.join(due, [*KEY, "date"], "left_semi").select(*candles.columns)
    one = candles.withColumn("_n", F.row_number().over(Window.partitionBy(*KEY, "date").orderBy(*order))).where("_n = 1")
    opens = one.select(*KEY, F.col("date").alias("execute_on"), F.col("open").alias("_open"))
    out = signals.drop("execution_open", "open_gap", "reconcile_status").join(opens, [*KEY, "execute_on"], "left")
    out = out.withColumn("execution_open", F.when(F.col("_open") > 0, F.col("_open"))).withColumn("open_gap", F.col("execution_open") / F.col("close") - 1).drop("_open")
    far = F.abs("open_gap") - max_open_gap > GAP_TOLERANCE
    return out.withColumn("reconcile_status", F.when(F.col("open_gap").isNull(), "sin_precio").when(far, "desviada").otherwise("conciliada"))


def reconcile_summary(done: DataFrame) -> DataFrame:
    return done.agg(*[F.count_if(F.col("reconcile_status") == s).alias(s) for s in ("conciliada", "desviada", "sin_precio")], F.avg("open_gap").alias("mean_gap"), F.max(F.abs("open_gap")).alias("max_abs_gap"))


def pending(signals: DataFrame, day) -> DataFrame:
    d = F.lit(day).cast("date")
    return signals.where((F.col("execute_on") <= d) & (F.col("reconcile_status").isNull() | (F.col("execute_on") == d)))


def verdict_counts(signals: DataFrame, verdicts: tuple[str, ...] = ("confirmar", "vigilar", "descartar")) -> DataFrame:
    return signals.groupBy("direction").agg(*[F.count_if(F.col("verdict") == v).alias(v) for v in verdicts])


def recommended(signals: DataFrame, analysed: bool) -> DataFrame:
    """One signal per key and direction: figures first, then confidence and score; only confirmed ones if analysed."""
    own = signals.where("verdict = 'confirmar'") if analysed else signals
    by = [F.desc("confidence"), F.desc("score")] if analysed else [F.desc("score")]
    w = Window.partitionBy(*KEY, "direction").orderBy(F.col("pattern").isNotNull().desc(), *by, "rule_id")
    return own.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n").orderBy(*by, "ticker")


def month_cost(calls: DataFrame, day) -> DataFrame:
    d = F.lit(day).cast("date")
    return calls.where((F.year("date") == F.year(d)) & (F.month("date") == F.month(d))).agg(F.coalesce(F.sum("cost_eur"), F.lit(0.0)).alias("cost_eur"))


def estimate_cost(*, input_price: float = 2.0, output_price: float = 10.0, cache_write: float = 2.5, cache_read: float = 0.2, batch: float = 0.5) -> Column:
    """EUR of a call from its token columns; prices per million tokens, batches at half."""
    plain = F.col("input_tokens") + cache_write * F.col("cache_write_tokens") + cache_read * F.col("cache_read_tokens")
    return F.bround((plain * input_price + F.col("output_tokens") * output_price) / 1e6 * F.when(F.col("batch"), batch).otherwise(1.0), 6)


def next_session(sessions: DataFrame, day) -> DataFrame:
    """The first session after a day, per market."""
    return sessions.where(F.col("session") > F.lit(day).cast("date")).groupBy("mic").agg(F.min("session").alias("session"))


def last_closed_session(sessions: DataFrame, now) -> DataFrame:
    """The latest date whose sessions have closed in all markets that traded. sessions: mic, session, close_at."""
    closed = sessions.groupBy("session").agg(F.bool_and(F.col("close_at") <= F.lit(now)).alias("closed"))
    return closed.where("closed").agg(F.max("session").alias("session"))
