"""One query per operator, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import models
from tidemark.functions import text as tx
from tidemark.functions.rules import compile_expression
from tidemark.operators import actions, graph, ingest, news, patterns, payload, quality, screener, similarity, temporal, universe
from tidemark.operators import indicators as ind
from tidemark.operators import signals as sg
from tidemark.plans.views import ARTICLES, BARS, MEMBERS, SIGNALS, articles, bars, members, read, rnd, rnd_sql, signals
from tidemark.schemas import KEY, PATTERN_NAMES
from tidemark.scratch import Scratch
from tidemark.sources import clustered, lateral, tables
from tidemark.streaming.events import event_bars as windowed_bars
from tidemark.streaming.events import story_sessions as sessions_of

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

W = "(PARTITION BY ticker, mic ORDER BY date)"
DAY = "DATE '1997-06-15'"
THE_DAY = datetime(1997, 6, 15).date()


def query(sql: str | None = None, *ctes: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = ("WITH " + ", ".join(ctes) + " " if ctes else "") + sql
        return f

    return add


def rows(*parts: str) -> str:
    return ", ".join(parts)


# --- tables ---------------------------------------------------------------------------------------------------------

@query("SELECT * FROM bars", BARS)
def ohlc_daily(s, d):
    return bars(s, d)


@query("SELECT ticker, mic, max(date) AS last_date FROM bars GROUP BY 1, 2", BARS)
def last_dates(s, d):
    return tables.last_dates(bars(s, d))


@query("SELECT count(*) AS n_rows, count(DISTINCT (ticker, mic)) AS n_keys, min(date) AS first_date, max(date) AS last_date FROM bars", BARS)
def price_stats(s, d):
    return tables.stats(bars(s, d))


def _some_keys(s, d):
    return bars(s, d).where("ticker LIKE '%1'").select(*KEY).distinct()


@query("SELECT ticker, mic, date, close FROM bars WHERE ticker LIKE '%1' AND date BETWEEN DATE '1996-01-01' AND DATE '1997-12-31'", BARS)
def semi_join_keys(s, d):
    return tables.scan(bars(s, d), [*KEY, "date", "close"], start=datetime(1996, 1, 1).date(), end=datetime(1997, 12, 31).date(), keys=_some_keys(s, d))


@query("SELECT id, ticker, published_at FROM articles WHERE published_at >= TIMESTAMP '2024-01-02' AND (ticker IS NULL OR ticker LIKE '%1')", ARTICLES)
def news_scan(s, d):
    a = articles(s, d)
    return tables.news_since(a, datetime(2024, 1, 2), a.where("ticker LIKE '%1'").select("ticker").distinct()).select("id", "ticker", F.col("published_at").cast("timestamp_ntz").alias("published_at"))


@query("""SELECT ticker, mic, date, CASE WHEN ticker LIKE '%1' AND date >= DATE '1997-01-01' THEN close + 1 ELSE close END AS close FROM bars""", BARS)
def upsert_merge(s, d):
    b = bars(s, d).select(*KEY, "date", "close")
    new = b.where("ticker LIKE '%1' AND date >= DATE '1997-01-01'").withColumn("close", F.col("close") + 1)
    return tables.merge(b, new, [*KEY, "date"])


@query("""SELECT ticker, rule_id, CASE WHEN direction = 'long' THEN 'desviada' ELSE reconcile_status END AS reconcile_status FROM signals""", SIGNALS)
def update_by_key(s, d):
    x = signals(s, d).select("ticker", "rule_id", "direction", "reconcile_status")
    new = x.where("direction = 'long'").select("ticker", "rule_id", F.lit("desviada").alias("reconcile_status"))
    return tables.update_by_key(x, new, ["ticker", "rule_id"], ["reconcile_status"]).select("ticker", "rule_id", "reconcile_status")


@query("SELECT 2 * id AS id FROM articles WHERE 2 * id IN (SELECT id FROM articles)", ARTICLES)
def existing_ids(s, d):
    """Of the doubles of all ids those that are ids themselves."""
    a = articles(s, d)
    return tables.existing_ids(a, a.select((2 * F.col("id")).alias("id")))


# --- universes and calendars ------------------------------------------------------------------------------------------

@query(f"""SELECT ticker, mic, name, sector, "start", "end" FROM members WHERE "start" <= {DAY} AND ("end" IS NULL OR "end" > {DAY})""", MEMBERS)
def members_as_of(s, d):
    return universe.members_as_of(members(s, d), THE_DAY)


@query("""SELECT ticker, mic, name, sector, "start", "end" FROM members WHERE "start" <= DATE '1996-12-31' AND ("end" IS NULL OR "end" > DATE '1996-01-01')""", MEMBERS)
def members_between(s, d):
    return universe.members_between(members(s, d), datetime(1996, 1, 1).date(), datetime(1996, 12, 31).date())


@query("""SELECT day, sector, count(*) AS n, min(ticker) AS first_ticker FROM (SELECT DISTINCT date AS day FROM bars) JOIN members ON "start" <= day AND ("end" IS NULL OR "end" > day) GROUP BY 1, 2""", MEMBERS, BARS)
def members_per_day(s, d):
    """Members of each sector on each day that has bars."""
    days = bars(s, d).select(F.col("date").alias("day"))
    return temporal.members_per_day(members(s, d), days).groupBy("day", "sector").agg(F.count("*").alias("n"), F.min("ticker").alias("first_ticker"))


@query("""SELECT upper(trim(s_name)) AS ticker, s_name || ' & Co' AS name, n_name AS sector, CASE WHEN r_name = 'EUROPE' THEN 'XEUR' WHEN r_name = 'ASIA' THEN 'XASI' END AS mic, CASE WHEN r_name = 'EUROPE' THEN 'EUR' WHEN r_name = 'ASIA' THEN 'JPY' END AS currency
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def listed_constituents(s, d):
    """Suppliers listed in HTML tables of 40 rows, with rows without cells and a second, smaller table, read back with a country map."""
    x = read(s, d, "supplier").join(read(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(read(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    row = F.concat(F.lit("<tr><td> "), F.lower("s_name"), F.lit(" </td><td>"), "s_name", F.lit(" &amp; Co</td><td>"), "n_name", F.lit("</td><td>"), "r_name", F.lit("</td></tr><tr class='empty'>\n</tr>"))
    page = F.concat(F.lit("<p>x</p><table><tr><th>Symbol</th><th>Other</th></tr></table><table><tr><th>Symbol</th><th>Company</th><th>Sector</th><th>Country</th></tr>"), F.concat_ws("", F.collect_list(row)), F.lit("</table>"))
    pages = x.groupBy(F.floor(F.col("s_suppkey") / 40)).agg(page.alias("html"))
    return lateral.listed(pages, "html", markets={"EUROPE": ("XEUR", "EUR"), "ASIA": ("XASI", "JPY")}, ticker=universe.canonical_ticker(F.col("ticker")))


@query("SELECT sector, count(*) AS n FROM members GROUP BY 1", MEMBERS)
def members_by_sector(s, d):
    return members(s, d).groupBy("sector").agg(F.count("*").alias("n"))


@query(f"""SELECT k.ticker, k.mic, CASE WHEN coalesce(last_date + 1, DATE '1990-01-01') <= {DAY} THEN coalesce(last_date + 1, DATE '1990-01-01') END AS "start" FROM (SELECT DISTINCT ticker, mic FROM bars) k
LEFT JOIN (SELECT ticker, mic, max(date) AS last_date FROM bars WHERE date < DATE '1997-06-01' AND ticker NOT LIKE '%2' GROUP BY 1, 2) l ON k.ticker = l.ticker AND k.mic = l.mic""", BARS)
def fetch_plan(s, d):
    b = bars(s, d)
    return ingest.plan_fetch(universe.universe_keys(b), tables.last_dates(b.where("date < DATE '1997-06-01' AND ticker NOT LIKE '%2'")), THE_DAY, datetime(1990, 1, 1).date())


@query(f"SELECT DISTINCT ticker, mic FROM bars EXCEPT SELECT ticker, mic FROM bars WHERE date = {DAY}", BARS)
def missing_bar(s, d):
    b = bars(s, d)
    planned = ingest.plan_fetch(universe.universe_keys(b), tables.last_dates(b.limit(0)), THE_DAY, datetime(1990, 1, 1).date())
    return ingest.without_bar(planned, b, THE_DAY).select(*KEY)


@query("SELECT ticker, mic, max(date) AS last_date FROM bars GROUP BY 1, 2 HAVING max(date) < (SELECT max(date) FROM bars)", BARS)
def stale_keys(s, d):
    b = bars(s, d)
    return ingest.stale_keys(universe.universe_keys(b), tables.last_dates(b), b.agg(F.max("date").alias("x")).first().x)


@query(f"""SELECT ticker, mic, name, sector, "start", CASE WHEN "end" IS NULL AND ticker LIKE '%1' THEN {DAY} ELSE "end" END AS "end" FROM members
UNION ALL SELECT ticker || 'N', mic, name, sector, {DAY}, NULL FROM members WHERE ticker LIKE '%2'""", MEMBERS)
def snapshot_roll(s, d):
    m = members(s, d)
    fresh = m.where("ticker NOT LIKE '%1'").unionByName(m.where("ticker LIKE '%2'").withColumn("ticker", F.concat("ticker", F.lit("N"))))
    fresh = fresh.where("end IS NULL OR ticker LIKE '%N'")
    return universe.roll_snapshot(m, fresh, THE_DAY)


@query("""SELECT ticker, mic, coalesce(CASE WHEN ticker LIKE '%3' THEN NULL ELSE sector END, 'filled ' || name) AS sector FROM members""", MEMBERS)
def merge_fill(s, d):
    m = members(s, d)
    left = m.select(*KEY, F.when(~F.col("ticker").like("%3"), F.col("sector")).alias("sector"))
    return universe.merge_fill(left, m.select("ticker", F.concat(F.lit("filled "), F.col("name")).alias("sector")), ["sector"])


SESSIONS = """sessions AS (SELECT n_name AS mic, CAST(o_orderdate AS DATE) AS session, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) + INTERVAL 1 HOUR * (14 + n_nationkey % 10) AS close_at
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)"""


def _sessions(s, d):
    o = read(s, d, "orders").join(read(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(read(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    day = F.to_date("o_orderdate")
    return o.select(F.col("n_name").alias("mic"), day.alias("session"), (day.cast("timestamp") + F.make_dt_interval(hours=14 + F.col("n_nationkey") % 10)).alias("close_at")).distinct()


@query(f"SELECT mic, min(session) AS session FROM sessions WHERE session > {DAY} GROUP BY 1", SESSIONS)
def next_session(s, d):
    return sg.next_session(_sessions(s, d), THE_DAY)


_MARKETS = "markets AS (SELECT mic, row_number() OVER (ORDER BY mic) - 1 AS i FROM (SELECT DISTINCT mic FROM sessions))"


@query("""SELECT rule_id, mic, execute_on AS day, (SELECT min(session) FROM sessions x WHERE x.mic = s.mic AND x.session > s.execute_on) AS session
FROM (SELECT rule_id, execute_on, m.mic FROM signals JOIN markets m ON CAST(substr(rule_id, 2) AS BIGINT) % (SELECT count(*) + 1 FROM markets) = i) s""", SIGNALS, SESSIONS, _MARKETS)
def execution_session(s, d):
    """The next session of each signal's market; markets are dealt out by the signal's number, one remainder has none."""
    sessions = _sessions(s, d)
    markets = sessions.select("mic").distinct().withColumn("i", F.row_number().over(Window.orderBy("mic")) - 1)
    n = markets.agg((F.count("*") + 1).alias("n"))
    rows = signals(s, d).select("rule_id", F.col("execute_on").alias("day")).crossJoin(F.broadcast(n)).withColumn("i", (F.substring("rule_id", 2, 20).cast("long") % F.col("n")).cast("int"))
    return temporal.next_sessions(rows.join(markets, "i").select("rule_id", "mic", "day"), sessions, "day")


@query("""SELECT ticker, mic, day, arg_max(open, date) AS open, max(date) AS bar_day FROM (SELECT DISTINCT 'Brand#' || CAST(event_id % 5 + 1 AS VARCHAR) || CAST(user_id % 5 + 1 AS VARCHAR) AS ticker, 'XSYN' AS mic, CAST(ts AS DATE) - 9000 - CAST(user_id % 100 AS INTEGER) AS day FROM events) e
LEFT JOIN bars USING (ticker, mic) WHERE date IS NULL OR date <= day GROUP BY 1, 2, 3""", BARS)
def last_bar_before(s, d):
    """The last bar of a ticker at or before days on which it need not have one."""
    e = read(s, d, "events")
    brand = F.concat(F.lit("Brand#"), (F.col("event_id") % 5 + 1).cast("string"), (F.col("user_id") % 5 + 1).cast("string"))
    days = e.select(brand.alias("ticker"), F.lit("XSYN").alias("mic"), F.date_sub(F.to_date("ts"), (F.col("user_id") % 100).cast("int") + 9000).alias("day")).distinct()
    return temporal.asof_join(days, bars(s, d).withColumn("bar_day", F.col("date")), list(KEY), "day", "date", ["open", "bar_day"])


@query("SELECT max(session) AS session FROM (SELECT session FROM sessions GROUP BY 1 HAVING bool_and(close_at <= TIMESTAMP '1997-06-15 18:00:00'))", SESSIONS)
def last_closed_session(s, d):
    return sg.last_closed_session(_sessions(s, d), datetime(1997, 6, 15, 18))


# --- quality and corporate actions ------------------------------------------------------------------------------------

_SHIFTED = "shifted AS (SELECT *, CASE WHEN volume % 7 = 0 THEN high * 1.01 ELSE close END AS c2 FROM bars)"


@query("SELECT ticker, mic, date FROM shifted WHERE c2 <= 0 OR high < low OR c2 > high * 1.001 OR c2 < low * 0.999", BARS, _SHIFTED)
def ohlc_invalid(s, d):
    b = bars(s, d).withColumn("close", F.when(F.col("volume") % 7 == 0, F.col("high") * 1.01).otherwise(F.col("close")))
    return b.where(quality.invalid_ohlc()).select(*KEY, "date")


_ANOMALIES = f"""anomalies AS (SELECT ticker, mic, date, CASE WHEN close <= 0 OR high < low OR close > high * 1.001 OR close < low * 0.999 THEN 'invalid_ohlc'
WHEN abs(adj_close / lag(adj_close) OVER {W} - 1) > 5.0 THEN 'jump'
WHEN v = 0 AND avg(CAST(v AS DOUBLE)) OVER (PARTITION BY ticker, mic ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) >= 10 THEN 'zero_volume' END AS reason
FROM (SELECT *, CASE WHEN volume % 11 = 0 THEN 0 ELSE volume END AS v FROM bars))"""


def _anomalies(s, d):
    b = bars(s, d).withColumn("volume", F.when(F.col("volume") % 11 == 0, 0).otherwise(F.col("volume")))
    return quality.find_anomalies(b, max_daily_jump=5.0, zero_volume_min_avg_volume=10.0)


@query("SELECT ticker, mic, date, reason FROM anomalies WHERE reason IS NOT NULL", BARS, _ANOMALIES)
def anomalies(s, d):
    return _anomalies(s, d)


@query("SELECT reason, count(*) AS n FROM anomalies WHERE reason IS NOT NULL GROUP BY 1", BARS, _ANOMALIES)
def anomalies_by_reason(s, d):
    return _anomalies(s, d).groupBy("reason").agg(F.count("*").alias("n"))


@query(f"""SELECT e AS expected, b AS with_bar, q AS quarantined, CAST(b - q AS DOUBLE) / e AS coverage FROM (SELECT (SELECT count(DISTINCT ticker) FROM bars) AS e,
(SELECT count(DISTINCT ticker) FROM bars WHERE date = {DAY}) AS b, (SELECT count(DISTINCT ticker) FROM anomalies WHERE date = {DAY} AND reason IS NOT NULL) AS q)""", BARS, _ANOMALIES)
def coverage(s, d):
    b = bars(s, d)
    return quality.coverage(universe.universe_keys(b), b, _anomalies(s, d), THE_DAY)


@query(f"SELECT b.* FROM bars b WHERE NOT (date = {DAY} AND ticker IN (SELECT ticker FROM anomalies WHERE date = {DAY} AND reason IS NOT NULL))", BARS, _ANOMALIES)
def promote(s, d):
    return quality.promote(bars(s, d), THE_DAY, _anomalies(s, d).where(F.col("date") == F.lit(THE_DAY)))


_RATIOS = ", ".join(repr(r) for r in actions.RATIOS)


@query(f"""SELECT ticker, mic, date, list_filter([{_RATIOS}]::DOUBLE[], lambda r: abs(1 / m / r - 1) <= 0.03)[1] AS value FROM (SELECT *, adj_close / lag(adj_close) OVER {W} AS m FROM bars)
WHERE abs(m - 1) >= 0.25 AND len(list_filter([{_RATIOS}]::DOUBLE[], lambda r: abs(1 / m / r - 1) <= 0.03)) > 0""", BARS)
def split_ratio(s, d):
    return actions.by_ratio(bars(s, d)).select(*KEY, "date", "value")


_FEED = "feed AS (SELECT *, CASE WHEN volume % 50 = 0 THEN 2.0 WHEN volume % 3 = 0 THEN 1.0 END AS split, CASE WHEN volume % 20 = 0 THEN close / 100 ELSE 0 END AS dividend FROM bars)"


def _feed(s, d):
    return bars(s, d).withColumn("split", F.when(F.col("volume") % 50 == 0, 2.0).when(F.col("volume") % 3 == 0, 1.0)).withColumn("dividend", F.when(F.col("volume") % 20 == 0, F.col("close") / 100).otherwise(0.0))


@query("SELECT ticker, mic, date, 'split' AS kind, CAST(split AS DOUBLE) AS value FROM feed WHERE split > 0 AND split <> 1 UNION ALL SELECT ticker, mic, date, 'dividend', dividend FROM feed WHERE dividend > 0", BARS, _FEED)
def feed_events(s, d):
    return actions.from_feed(_feed(s, d)).drop("source")


@query("SELECT DISTINCT f.ticker, f.mic FROM feed f JOIN loaded l ON f.ticker = l.ticker AND f.mic = l.mic JOIN loaded o ON o.ticker = f.ticker AND o.mic = f.mic WHERE f.split = 2.0 AND l.date = f.date AND o.date < f.date GROUP BY f.ticker, f.mic, f.date HAVING min(o.at) < max(l.at) - INTERVAL 1 HOUR",
       BARS, _FEED, "loaded AS (SELECT ticker, mic, date, TIMESTAMP '2024-01-01' + INTERVAL 1 MINUTE * (volume % 70 + CASE WHEN date >= DATE '1995-06-01' THEN 45 ELSE 0 END) AS at FROM bars)")
def needs_reingest(s, d):
    minutes = F.col("volume") % 70 + F.when(F.col("date") >= F.lit("1995-06-01").cast("date"), 45).otherwise(0)
    b = bars(s, d).withColumn("ingested_at", F.timestamp_seconds(1704067200 + minutes * 60))
    return actions.needs_reingest(b, actions.from_feed(_feed(s, d)).where("kind = 'split'"))


_RAW = """raw AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'SEHK: ' || p_partkey WHEN 1 THEN '28' || p_partkey % 10 || 'a' WHEN 2 THEN '0' || p_partkey || '00' WHEN 3 THEN 'BMV: ' || p_name || '*' ELSE ' ' END AS code,
CASE p_partkey % 4 WHEN 0 THEN 'XTKS' WHEN 1 THEN 'XNYS' WHEN 2 THEN 'XNONE' END AS mic FROM part)"""


@query(r"""SELECT p_partkey, CASE WHEN length(c) = 4 THEN c END AS code_4, nullif(upper(regexp_replace(own, '[^0-9A-Za-z&]', '', 'g')), '') AS exchange_code, nullif(replace(upper(trim(code)), '-', '.'), '') AS canonical,
replace(replace(upper(trim(code)), ' ', '-'), '.', '-') || CASE mic WHEN 'XTKS' THEN '.T' WHEN 'XNYS' THEN '' END AS symbol
FROM (SELECT *, CASE WHEN regexp_matches(k, '^[0-9]+$') AND length(k) < 4 THEN lpad(k, 4, '0') ELSE k END AS c FROM (SELECT *, upper(regexp_replace(own, '[^0-9A-Za-z]', '', 'g')) AS k FROM (SELECT *, split_part(code, ':', -1) AS own FROM raw)))""", _RAW)
def ticker_cleaners(s, d):
    k = F.col("p_partkey")
    code = F.when(k % 5 == 0, F.concat(F.lit("SEHK: "), k)).when(k % 5 == 1, F.concat(F.lit("28"), k % 10, F.lit("a"))).when(k % 5 == 2, F.concat(F.lit("0"), k, F.lit("00"))).when(k % 5 == 3, F.concat(F.lit("BMV: "), "p_name", F.lit("*"))).otherwise(" ")
    mic = F.when(k % 4 == 0, "XTKS").when(k % 4 == 1, "XNYS").when(k % 4 == 2, "XNONE")
    return read(s, d, "part").select("p_partkey", universe.code_ticker(code, 4).alias("code_4"), universe.exchange_code_ticker(code).alias("exchange_code"), universe.canonical_ticker(code).alias("canonical"), universe.feed_symbol(code, mic, {"XTKS": ".T", "XNYS": ""}).alias("symbol"))


_GAPPED = """gapped AS (SELECT ticker, mic, date, CASE WHEN volume % 7 <> 0 THEN high END AS high, CASE WHEN volume % 5 <> 0 THEN low * 1.01 END AS low, CASE WHEN volume % 11 <> 0 THEN close - CASE WHEN volume % 13 = 0 THEN close ELSE 0 END END AS close FROM bars)"""


@query("SELECT ticker, mic, date FROM gapped WHERE close IS NULL OR close <= 0 OR (high IS NOT NULL AND low IS NOT NULL AND (high < low OR close > high * 1.001 OR close < low * 0.999))", BARS, _GAPPED)
def ohlc_invalid_nulls(s, d):
    v = F.col("volume")
    b = bars(s, d).withColumns({"high": F.when(v % 7 != 0, F.col("high")), "low": F.when(v % 5 != 0, F.col("low") * 1.01), "close": F.when(v % 11 != 0, F.col("close") - F.when(v % 13 == 0, F.col("close")).otherwise(0))})
    return b.where(quality.invalid_ohlc()).select(*KEY, "date")


# --- indicators -------------------------------------------------------------------------------------------------------

def _frame(n: int) -> str:
    return f"(PARTITION BY ticker, mic ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _full(column: str, n: int, digits: int = 6) -> str:
    return f"CASE WHEN count({column}) OVER {_frame(n)} = {n} THEN " + rnd_sql(f"avg({column}) OVER {_frame(n)}", digits) + " END"


@query(f"SELECT ticker, mic, date, {', '.join(f'{_full("adj_close", n)} AS sma_{n}' for n in (20, 50, 200))} FROM bars", BARS)
def sma(s, d):
    return bars(s, d).select(*KEY, "date", *[rnd(ind.sma("adj_close", n), 6).alias(f"sma_{n}") for n in (20, 50, 200)])


@query(f"SELECT ticker, mic, date, {', '.join(f'{_full("adj_close", n)} AS sma_{n}' for n in (20, 50, 200))} FROM bars", BARS)
def sma_clustered(s, d):
    """The same over a stored table that is clustered by key: no shuffle once it is written."""
    stored = clustered.read_clustered(s, clustered.write_clustered(bars(s, d).select(*KEY, "date", "adj_close")))
    return stored.select(*KEY, "date", *[rnd(ind.sma("adj_close", n), 6).alias(f"sma_{n}") for n in (20, 50, 200)])


@query(f"SELECT ticker, mic, date, {_full('volume', 20)} AS avg_volume_20 FROM bars", BARS)
def avg_volume(s, d):
    return bars(s, d).select(*KEY, "date", rnd(ind.sma("volume", 20), 6).alias("avg_volume_20"))


@query(f"SELECT ticker, mic, date, {', '.join(f'adj_close / lag(adj_close, {n}) OVER {W} - 1 AS ret_{n}d' for n in (1, 5, 20))} FROM bars", BARS)
def returns(s, d):
    return bars(s, d).select(*KEY, "date", *[ind.ret("adj_close", n).alias(f"ret_{n}d") for n in (1, 5, 20)])


def _ema(x: str, alpha: str, seed: int, first: int, name: str, source: str) -> str:
    """CTE `name`: source plus a column name, the mean of x that starts at row `seed` with the plain mean of rows first..seed."""
    a = f"(1 - {alpha})"
    return f"""{name} AS (SELECT *, CASE WHEN i >= {seed} THEN pow({a}, i - {seed}) * (avg(CASE WHEN i BETWEEN {first} AND {seed} THEN {x} END) OVER (PARTITION BY ticker, mic)
+ {alpha} * coalesce(sum(CASE WHEN i > {seed} THEN {x} * pow({a}, {seed} - i) END) OVER (PARTITION BY ticker, mic ORDER BY i ROWS UNBOUNDED PRECEDING), 0)) END AS c_{name} FROM {source})"""


_NUMBERED = f"""numbered AS (SELECT *, row_number() OVER {W} - 1 AS i, adj_close - lag(adj_close) OVER {W} AS dx,
CASE WHEN lag(close) OVER {W} IS NOT NULL THEN greatest(high - low, abs(high - lag(close) OVER {W}), abs(low - lag(close) OVER {W})) END AS tr FROM bars)"""


@query(f"SELECT ticker, mic, date, CASE WHEN c_gain + c_loss > 0 THEN {rnd_sql('100 * c_gain / (c_gain + c_loss)', 6)} WHEN c_gain + c_loss = 0 THEN 50.0 END AS rsi_14 FROM loss",
       BARS, _NUMBERED, _ema("greatest(dx, 0)", "(1.0 / 14)::DOUBLE", 14, 1, "gain", "numbered"), _ema("greatest(-dx, 0)", "(1.0 / 14)::DOUBLE", 14, 1, "loss", "gain"))
def rsi(s, d):
    return ind.indicators(_priced(bars(s, d)), ["rsi_14"]).select(*KEY, "date", rnd(F.col("rsi_14"), 6).alias("rsi_14"))


@query(f"SELECT ticker, mic, date, {rnd_sql('c_atr', 6)} AS atr_14 FROM atr", BARS, _NUMBERED, _ema("tr", "(1.0 / 14)::DOUBLE", 14, 1, "atr", "numbered"))
def atr(s, d):
    return ind.indicators(_priced(bars(s, d)), ["atr_14"]).select(*KEY, "date", rnd(F.col("atr_14"), 6).alias("atr_14"))


@query(f"SELECT ticker, mic, date, CASE WHEN c_sig IS NOT NULL THEN {rnd_sql('c_fast - c_slow', 6)} END AS macd, {rnd_sql('c_sig', 6)} AS macd_signal, {rnd_sql('c_fast - c_slow - c_sig', 6)} AS macd_hist FROM sig",
       BARS, _NUMBERED, _ema("adj_close", "(2.0 / 13)::DOUBLE", 11, 0, "fast", "numbered"), _ema("adj_close", "(2.0 / 27)::DOUBLE", 25, 0, "slow", "fast"), _ema("(c_fast - c_slow)", "0.2::DOUBLE", 33, 25, "sig", "slow"))
def macd(s, d):
    x = ind.indicators(_priced(bars(s, d)), ["macd", "macd_signal", "macd_hist"])
    return x.select(*KEY, "date", *[rnd(F.col(c), 6).alias(c) for c in ("macd", "macd_signal", "macd_hist")])


# the same over bars whose closes before a 2:1 split are adjusted, in two markets
_SPLIT = (BARS.replace("bars AS (", "plain_bars AS (", 1), """unadjusted AS (SELECT * REPLACE (CASE WHEN ticker LIKE '%2' THEN 'XTST' ELSE mic END AS mic, close * CASE WHEN date < DATE '1995-06-01' THEN 0.5::DOUBLE ELSE 1 END AS adj_close) FROM plain_bars)""",
          "bars AS (SELECT ticker, mic, date, high * adj_close / close AS high, low * adj_close / close AS low, adj_close AS close, adj_close FROM unadjusted)")


def _split_bars(s, d):
    b = bars(s, d).withColumn("mic", F.when(F.col("ticker").like("%2"), "XTST").otherwise(F.col("mic")))
    return b.withColumn("adj_close", F.col("close") * F.when(F.col("date") < F.lit("1995-06-01").cast("date"), 0.5).otherwise(1.0))


def _priced(b):
    return b.select(*KEY, "date", "high", "low", "close", "adj_close")


@query(f"SELECT ticker, mic, date, CASE WHEN c_gain + c_loss > 0 THEN {rnd_sql('100 * c_gain / (c_gain + c_loss)', 6)} WHEN c_gain + c_loss = 0 THEN 50.0 END AS rsi_14, {rnd_sql('c_atr', 6)} AS atr_14, {_full('adj_close', 50)} AS sma_50, {rnd_sql(f'adj_close / lag(adj_close, 5) OVER {W} - 1', 6)} AS ret_5d FROM atr",
       *_SPLIT, _NUMBERED, _ema("greatest(dx, 0)", "(1.0 / 14)::DOUBLE", 14, 1, "gain", "numbered"), _ema("greatest(-dx, 0)", "(1.0 / 14)::DOUBLE", 14, 1, "loss", "gain"), _ema("tr", "(1.0 / 14)::DOUBLE", 14, 1, "atr", "loss"))
def adjusted_indicators(s, d):
    x = ind.indicators(_priced(_split_bars(s, d)), ["rsi_14", "atr_14", "sma_50", "ret_5d"])
    return x.select(*KEY, "date", rnd(F.col("rsi_14"), 6).alias("rsi_14"), rnd(F.col("atr_14"), 6).alias("atr_14"), rnd(F.col("sma_50"), 6).alias("sma_50"), rnd(F.col("ret_5d"), 6).alias("ret_5d"))


@query(f"""SELECT ticker, mic, date, list_filter([{_RATIOS}]::DOUBLE[], lambda r: abs(1 / m / r - 1) <= 0.03)[1] AS value FROM (SELECT *, adj_close / lag(adj_close) OVER {W} AS m, close / lag(close) OVER {W} AS p FROM unadjusted)
WHERE abs(m - 1) >= 0.25 AND abs(p / m - 1) <= 0.03 AND len(list_filter([{_RATIOS}]::DOUBLE[], lambda r: abs(1 / m / r - 1) <= 0.03)) > 0""", *_SPLIT)
def adjusted_split_ratio(s, d):
    return actions.by_ratio(_split_bars(s, d)).select(*KEY, "date", "value")


_TR = f"ranged AS (SELECT *, greatest(high - low, abs(high - lag(close) OVER {W}), abs(low - lag(close) OVER {W})) AS tr FROM bars)"


@query(f"SELECT ticker, mic, date, {_full('tr', 14)} AS pattern_atr FROM ranged", BARS, _TR)
def pattern_atr(s, d):
    b = bars(s, d).withColumn("_tr", ind.true_range(F.col("high"), F.col("low"), F.col("close")))
    return b.select(*KEY, "date", rnd(ind.pattern_atr(), 6).alias("pattern_atr"))


@query("SELECT ticker, mic, date, max(high) OVER (PARTITION BY ticker, mic ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS prior_max FROM bars", BARS)
def prior_max(s, d):
    return bars(s, d).select(*KEY, "date", ind.prior_max("high").alias("prior_max"))


@query(f"""SELECT b.ticker, b.mic, b.date FROM (SELECT *, row_number() OVER {W} - 1 AS pos, count(*) OVER (PARTITION BY ticker, mic) AS n FROM bars) b
LEFT JOIN (SELECT ticker, mic, max(date) AS last_date FROM bars WHERE date < DATE '1997-06-01' AND ticker NOT LIKE '%2' GROUP BY 1, 2) l ON b.ticker = l.ticker AND b.mic = l.mic
WHERE (pos >= 199 OR n <= 199) AND (last_date IS NULL OR b.date > last_date OR b.ticker LIKE '%3')""", BARS)
def incremental_rows(s, d):
    b = bars(s, d)
    stored = tables.last_dates(b.where("date < DATE '1997-06-01' AND ticker NOT LIKE '%2'"))
    return ind.select_rows(b, stored, b.where("ticker LIKE '%3'").select(*KEY).distinct()).select(*KEY, "date")


@query(f"SELECT ticker, mic, date, date_diff('day', date, m) AS age, recency FROM (SELECT *, max(date) OVER (PARTITION BY ticker, mic) AS m, row_number() OVER (PARTITION BY ticker, mic ORDER BY date DESC) - 1 AS recency FROM bars) WHERE recency < 8", BARS)
def recency_tail(s, d):
    b = bars(s, d).withColumn("m", F.max("date").over(Window.partitionBy(*KEY)))
    return ind.tail(b, 8).select(*KEY, "date", F.datediff("m", "date").cast("long").alias("age"), F.col("recency").cast("long").alias("recency"))


_SMA = f"averaged AS (SELECT *, CASE WHEN count(adj_close) OVER {_frame(20)} = 20 THEN avg(adj_close) OVER {_frame(20)} END AS sma_20, CASE WHEN count(volume) OVER {_frame(20)} = 20 THEN avg(volume) OVER {_frame(20)} END AS avg_volume_20 FROM bars)"


def _averaged(s, d, since=None):
    b = bars(s, d) if since is None else bars(s, d).where(F.col("date") >= F.lit(since))
    return b.withColumns({"sma_20": ind.sma("adj_close", 20), "avg_volume_20": ind.sma("volume", 20)})


def _cross(s, d, expr):
    return _averaged(s, d).withColumn("hit", compile_expression(expr).column).where("hit").select(*KEY, "date")


@query(f"SELECT ticker, mic, date FROM (SELECT *, coalesce(close > sma_20, false) AND coalesce(lag(close) OVER {W} <= lag(sma_20) OVER {W}, false) AS hit FROM averaged) WHERE hit", BARS, _SMA)
def bullish_cross(s, d):
    return _cross(s, d, "bullish_cross(close, sma_20)")


@query(f"SELECT ticker, mic, date FROM (SELECT *, coalesce(close < sma_20, false) AND coalesce(lag(close) OVER {W} >= lag(sma_20) OVER {W}, false) AS hit FROM averaged) WHERE hit", BARS, _SMA)
def bearish_cross(s, d):
    return _cross(s, d, "bearish_cross(close, sma_20)")


@query(f"SELECT ticker, mic, date FROM (SELECT *, NOT coalesce(close > sma_20, false) AND NOT coalesce(ticker = 'Brand#11', false) AND coalesce(-1 < volume, false) AND coalesce(volume / nullif(avg_volume_20, 0) >= 1.2, false) AS hit FROM averaged) WHERE hit", BARS, _SMA)
def rule_expression(s, d):
    return _cross(s, d, "not close > sma_20 and ticker != 'Brand#11' and -1 < volume and volume / avg_volume_20 >= 1.2")


# --- rules and panels -------------------------------------------------------------------------------------------------

RULE = screener.Rule("breakout", "long", (screener.Condition("close > sma_20", 0.6, True), screener.Condition("volume > 1.2 * avg_volume_20", 0.3), screener.Condition("bullish_cross(close, sma_20)", 0.1)), window=3, threshold=0.6)


def _last_day(b):
    return b.agg(F.max("date").alias("x")).first().x


def _panel(b):
    """Keys that have a row on the last day."""
    return b.where(F.col("date") == F.lit(_last_day(b)))


@query(f"""SELECT ticker, mic, 'breakout' AS rule_id, score, conditions_met, close FROM (SELECT ticker, mic, CASE WHEN c1 THEN round_even(0.6 * c1::INT + 0.3 * c2::INT + 0.1 * c3::INT, 6) ELSE 0 END AS score,
array_to_string(list_filter([CASE WHEN c1 THEN 'close > sma_20' END, CASE WHEN c2 THEN 'volume > 1.2 * avg_volume_20' END, CASE WHEN c3 THEN 'bullish_cross(close, sma_20)' END], lambda x: x IS NOT NULL), '; ') AS conditions_met, close
FROM (SELECT ticker, mic, bool_or(coalesce(close > sma_20, false)) AS c1, bool_or(coalesce(volume > 1.2 * avg_volume_20, false)) AS c2, bool_or(x) AS c3, arg_max(close, date) AS close, max(date) AS last, arg_max(avg_volume_20, date) AS av
FROM (SELECT *, row_number() OVER (PARTITION BY ticker, mic ORDER BY date DESC) - 1 AS rec, coalesce(close > sma_20, false) AND coalesce(lag(close) OVER {W} <= lag(sma_20) OVER {W}, false) AS x FROM averaged)
WHERE rec < 3 GROUP BY 1, 2) WHERE last = (SELECT max(date) FROM bars) AND av >= 1) WHERE score >= 0.6 ORDER BY score DESC, ticker, mic LIMIT 20""", BARS, _SMA)
def top_candidates(s, d):
    day = _last_day(bars(s, d))
    # the windows of the means read only days that can hold the rule's sessions and the means' own, gaps allowed for
    x = _averaged(s, d, since=universe.lookback_start(day, 5 * (20 + screener.compile_rule(RULE).sessions)))
    return screener.run_screener(x.where(F.col("date") == F.lit(day)), day, rules=[RULE], indicators=x, min_avg_volume=1.0).select(*KEY, "rule_id", "score", "conditions_met", "close")


@query(f"SELECT b.ticker, b.mic, b.close, b.volume, m.n AS members FROM bars b JOIN (SELECT ticker, mic, count(*) AS n FROM bars GROUP BY 1, 2) m ON b.ticker = m.ticker AND b.mic = m.mic WHERE b.date = {DAY}", BARS)
def panel(s, d):
    b = bars(s, d)
    return sg.build_panel(b.groupBy(*KEY).agg(F.count("*").alias("members")), b.where(F.col("date") == F.lit(THE_DAY)).select(*KEY, "close", "volume")).select(*KEY, "close", "volume", "members")


@query("SELECT ticker, mic, date, sha256(ticker || chr(31) || mic || chr(31) || CAST(volume AS VARCHAR)) AS row_hash FROM bars", BARS)
def panel_row_hash(s, d):
    return bars(s, d).select(*KEY, "date", sg.row_hash([("ticker", "string"), ("mic", "string"), ("volume", "bigint")]).alias("row_hash"))


@query()
def shipped_rules(s, d):
    # on smoothed prices, whose jumps leave figures, on the latest day on which one completes
    # bars, a row per brand and day, are made from the line items once, and what is derived from them once for all jobs
    scratch = Scratch(s)
    b = scratch.keep(smooth(s, d).withColumn("volume", F.col("volume") * 1_000_000), "bars")
    flags = scratch.keep(patterns.pattern_columns(b), "flags")
    done = F.greatest(*[F.coalesce(f"pat_{p}", F.lit(0.0)) for p in PATTERN_NAMES]) == 1
    day = flags.agg(F.coalesce(F.max(F.when(done, F.col("date"))), F.max("date")).alias("d")).first().d
    x = scratch.keep(ind.indicators(b).join(flags, [*KEY, "date"]), "indicators")
    today = x.where(F.col("date") == F.lit(day)).select(*KEY, "avg_volume_20", F.lit("none").alias("sector"))
    return screener.run_screener(today, day, rules=screener.RULES, indicators=x)


# --- chart patterns -----------------------------------------------------------------------------------------------------

def _flag_sql(sign: int) -> str:
    h, lo, c = ("high", "low", "close") if sign > 0 else ("-low", "-high", "-close")
    return f"""SELECT ticker, mic, date, {rnd_sql(f'{sign} * v', 6)} AS entry, {rnd_sql(f'{sign} * (dip - 0.25 * a)', 4)} AS stop, {rnd_sql(f'{sign} * (dip + v - base)', 4)} AS target FROM (
SELECT c.ticker, c.mic, c.date, c.t.v AS v, c.t.a AS a, c.cc, min(b.lo) FILTER (WHERE b.i >= -c.t.n - 15 AND b.i < -c.t.n) AS base, max(b.h) FILTER (WHERE b.i >= -c.t.n - 15 AND b.i < -c.t.n) AS before, min(b.lo) FILTER (WHERE b.i > -c.t.n) AS dip
FROM (SELECT *, max({{'v': h, 'n': -i, 'a': a}}) OVER (PARTITION BY ticker, mic ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS t FROM view) c JOIN view b ON b.ticker = c.ticker AND b.mic = c.mic AND b.i < c.i AND b.i >= c.i - 35
WHERE c.i > 35 AND c.cc > c.t.v AND c.i + c.t.n >= 4 GROUP BY ALL) WHERE before <= v AND v - base >= 6 * a AND v - dip <= 0.5 * (v - base) AND cc < dip + v - base""".replace("view", f"(SELECT ticker, mic, date, row_number() OVER {W} AS i, {h} AS h, {lo} AS lo, {c} AS cc, CASE WHEN count(tr) OVER {_frame(14)} = 14 THEN avg(tr) OVER {_frame(14)} END AS a FROM smooth)")


# daily prices of the test tables jump far more than flags allow, so they are smoothed first
_SMOOTH_COLUMNS = ", ".join(f"avg({c}) OVER {_frame(20)} AS {c}" for c in ("open", "high", "low", "close"))
_SMOOTH = f"smooth0 AS (SELECT ticker, mic, date, {_SMOOTH_COLUMNS} FROM bars), smooth AS (SELECT *, greatest(high - low, abs(high - lag(close) OVER {W}), abs(low - lag(close) OVER {W})) AS tr FROM smooth0)"


def smooth(s, d):
    w = ind.by_key().rowsBetween(-19, 0)
    b = bars(s, d)
    return b.select(*KEY, "date", *[F.avg(c).over(w).alias(c) for c in ("open", "high", "low", "close")], "volume").withColumn("adj_close", F.col("close"))


def _flags(s, d, sign):
    f = patterns.flags(smooth(s, d), sign)
    return f.select(*KEY, "date", rnd(F.col("entry"), 6).alias("entry"), rnd(F.col("stop"), 4).alias("stop"), rnd(F.col("target"), 4).alias("target"))


@query(_flag_sql(1), BARS, _SMOOTH)
def bull_flag(s, d):
    return _flags(s, d, 1)


@query(_flag_sql(-1), BARS, _SMOOTH)
def bear_flag(s, d):
    return _flags(s, d, -1)


@query()
def pivots(s, d):
    return patterns.find_pivots(smooth(s, d))


@query()
def chart_patterns(s, d):
    return patterns.find_patterns(smooth(s, d))


@query()
def pattern_flags(s, d):
    return patterns.pattern_columns(smooth(s, d))


_MATCHES = """matches AS (SELECT ticker, mic, date, i, CASE WHEN volume % 2 = 0 THEN 'double_bottom' ELSE 'double_top' END AS pattern, CASE WHEN volume % 2 = 0 THEN 'long' ELSE 'short' END AS direction,
CASE WHEN volume % 2 = 0 THEN close * 0.7 ELSE close * 1.3 END AS stop, CASE WHEN volume % 2 = 0 THEN close * 1.5 ELSE close * 0.5 END AS target FROM n)"""
_N = f"n AS (SELECT *, row_number() OVER {W} AS i FROM bars)"
_OUTCOMES = f"""walked AS (SELECT m.*, b.i - m.i AS k, CASE WHEN direction = 'long' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS sign, b.open, b.close AS bc,
CASE WHEN (direction = 'long' AND b.low <= stop) OR (direction = 'short' AND b.high >= stop) THEN 'stop' WHEN (direction = 'long' AND b.high >= target) OR (direction = 'short' AND b.low <= target) THEN 'target' END AS hit
FROM matches m JOIN n b ON b.ticker = m.ticker AND b.mic = m.mic AND b.i BETWEEN m.i + 1 AND m.i + 40),
ends AS (SELECT ticker, mic, date, pattern, direction, stop, target, sign, max(open) FILTER (WHERE k = 1) AS entry, arg_min(hit, k) FILTER (WHERE hit IS NOT NULL) AS hit, min(k) FILTER (WHERE hit IS NOT NULL) AS hk, max(k) AS lk, arg_max(bc, k) AS lc FROM walked GROUP BY ALL),
outcomes AS (SELECT ticker, mic, date, pattern, direction, entry, stop, target, CASE WHEN void THEN 'void' ELSE coalesce(hit, 'open') END AS outcome, CAST(CASE WHEN void THEN 0 ELSE coalesce(hk, lk) END AS INTEGER) AS sessions,
CASE WHEN NOT void THEN sign * (CASE hit WHEN 'stop' THEN stop WHEN 'target' THEN target ELSE lc END / entry - 1) END AS ret FROM (SELECT *, sign * entry <= sign * stop OR sign * entry >= sign * target AS void FROM ends WHERE entry > 0))"""


def _outcomes(s, d):
    b = bars(s, d)
    even = F.col("volume") % 2 == 0
    m = b.select(*KEY, "date", F.when(even, "double_bottom").otherwise("double_top").alias("pattern"), F.when(even, "long").otherwise("short").alias("direction"), F.when(even, F.col("close") * 0.7).otherwise(F.col("close") * 1.3).alias("stop"), F.when(even, F.col("close") * 1.5).otherwise(F.col("close") * 0.5).alias("target"))
    return patterns.follow(m, b)


@query("SELECT * FROM outcomes", BARS, _N, _MATCHES, _OUTCOMES)
def trade_outcomes(s, d):
    return _outcomes(s, d)


_COUNTS = ", ".join(f"count(*) FILTER (WHERE outcome = '{o}') AS n_{o}" for o in ("target", "stop", "open", "void"))
_STATS = f"count(outcome) AS n, {_COUNTS}, {rnd_sql('avg(ret)', 6)} AS mean_ret, CASE WHEN count(*) FILTER (WHERE outcome IN ('target', 'stop')) > 0 THEN CAST(count(*) FILTER (WHERE outcome = 'target') AS DOUBLE) / count(*) FILTER (WHERE outcome IN ('target', 'stop')) END AS hit_ratio"
_ALL = "SELECT unnest(['" + "', '".join(patterns.PATTERN_NAMES) + "']) AS pattern"


@query(f"SELECT p.pattern, {_STATS} FROM ({_ALL}) p LEFT JOIN outcomes o ON p.pattern = o.pattern GROUP BY 1", BARS, _N, _MATCHES, _OUTCOMES)
def pattern_stats(s, d):
    return patterns.pattern_stats(_outcomes(s, d)).withColumn("mean_ret", rnd(F.col("mean_ret"), 6))


@query(f"SELECT CAST(year(date) AS INTEGER) AS year, pattern, {_STATS} FROM outcomes GROUP BY 1, 2", BARS, _N, _MATCHES, _OUTCOMES)
def pattern_stats_yearly(s, d):
    return patterns.pattern_stats_yearly(_outcomes(s, d)).withColumn("mean_ret", rnd(F.col("mean_ret"), 6))


# --- text and news ------------------------------------------------------------------------------------------------------

_NORM = "trim(regexp_replace(strip_accents(replace(lower(text), 'ß', 'ss')), '[^0-9a-z]+', ' ', 'g'))"


@query(f"SELECT doc_id, {_NORM} AS norm, sha256({_NORM}) AS digest FROM documents")
def text_normalize(s, d):
    return read(s, d, "documents").select("doc_id", tx.normalize_latin(F.col("text")).alias("norm")).withColumn("digest", tx.text_hash(F.col("norm")))


@query(f"SELECT doc_id, {_NORM} AS norm FROM documents")
def text_normalize_unicode(s, d):
    return read(s, d, "documents").select("doc_id", tx.normalize("text").alias("norm"))


@query(r"""SELECT doc_id, CASE WHEN length(text) <= 60 THEN text ELSE regexp_replace(regexp_replace(substr(text, 1, 60), ' [^ ]*\z', ''), '[.,;:]+\z', '') || '...' END AS clipped,
CASE WHEN length(f) <= 160 THEN f ELSE regexp_replace(regexp_replace(substr(f, 1, 160), ' [^ ]*\z', ''), '[,;:]+\z', '') || '…' END AS brief
FROM (SELECT doc_id, text, CASE WHEN p > 1 AND p <= 160 THEN substr(t, 1, p) WHEN q > 1 AND q <= 160 THEN rtrim(substr(t, 1, q), ';') ELSE t END AS f
FROM (SELECT *, strpos(t, '. ') AS p, strpos(t, '; ') AS q FROM (SELECT doc_id, text, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents)))""")
def clip_brief(s, d):
    return read(s, d, "documents").select("doc_id", tx.clip(F.col("text"), 60).alias("clipped"), tx.brief(F.col("text")).alias("brief"))


@query(r"SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS plain FROM pages")
def clean_html(s, d):
    return read(s, d, "pages").select("page_id", tx.strip_tags(F.col("html")).alias("plain"))


_CHAIN = """SELECT id, min(id) OVER (PARTITION BY language, h, s) AS chain FROM (SELECT *, sum(CASE WHEN gap > INTERVAL 48 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY language, h ORDER BY published_at, id) AS s
FROM (SELECT *, published_at - lag(published_at) OVER (PARTITION BY language, h ORDER BY published_at, id) AS gap FROM (SELECT *, sha256(lower(summary)) AS h FROM articles)))"""


@query(_CHAIN, ARTICLES)
def exact_dups(s, d):
    return news.exact_chains(articles(s, d), F.col("language"), F.sha2(F.lower("summary"), 256)).select("id", "chain")


_SHINGLES = """words AS (SELECT doc_id, lang, string_split(trim(regexp_replace(strip_accents(replace(lower(text), 'ß', 'ss')), '[^0-9a-z]+', ' ', 'g')), ' ') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, lang, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT *, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM words) WHERE len(w) > 1 OR w[1] <> ''),
cnt AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1)"""
_JACCARD = "pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh a JOIN sh b ON a.lang = b.lang AND a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2)"


def _shingled(s, d):
    return read(s, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("grp"), tx.normalize_latin(F.col("text")).alias("shingles"))


_SIMILAR = "SELECT a, b, CAST(k AS DOUBLE) / (x.n + y.n - k) AS jaccard FROM pairs JOIN cnt x ON a = x.doc_id JOIN cnt y ON b = y.doc_id WHERE CAST(k AS DOUBLE) / (x.n + y.n - k) >= 0.85"


@query(_SIMILAR, _SHINGLES, _JACCARD)
def shingle_jaccard(s, d):
    return similarity.jaccard_pairs(_shingled(s, d), 0.85)


@query(_SIMILAR, _SHINGLES, _JACCARD)
def minhash_lsh(s, d):
    return similarity.minhash_pairs(_shingled(s, d), 0.85)


@query(f"""SELECT a.vec_id AS a, b.vec_id AS b, {rnd_sql("list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e)))", 6)} AS cosine FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id
WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.35""", "v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)")
def cosine_pairs(s, d):
    v = read(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("grp"), F.col("embedding").cast("array<double>").alias("x"))
    return similarity.cosine_pairs(v, 0.35).withColumn("cosine", rnd(F.col("cosine"), 6))


_COMPONENTS = """RECURSIVE e AS (SELECT doc_id AS a, min(doc_id) OVER (PARTITION BY md5(text)) AS b FROM documents UNION ALL SELECT doc_id, doc_id - 1 FROM documents WHERE doc_id % 5 <> 0),
z AS (SELECT a AS x, b AS y FROM e UNION SELECT b, a FROM e), r AS (SELECT doc_id AS id, doc_id AS c FROM documents UNION SELECT z.x, r.c FROM r JOIN z ON z.y = r.id)"""


@query("SELECT id, min(c) AS component FROM r GROUP BY 1", _COMPONENTS)
def components(s, d):
    x = read(s, d, "documents")
    same = x.select(F.col("doc_id").alias("a"), F.min("doc_id").over(Window.partitionBy(F.md5("text"))).alias("b"))
    near = x.where("doc_id % 5 <> 0").select(F.col("doc_id").alias("a"), (F.col("doc_id") - 1).alias("b"))
    return graph.connected_components(same.union(near), x.select(F.col("doc_id").alias("id")))


_KRUSKAL = """{n}_state AS (SELECT CAST(0 AS BIGINT) AS k, (SELECT list(i ORDER BY i) FROM {n}_nodes) AS l, false AS took UNION ALL
SELECT s.k + 1, list_transform(s.l, lambda v: CASE WHEN v = greatest(s.l[e.a], s.l[e.b]) THEN least(s.l[e.a], s.l[e.b]) ELSE v END), s.l[e.a] <> s.l[e.b] FROM {n}_state s JOIN {n}_edges e ON e.k = s.k + 1),
{n}_last AS (SELECT l FROM {n}_state ORDER BY k DESC LIMIT 1)"""

#: The cascade in SQL: copies chained, then links of each level taken one by one in order, labels in a list.
_CASCADE = f"""RECURSIVE x AS (SELECT id, coalesce(language, '') AS grp, epoch_us(published_at) AS t, {_NORM.replace("text", "concat_ws('. ', nullif(trim(title), ''), nullif(trim(summary), ''))")} AS norm FROM articles),
gaps AS (SELECT *, t - lag(t) OVER (PARTITION BY grp, norm ORDER BY t, id) > 172800000000 AS gap FROM x),
runs AS (SELECT *, sum(CASE WHEN gap THEN 1 ELSE 0 END) OVER (PARTITION BY grp, norm ORDER BY t, id) AS s FROM gaps),
p AS (SELECT id, grp, t, norm, min(id) OVER (PARTITION BY grp, norm, s) AS chain, count(*) OVER (PARTITION BY grp, norm, s) AS copies FROM runs),
sh AS (SELECT DISTINCT id, grp, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT *, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM (SELECT id, grp, string_split(norm, ' ') AS w FROM p WHERE id = chain AND norm <> ''))),
cnt AS (SELECT id, count(*) AS n FROM sh GROUP BY 1),
alike AS (SELECT a, b FROM (SELECT a.id AS a, b.id AS b, count(*) AS k FROM sh a JOIN sh b ON a.grp = b.grp AND a.g = b.g AND a.id < b.id GROUP BY 1, 2) JOIN cnt x ON a = x.id JOIN cnt y ON b = y.id WHERE CAST(k AS DOUBLE) / (x.n + y.n - k) >= 0.85),
two AS (SELECT u.chain AS ca, v.chain AS cb, min(row(CASE WHEN u.id < v.id THEN u.t ELSE v.t END, least(u.id, v.id), greatest(u.id, v.id))) AS o FROM alike JOIN p u ON u.chain = a JOIN p v ON v.chain = b WHERE abs(u.t - v.t) <= 172800000000 GROUP BY 1, 2),
two_nodes AS (SELECT chain, row_number() OVER (ORDER BY chain) AS i FROM (SELECT DISTINCT chain FROM p)),
two_edges AS (SELECT row_number() OVER (ORDER BY o) AS k, u.i AS a, v.i AS b, o[2] AS l, o[3] AS r FROM two JOIN two_nodes u ON u.chain = ca JOIN two_nodes v ON v.chain = cb),
{_KRUSKAL.format(n="two")},
c2 AS (SELECT n.chain, m.chain AS c, count(*) OVER (PARTITION BY m.chain) AS parts FROM two_nodes n JOIN two_last ON true JOIN two_nodes m ON m.i = l[n.i]),
f2 AS (SELECT unnest([e.l, e.r]) AS id FROM two_state s JOIN two_edges e ON e.k = s.k WHERE took),
alone AS (SELECT p.id, p.grp, p.t, CAST(embedding AS DOUBLE[]) AS e FROM p JOIN c2 ON c2.chain = p.chain JOIN embeddings ON vec_id = p.id WHERE copies = 1 AND parts = 1),
three_nodes AS (SELECT id, row_number() OVER (ORDER BY id) AS i FROM alone),
three_edges AS (SELECT row_number() OVER (ORDER BY u.t, u.id, v.t, v.id) AS k, m.i AS a, n.i AS b, u.id AS l, v.id AS r FROM alone u JOIN alone v ON u.grp = v.grp AND row(u.t, u.id) < row(v.t, v.id) AND v.t - u.t <= 172800000000
JOIN three_nodes m ON m.id = u.id JOIN three_nodes n ON n.id = v.id WHERE list_dot_product(u.e, v.e) / (sqrt(list_dot_product(u.e, u.e)) * sqrt(list_dot_product(v.e, v.e))) >= 0.35),
{_KRUSKAL.format(n="three")},
c3 AS (SELECT n.id, m.id AS c FROM three_nodes n JOIN three_last ON true JOIN three_nodes m ON m.i = l[n.i]),
f3 AS (SELECT unnest([e.l, e.r]) AS id FROM three_state s JOIN three_edges e ON e.k = s.k WHERE took)"""


def _cascade(s, d):
    x = read(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("x"))
    # by language, where the given tables have more copies than by source
    return news.cascade(articles(s, d).withColumn("ticker", F.col("language")), vectors=lambda alone: alone.select("id").join(x, "id"), cosine=0.35)


@query("""SELECT p.id, coalesce(c3.c, c2.c) AS component, CASE WHEN p.id IN (SELECT id FROM f3) THEN 'embedding' WHEN p.id IN (SELECT id FROM f2) THEN 'minhash' WHEN copies > 1 THEN 'exact' ELSE 'single' END AS method
FROM p JOIN c2 ON c2.chain = p.chain LEFT JOIN c3 ON c3.id = p.id""", _CASCADE.replace("RECURSIVE ", "RECURSIVE " + ARTICLES + ", ", 1))
def cascade(s, d):
    return _cascade(s, d)[0].select("id", "component", "method")


@query("""SELECT 'exact' AS level, count(*) - count(DISTINCT chain) AS merges FROM p UNION ALL SELECT 'minhash', CAST(count_if(took) AS BIGINT) FROM two_state UNION ALL SELECT 'embedding', CAST(count_if(took) AS BIGINT) FROM three_state""", _CASCADE.replace("RECURSIVE ", "RECURSIVE " + ARTICLES + ", ", 1))
def cascade_merges(s, d):
    return _cascade(s, d)[1]


@query()
def cascade_model(s, d):
    """The cascade whose third level asks an embedder that is trained on the same articles."""
    a = articles(s, d)
    scratch = Scratch(s)
    # texts are read and hashed once: the embedder learns from their counted words, and embeds the same
    counts = scratch.keep(models.word_counts(a.select("id", tx.article_text(F.col("title"), F.col("summary")).alias("text"))), "words")
    embedder = models.fit_embedder(counts)
    out = news.cascade(a, vectors=lambda _: embedder.vectors(counts), cosine=0.85)[0].select("id", "component", "method")
    scratch.drop(counts)
    return out


def _sentiment_labels(s, d):
    label = F.when(F.col("toxic") == 1, "negative").when(F.col("quality") == 1, "positive").otherwise("neutral")
    return read(s, d, "labels").select("doc_id", label.alias("label"))


@query()
def sentiment_scores(s, d):
    """label and signed score of every document, by a model of the labelled ones."""
    scratch = Scratch(s)
    # texts are read once and don't move: the rounds read their counted words, and vectors meet the labels
    counts = scratch.keep(models.word_counts(read(s, d, "documents").select("doc_id", "text")), "words")
    embedder = models.fit_embedder(counts)
    vectors = scratch.keep(embedder.vectors(counts), "vectors")
    scratch.drop(counts)
    model = models.fit_sentiment(vectors.join(_sentiment_labels(s, d), "doc_id"), embedder)
    return model.scores(vectors)


_SCORED = """scored AS (SELECT *, concat_ws('. ', nullif(trim(title), ''), nullif(trim(summary), '')) AS t FROM articles),
ranked AS (SELECT *, floor((0.5 * reliability + 0.3 * CASE WHEN published_at = min(published_at) OVER (PARTITION BY ticker) THEN 1 ELSE 0 END + 0.2 * CAST(length(t) AS DOUBLE) / max(length(t)) OVER (PARTITION BY ticker)) * 1e9 + 0.5) AS s FROM scored)"""


def _scored(s, d):
    a = articles(s, d).withColumn("text", tx.article_text(F.col("title"), F.col("summary"))).withColumn("component", F.col("ticker"))
    return a.withColumn("method", F.lit("exact"))


@query("SELECT ticker, arg_min(id, row(-s, id)) AS representative_id FROM ranked GROUP BY 1", ARTICLES, _SCORED)
def representative(s, d):
    x = _scored(s, d).withColumn("s", F.floor(news.representative_score((0.5, 0.3, 0.2), ["component"]) * 1e9 + 0.5))
    return x.groupBy("ticker").agg(F.min_by("id", F.struct(-F.col("s"), "id")).alias("representative_id"))


@query("SELECT sha256(array_to_string(list_sort(list(CAST(id AS VARCHAR))), '|')) AS cluster_id, CAST(count(*) AS INTEGER) AS size, max(reliability)::DOUBLE AS reliability, min(published_at) AS first_published_at, max(published_at) AS last_published_at, array_to_string(list_sort(list(DISTINCT source)), ', ') AS sources FROM articles GROUP BY ticker", ARTICLES)
def topics(s, d):
    t = news.topics(_scored(s, d))
    return t.select("cluster_id", "size", "reliability", F.col("first_published_at").cast("timestamp_ntz").alias("first_published_at"), F.col("last_published_at").cast("timestamp_ntz").alias("last_published_at"), "sources")


@query("SELECT id, ticker, rank FROM (SELECT id, ticker, CAST(row_number() OVER (PARTITION BY ticker ORDER BY published_at DESC, length(summary) DESC, id) AS INTEGER) AS rank FROM articles) WHERE rank <= 5", ARTICLES)
def recent_topics(s, d):
    a = articles(s, d).select(F.col("id").alias("cluster_id"), "ticker", F.col("published_at").alias("last_published_at"), F.length("summary").alias("size"))
    return news.recent_topics(a).select(F.col("cluster_id").alias("id"), "ticker", F.col("rank").cast("int").alias("rank"))


@query("SELECT sentiment, count(*) AS n FROM (SELECT CASE WHEN toxic = 1 THEN -0.9 WHEN quality = 1 THEN 0.8 ELSE 0.0 END::DOUBLE AS sentiment FROM labels) GROUP BY 1")
def sentiment_counts(s, d):
    x = read(s, d, "labels").select(F.when(F.col("toxic") == 1, "negative").when(F.col("quality") == 1, "positive").otherwise("neutral").alias("label"))
    conf = F.when(F.col("label") == "negative", 0.9).otherwise(0.8)
    return x.select(tx.signed_sentiment(F.col("label"), conf).alias("sentiment")).groupBy("sentiment").agg(F.count("*").alias("n"))


# --- signals --------------------------------------------------------------------------------------------------------------

_RECONCILED = """reconciled AS (SELECT s.ticker, s.rule_id, s.execute_on, CASE WHEN b.open > 0 THEN b.open END AS execution_open, CASE WHEN b.open > 0 THEN b.open / s.close - 1 END AS open_gap
FROM signals s LEFT JOIN bars b ON s.ticker = b.ticker AND s.mic = b.mic AND s.execute_on = b.date),
marked AS (SELECT *, CASE WHEN open_gap IS NULL THEN 'sin_precio' WHEN abs(open_gap) - 0.5 > 1e-9 THEN 'desviada' ELSE 'conciliada' END AS reconcile_status FROM reconciled)"""


def _reconciled(s, d):
    return sg.reconcile(signals(s, d).where("close > 0"), bars(s, d), max_open_gap=0.5).select("ticker", "rule_id", "execute_on", "execution_open", "open_gap", "reconcile_status")


@query("SELECT * FROM marked", BARS, SIGNALS, _RECONCILED)
def reconcile(s, d):
    return _reconciled(s, d)


@query(f"SELECT count(*) FILTER (WHERE reconcile_status = 'conciliada') AS conciliada, count(*) FILTER (WHERE reconcile_status = 'desviada') AS desviada, count(*) FILTER (WHERE reconcile_status = 'sin_precio') AS sin_precio, {rnd_sql('avg(open_gap)', 6)} AS mean_gap, max(abs(open_gap)) AS max_abs_gap FROM marked", BARS, SIGNALS, _RECONCILED)
def reconcile_summary(s, d):
    return sg.reconcile_summary(_reconciled(s, d)).withColumn("mean_gap", rnd(F.col("mean_gap"), 6))


@query(f"SELECT ticker, rule_id, execute_on FROM signals WHERE execute_on <= {DAY} AND (reconcile_status IS NULL OR execute_on = {DAY})", SIGNALS)
def pending(s, d):
    return sg.pending(signals(s, d), THE_DAY).select("ticker", "rule_id", "execute_on")


@query("SELECT direction, count(*) FILTER (WHERE verdict = 'confirmar') AS confirmar, count(*) FILTER (WHERE verdict = 'vigilar') AS vigilar, count(*) FILTER (WHERE verdict = 'descartar') AS descartar FROM signals GROUP BY 1", SIGNALS)
def verdict_counts(s, d):
    return sg.verdict_counts(signals(s, d))


@query("SELECT ticker, direction, rule_id FROM (SELECT *, row_number() OVER (PARTITION BY ticker, mic, direction ORDER BY (pattern IS NOT NULL) DESC, confidence DESC, score DESC, rule_id) AS n FROM signals WHERE verdict = 'confirmar') WHERE n = 1", SIGNALS)
def operations_dedup(s, d):
    return sg.recommended(signals(s, d), True).select("ticker", "direction", "rule_id")


@query("SELECT coalesce(sum(cents), 0) / 100.0::DOUBLE AS cost_eur FROM (SELECT CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders WHERE year(o_orderdate) = 1997 AND month(o_orderdate) = 6)")
def month_cost(s, d):
    x = read(s, d, "orders").select(F.to_date("o_orderdate").alias("date"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cost_eur"))
    return sg.month_cost(x, THE_DAY).select((F.col("cost_eur") / 100.0).alias("cost_eur"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(s, d):
    return read(s, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query()
def payload_json(s, d):
    c = top_candidates(s, d).withColumn("direction", F.lit("long"))
    t = articles(s, d).select(F.col("id").cast("string").alias("cluster_id"), F.concat(F.lit("Brand#1"), (F.col("id") % 5 + 1).cast("string")).alias("ticker"), F.col("published_at").alias("last_published_at"), F.lit(1).alias("size"), F.col("source").alias("sources"), "title")
    return payload.build_payload(c, t)


# --- streams, as batches ------------------------------------------------------------------------------------------------

@query("""SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS "start", arg_min(value, row(ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, row(ts, event_id)) AS close, count(*) AS volume FROM events GROUP BY 1, 2""")
def event_bars(s, d):
    return windowed_bars(read(s, d, "events")).withColumn("start", F.col("start").cast("timestamp_ntz"))


_SESSIONED = """SELECT ticker, digest, min(published_at) AS first, max(published_at) AS last, count(*) AS copies FROM (SELECT *, sum(CASE WHEN gap > INTERVAL 1 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY ticker, digest ORDER BY published_at, id) AS s
FROM (SELECT *, published_at - lag(published_at) OVER (PARTITION BY ticker, digest ORDER BY published_at, id) AS gap FROM (SELECT *, substr(sha256(lower(title)), 1, 1) AS digest FROM articles))) GROUP BY ticker, digest, s"""


@query(_SESSIONED, ARTICLES)
def story_sessions(s, d):
    a = articles(s, d).withColumn("digest", F.substring(F.sha2(F.lower("title"), 256), 1, 1))
    x = sessions_of(a, gap="1 hour")
    return x.select("ticker", "digest", F.col("first").cast("timestamp_ntz").alias("first"), F.col("last").cast("timestamp_ntz").alias("last"), "copies")
