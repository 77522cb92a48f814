from datetime import date, datetime

import pytest

from tidemark.operators import actions, indicators, ingest, quality, signals, universe
from tidemark.schemas import check_identifier
from tidemark.sources import parsers
from tidemark.sources.registry import Budget
from tidemark.sources.tables import ConcurrentWrite, TableStore, existing_ids, normalize_prices
from tidemark.plans.delivery import Dispatcher, Message, split_text
from tidemark.plans.runner import Context, Pipeline, StepError, ok

BARS = "ticker string, mic string, date date, open double, high double, low double, close double, adj_close double, volume double"


def bars(spark, n=30, ticker="A", **last):
    rows = [[ticker, "X", date(2026, 8, 1 + i), 100.0, 101.0, 99.0, 100.0, 100.0, 2e6] for i in range(n)]
    for k, v in last.items():
        rows[-1][[x.split()[0] for x in BARS.split(", ")].index(k)] = v
    return spark.createDataFrame([tuple(r) for r in rows], BARS)


def test_upsert_is_idempotent_and_replace_day_clears(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    p = normalize_prices(bars(spark))
    store.upsert("prices", p)
    store.upsert("prices", p.withColumn("close", p.close + 1))
    assert store.read("prices").count() == 30 and store.read("prices").where("close = 101").count() == 30
    s = spark.createDataFrame([("A", "X", date(2026, 8, 1), "r", "eu")], "ticker string, mic string, date date, rule_id string, region string")
    store.replace_day("signals", s, region="eu", date=date(2026, 8, 1))
    assert store.update("signals", s.selectExpr("ticker", "mic", "date", "rule_id", "'desviada' AS reconcile_status"), ["reconcile_status"]) == 1
    assert store.read("signals").first().reconcile_status == "desviada"
    store.replace_day("signals", s.limit(0), region="eu", date=date(2026, 8, 1))
    assert store.read("signals").count() == 0


def test_identifiers():
    assert check_identifier("prices_1") == "prices_1"
    with pytest.raises(ValueError):
        check_identifier("a; drop")


def test_normalized_prices_keep_the_last(spark):
    b = bars(spark, 1).unionByName(bars(spark, 1, close=105.0, volume=2.5)).selectExpr("ticker", "CAST(NULL AS string) AS mic", "date", "open", "high", "low", "close", "adj_close", "volume")
    r = normalize_prices(b.coalesce(1)).collect()
    assert [(x.mic, x.close, x.volume) for x in r] == [("UNKNOWN", 105.0, 2)]


@pytest.mark.parametrize(("last", "reason"), [({}, None), ({"close": 0.0}, "invalid_ohlc"), ({"high": 98.0}, "invalid_ohlc"), ({"close": 150.0, "adj_close": 150.0, "high": 151.0}, "jump"), ({"volume": 0.0}, "zero_volume"), ({"close": 50.0, "low": 49.0, "adj_close": 100.0}, None)])
def test_anomalies(spark, last, reason):
    found = quality.find_anomalies(bars(spark, **last), date(2026, 8, 30), max_daily_jump=0.4, zero_volume_min_avg_volume=1e5).collect()
    assert [r.reason for r in found] == ([reason] if reason else [])


def test_quality_fails_closed(spark):
    keys = spark.createDataFrame([("A", "X"), ("B", "X")], "ticker string, mic string")
    report, _ = quality.run_quality(keys, bars(spark), date(2026, 8, 30))
    assert not report.passed and report.coverage == 0.5


def test_split_by_ratio(spark):
    found = actions.by_ratio(bars(spark, close=50.0, adj_close=50.0, low=49.0)).collect()
    assert [(r.kind, r.value) for r in found] == [("split", 2.0)]
    assert actions.by_ratio(bars(spark, close=50.0, low=49.0)).count() == 0


def test_roll_is_a_no_op_when_repeated(spark):
    kind = "ticker string, mic string, start date, end date"
    old = spark.createDataFrame([("SAP", "X", None, None), ("SIE", "X", None, None)], kind)
    fresh = spark.createDataFrame([("SAP", "X"), ("BMW", "X")], "ticker string, mic string")
    day = date(2026, 9, 1)
    once = universe.roll_snapshot(old, fresh, day)
    assert {(r.ticker, r.start, r.end) for r in once.collect()} == {("SAP", None, None), ("SIE", None, day), ("BMW", day, None)}
    assert {tuple(r) for r in universe.roll_snapshot(once, fresh, day).collect()} == {tuple(r) for r in once.collect()}


def test_membership_bounds(spark):
    t = spark.createDataFrame([("A", "X", date(2020, 1, 1), date(2021, 1, 1)), ("B", "X", None, None)], "ticker string, mic string, start date, end date")
    assert universe.members_as_of(t, date(2021, 1, 1)).count() == 1 and universe.members_as_of(t, date(2020, 1, 1)).count() == 2
    assert universe.lookback_start(date(2026, 1, 1), 250) == date(2024, 12, 26)


def test_fetch_plan(spark):
    keys = spark.createDataFrame([("A", "X"), ("B", "X")], "ticker string, mic string")
    last = spark.createDataFrame([("A", "X", date(2026, 8, 30))], "ticker string, mic string, last_date date")
    plan = {r.ticker: r.start for r in ingest.plan_fetch(keys, last, date(2026, 8, 30), date(2020, 1, 1)).collect()}
    assert plan == {"A": None, "B": date(2020, 1, 1)}


def test_indicators_have_their_warm_up(spark):
    r = indicators.indicators(bars(spark, 30)).orderBy("date").collect()
    assert [x.sma_20 is not None for x in r] == [i >= 19 for i in range(30)]
    assert [x.rsi_14 is not None for x in r] == [i >= 14 for i in range(30)] and r[-1].rsi_14 == 50.0
    assert all(x.macd is None and x.sma_200 is None for x in r)


def test_gap_at_the_limit_is_reconciled(spark):
    s = spark.createDataFrame([("A", "X", date(2026, 8, 1), 100.0), ("B", "X", date(2026, 8, 1), 100.0)], "ticker string, mic string, execute_on date, close double")
    c = spark.createDataFrame([("A", "X", date(2026, 8, 1), 102.0)], "ticker string, mic string, date date, open double")
    assert {r.ticker: r.reconcile_status for r in signals.reconcile(s, c).collect()} == {"A": "conciliada", "B": "sin_precio"}


def test_panel_hash_ignores_order_and_sees_values(spark):
    b = bars(spark, 5)
    h = signals.panel_hash(b)
    assert h == signals.panel_hash(b.orderBy(b.date.desc()).repartition(3)) != signals.panel_hash(bars(spark, 5, close=1.0))


def test_html_and_rss():
    page = "<table><tr><th>x</th></tr></table><table><tr><th>Ticker</th><th>Company</th></tr><tr><td>BRK.B[1]</td><td>B &amp; H</td></tr><tr></tr></table>"
    assert parsers.constituents_table(page, {"ticker": ["Symbol", "ticker"], "name": ["Company"]}) == [{"ticker": "BRK.B", "name": "B & H"}]
    feed = "<rss><channel><item><title>T</title><link>u</link><pubDate>Fri, 18 Sep 2026 08:00:00 +0200</pubDate></item><item><title>no date</title></item></channel></rss>"
    got = parsers.rss_entries(feed, "s", None, datetime.fromisoformat("2026-09-01T00:00:00+00:00"))
    assert [(x[3], x[5], x[2].hour) for x in got] == [("T", "u", 6)]


def test_unpivot(spark):
    wide = spark.createDataFrame([("2026-08-01", 1.0, None), ("2026-08-02", None, 2.0)], "date string, `A|Close` double, `B|Close` double")
    got = parsers.unpivot_download(wide, {"A": ("A", "X"), "B": ("B", "X"), "C": ("C", "X")})
    assert {(r.ticker, r.close, r.volume) for r in got.collect()} == {("A", 1.0, None), ("B", 2.0, None)}


def test_budget_messages_and_runner():
    b = Budget()
    assert b.reserve("p", date(2026, 1, 1), 20, 20) and not b.reserve("p", date(2026, 1, 1), 1, 20)
    assert split_text("aa\nbb\ncc", 5) == ["aa\nbb", "cc"]
    got = []
    d = Dispatcher({"bad": lambda m: 1 / 0, "good": got.append})
    assert d.send([Message("x")]) == 1 and len(d.errors) == 1 and len(got) == 1

    def fail(c):
        raise StepError("no")

    r = Pipeline([("a", lambda c: None), ("b", fail), ("c", lambda c: None)]).run(Context(None))
    assert [x.status for x in r] == ["ok", "failed"] and not ok(r)
    assert ok(Pipeline([("a", lambda c: c.stop("closed")), ("b", fail)]).run(Context(None)))


def test_existing_ids(spark):
    news = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "id string")
    asked = spark.createDataFrame([("b",), ("b",), ("c",), (None,)], "id string")
    assert [r.id for r in existing_ids(news, asked).collect()] == ["b"]


class Interrupted(TableStore):
    """A store whose reads let another writer go first, once."""

    other = None

    def _base(self, table):
        found = super()._base(table)
        if self.other:
            write, self.other = self.other, None
            write()
        return found


def test_of_two_writers_one_fails_loudly_and_nothing_is_lost(spark, tmp_path):
    one, two = TableStore(spark, str(tmp_path)), Interrupted(spark, str(tmp_path))
    a, b, c = (normalize_prices(bars(spark, 2, ticker=t)) for t in "ABC")
    one.upsert("prices", a)
    two.other = lambda: one.upsert("prices", b)
    with pytest.raises(ConcurrentWrite):
        two.upsert("prices", c)
    assert {r.ticker for r in one.read("prices").collect()} == {"A", "B"}
    two.upsert("prices", c)  # it may try again
    assert {r.ticker for r in one.read("prices").collect()} == {"A", "B", "C"}
    for write in (lambda: two.update("prices", a, ["close"]), lambda: two.replace_day("prices", a, date=date(2026, 8, 1))):
        two.other = lambda: one.upsert("prices", b)
        with pytest.raises(ConcurrentWrite):
            write()
    assert one.read("prices").count() == 6


def test_a_dead_writers_claim_is_released(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    store.upsert("prices", normalize_prices(bars(spark, 2)))
    store._fs.createNewFile(store._path("prices", f"_claim-{store._base('prices')[0] + 1:012d}"))
    with pytest.raises(ConcurrentWrite):
        store.upsert("prices", normalize_prices(bars(spark, 3)))
    store.release("prices")
    store.upsert("prices", normalize_prices(bars(spark, 3)))
    assert store.read("prices").count() == 3


def test_duplicates_are_chosen_by_their_columns_not_their_place(spark, tmp_path):
    rows = [("A", "X", date(2026, 8, 1), 1.0, 2.0, 1.0, c, c, v) for c, v in ((1.5, 10.0), (1.7, 10.0), (1.7, 30.0), (1.6, 90.0))]
    for order in (rows, rows[::-1], rows[2:] + rows[:2]):
        df = spark.createDataFrame(order, BARS).repartition(3)
        assert [(r.close, r.volume) for r in normalize_prices(df).collect()] == [(1.7, 30)]


def test_stale_history_by_one_window(spark):
    at = lambda h: datetime(2026, 8, 10, h)
    rows = [("A", "X", date(2026, 8, d), at(h)) for d, h in ((1, 3), (2, 9), (3, 9), (4, 12))] + [("B", "X", date(2026, 8, d), at(9)) for d in (1, 2, 2, 3)]
    window = spark.createDataFrame(rows, "ticker string, mic string, date date, ingested_at timestamp")
    events = lambda *e: spark.createDataFrame([(t, "X", date(2026, 8, d)) for t, d in e], "ticker string, mic string, date date")
    assert [r.ticker for r in actions.needs_reingest(window, events(("A", 3), ("A", 3), ("B", 3))).collect()] == ["A"]
    assert actions.needs_reingest(window, events(("A", 1), ("B", 1), ("B", 2))).count() == 0


def test_reconciliation_fails_if_the_store_has_fewer_signals(spark, tmp_path, monkeypatch):
    from tidemark.plans import steps

    store, day = TableStore(spark, str(tmp_path)), date(2026, 8, 2)
    signal = spark.createDataFrame([("A", "X", date(2026, 8, 1), "r", "eu", day, 100.0)], "ticker string, mic string, date date, rule_id string, region string, execute_on date, close double")
    store.replace_day("signals", signal, region="eu", date=date(2026, 8, 1))
    store.upsert("prices", normalize_prices(bars(spark, 3)))
    assert steps.run_reconcile(store, day, region="eu").first().reconcile_status == "conciliada"
    monkeypatch.setattr(TableStore, "update", lambda self, *a: 0)
    with pytest.raises(StepError, match="1 signals were reconciled but 0 were updated"):
        steps.run_reconcile(store, day, region="eu")


def test_clustered_tables_need_no_shuffle_by_key(spark, tmp_path):
    from tidemark.sources.clustered import read_clustered, write_clustered

    df = bars(spark, 25).unionByName(bars(spark, 25, "B")).unionByName(bars(spark, 3, "C").selectExpr("CAST(NULL AS string) AS ticker", *[c.split()[0] for c in BARS.split(", ")][1:]))
    name = write_clustered(df, buckets=3, root=f"file://{tmp_path}")
    stored = read_clustered(spark, name)
    out = stored.select("ticker", "mic", "date", indicators.sma("close", 20).alias("sma_20"))
    assert out.where("sma_20 IS NOT NULL").count() == 12 and stored.count() == 53
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    joined = stored.join(read_clustered(spark, write_clustered(df.select("ticker", "mic", "date").distinct(), buckets=3, root=f"file://{tmp_path}")).groupBy("ticker", "mic").count(), ["ticker", "mic"])
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert joined.count() == 50 and "Exchange hashpartitioning" not in plan


PAGE = """<table><tr><th>Ticker</th><th>Company</th></tr><tr><td>ONE</td><td>only</td></tr></table>
<table><tr><th>Ticker</th><th>Company</th><th>ICB Sector</th><th>Country</th></tr>
<tr class="mw-empty-elt">
</tr><tr><td>aa-b</td><td>A &amp; B<sup>[1]</sup></td><td>Tech</td><td> Norway </td></tr><tr><td>aa-b</td><td>A in Bergen</td><td>Tech</td><td>Norway</td></tr>
<tr><td>cc</td><td>C</td><td></td><td>Atlantis</td></tr><tr><td></td><td>nothing</td><td>x</td><td>Norway</td></tr></table>"""


def test_pages_are_parsed_by_a_table_function(spark):
    from pyspark.sql import functions as F

    from tidemark.sources import lateral

    pages = spark.createDataFrame([(PAGE,), ("<p>no table</p>",), (None,), ("",)], "page string")
    markets = {"Norway": ("XOSL", "NOK")}
    got = lateral.listed(pages, "page", markets=markets, ticker=universe.canonical_ticker(F.col("ticker")))
    assert sorted(tuple(r) for r in got.collect()) == [("AA.B", "A & B", "Tech", "XOSL", "NOK"), ("CC", "C", None, None, None)]
    both = lateral.listed(pages, "page", headers={"ticker": ["Ticker"], "name": ["Company"]}, all_tables=True, mic="X", currency="EUR")
    assert sorted(r.ticker for r in both.collect()) == ["ONE", "aa-b", "cc"] and both.first().mic == "X"
    pages.createOrReplaceTempView("listing_pages")
    lateral.register(spark)
    found = spark.sql("SELECT t.ticker, t.market FROM listing_pages, LATERAL listed_constituents(page, map('ticker', array('Ticker'), 'market', array('Country')), false) t ORDER BY 1")
    assert [tuple(r) for r in found.collect()] == [("aa-b", "Norway"), ("aa-b", "Norway"), ("cc", "Atlantis")]


def test_feeds_are_parsed_by_a_table_function(spark):
    from tidemark.sources import lateral

    body = "<rss><channel><item><title>A &amp;amp; B rise</title><link>http://a</link><pubDate>Mon, 02 Mar 2026 10:00:00 +0200</pubDate><description>&lt;p&gt;Up  4%&lt;/p&gt;</description></item><item><title>old</title><link>http://b</link><pubDate>Mon, 02 Feb 2026 10:00:00 +0000</pubDate></item><item><title>no date</title><link>http://c</link></item></channel></rss>"
    spark.createDataFrame([("f", body), ("g", "not xml"), ("h", None)], "source string, body string").createOrReplaceTempView("feed_bodies")
    lateral.register(spark)
    got = spark.sql("SELECT source, t.* FROM feed_bodies, LATERAL feed_entries(body, TIMESTAMP '2026-03-01 00:00:00') t").selectExpr("source", "CAST(published_at AS string) AS at", "title", "summary", "url").collect()
    assert [tuple(r) for r in got] == [("f", "2026-03-02 08:00:00", "A & B rise", "Up 4%", "http://a")]
