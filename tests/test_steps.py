"""Steps over stored tables: what they write, that repeating them changes nothing, and when they fail."""

import json
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators.news import cluster_articles, merges_per_level
from tidemark.operators.payload import build_payload, without_bounds
from tidemark.operators.screener import Condition, Rule
from tidemark.plans import steps
from tidemark.plans.runner import StepError
from tidemark.sources import feeds
from tidemark.sources.tables import TableStore

DAY = date(2026, 8, 28)
PRICES = "ticker string, mic string, date date, open double, high double, low double, close double, adj_close double, volume long, source string, ingested_at timestamp, dividend double, split double"
MEMBERS = "ticker string, mic string, name string, sector string, start date, end date"


def candles(spark, tickers, n=260, end=DAY, at=datetime(2026, 8, 28, 12), close=None, **last):
    rows = []
    for k, t in enumerate(tickers):
        for i in range(n):
            c = 100.0 + k + (i % 17) * 0.5 if close is None else close(i)
            rows.append([t, "XNYS", end - timedelta(days=n - 1 - i), c, c + 1, c - 1, c, c, 2_000_000 + i, "p", at, None, None])
        for name, v in last.items():
            rows[-1][[x.split()[0] for x in PRICES.split(", ")].index(name)] = v
    return spark.createDataFrame([tuple(r) for r in rows], PRICES)


def members(spark, *tickers):
    return spark.createDataFrame([(t, "XNYS", f"Name {t}", "Tech", date(2020, 1, 1), None) for t in tickers], MEMBERS)


@pytest.fixture
def store(spark, tmp_path):
    return TableStore(spark, str(tmp_path / "t"))


def test_states_stay_readable_and_only_touched_months_are_rewritten(spark, store):
    store.upsert("prices", candles(spark, ["A"], 60))
    before, parts = store.read("prices"), store._parts("prices")
    store.upsert("prices", candles(spark, ["A"], 2, close=lambda i: 7.0))
    after = store._parts("prices")
    assert [k for k in parts if parts[k] != after[k]] == ["2026-08"] and len(after) == len(parts) >= 2
    assert before.where("close = 7").count() == 0 and store.read("prices").where("close = 7").count() == 2
    assert store.scan("prices", ["close"], start=DAY).count() == 1


def test_the_later_row_of_a_key_stays_whatever_the_partitions(spark, store):
    rows = [("A", "XNYS", DAY, float(i), datetime(2026, 8, 28, i % 24, i % 60)) for i in range(200)]
    for n in (1, 7):
        store.upsert("prices", spark.createDataFrame(rows, "ticker string, mic string, date date, close double, ingested_at timestamp").repartition(n))
        assert store.read("prices").first().close == max(rows, key=lambda r: r[4])[3]


def test_call_budgets_are_stored(store):
    assert store.reserve_calls("p", DAY, 15, 20) and not store.reserve_calls("p", DAY, 6, 20) and store.reserve_calls("p", DAY, 5, 20)
    assert store.calls("p", DAY) == 20 and store.calls("p", DAY + timedelta(days=1)) == 0


def test_indicators_are_incremental(spark, store):
    store.upsert("prices", candles(spark, ["A", "B"], 259, end=DAY - timedelta(days=1)))
    own = members(spark, "A", "B")
    first = steps.run_indicators(store, own, DAY - timedelta(days=1))
    assert first["expected"] == first["with_today"] == 2 and first["rows"] == 2 * (259 - 199)
    with pytest.raises(StepError):
        steps.run_indicators(store, own, DAY)
    store.upsert("prices", candles(spark, ["A", "B"], 260))
    assert steps.run_indicators(store, own, DAY)["rows"] == 2
    assert steps.run_indicators(store, own, DAY)["rows"] == 0
    assert steps.run_indicators(store, own, DAY, forced=own.where("ticker = 'A'").select("ticker", "mic"))["rows"] > 50


def test_corporate_actions_are_reconciled_once(spark, tmp_path):
    staging, prod = (TableStore(spark, str(tmp_path), x) for x in ("staging", "prod"))
    old = candles(spark, ["A", "B"], 30, end=DAY - timedelta(days=1), at=datetime(2026, 8, 20))
    staging.upsert("prices", old.unionByName(candles(spark, ["A"], 1, close=lambda i: 50.0, split=2.0)).unionByName(candles(spark, ["B"], 1, dividend=0.5)))
    quarantine = spark.createDataFrame([("A", "XNYS", "jump"), ("C", "XNYS", "jump")], "ticker string, mic string, reason string")
    asked = []

    def provider(planned, as_of):
        asked.append(sorted(r.ticker for r in planned.collect()))
        return candles(spark, ["A"], 31, close=lambda i: 50.0).drop("ingested_at", "source", "dividend", "split")

    out = steps.reconcile_corporate_actions(staging, prod, members(spark, "A", "B"), quarantine, DAY, provider=provider)
    assert sorted((r.ticker, r.kind) for r in prod.read("corporate_actions").collect()) == [("A", "split"), ("B", "dividend")]
    assert asked and "A" in asked[0] and [r.ticker for r in out["released"].collect()] == ["A"]
    assert prod.read("prices").where("ticker = 'A' AND close = 50").count() >= 31
    before = prod.read("corporate_actions").count()
    steps.reconcile_corporate_actions(staging, prod, members(spark, "A", "B"), quarantine, DAY, provider=provider)
    assert prod.read("corporate_actions").count() == before


def test_snapshots_tell_changes(spark, store):
    own = members(spark, "A", "B")
    store.upsert("prices", candles(spark, ["A", "B"], 260))
    steps.run_indicators(store, own, DAY)
    digest, changed = steps.store_snapshot(store, own, DAY, region="eu")
    assert changed and steps.store_snapshot(store, own, DAY, region="eu") == (digest, False)
    assert store.snapshot_header("eu", DAY).snapshot_hash == digest and store.snapshot_header("us", DAY) is None
    assert store.day("snapshots", region="eu", date=DAY).count() == 2
    with pytest.raises(StepError):
        steps.store_snapshot(store, members(spark, "A", "B", "C"), DAY, region="eu")


ARTICLES = "ticker string, published_at timestamp, title string, summary string, url string"
NOW = datetime(2026, 8, 28, 12)


def test_news_sources_may_fail_but_not_all(spark, store):
    def good(tickers, since):
        return spark.createDataFrame([("A", NOW - timedelta(hours=1), "One", "text", "u1"), ("A", NOW - timedelta(days=9), "Old", "text", "u2")], ARTICLES)

    def bad(tickers, since):
        raise OSError("down")

    attributes = spark.createDataFrame([("good", 0.8, "en")], "source string, reliability double, language string")
    targets = steps.news_targets(members(spark, "A"), members(spark, "A", "B"))
    args = {"since": NOW - timedelta(days=2), "until": NOW}
    assert targets.count() == 2
    report = steps.collect_news(store, targets, {"good": good, "bad": bad}, attributes, DAY, **args)
    assert (report.fetched, report.new, report.failed) == (1, 1, {"bad": "down"})
    assert steps.collect_news(store, targets, {"good": good}, attributes, DAY, **args).new == 0
    with pytest.raises(StepError):
        steps.collect_news(store, targets, {"bad": bad}, attributes, DAY, **args)


def articles(spark):
    long = " ".join(f"word{i}" for i in range(40))
    rows = [(str(i), "A", "XNYS", "s", 0.5, "en", NOW + timedelta(minutes=i), "Same title", t, f"u{i}") for i, t in enumerate([long, long, long + " end", "something else entirely", "a third story"])]
    return spark.createDataFrame(rows, "id string, ticker string, mic string, source string, reliability double, language string, published_at timestamp, title string, summary string, url string")


def test_methods_are_those_of_each_article(spark):
    got = {r.id: (r.component, r.method) for r in cluster_articles(articles(spark)).collect()}
    assert got["0"][0] == got["1"][0] == got["2"][0] and got["2"][1] == "minhash" and got["3"][1] == got["4"][1] == "single"
    assert {got["0"][1], got["1"][1]} <= {"exact", "minhash"}
    assert {r.level: r.merges for r in merges_per_level(articles(spark)).collect()} == {"exact": 1, "minhash": 1}


def test_topics_and_members_replace_the_day(spark, store):
    for _ in range(2):
        found = steps.store_topics(store, articles(spark), DAY, region="eu")
        assert sorted(r["size"] for r in found.collect()) == [1, 1, 3]
        own = store.day("news_cluster_members", region="eu", as_of=DAY)
        assert own.count() == 5 and own.where("is_representative").count() == 3
    assert steps.store_topics(store, articles(spark).limit(0), DAY, region="eu").count() == 0


def signal_parts(spark):
    candidates = spark.createDataFrame([("A", "XNYS", "r1", "long", 0.9, "x", 100.0, "h", None, None, None), ("B", "XNYS", "r1", "long", 0.8, "x", 100.0, "h", None, None, None)], "ticker string, mic string, rule_id string, direction string, score double, conditions_met string, close double, rule_hash string, pattern string, stop_price double, target_price double")
    panel = spark.createDataFrame([("A", "XNYS", "EUR"), ("B", "XNYS", "EUR")], "ticker string, mic string, currency string")
    return candidates, panel, spark.createDataFrame([("XNYS", DAY)], "mic string, session date")


def test_signals_are_persisted_and_reconciled(spark, store):
    candidates, panel, sessions = signal_parts(spark)
    eve = DAY - timedelta(days=1)
    for replaced in (0, 2):
        assert steps.persist_signals(store, candidates, panel, sessions, eve, region="eu", snapshot_hash="h") == (2, replaced)
    assert [r.ticker for r in store.signals(eve, "eu").collect()] == ["A", "B"]
    with pytest.raises(StepError):
        steps.persist_signals(store, candidates, panel, sessions.limit(0), eve, region="eu", snapshot_hash="h")
    with pytest.raises(StepError):
        steps.run_reconcile(store, DAY, region="eu")
    store.upsert("prices", candles(spark, ["A"], 1, open=101.0).unionByName(candles(spark, ["B"], 1, open=110.0)))
    for _ in range(2):
        done = steps.run_reconcile(store, DAY, region="eu")
        assert {r.ticker: r.reconcile_status for r in done.collect()} == {"A": "conciliada", "B": "desviada"}
        assert [(r.ticker, round(r.open_gap, 6)) for r in steps.named_gaps(done).collect()] == [("B", 0.1)]
    assert steps.run_reconcile(store, DAY, region="us") is None
    assert {r.reconcile_status for r in store.signals(eve).collect()} == {"conciliada", "desviada"}


def test_rules_are_counted(spark):
    rows = candles(spark, ["A", "B", "C"], 5).withColumn("avg_volume_20", F.when(F.col("ticker") != "C", 10.0))
    panel = rows.where(F.col("date") == F.lit(DAY)).select("ticker", "mic", "avg_volume_20")
    rules = [Rule("r", "long", (Condition("close > 102.5", 1.0),), filters=("volume > 1",))]
    got = steps.rule_counts(panel, DAY, rules=rules, indicators=rows, min_avg_volume=1.0).collect()
    assert [(r.rule_id, r.eligible, r.candidates, r.illiquid) for r in got] == [("r", 2, 1, 1)]


def test_universes_roll_and_are_written_with_their_meta(spark, tmp_path):
    pages = {"wiki:a": spark.createDataFrame([("A", "XNYS"), ("B", "XNYS")], "ticker string, mic string"), "wiki:b": spark.createDataFrame([("B", "XNYS"), ("C", None)], "ticker string, mic string")}
    union = steps.union_of_snapshots(pages)
    assert sorted((r.ticker, r.source) for r in union.collect()) == [("A", "wiki:a"), ("B", "wiki:a"), ("C", "wiki:b")]
    spec = steps.UniverseSpec("u", lambda: union, mic="XLON")
    first = steps.build_universe(spec, None, DAY - timedelta(days=5)).persist()
    assert {(r.ticker, r.mic, r.end) for r in first.collect()} == {("A", "XNYS", None), ("B", "XNYS", None), ("C", "XLON", None)}
    later = steps.build_universe(steps.UniverseSpec("u", lambda: union.where("ticker != 'A'").withColumn("mic", F.coalesce("mic", F.lit("XLON")))), first, DAY)
    assert {(r.ticker, r.end) for r in later.collect()} == {("A", DAY), ("B", None), ("C", None)}
    steps.write_constituents(later, str(tmp_path / "c"), {"universe": "u"})
    meta = json.loads(spark.read.text(str(tmp_path / "c.meta")).first().value)
    assert meta == {"universe": "u", "rows": 3, "current_members": 2} and spark.read.parquet(str(tmp_path / "c")).count() == 3


def test_backfill_includes_those_that_left(spark, store):
    table = members(spark, "A").unionByName(members(spark, "B").withColumn("end", F.lit(DAY - timedelta(days=100)).cast("date")))
    seen = []

    def provider(planned, as_of):
        seen.extend((r.ticker, r.start) for r in planned.collect())
        return candles(spark, ["A", "B"], 3)

    report = steps.backfill(store, table, DAY, 1, provider=provider)
    assert sorted(seen) == [("A", DAY - timedelta(days=365)), ("B", DAY - timedelta(days=365))] and report.received == 2
    assert store.read("prices").count() == 6


def test_pattern_statistics_of_members(spark, tmp_path):
    staging, prod = (TableStore(spark, str(tmp_path), x) for x in ("staging", "prod"))
    with pytest.raises(StepError):
        steps.member_pattern_stats(prod, staging, members(spark, "A"), DAY)
    prod.upsert("prices", candles(spark, ["A"], 120))
    by_pattern, yearly = steps.member_pattern_stats(prod, staging, members(spark, "A"), DAY)
    assert by_pattern.count() == 8 and yearly.count() >= 0


def test_digests_name_a_key_once(spark):
    rows = spark.createDataFrame([("A", "X", "r1", "long", "confirmar", 0.5, 0.9), ("A", "X", "r2", "long", "descartar", 0.9, 0.1), ("B", "X", "r1", "short", "confirmar", 0.7, 0.2)], "ticker string, mic string, rule_id string, direction string, verdict string, confidence double, score double")
    assert [(r.ticker, r.rule_id) for r in steps.digest_rows(rows, True).collect()] == [("A", "r2"), ("B", "r1")]
    assert [r.rule_id for r in steps.digest_rows(rows, False).collect()] == ["r1", "r1"]
    assert {r.label: r.n for r in steps.digest_counts(rows).collect()} == {"descartar": 1, "short": 1}


def test_answers_are_recorded_by_payload_and_model(spark, store):
    asked = []

    def ask(payload):
        asked.append(payload)
        return steps.Reply(json.dumps({"summary": "s", "verdicts": [{"ticker": "A", "verdict": "confirmar", "confidence": 0.5}]}), 1_000_000, 100_000)

    args = {"region": "eu", "ask": ask, "monthly_budget": 4.0}
    first = steps.ask_model(store, "p", {"A"}, DAY, model="m", **args)
    assert (first.cost_eur, first.month_eur, first.reused, first.over_budget) == (3.0, 3.0, False, False)
    again = steps.ask_model(store, "p", {"A"}, DAY, model="m", **args)
    assert (again.cost_eur, again.month_eur, again.reused) == (0.0, 3.0, True) and len(asked) == 1
    other = steps.ask_model(store, "p", {"A"}, DAY + timedelta(days=1), model="n", **args)
    assert other.over_budget and other.month_eur == 6.0 and len(asked) == 2
    with pytest.raises(StepError):
        steps.ask_model(store, "q", {"A", "B"}, DAY, model="m", **args)


def test_payloads_carry_names_levels_and_general_topics(spark):
    candidates = spark.createDataFrame([("A", "XNYS", "r", "long", 0.9123, "x; y", 100.0, "bull_flag", 95.0, 120.0), ("B", "XNYS", "r", "short", 0.5, "", 10.0, None, None, None)], "ticker string, mic string, rule_id string, direction string, score double, conditions_met string, close double, pattern string, stop_price double, target_price double")
    topics = spark.createDataFrame([("c1", "A", NOW, 2, "s", "Title"), ("c2", None, NOW, 1, "s", "General")], "cluster_id string, ticker string, last_published_at timestamp, size int, sources string, title string")
    panel = spark.createDataFrame([("A", "XNYS", "Name A", "EUR")], "ticker string, mic string, name string, currency string")
    row = build_payload(candidates, topics, panel=panel, region="eu", day="2026-08-28", currency="EUR").first()
    body = json.loads(row.payload)
    a, b = sorted(body["candidates"], key=lambda x: x["ticker"])
    assert (a["name"], a["currency"], a["levels"], b["name"], "levels" in b) == ("Name A", "EUR", {"pattern": "bull_flag", "stop": 95.0, "target": 120.0}, "B", False)
    assert a["conditions"] == ["x", "y"] and [t["title"] for t in a["topics"]] == ["Title"] and [t["title"] for t in body["general_topics"]] == ["General"]
    assert body["region"] == "eu" and list(body) == sorted(body)
    assert build_payload(candidates.repartition(3), topics, panel=panel, region="eu", day="2026-08-28", currency="EUR").first().payload_hash == row.payload_hash


def test_schemas_lose_bounds_only():
    assert without_bounds({"a": {"minimum": 0, "type": "number", "anyOf": [{"maximum": 1, "x": [1]}]}}) == {"a": {"type": "number", "anyOf": [{"x": [1]}]}}


# --- sources ----------------------------------------------------------------------------------------------------------

def planned(spark, *keys):
    return spark.createDataFrame([(t, m, DAY) for t, m in keys], "ticker string, mic string, start date")


def test_downloads_go_in_batches(spark):
    asked = []

    def download(symbols, start, end):
        asked.append(symbols)
        return spark.createDataFrame([(DAY, 5.0, 6.0)], "date date, `A|Close` double, `B-X.ST|Close` double") if "A" in symbols else None

    got = feeds.download_provider(download, size=2)(planned(spark, ("A", "XNYS"), ("B X", "XSTO"), ("C", "XLON"), ("D", "NOWHERE")), DAY).collect()
    assert asked == [["A", "B-X.ST"], ["C.L"]] and sorted((r.ticker, r.mic, r.close) for r in got) == [("A", "XNYS", 5.0), ("B X", "XSTO", 6.0)]


@pytest.mark.parametrize(("statuses", "limit", "tickers"), [((200, 404, 200, 200), 9, "ACD"), ((200, 429, 200, 200), 9, "A"), ((200, 500, 200, 200), 9, "ACD"), ((200, 200, 200, 200), 2, "AB"), ((200, "down", 200, 200), 9, "A")])
def test_quotas_and_refusals(spark, statuses, limit, tickers):
    calls, used = [], []

    def transport(url, parameters):
        status = statuses[len(calls)]
        calls.append(url)
        if status == "down":
            raise OSError("down")
        return feeds.Response(status, '[{"date": "2026-08-28", "close": 5.0}]')

    def reserve(n):
        used.append(n)
        return len(used) <= limit

    fetch = feeds.quota_provider(transport, "http://x", "k", reserve, {"XNYS": ".US"})
    got = fetch(planned(spark, *((t, "XNYS") for t in "ABCD"), ("E", "XLON")), DAY).collect()
    assert "".join(sorted(r.ticker for r in got)) == tickers


FEED = "<rss><channel><item><title>&lt;b&gt;x &amp;amp; y&lt;/b&gt;</title><link>http://l</link><pubDate>Fri, 28 Aug 2026 10:00:00 GMT</pubDate><description>&lt;p&gt;p &amp;amp; q&lt;/p&gt;</description></item></channel></rss>"


def test_feeds_are_cleaned_and_one_may_fail(spark):
    def transport(url, parameters):
        return feeds.Response(200 if url.endswith("A-B") else 500, FEED)

    fetch = feeds.rss_source(spark, transport, "http://f/{ticker}")
    tickers = spark.createDataFrame([("A.B",), ("C",)], "ticker string")
    got = fetch(tickers, datetime(2026, 8, 1).astimezone()).collect()
    assert [(r.ticker, r.title, r.summary) for r in got] == [("A.B", "x & y", "p & q")]
    with pytest.raises(OSError):
        fetch(tickers.where("ticker = 'C'"), datetime(2026, 8, 1).astimezone())


def test_requests_are_paced(spark):
    clock, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        clock[0] += s

    def transport(url, parameters):
        return feeds.Response(200, json.dumps([{"datetime": 1787911200, "headline": parameters["symbol"], "summary": "", "url": "u"}]))

    fetch = feeds.paced_source(spark, transport, "http://a", "k", per_minute=60, now=lambda: clock[0], sleep=sleep)
    got = fetch(spark.createDataFrame([("A",), ("B",), ("C",)], "ticker string"), datetime(2026, 8, 1)).collect()
    assert sorted(r.title for r in got) == ["A", "B", "C"] and slept == [1.0, 1.0]


def test_symbols_are_repaired_once(spark):
    searched = []

    def search(ticker, mic):
        searched.append(ticker)
        if ticker == "FAIL":
            raise OSError("down")
        return ("NEW", "XNAS") if ticker == "OLD" else None

    table = spark.createDataFrame([("KNOWN", "XNYS"), ("OLD", "XNYS"), ("GONE", "XNYS"), ("FAIL", "XNYS")], "ticker string, mic string")
    enrich = feeds.symbol_repair(table.where("ticker = 'KNOWN'"), search)
    for _ in range(2):
        assert sorted((r.ticker, r.mic) for r in enrich(table).collect()) == [("FAIL", "XNYS"), ("KNOWN", "XNYS"), ("NEW", "XNAS")]
    assert sorted(searched) == ["FAIL", "FAIL", "GONE", "OLD"]
