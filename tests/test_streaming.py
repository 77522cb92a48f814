"""Streams over files that arrive one after the other, against the batch operators."""

import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest

from tidemark.operators.patterns import Params, Pivots, scan, scan_on, simple_atr
from tidemark.sources.tables import TableStore
from tidemark.streaming import events, figures


class Feed:
    """A folder that a stream reads; run() takes in what has been added and gives all rows so far."""

    def __init__(self, spark, path, schema):
        self.spark, self.path, self.schema, self.n = spark, str(path), schema, 0

    def add(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(f"{self.path}/in")

    def stream(self):
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(f"{self.path}/in")

    def run(self, df, mode="append"):
        self.n += 1
        q = df.writeStream.outputMode(mode).format("memory").queryName(f"q{abs(hash(self.path)) % 10**9}_{self.n}").option("checkpointLocation", f"{self.path}/check{self.n}").trigger(availableNow=True).start()
        q.awaitTermination(120)
        return self.spark.table(q.name).collect()


DAY = datetime(2024, 1, 1)
EVENTS = "event_id long, ts timestamp, event_type string, value double"


def test_candles_of_a_stream_leave_late_events_out(spark, tmp_path):
    feed = Feed(spark, tmp_path, EVENTS)
    feed.add([(1, DAY, "a", 1.0), (2, DAY + timedelta(minutes=5), "a", 3.0)])
    feed.add([(3, DAY + timedelta(minutes=2), "a", 2.0)])  # out of order, but within the watermark
    feed.add([(4, DAY + timedelta(days=5), "a", 9.0)])
    feed.add([(5, DAY + timedelta(days=5, minutes=1), "a", 9.0)])
    feed.add([(6, DAY + timedelta(minutes=6), "a", 99.0)])  # too late: its window has closed
    feed.add([(7, DAY + timedelta(days=10), "a", 5.0)])
    got = {r.start: (r.open, r.high, r.low, r.close, r.volume) for r in feed.run(events.event_bars(feed.stream()))}
    assert got[DAY] == (1.0, 3.0, 1.0, 3.0, 3) and got[DAY + timedelta(days=5)] == (9.0, 9.0, 9.0, 9.0, 2)


def test_first_deliveries_of_a_stream(spark, tmp_path):
    feed = Feed(spark, tmp_path, "id string, published_at timestamp")
    feed.add([("a", DAY), ("b", DAY)])
    feed.add([("a", DAY), ("c", DAY + timedelta(hours=1))])
    assert sorted(r.id for r in feed.run(events.first_deliveries(feed.stream()))) == ["a", "b", "c"]


def test_sessions_of_a_stream(spark, tmp_path):
    feed = Feed(spark, tmp_path, "ticker string, digest string, published_at timestamp")
    feed.add([("A", "x", DAY), ("A", "x", DAY + timedelta(hours=30))])
    feed.add([("A", "x", DAY + timedelta(hours=60))])
    feed.add([("A", "x", DAY + timedelta(days=30))])
    feed.add([("A", "x", DAY + timedelta(days=60))])
    got = sorted((r["first"], r["last"], r.copies) for r in feed.run(events.story_sessions(feed.stream())))
    assert got[0] == (DAY, DAY + timedelta(hours=60), 3) and got[1] == (DAY + timedelta(days=30),) * 2 + (1,)


def test_upserts_of_a_stream_are_idempotent(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "store"))
    feed = Feed(spark, tmp_path, "provider string, day date, calls int")
    feed.add([("p", DAY.date(), 1)])
    feed.add([("p", DAY.date(), 4), ("q", DAY.date(), 2)])
    for check in ("one", "two"):  # the second reads everything again
        events.upsert_stream(feed.stream(), store, "api_calls", str(tmp_path / check)).awaitTermination(120)
        assert {(r.provider, r.calls) for r in store.read("api_calls").collect()} == {("p", 4), ("q", 2)}


@pytest.mark.parametrize("seed", [1, 2])
def test_pivots_of_a_stream_are_those_of_the_series(spark, tmp_path, seed):
    r = random.Random(seed)
    close = np.cumsum([r.gauss(0, 1) for _ in range(400)]) + 200
    high, low = close + [abs(r.gauss(0, 0.5)) for _ in close], close - [abs(r.gauss(0, 0.5)) for _ in close]
    p = Params()
    z = Pivots(high, low, simple_atr(high, low, close, p.atr_length), p.reversal)
    for t in range(len(close)):
        z.step(t)
    feed = Feed(spark, tmp_path, "ticker string, mic string, bar long, high double, low double, close double")
    for a in range(0, 400, 57):
        feed.add([("A", "X", t, float(high[t]), float(low[t]), float(close[t])) for t in range(a, min(400, a + 57))])
    got = feed.run(events.streaming_pivots(feed.stream()))
    assert len(z.turns) > 5 and sorted((x.bar, x.kind, x.price, x.confirmed_at) for x in got) == sorted((t.bar, "L" if t.low else "H", t.price, t.seen_at) for t in z.turns)


def regime(r, n):
    price, out = 100.0, []
    while len(out) < n:
        drift, spread = r.choice([-0.9, -0.4, 0.0, 0.4, 0.9]), r.uniform(0.2, 1.1)
        for _ in range(r.randrange(8, 40)):
            price *= 1 + (drift + r.uniform(-spread, spread)) / 100
            out.append((price * (1 + r.uniform(0.001, 0.006)), price * (1 - r.uniform(0.001, 0.006)), price))
    return out[:n]


def test_a_scan_goes_on_where_it_stood():
    seen = 0
    for seed in range(6):
        bars = np.array(regime(random.Random(f"on {seed}"), 700))
        whole = scan(*bars.T)
        held, search, found, base = bars[:0], None, [], 0
        for a in range(0, 700, 31):
            old = len(held)
            held = np.vstack([held, bars[a : a + 31]])
            matches, search = scan_on(*held.T, search=search, start=old)
            found += [(m.name, m.bar + base, m.entry, m.stop, m.target) for m in matches]
            cut = search.cut_at(len(held), Params())
            held, search, base = held[cut:], search.moved(cut), base + cut
        assert found == [(m.name, m.bar, pytest.approx(m.entry), pytest.approx(m.stop), pytest.approx(m.target)) for m in whole]
        seen += len(whole)
    assert seen >= 20


def figures_of(rows):
    return sorted((r.ticker, r.bar, r.pattern, round(r.entry, 6), round(r.stop, 6), round(r.target, 6)) for r in rows)


def scanned(series, start=0):
    return sorted((t, m.bar + start, m.name, round(m.entry, 6), round(m.stop, 6), round(m.target, 6)) for t, own in series.items() for m in scan(*np.array(own[start:]).T))


def restarted(feed):
    """Takes in what is there, from where the query stood before."""
    out = figures.streaming_figures(feed.stream()).writeStream.format("parquet").option("path", f"{feed.path}/out").option("checkpointLocation", f"{feed.path}/check")
    assert out.trigger(availableNow=True).start().awaitTermination(120)
    return feed.spark.read.parquet(f"{feed.path}/out").collect()


BAR = "ticker string, mic string, bar long, high double, low double, close double"


def test_figures_of_a_stream_are_those_of_the_series(spark, tmp_path):
    series = {t: regime(random.Random(f"stream {t}"), 600) for t in ("A", "B", "C")}
    feed = Feed(spark, tmp_path, BAR)
    for a, b in ((0, 150), (150, 390), (390, 600)):  # each run goes on from the checkpoint of the one before; late bars are left out
        feed.add([(t, "X", i, *own[i]) for t, own in series.items() for i in range(a, b)] + ([("A", "X", 3, 1e6, 1.0, 5e5)] if a else []))
        got = restarted(feed)
    assert len(scanned(series)) > 5 and figures_of(got) == scanned(series)


class Held:
    """A state of one key, and the handle that gives it, in memory."""

    def __init__(self):
        self.states, self.timers, self.value = {}, [], None

    def getListState(self, name, kind):
        return self.states.setdefault(name, Held())

    getValueState = getListState
    exists = lambda self: self.value is not None
    get = lambda self: self.value or ()
    listTimers = lambda self: iter(self.timers)

    def put(self, value):
        self.value = value

    update = put

    def clear(self):
        self.value = None

    def registerTimer(self, at):
        self.timers.append(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


class Now:
    def getCurrentProcessingTimeInMs(self):
        return 1000


def test_idle_keys_start_anew():
    """One timer a key, set again with every batch; when it ends, the next bar is the first of a new series."""
    own = regime(random.Random("stream A"), 600)
    handle, work = Held(), figures.Figures(idle_ms=50)
    work.init(handle)
    rows = lambda a, b: iter([pd.DataFrame([(i, *own[i]) for i in range(a, b)], columns=["bar", "high", "low", "close"])])
    matches = lambda a, b: [tuple(r) for x in work.handleInputRows(("A", "X"), rows(a, b), Now()) for r in x[["bar", "pattern"]].itertuples(index=False)]
    whole = lambda start, end: [(m.bar + start, m.name) for m in scan(*np.array(own[start:end]).T)]
    assert matches(0, 100) + matches(100, 300) == whole(0, 300) and handle.timers == [1050]
    assert list(work.handleExpiredTimer(("A", "X"), Now(), None)) == [] and not any(x.exists() for x in handle.states.values())
    assert matches(300, 450) + matches(440, 600) == whole(300, 600)
