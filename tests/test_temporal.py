"""Joins in time and recursive means against plain programs."""

import random
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators.indicators import indicators, with_means
from tidemark.operators.temporal import asof_join, days_within, members_per_day, next_sessions

DAY = date(2024, 1, 1)


@pytest.mark.parametrize("after", [False, True])
@pytest.mark.parametrize("strict", [False, True])
def test_each_row_meets_the_nearest_one(spark, after, strict):
    r = random.Random(4)
    at = lambda: DAY + timedelta(days=r.randrange(400))
    left = [(i, r.choice(["x", "y", None, "lone"]), r.choice([at(), at(), at(), None])) for i in range(300)]
    right = [(r.choice(["x", "y", None, "other"]), r.choice([at(), at(), at(), None]), i % 50) for i in range(120)]
    got = asof_join(spark.createDataFrame(left, "id int, k string, d date"), spark.createDataFrame(right, "k string, e date, v int").withColumn("found", F.col("e")), ["k"], "d", "e", ["v", "found"], after=after, strict=strict, cell_days=30)
    assert got.columns == ["id", "k", "d", "v", "found"]

    def nearest(k, d):
        ok = [(e, v) for q, e, v in right if q == k and e is not None and d is not None and ((e > d if strict else e >= d) if after else (e < d if strict else e <= d))]
        if not ok:
            return None, None
        e = min(ok)[0] if after else max(ok)[0]
        return min(v for x, v in ok if x == e), e

    assert {x.id: (x.v, x.found) for x in got.collect()} == {i: nearest(k, d) for i, k, d in left}


def test_times_and_numbers_work_alike(spark):
    t = datetime(2024, 1, 1, 12)
    left = spark.createDataFrame([(1, "a", t, 5), (2, "a", t + timedelta(hours=1), 50)], "id int, k string, t timestamp, n long")
    right = spark.createDataFrame([("a", t, 7, "p"), ("a", t + timedelta(minutes=59), 60, "q")], "k string, u timestamp, m long, v string")
    assert [r.v for r in asof_join(left, right, ["k"], "t", "u", ["v"]).orderBy("id").collect()] == ["p", "q"]
    assert [r.v for r in asof_join(left, right, ["k"], "n", "m", ["v"], after=True).orderBy("id").collect()] == ["p", "q"]


def test_next_sessions_of_markets(spark):
    sessions = spark.createDataFrame([("A", DAY + timedelta(days=i)) for i in (0, 3, 4)] + [("B", DAY)], "mic string, session date")
    rows = spark.createDataFrame([(1, "A", DAY), (2, "A", DAY + timedelta(days=3)), (3, "A", DAY + timedelta(days=4)), (4, "B", DAY - timedelta(days=90)), (5, "C", DAY)], "id int, mic string, day date")
    got = {r.id: r.execute_on for r in next_sessions(rows, sessions, "day", "execute_on").collect()}
    assert got == {1: DAY + timedelta(days=3), 2: DAY + timedelta(days=4), 3: None, 4: DAY, 5: None}


def test_days_meet_their_intervals_by_an_equal_join(spark):
    r = random.Random(2)
    bound = lambda: r.choice([None, DAY + timedelta(days=r.randrange(-200, 300))])
    rows = [(f"t{i % 20}", "M", bound(), bound()) for i in range(60)]
    days = [DAY + timedelta(days=i) for i in r.sample(range(250), 60)]
    table, of = spark.createDataFrame(rows, "ticker string, mic string, start date, end date"), spark.createDataFrame([(d,) for d in days], "day date")
    inside = lambda d, s, e: (s is None or s <= d) and (e is None or e > d)
    met = days_within(table, of)
    assert sorted(map(str, met.select("day", "ticker", "start", "end").collect())) == sorted(str(x) for x in spark.createDataFrame([(d, t, s, e) for d in days for t, _, s, e in rows if inside(d, s, e)], "day date, ticker string, start date, end date").collect())
    plan = met._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    first = lambda own: min(own, key=lambda x: (x[0] is None, x[0] or DAY, x[1] is None, x[1] or DAY))
    want = {}
    for d in days:
        for t in {t for t, *_ in rows}:
            own = [(s, e) for u, _, s, e in rows if u == t and inside(d, s, e)]
            if own:
                want[d, t] = first(own)
    assert {(x.day, x.ticker): (x.start, x.end) for x in members_per_day(table, of).collect()} == want


def recursive(values, alpha, length):
    out, have, y = [], [], None
    for v in values:
        if v is not None:
            have.append(v)
            y = y + alpha * (v - y) if y is not None else np.mean(have) if len(have) == length else None
        out.append(y if v is not None else None)
    return out


def test_means_compose_over_blocks(spark):
    r = random.Random(8)
    series = {k: [None if r.random() < 0.1 else 100 + r.gauss(0, 5) for _ in range(n)] for k, n in (("a", 700), ("b", 20), ("c", 5), ("d", 83))}
    rows = [(k, "M", DAY + timedelta(days=i), v, None if v is None else -v) for k, own in series.items() for i, v in enumerate(own)]
    df = spark.createDataFrame(rows, "ticker string, mic string, date date, x double, z double").repartition(5)
    for block in (4, 512):
        got = {(g.ticker, g.date): (g.y, g.w) for g in with_means(df, {"y": "x", "w": "z"}, 0.2, 9, block).collect()}
        for k, own in series.items():
            for i, want in enumerate(recursive(own, 0.2, 9)):
                y, w = got[k, DAY + timedelta(days=i)]
                assert (y is None) == (want is None) and (want is None or (y == pytest.approx(want, rel=1e-11) and w == pytest.approx(-want, rel=1e-11)))


def test_the_catalog_needs_no_python_worker(spark):
    df = spark.createDataFrame([("a", "M", DAY + timedelta(days=i), 2.0 + i % 7, 1.0, 1.5 + i % 5, 1.5 + i % 5, 10) for i in range(60)], "ticker string, mic string, date date, high double, low double, close double, adj_close double, volume long")
    out = indicators(df)
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "InPandas" not in plan
    last = out.orderBy("date").collect()[-1]
    assert 0 < last.rsi_14 < 100 and last.macd_hist == pytest.approx(last.macd - last.macd_signal) and last.atr_14 > 0 and last.sma_200 is None


def test_a_day_is_of_the_earliest_interval_whatever_their_number(spark):
    """Overlapping intervals, open ones among them, against a walk over all days; nothing is grouped by day and key."""
    import random
    from datetime import date, timedelta

    from tidemark.operators.temporal import members_per_day

    r, first = random.Random(11), date(2020, 1, 1)
    at = lambda n: first + timedelta(days=n)
    rows = [(r.choice(["A", "B", "C", "D", None]), r.choice(["X", None]), f"n{i}", r.choice([None, *[at(r.randrange(-40, 160))] * 4]), r.choice([None, *[at(r.randrange(-20, 190))] * 5])) for i in range(45)]
    rows += [("E", "X", "late", None, at(30)), ("E", "X", "later", None, None), ("F", "X", "own", at(3), at(9)), ("F", "X", "rest", None, None)]
    days = [at(n) for n in range(0, 170, 3)]
    want = set()
    for day in days:
        held = {}
        for t, m, name, start, end in rows:
            if (start is None or start <= day) and (end is None or end > day):
                held.setdefault((t, m), []).append((start is None, start or first, end is None, end or first, name))
        want |= {(day, *k, min(v)[-1]) for k, v in held.items()}
    table = spark.createDataFrame(rows, "ticker string, mic string, name string, start date, end date")
    got = members_per_day(table, spark.createDataFrame([(d,) for d in days * 2], "day date"))
    assert sorted(map(repr, got.select("day", "ticker", "mic", "name").collect())) == sorted(map(repr, spark.createDataFrame(list(want), "day date, ticker string, mic string, name string").collect()))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Aggregate" in x and "ticker" in x and "day" in x for x in plan.splitlines())
