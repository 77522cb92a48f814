"""Chart patterns: causal pivots, armed figures, breakouts, flags, and what came of them.

A series is worked through bar by bar with data up to that bar only, so a value never changes when later bars come.
Series are independent of each other and bounded by their history; they run as one Arrow group per key.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.indicators import by_key, true_range
from tidemark.schemas import KEY, PATTERN_COLUMNS, PATTERN_NAMES

HORIZON = 40


@dataclass(frozen=True)
class Params:
    """Distances in ATR, lengths in bars (fixed values)."""

    atr_length: int = 14
    reversal: float = 3.0
    equal: float = 1.0
    head_margin: float = 1.0
    shoulder_tolerance: float = 2.0
    min_height: float = 3.0
    min_separation: int = 8
    max_span: int = 120
    prior_move: float = 0.5
    max_tilt: float = 0.5
    max_time_ratio: float = 3.0
    stop_buffer: float = 0.25
    pole_min: float = 6.0
    pole_bars: int = 15
    flag_min: int = 4
    flag_max: int = 20
    max_retrace: float = 0.5


class Turn(NamedTuple):
    bar: int
    price: float
    low: bool
    seen_at: int


class Figure(NamedTuple):
    """A figure seen the bullish way up: the line through (bar, price) with a slope, its height, its stop."""

    size: int
    bar: int
    price: float
    slope: float
    height: float
    stop: float

    def line(self, t):
        return self.price + self.slope * (t - self.bar)


def simple_atr(high: np.ndarray, low: np.ndarray, close: np.ndarray, length: int) -> np.ndarray:
    """Mean over full windows of how far a bar reaches together with the close before it, where there is one.

    The span of high, low and that close is the greatest of their three distances.
    """
    before = np.concatenate([[np.nan], close[:-1]])[: len(close)]
    span, out = np.fmax(high, before) - np.fmin(low, before), np.full(len(close), np.nan)
    if len(close) >= length:
        out[length - 1 :] = np.lib.stride_tricks.sliding_window_view(span, length).mean(1)
    return out


class Pivots:
    """Turning points, each known from the bar that has moved `reversal` ATR away from it."""

    def __init__(self, high: np.ndarray, low: np.ndarray, atr: np.ndarray, reversal: float):
        self.side = {True: low, False: high}  # by whether a low is looked for
        self.limit = reversal * atr
        self.falling: bool | None = None
        self.best: dict[bool, int] = {}
        self.turns: list[Turn] = []

    def _beyond(self, low: bool, t: int, bar: int) -> bool:
        s = self.side[low]
        return s[t] < s[bar] if low else s[t] > s[bar]

    def _away(self, low: bool, t: int) -> bool:
        """Whether bar t has moved far enough from the extreme of this side."""
        at = self.best[low]
        return at < t and abs(self.side[not low][t] - self.side[low][at]) >= self.limit[t] and (self.side[not low][t] > self.side[low][at]) == low

    def _turn(self, low: bool, t: int) -> Turn:
        at = self.best[low]
        self.turns.append(Turn(at, float(self.side[low][at]), low, t))
        self.falling = not low
        other = self.side[not low][at + 1 : t + 1]
        self.best = {not low: at + 1 + int(np.nanargmin(other) if not low else np.nanargmax(other))}
        return self.turns[-1]

    def step(self, t: int) -> Turn | None:
        """The pivot that bar t confirms, if any. Bars without prices or ATR change nothing."""
        if not (self.limit[t] > 0 and np.isfinite(self.side[True][t]) and np.isfinite(self.side[False][t])):
            return None
        if self.falling is not None:
            low = self.falling
            if self._beyond(low, t, self.best[low]):
                self.best[low] = t
                return None
            return self._turn(low, t) if self._away(low, t) else None
        if not self.best:
            self.best = {True: t, False: t}
            return None
        for low in (True, False):
            if self._beyond(low, t, self.best[low]):
                self.best[low] = t
        up, down = self._away(True, t), self._away(False, t)
        if up and (not down or self.best[True] < self.best[False]):
            return self._turn(True, t)
        return self._turn(False, t) if down else None


def _two_floors(x, v, atr: float, p: Params) -> Figure | None:
    """Fall, floor, bounce, floor at the same height."""
    top, a, bounce, b = v[-4:]
    height = bounce - min(a, b)
    ok = abs(a - b) <= p.equal * atr and height >= p.min_height * atr and x[-1] - x[-3] >= p.min_separation and top - bounce >= p.prior_move * height
    return Figure(4, x[-2], bounce, 0.0, height, min(a, b) - p.stop_buffer * atr) if ok else None


def _head_and_shoulders(x, v, atr: float, p: Params) -> Figure | None:
    """Fall, shoulder, bounce, lower head, bounce, shoulder; the line through both bounces."""
    top, left, b1, head, b2, right = v[-6:]
    slope = (b2 - b1) / (x[-2] - x[-4])
    height = b1 + slope * (x[-3] - x[-4]) - head
    before, after = x[-3] - x[-5], x[-1] - x[-3]
    ok = (
        head < min(left, right) - p.head_margin * atr and abs(left - right) <= p.shoulder_tolerance * atr
        and height >= p.min_height * atr and abs(b2 - b1) <= p.max_tilt * height
        and before + after >= 2 * p.min_separation and max(before, after) <= p.max_time_ratio * min(before, after)
        and top - max(b1, b2) >= p.prior_move * height
    )
    return Figure(6, x[-2], b2, slope, height, right - p.stop_buffer * atr) if ok else None


def _rising_lows(x, v, atr: float, p: Params) -> Figure | None:
    """Two tops at the same height over three rising lows."""
    low0, top1, low1, top2, low2 = v[-5:]
    near = p.equal * atr
    height = max(top1, top2) - low1
    ok = abs(top1 - top2) <= near and low1 - low0 > near and low2 - low1 > near and height >= p.min_height * atr and x[-1] - x[-4] >= p.min_separation
    return Figure(5, x[-2], max(top1, top2), 0.0, height, low2 - p.stop_buffer * atr) if ok else None


#: By name: the sign of the view (1 as it is, -1 upside down), the pivots it takes, and its test; in catalogue order.
FIGURES = {
    "double_bottom": (1, 4, _two_floors), "double_top": (-1, 4, _two_floors),
    "inv_head_shoulders": (1, 6, _head_and_shoulders), "head_shoulders": (-1, 6, _head_and_shoulders),
    "ascending_triangle": (1, 5, _rising_lows), "descending_triangle": (-1, 5, _rising_lows),
}
FLAGS = {"bull_flag": 1, "bear_flag": -1}


def direction(name: str) -> str:
    return "long" if {**{k: s for k, (s, _, _) in FIGURES.items()}, **FLAGS}[name] > 0 else "short"


def _flag(high, low, close, atr, t: int, p: Params):
    """The flag that bar t's close completes: pole, pause that gives back half at most, close above the pole."""
    from_ = t - p.flag_max
    if from_ < p.pole_bars or np.isnan(high[from_:t]).all():
        return None
    top = from_ + int(np.nanargmax(high[from_:t]))
    start = top - p.pole_bars
    if t - top < p.flag_min or not close[t] > high[top] or np.isnan(low[start:top]).all() or np.nanmax(high[start:top]) > high[top] or np.isnan(low[top + 1 : t]).all():
        return None
    base, dip = start + int(np.nanargmin(low[start:top])), top + 1 + int(np.nanargmin(low[top + 1 : t]))
    pole, back = high[top] - low[base], high[top] - low[dip]
    target = low[dip] + pole
    if not (pole >= p.pole_min * atr[top] and back <= p.max_retrace * pole and close[t] < target):
        return None
    return (base, top, dip), float(high[top]), float(low[dip] - p.stop_buffer * atr[top]), float(target)


class Match(NamedTuple):
    name: str
    bar: int
    entry: float
    stop: float
    target: float
    pivots: tuple[int, ...]
    prices: tuple[float, ...]


@dataclass
class Search:
    """Where a scan stands after its last bar: all that later bars can need besides the bars from cut_at() on."""

    falling: bool | None = None
    best: dict[bool, int] = field(default_factory=dict)
    turns: list[Turn] = field(default_factory=list)
    armed: list[tuple[str, Figure, list[Turn]]] = field(default_factory=list)

    def cut_at(self, bars: int, p: Params) -> int:
        """The first of so many bars that is needed again: by flags, and by the extremes that may turn, with their ATR."""
        margin = p.atr_length + 1
        return max(0, min([bars - p.flag_max - p.pole_bars, *self.best.values()]) - margin)

    def moved(self, by: int) -> Search:
        """The same with all bars numbered from `by` on."""
        turn = lambda t: t._replace(bar=t.bar - by, seen_at=t.seen_at - by)
        armed = [(name, f._replace(bar=f.bar - by), [turn(t) for t in own]) for name, f, own in self.armed]
        return Search(self.falling, {k: v - by for k, v in self.best.items()}, [turn(t) for t in self.turns], armed)


def scan(high: np.ndarray, low: np.ndarray, close: np.ndarray, p: Params = Params()) -> list[Match]:
    """All patterns in the order in which closes complete them."""
    return scan_on(high, low, close, p)[0]


def scan_on(high: np.ndarray, low: np.ndarray, close: np.ndarray, p: Params = Params(), search: Search | None = None, start: int = 0) -> tuple[list[Match], Search]:
    """What the bars from `start` on complete, given where the search stood before them, and where it stands then."""
    search = search or Search()
    atr = simple_atr(high, low, close, p.atr_length)
    pivots, armed, out = Pivots(high, low, atr, p.reversal), list(search.armed), []
    pivots.falling, pivots.best, pivots.turns = search.falling, dict(search.best), list(search.turns)
    views = {1: (high, low, close), -1: (-low, -high, -close)}
    ceiling = {s: pd.Series(v[0]).rolling(p.flag_max, min_periods=1).max().shift(1).to_numpy() for s, v in views.items()}
    for t in range(start, len(close)):
        if pivots.step(t) is not None:
            armed = []
            recent = pivots.turns[-6:]
            last = recent[-1]
            unit = float(atr[last.bar])
            for name, (sign, n, test) in FIGURES.items():
                if len(recent) < n or last.low != (sign > 0) or not unit > 0:
                    continue
                f = test([r.bar for r in recent], [sign * r.price for r in recent], unit, p)
                between = np.arange(last.bar + 1, t)
                if f and not (sign * close[between] > f.line(between)).any():
                    armed.append((name, f, recent[-n:]))
        waiting = []
        for name, f, own in armed:
            sign, line = FIGURES[name][0], f.line(t)
            if not sign * close[t] > line:
                waiting.append((name, f, own))
            elif t - own[0].bar <= p.max_span and sign * close[t] < line + f.height:
                out.append(Match(name, t, sign * line, sign * f.stop, sign * (line + f.height), tuple(r.bar for r in own), tuple(r.price for r in own)))
        armed = waiting
        for name, sign in FLAGS.items():
            h, lo, c = views[sign]
            if c[t] > ceiling[sign][t] and (found := _flag(h, lo, c, atr, t, p)):
                bars, line, stop, target = found
                out.append(Match(name, t, sign * line, sign * stop, sign * target, bars, (sign * lo[bars[0]], sign * h[bars[1]], sign * lo[bars[2]])))
    return out, Search(pivots.falling, pivots.best, pivots.turns[-6:], armed)


def scaled(m: Match, factor: float) -> Match:
    """The match with all prices times a factor."""
    return m._replace(entry=m.entry * factor, stop=m.stop * factor, target=m.target * factor, prices=tuple(x * factor for x in m.prices))


def _series(pdf: pd.DataFrame):
    pdf = pdf.sort_values("date", kind="stable")
    factor = pdf["adj_close"].to_numpy(float) / pdf["close"].to_numpy(float)
    return pdf, factor, *(pdf[c].to_numpy(float) * factor for c in ("open", "high", "low", "close"))


def find_patterns(bars: DataFrame) -> DataFrame:
    """A row per completed pattern: ticker, mic, date, pattern, direction, bar, levels (adjusted), pivots."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, _, _, high, low, close = _series(pdf)
        days = pdf["date"].tolist()
        rows = [(pdf["ticker"].iloc[0], pdf["mic"].iloc[0], days[m.bar], m.name, direction(m.name), m.bar, m.entry, m.stop, m.target, list(m.pivots)) for m in scan(high, low, close)]
        return pd.DataFrame(rows, columns=["ticker", "mic", "date", "pattern", "direction", "bar", "entry", "stop", "target", "pivots"])

    own = bars.select(*KEY, "date", "open", "high", "low", "close", "adj_close")
    return own.groupBy(*KEY).applyInPandas(work, "ticker string, mic string, date date, pattern string, direction string, bar int, entry double, stop double, target double, pivots array<int>")


def find_pivots(bars: DataFrame) -> DataFrame:
    """ticker, mic, bar, kind (H or L), price (adjusted), confirmed_at of every turning point."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, _, _, high, low, close = _series(pdf)
        z = Pivots(high, low, simple_atr(high, low, close, Params.atr_length), Params.reversal)
        for t in range(len(close)):
            z.step(t)
        return pd.DataFrame([(pdf["ticker"].iloc[0], pdf["mic"].iloc[0], x.bar, "L" if x.low else "H", x.price, x.seen_at) for x in z.turns], columns=["ticker", "mic", "bar", "kind", "price", "confirmed_at"])

    own = bars.select(*KEY, "date", "open", "high", "low", "close", "adj_close")
    return own.groupBy(*KEY).applyInPandas(work, "ticker string, mic string, bar int, kind string, price double, confirmed_at int")


def pattern_columns(bars: DataFrame) -> DataFrame:
    """ticker, mic, date and the pattern columns: flags 0 or 1, levels in real prices; one match a bar, the first."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, factor, _, high, low, close = _series(pdf)
        out = pdf[["ticker", "mic", "date"]].reset_index(drop=True)
        for c in PATTERN_COLUMNS:
            out[c] = 0.0 if c.removeprefix("pat_") in PATTERN_NAMES else np.nan
        taken = set()
        for m in scan(high, low, close):
            if m.bar not in taken:
                taken.add(m.bar)
                out.loc[m.bar, [f"pat_{m.name}", "pat_entry", "pat_stop", "pat_target"]] = [1.0, *(x / factor[m.bar] for x in (m.entry, m.stop, m.target))]
        return out

    own = bars.select(*KEY, "date", "open", "high", "low", "close", "adj_close")
    out = own.groupBy(*KEY).applyInPandas(work, "ticker string, mic string, date date, " + ", ".join(f"{c} double" for c in PATTERN_COLUMNS))
    return out.select(*KEY, "date", *[F.nanvl(c, F.lit(None).cast("double")).alias(c) for c in PATTERN_COLUMNS])


def find_match(matches: DataFrame, bars: DataFrame, pattern: str) -> DataFrame:
    """Matches of a pattern that were completed on the key's last bar."""
    last = bars.groupBy(*KEY).agg(F.max("date").alias("date"))
    return matches.where(F.col("pattern") == pattern).join(last, [*KEY, "date"], "left_semi")


def flags(bars: DataFrame, sign: int = 1, p: Params = Params()) -> DataFrame:
    """Flags by windows and array functions alone: ticker, mic, date, entry, stop, target (adjusted = real prices here).

    The same figure as in scan(), for whole series without a Python worker.
    """
    h, lo, c = ("high", "low", "close") if sign > 0 else ("_nlow", "_nhigh", "_nclose")
    x = bars.withColumns({"_nlow": -F.col("low"), "_nhigh": -F.col("high"), "_nclose": -F.col("close")})
    x = x.withColumn("_tr", true_range(F.col("high"), F.col("low"), F.col("close")))
    w = by_key().rowsBetween(1 - p.atr_length, 0)
    x = x.withColumn("_atr", F.when(F.count("_tr").over(w) == p.atr_length, F.avg("_tr").over(w))).withColumn("_i", F.row_number().over(by_key()))
    pause = by_key().rowsBetween(-p.flag_max, -1)
    x = x.withColumn("_top", F.max(F.struct(F.col(h).alias("v"), (-F.col("_i")).alias("i"), F.col("_atr").alias("a"))).over(pause))
    x = x.withColumn("_w", F.collect_list(F.struct(F.col("_i").alias("i"), F.col(h).alias("h"), F.col(lo).alias("l"))).over(by_key().rowsBetween(-p.flag_max - p.pole_bars, -1)))
    top_i = -F.col("_top.i")
    x = x.where((F.col("_i") > p.flag_max + p.pole_bars) & (F.col(c) > F.col("_top.v")) & (F.col("_i") - top_i >= p.flag_min))
    pole = F.filter("_w", lambda r: (r["i"] >= top_i - p.pole_bars) & (r["i"] < top_i))
    rest = F.filter("_w", lambda r: r["i"] > top_i)
    x = x.withColumn("_base", F.array_min(F.transform(pole, lambda r: r["l"]))).withColumn("_before", F.array_max(F.transform(pole, lambda r: r["h"]))).withColumn("_dip", F.array_min(F.transform(rest, lambda r: r["l"])))
    x = x.withColumn("_pole", F.col("_top.v") - F.col("_base")).withColumn("_target", F.col("_dip") + F.col("_pole"))
    ok = (F.col("_before") <= F.col("_top.v")) & (F.col("_pole") >= p.pole_min * F.col("_top.a")) & (F.col("_top.v") - F.col("_dip") <= p.max_retrace * F.col("_pole")) & (F.col(c) < F.col("_target"))
    return x.where(ok).select(*KEY, "date", (sign * F.col("_top.v")).alias("entry"), (sign * (F.col("_dip") - p.stop_buffer * F.col("_top.a"))).alias("stop"), (sign * F.col("_target")).alias("target"))


def follow(matches: DataFrame, bars: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """What came of each match: entry at the next open; stop before target within a bar; else open at the horizon's end.

    matches: ticker, mic, date, pattern, direction, stop, target. Those on the last bar, or before an open that isn't
    positive, have no outcome yet and are left out.
    """
    factor = F.when(F.col("close") != 0, F.col("adj_close") / F.col("close"))
    own = bars.select(*KEY, F.col("date").alias("_d"), *[(F.col(c) * factor).alias(f"_{c}") for c in ("open", "high", "low", "close")]).withColumn("_i", F.row_number().over(by_key("_d")))
    at = matches.withColumn("_m", F.monotonically_increasing_id()).join(own.select(*KEY, F.col("_d").alias("date"), F.col("_i").alias("_b")), [*KEY, "date"])
    sign = F.when(F.col("direction") == "long", 1.0).otherwise(-1.0)
    # the range of bars per match is joined by blocks of `horizon` bars, so the join has an equal key
    at = at.withColumn("sign", sign).withColumn("_block", F.explode(F.array(F.floor((F.col("_b") + 1) / horizon), F.floor((F.col("_b") + 1) / horizon) + 1)))
    own = own.withColumn("_block", F.floor(F.col("_i") / horizon))
    joined = at.join(own, [*KEY, "_block"]).where((F.col("_i") > F.col("_b")) & (F.col("_i") <= F.col("_b") + horizon))
    adverse = F.when(F.col("sign") > 0, F.col("_low")).otherwise(-F.col("_high")) <= F.col("sign") * F.col("stop")
    good = F.when(F.col("sign") > 0, F.col("_high")).otherwise(-F.col("_low")) >= F.col("sign") * F.col("target")
    hit = F.when(adverse, "stop").when(good, "target")
    # a match is one number while its bars meet; what it says is carried once
    own_columns = F.struct(*KEY, "date", "pattern", "direction", "stop", "target", "sign")
    per = joined.groupBy("_m").agg(F.any_value(own_columns).alias("_row"), F.min(F.struct("_i", F.col("_open").alias("o"))).alias("first"), F.min(F.when(hit.isNotNull(), F.struct("_i", hit.alias("hit")))).alias("end"), F.max(F.struct("_i", F.col("_close").alias("c"))).alias("last"), F.min("_b").alias("_b"))
    per = per.select("_row.*", "first", "end", "last", "_b").where((F.col("first._i") == F.col("_b") + 1) & (F.col("first.o") > 0)).withColumn("entry", F.col("first.o"))
    void = (F.col("sign") * F.col("entry") <= F.col("sign") * F.col("stop")) | (F.col("sign") * F.col("entry") >= F.col("sign") * F.col("target"))
    outcome = F.when(void, "void").otherwise(F.coalesce("end.hit", F.lit("open")))
    sessions = F.when(void, 0).otherwise(F.coalesce("end._i", "last._i") - F.col("_b"))
    out_at = F.when(outcome == "stop", F.col("stop")).when(outcome == "target", F.col("target")).when(outcome == "open", F.col("last.c"))
    return per.select(*KEY, "date", "pattern", "direction", "entry", "stop", "target", outcome.alias("outcome"), sessions.cast("int").alias("sessions"), (F.col("sign") * (out_at / F.col("entry") - 1)).alias("ret"))


def _counted(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count("outcome").alias("n"), *[F.count_if(F.col("outcome") == o).alias(f"n_{o}") for o in ("target", "stop", "open", "void")],
        F.avg(F.when(F.col("outcome") != "void", F.col("ret"))).alias("mean_ret"),
    ).withColumn("hit_ratio", F.try_divide("n_target", F.col("n_target") + F.col("n_stop")))


def pattern_stats(outcomes: DataFrame) -> DataFrame:
    """Counts by outcome, hit ratio and mean return of every pattern, those without a case too."""
    names = outcomes.sparkSession.createDataFrame([(p,) for p in PATTERN_NAMES], "pattern string")
    return _counted(names.join(outcomes, "pattern", "left").groupBy("pattern"))


def pattern_stats_yearly(outcomes: DataFrame) -> DataFrame:
    return _counted(outcomes.groupBy(F.year("date").alias("year"), "pattern"))
