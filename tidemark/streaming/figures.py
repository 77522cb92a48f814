"""Figures and flags of a stream of bars, with typed state that a timer ends for idle keys."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.patterns import Figure, Params, Search, Turn, scan_on

#: Kinds of state. Bars and turning points are numbered as the key's bars came, from 0 on.
BARS = "number long, bar long, high double, low double, close double"
TURNS = "bar long, price double, low boolean, seen_at long"
ARMED = "name string, size int, bar long, price double, slope double, height double, stop double, turns int"
SEARCH = "falling boolean, low_at long, high_at long, seen long"
MATCHES = "ticker string, mic string, bar long, pattern string, entry double, stop double, target double"


class Figures(StatefulProcessor):
    """Per key: the bars that may be needed again, the last turning points, the figures that wait for their breakout."""

    def __init__(self, p: Params = Params(), idle_ms: int = 0):
        self.p, self.idle_ms = p, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bars, self.turns, self.armed = handle.getListState("bars", BARS), handle.getListState("turns", TURNS), handle.getListState("armed", ARMED)
        self.search = handle.getValueState("search", SEARCH)

    def _held(self) -> tuple[list[tuple], Search, int]:
        """Bars, search (numbered as the key's bars) and the number of bars that were there."""
        if not self.search.exists():
            return [], Search(), 0
        falling, low_at, high_at, seen = self.search.get()
        best = {side: at for side, at in ((True, low_at), (False, high_at)) if at is not None}
        turns = [Turn(*t) for t in self.turns.get()]
        armed = [(name, Figure(size, bar, price, slope, height, stop), turns[-n:]) for name, size, bar, price, slope, height, stop, n in self.armed.get()]
        return list(self.bars.get()), Search(falling, best, turns, armed), seen

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, search, seen = self._held()
        new = pd.concat(list(rows)).sort_values("bar").drop_duplicates("bar")
        new = new[new["bar"] > held[-1][1]] if held else new
        old = len(held)
        first = held[0][0] if held else 0
        held += [(seen + i, int(b), float(h), float(lo), float(c)) for i, (b, h, lo, c) in enumerate(new[["bar", "high", "low", "close"]].itertuples(index=False))]
        if len(held) > old:
            high, low, close = (np.array([x[i] for x in held], float) for i in (2, 3, 4))
            found, search = scan_on(high, low, close, self.p, search.moved(first), old)
            cut = search.cut_at(len(held), self.p)
            yield pd.DataFrame([(*key, held[m.bar][1], m.name, m.entry, m.stop, m.target) for m in found], columns=["ticker", "mic", "bar", "pattern", "entry", "stop", "target"])
            self._keep(held[cut:], search.moved(-first), seen + len(new))
        if self.idle_ms:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)

    def _keep(self, bars: list[tuple], search: Search, seen: int) -> None:
        self.bars.put(bars)
        self.search.update((search.falling, search.best.get(True), search.best.get(False), seen))
        for state, rows in ((self.turns, [tuple(t) for t in search.turns]), (self.armed, [(name, *f, len(own)) for name, f, own in search.armed])):
            if rows:
                state.put(rows)
            else:
                state.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """A key that has been idle starts anew with its next bar."""
        for state in (self.bars, self.turns, self.armed, self.search):
            state.clear()
        return iter(())

    def close(self) -> None:
        pass


def streaming_figures(bars: DataFrame, p: Params = Params(), idle_ms: int = 0) -> DataFrame:
    """The figures and flags that a stream of bars (ticker, mic, bar, high, low, close in order) completes, as scan() finds them.

    Bars that come late, behind the last one that was worked on, are left out. State is held by RocksDB, as typed lists
    whose columns may be added to; with idle_ms, a key without bars for so long is forgotten (with a trigger that runs on:
    one that takes in what is there and ends waits for no timer).
    """
    bars.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return bars.groupBy("ticker", "mic").transformWithStateInPandas(statefulProcessor=Figures(p, idle_ms), outputStructType=MATCHES, outputMode="Append", timeMode="ProcessingTime" if idle_ms else "None")
