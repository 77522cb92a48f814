"""Structured Streaming variants of the daily operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.patterns import Params


def event_bars(events: DataFrame, *, length: str = "1 hour", late: str = "48 hours") -> DataFrame:
    """Candles of event values per type and window; works on batches and, with a watermark, on streams."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        e = e.withWatermark("ts", late)
    o = F.struct("ts", "event_id")
    return e.groupBy(F.window("ts", length), "event_type").agg(
        F.min_by("value", o).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", o).alias("close"), F.count("*").alias("volume"),
    ).select("event_type", F.col("window.start").alias("start"), "open", "high", "low", "close", "volume")


def first_deliveries(articles: DataFrame, *, late: str = "48 hours") -> DataFrame:
    """Articles without those whose id was delivered within the watermark already."""
    a = articles.withColumn("published_at", F.col("published_at").cast("timestamp"))
    return a.withWatermark("published_at", late).dropDuplicatesWithinWatermark(["id"]) if articles.isStreaming else a.dropDuplicates(["id"])


def story_sessions(articles: DataFrame, *, gap: str = "48 hours") -> DataFrame:
    """Runs of copies of one text per group whose gaps stay within `gap`: digest, ticker, first, last, copies."""
    a = articles.withColumn("published_at", F.col("published_at").cast("timestamp"))
    if articles.isStreaming:
        a = a.withWatermark("published_at", gap)
    return a.groupBy(F.session_window("published_at", gap), "ticker", "digest").agg(F.count("*").alias("copies"), F.min("published_at").alias("first"), F.max("published_at").alias("last")).select("ticker", "digest", "first", "last", "copies")


def upsert_stream(stream: DataFrame, store, table: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda df: df):
    """Takes in all that is there now, batch by batch, by primary key; redelivery changes nothing."""
    return stream.writeStream.foreachBatch(lambda df, _: store.upsert(table, transform(df))).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def streaming_pivots(bars: DataFrame, p: Params = Params()) -> DataFrame:
    """Turning points of a stream of bars (ticker, mic, bar, high, low, close in order), with the state kept per key.

    The state is where the search stands and the bars since the extreme that may become the next turning point, or
    those that the next ATR needs: what came before is never looked at again. Bars that come late, behind the last one
    that was worked on, are left out.
    """
    from tidemark.operators.patterns import Pivots, simple_atr

    names = ("bar", "high", "low", "close")

    def work(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        *held, falling, low_at, high_at = state.get if state.exists else ([], [], [], [], None, None, None)
        pdf = pd.concat(list(batches)).sort_values("bar")
        pdf = pdf[pdf["bar"] > held[0][-1]] if held[0] else pdf
        old = len(held[0])
        bar, high, low, close = (list(h) + pdf[c].tolist() for h, c in zip(held, names, strict=True))
        h, lo, c = (np.array(x, float) for x in (high, low, close))
        z = Pivots(h, lo, simple_atr(h, lo, c, p.atr_length), p.reversal)
        z.falling, z.best = falling, {side: at for side, at in ((True, low_at), (False, high_at)) if at is not None}
        for t in range(old, len(c)):
            z.step(t)
        cut = max(0, min([len(c) - p.atr_length, *z.best.values()]))
        state.update((bar[cut:], high[cut:], low[cut:], close[cut:], z.falling, *(z.best[s] - cut if s in z.best else None for s in (True, False))))
        yield pd.DataFrame([(key[0], key[1], bar[x.bar], "L" if x.low else "H", x.price, bar[x.seen_at]) for x in z.turns], columns=["ticker", "mic", "bar", "kind", "price", "confirmed_at"])

    return bars.groupBy("ticker", "mic").applyInPandasWithState(
        work, "ticker string, mic string, bar long, kind string, price double, confirmed_at long",
        "bar array<bigint>, high array<double>, low array<double>, close array<double>, falling boolean, low_at int, high_at int", "append", GroupStateTimeout.NoTimeout,
    )
