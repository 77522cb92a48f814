"""Providers and feeds over a transport that is handed in: batches, budgets, pacing and what to do about errors.

A transport is a callable (url, parameters) -> Response. Requests are made on the driver, as their number is bounded by
quotas; their answers are parsed in Spark.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources import parsers
from tidemark.sources.registry import ARTICLES, PRICES, register

#: Statuses after which a provider isn't asked again in this run: no access, or a quota is used up (fixed values).
STOP = {401, 402, 403, 423, 429}
UNKNOWN = 404
CANDLES = "ticker string, mic string, date date, open double, high double, low double, close double, adj_close double, volume double"

#: Suffixes of symbols by market; markets that aren't here aren't covered (fixed values).
SUFFIXES = {
    "XNYS": "", "XNAS": "", "BATS": "", "UNKNOWN": "", "XLON": ".L", "XETR": ".DE", "XPAR": ".PA", "XAMS": ".AS", "XMAD": ".MC", "XMIL": ".MI", "XSWX": ".SW", "XSTO": ".ST",
    "XOSL": ".OL", "XCSE": ".CO", "XHEL": ".HE", "XBRU": ".BR", "XWBO": ".VI", "XDUB": ".IR", "XLIS": ".LS", "XWAR": ".WA", "XTKS": ".T", "XHKG": ".HK", "XASX": ".AX", "XKRX": ".KS", "BVMF": ".SA", "XMEX": ".MX",
}


@dataclass(frozen=True)
class Response:
    status: int
    text: str


Transport = Callable[[str, dict], Response]


def symbol(ticker: str, mic: str, suffixes: dict[str, str] = SUFFIXES) -> str | None:
    base = ticker.strip().upper().replace(" ", "-").replace(".", "-")
    return base + suffixes[mic] if base and mic in suffixes else None


def batches(items: list, size: int) -> Iterable[list]:
    for i in range(0, len(items), size):
        yield items[i : i + size]


@register(PRICES, "download")
def download_provider(download: Callable[[list[str], date, date], DataFrame | None], *, size: int = 200) -> Callable[[DataFrame, date], DataFrame]:
    """Candles from a download of many symbols at once, `size` at a time; keys of one start go together.

    download(symbols, start, end) gives a wide frame (see parsers.unpivot_download) or None if nothing came. Markets
    without symbols are left out. Planned keys are as many as the universe has, so they are read to the driver.
    """

    def fetch(planned: DataFrame, as_of: date) -> DataFrame:
        by_start: dict[date, dict[str, tuple[str, str]]] = {}
        for r in planned.where("start is not null").select("ticker", "mic", "start").toLocalIterator():
            own = symbol(r.ticker, r.mic)
            if own:
                by_start.setdefault(r.start, {})[own] = (r.ticker, r.mic)
        out = planned.sparkSession.createDataFrame([], CANDLES)
        for start, symbols in sorted(by_start.items()):
            for part in batches(sorted(symbols), size):
                wide = download(part, start, as_of)
                if wide is not None:
                    out = out.unionByName(parsers.unpivot_download(wide, {s: symbols[s] for s in part}))
        return out

    return fetch


@register(PRICES, "quota")
def quota_provider(transport: Transport, base: str, key: str, reserve: Callable[[int], bool], suffixes: dict[str, str]) -> Callable[[DataFrame, date], DataFrame]:
    """Candles symbol by symbol under a budget. An unknown symbol gives none; a refusal, a transport error or the end of
    the budget ends the run with what has come so far; other errors leave their symbol out."""

    def fetch(planned: DataFrame, as_of: date) -> DataFrame:
        got = []
        for r in planned.where("start is not null").select("ticker", "mic", "start").orderBy("ticker", "mic").toLocalIterator():
            own = symbol(r.ticker, r.mic, suffixes)
            if own is None:
                continue
            if not reserve(1):
                break
            try:
                answer = transport(f"{base}/eod/{own}", {"api_token": key, "fmt": "json", "period": "d", "from": r.start.isoformat(), "to": as_of.isoformat()})
            except OSError:
                break
            if answer.status in STOP:
                break
            if answer.status == 200:
                got.append((r.ticker, r.mic, answer.text))
        return parsers.eod_json(planned.sparkSession.createDataFrame(got, "ticker string, mic string, body string"), "body")

    return fetch


@register(ARTICLES, "rss")
def rss_source(spark: SparkSession, transport: Transport, template: str, *, per_ticker: bool = True, name: str = "rss") -> Callable[[DataFrame, datetime], DataFrame]:
    """Articles of one feed, or of a feed per ticker. A feed may fail; if all of them do, the source does (OSError)."""

    def fetch(tickers: DataFrame, since: datetime) -> DataFrame:
        wanted = [r.ticker for r in tickers.select("ticker").distinct().orderBy("ticker").toLocalIterator()] if per_ticker else [None]
        got, failed = [], []
        for t in wanted:
            try:
                answer = transport(template.format(ticker=(t or "").strip().upper().replace(" ", "-").replace(".", "-")), {})
                if answer.status != 200:
                    raise OSError(f"status {answer.status}")
                got.append((name, t, answer.text))
            except OSError as e:
                failed.append(f"{t or name}: {e}")
        if wanted and len(failed) == len(wanted):
            raise OSError(f"{name}: no feed answered ({failed[0]})")
        return parsers.rss(spark.createDataFrame(got, "source string, ticker string, body string"), since)

    return fetch


@register(ARTICLES, "paced")
def paced_source(spark: SparkSession, transport: Transport, url: str, key: str, *, per_minute: int = 60, name: str = "api", now: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> Callable[[DataFrame, datetime], DataFrame]:
    """Articles of a JSON service, a request per ticker at an even pace; a ticker that fails is left out, unless all do."""

    def fetch(tickers: DataFrame, since: datetime) -> DataFrame:
        wanted = [r.ticker for r in tickers.select("ticker").distinct().orderBy("ticker").toLocalIterator()]
        got, failed, due = [], [], now()
        for t in wanted:
            wait = due - now()
            if wait > 0:
                sleep(wait)
            due = max(due, now()) + 60.0 / per_minute
            try:
                answer = transport(url, {"symbol": t, "from": since.date().isoformat(), "token": key})
                if answer.status != 200:
                    raise OSError(f"status {answer.status}")
                got.append((t, answer.text))
            except OSError as e:
                failed.append(f"{t}: {e}")
        if wanted and len(failed) == len(wanted):
            raise OSError(f"{name}: nothing answered ({failed[0]})")
        bodies = spark.createDataFrame(got, "ticker string, body string")
        return parsers.news_json(bodies, "body", source=name, ticker=F.col("ticker")).where(F.col("published_at") >= F.lit(since))

    return fetch


def symbol_repair(known: DataFrame, search: Callable[[str, str], tuple[str, str] | None]) -> Callable[[DataFrame], DataFrame]:
    """An enricher: keys without recent candles are searched for, each once; what isn't found goes, failed searches stay.

    search(ticker, mic) gives the right key, None if there is none, and raises OSError if it can't tell.
    """
    from tidemark.operators.universe import repair_symbols

    memo: dict[tuple[str, str], tuple] = {}

    def enrich(table: DataFrame) -> DataFrame:
        rows = []
        for r in table.join(known.select("ticker", "mic").distinct(), ["ticker", "mic"], "left_anti").select("ticker", "mic").distinct().toLocalIterator():
            own = (r.ticker, r.mic)
            if own not in memo:
                try:
                    found = search(*own)
                    memo[own] = ("found", *found) if found else ("missing", None, None)
                except OSError:
                    rows.append((*own, "failed", None, None))
                    continue
            rows.append((*own, *memo[own]))
        return repair_symbols(table, known, table.sparkSession.createDataFrame(rows, "ticker string, mic string, status string, new_ticker string, new_mic string"))

    return enrich
