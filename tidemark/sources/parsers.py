"""Readers of what providers send: interval CSV, exchange JSON, HTML tables, RSS, wide downloads, news JSON."""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import datetime, timezone
from email.utils import parsedate_to_datetime
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.universe import canonical_ticker
from tidemark.functions.text import cleaned


def intervals_csv(spark: SparkSession, path: str) -> DataFrame:
    """ticker, start, end from `ticker,start_date,end_date`; dates that can't be read are open, rows without a ticker go."""
    raw = spark.read.schema("ticker string, start_date string, end_date string").csv(path, header=True)
    day = lambda c: F.try_to_timestamp(c, F.lit("yyyy-MM-dd")).cast("date")
    return raw.where(F.trim("ticker") != "").select(canonical_ticker(F.col("ticker")).alias("ticker"), day(F.col("start_date")).alias("start"), day(F.col("end_date")).alias("end"))


def exchange_json(df: DataFrame, column: str, mics: dict[str, str]) -> DataFrame:
    """ticker, cik, name, mic from a text `{fields, data}`; one row per ticker; exchanges without a market code go."""
    parsed = F.from_json(column, "fields array<string>, data array<array<string>>")
    rows = df.select(parsed.alias("p")).select("p.fields", F.explode("p.data").alias("row"))
    at = lambda name: F.get("row", (F.array_position("fields", name) - 1).cast("int"))
    table = F.create_map(*[F.lit(x) for kv in mics.items() for x in kv])
    own = rows.select(canonical_ticker(at("ticker")).alias("ticker"), at("cik").cast("long").alias("cik"), at("name").alias("name"), F.try_element_at(table, at("exchange")).alias("mic"))
    return own.where("ticker is not null and mic is not null").groupBy("ticker").agg(F.min(F.struct("cik", "name", "mic")).alias("r")).select("ticker", "r.cik", "r.name", "r.mic")


class _Tables(HTMLParser):
    """All tables of a page as lists of rows of cell texts; nested tables stand for themselves."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tables: list[list[list[str]]] = []
        self._open: list[list[list[str]]] = []
        self._cell: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self._open.append([])
        elif tag == "tr" and self._open:
            self._open[-1].append([])
        elif tag in ("td", "th") and self._open and self._open[-1]:
            self._cell = []

    def handle_endtag(self, tag):
        if tag == "table" and self._open:
            self.tables.append([r for r in self._open.pop() if any(c for c in r)])
        elif tag in ("td", "th") and self._cell is not None:
            self._open[-1][-1].append(re.sub(r"\s+", " ", re.sub(r"\[.*?\]", "", "".join(self._cell))).strip())
            self._cell = None

    def handle_data(self, data):
        if self._cell is not None:
            self._cell.append(data)


def html_tables(html: str) -> list[list[list[str]]]:
    p = _Tables()
    p.feed(html or "")
    return p.tables


def constituents_table(html: str, headers: dict[str, list[str]], *, all_tables: bool = False) -> list[dict[str, str | None]]:
    """Rows of the largest table that has all wanted columns (or of all such tables). headers: column -> names it may have."""
    found = []
    for rows in html_tables(html):
        if not rows:
            continue
        at = {c: next((i for i, h in enumerate(rows[0]) if h.lower() in {n.lower() for n in names}), None) for c, names in headers.items()}
        if at.get("ticker") is not None:
            found.append([{c: (r[i] or None) if i is not None and i < len(r) else None for c, i in at.items()} for r in rows[1:]])
    if not found:
        raise ValueError("no table with a ticker column")
    picked = [r for t in found for r in t] if all_tables else max(found, key=len)
    return [r for r in picked if r["ticker"]]


def html_constituents(pages: DataFrame, column: str, headers: dict[str, list[str]], *, all_tables: bool = False) -> DataFrame:
    """A row per listed constituent of every page; pages without such a table have none."""
    names = list(headers)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for page in pdf["page"]:
                try:
                    rows += constituents_table(page, headers, all_tables=all_tables)
                except ValueError:
                    continue
            yield pd.DataFrame(rows, columns=names)

    return pages.select(F.col(column).alias("page")).mapInPandas(work, ", ".join(f"{n} string" for n in names))


def rss_entries(text: str, source: str, ticker: str | None, since: datetime) -> list[tuple]:
    """(source, ticker, published_at, title, summary, url) of entries that have a date, a link and a title, from `since` on.

    Titles and summaries are cleaned of tags and entities; a missing summary is empty.
    """
    out = []
    for item in ElementTree.fromstring(text).iter():
        if item.tag.rpartition("}")[2] not in ("item", "entry"):
            continue
        own = {c.tag.rpartition("}")[2]: c for c in item}
        value = lambda *names: next(((own[n].text or "").strip() for n in names if n in own and (own[n].text or "").strip()), None)  # noqa: E731, B023
        when, title = value("pubDate", "published", "updated", "date"), cleaned(value("title"))
        link = value("link") or (own["link"].get("href") if "link" in own else None)
        if not (when and title and link):
            continue
        try:
            at = parsedate_to_datetime(when)
        except ValueError:
            try:
                at = datetime.fromisoformat(when)
            except ValueError:
                continue
        at = at.replace(tzinfo=at.tzinfo or timezone.utc).astimezone(timezone.utc)
        if at >= since:
            out.append((source, ticker, at, title, cleaned(value("description", "summary")), cleaned(link)))
    return out


def rss(feeds: DataFrame, since: datetime) -> DataFrame:
    """Entries of feeds (source, ticker, body); a feed that can't be read has none."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                try:
                    rows += rss_entries(r.body, r.source, r.ticker, since)
                except ElementTree.ParseError:
                    continue
            yield pd.DataFrame(rows, columns=["source", "ticker", "published_at", "title", "summary", "url"])

    return feeds.select("source", "ticker", "body").mapInPandas(work, "source string, ticker string, published_at timestamp, title string, summary string, url string")


def news_json(df: DataFrame, column: str, *, source: str, ticker: Column) -> DataFrame:
    """Articles of a JSON array with Unix seconds."""
    item = F.explode(F.from_json(column, "array<struct<datetime:bigint,headline:string,summary:string,url:string>>"))
    own = df.select(ticker.alias("ticker"), item.alias("x"))
    return own.where("x.headline is not null and x.url is not null").select(F.lit(source).alias("source"), "ticker", F.timestamp_seconds("x.datetime").alias("published_at"), F.col("x.headline").alias("title"), "x.summary", "x.url")


#: Fields of a wide download and their columns (fixed values).
FIELDS = {"Open": "open", "High": "high", "Low": "low", "Close": "close", "Adj Close": "adj_close", "Volume": "volume"}


def unpivot_download(wide: DataFrame, symbols: dict[str, tuple[str, str]], separator: str = "|") -> DataFrame:
    """Long candles from columns `symbol|field` per date; rows without a close and unknown symbols go, missing fields are null."""
    have = {c for c in wide.columns if separator in c}
    bars = []
    for symbol, (ticker, mic) in symbols.items():
        if f"{symbol}{separator}Close" in have:
            fields = [(F.col(f"`{symbol}{separator}{f}`") if f"{symbol}{separator}{f}" in have else F.lit(None)).cast("double").alias(c) for f, c in FIELDS.items()]
            bars.append(F.struct(F.lit(ticker).alias("ticker"), F.lit(mic).alias("mic"), *fields))
    if not bars:
        return wide.sparkSession.createDataFrame([], "ticker string, mic string, date date, " + ", ".join(f"{c} double" for c in FIELDS.values()))
    return wide.select(F.to_date("date").alias("date"), F.explode(F.array(*bars)).alias("b")).where("b.close is not null").select("b.ticker", "b.mic", "date", *[f"b.{c}" for c in FIELDS.values()])


def eod_json(df: DataFrame, column: str) -> DataFrame:
    """Candles of one symbol's JSON array (date, open, high, low, close, adjusted_close, volume); df has ticker, mic."""
    kind = "array<struct<date:string,open:double,high:double,low:double,close:double,adjusted_close:double,volume:double>>"
    own = df.select("ticker", "mic", F.explode(F.from_json(column, kind)).alias("x"))
    return own.where("x.close is not null").select("ticker", "mic", F.to_date("x.date").alias("date"), "x.open", "x.high", "x.low", "x.close", F.col("x.adjusted_close").alias("adj_close"), "x.volume")
