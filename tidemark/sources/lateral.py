"""Parsers as table functions: one call per page or feed, joined by LATERAL in SQL or by lateralJoin."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from tidemark.sources.parsers import constituents_table, rss_entries

#: What a listing's columns may be called, in order of preference, when a caller names none.
HEADERS = {"ticker": ["Symbol", "Ticker"], "name": ["Company", "Security", "Name"], "sector": ["GICS Sector", "ICB Sector", "Sector"], "market": ["Country", "Exchange"]}


@udtf(returnType="ticker string, name string, sector string, market string")
class ListedConstituents:
    """The rows of a page's largest table of constituents, or of all of them; rows without cells, and without a ticker, don't count."""

    def eval(self, html: str, headers: dict, all_tables: bool) -> Iterator[tuple]:
        wanted = headers or HEADERS
        try:
            rows = constituents_table(html, wanted, all_tables=bool(all_tables))
        except ValueError:  # a page without such a table lists nothing
            return
        for r in rows:
            yield tuple(r.get(c) for c in ("ticker", "name", "sector", "market"))


@udtf(returnType="published_at timestamp, title string, summary string, url string")
class FeedEntries:
    """The dated entries of a feed from a time on, cleaned of tags and entities; a body that can't be read has none."""

    def eval(self, body: str, since: datetime) -> Iterator[tuple]:
        try:
            found = rss_entries(body or "", "", None, since.astimezone())
        except ElementTree.ParseError:
            return
        for _, _, at, title, summary, url in found:
            yield at, title, summary, url


def register(spark: SparkSession) -> None:
    """Makes listed_constituents(html, headers, all_tables) and feed_entries(body, since) known to SQL."""
    spark.udtf.register("listed_constituents", ListedConstituents)
    spark.udtf.register("feed_entries", FeedEntries)


def listed(pages: DataFrame, html: str, *, headers: dict[str, list[str]] | None = None, all_tables: bool = False, markets: dict[str, tuple[str, str]] | None = None, mic: str | None = None, currency: str | None = None, ticker: Column | None = None) -> DataFrame:
    """ticker, name, sector, mic, currency of the constituents that pages list, once per ticker and market.

    The market is the table's own column mapped by `markets` (a market that isn't there gives nulls), or the one given;
    `ticker` cleans the listed one, and rows whose ticker it rejects go.
    """
    wanted = F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for kv in (headers or HEADERS).items() for x in kv])
    rows = pages.select(F.col(html).alias("html")).lateralJoin(ListedConstituents(F.col("html").outer(), wanted, F.lit(all_tables))).drop("html")
    own = F.col("ticker") if ticker is None else ticker
    if markets:
        place = F.try_element_at(F.create_map(*[x for k, v in markets.items() for x in (F.lit(k), F.struct(F.lit(v[0]).alias("mic"), F.lit(v[1]).alias("currency")))]), F.trim("market"))
    else:
        place = F.struct(F.lit(mic).cast("string").alias("mic"), F.lit(currency).cast("string").alias("currency"))
    out = rows.select(own.alias("ticker"), F.trim("name").alias("name"), F.trim("sector").alias("sector"), place["mic"].alias("mic"), place["currency"].alias("currency"))
    # of rows of one ticker and market the least by its columns stays
    first = F.min(F.struct("name", "sector", "currency")).alias("f")
    return out.where("ticker is not null").groupBy("ticker", "mic").agg(first).select("ticker", "f.name", "f.sector", "mic", "f.currency")
