"""Providers by name, request budgets, and a Python data source for feeds that lie in a folder."""

from __future__ import annotations

import threading
from collections.abc import Callable
from datetime import date, datetime
from pathlib import Path

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Candle providers, article sources and universes by name: what the name is registered with.
PRICES: dict[str, Callable] = {}
ARTICLES: dict[str, Callable] = {}
UNIVERSES: dict[str, Callable] = {}


def register(table: dict[str, Callable], name: str):
    def add(f: Callable) -> Callable:
        table[name] = f
        return f

    return add


def get(table: dict[str, Callable], name: str) -> Callable:
    if name not in table:
        raise KeyError(f"unknown provider {name!r}; there are {', '.join(sorted(table)) or 'none'}")
    return table[name]


class Budget:
    """Calls per provider and day; a reservation that would pass the limit is refused and counts nothing."""

    def __init__(self):
        self._used: dict[tuple[str, date], int] = {}
        self._lock = threading.Lock()

    def used(self, provider: str, day: date) -> int:
        return self._used.get((provider, day), 0)

    def reserve(self, provider: str, day: date, calls: int, limit: int) -> bool:
        with self._lock:
            if self.used(provider, day) + calls > limit:
                return False
            self._used[provider, day] = self.used(provider, day) + calls
            return True


class FeedFolder(DataSource):
    """`spark.read.format("feeds").load(folder)`: RSS files named source__ticker.xml as articles, one partition per file."""

    @classmethod
    def name(cls) -> str:
        return "feeds"

    def schema(self) -> str:
        return "source string, ticker string, published_at timestamp, title string, summary string, url string"

    def reader(self, schema) -> DataSourceReader:
        return _FeedReader(self.options)


class _FeedReader(DataSourceReader):
    def __init__(self, options):
        self.folder, self.since = options["path"], options.get("since", "1970-01-01T00:00:00+00:00")

    def partitions(self):
        return [InputPartition(str(p)) for p in sorted(Path(self.folder).glob("*.xml"))]

    def read(self, partition):
        from tidemark.sources.parsers import rss_entries

        path = Path(partition.value)
        source, _, ticker = path.stem.partition("__")
        yield from rss_entries(path.read_text(), source, ticker or None, datetime.fromisoformat(self.since))
