"""Messages and charts: formatting, dispatch, splitting. Networks are given from outside as callables."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Message:
    text: str
    chart: str | None = None


def split_text(text: str, limit: int = 4096) -> list[str]:
    """Parts of at most `limit` characters, cut at line breaks where there are any."""
    out = []
    while len(text) > limit:
        cut = text.rfind("\n", 0, limit + 1)
        cut = cut if cut > 0 else limit
        out.append(text[:cut])
        text = text[cut:].lstrip("\n")
    return [*out, text] if text or not out else out


@dataclass
class Dispatcher:
    """Sends every message to every provider; one that fails doesn't keep the others from theirs."""

    providers: dict[str, Callable[[Message], None]]
    errors: list[str] = field(default_factory=list)

    def send(self, messages: list[Message]) -> int:
        sent = 0
        for name, provider in self.providers.items():
            for m in messages:
                try:
                    provider(m)
                    sent += 1
                except Exception as e:  # noqa: BLE001
                    self.errors.append(f"{name}: {e}")
        return sent


def chart_spec(bars: DataFrame, *, title: str, levels: dict[str, float] | None = None, sessions: int = 120) -> str:
    """A drawing of the last candles and the levels as a Vega-Lite document."""
    rows = [r.asDict() for r in bars.select("date", "open", "high", "low", "close").orderBy("date").tail(sessions)]
    for r in rows:
        r["date"] = str(r["date"])
    x, color = {"field": "date", "type": "temporal"}, {"condition": {"test": "datum.open < datum.close", "value": "#2a7"}, "value": "#c33"}
    layers = [
        {"mark": "rule", "encoding": {"x": x, "y": {"field": "low", "type": "quantitative", "scale": {"zero": False}}, "y2": {"field": "high"}, "color": color}},
        {"mark": "bar", "encoding": {"x": x, "y": {"field": "open", "type": "quantitative"}, "y2": {"field": "close"}, "color": color}},
        *({"mark": {"type": "rule", "strokeDash": [4, 4]}, "encoding": {"y": {"datum": v}}, "name": k} for k, v in (levels or {}).items()),
    ]
    return json.dumps({"title": title, "data": {"values": rows}, "layer": layers})


def price(value: float | None) -> str:
    return "-" if value is None else f"{value:,.2f}"


def levels_text(row) -> str:
    """Entry, stop and target with their distances from the close."""
    parts = [f"close {price(row['close'])}"]
    for c in ("stop_price", "target_price"):
        if row[c] is not None and row["close"]:
            parts.append(f"{c.split('_')[0]} {price(row[c])} ({row[c] / row['close'] - 1:+.1%})")
    return ", ".join(parts)


def build_digest(signals: DataFrame, *, region: str, day, limit: int = 20) -> Message:
    """Counts per direction and the best signals, one line each."""
    counts = {r.direction: r["count"] for r in signals.groupBy("direction").count().collect()}
    rows = signals.orderBy(*[c for c in (signals.score.desc(), "ticker")]).limit(limit).collect()
    head = f"{region} {day}: " + (", ".join(f"{n} {d}" for d, n in sorted(counts.items())) or "no signals")
    return Message("\n".join([head, *(f"{r.ticker} {r.direction} {r.rule_id} {r.score:.2f}" for r in rows)]))


def operation_messages(operations: DataFrame, charts: Callable[[str, str], str | None] = lambda t, m: None) -> list[Message]:
    """One message per recommended operation."""
    return [Message(f"{r.direction.upper()} {r.ticker}\n{levels_text(r)}", charts(r.ticker, r.mic)) for r in operations.collect()]
