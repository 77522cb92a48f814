"""What is sent to the language model and what comes back; the client itself is given from outside."""

from __future__ import annotations

import hashlib
import json
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import clip, conditions, moment, rounded
from tidemark.schemas import KEY

VERDICTS = ("confirmar", "vigilar", "descartar")
ANSWER = "summary string, verdicts array<struct<ticker:string,verdict:string,confidence:double,headline:string,rationale:string,risks:array<string>>>"


class Client(Protocol):
    def ask(self, payload: str) -> str: ...


class Replay:
    """A client that gives recorded answers by payload hash."""

    def __init__(self, answers: dict[str, str]):
        self.answers = answers

    def ask(self, payload: str) -> str:
        return self.answers[hashlib.sha256(payload.encode()).hexdigest()]


#: Bounds of numbers, which the model's output format doesn't take (fixed values).
BOUNDS = ("minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum")


def without_bounds(schema):
    """A JSON schema without bounds of numbers at any depth."""
    if isinstance(schema, dict):
        return {k: without_bounds(v) for k, v in schema.items() if k not in BOUNDS}
    return [without_bounds(v) for v in schema] if isinstance(schema, list) else schema


def build_payload(candidates: DataFrame, topics: DataFrame, k: int = 5, *, panel: DataFrame | None = None, **header: str) -> DataFrame:
    """One row: payload (stable JSON: sorted fields, no spaces) and payload_hash.

    Candidates come with their conditions and their k latest topics, with name and currency if there is a panel (the
    ticker stands for a missing name), and with their figure's levels if they have one; topics without a ticker are
    the general ones. header: region, day, currency and what else stands beside them. Candidates and topics are bounded
    by their top-k.
    """
    from tidemark.operators.news import recent_topics

    shown = F.struct(moment(F.col("last_published_at")).alias("at"), "size", "sources", clip(F.col("title"), 160).alias("title"), "rank").alias("t")
    in_order = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("t.rank", "t"))), lambda x: x["t"].dropFields("rank")).alias(c)
    ranked = recent_topics(topics, k).select("ticker", shown)
    per = ranked.where("ticker is not null").groupBy("ticker").agg(in_order("topics"))
    own = candidates.join(per, "ticker", "left")
    if panel is not None:
        own = own.join(panel.select(*KEY, F.coalesce("name", "ticker").alias("_name"), F.col("currency").alias("_currency")), KEY, "left")
    fields = {
        "conditions": conditions(F.col("conditions_met")), "currency": F.col("_currency") if panel is not None else None, "direction": F.col("direction"), "last_close": rounded(F.col("close"), 4),
        "levels": F.when(F.col("pattern").isNotNull(), F.struct("pattern", rounded(F.col("stop_price"), 4).alias("stop"), rounded(F.col("target_price"), 4).alias("target"))) if {"pattern", "stop_price", "target_price"} <= set(candidates.columns) else None,
        "name": F.coalesce("_name", "ticker") if panel is not None else None, "rule_id": F.col("rule_id"), "score": rounded(F.col("score"), 3), "sector": F.col("sector") if "sector" in candidates.columns else None,
        "ticker": F.col("ticker"), "topics": F.coalesce("topics", F.array().cast(per.schema["topics"].dataType)),
    }
    one = F.struct(*[c.alias(name) for name, c in fields.items() if c is not None])
    general = ranked.where("ticker is null").agg(in_order("general"))
    both = own.agg(F.array_sort(F.collect_list(one)).alias("candidates")).crossJoin(general)  # two single rows
    body = {"candidates": F.col("candidates"), "general_topics": F.col("general"), **{name: F.lit(v) for name, v in header.items()}}
    return both.select(F.to_json(F.struct(*[body[n].alias(n) for n in sorted(body)])).alias("payload")).withColumn("payload_hash", F.sha2("payload", 256))


def parse_answers(df: DataFrame, column: str = "response") -> DataFrame:
    """df with answer (null if the text isn't the asked JSON or a verdict is unknown)."""
    parsed = F.from_json(column, ANSWER)
    known = F.forall(parsed["verdicts"], lambda v: v["verdict"].isin(*VERDICTS) & v["ticker"].isNotNull() & v["confidence"].between(0, 1))
    return df.withColumn("answer", F.when(F.coalesce(known, F.lit(False)), parsed))


def check_answer(answer: str, tickers: set[str]) -> dict:
    """The parsed answer; ValueError if it names other tickers than the candidates or leaves some out."""
    data = json.loads(answer)
    named = [v["ticker"] for v in data["verdicts"]]
    if set(named) != tickers or len(named) != len(set(named)) or any(v["verdict"] not in VERDICTS for v in data["verdicts"]):
        raise ValueError(f"left out: {sorted(tickers - set(named))}, invented: {sorted(set(named) - tickers)}")
    return data


def run_llm(payload: str, tickers: set[str], client: Client, recorded: dict[str, str] | None = None) -> tuple[dict, bool]:
    """The checked answer, and whether it was a recorded one for the same payload."""
    known = (recorded or {}).get(hashlib.sha256(payload.encode()).hexdigest())
    return check_answer(known or client.ask(payload), tickers), known is not None
