"""Weighted rules over the panel: all rules in one pass, candidates by score."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.rules import Expression, check_variables, compile_expression
from tidemark.operators.indicators import tail
from tidemark.operators.universe import lookback_start
from tidemark.schemas import KEY, PATTERN_NAMES


@dataclass(frozen=True)
class Condition:
    expr: str
    weight: float
    required: bool = False
    label: str | None = None


@dataclass(frozen=True)
class Rule:
    """Filters on today's row and weighted conditions that must have held in one of the last `window` sessions."""

    id: str
    direction: str
    conditions: tuple[Condition, ...]
    filters: tuple[str, ...] = ()
    window: int = 1
    threshold: float = 0.6
    patterns: tuple[str, ...] = ()

    def __post_init__(self):
        if abs(sum(c.weight for c in self.conditions) - 1) > 1e-6:
            raise ValueError(f"{self.id}: weights must sum to 1")
        if self.direction not in ("long", "short"):
            raise ValueError(f"{self.id}: direction is long or short")

    def hash(self) -> str:
        return hashlib.sha256(json.dumps([self.id, self.direction, [[c.expr, c.weight, c.required] for c in self.conditions], self.filters, self.window, self.threshold]).encode()).hexdigest()


def pattern_rule(name: str) -> Rule:
    """The shipped rule of a chart pattern: the figure, volume, and a reward of at least the risk."""
    long = name in ("double_bottom", "inv_head_shoulders", "ascending_triangle", "bull_flag")
    reward = "pat_target - close >= close - pat_stop" if long else "close - pat_target >= pat_stop - close"
    return Rule(name, "long" if long else "short", (Condition(f"pat_{name} == 1", 0.6, True), Condition("volume > 1.2 * avg_volume_20", 0.2), Condition(reward, 0.2)), threshold=0.6, patterns=(name,))


OVERSOLD_UPTREND = Rule(
    "oversold_uptrend", "long",
    (Condition("rsi_14 < 30", 0.4), Condition("close > sma_200", 0.3, True), Condition("bullish_cross(macd, macd_signal)", 0.3)),
    filters=("avg_volume_20 > 1_000_000", "sector != 'Financials'"), window=5, threshold=0.7,
)
RULES = [OVERSOLD_UPTREND, *map(pattern_rule, PATTERN_NAMES)]


@dataclass
class CompiledRule:
    rule: Rule
    filters: list[Expression]
    conditions: list[Expression]
    sessions: int = field(init=False)

    def __post_init__(self):
        self.sessions = self.rule.window + max((e.lookback for e in [*self.filters, *self.conditions]), default=0)


def compile_rule(rule: Rule) -> CompiledRule:
    return CompiledRule(rule, [compile_expression(f) for f in rule.filters], [compile_expression(c.expr) for c in rule.conditions])


def load_window(indicators: DataFrame, panel: DataFrame, as_of, sessions: int) -> DataFrame:
    """The last sessions of every panel key with its attributes; an error if a key has no row on as_of.

    Only the days that so many sessions can span are read; as_of is a date.
    """
    recent = indicators.where(F.col("date").between(F.lit(lookback_start(as_of, sessions)), F.lit(as_of)))
    rows = recent.join(panel.select(*KEY), KEY, "left_semi")
    missing = panel.select(*KEY).join(rows.where(F.col("date") == F.lit(as_of)).select(*KEY), KEY, "left_anti")
    first = missing.limit(5).collect()
    if first:
        raise ValueError(f"no row on {as_of} for {', '.join(r.ticker for r in first)}")
    attributes = [c for c in panel.columns if c not in rows.columns or c in KEY]
    return tail(rows, sessions).join(panel.select(*attributes), KEY)


def evaluate(window: DataFrame, rules: list[CompiledRule]) -> DataFrame:
    """Per key and rule: eligible, score, conditions_met. All rules share the lags' windows and one aggregation by key."""
    check_variables([e for r in rules for e in [*r.filters, *r.conditions]], window.columns)
    flags = {}
    for i, r in enumerate(rules):
        for j, e in enumerate(r.filters):
            flags[f"_f{i}_{j}"] = (F.col("recency") == 0) & F.coalesce(e.column.cast("boolean"), F.lit(False))
        for j, e in enumerate(r.conditions):
            flags[f"_c{i}_{j}"] = (F.col("recency") < r.rule.window) & F.coalesce(e.column.cast("boolean"), F.lit(False))
    met = window.withColumns(flags).groupBy(*KEY).agg(*[F.bool_or(c).alias(c) for c in flags]) if flags else window.select(*KEY).distinct()
    out = [_judged(i, r) for i, r in enumerate(rules)]
    return met.select(*KEY, F.explode(F.array(*out)).alias("x")).select(*KEY, "x.*")


def _judged(i: int, r: CompiledRule) -> Column:
    eligible, score, open_ = F.lit(True), F.lit(0.0), F.lit(True)
    labels, seen = [], set()
    for j in range(len(r.filters)):
        eligible = eligible & F.col(f"_f{i}_{j}")
    for j, c in enumerate(r.rule.conditions):
        score = score + F.when(F.col(f"_c{i}_{j}"), c.weight).otherwise(0.0)
        open_ = open_ & F.col(f"_c{i}_{j}") if c.required else open_
        if c.expr not in seen:
            seen.add(c.expr)
            labels.append(F.when(F.col(f"_c{i}_{j}"), F.lit(c.label or c.expr)))
    names = F.array_join(F.filter(F.array(*labels), lambda x: x.isNotNull()), "; ")
    return F.struct(F.lit(r.rule.id).alias("rule_id"), F.lit(r.rule.hash()).alias("rule_hash"), F.lit(r.rule.direction).alias("direction"), F.lit(r.rule.threshold).alias("threshold"), eligible.alias("eligible"), F.when(open_, F.bround(score, 6)).otherwise(0.0).alias("score"), names.alias("conditions_met"))


def pattern_levels(rule: Column, rules: list[Rule]) -> Column:
    """Of the patterns that a rule names the first of the catalogue that completed today."""
    out = F.lit(None).cast("string")
    for r in rules:
        for p in reversed([p for p in PATTERN_NAMES if p in r.patterns]):
            out = F.when((rule == r.id) & (F.col(f"pat_{p}") == 1), F.lit(p)).otherwise(out)
    return out


def run_screener(panel: DataFrame, as_of, *, rules: list[Rule], indicators: DataFrame, max_candidates: int = 20, min_score: float = 0.0, min_avg_volume: float = 0.0) -> DataFrame:
    """Candidates: liquid panel keys whose score reaches the rule's threshold, best first over all rules, at most so many."""
    compiled = [compile_rule(r) for r in rules]
    liquid = panel.where(F.col("avg_volume_20") >= min_avg_volume)
    window = load_window(indicators, liquid, as_of, max(r.sessions for r in compiled))
    judged = evaluate(window, compiled).where(F.col("eligible") & (F.col("score") >= F.greatest("threshold", F.lit(min_score))))
    today = window.where("recency = 0")
    with_today = judged.join(today.select(*KEY, *[c for c in ("close", "sector", *(f"pat_{p}" for p in PATTERN_NAMES), "pat_stop", "pat_target") if c in today.columns]), KEY, "left")
    have = all(f"pat_{p}" in today.columns for r in rules for p in r.patterns)
    pattern = pattern_levels(F.col("rule_id"), rules) if have else F.lit(None).cast("string")
    out = with_today.withColumn("pattern", pattern)
    for c in ("stop", "target"):
        out = out.withColumn(f"{c}_price", F.when(F.col("pattern").isNotNull(), F.col(f"pat_{c}")) if f"pat_{c}" in today.columns else F.lit(None).cast("double"))
    out = out.select(*KEY, "rule_id", "direction", "score", "conditions_met", "close", *(["sector"] if "sector" in today.columns else []), "rule_hash", "pattern", "stop_price", "target_price")
    return out.orderBy(F.desc("score"), "ticker", "mic", "rule_id").limit(max_candidates)
