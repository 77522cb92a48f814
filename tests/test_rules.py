import pytest
from datetime import date

from tidemark.functions.rules import RuleError, check_variables, compile_expression
from tidemark.operators.screener import Condition, Rule, compile_rule, evaluate, pattern_rule

ROWS = [("A", "X", date(2024, 1, d), c, s) for d, c, s in ((1, 1.0, "Tech"), (2, None, None), (3, 5.0, "Financials"))]


def held(spark, expr):
    df = spark.createDataFrame(ROWS, "ticker string, mic string, date date, close double, sector string")
    return [r.x for r in df.withColumn("x", compile_expression(expr).column).orderBy("date").collect()]


def test_missing_values_are_false_and_not_turns_them_round(spark):
    assert held(spark, "close > 2") == [False, False, True]
    assert held(spark, "not close > 2") == [True, True, False]
    assert held(spark, "sector != 'Financials'") == [True, True, False]
    assert held(spark, "close / 0 > 1 and 0 < close < 9") == [True, False, True]


def test_crosses_and_lags(spark):
    assert held(spark, "bullish_cross(close, prev(close, 2))") == [False, False, False]
    e = compile_expression("prev(close, 2) < close")
    assert (e.lookback, e.variables, e.functions) == (2, {"close"}, {"prev"})


@pytest.mark.parametrize("bad", ["close ** 2", "close % 2", "a.b", "a[0]", "f(x)", "prev(x)", "prev(x, n=1)", "+x", "x in y", "None", "lambda: 1", "x if y else z", "prev(x, -1)", "", "1; 2", "x // 2", "bullish_cross(a)"])
def test_rejected(bad):
    with pytest.raises(RuleError):
        compile_expression(bad)


def test_unknown_variables_and_weights():
    with pytest.raises(RuleError):
        check_variables([compile_expression("a > b")], ["a"])
    with pytest.raises(ValueError):
        Rule("r", "long", (Condition("a > 1", 0.5),))


def test_required_conditions_and_repeated_labels(spark):
    df = spark.createDataFrame([("A", "X", date(2024, 1, 1), 0, 1.0), ("B", "X", date(2024, 1, 1), 0, 3.0)], "ticker string, mic string, date date, recency int, close double")
    rule = Rule("r", "long", (Condition("close > 2", 0.5, True), Condition("close > 0", 0.25), Condition("close > 0", 0.25)), threshold=0)
    got = {r.ticker: (r.score, r.conditions_met) for r in evaluate(df, [compile_rule(rule)]).collect()}
    assert got == {"A": (0.0, "close > 0"), "B": (1.0, "close > 2; close > 0")}


def test_shipped_pattern_rules():
    assert pattern_rule("bear_flag").direction == "short" and pattern_rule("bull_flag").direction == "long"


def test_all_nine_shipped_rules_fire(spark):
    """A key for each rule, on one day: its figure, or the dip, with volume and reward; one more whose sector is filtered out."""
    from datetime import timedelta

    from pyspark.sql import functions as F

    from tidemark.operators.screener import RULES, run_screener
    from tidemark.schemas import PATTERN_NAMES

    day = date(2024, 6, 28)
    rows = []
    for n, rule in enumerate([*RULES, RULES[0]]):
        long, name = rule.direction == "long", rule.patterns[0] if rule.patterns else None
        for back in range(8):
            dip = name is None
            rows.append((
                f"T{n}", "X", day - timedelta(days=back), 100.0, 90.0 if dip else 110.0, 28.0 if dip and back == 3 else 50.0, 1.0 if back == 0 else -1.0, 0.0, 3_000_000, 2_000_000.0,
                90.0 if long else 110.0, 130.0 if long else 70.0, *[1.0 if p == name and back == 0 else 0.0 for p in PATTERN_NAMES],
            ))
    columns = "ticker string, mic string, date date, close double, sma_200 double, rsi_14 double, macd double, macd_signal double, volume long, avg_volume_20 double, pat_stop double, pat_target double"
    ind = spark.createDataFrame(rows, columns + "".join(f", pat_{p} double" for p in PATTERN_NAMES))
    panel = ind.where(F.col("date") == F.lit(day)).select("ticker", "mic", "avg_volume_20", F.when(F.col("ticker") == f"T{len(RULES)}", "Financials").otherwise("Tech").alias("sector"))
    got = {r.ticker: (r.rule_id, r.direction, r.score, r.pattern) for r in run_screener(panel, day, rules=RULES, indicators=ind).collect()}
    assert got == {f"T{n}": (r.id, r.direction, 1.0, r.patterns[0] if r.patterns else None) for n, r in enumerate(RULES)} and len(RULES) == 9
