"""Declared schemas of the persistent tables, with primary keys and additive migrations."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INDICATOR_COLUMNS = ["rsi_14", "sma_20", "sma_50", "sma_200", "macd", "macd_hist", "macd_signal", "atr_14", "avg_volume_20", "ret_1d", "ret_5d", "ret_20d"]
PATTERN_NAMES = ["double_bottom", "double_top", "inv_head_shoulders", "head_shoulders", "ascending_triangle", "descending_triangle", "bull_flag", "bear_flag"]
PATTERN_COLUMNS = [*(f"pat_{p}" for p in PATTERN_NAMES), "pat_entry", "pat_stop", "pat_target"]
CATALOG = [*INDICATOR_COLUMNS, *PATTERN_COLUMNS]
KEY = ["ticker", "mic"]


_KINDS = {"string": T.StringType(), "double": T.DoubleType(), "long": T.LongType(), "int": T.IntegerType(), "boolean": T.BooleanType(), "date": T.DateType(), "timestamp": T.TimestampType(), "strings": T.ArrayType(T.StringType())}


def _parsed(text: str) -> T.StructType:
    return T.StructType([T.StructField(n, _KINDS[k]) for n, k in (x.split() for x in text.split(","))])


_CATALOG = ", ".join(f"{c} double" for c in CATALOG)
#: table -> (schema, primary key)
TABLES: dict[str, tuple[T.StructType, list[str]]] = {
    "prices": (_parsed("ticker string, mic string, date date, open double, high double, low double, close double, adj_close double, volume long, source string, ingested_at timestamp, dividend double, split double"), [*KEY, "date"]),
    "corporate_actions": (_parsed("ticker string, mic string, date date, kind string, value double, source string, detected_at timestamp"), [*KEY, "date", "kind"]),
    "indicators": (_parsed("ticker string, mic string, date date, close double, adj_close double, volume long, computed_at timestamp, " + _CATALOG), [*KEY, "date"]),
    "snapshots": (_parsed("ticker string, mic string, date date, region string, name string, sector string, sub_industry string, currency string, close double, adj_close double, volume long, created_at timestamp, " + _CATALOG), [*KEY, "date"]),
    "snapshot_runs": (_parsed("region string, date date, snapshot_hash string, rows int, expected int, coverage double, created_at timestamp"), ["region", "date"]),
    "news": (_parsed("id string, ticker string, mic string, source string, reliability double, language string, published_at timestamp, title string, summary string, url string, as_of date, fetched_at timestamp"), ["id"]),
    "news_clusters": (_parsed("region string, as_of date, cluster_id string, ticker string, mic string, representative_id string, size int, method string, sources string, reliability double, language string, first_published_at timestamp, last_published_at timestamp, title string, summary string, url string, sentiment_label string, sentiment_score double, created_at timestamp"), ["region", "as_of", "cluster_id"]),
    "news_cluster_members": (_parsed("region string, as_of date, cluster_id string, news_id string, method string, is_representative boolean, created_at timestamp"), ["region", "as_of", "cluster_id", "news_id"]),
    "llm_calls": (_parsed("region string, date date, model string, payload_hash string, batch boolean, input_tokens int, output_tokens int, cache_write_tokens int, cache_read_tokens int, cost_eur double, response string, created_at timestamp"), ["region", "date"]),
    "signals": (_parsed("ticker string, mic string, date date, rule_id string, region string, rule_hash string, snapshot_hash string, direction string, score double, conditions_met string, close double, currency string, execute_on date, verdict string, confidence double, rationale string, risks strings, llm_model string, created_at timestamp, headline string, pattern string, stop_price double, target_price double, execution_open double, open_gap double, reconcile_status string, reconciled_at timestamp"), [*KEY, "date", "rule_id"]),
    "api_calls": (_parsed("provider string, day date, calls int, updated_at timestamp"), ["provider", "day"]),
    "constituents": (_parsed("ticker string, name string, sector string, sub_industry string, cik long, mic string, currency string, start date, end date, source string"), ["ticker", "mic", "start"]),
}

_IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]*\Z")


def check_identifier(name: str) -> str:
    """The name, if it can be a table or column name; else ValueError."""
    if not _IDENTIFIER.match(name):
        raise ValueError(f"not an identifier: {name!r}")
    return name


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """df, if it has all columns; else ValueError naming those it lacks."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def conform(df: DataFrame, table: str) -> DataFrame:
    """df with exactly the table's columns and types; columns that it lacks are null, NaN becomes null."""
    schema = TABLES[table][0]
    out = []
    for f in schema:
        c = F.col(f.name) if f.name in df.columns else F.lit(None)
        if isinstance(f.dataType, T.DoubleType):
            c = F.nanvl(c.cast("double"), F.lit(None).cast("double"))
        out.append(c.cast(f.dataType).alias(f.name))
    return df.select(*out)
