"""Queries against their SQL on the smallest tables, and what must hold of the ones without SQL."""

import datetime
import math
import os

import duckdb
import pytest

import __spark_entry__
from tidemark.plans.queries import ORACLE_SQL

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Every query of the engine's own operators that has SQL.
OWN = sorted(ORACLE_SQL)

pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="the driver's tables aren't here")


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else repr(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return str(value) if value is not None else None


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", OWN)
def test_against_sql(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, DIR)
    columns = sorted(df.columns)
    cursor = duck.execute(__spark_entry__.oracle_sql()[name])
    own = [d[0] for d in cursor.description]
    assert sorted(own) == columns
    at = [own.index(c) for c in columns]
    want = sorted(str([plain(r[i]) for i in at]) for r in cursor.fetchall())
    assert sorted(str([plain(r[c]) for c in columns]) for r in df.collect()) == want


def test_every_sql_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).limit(1).count() == 1


def test_shipped_rules_read_the_line_items_once(spark):
    """Bars and figures are kept for the jobs that follow the first, so what is left to do reads no line items."""
    assert not any("lineitem" in f for f in __spark_entry__.queries()["shipped_rules"](spark, "/root/testdata/sf0.001").inputFiles())


def test_sentiment_scores_read_the_texts_once(spark):
    """Texts are counted by the first job and never shuffled; what is left to do reads vectors, a row for each document."""
    found = __spark_entry__.queries()["sentiment_scores"](spark, DIR)
    assert not any("documents" in f for f in found.inputFiles())
    assert found.columns == ["doc_id", "label", "score"]
    assert found.select("doc_id").exceptAll(spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id")).count() == 0 and found.count() == spark.read.parquet(f"{DIR}/documents.parquet").count()
