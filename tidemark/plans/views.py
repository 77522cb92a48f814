"""Domain views over the driver's tables, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily candles: a brand's line items of a day, priced per unit."""
    px = F.col("l_extendedprice") / F.col("l_quantity")
    li = read(spark, sf_dir, "lineitem").where("l_quantity > 0").join(read(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    x = li.select(F.col("p_brand").alias("ticker"), F.to_date("l_shipdate").alias("date"), px.alias("px"), "l_quantity", F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", px.alias("p")).alias("o"))
    per = x.groupBy("ticker", "date").agg(F.min_by("px", "o").alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", "o").alias("close"), F.sum("l_quantity").cast("long").alias("volume"))
    return per.select("ticker", F.lit("XSYN").alias("mic"), "date", "open", "high", "low", "close", F.col("close").alias("adj_close"), "volume")


BARS = """bars AS (SELECT ticker, 'XSYN' AS mic, date, arg_min(px, o) AS open, max(px) AS high, min(px) AS low, arg_max(px, o) AS close, arg_max(px, o) AS adj_close, CAST(sum(q) AS BIGINT) AS volume
FROM (SELECT p_brand AS ticker, CAST(l_shipdate AS DATE) AS date, l_quantity AS q, l_extendedprice / l_quantity AS px, row(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice / l_quantity) AS o
FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 0) GROUP BY ticker, date)"""


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Membership intervals: a supplier from its first to its last shipment, open if that was in the last 30 days."""
    li = read(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.min(F.to_date("l_shipdate")).alias("start"), F.max(F.to_date("l_shipdate")).alias("last"))
    last = li.agg(F.max("last").alias("d"))
    s = read(spark, sf_dir, "supplier").join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    own = li.join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(F.broadcast(last))
    end = F.when(F.col("last") < F.date_sub("d", 30), F.date_add("last", 1))
    return own.select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("ticker"), F.lit("XSYN").alias("mic"), F.col("s_name").alias("name"), F.col("n_name").alias("sector"), "start", end.alias("end"))


MEMBERS = """sp AS (SELECT l_suppkey, min(CAST(l_shipdate AS DATE)) AS s, max(CAST(l_shipdate AS DATE)) AS e FROM lineitem GROUP BY 1),
members AS (SELECT 'S' || CAST(s_suppkey AS VARCHAR) AS ticker, 'XSYN' AS mic, s_name AS name, n_name AS sector, s AS "start", CASE WHEN e < (SELECT max(e) FROM sp) - 30 THEN e + 1 END AS "end"
FROM sp JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)"""


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as articles: the source is the ticker, the first line the title, a time made of doc_id."""
    d = read(spark, sf_dir, "documents")
    at = F.timestamp_seconds(F.lit(1704067200) + (F.col("doc_id") * 37 % 4320) * 60)
    return d.select(F.col("doc_id").alias("id"), F.col("source").alias("ticker"), F.lit("XSYN").alias("mic"), "source", (F.length("source") / 10.0).alias("reliability"), F.col("lang").alias("language"), at.alias("published_at"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), F.col("text").alias("summary"), F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("url"))


ARTICLES = """articles AS (SELECT doc_id AS id, source AS ticker, 'XSYN' AS mic, source, length(source) / 10.0 AS reliability, lang AS language,
make_timestamp((1704067200 + (doc_id * 37 % 4320) * 60) * 1000000) AS published_at, split_part(text, chr(10), 1) AS title, text AS summary, 'doc:' || CAST(doc_id AS VARCHAR) AS url FROM documents)"""


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as signals: a customer's order is reconciled with the brand's open on the order's day."""
    o = read(spark, sf_dir, "orders")
    brand = F.concat(F.lit("Brand#"), (F.col("o_custkey") % 5 + 1).cast("string"), (F.col("o_orderkey") % 5 + 1).cast("string"))
    verdict = F.when(F.col("o_orderstatus") == "F", "confirmar").when(F.col("o_orderstatus") == "O", "vigilar").otherwise("descartar")
    return o.select(
        brand.alias("ticker"), F.lit("XSYN").alias("mic"), F.to_date("o_orderdate").alias("execute_on"), F.concat(F.lit("r"), F.col("o_orderkey").cast("string")).alias("rule_id"),
        F.when(F.col("o_orderkey") % 2 == 0, "long").otherwise("short").alias("direction"), (F.col("o_orderkey") % 1000 / 1000.0).alias("score"), (F.col("o_custkey") % 100 / 100.0).alias("confidence"),
        F.when(F.col("o_orderkey") % 3 == 0, "bull_flag").alias("pattern"), verdict.alias("verdict"), (F.col("o_totalprice") / 100).alias("close"), F.when(F.col("o_orderkey") % 4 != 0, "conciliada").alias("reconcile_status"),
    )


SIGNALS = """signals AS (SELECT 'Brand#' || CAST(o_custkey % 5 + 1 AS VARCHAR) || CAST(o_orderkey % 5 + 1 AS VARCHAR) AS ticker, 'XSYN' AS mic, CAST(o_orderdate AS DATE) AS execute_on,
'r' || CAST(o_orderkey AS VARCHAR) AS rule_id, CASE WHEN o_orderkey % 2 = 0 THEN 'long' ELSE 'short' END AS direction, o_orderkey % 1000 / 1000.0::DOUBLE AS score, o_custkey % 100 / 100.0::DOUBLE AS confidence,
CASE WHEN o_orderkey % 3 = 0 THEN 'bull_flag' END AS pattern, CASE o_orderstatus WHEN 'F' THEN 'confirmar' WHEN 'O' THEN 'vigilar' ELSE 'descartar' END AS verdict,
o_totalprice / 100 AS close, CASE WHEN o_orderkey % 4 <> 0 THEN 'conciliada' END AS reconcile_status FROM orders)"""


def rnd(c: Column, digits: int) -> Column:
    """Rounding that two engines do alike."""
    return F.floor(c * 10.0**digits + 0.5) / 10.0**digits


def rnd_sql(x: str, digits: int) -> str:
    return f"floor(({x}) * 1e{digits} + 0.5) / 1e{digits}"
