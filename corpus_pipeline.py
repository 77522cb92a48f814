"""A corpus pipeline over `documents`: quality, near-duplicates, benchmark passages, mixing, token ids.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns
that they were given. Every stage is written as Parquet in the shared folder before the next one reads it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import quality as q
from tidemark.llm.common import table, written
from tidemark.llm.decontam import with_hits
from tidemark.llm.minhash_dedup import near_duplicates
from tidemark.llm.mixing import mix_documents
from tidemark.llm.token_output import token_output

#: Documents of a lower quality score go.
ACCEPT = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose compression score is ACCEPT or more. Without labels of both kinds all documents stay."""
    model = q.train(docs, table(spark, sf_dir, "labels"))
    return q.with_score(docs, model, score="_quality").where(F.col("_quality") >= ACCEPT).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each class of near-duplicate texts: that of smallest doc_id, rows without one last.

    Classes are those of the texts, whatever their doc_id: rows that share a doc_id stay if their texts aren't near
    copies of each other or of others, and rows without a doc_id go if theirs are. Null and empty texts aren't copies;
    of them only rows that repeat a doc_id go.
    """
    whole = F.substring(F.unhex(F.sha2(F.col("text").cast("binary"), 256)), 1, 16)
    filled = docs.where(F.length("text") > 0)
    classes = near_duplicates(filled.select(whole.alias("h"), "text"), key="h").select("h", "class_id").distinct()
    # of every text the row that sorts first, before texts meet their classes: copies never meet in one task
    of_text = filled.groupBy(whole.alias("h")).agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id")).alias("f")).select("h", "f.*")
    first = F.min(F.struct("no_id", "doc_id", "h")).alias("first")
    # one name of a doc_id and text, never null; copies under other ids have other names and so other tasks
    name = lambda k, h: F.sha2(F.concat(h, F.coalesce(k.cast("string"), F.lit("")).cast("binary"), k.isNull().cast("string").cast("binary")), 256)
    keep = of_text.join(classes, "h").groupBy("class_id").agg(first).select(name(F.col("first.doc_id"), F.col("first.h")).alias("_name"))
    own = filled.withColumn("_name", name(F.col("doc_id"), whole)).join(keep, "_name", "left_semi").dropDuplicates(["_name"])
    empty = docs.where(F.col("text").isNull() | (F.length("text") == 0))
    rest = empty.where(F.col("doc_id").isNotNull()).dropDuplicates(["doc_id"]).union(empty.where(F.col("doc_id").isNull()))
    return own.select(*docs.columns).union(rest)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in which no benchmark item is found, be it one without an item_id."""
    items = table(spark, sf_dir, "benchmark").select(F.sha2(F.col("text").cast("binary"), 256).alias("item_id"), "text")
    found = with_hits(docs, items, hits="_hits")
    return found.where(F.size("_hits") == 0).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Gives each document as often as the mix takes it; those that it doesn't take go."""
    return mix_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token files of all documents and reads back doc_id, start, n_tokens and ids_crc32 of each."""
    return token_output(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix), ("tokens", tokens)]

#: None: SQL can't express the compression classifier; the tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
