"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import dropped, written


def components(edges: DataFrame, *, most_rounds: int = 60) -> DataFrame:
    """node, component (the smallest node reachable) of every node of edges (a, b); nodes without links have no row.

    Alternates two steps until nothing changes, in a number of rounds near the logarithm of the longest chain: every
    node links its larger neighbours to its smallest neighbour, then its smaller neighbours and itself to their
    smallest. The links never outnumber those given. Each round is a partially aggregated minimum and a join, which
    adaptive execution splits where a node has very many links, and is written to the shared folder, so that the loss
    of an executor repeats one round at most. Nothing is collected but a count and a checksum.
    """
    now = written(edges.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).where("u < v").distinct(), "links")
    before = None
    for _ in range(most_rounds):
        both = now.select(F.col("u").alias("x"), F.col("v").alias("y")).union(now.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.join(least, "x").where("y > x and y != m").select(F.col("m").alias("u"), F.col("y").alias("v")).distinct()
        down = large.select(F.col("v").alias("x"), F.col("u").alias("y"))
        low = down.groupBy("x").agg(F.min("y").alias("m"))
        small = down.join(low, "x").select(F.col("m").alias("u"), F.when(F.col("y") == F.col("m"), F.col("x")).otherwise(F.col("y")).alias("v")).where("u < v").distinct()
        after = written(small, "links")
        mark = after.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")).first()
        dropped(now)
        now = after
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError("the components didn't settle")
    return now.select(F.col("v").alias("node"), F.col("u").alias("component")).union(now.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())
