"""Operator 5: mixing sources to target weights by weighted fair queueing, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import dropped, written

#: A word for the size of a document: no ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Sources weigh 1, 2, 3, 1, ... by rank; a document is taken this often at most.
WEIGHTS, MOST_COPIES = 3, 3
#: Rows of a source that are summed in one go, and rows in one range of virtual time.
RUN_ROWS, RANGE_ROWS, MOST_RANGES = 128, 1000, 100_000
#: A table of sources up to this many rows is broadcast; a larger one is joined by shuffling.
BROADCAST_SOURCES = 50_000


def _targets(sizes: DataFrame, total: int, copies: int) -> DataFrame:
    """sid, weight and target of each source: shares of the total by weight, none above copies times its own size.

    The level (words per unit of weight) at which the shares fill up is found in one pass over the sources ordered by
    the level at which each is full.
    """
    ranked = sizes.withColumn("sid", F.row_number().over(Window.orderBy(F.col("s").asc_nulls_last())))
    ranked = ranked.withColumn("weight", (F.col("sid") - 1) % WEIGHTS + 1).withColumn("cap", copies * F.col("source_size"))
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), "sid")
    before = F.coalesce(F.sum("cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    weights = F.sum("weight").over(by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    levels = ranked.withColumn("level", (F.lit(total) - before) / weights)
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct((F.col("cap") / F.col("weight")).alias("x"), "sid", "level"))
    level = F.min(fits).over(Window.partitionBy())["level"]
    share = F.least(F.col("cap").cast("double"), F.coalesce(level * F.col("weight"), F.col("cap").cast("double")))
    return levels.select("s", "sid", "source_size", "n", share.alias("target"))


def _finish(epoch: int | Column) -> Column:
    """Virtual finish time of a document's copy: the words of its source up to it, divided by the source's target."""
    return F.when(F.col("target") > 0, (epoch * F.col("source_size") + F.col("upto")) / F.col("target"))


def mixed(df: DataFrame, *, key: str = "doc_id", source: str = "source", text: str = "text", seed: str = "mix", copies: int = MOST_COPIES) -> DataFrame:
    """Per row of df: key, source, hash, size, source_size, target, taken, copies.

    Each source's documents are shuffled by a hash of key, seed and text and stand in line up to `copies` times; a
    copy's virtual finish time is the cumulative size of its source divided by the source's target. All copies are put
    into ranges of virtual time, and the line is cut where the sum of sizes reaches the total of all sizes. Whole
    documents are taken.

    Null texts have size 0 and are taken 0 times; a null source is a source of its own and ranks last; a null key is
    an empty one; rows that agree in everything stand next to each other in any order, which gives equal rows. Reruns
    agree. An empty table gives an empty one; other columns are ignored whatever their names.

    Texts are read once, for their sizes; what is shuffled are rows of a few numbers. No source, however large, is
    ordered in one task: it is cut into runs of about 128 rows by the hash, and the runs' sums are added up.
    """
    h = F.md5(F.concat_ws("|", F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(seed), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))).cast("binary"))
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    rows = written(df.select(F.col(key).alias("k"), F.col(source).alias("s"), size.alias("size"), h.alias("h")), "mix-sizes")
    per_source = rows.groupBy("s").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    all_of = per_source.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("total"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("sources")).first()
    targets = _targets(per_source, all_of.total, copies)
    targets = F.broadcast(targets) if all_of.sources <= BROADCAST_SOURCES else targets

    run = F.floor(F.conv(F.substring("h", 1, 8), 16, 10).cast("long") * F.ceil(F.col("n") / RUN_ROWS) / F.lit(1 << 32))
    lined = rows.join(targets.withColumnRenamed("s", "s2"), F.col("s").eqNullSafe(F.col("s2"))).select("k", "s", "size", "h", "sid", "source_size", "target", run.alias("run"))
    sums = lined.groupBy("sid", "run").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("sid").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("sid", "run", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("sid", "run").orderBy("h", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = written(lined.join(base, ["sid", "run"]).withColumn("upto", F.col("base") + F.sum("size").over(inside)).drop("run", "base"), "mix-line")

    ranges = max(1, min(MOST_RANGES, all_of.n // RANGE_ROWS))
    epochs = F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))
    queue = placed.where("size > 0").select("size", "sid", "source_size", "target", "upto", epochs.alias("epoch")).select("size", "sid", _finish(F.col("epoch")).alias("v"))
    queue = queue.withColumn("range", F.when(F.col("v") < 2, F.floor(F.col("v") * ranges)).otherwise(2 * ranges).cast("long"))
    by_range = queue.groupBy("range").agg(F.sum("size").alias("words"))
    so_far = by_range.withColumn("upto", F.sum("words").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    full = so_far.where(F.col("upto") > all_of.total).agg(F.min(F.struct("range", (F.col("upto") - F.col("words")).alias("before"))).alias("x")).first().x
    taken = F.lit(copies)
    if full is not None:
        inside = queue.where(F.col("range") == full.range).withColumn("upto", full.before + F.sum("size").over(Window.orderBy("v", "sid").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        last = inside.where(F.col("upto") <= all_of.total).agg(F.max(F.struct("v", "sid")).alias("x")).first().x
        in_range = lambda v: F.when(v < 2, F.floor(v * ranges)).otherwise(2 * ranges)
        taken = F.lit(0)
        for epoch in range(copies):
            v = _finish(epoch)
            inn = in_range(v) < full.range
            if last is not None:
                inn = inn | ((in_range(v) == full.range) & ((v < last.v) | ((v == last.v) & (F.col("sid") <= last.sid))))
            taken = taken + F.when(inn, 1).otherwise(0)
    taken = F.when(F.col("size") > 0, taken).otherwise(0)
    dropped(rows)
    return placed.select(F.col("k").alias(key), F.col("s").alias(source), "h", "size", "source_size", "target", (F.col("size") * taken).alias("taken"), taken.cast("int").alias("copies"))


def mix_documents(df: DataFrame, **options) -> DataFrame:
    """The rows of df, each as often as the mix takes it (whole documents; those that aren't taken go)."""
    key, source, text, seed = (options.get(k, v) for k, v in (("key", "doc_id"), ("source", "source"), ("text", "text"), ("seed", "mix")))
    picks = mixed(df, **options).where("copies > 0").select(F.col("h").alias("_h"), F.col(source).alias("_s"), "copies", F.row_number().over(Window.partitionBy("h", source).orderBy(F.desc("copies"))).alias("_n"))
    h = F.md5(F.concat_ws("|", F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(seed), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))).cast("binary"))
    own = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), h.alias("_h2"), F.col(source).alias("_s2"))
    # rows of one key and text are told apart by their other columns, so that reruns take the same ones
    rest = [F.col(f"_row.`{f.name}`") for f in df.schema if "map<" not in f.dataType.simpleString()]
    own = own.withColumn("_n2", F.row_number().over(Window.partitionBy("_h2", "_s2").orderBy(F.xxhash64(*rest))))
    hit = own.join(picks, (F.col("_h") == F.col("_h2")) & F.col("_s").eqNullSafe(F.col("_s2")) & (F.col("_n") == F.col("_n2")))
    return hit.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("_row.*")


#: DuckDB SQL for mixed(): doc_id, size, source_size, target, taken, copies, with the whole line ordered in one window.
ORACLE = """
WITH d AS (SELECT doc_id, source,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
    md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|mix|' || md5(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS sid FROM d GROUP BY source),
w AS (SELECT *, (sid - 1) % 3 + 1 AS weight, 3 * source_size AS cap, CAST((SELECT sum(size) FROM d) AS BIGINT) AS total FROM s),
l AS (SELECT *, CAST(total - coalesce(sum(cap) OVER (ORDER BY CAST(cap AS DOUBLE) / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
    / CAST(sum(weight) OVER (ORDER BY CAST(cap AS DOUBLE) / weight, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM w),
m AS (SELECT arg_min(level, row(CAST(cap AS DOUBLE) / weight, sid)) AS level FROM l WHERE level * weight <= cap),
t AS (SELECT source, sid, source_size, total, least(CAST(cap AS DOUBLE), m.level * weight) AS target FROM l, m),
p AS (SELECT d.doc_id, d.size, d.h, t.sid, t.source_size, t.target, t.total,
    CAST(sum(d.size) OVER (PARTITION BY t.sid ORDER BY d.h, d.size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT p.*, CASE WHEN target > 0 THEN CAST(e * source_size + upto AS DOUBLE) / target END AS v FROM p, (SELECT unnest([0, 1, 2]) AS e)),
c AS (SELECT *, sum(size) OVER (ORDER BY v NULLS LAST, sid, h ROWS UNBOUNDED PRECEDING) <= total AND v IS NOT NULL AS inn FROM q)
SELECT doc_id, any_value(size) AS size, any_value(source_size) AS source_size, any_value(target) AS target,
    CAST(any_value(size) * count(*) FILTER (WHERE inn) AS BIGINT) AS taken FROM c GROUP BY doc_id, h
"""
