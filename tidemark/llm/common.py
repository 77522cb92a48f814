"""Helpers that the training-data operators share."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arrow batches handed to Python hold at most this many rows and bytes, so one batch never holds many long texts.
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20
#: Python functions cut a batch again so that the texts in work at one time stay near this many characters.
WORK_CHARS = 1_000_000
#: Rows in a range of a sorted table.
RANGE_ROWS = 1 << 15
_kept: list[tuple[str, object]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's bounds of Arrow batches, by rows and bytes, to those above; never raises one.

    Plans are lazy and read these settings when they run, so they stay lowered. No result depends on them.
    """
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(spark.conf.get(rows))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(size))
    if now <= 0 or now > BATCH_BYTES:
        spark.conf.set(size, f"{BATCH_BYTES}b")


def worker_state(ident: str, make: Callable[[], object]) -> object:
    """The one model, index or cache that a Python worker keeps between tasks; another one takes its place.

    Workers outlive tasks and stages and serve every operator, so whatever each of them kept would add up.
    """
    if not _kept or _kept[0][0] != ident:
        _kept.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        _kept.append((ident, make()))
    return _kept[0][1]


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors and the driver share: spark.checkpoint.dir, which must be set.

    Only where one process is driver and executors (tests) a folder of our own takes its place; on a cluster, a
    machine's own folder would lose what the other machines write.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir isn't set; it must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


@contextmanager
def freed_shuffles(spark: SparkSession):
    """Within it, every query's shuffle files go when the query has ended, not when the driver collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tidemark-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage, survives the loss of executors, and is computed once.

    The shuffle files that made it go at once: no later plan reads them.
    """
    spark = df.sparkSession
    path = path or new_path(spark, name)
    with freed_shuffles(spark):
        df.write.mode("overwrite").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tidemark_path = path
    return out


def ranged(df: DataFrame, keys: list[str], name: str, rows: int = RANGE_ROWS) -> DataFrame:
    """df in the order of `keys`, nulls first, as a table: seq (long) numbers its rows in order, part (int) the ranges they lie in.

    A range holds about `rows` rows, or fewer where the session has more shuffle partitions than that gives. Rows that
    agree in all keys are told apart by where they lay in df, so that even they spread over several ranges.
    """
    own = written(df.withColumn("_tie", F.monotonically_increasing_id()), name)
    parts = max(-(-own.count() // rows), 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    out = own.repartitionByRange(parts, *keys, "_tie").sortWithinPartitions(*keys, "_tie").withColumn("seq", F.monotonically_increasing_id())
    out = written(out.withColumn("part", F.shiftright("seq", 33).cast("int")).drop("_tie"), name)
    dropped(own)
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes tables made by written() that no later plan reads."""
    for t in tables:
        spark, path = t.sparkSession, t._tidemark_path
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def remainder(column: Column, n: int) -> Column:
    """crc32 of the value as text, mod n; a null value counts as the empty text."""
    return (F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % n).cast("int")


def spread(text: Column, most: int, windows: int = 12) -> Column:
    """The text, or of a longer one so many windows, `most` characters in all, that lie evenly from its start to its end."""
    n, size = F.length(text), most // windows
    cuts = [F.substring(text, F.lit(1) + F.floor(F.lit(i) * (n - size) / (windows - 1)).cast("int"), F.lit(size)) for i in range(windows)]
    return F.when(n <= most, text).otherwise(F.concat(*cuts))


def work_slices(sizes: list[int], most: int = WORK_CHARS):
    """Yields (from, to) over consecutive items whose sizes sum to about `most`; a larger item stands alone."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)
