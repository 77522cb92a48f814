"""Tables clustered by key: bucketed by (ticker, mic) and sorted by date, so that work by key needs no shuffle."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidemark.schemas import KEY, check_identifier
from tidemark.scratch import shared_dir

#: Candles in a bucket, about, when the number of buckets isn't given: a bucket is what one task reads.
ROWS = 5_000_000


def write_clustered(df: DataFrame, name: str | None = None, *, buckets: int | None = None, root: str | None = None) -> str:
    """Stores df (ticker, mic, date, ...) clustered and gives the name of its table.

    All rows of a key lie in one file, by date. Scans of the table know that: windows, aggregations and joins by key of
    tables with as many buckets run where the files are read. A key filter reads one bucket, and within a file the row
    groups whose range holds the key. Keys that are null are kept, in a bucket of their own.
    """
    spark = df.sparkSession
    name = check_identifier(name or f"clustered_{uuid.uuid4().hex}")
    n = buckets or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // ROWS))
    # dealt out as the buckets are, so that a bucket is one file and not one a task
    dealt = df.repartition(n, *KEY).write.bucketBy(n, *KEY).sortBy(*KEY, "date").mode("overwrite")
    dealt.option("path", f"{root or shared_dir(spark)}/{name}").saveAsTable(name)
    return name


def read_clustered(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(check_identifier(name))
