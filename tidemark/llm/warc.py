"""Operator 12: WARC archives, written and read back record by record.

Archives are written by Spark's text writer, a record a row. They are read in byte ranges, cut at every occurrence of
the magic line. Each occurrence is a candidate record that names its successor by its own lengths; only candidates that
can be reached from the file's start are records, so that magic inside payloads is rejected.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import bound_batches, new_path, written

#: The line that every record starts with, and what follows every record's block.
MAGIC, END = "WARC/1.0\r\n", "\r\n\r\n"
#: Payloads of fewer bytes are never revisits.
LEAST_BYTES = 100
#: A payload that more than one in so many pages has is hot: there are at most so many of them.
HOT_SHARE = 1000
#: Time of capture where the pages have none.
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def _payload(html: Column) -> Column:
    return F.coalesce(html, F.lit("")).cast("binary")


def _int(name: str) -> Column:
    """A long as an integer; whatever is larger than any row's bytes is the largest one."""
    return F.least(F.col(name), F.lit((1 << 31) - 1)).cast("int")


def _no_breaks(c: Column) -> Column:
    """A header's value stays on its line."""
    return F.replace(F.replace(c, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def _record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("-")), F.lit(">"))


def _first_of_digest(pages: DataFrame) -> DataFrame:
    """digest, first, size: of the payloads that several pages have, the smallest page_id and the number of pages."""
    own = pages.select("page_id", _payload(F.col("html")).alias("p")).where(F.length("p") >= LEAST_BYTES).select("page_id", F.sha2("p", 256).alias("digest"))
    per = own.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("size"))
    return written(per.where("size > 1"), "warc-firsts")


def with_first(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest, first (the smallest page_id with the same payload; null if no other page has it or it is short).

    Payloads of more than a thousandth of the pages, a thousand at most, are found by a broadcast; all others are joined
    by digest, where no key can then hold more than a thousandth. Pages of hot payloads are spread over that join.
    """
    own = pages.select("page_id", "url", "html", F.sha2(_payload(F.col("html")), 256).alias("digest"))
    firsts = _first_of_digest(pages)
    n = pages.count()
    hot = firsts.where(F.col("size") * HOT_SHARE > n).select("digest", F.col("first").alias("hot"))
    rest = firsts.where(F.col("size") * HOT_SHARE <= n).select(F.col("digest").alias("_by"), F.col("first").alias("other"))
    own = own.join(F.broadcast(hot), "digest", "left")
    spread = F.when(F.col("hot").isNull(), F.col("digest")).otherwise(F.concat(F.lit("hot "), F.xxhash64("page_id", "url").cast("string")))
    return own.withColumn("_by", spread).join(rest, "_by", "left").select("page_id", "url", "html", "digest", F.coalesce("hot", "other").alias("first"))


def write_warc(pages: DataFrame, path: str | None = None, *, date: str = DATE) -> str:
    """Writes a record for each row of pages (page_id, url, html) and gives the archives' folder.

    A response holds an HTTP head and the payload; a page whose payload, of 100 bytes or more, is that of a page with a
    smaller page_id is a revisit, which holds the HTTP head alone and refers to it. Files, one a task, are committed by
    Spark's writer, so that lost and repeated tasks leave nothing behind.
    """
    path = path or new_path(pages.sparkSession, "warc")
    own = with_first(pages)
    revisit = F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") != F.col("first")))
    size = F.length(_payload(F.col("html")))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size.cast("string"), F.lit("\r\n\r\n"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    record = F.concat(
        F.lit(MAGIC), line("WARC-Type", F.when(revisit, "revisit").otherwise("response")), line("WARC-Record-ID", _record_id(F.col("page_id"))), line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", _no_breaks(F.col("url"))), F.lit("")), line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(revisit, F.concat(line("WARC-Refers-To", _record_id(F.col("first"))), line("WARC-Profile", F.lit(PROFILE)))).otherwise(""),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", (F.octet_length(head) + F.when(revisit, 0).otherwise(size)).cast("string")), F.lit("\r\n"), head, F.when(revisit, "").otherwise(F.coalesce("html", F.lit(""))),
    )
    own.select(record.alias("value")).write.mode("overwrite").option("lineSep", END).text(path)
    return path


def _header(head: Column, name: str) -> Column:
    """A header's value, null if it isn't there. `head` starts with the line after the magic."""
    found = F.regexp_extract(F.concat(F.lit("\r\n"), head, F.lit("\r\n")), rf"(?i)\r\n{name}:[ \t]*([^\r\n]*)\r\n", 1)
    return F.nullif(found, F.lit(""))


def segments(spark: SparkSession, path: str) -> DataFrame:
    """What stands between two occurrences of the magic line, in byte ranges of the archives, with offsets.

    file, block (start of the byte range that the segment starts in), at (offset of the magic before it, negative for
    what stands before the first one), len (bytes after the magic), body (their SHA-256), and, read as a record's: the
    header's fields, succ (offset of the successor that its lengths name; null if it is no header), inside (whether the
    whole block lies in this segment), and the HTTP payload's payload_bytes and payload_digest if it does.
    """
    raw = spark.read.option("lineSep", MAGIC).text(path)
    raw = raw.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("_i"))
    head = F.when(F.locate(END, F.col("value")) > 0, F.substring_index("value", END, 1))
    x = raw.select("file", "block", "_i", F.octet_length("value").alias("len"), F.sha2(F.col("value").cast("binary"), 256).alias("body"), "value", head.alias("head"))
    # sixteen digits at most: a longer length can be no file's
    length = F.regexp_extract(F.coalesce(_header(F.col("head"), "Content-Length"), F.lit("")), r"^(\d{1,16})$", 1)
    x = x.withColumn("length", F.nullif(length, F.lit("")).cast("long")).withColumn("skip", F.octet_length("head") + len(END))
    x = x.withColumn("inside", F.col("skip") + F.col("length") <= F.col("len"))
    fields = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "refers_to": "WARC-Refers-To", "stated": "WARC-Payload-Digest"}
    x = x.withColumns({k: _header(F.col("head"), v) for k, v in fields.items()})
    found = _http(F.when(F.col("inside"), F.substring(F.col("value").cast("binary"), F.col("skip") + 1, _int("length"))))
    x = written(x.withColumns(found).drop("value", "head"), "warc-segments")
    before = F.coalesce(F.sum(F.col("len") + len(MAGIC)).over(Window.partitionBy("file", "block").orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = x.groupBy("file", "block").agg(F.sum(F.col("len") + len(MAGIC)).alias("_n"))
    base = F.coalesce(F.sum("_n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    x = x.withColumn("_b", before).join(blocks.select("file", "block", base.alias("_base")), ["file", "block"])
    at = F.col("_base") + F.col("_b") - len(MAGIC)
    succ = F.col("at") + len(MAGIC) + F.col("skip") + F.col("length") + len(END)
    return x.withColumn("at", at).withColumn("succ", succ).drop("_b", "_base", "_i")


def _http(block: Column) -> dict[str, Column]:
    """payload_bytes, payload_digest and stated_bytes of an HTTP block: what follows its head, and the length that it states."""
    n = F.octet_length(F.substring_index(block.cast("string"), END, 1))
    payload = F.substring(block, n + len(END) + 1, F.length(block))
    head = F.substring_index(block.cast("string"), END, 1)
    stated = F.regexp_extract(F.coalesce(_header(F.concat(F.lit("\r\n"), head), "Content-Length"), F.lit("")), r"^(\d{1,16})$", 1)
    return {"payload_bytes": F.length(payload).cast("long"), "payload_digest": F.sha2(payload, 256), "stated_bytes": F.nullif(stated, F.lit("")).cast("long")}


def contract(table: pa.Table) -> pa.Table:
    """Of the candidates of one byte range, by at: file, at, exit, where the chain from each of them leaves the range's candidates."""
    table = table.sort_by([("at", "descending")])
    at, succ, exits = table.column("at").to_pylist(), table.column("succ").to_pylist(), {}
    for a, s in zip(at, succ, strict=True):
        exits[a] = exits.get(s, s)
    return pa.table({"file": table.column("file").cast(pa.string()), "at": pa.array(at, pa.int64()), "exit": pa.array([exits[a] for a in at], pa.int64())})


def follow(table: pa.Table, entries: pa.Table) -> pa.Table:
    """Of the candidates of one byte range, those that the chain from its entries meets: file, at."""
    step = dict(zip(table.column("at").to_pylist(), table.column("succ").to_pylist(), strict=True))
    met = set()
    for a in entries.column("at").to_pylist():
        while a in step and a not in met:
            met.add(a)
            a = step[a]
    file = table.column("file")[0].as_py() if len(table) else ""
    return pa.table({"file": pa.array([file] * len(met), pa.string()), "at": pa.array(sorted(met), pa.int64())})


def reachable(candidates: DataFrame) -> DataFrame:
    """file, at of those candidates (file, block, at, succ) that the chain of successors from offset 0 of their file meets.

    Each byte range first contracts its candidates to where their chains leave it. What such an exit meets in a later
    range, be it a record or magic in a payload, is an entry of that range; from each file's start, pointers over
    entries double their reach in every round, so that the rounds are the logarithm of a file's ranges. The entries that
    are reached are then followed within their ranges. Only offsets move; a range's offsets are one group.
    """
    exits = written(candidates.select("file", "block", "at", "succ").groupBy("file", "block").applyInArrow(contract, "file string, at long, exit long"), "warc-exits")
    targets = exits.select("file", F.col("exit").alias("at")).union(exits.where("at = 0").select("file", "at")).distinct()
    pointers = written(exits.join(targets, ["file", "at"]), "warc-pointers")
    longest = pointers.groupBy("file").count().agg(F.max("count")).first()[0] or 0
    known = pointers.select("file", "at")
    reached = known.where("at = 0")
    for _ in range(max(0, longest - 1).bit_length()):
        ends = pointers.join(reached, ["file", "at"]).select("file", F.col("exit").alias("at"))
        reached = written(reached.union(ends.join(known, ["file", "at"], "left_semi")).distinct(), "warc-reached")
        further = pointers.select("file", F.col("at").alias("exit"), F.col("exit").alias("further"))
        pointers = written(pointers.join(further, ["file", "exit"]).select("file", "at", F.col("further").alias("exit")), "warc-pointers")
    own = candidates.select("file", "block", "at", "succ")
    entries = written(reached.join(own.select("file", "at", "block"), ["file", "at"]).select("file", "block", "at"), "warc-entries")
    return own.groupBy("file", "block").cogroup(entries.groupBy("file", "block")).applyInArrow(follow, "file string, at long")


def _assembled(spark: SparkSession, path: str, parts: DataFrame, records: DataFrame) -> DataFrame:
    """file, at, payload_bytes, payload_digest, stated_bytes of records whose blocks hold magic: their segments put together again.

    The segments' contents are fetched by their hash, in a second scan.
    """
    open_ones = records.where("not inside").select("file", "at", "succ", "skip", "length")
    marks = open_ones.select("file", "at", F.lit(0).alias("_o"), F.struct("at", "succ").alias("r"), F.lit(None).cast("string").alias("body"))
    all_of = parts.join(open_ones.select("file").distinct(), "file", "left_semi").select("file", "at", F.lit(1).alias("_o"), F.lit(None).cast("struct<at:bigint,succ:bigint>").alias("r"), "body")
    last = F.last("r", ignorenulls=True).over(Window.partitionBy("file").orderBy("at", "_o"))
    pieces = written(marks.union(all_of).withColumn("r", last).where("_o = 1 and r is not null and at < r.succ").select("file", F.col("r.at").alias("start"), "at", "body"), "warc-pieces")
    raw = spark.read.option("lineSep", MAGIC).text(path).withColumn("body", F.sha2(F.col("value").cast("binary"), 256))
    contents = raw.join(pieces.select("body").distinct(), "body", "left_semi").groupBy("body").agg(F.min("value").alias("value"))
    whole = pieces.join(contents, "body").groupBy("file", "start").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("v"))
    whole = whole.select("file", F.col("start").alias("at"), F.array_join(F.transform("v", lambda x: x["value"]), MAGIC).cast("binary").alias("bytes"))
    own = open_ones.join(whole, ["file", "at"])
    return own.select("file", "at", *[c.alias(k) for k, c in _http(F.substring(F.col("bytes"), F.col("skip") + 1, _int("length"))).items()])


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives in a folder: file, at (offset), record_type, record_id, target_uri, refers_to,
    payload_bytes, payload_digest (SHA-256, hex; both of the full payload), intact (whether the stated digest is that one).

    A response's payload is read and hashed; a revisit states the length and digest of the payload that it leaves out.
    What can't be reached from a file's start isn't a record; a file that doesn't start with a record has none. Files
    are read in byte ranges, so any size will do; they must not be compressed.
    """
    bound_batches(spark)
    parts = written(segments(spark, path), "warc-offsets")
    candidates = parts.where("at >= 0 and succ is not null")
    records = written(candidates.join(reachable(candidates), ["file", "at"]), "warc-records")
    names = ["payload_bytes", "payload_digest", "stated_bytes"]
    if records.where("not inside").limit(1).count():
        again = _assembled(spark, path, parts, records).withColumnsRenamed({c: f"_{c}" for c in names})
        records = records.join(again, ["file", "at"], "left").withColumns({c: F.coalesce(c, f"_{c}") for c in names})
    stated = F.regexp_extract(F.coalesce("stated", F.lit("")), "^sha256:([0-9a-f]{64})$", 1)
    revisit = F.col("record_type") == "revisit"
    size, digest = F.when(revisit, F.col("stated_bytes")).otherwise(F.col("payload_bytes")), F.when(revisit, stated).otherwise(F.col("payload_digest"))
    return records.select("file", "at", "record_type", "record_id", "target_uri", "refers_to", size.alias("payload_bytes"), digest.alias("payload_digest"), (digest == stated).alias("intact"))


def archive(pages: DataFrame) -> DataFrame:
    """Writes pages (page_id, url, html) as WARC archives and reads them back: per page page_id, payload_bytes,
    payload_digest, record_type (response or revisit), refers_to.

    A null html is an empty payload. Payloads of fewer than 100 bytes are responses, whatever their copies. Rows that
    share the smallest page_id of a payload are all responses; a null page_id is never the smallest, so such a page
    revisits one that has an id, and is a response if none has. Repeated rows are records of their own. Other columns
    are ignored whatever their names; an empty table gives an empty one. A payload may hold anything, records included.
    """
    kind = pages.schema["page_id"].dataType.simpleString()
    found = read_warc(pages.sparkSession, write_warc(pages))
    of = lambda c: F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), "^<urn:page:(.*)>$", 1), F.lit("")).try_cast(kind)
    return found.select(of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", of(F.col("refers_to")).alias("refers_to"))


#: The same in SQL.
ORACLE = """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), f AS (SELECT h, min(page_id) AS first FROM p WHERE strlen(h) >= 100 GROUP BY h)
SELECT page_id, CAST(strlen(p.h) AS BIGINT) AS payload_bytes, sha256(p.h) AS payload_digest, CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN page_id <> first THEN first END AS refers_to FROM p LEFT JOIN f ON p.h = f.h"""
