"""Operator 2: removal of repeated chunks of lines whose bounds depend on content, of pairs of lines and of long lines."""

from __future__ import annotations

import hashlib

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bound_batches, dropped, written

#: A chunk ends after a line if the rolling hash of so many lines up to it is 0 modulo so much; shorter chunks go on.
WINDOW, EVERY, LEAST_LINES = 2, 3, 2
#: A line of more words or more bytes than this is compared on its own too.
LONG_WORDS, LONG_BYTES = 50, 500
_FACTOR, _MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1


def line_hashes(lines: list[bytes]) -> list[int]:
    return [xxhash.xxh3_64_intdigest(x) for x in lines]


def bounds(hashes: list[int], window: int = WINDOW, every: int = EVERY, least: int = LEAST_LINES) -> list[tuple[int, int]]:
    """Chunks of lines, as (first, end), by a rolling hash over line hashes.

    The hash of the last `window` lines takes in a line and lets the oldest go. Where a chunk ends depends on those
    lines only (and on where the last one ended, within `least` lines), so lines put in before or after don't shift it.
    What is left at the end of the text is a chunk too.
    """
    out, first, rolled = [], 0, 0
    oldest = pow(_FACTOR, window, 1 << 64)
    for i, h in enumerate(hashes):
        rolled = (rolled * _FACTOR + h) & _MASK
        if i >= window:
            rolled = (rolled - hashes[i - window] * oldest) & _MASK
        if i + 1 - first >= least and (rolled ^ rolled >> 29) % every == 0:
            out.append((first, i + 1))
            first = i + 1
    if first < len(hashes):
        out.append((first, len(hashes)))
    return out


def split_lines(text: str | None) -> list[bytes]:
    """The text's lines with their line ends; only the last line may have none."""
    lines = (text or "").encode("utf-8", "surrogatepass").split(b"\n")
    return [x + b"\n" for x in lines[:-1]] + ([lines[-1]] if lines[-1] else [])


def _joined(lines: list[bytes]) -> bytes:
    # the last line counts as if it had a line end, so that a passage is the same at the end of a text
    part = b"".join(lines)
    return part if part.endswith(b"\n") else part + b"\n"


def _spans(lines: list[bytes]) -> list[tuple[int, int, int]]:
    """(ordinal, first, end) of the chunks of two lines or more that aren't blank."""
    found = enumerate(bounds(line_hashes([x.rstrip(b"\n") for x in lines])))
    return [(n, a, b) for n, (a, b) in found if sum(1 for x in lines[a:b] if x.strip()) >= LEAST_LINES]


def chunks(text: str | None) -> list[tuple[int, bytes, int]]:
    """(ordinal, bytes, lines) of the text's chunks of two lines or more that aren't blank; line ends are part of them."""
    lines = split_lines(text)
    return [(n, _joined(lines[a:b]), b - a) for n, a, b in _spans(lines)]


def is_long(line: bytes) -> bool:
    return len(line) > LONG_BYTES or len(line) > 2 * LONG_WORDS and len(line.split()) > LONG_WORDS


def pieces(lines: list[bytes]) -> list[tuple[int, int, bytes]]:
    """(first, end, bytes) of all that is compared, each span once.

    Chunks, and so that no passage escapes because bounds fall beside it, every pair of neighbouring lines that aren't
    blank, with the blank ones between them, and every long line. A passage of two lines or more is made of such pairs.
    """
    full = [i for i, x in enumerate(lines) if x.strip()]
    spans = {(a, b) for _, a, b in _spans(lines)} | {(a, b + 1) for a, b in zip(full, full[1:], strict=False)}
    spans |= {(i, i + 1) for i in full if is_long(lines[i])}
    return [(a, b, _joined(lines[a:b])) for a, b in sorted(spans)]


def gone_lines(lines: list[bytes], marks: dict[tuple[int, bytes], int | None]) -> list[bool]:
    """Per line whether it goes. marks holds the repeated pieces by first line and hash, with the first line of their
    first occurrence if that is in the same text: one that shares a line with it (equal lines in a row) isn't a repeat.
    """
    out = [False] * len(lines)
    end: dict[tuple[int, bytes], int] = {}
    for a, b, part in pieces(lines):
        h = _digest(part)
        end[a, h] = b
        if (a, h) in marks and end.get((marks[a, h], h), 0) <= a:
            out[a:b] = [True] * (b - a)
    return out


def _digest(part: bytes) -> bytes:
    return xxhash.xxh3_128_digest(part)


def dedup_lines(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: key, n_lines, n_removed_lines, n_removed_chunks, kept_text, kept_sha256.

    Of passages of two lines or more that aren't blank, and of lines of more than 50 words or 500 bytes, that occur
    more than once anywhere, the first (smallest key, then first in its text) stays and all others go, if their bytes
    are equal to the first one's. Other lone lines stay, and so do blank lines at the ends of a passage unless a chunk
    holds them. Where passages overlap, the first occurrence of every line stays. n_removed_chunks counts runs of
    removed lines.

    Null texts count as empty: no lines, kept_text ''. Rows with a null key are neither changed nor compared. Rows that
    share a key are one document: pieces at the same line aren't repeats of each other. Other columns are ignored
    whatever their names; an empty table gives an empty one. Line ends are LF; others are part of their line.

    Pieces (chunks, pairs of lines, long lines) first meet as 16-byte hashes (partially aggregated); only the texts of
    documents that hold a repeated piece are cut again, and only the repeated pieces move, for the comparison of bytes.
    A hot piece is a join with one row on one side, whose other side adaptive execution splits.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    kind = docs.select(key).schema[0].dataType.simpleString()
    own = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))

    def hashed(batches):
        for batch in batches:
            found = [[{"n": n, "h": _digest(p)} for n, _, p in pieces(split_lines(t))] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.struct([("n", pa.int32()), ("h", pa.binary())])))], ["k", "pieces"])

    some = F.contains("t", F.lit("\n")) | (F.length("t") > 2 * LONG_WORDS)
    rows = own.where(F.col("k").isNotNull() & some).mapInArrow(hashed, f"k {kind}, pieces array<struct<n:int,h:binary>>")
    rows = written(rows.select("k", F.explode("pieces").alias("c")).select("k", "c.n", "c.h"), "pieces")
    firsts = rows.groupBy("h").agg(F.min(F.struct("k", "n")).alias("first"), F.count("*").alias("times")).where("times > 1").select("h", "first")
    places = rows.join(firsts, "h").select("k", "n", "h", (F.struct("k", "n") == F.col("first")).alias("is_first"))
    wanted = places.groupBy("k").agg(F.collect_set(F.struct("n", "h", "is_first")).alias("wanted"))

    def cut_again(batches):
        for batch in batches:
            out = {c: [] for c in ("k", "n", "h", "is_first", "part")}
            for k, t, marks in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                own = {(n, _digest(p)): p for n, _, p in pieces(split_lines(t))}
                for m in marks:
                    if (m["n"], m["h"]) in own:
                        for c in ("n", "h", "is_first"):
                            out[c].append(m[c])
                        out["k"].append(k)
                        out["part"].append(own[m["n"], m["h"]])
            types = [batch.schema.field(0).type, pa.int32(), pa.binary(), pa.bool_(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(v, x) for v, x in zip(out.values(), types, strict=True)], list(out))

    texts = own.join(wanted, "k").select("k", "t", "wanted").mapInArrow(cut_again, f"k {kind}, n int, h binary, is_first boolean, part binary")
    texts = written(texts, "repeated-pieces")
    model = texts.where("is_first").groupBy("h").agg(F.min("part").alias("first_part"), F.min(F.struct("k", "n")).alias("first"))
    same = texts.where("not is_first").join(model, "h").where("part = first_part")
    same = same.select("k", "n", "h", F.when(F.col("first.k") == F.col("k"), F.col("first.n")).alias("first_n"))
    same = same.groupBy("k").agg(F.collect_set(F.struct("n", "h", "first_n")).alias("gone"))

    def cleaned(batches):
        for batch in batches:
            cols = {c: [] for c in ("n_lines", "n_removed_lines", "n_removed_chunks", "kept_text", "kept_sha256")}
            for t, gone in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                lines = split_lines(t)
                left, lost = lines, 0
                if gone:
                    flags = gone_lines(lines, {(g["n"], g["h"]): g["first_n"] for g in gone})
                    left = [x for x, f in zip(lines, flags, strict=True) if not f]
                    lost = sum(f and not before for f, before in zip(flags, [False, *flags], strict=False))
                rest = b"".join(left)
                for c, v in zip(cols, (len(lines), len(lines) - len(left), lost, rest.decode("utf-8", "surrogatepass"), hashlib.sha256(rest).hexdigest()), strict=True):
                    cols[c].append(v)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, x) for v, x in zip(cols.values(), types, strict=True))], ["k", *cols])

    out = own.join(same, "k", "left").select("k", "t", "gone").mapInArrow(cleaned, f"k {kind}, n_lines long, n_removed_lines long, n_removed_chunks long, kept_text string, kept_sha256 string")
    dropped(rows)
    return out.withColumnRenamed("k", key)
