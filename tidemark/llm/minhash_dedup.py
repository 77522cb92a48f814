"""Operator 9: near-duplicate documents by order MinHash, verified by banded alignment."""

from __future__ import annotations

import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bound_batches, dropped, written
from tidemark.llm.components import components

#: Words in a shingle, similarity of a link.
SHINGLE, SIMILARITY = 5, 0.8
#: Sketches of a document, and shingles in each. A pair of similarity 0.8 shares one of them but for about 1 in 90,000.
SKETCHES, SAMPLED = 16, 3
#: Texts, and shingles of all of them, that are compared in one block; larger buckets are compared block by block.
BLOCK, BLOCK_SHINGLES = 512, 1 << 18
#: A text is cut into words in parts of about so many characters.
PART = 1 << 20
_WORD, _BREAK = re.compile(r"[^\W_]+"), re.compile(r"[\W_]")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str) -> np.ndarray:
    """Hashes of the words, runs of letters and digits in lower case, part by part of the text."""
    out, start = [np.zeros(0, np.uint64)], 0
    while start < len(text):
        end = _BREAK.search(text, start + PART) if start + PART < len(text) else None
        end = end.start() if end else len(text)
        words = _WORD.findall(text[start:end].lower())
        out.append(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)))
        start = end
    return np.concatenate(out)


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Hashes of the word shingles of a text in text order, each labelled with how often it occurred before.

    Words are runs of letters and digits, lower case. A text of fewer than `size` words is one shingle; without words
    there is none. No two of the hashes are equal but by chance.
    """
    own = word_hashes(text or "")
    if not len(own):
        return own
    n = max(1, len(own) - size + 1)
    out = np.zeros(n, np.uint64)
    for i in range(min(size, len(own))):
        out = _mixed(out * _MIX + own[i : i + n])
    order = np.argsort(out, kind="stable")
    same = np.append(False, out[order][1:] == out[order][:-1])
    if same.any():
        at = np.arange(n)
        nth = np.empty(n, np.uint64)
        nth[order] = at - np.maximum.accumulate(np.where(same, 0, at))
        out = np.where(nth > 0, _mixed(out + nth * _MIX), out)
    return out


def sketches(hashes: np.ndarray, count: int = SKETCHES, sampled: int = SAMPLED) -> list[int]:
    """Order MinHash: per sketch the `sampled` labelled shingles of smallest hash, in text order, as one number."""
    out = []
    for i in range(count):
        h = _mixed(hashes ^ np.uint64((i + 1) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF))
        at = np.sort(np.argpartition(h, sampled - 1)[:sampled]) if len(h) > sampled else np.arange(len(h))
        x = np.uint64(i)
        with np.errstate(over="ignore"):
            for k in hashes[at]:
                x = x * _MIX ^ k
                x ^= x >> np.uint64(29)
        out.append(int(np.int64(x.astype(np.int64))))
    return out


def aligned(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """Share of the shingles of both texts that an alignment in text order matches, matched / (len(a) + len(b) - matched).

    Labelled shingles are unique within a text, so the best alignment is the longest increasing run of positions. Only
    positions in a band around the diagonal count: for a similarity of `least` no more than (1 - least) / (1 + least) of
    the shingles are unmatched, which is as far as a matched pair can be off the diagonal. At or above `least` the
    result is exact.
    """
    if not len(a) or not len(b):
        return 0.0
    band = int((len(a) + len(b)) * (1 - least) / (1 + least)) + 1
    order = np.argsort(b)
    at = np.searchsorted(b[order], a)
    at[at == len(b)] = 0
    j = order[at]
    i = np.flatnonzero(b[j] == a)
    j = j[i]
    j = j[np.abs(i - j) <= band]
    if len(j) and (j[1:] > j[:-1]).all():
        n = len(j)
    else:
        tails: list[int] = []
        for x in j.tolist():
            k = bisect_left(tails, x)
            tails[k : k + 1] = [x]
        n = len(tails)
    return n / (len(a) + len(b) - n)


def shared_counts(rows: list[np.ndarray], columns: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """How many labelled shingles each row's text shares with each column's, by products of incidence matrices."""
    sets = rows + columns
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, ids, counts = np.unique(flat, return_inverse=True, return_counts=True)
    keep = counts[ids] > 1
    column = np.cumsum(counts > 1) - 1
    ids, owner = column[ids[keep]], owner[keep]
    out = np.zeros((len(rows), len(columns)), np.float32)
    order = np.argsort(ids, kind="stable")
    ids, owner = ids[order], owner[order]
    for first in range(0, int((counts > 1).sum()), width):
        part = slice(*np.searchsorted(ids, [first, first + width]))
        m = np.zeros((len(sets), width), np.float32)
        m[owner[part], ids[part] - first] = 1
        out += m[: len(rows)] @ m[len(rows) :].T
    return out


def links_in_block(ids: list, texts: list[np.ndarray], split: int | None = None, least: float = SIMILARITY) -> list[tuple]:
    """Verified links that join what can be joined among texts, or between texts[:split] and texts[split:].

    All pairs of the block are judged by what they share, which bounds the alignment from above; of those that pass,
    the most similar are aligned first, and pairs that earlier links have joined already are left out.
    """
    a, b = (texts, texts) if split is None else (texts[:split], texts[split:])
    shared = shared_counts(a, b)
    n = np.array([len(t) for t in texts], np.float32)
    na, nb = (n, n) if split is None else (n[:split], n[split:])
    bound = shared / np.maximum(na[:, None] + nb[None, :] - shared, 1)
    if split is None:
        bound = np.triu(bound, 1)
    i, j = np.nonzero(bound >= least - 1e-6)
    order = np.argsort(-bound[i, j], kind="stable")
    j = j + (split or 0)
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    out = []
    for x, y in zip(i[order].tolist(), j[order].tolist(), strict=True):
        if find(x) != find(y) and aligned(texts[x], texts[y], least) >= least:
            root[find(x)] = find(y)
            out.append((ids[x], ids[y]))
    return out


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """Per row of docs: key, class_id (smallest key of its class), kept (key = class_id).

    Two texts are linked if an alignment in order matches at least `least` of their 5-word shingles, and a class is
    what links connect. Candidates share one of 16 order MinHash sketches. Exact copies are one class by a 128-bit
    hash of the whole text before anything is compared, whatever their number.

    Texts without words (null and empty ones too) link with nothing: each is its own class, unless they are exact
    copies of each other; nulls and empty texts aren't copies. Rows with a null key are their own class with a null
    class_id and are kept. Rows that share a key are one document if their texts agree, and else one class. Other
    columns are ignored whatever their names; an empty table gives an empty one.

    Two scans of the texts: one for the sketches, one for the texts of those buckets that have two members or more.
    Buckets with equal members are compared once, large ones in many tasks, in blocks that are bounded by their texts
    and by their shingles; a longer text is a block of its own. Copies take no part in comparisons or components.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    kind = docs.select(key).schema[0].dataType.simpleString()

    def sketch(batches):
        for batch in batches:
            own, n = [], []
            for t in batch.column(2):
                h = shingles(t.as_py())
                own.append(sketches(h) if len(h) else [])
                n.append(len(h))
            columns = [batch.column(0), batch.column(1), pa.array(own, pa.list_(pa.int64())), pa.array(n, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["k", "whole", "sketches", "n"])

    whole = F.substring(F.unhex(F.sha2(F.col(text).cast("binary"), 256)), 1, 16)
    own = docs.where(F.col(key).isNotNull() & (F.length(text) > 0)).select(F.col(key).alias("k"), whole.alias("whole"), F.col(text).alias("t"))
    sketched = written(own.mapInArrow(sketch, f"k {kind}, whole binary, sketches array<bigint>, n long"), "sketches")
    # one document for each distinct text, also those without words, which have no sketches: the row of smallest key
    firsts = written(sketched.groupBy("whole").agg(F.min(F.struct("k", "sketches", "n")).alias("f")).select("whole", "f.*"), "firsts")
    named = written(sketched.select("k", "whole").join(firsts.select("whole", F.col("k").alias("first")), "whole").select("k", "first").distinct(), "named")
    dropped(sketched)

    # texts, not keys, are the members of buckets: a key may have several texts
    entries = firsts.select("k", "whole", "n", F.posexplode("sketches").alias("band", "sketch"))
    member = F.xxhash64("whole").cast("decimal(20,0)")
    buckets = entries.groupBy("band", "sketch").agg(F.count("*").alias("size"), F.min("whole").alias("low"), F.max("whole").alias("high"), F.sum(member).alias("set"), F.sum("n").alias("shingles"))
    buckets = buckets.where("size > 1")
    # buckets with the same members (as equal size, ends and sum of hashes say) are compared once; the size of a set is at most what it was
    once = buckets.groupBy("size", "low", "high", "set").agg(F.min(F.struct("band", "sketch", "shingles")).alias("b")).select("b.*", "size")
    placed = written(entries.join(once, ["band", "sketch"]), "placed")
    blocks = F.ceil(F.greatest(F.col("size") / BLOCK, F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    mine = F.pmod(F.xxhash64("whole", F.lit(7)), blocks).cast("int")
    rows = placed.select("k", "whole", "band", "sketch", blocks.alias("blocks"), mine.alias("mine"))
    rows = rows.select("k", "whole", "band", "sketch", "mine", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    rows = rows.select("k", "whole", F.xxhash64("band", "sketch", F.least("mine", "other"), F.greatest("mine", "other")).alias("block"), (F.col("mine") > F.col("other")).alias("second"), (F.col("mine") == F.col("other")).alias("inner"))

    # always by sorted shuffles: whether one side is small enough to broadcast must not depend on the input's size
    # a text enters its blocks once, with the smallest of its keys
    lists = rows.groupBy("k", "whole").agg(F.collect_list(F.struct("block", "second", "inner")).alias("at"))
    texts = lists.hint("merge").join(own, ["k", "whole"]).dropDuplicates(["k", "whole"])
    wanted = texts.select(F.explode("at").alias("e"), "k", "whole", "t").select("e.block", "e.second", "e.inner", "k", "whole", "t")

    def compare(block: pa.Table) -> pa.Table:
        block = block.select(["second", "inner", "k", "whole", "t"]).sort_by([(c, "ascending") for c in ("second", "k", "whole")])
        both = None if block.column("inner")[0].as_py() else block.column("second").to_pylist().count(False)
        found = links_in_block(block.column("k").to_pylist(), [shingles(t.as_py()) for t in block.column("t")], both, least)
        ends = block.schema.field("k").type
        return pa.table({"a": pa.array([a for a, _ in found], ends), "b": pa.array([b for _, b in found], ends)})

    links = wanted.groupBy("block").applyInArrow(compare, f"a {kind}, b {kind}")
    # texts of one key are one class; a key with one text gives no link
    several = named.groupBy("k").agg(F.min("first").alias("a"), F.max("first").alias("z")).where("a != z").select("k", "a")
    same_key = named.join(several, "k").where("first != a").select("a", F.col("first").alias("b"))
    found = components(written(links.union(same_key), "near-links"))
    dropped(placed, firsts)
    class_id = F.coalesce("component", "first")
    classes = named.join(found, F.col("first") == F.col("node"), "left").select("k", class_id.alias("class")).where("class != k").distinct()
    out = docs.select(F.col(key).alias("k")).join(classes, "k", "left")
    class_id = F.coalesce("class", "k")
    return out.select(F.col("k").alias(key), class_id.alias("class_id"), (F.coalesce(class_id == F.col("k"), F.lit(True))).alias("kept"))
