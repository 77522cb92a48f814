"""Operator 8: near-duplicate vectors by iterative quantisation, multi-index Hamming tables and exact reranking."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bound_batches, dropped, written
from tidemark.llm.components import components

SIMILARITY = 0.98
#: Bits of a code, the parts it is cut into, and how many parts must agree: one table for each choice of so many parts.
BITS, PARTS, AGREE = 64, 8, 2
#: The rotation is learned from so many vectors at most (those of smallest key hash) in so many rounds.
TRAIN_ROWS, ROUNDS = 20_000, 40
#: Vectors of a bucket that are compared in one block.
BLOCK = 256
#: Blocks of so many vectors or fewer are compared together; rows that are worked on at a time.
SMALL, WORK_ROWS = 12, 20_000


def tables(parts: int = PARTS, agree: int = AGREE) -> list[tuple[int, ...]]:
    return list(combinations(range(parts), agree))


class Rotation:
    """Codes by iterative quantisation: principal axes, turned so that the signs lose as little as possible."""

    def __init__(self, x: np.ndarray, bits: int = BITS, rounds: int = ROUNDS):
        dim = x.shape[1]
        self.mean = x.mean(0) if len(x) else np.zeros(dim)
        centred = x - self.mean
        bits = min(bits, dim)
        rng = np.random.default_rng(20)
        if len(x) > bits:
            axes = np.linalg.eigh(centred.T @ centred)[1][:, ::-1][:, :bits]
        else:
            axes = np.linalg.qr(rng.standard_normal((dim, dim)))[0][:, :bits]
        turn = np.linalg.qr(rng.standard_normal((bits, bits)))[0]
        flat = centred @ axes
        if len(x) > bits:
            for _ in range(rounds):
                u, _, v = np.linalg.svd(np.where(flat @ turn >= 0, 1.0, -1.0).T @ flat)
                turn = v.T @ u.T
        self.map = axes @ turn

    def codes(self, x: np.ndarray) -> np.ndarray:
        """A row of bits for each unit vector."""
        return (x - self.mean) @ self.map >= 0

    def parts(self, x: np.ndarray) -> np.ndarray:
        """The code's parts, as PARTS small integers a row."""
        bits = self.codes(x)
        cuts = np.linspace(0, bits.shape[1], PARTS + 1).astype(int)
        return np.stack([bits[:, a:b] @ (1 << np.arange(b - a)) if b > a else np.zeros(len(x), int) for a, b in zip(cuts, cuts[1:], strict=False)], 1)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _usable(c: Column) -> Column:
    bad = F.exists(c, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return c.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(c, lambda v: v != 0)


def _first_tables() -> np.ndarray:
    """By which parts agree (a bit for each), the first table in which a pair meets; -1 if in none."""
    out = np.full(1 << PARTS, -1)
    for agree in range(1 << PARTS):
        out[agree] = next((t for t, chosen in enumerate(tables()) if all(agree >> p & 1 for p in chosen)), -1)
    return out


FIRST_TABLE = _first_tables()
_BITS = (1 << np.arange(PARTS)).astype(np.int64)


def _meets(parts: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return FIRST_TABLE[(parts[i] == parts[j]) @ _BITS]


def spanning(n: int, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """Links that join what the links i-j join, one less than the members of each joined set."""
    near = np.zeros((n, n), bool)
    near[i, j] = near[j, i] = True
    left, out = np.ones(n, bool), []
    for start in np.unique(i).tolist():
        if left[start]:
            left[start] = False
            todo = [start]
            while todo:
                u = todo.pop()
                new = np.flatnonzero(near[u] & left)
                left[new] = False
                out += [(u, v) for v in new.tolist()]
                todo += new.tolist()
    return out


def links_in_blocks(block: np.ndarray, second: np.ndarray, inner: np.ndarray, table: np.ndarray, weights: np.ndarray, x: np.ndarray, parts: np.ndarray, least: float = SIMILARITY, label: np.ndarray | None = None) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """(links of every row, spanning links as row numbers) of pairs of cosine >= least within blocks.

    Rows lie block by block, in a block that compares two sets the first set before the second. A pair that agrees in
    several tables counts in the first of them only, so that the sums over all tables count it once. Small blocks are
    compared all together, one distance between rows after the other; large ones by a matrix product each. Rows of
    different labels, which only a collision of hashes brings into one block, aren't linked.
    """
    label = np.zeros(len(block), np.int64) if label is None else label
    links, span = np.zeros(len(block), np.int64), []
    first = np.flatnonzero(np.append(True, block[1:] != block[:-1])) if len(block) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(block)))
    small = np.repeat(size <= SMALL, size)

    def count(i: np.ndarray, j: np.ndarray) -> None:
        own = _meets(parts, i, j) == table[i]
        np.add.at(links, i[own], weights[j[own]])
        np.add.at(links, j[own], weights[i[own]])

    for step in range(1, SMALL):
        i = np.flatnonzero(small[:-step] & (block[:-step] == block[step:])) if len(block) > step else np.zeros(0, np.int64)
        i = i[(inner[i] | (second[i] != second[i + step])) & (label[i] == label[i + step])]
        if len(i):
            i = i[np.einsum("ij,ij->i", x[i], x[i + step]) >= least]
            count(i, i + step)
            span += zip(i.tolist(), (i + step).tolist(), strict=True)
    for a, n in zip(first[size > SMALL].tolist(), size[size > SMALL].tolist(), strict=True):
        cut = n if inner[a] else int((~second[a : a + n]).sum())
        rows, columns = (x[a : a + n], x[a : a + n]) if inner[a] else (x[a : a + cut], x[a + cut : a + n])
        close = rows @ columns.T >= least
        if (label[a : a + n] != label[a]).any():
            of_rows, of_columns = (label[a : a + n],) * 2 if inner[a] else (label[a : a + cut], label[a + cut : a + n])
            close &= of_rows[:, None] == of_columns
        i, j = np.nonzero(np.triu(close, 1) if inner[a] else close)
        j = j if inner[a] else j + cut
        count(i + a, j + a)
        span += [(u + a, v + a) for u, v in spanning(n, i, j)]
    return links, span


def near_vectors(df: DataFrame, *, key: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = SIMILARITY) -> DataFrame:
    """Per row of df: key, n_links, component_id, kept (key = component_id).

    Rows are linked if their labels are equal and not null and the cosine of their vectors, in double precision, is at
    least `least`. Candidates agree in 2 of the 8 parts of their 64-bit codes (28 tables of 16 bits); those are all
    pairs whose codes differ in up to 6 bits and nearly all that differ in a few more. Every candidate is judged by its
    original vectors. Equal vectors of one label are one row with a weight before they enter the tables.

    Vectors that are null, empty, zero or hold null or non-finite values link with nothing (0 links, their own
    component), as do rows with a null label or key; vectors of different lengths aren't compared. Rows are counted one
    by one, also those that repeat a key. Other columns are ignored whatever their names; an empty table gives an
    empty one.

    Codes of single members leave before vectors are moved; buckets with equal members are compared once; a bucket of
    more than 256 vectors is compared in blocks by many tasks, which give sums of links and spanning links, not pairs.
    """
    spark = df.sparkSession
    bound_batches(spark)
    rows = df.where(F.col(key).isNotNull() & F.col(label).isNotNull() & _usable(F.col(vector)))
    rows = rows.select(F.col(key).alias("k"), F.xxhash64(label, F.size(vector)).alias("g"), F.col(label).cast("string").alias("l"), F.col(vector).cast("array<double>").alias("x"))
    # two independent 64-bit hashes stand for a vector of a label
    rows = rows.withColumn("h1", F.xxhash64("g", "x")).withColumn("h2", F.xxhash64(F.lit(5), "x", "g"))
    single = written(rows.groupBy("h1", "h2").agg(F.min("k").alias("k"), F.count("*").alias("n"), F.first("g").alias("g"), F.first("l").alias("l"), F.first("x").alias("x")), "vectors")

    sample = [r.x for r in single.select("x", F.xxhash64(F.lit(9), "k").alias("h")).orderBy("h", "x").limit(TRAIN_ROWS).select("x").toLocalIterator()]
    by_size: dict[int, list] = {}
    for x in sample:
        by_size.setdefault(len(x), []).append(x)
    turns = {n: Rotation(unit(np.array(x))) for n, x in by_size.items()}
    shared = spark.sparkContext.broadcast(turns)

    def coded(batches):
        turns = shared.value
        for batch in batches:
            x = batch.column(0).to_pylist()
            out = np.zeros((len(x), PARTS), np.int64)
            sizes = np.array([len(v) for v in x])
            for n in np.unique(sizes):
                at = np.flatnonzero(sizes == n)
                turn = turns.get(int(n)) or turns.setdefault(int(n), Rotation(np.zeros((0, int(n)))))
                out[at] = turn.parts(unit(np.array([x[i] for i in at])))
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), batch.column(3), batch.column(4), batch.column(0), pa.array(out.tolist(), pa.list_(pa.int32()))], ["v", "g", "n", "l", "x", "parts"])

    # from here on a vector goes by its hashes: a key may have several vectors
    both = F.struct("h1", "h2")
    codes = single.select("x", both.alias("v"), "g", "n", "l").mapInArrow(coded, "v struct<h1:long,h2:long>, g long, n long, l string, x array<double>, parts array<int>")
    codes = written(codes, "codes")
    each = F.array(*[F.struct(F.lit(t).alias("t"), F.xxhash64("g", F.lit(t), *[F.col("parts")[p] for p in chosen]).alias("bucket")) for t, chosen in enumerate(tables())])
    entries = codes.select("v", F.explode(each).alias("e")).select("v", "e.t", "e.bucket")
    member = F.xxhash64("v").cast("decimal(20,0)")
    buckets = entries.groupBy("t", "bucket").agg(F.count("*").alias("size"), F.min("v").alias("low"), F.max("v").alias("high"), F.sum(member).alias("set")).where("size > 1")
    # of buckets with the same members the first table's stays: it is the first in which any of their pairs agree
    once = buckets.groupBy("size", "low", "high", "set").agg(F.min(F.struct("t", "bucket")).alias("b")).select("b.t", "b.bucket", "size")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    placed = entries.join(once, ["t", "bucket"]).select("v", "t", "bucket", blocks.alias("blocks"), F.pmod(F.xxhash64("v", F.lit(7)), blocks).cast("int").alias("mine"))
    spread = placed.select("v", "t", "bucket", "mine", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    spread = spread.select("v", "t", F.xxhash64("t", "bucket", F.least("mine", "other"), F.greatest("mine", "other")).alias("block"), (F.col("mine") > F.col("other")).alias("second"), (F.col("mine") == F.col("other")).alias("inner"))
    wanted = spread.join(codes, "v").select("block", "t", "second", "inner", "v", "n", "l", "x", "parts")

    def compare(batches):
        held: list[pa.RecordBatch] = []

        def judged(rows: pa.Table):
            block, second, inner, table, n = (rows.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("block", "second", "inner", "t", "n"))
            parts = np.array(rows.column("parts").combine_chunks().flatten()).reshape(-1, PARTS)
            lists = rows.column("x").combine_chunks()
            sizes = np.diff(np.asarray(lists.offsets))
            flat, ends = np.array(lists.flatten()), np.cumsum(sizes)
            keys = rows.column("v").combine_chunks()
            labels = rows.column("l").combine_chunks().dictionary_encode().indices.to_numpy()
            for dim in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == dim)
                x = unit(flat[(ends[at] - dim)[:, None] + np.arange(dim)])
                links, span = links_in_blocks(block[at], second[at], inner[at], table[at], n[at], x, parts[at], least, labels[at])
                some = np.flatnonzero(links)
                i, j = (np.array([p[c] for p in span], np.int64) for c in (0, 1))
                a = pa.concat_arrays([keys.take(pa.array(at[some])), keys.take(pa.array(at[i]))])
                b = pa.concat_arrays([pa.nulls(len(some), keys.type), keys.take(pa.array(at[j]))])
                yield pa.RecordBatch.from_arrays([a, b, pa.array(np.concatenate([links[some], np.zeros(len(i), np.int64)]))], ["a", "b", "n"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows = pa.Table.from_batches(held)
            if rows.num_rows >= WORK_ROWS:  # all but the last block, which may go on in the next batch
                block = rows.column("block").combine_chunks().to_numpy()
                cut = int(np.flatnonzero(block != block[-1])[-1]) + 1 if (block != block[-1]).any() else 0
                if cut:
                    yield from judged(rows.slice(0, cut))
                    held = rows.slice(cut).to_batches()
        if held:
            yield from judged(pa.Table.from_batches(held))

    ordered = wanted.repartition("block").sortWithinPartitions("block", "second", "v")
    found = written(ordered.mapInArrow(compare, "a struct<h1:long,h2:long>, b struct<h1:long,h2:long>, n long"), "vector-links")
    counts = found.where("b is null").groupBy("a").agg(F.sum("n").alias("links"))
    names = single.select(both.alias("v"), "k")
    ends = found.where("b is not null").join(names.select(F.col("v").alias("a"), F.col("k").alias("ka")), "a").join(names.select(F.col("v").alias("b"), F.col("k").alias("kb")), "b")
    comps = components(ends.select(F.col("ka").alias("a"), F.col("kb").alias("b")))
    judged = single.select("h1", "h2", "k", "n").join(counts, both == F.col("a"), "left").join(comps, F.col("k") == F.col("node"), "left")
    judged = judged.select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "k").alias("component_id"))
    dropped(codes)
    ok = F.col(label).isNotNull() & F.col(key).isNotNull() & _usable(F.col(vector))
    g, x = F.xxhash64(label, F.size(vector)), F.col(vector).cast("array<double>")
    mine = df.select(F.col(key).alias("k"), F.when(ok, F.xxhash64(g, x)).alias("h1"), F.when(ok, F.xxhash64(F.lit(5), x, g)).alias("h2"))
    out = mine.join(judged, ["h1", "h2"], "left")
    component = F.coalesce("component_id", "k")
    return out.select(F.col("k").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("k"), F.lit(True)).alias("kept"))
