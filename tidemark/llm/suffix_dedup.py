"""Operator 7: removal of repeated 50-byte strings with suffix arrays over shards of what can repeat."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import bound_batches, dropped, written
from tidemark.llm.suffixes import permuted_matches, suffix_array, words_at

#: Bytes of a repeated string, and of the pieces of it whose smallest hash says where it is compared.
LENGTH, PIECE = 50, 16
#: Bytes of distinct parts that share one suffix array; strings that start in one part.
SHARD_BYTES, LONGEST = 1 << 20, 4096
#: A text is worked on in parts of so many bytes; parts that are cut out leave when they have so many bytes together.
WORK_BYTES = 1 << 20
#: Strings of a hot anchor leave when they have so many bytes together.
STRING_BYTES = 4 << 20


def anchors(data: bytes, length: int = LENGTH, piece: int = PIECE) -> np.ndarray:
    """For every place where a string of `length` bytes starts, the smallest hash among its pieces.

    Equal strings have equal anchors, wherever they stand; neighbouring places mostly share one.
    """
    t = np.frombuffer(data, np.uint8)
    if len(t) < length:
        return np.zeros(0, np.int64)
    w = words_at(t)
    n = len(t) - piece + 1
    h = np.zeros(n, np.uint64)
    for at in range(0, piece, 8):
        h = (h ^ w[at : at + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    wide, have = length - piece + 1, 1
    while have < wide:
        step = min(have, wide - have)
        h = np.minimum(h[:-step], h[step:])
        have += step
    return h.view(np.int64)


def worked(t: bytes, length: int = LENGTH):
    """(place, bytes) of the parts that a text is worked on in; every string of `length` bytes starts in one of them."""
    for at in range(0, max(1, len(t) - length + 1), WORK_BYTES):
        yield at, t[at : at + WORK_BYTES + length - 1]


def _row_hash(t: bytes) -> int:
    """Names a text among those of its key; 0 names the only one."""
    return xxhash.xxh3_64_intdigest(t) - (1 << 63) or 1


def runs(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places and ends of the runs of equal values."""
    if not len(a):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.flatnonzero(a[1:] != a[:-1]) + 1
    return np.append(0, cut), np.append(cut, len(a))


def least_owners(t: np.ndarray, lens: np.ndarray, owner: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For every place of the texts end to end in t, the smallest owner of a text that holds the string of `length`
    bytes which starts there; a place where no such string starts has its own text's owner."""
    ends = np.cumsum(lens)
    source = np.repeat(np.arange(len(lens)), lens)
    least = owner[source]
    order = suffix_array(t, length)
    order = order[order + length <= ends[source[order]]]  # strings across two texts don't count
    if len(order):
        first = ~permuted_matches(t, order, length)
        by_group = np.minimum.reduceat(least[order], np.flatnonzero(first))
        least[order] = by_group[np.cumsum(first) - 1]
    return least


def place_hashes(t: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """A 64-bit hash of the string of `length` bytes, eight at least, from every place on where one starts."""
    if len(t) < length:
        return np.zeros(0, np.uint64)
    mixed = lambda h: (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h, have = mixed(words_at(t)[: len(t) - 7] * np.uint64(0x9E3779B97F4A7C15)), 8
    while have < length:  # a string is two shorter ones, which may overlap
        step = min(have, length - have)
        h = mixed(h[:-step] * np.uint64(0xBF58476D1CE4E5B9) + (h[step:] ^ (h[step:] >> np.uint64(29))))
        have += step
    return h


def shared_parts(t: np.ndarray, lens: np.ndarray, owner: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which of the texts end to end in t hold a string of `length` bytes with the hash of one of another owner's."""
    source = np.repeat(np.arange(len(lens)), np.maximum(lens - length + 1, 0))
    n = np.maximum(lens - length + 1, 0)
    places = np.arange(len(source)) + np.repeat(np.cumsum(lens) - lens - (np.cumsum(n) - n), n)
    h = place_hashes(t, length)[places] if len(places) else np.zeros(0, np.uint64)
    inorder = np.sort(h)
    again = inorder[1:][inorder[1:] == inorder[:-1]]
    some = np.zeros(len(lens), bool)
    if len(again):
        at = np.flatnonzero(again[np.minimum(np.searchsorted(again, h), len(again) - 1)] == h)
        at = at[np.argsort(h[at], kind="stable")]
        first, end = runs(h[at])
        of = owner[source[at]]
        differ = np.minimum.reduceat(of, first) != np.maximum.reduceat(of, first)
        some[source[at][np.repeat(differ, end - first)]] = True
    return np.flatnonzero(some)


class Parts:
    """Rows (anchor, k, r, at, part) in the order of (anchor, k), and their distinct parts."""

    NAMES = ("anchor", "k", "r", "at", "part")

    def __init__(self, rows: pa.Table):
        self.rows = rows.select(self.NAMES)
        self.anchor, self.k, self.r, self.at = (rows.column(c).combine_chunks().to_numpy() for c in self.NAMES[:4])
        coded = rows.column("part").combine_chunks().dictionary_encode()
        self.code, self.parts = coded.indices.to_numpy(), coded.dictionary
        offsets = np.frombuffer(self.parts.buffers()[1], np.int32, len(self.parts) + 1, self.parts.offset * 4)
        self.lens = np.diff(offsets).astype(np.int64)
        self.bytes = np.frombuffer(self.parts.buffers()[2], np.uint8, int(offsets[-1] - offsets[0]), int(offsets[0]))
        # the first row of a part has its smallest key: rows of one part have one anchor and lie in the order of keys
        first = np.full(len(self.parts), len(self.code))
        np.minimum.at(first, self.code, np.arange(len(self.code)))
        self.owner = self.k[first] if len(first) else np.zeros(0, np.int64)

    def later(self) -> np.ndarray:
        """Whether a row has a greater key than its part's first row: then all strings of the part go there."""
        return self.k > self.owner[self.code]

    def whole(self, rows: np.ndarray) -> pa.RecordBatch:
        return _ranges(self.k[rows], self.r[rows], self.at[rows], self.at[rows] + self.lens[self.code[rows]])

    def _bytes_of(self, some: np.ndarray) -> np.ndarray:
        """The bytes of some distinct parts, end to end."""
        lens = self.lens[some]
        base = np.cumsum(lens) - lens
        return self.bytes[np.repeat((np.cumsum(self.lens) - self.lens)[some] - base, lens) + np.arange(int(lens.sum()))]

    def judged(self, length: int) -> pa.RecordBatch:
        """Ranges of the parts' first owners that strings of other parts, with smaller owners, make go."""
        # strings of a part that is alone under its anchor stand in no other part
        anchor = np.zeros(len(self.parts), np.int64)
        anchor[self.code] = self.anchor
        _, same, times = np.unique(anchor, return_inverse=True, return_counts=True)
        some = np.flatnonzero(times[same] > 1)
        # nor do those of a part none of whose strings has the hash of another owner's
        some = some[shared_parts(self._bytes_of(some), self.lens[some], self.owner[some], length)]
        if not len(some):
            return _ranges(*[np.zeros(0, np.int64)] * 4)
        lens, owner = self.lens[some], self.owner[some]
        base = np.cumsum(lens) - lens
        places = np.flatnonzero(least_owners(self._bytes_of(some), lens, owner, length) < np.repeat(owner, lens))
        source = np.searchsorted(base, places, "right") - 1
        # runs of places within a part; a range may touch the next one of its part
        cut = np.flatnonzero((source[1:] != source[:-1]) | (places[1:] > places[:-1] + length)) + 1 if len(places) else np.zeros(0, np.int64)
        first, last = (np.append(0, cut), np.append(cut - 1, len(places) - 1)) if len(places) else (cut, cut)
        of, a, b = some[source[first]], places[first] - base[source[first]], places[last] + length - base[source[first]]
        # every row of such a part: of its first owner alone, as later owners lose the whole part anyway
        own = np.flatnonzero(~self.later() & np.isin(self.code, of))
        own = own[np.argsort(self.code[own], kind="stable")]
        lo, hi = (np.searchsorted(of, self.code[own], side) for side in ("left", "right"))
        n = hi - lo
        row = np.repeat(own, n)
        at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return _ranges(self.k[row], self.r[row], self.at[row] + a[at], self.at[row] + b[at])

    def strings(self, length: int) -> Iterator[pa.RecordBatch]:
        """Every string of `length` bytes of every row, as a part of its own whose anchor is the string's hash, some at a time."""
        start = np.cumsum(self.lens) - self.lens
        most = max(1, STRING_BYTES // length)
        for i, code in enumerate(self.code.tolist()):
            part = self.bytes[start[code] : start[code] + self.lens[code]]
            for x in range(0, len(part) - length + 1, most):
                own = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(part[x : x + most - 1 + length], length))
                n = len(own)
                text = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * length, length, dtype=np.int32)), pa.py_buffer(own)])
                same = lambda v: pa.array(np.full(n, v, np.int64))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([same(self.k[i]), same(self.r[i]), pa.array(self.at[i] + x + np.arange(n)), pa.nulls(n, pa.int64()), pa.array(string_hashes(own)), text], _FOUND)


def string_hashes(rows: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of bytes."""
    wide = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    wide[:, : rows.shape[1]] = rows
    out = np.zeros(len(rows), np.uint64)
    with np.errstate(over="ignore"):
        for word in wide.view(np.uint64).T:
            x = (out ^ word) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            out = x ^ (x >> np.uint64(32))
    return out.view(np.int64)


_FOUND = ["k", "r", "a", "b", "anchor", "part"]


def _ranges(k: np.ndarray, r: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    n = len(k)
    return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (k, r, a, b)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], _FOUND)


def remove_repeats(docs: DataFrame, *, key: str = "doc_id", text: str = "text", length: int = LENGTH, keep_text: bool = False, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Per row of docs: key, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept_text (binary).

    A byte is removed if a string of `length` bytes that covers it also starts in a row with a smaller key. Strings are
    judged on the input. A null text is empty; null and short texts keep all they have. Rows with a null key are
    neither changed nor compared; rows that share a key don't make each other's text go. Keys are integers. Other
    columns are ignored whatever their names; an empty table gives an empty one.

    Whole copies hang on the row of smallest key. Every string's anchor, the smallest hash of its pieces, is the
    same wherever the string stands, so only strings whose anchor occurs twice are moved, a run of neighbouring strings
    of one anchor as one part. Parts meet by anchor. Of equal parts all but those of the smallest key go; the distinct
    parts of about a megabyte enter one suffix array, which compares their strings byte by byte. What comes back are
    ranges of a document.

    However often an anchor or a part occurs, a batch of texts gives one row of it to the shuffle; an anchor with more
    distinct parts than a shard holds is dealt out again string by string.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    all_rows = docs.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("t"))
    long_rows = all_rows.where(F.col("k").isNotNull() & (F.octet_length("t") >= length))
    # one row per text: its smallest key stands for all; a copy under a greater key goes whole
    whole = F.unhex(F.substring(F.sha2("t", 256), 1, 32))
    ids = written(long_rows.select("k", whole.alias("id")), "ids")
    first = ids.groupBy("id").agg(F.min("k").alias("first"))
    copies = ids.join(first, "id").where("k > first").groupBy("k").agg(F.collect_set("id").alias("copies"))

    def anchored(batches):
        for batch in batches:
            keys = batch.column(0).to_numpy()
            order = np.argsort(keys, kind="stable")
            of_text = [[a[runs(a)[0]] for a in (anchors(x, length) for _, x in worked(batch.column(1)[i].as_py(), length))] for i in order.tolist()]
            found = [np.unique(np.concatenate(a) if len(a) > 1 else a[0]) for a in of_text]
            k = np.repeat(keys[order], [len(x) for x in found])
            anchor = np.concatenate(found) if found else np.zeros(0, np.int64)
            # an anchor that the batch holds twice is shared: its first row says so for all others, which are told here
            by = np.argsort(anchor, kind="stable")
            same = np.append(False, anchor[by][1:] == anchor[by][:-1]) if len(by) else np.zeros(0, bool)
            again, sure = np.zeros(len(by), bool), np.zeros(len(by), bool)
            again[by] = same
            sure[by] = same | np.append(same[1:], False) if len(by) else same
            meet = np.where(again, (k * np.int64(-7046029254386353131)) ^ anchor, anchor)
            yield pa.RecordBatch.from_arrays([pa.array(meet), pa.array(k), pa.array(anchor, mask=~sure)], ["meet", "k", "told"])

    rows = long_rows.select("k", "t").mapInArrow(anchored, "meet long, k long, told long")
    shared = rows.withColumn("n", F.count("*").over(Window.partitionBy("meet"))).where("told is not null or n > 1")
    by_doc = shared.groupBy("k").agg(F.collect_set(F.coalesce("told", "meet")).alias("anchors"))
    # a key with several texts needs more than its key to name a row
    firsts = first.select(F.col("first").alias("k")).distinct()
    several = ids.groupBy("k").agg((F.min("id") != F.max("id")).alias("several")).join(firsts, "k", "left_semi")
    marked = written(by_doc.join(several, "k"), "anchors")

    def cut_out(batches):
        def held():
            return pa.RecordBatch.from_arrays([pa.array(columns[c], pa.binary() if c == "part" else pa.int64()) for c in Parts.NAMES], list(Parts.NAMES))

        def put(*row):
            for c, x in zip(Parts.NAMES, row, strict=True):
                columns[c].append(x)

        for batch in batches:
            columns, size = {c: [] for c in Parts.NAMES}, 0
            keys, seen = batch.column(0).to_numpy(), {}
            for n in np.argsort(keys, kind="stable").tolist():
                k, t = int(keys[n]), batch.column(1)[n].as_py()
                r = _row_hash(t) if batch.column(3)[n].as_py() else 0
                wanted = np.unique(np.asarray(batch.column(2)[n].values))
                gone_from = gone_to = -1
                for base, piece in worked(t, length):
                    a = anchors(piece, length)
                    first, end = runs(a)
                    place = np.minimum(np.searchsorted(wanted, a[first]), len(wanted) - 1)
                    hit = wanted[place] == a[first]
                    for i, to, anchor in zip(first[hit].tolist(), end[hit].tolist(), a[first[hit]].tolist(), strict=True):
                        for x in range(i, to, LONGEST):  # very long runs are cut: strings of a short period give few distinct parts
                            part = piece[x : min(x + LONGEST, to) - 1 + length]
                            if seen.setdefault(part, k) == k:
                                put(anchor, k, r, base + x, part)
                                size += len(part)
                            elif base + x <= gone_to:  # a smaller key of this batch has it: it goes, and is moved no more
                                gone_to = base + x + len(part)
                            else:
                                if gone_to >= 0:
                                    put(gone_to, k, r, gone_from, None)
                                gone_from, gone_to = base + x, base + x + len(part)
                        if size >= WORK_BYTES:
                            yield held()
                            columns, size = {c: [] for c in Parts.NAMES}, 0
                if gone_to >= 0:  # a row without a part says that the bytes up to its anchor go
                    put(gone_to, k, r, gone_from, None)
            yield held()

    parts = long_rows.join(marked, "k").select("k", "t", "anchors", "several").mapInArrow(cut_out, "anchor long, k long, r long, at long, part binary")

    def compare(batches, last_pass=False):
        held: list[pa.Table] = []
        size, postponed = 0, None

        def shard(rows: pa.Table, end: bool):
            """Judges the whole anchors of rows; gives the ranges found and the rows that wait for more."""
            nonlocal postponed
            p = Parts(rows)
            later = p.later()
            yield p.whole(np.flatnonzero(later))
            rows = p.rows.filter(pa.array(~later))
            anchor = p.anchor[~later]
            if not end and len(anchor) and int(p.lens.sum()) < shard_bytes // 2:
                return rows
            cut = len(anchor) if end else int(np.flatnonzero(anchor != anchor[-1])[-1]) + 1 if len(anchor) and (anchor != anchor[-1]).any() else 0
            if cut:
                yield Parts(rows.slice(0, cut)).judged(length)
                return rows.slice(cut)
            if len(anchor) and not last_pass:  # one anchor with more distinct parts than a shard holds
                postponed = int(anchor[0])
                yield from Parts(rows).strings(length)
                return rows.slice(0, 0)
            return rows

        for batch in batches:
            rows = pa.Table.from_batches([batch])
            told = rows.filter(pc.is_null(rows.column("part")))
            if told.num_rows:
                yield _ranges(*(told.column(c).to_numpy() for c in ("k", "r", "at", "anchor")))
                rows = rows.filter(pc.is_valid(rows.column("part")))
            if postponed is not None and rows.num_rows:
                same = rows.filter(pc.equal(rows.column("anchor"), postponed))
                if same.num_rows:
                    p = Parts(same)
                    yield p.whole(np.flatnonzero(p.later()))
                    yield from Parts(p.rows.filter(pa.array(~p.later()))).strings(length)
                    rows = rows.filter(pc.not_equal(rows.column("anchor"), postponed))
            if rows.num_rows:
                held.append(rows)
                size += rows.column("part").nbytes
                if size >= shard_bytes:
                    rows = yield from shard(pa.concat_tables(held), False)
                    held, size = [rows], rows.column("part").nbytes
        if held:
            yield from shard(pa.concat_tables(held), True)

    deal = F.coalesce(F.when(F.col("part").isNotNull(), F.col("anchor")), F.xxhash64("k"))
    schema = "k long, r long, a long, b long, anchor long, part binary"
    found = written(parts.repartition(deal).sortWithinPartitions("anchor", "k", "at").mapInArrow(compare, schema), "ranges")
    again = found.where("part is not null").select("anchor", "k", "r", F.col("a").alias("at"), "part").repartition("anchor").sortWithinPartitions("anchor", "k", "at")
    ends = found.where("part is null").select("k", "r", "a", "b").union(again.mapInArrow(lambda x: compare(x, True), schema).select("k", "r", "a", "b"))
    ranges = ends.groupBy("k").agg(F.collect_set(F.struct("r", "a", "b")).alias("ranges"))

    def cleaned(batches):
        for batch in batches:
            keys, n_bytes, n_removed, n_spans, sha, left = [], [], [], [], [], []
            for k, t, copied, own in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                copy = bool(copied) and hashlib.sha256(t).digest()[:16] in copied
                spans: list[list[int]] = []
                own = own or [] if len(t) >= length else []  # a short text may share its key with a longer one
                mine = {0, _row_hash(t)} if any(r["r"] for r in own) else {0}
                for r in [{"a": 0, "b": len(t)}] if copy else sorted((r for r in own if r["r"] in mine), key=lambda r: (r["a"], r["b"])):
                    if spans and r["a"] <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], r["b"])
                    else:
                        spans.append([r["a"], r["b"]])
                edges = [0, *(x for s in spans for x in s), len(t)]
                rest = b"".join(t[i:j] for i, j in zip(edges[::2], edges[1::2], strict=True))
                keys.append(k)
                n_bytes.append(len(t))
                n_removed.append(len(t) - len(rest))
                n_spans.append(len(spans))
                sha.append(hashlib.sha256(rest).hexdigest())
                left.append(rest if keep_text else None)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip([keys, n_bytes, n_removed, n_spans, sha, left], types, strict=True)], ["k", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"])

    # what happens to each key, without texts; the texts then move once
    fate = written(copies.join(ranges, "k", "full_outer"), "fates")
    dropped(ids, marked, found)
    judged_rows = all_rows.join(fate, "k", "left").select("k", "t", "copies", "ranges")
    out = judged_rows.mapInArrow(cleaned, "k long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text binary")
    out = out.withColumnRenamed("k", key)
    return out if keep_text else out.drop("kept_text")
