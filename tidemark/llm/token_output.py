"""Operator 10: token ids in binary blocks, one zstandard frame per document under a shared trained dictionary.

The format is a folder: `header` (one row: id width, end id, dictionary and its hash) and `blocks` (one row per block
of consecutive documents: shard, block, dictionary hash, keys, id counts, the offset of each frame, and the frames end
to end). A document is read by its block's offsets and one frame, without its neighbours. The blocks lie in Parquet
because only Spark's writers reach every store and commit a task's output once, however often it is retried.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.bpe import cut_with_care, pieces
from tidemark.llm.common import bound_batches, new_path, work_slices, worker_state
from tidemark.llm.token_counts import read_model

#: When a worker holds more pieces than this, it forgets all but the half that it met most often.
KEPT_PIECES = 600_000
#: New pieces that the library encodes as one text; characters of texts in which equal pieces are found together.
JOINED, SLICE_CHARS = 500, 4_000_000

#: A block ends after so many bytes of frames or documents.
BLOCK_BYTES, BLOCK_DOCS = 1 << 20, 512
#: The dictionary is trained on about so many documents, of each at most so many characters.
SAMPLE_DOCS, SAMPLE_CHARS, DICT_BYTES = 1500, 4096, 64 << 10
LEVEL = 1


class Ragged:
    """Arrays of ids end to end."""

    @classmethod
    def of(cls, ids: np.ndarray, lens: np.ndarray) -> "Ragged":
        out = cls()
        out.add(ids, lens)
        return out

    def __init__(self):
        self.ids, self.lens, self.starts = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, ids: np.ndarray, lens: np.ndarray) -> None:
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(lens) - lens])
        self.lens, self.ids = np.concatenate([self.lens, lens]), np.concatenate([self.ids, ids])

    def take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the arrays at these places end to end, and how many each has."""
        lens = self.lens[at]
        ends = np.cumsum(lens)
        return self.ids[np.repeat(self.starts[at] - (ends - lens), lens) + np.arange(ends[-1] if len(ends) else 0)], lens


class Met:
    """Distinct strings with the ids of each and in how many calls each was met."""

    def __init__(self, most: int):
        self.most, self.keys, self.ids, self.times = most, pa.array([], pa.large_string()), Ragged(), np.zeros(0, np.int64)

    def numbers(self, own: pa.Array, learn: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The number of each of these distinct strings; learn gives the ids of those that are new."""
        found = pc.index_in(own, value_set=self.keys)
        new = np.flatnonzero(pc.is_null(found).to_numpy(zero_copy_only=False))
        at = pc.fill_null(found, 0).to_numpy().astype(np.int64)
        if len(new):
            added = own.take(pa.array(new))
            at[new] = len(self.keys) + np.arange(len(new))
            self.ids.add(*learn(added.to_pylist()))
            self.keys = pa.concat_arrays([self.keys, added])
            self.times = np.append(self.times, np.zeros(len(new), np.int64))
        self.times[at] += 1
        return at

    def shrink(self) -> None:
        """Over `most` strings, those that were met most often stay, half of `most` of them, and count half as often."""
        if len(self.keys) > self.most:
            keep = np.sort(np.argsort(-self.times, kind="stable")[: self.most // 2])
            keep = keep[self.times[keep] > 1]
            self.ids, self.times = Ragged.of(*self.ids.take(keep)), self.times[keep] // 2
            self.keys = self.keys.take(pa.array(keep))


class PieceEncoder:
    """Encodes texts with the tokenizers library, which sees each distinct piece once while it is kept."""

    def __init__(self, model: bytes):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; the library's threads only cost memory
        self.tokenizer = Tokenizer.from_buffer(model)
        added = {t["content"] for t in json.loads(model).get("added_tokens", ())}
        self.added = re.compile("|".join(map(re.escape, added)) or r"(?!)")
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.width = np.zeros(max(vocab.values(), default=0) + 1, np.int64)  # bytes of each token
        for token, i in vocab.items():
            self.width[i] = len(token.encode()) if token in added else len(token)
        self.pieces = Met(KEPT_PIECES)

    def _each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and how many each has; every text is encoded alone."""
        own = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        lens = np.fromiter(map(len, own), np.int64, len(own))
        return np.fromiter((i for x in own for i in x), np.uint32, int(lens.sum())), lens

    def _joined(self, own: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for pieces with a space before each, encoded as one text; the tokens' bytes tell where each ends."""
        if not own:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        text = " " + " ".join(own)
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
        data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        begins = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))  # of the characters
        ends = begins[np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1)]
        upto = np.cumsum(self.width[ids])
        last = np.searchsorted(upto, ends)
        if len(upto) and upto[-1] == ends[-1] and (upto[last] == ends).all():
            return ids, np.diff(last + 1, prepend=0)
        return self._each([" " + p for p in own])

    def _learn(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces with a space before each, encoded joined; those that hold an added token's string, each alone."""
        alone = [bool(self.added.search(" " + p)) for p in new] if self.added.search(" ".join(new)) else []
        if any(alone):
            return self._each([" " + p for p in new])
        parts = [self._joined(new[i : i + JOINED]) for i in range(0, len(new), JOINED)]
        return np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text.

        Texts are cut into pieces, and equal ones are found by Arrow; the library sees the distinct pieces that aren't
        known. The first piece of a text, before which nothing stands, and the last one of a text that ends in white
        space or was cut with care, are encoded alone.
        """
        self.pieces.shrink()
        careful = [bool(t) and cut_with_care(t) for t in texts]
        order = [i for i, (t, c) in enumerate(zip(texts, careful, strict=True)) if t and not c]
        cut = pc.split_pattern(pa.array([texts[i] for i in order], pa.large_string()), " ")
        rest = [i for i, c in enumerate(careful) if c]
        own = [pieces(texts[i]) for i in rest]
        flat = pa.concat_arrays([cut.flatten(), pa.array([p for x in own for p in x], pa.large_string())])
        n = np.concatenate([np.diff(cut.offsets.to_numpy()), np.fromiter(map(len, own), np.int64, len(own))])
        ends = np.cumsum(n)
        order += rest
        coded = flat.dictionary_encode()
        codes = coded.indices.to_numpy()
        first = ends - n
        last = np.array([e - 1 for e, k, i in zip(ends.tolist(), n.tolist(), order, strict=True) if k > 1 and (careful[i] or texts[i][-1].isspace())], np.int64)
        inner = np.ones(len(codes), bool)
        inner[first] = inner[last] = False
        used = np.flatnonzero(np.bincount(codes[inner], minlength=len(coded.dictionary)))
        number = np.zeros(len(coded.dictionary), np.int64)
        if len(used):
            number[used] = self.pieces.numbers(coded.dictionary.take(pa.array(used)), self._learn)
        at = number[codes]
        alone = np.concatenate([first, last])
        strings = flat.take(pa.array(alone, pa.int64())).to_pylist()
        ids, lens = self._each(strings[: len(first)] + [" " + p for p in strings[len(first) :]])
        at[alone] = len(self.pieces.ids.lens) + np.arange(len(alone))
        both = Ragged.of(np.concatenate([self.pieces.ids.ids, ids]), np.concatenate([self.pieces.ids.lens, lens]))
        ids, lens = both.take(at)
        upto = np.append(0, np.cumsum(lens))
        out = [np.zeros(0, np.uint32)] * len(texts)
        for i, a, b in zip(order, upto[first].tolist(), upto[ends].tolist(), strict=True):
            out[i] = ids[a:b]
        return out


@dataclass
class TokenFiles:
    """What write_tokens() wrote: its folder, the dictionary's hash, and the id type."""

    path: str
    dict_hash: str
    dtype: str


def _sample(docs: DataFrame, key: str, text: str) -> list[str]:
    """Starts of about SAMPLE_DOCS texts, chosen by a hash of key and start, so that their number doesn't grow."""
    share = min(1.0, SAMPLE_DOCS / max(1, docs.count()))
    own = docs.select(F.col(key).alias("k"), F.substring(text, 1, SAMPLE_CHARS).alias("t")).where(F.length("t") > 0)
    drawn = own.where(F.pmod(F.xxhash64("k", "t"), F.lit(1 << 30)) < int(share * (1 << 30)))
    return sorted(r.t for r in drawn.distinct().select("t").collect())  # rows that repeat are drawn together, once


def train_dictionary(samples: list[np.ndarray], size: int = DICT_BYTES) -> bytes:
    """A dictionary for serialized id arrays; too few samples to train on give their bytes end to end."""
    raw = [s.tobytes() for s in samples if len(s)]
    try:
        return zstandard.train_dictionary(min(size, max(1024, sum(map(len, raw)) // 8)), raw).as_bytes()
    except zstandard.ZstdError:
        return b"".join(raw)[-size:]


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def write_tokens(docs: DataFrame, tokenizer_path: str, path: str, *, end_id: int = 2, key: str = "doc_id", text: str = "text") -> TokenFiles:
    """Writes the ids of every whole text, each followed by end_id, in ascending order of key.

    Null and empty texts give end_id alone. A null key comes first; rows of one key are ordered by text, so repeated
    rows and reruns give the same files. Other columns are ignored whatever their names. An empty table gives a folder
    without blocks. The rows are dealt out by ranges of (key, hash of text): neither a key that many rows share nor a
    long text makes one task large, and a task holds one block at a time.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    model = read_model(tokenizer_path)
    encoder = PieceEncoder(model)
    dtype = "<u2" if max(encoder.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"
    data = train_dictionary([np.append(x, end_id).astype(dtype) for x in encoder(_sample(docs, key, text))])
    dict_hash = hashlib.sha256(data).hexdigest()
    shared, ident = spark.sparkContext.broadcast((model, data)), hashlib.sha256(model).hexdigest()

    def encode(batches):
        model, data = shared.value
        encoder = worker_state(f"ids-{ident}", lambda: PieceEncoder(model))
        zipped = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(data))
        shard, block = TaskContext.get().partitionId(), 0
        keys, counts, frames, size = [], [], [], 0

        def made():
            offsets = np.append(0, np.cumsum([len(f) for f in frames]))
            columns = [[shard], [block], [dict_hash], [keys], [counts], [offsets.tolist()], [sum(counts)], [b"".join(frames)]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

        for batch in batches:
            if not batch.num_rows:
                continue
            kinds = [pa.int32(), pa.int64(), pa.string(), pa.list_(batch.column(0).type), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.binary()]
            own, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in work_slices([len(t or "") for t in texts], SLICE_CHARS):
                for k, ids in zip(own[a:b], encoder(texts[a:b]), strict=True):
                    frame = zipped.compress(np.append(ids, end_id).astype(dtype).tobytes())
                    keys.append(k)
                    counts.append(len(ids) + 1)
                    frames.append(frame)
                    size += len(frame)
                    if size >= BLOCK_BYTES or len(keys) >= BLOCK_DOCS:
                        yield made()
                        block, keys, counts, frames, size = block + 1, [], [], [], 0
        if keys:
            yield made()

    kind = docs.select(key).schema[0].dataType.simpleString()
    names = ["shard", "block", "dict_hash", "keys", "counts", "offsets", "n_tokens", "frames"]
    schema = f"shard int, block long, dict_hash string, keys array<{kind}>, counts array<bigint>, offsets array<bigint>, n_tokens long, frames binary"
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.xxhash64(text).alias("h"))
    ordered = rows.repartitionByRange("k", "h").sortWithinPartitions("k", "h", "t").select("k", "t")
    ordered.mapInArrow(encode, schema).write.mode("overwrite").parquet(f"{path}/blocks")
    head = spark.createDataFrame([(dtype, end_id, dict_hash, bytearray(data))], "dtype string, end_id int, dict_hash string, dictionary binary")
    head.coalesce(1).write.mode("overwrite").parquet(f"{path}/header")
    return TokenFiles(path, dict_hash, dtype)


def block_starts(spark: SparkSession, path: str) -> DataFrame:
    """shard, block, start: the ids before each block, from sums by shard and then by block within its shard."""
    sizes = spark.read.parquet(f"{path}/blocks").select("shard", "block", "n_tokens")
    shards = sizes.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = shards.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    own = sizes.select("shard", "block", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("own"))
    return own.join(base, "shard").select("shard", "block", (F.col("base") + F.col("own")).alias("start"))


def _opened(header) -> tuple[zstandard.ZstdDecompressor, np.dtype]:
    data = bytes(header.dictionary)
    if hashlib.sha256(data).hexdigest() != header.dict_hash:
        raise ValueError("the dictionary isn't the one that the header names")
    return zstandard.ZstdDecompressor(dict_data=_dictionary(data)), np.dtype(header.dtype)


def read_tokens(spark: SparkSession, path: str, *, key: str = "doc_id") -> DataFrame:
    """Per document, from the files: key, start, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32 bits)."""
    header = spark.read.parquet(f"{path}/header").first()
    bound_batches(spark)  # a batch of blocks is bounded by its bytes

    def decode(batches):
        unzip, dtype = _opened(header)
        for batch in batches:
            for row in batch.to_pylist():
                if row["dict_hash"] != header.dict_hash:
                    raise ValueError("a block was written with another dictionary")
                out = []
                for i, n in enumerate(row["counts"]):
                    ids = np.frombuffer(unzip.decompress(row["frames"][row["offsets"][i] : row["offsets"][i + 1]]), dtype)
                    if len(ids) != n:
                        raise ValueError("a frame doesn't hold as many ids as its index says")
                    out.append(zlib.crc32(ids.astype("<u4").tobytes()))
                n = np.array(row["counts"], np.int64)
                same = [pa.array(np.full(len(n), row[c]), t) for c, t in (("shard", pa.int32()), ("block", pa.int64()))]
                yield pa.RecordBatch.from_arrays([pa.array(row["keys"], batch.schema.field("keys").type.value_type), *same, pa.array(np.cumsum(n) - n), pa.array(n), pa.array(out, pa.int64())], [key, "shard", "block", "inside", "n_tokens", "ids_crc32"])

    blocks = spark.read.parquet(f"{path}/blocks").select("shard", "block", "dict_hash", "keys", "counts", "offsets", "frames")
    kind = blocks.schema["keys"].dataType.elementType.simpleString()
    # frames are decoded where they are read; only rows of numbers meet the blocks' starts
    out = blocks.mapInArrow(decode, f"{key} {kind}, shard int, block long, inside long, n_tokens long, ids_crc32 long")
    return out.join(block_starts(spark, path), ["shard", "block"]).select(key, (F.col("start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def read_document(spark: SparkSession, path: str, key_value) -> list[np.ndarray]:
    """The ids of the documents of one key: block by its keys, then one frame of each."""
    header = spark.read.parquet(f"{path}/header").first()
    unzip, dtype = _opened(header)
    hits = spark.read.parquet(f"{path}/blocks").where(F.array_contains("keys", key_value))
    at = hits.select(F.explode(F.arrays_zip("keys", "offsets", F.slice("offsets", 2, F.size("keys")).alias("ends"))).alias("x"), "frames").where(F.col("x.keys") == key_value)
    return [np.frombuffer(unzip.decompress(bytes(r.f)), dtype) for r in at.select(F.substring("frames", F.col("x.offsets").cast("int") + 1, (F.col("x.ends") - F.col("x.offsets")).cast("int")).alias("f")).collect()]


def token_output(docs: DataFrame, tokenizer_path: str, *, path: str | None = None, end_id: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """write_tokens() to path (by default a new folder in the shared one), then read_tokens() from it."""
    spark = docs.sparkSession
    path = path or new_path(spark, "tokens")
    write_tokens(docs, tokenizer_path, path, end_id=end_id, key=key, text=text)
    return read_tokens(spark, path, key=key)
