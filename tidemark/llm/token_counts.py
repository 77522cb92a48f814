"""Operator 1: token counts by rank-synchronous array merging."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bpe import ArrayBPE, Interned, pieces
from tidemark.llm.common import bound_batches, work_slices, worker_state

#: A worker forgets its counted pieces when it holds more than this; they are counted again when they next occur.
KEPT_PIECES = 800_000


class PieceCounter:
    """Counts texts by their pieces; each distinct piece is merged once while it is kept."""

    def __init__(self, model: bytes):
        self.bpe = ArrayBPE(model)
        self.reset()

    def reset(self) -> None:
        self.bpe.reset()
        self.known, self.counts = Interned(), np.zeros(0, np.int64)

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        if len(self.known) > KEPT_PIECES:
            self.reset()
        flat, lens = [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            if text:
                own = pieces(text)
                own[0] = (own[0],)  # a tuple: nothing stands before it
                flat += own
                lens[i] = len(own)
        before = len(self.known)
        at = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        if len(self.known) > before:
            new = ["".join(p) if isinstance(p, tuple) else " " + p for p in self.known.since(before)]
            self.counts = np.append(self.counts, self.bpe.count(new))
        sums, ends = np.append(0, np.cumsum(self.counts[at])), np.cumsum(lens)
        return sums[ends] - sums[ends - lens]


def read_model(path: str, most: int = 64 << 20) -> bytes:
    """The tokenizer file, read on the driver; files over `most` bytes are refused, since it is sent to every worker."""
    with open(path, "rb") as f:
        data = f.read(most + 1)
    if len(data) > most:
        raise ValueError(f"{path} is larger than {most} bytes")
    return data


def token_counts(df: DataFrame, tokenizer_path: str, *, text: str = "text", key: str = "doc_id", limit: int = 1024) -> DataFrame:
    """Per row of df: key, n_bytes, n_tokens, over_limit (n_tokens > limit) of the whole text.

    tokenizer_path is a byte-level BPE of the tokenizers library (.json). Null and empty texts have 0 bytes and 0
    tokens. A null key is carried along; repeated rows give repeated rows; other columns are ignored whatever their
    names; an empty table gives an empty one. Texts may have any length: they are worked on in bounded slices of rows.
    Scan, one pass in Python over Arrow batches, no shuffle.
    """
    spark = df.sparkSession
    bound_batches(spark)
    data = read_model(tokenizer_path)
    model, ident = spark.sparkContext.broadcast(data), hashlib.sha256(data).hexdigest()

    def count(batches):
        counter = worker_state(f"counts-{ident}", lambda: PieceCounter(model.value))
        for batch in batches:
            texts = batch.column(1).to_pylist()
            out = [counter(texts[a:b]) for a, b in work_slices([len(t or "") for t in texts])]
            n = pa.array(np.concatenate(out) if out else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), n], ["k", "n_bytes", "n_tokens"])

    size = F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long")
    kind = df.select(F.col(key).alias("k")).schema[0].dataType.simpleString()
    out = df.select(F.col(key).alias("k"), F.col(text).alias("t"), size.alias("n_bytes")).mapInArrow(count, f"k {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("k").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
