"""Operator 3: text quality by compression under dictionaries of good and of bad text."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bound_batches, remainder, spread, worker_state

#: Each class learns from so many labelled documents at most (those of smallest key hash), of each so many characters,
#: of longer ones from windows that lie evenly over the whole text.
TRAIN_DOCS, TRAIN_CHARS = 3000, 6000
#: A text is compressed in parts of so many bytes, so that the dictionaries tell as much about its end as about its start.
PART, DICT_BYTES, LEVEL = 512, 110 << 10, 3


class Compressors:
    """Compressed sizes of texts under the two dictionaries."""

    def __init__(self, good: bytes, bad: bytes):
        self.zips = []
        for data in (good, bad):
            d = zstandard.ZstdCompressionDict(data) if data else None
            if d:
                d.precompute_compress(level=LEVEL)
            self.zips.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False))

    def difference(self, text: str | None) -> float:
        """(size under the bad dictionary - size under the good one) / bytes, over all parts of the text; 0 for no text."""
        data = (text or "").encode("utf-8", "surrogatepass")
        if not data:
            return 0.0
        good = bad = 0
        for i in range(0, len(data), PART):
            part = data[i : i + PART]
            good += len(self.zips[0].compress(part))
            bad += len(self.zips[1].compress(part))
        return (bad - good) / len(data)


def _dictionary(texts: list[str]) -> bytes:
    parts = [d[i : i + PART] for t in texts for d in [t.encode()] for i in range(0, len(d), PART)]
    if not parts:
        return b""
    try:
        return zstandard.train_dictionary(min(DICT_BYTES, max(1024, sum(map(len, parts)) // 4)), parts).as_bytes()
    except zstandard.ZstdError:
        return b"".join(parts)[-DICT_BYTES:]


def _fit(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic regression on one feature with a mild prior, by Newton's method; each class counts as in the sample."""
    w = np.zeros(2)
    f = np.stack([np.ones_like(x), x], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(f @ w, -30, 30)))
        grad = f.T @ (p - y) + 1e-3 * w
        step = np.linalg.solve((f * (p * (1 - p))[:, None]).T @ f + 1e-3 * np.eye(2), grad)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


class QualityModel:
    """The two dictionaries and the calibration: score = logistic(a + b * difference)."""

    def __init__(self, good: list[str], bad: list[str], rate: float = 0.5):
        # every other document trains the dictionaries, the rest the calibration, which thus sees texts that no dictionary saw
        self.good, self.bad = _dictionary(good[::2]), _dictionary(bad[::2])
        self.a, self.b = math.log(max(rate, 1e-6) / max(1 - rate, 1e-6)), 0.0
        own = Compressors(self.good, self.bad)
        x = np.array([own.difference(t) for t in good[1::2] + bad[1::2]])
        y = np.array([1.0] * len(good[1::2]) + [0.0] * len(bad[1::2]))
        if len(good) > 1 and len(bad) > 1:
            scale = float(np.abs(x).std()) or 1.0
            a, b = _fit(x / scale, y)
            balance = math.log(rate / (1 - rate)) - math.log(y.mean() / (1 - y.mean()))
            self.a, self.b = a + balance, b / scale

    def ident(self) -> str:
        return hashlib.sha256(repr((self.good, self.bad)).encode()).hexdigest()


def train(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality", folds: int = 5, held_out: int = 0, most: int = TRAIN_DOCS, chars: int = TRAIN_CHARS) -> QualityModel:
    """The model from a bounded sample of labelled rows outside the held-out fold; keys with labels of both kinds are left out.

    Of a key with several texts the one that sorts first counts, so however often a key occurs the sample is bounded.
    """
    own = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & (remainder(F.col(key), folds) != held_out))
    own = own.groupBy(F.col(key).alias("k")).agg(F.min(label).alias("y"), F.max(label).alias("y2")).where("y = y2")
    sizes = {r.y: r.n for r in own.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return QualityModel([], [])
    parts = [own.where(F.col("y") == y).select("k", "y", F.xxhash64("k").alias("h")).orderBy("h").limit(most) for y in (0, 1)]
    picked = parts[0].union(parts[1]).select("k", "y")  # at most 2 * most rows
    rows = docs.select(F.col(key).alias("k"), spread(F.col(text), chars).alias("t")).where("t is not null").join(F.broadcast(picked), "k").groupBy("k", "y").agg(F.min("t").alias("t")).collect()
    rows.sort(key=lambda r: (hashlib.sha256(str(r.k).encode()).digest(), r.t))
    n = sum(sizes.values())
    return QualityModel(*([r.t for r in rows if r.y == y] for y in (1, 0)), rate=min(max(sizes.get(1, 0) / n, 1e-3), 1 - 1e-3))


def with_score(docs: DataFrame, model: QualityModel, *, text: str = "text", score: str = "score") -> DataFrame:
    """docs with the column `score`, 0 to 1, higher where label 1 is likelier; from the whole text only.

    Empty and null texts get the score of difference 0. A column of docs that has the score's name is replaced.
    """
    bound_batches(docs.sparkSession)
    names = [c for c in docs.columns if c != score]
    shared, ident, a, b = docs.sparkSession.sparkContext.broadcast((model.good, model.bad)), model.ident(), model.a, model.b

    def scored(batches):
        own = worker_state(ident, lambda: Compressors(*shared.value))
        for batch in batches:
            x = np.array([own.difference(t.as_py()) for t in batch.column(0)], np.float64)
            p = 1 / (1 + np.exp(-np.clip(a + b * x, -700, 700)))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(p)], [*[f"c{i}" for i in range(len(names))], "p"])

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    source = docs.select(F.col(f"`{text}`").alias("t"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    schema = ", ".join([*[f"c{i} {kinds[c]}" for i, c in enumerate(names)], "p double"])
    return source.mapInArrow(scored, schema).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], F.col("p").alias(score))


def quality_scores(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality", folds: int = 5, held_out: int = 0, accept: float = 0.3) -> DataFrame:
    """Per row of docs: key, held_out, score, predicted (1 if score >= accept); learned outside the held-out fold.

    Null and empty texts get the score of no difference; a null key counts as the empty text for the fold; without
    labels of both kinds every score is 0.5. Repeated rows give repeated rows, an
    empty table an empty one; other columns are ignored whatever their names. Two scans of docs (the sample's, whose
    rows are found through a broadcast of at most 6,000 keys, and the scoring one); no shuffle of texts.
    """
    model = train(docs, labels, key=key, text=text, label=label, folds=folds, held_out=held_out)
    out = with_score(docs.select(F.col(key).alias("k"), F.col(text).alias("t")), model, text="t")
    return out.select(F.col("k").alias(key), (remainder(F.col("k"), folds) == held_out).alias("held_out"), "score", (F.col("score") >= accept).cast("int").alias("predicted"))
