"""Models of text trained here: an embedder (hashed TF-IDF and a randomised SVD) and a sentiment classifier over it.

Training is sums over a table: every pass is one Spark job whose result has a bounded size, the model's own. Scoring is
an iterator function that loads the weights, which are broadcast, once for each task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructType

from tidemark.functions.text import latin_words
from tidemark.scratch import Scratch

#: Remainders of the words' hashes, dimensions of an embedding, and dimensions more that the sketch has.
WORDS, SIZE, MORE = 1 << 13, 32, 8
#: Passes that sharpen the sketch; steps of the classifier, and its ridge.
POWERS, STEPS, RIDGE = 2, 8, 1.0
#: Texts that are counted at once, and texts that are multiplied at once, as a dense table over the words that stand in them.
CHUNK, BLOCK = 256, 32
LABELS = ("negative", "neutral", "positive")


def word_numbers(text: Column, words: int = WORDS) -> Column:
    """The remainders of the hashes of a text's words."""
    return F.transform(latin_words(text), lambda w: F.pmod(F.xxhash64(w), F.lit(words)).cast("int"))


def word_counts(texts: DataFrame, text: str = "text", *, words: int = WORDS) -> DataFrame:
    """The other columns, k and n: the numbers of each text's words, each once and ascending, and how often it has them."""
    hashes = F.coalesce(F.transform(latin_words(F.col(text)), lambda w: F.xxhash64(w)), F.array().cast("array<long>"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *rest, lists = batch.columns
            flat, ends = _flat(lists)
            k, n, bounds = _counted(flat, ends, words)
            made = [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(x, pa.int32())) for x in (k, n)]
            yield pa.RecordBatch.from_arrays([*rest, *made], [*batch.schema.names[:-1], "k", "n"])

    rest = texts.drop(text)
    schema = StructType(list(rest.schema.fields)).add("k", ArrayType(IntegerType())).add("n", ArrayType(IntegerType()))
    return texts.select(*rest.columns, hashes.alias("_w")).mapInArrow(count, schema)


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of all lists, and the bounds between the lists."""
    ends = lists.offsets.to_numpy().astype(np.int64)
    return lists.values.to_numpy()[ends[0] : ends[-1]], ends - ends[0]


def _counted(numbers: np.ndarray, bounds: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's numbers, each once, how often each is there, and the bounds between the texts."""
    ks, ns, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(1, np.int64)]
    for first in range(0, len(bounds) - 1, CHUNK):
        ends = bounds[first : first + CHUNK + 1]
        starts = np.arange(len(ends)) * words
        own, counts = np.unique(np.repeat(starts[:-1], np.diff(ends)) + numbers[ends[0] : ends[-1]] % words, return_counts=True)
        ks.append(own % words)
        ns.append(counts)
        sizes.append(np.diff(np.searchsorted(own, starts)))
    return np.concatenate(ks), np.concatenate(ns), np.cumsum(np.concatenate(sizes))


def weighted(numbers: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A text's word numbers, each once, and their weights, of length 1."""
    own, counts = np.unique(numbers, return_counts=True)
    w = (1 + np.log(counts)) * idf[own]
    length = np.sqrt(w @ w)
    return own, w / length if length else w


def _tables(k: np.ndarray, n: np.ndarray, bounds: np.ndarray, idf: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """weighted() texts as dense tables of BLOCK rows: the word numbers that are columns, and the weights."""
    place = np.zeros(len(idf), np.int64)
    for first in range(0, len(bounds) - 1, BLOCK):
        ends = bounds[first : first + BLOCK + 1]
        own, row = k[ends[0] : ends[-1]], np.repeat(np.arange(len(ends) - 1), np.diff(ends))
        w = (1 + np.log(n[ends[0] : ends[-1]])) * idf[own]
        length = np.sqrt(np.bincount(row, w * w, len(ends) - 1))
        columns = np.flatnonzero(np.bincount(own, minlength=len(idf)))
        place[columns] = np.arange(len(columns))
        table = np.zeros((len(ends) - 1, len(columns)))
        table[row, place[own]] = w / np.where(length, length, 1)[row]
        yield columns, table


@dataclass(frozen=True)
class Embedder:
    """idf by word number and a matrix of word numbers by dimensions: a few megabytes whatever was learnt from."""

    idf: np.ndarray
    matrix: np.ndarray

    def encode(self, lists: Iterator[np.ndarray]) -> np.ndarray:
        """A vector of length 1 for each list of word numbers; zeros where nothing is known of the words."""
        lists = [np.asarray(x, np.int64) for x in lists]
        bounds = np.cumsum([0, *map(len, lists)])
        return self.encode_counts(*_counted(np.concatenate([np.zeros(0, np.int64), *lists]), bounds, len(self.idf)))

    def encode_counts(self, k: np.ndarray, n: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The same for counted words."""
        out = [np.zeros((0, self.matrix.shape[1]))]
        for columns, table in _tables(k, n, bounds, self.idf):
            v = table @ self.matrix[columns]
            length = np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]
            out.append(np.where(length > 1e-12, v / np.where(length, length, 1), 0.0))
        return np.concatenate(out)

    def column(self, spark: SparkSession) -> Callable[[Column], Column]:
        """The embedder as a function of a text column."""
        weights = spark.sparkContext.broadcast((self.idf, self.matrix))

        @pandas_udf("array<double>")
        def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = Embedder(*weights.value)
            for numbers in batches:
                yield pd.Series(list(model.encode(x if x is not None else [] for x in numbers)), dtype=object)

        return lambda text: embed(word_numbers(text))

    def vectors(self, counts: DataFrame) -> DataFrame:
        """word_counts() with x, the embedding, in place of k and n."""
        weights = counts.sparkSession.sparkContext.broadcast((self.idf, self.matrix))

        def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = Embedder(*weights.value)
            for batch in batches:
                *rest, k, n = batch.columns
                own, bounds = _flat(k)
                x = model.encode_counts(own, _flat(n)[0], bounds)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([*rest, lists], [*batch.schema.names[:-2], "x"])

        rest = counts.drop("k", "n")
        return counts.select(*rest.columns, "k", "n").mapInArrow(embed, StructType(list(rest.schema.fields)).add("x", ArrayType(DoubleType())))


def _summed(table: DataFrame, part: Callable[[Iterator[pa.RecordBatch], dict], None], width: int) -> dict[int, np.ndarray]:
    """Rows of numbers, by key, that `part` adds up over the batches of each task, added up over the tasks.

    As many rows come to the driver as there are keys, which are a model's.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        part(batches, sums)
        keys = sorted(sums)
        rows = np.array([sums[k] for k in keys]).reshape(len(keys), width)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), *[pa.array(rows[:, i]) for i in range(width)]], ["k", *[f"c{i}" for i in range(width)]])

    columns = [f"c{i}" for i in range(width)]
    found = table.mapInArrow(work, "k int, " + ", ".join(f"{c} double" for c in columns)).groupBy("k").agg(*[F.sum(c).alias(c) for c in columns]).toArrow()
    rows = np.column_stack([found.column(c).to_numpy() for c in columns]) if len(found) else np.zeros((0, width))
    return dict(zip(found.column("k").to_pylist(), rows, strict=True))


def train_embedder(texts: DataFrame, text: str = "text", *, words: int = WORDS, size: int = SIZE) -> Embedder:
    """An embedder from all texts, which are read once; null and empty texts count as texts without words."""
    scratch = Scratch(texts.sparkSession)
    own = scratch.keep(word_counts(texts.select(text), text, words=words), "words")
    found = fit_embedder(own, words=words, size=size)
    scratch.drop(own)
    return found


def fit_embedder(counts: DataFrame, *, words: int = WORDS, size: int = SIZE) -> Embedder:
    """An embedder from word_counts(): idf of the words, and the leading right singular vectors of their weighted table.

    A random sketch is multiplied by the table and its transpose POWERS + 1 times, a job each, so counts should be kept.
    Texts without any words at all give an embedder that knows nothing.
    """
    spark, own = counts.sparkSession, counts.select("k", "n")

    def texts_with(batches: Iterator[pa.RecordBatch], sums: dict) -> None:
        df = np.zeros(words)
        for batch in batches:
            df += np.bincount(_flat(batch.column(0))[0], minlength=words)
        sums.update((int(k), df[k : k + 1]) for k in np.flatnonzero(df))

    n = own.count()
    df = np.zeros(words)
    for k, (found,) in _summed(own.select("k"), texts_with, 1).items():
        df[k] = found
    idf = np.log((1 + n) / (1 + df)) + 1
    basis, _ = np.linalg.qr(np.random.default_rng(7).standard_normal((words, size + MORE)))

    def multiplied(basis: np.ndarray) -> np.ndarray:
        weights = spark.sparkContext.broadcast((idf, basis))

        def part(batches: Iterator[pa.RecordBatch], sums: dict) -> None:
            idf, basis = weights.value
            out = np.zeros_like(basis)
            touched = np.zeros(len(basis), bool)
            for batch in batches:
                k, bounds = _flat(batch.column(0))
                for columns, table in _tables(k, _flat(batch.column(1))[0], bounds, idf):
                    out[columns] += table.T @ (table @ basis[columns])
                    touched[columns] = True
            sums.update((int(k), out[k]) for k in np.flatnonzero(touched))

        found = np.zeros_like(basis)
        for k, row in _summed(own, part, basis.shape[1]).items():
            found[k] = row
        weights.destroy()
        return found

    for _ in range(POWERS):
        basis, _ = np.linalg.qr(multiplied(basis))
    values, vectors = np.linalg.eigh(basis.T @ multiplied(basis))
    lead = np.argsort(values)[::-1][:size]
    matrix = basis @ vectors[:, lead]
    matrix *= np.sign(matrix[np.abs(matrix).argmax(axis=0), np.arange(matrix.shape[1])])
    return Embedder(idf, matrix if df.any() else np.zeros((words, size)))


@dataclass(frozen=True)
class Sentiment:
    """A line for each label over an embedder's dimensions and a constant."""

    embedder: Embedder
    lines: np.ndarray

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        p = 1 / (1 + np.exp(-np.clip(np.column_stack([x, np.ones(len(x))]) @ self.lines.T, -30, 30)))
        return p / p.sum(axis=1, keepdims=True)

    def judged(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Labels and signed scores of vectors."""
        p = self.probabilities(x)
        best = p.argmax(axis=1)
        return [LABELS[i] for i in best], p[np.arange(len(p)), best] * (best - 1.0)

    def column(self, spark: SparkSession) -> Callable[[Column], Column]:
        """A function of a text column: struct(label, score), where score is the label's probability, signed; 0 if neutral."""
        weights = spark.sparkContext.broadcast((self.embedder.idf, self.embedder.matrix, self.lines))

        @pandas_udf("label string, score double")
        def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            idf, matrix, lines = weights.value
            model = Sentiment(Embedder(idf, matrix), lines)
            for numbers in batches:
                labels, scores = model.judged(model.embedder.encode(x if x is not None else [] for x in numbers))
                yield pd.DataFrame({"label": labels, "score": scores})

        return lambda text: score(word_numbers(text))

    def scores(self, vectors: DataFrame) -> DataFrame:
        """Embedder.vectors() with label and score in place of x."""
        lines = self.lines

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = Sentiment(None, lines)
            for batch in batches:
                *rest, x = batch.columns
                labels, scores = model.judged(_flat(x)[0].reshape(len(x), -1))
                yield pa.RecordBatch.from_arrays([*rest, pa.array(labels, pa.string()), pa.array(scores)], [*batch.schema.names[:-1], "label", "score"])

        rest = vectors.drop("x")
        return vectors.select(*rest.columns, "x").mapInArrow(score, StructType(list(rest.schema.fields)).add("label", "string").add("score", "double"))


def train_sentiment(texts: DataFrame, embedder: Embedder, text: str = "text", label: str = "label") -> Sentiment:
    """One line per label from labelled texts."""
    counts = word_counts(texts.select(label, text), text, words=len(embedder.idf))
    return fit_sentiment(embedder.vectors(counts), embedder, label)


def fit_sentiment(vectors: DataFrame, embedder: Embedder, label: str = "label") -> Sentiment:
    """One line per label by logistic regression on labelled Embedder.vectors(), in STEPS Newton steps.

    Each step is one job that adds up gradients and curvatures; rows with another label, or none, are left out.
    """
    scratch = Scratch(vectors.sparkSession)
    number = F.coalesce(*[F.when(F.col(label) == name, F.lit(i)) for i, name in enumerate(LABELS)])
    own = scratch.keep(vectors.select(number.alias("y"), "x").where("y is not null"), "vectors")
    width = embedder.matrix.shape[1] + 1
    lines = np.zeros((len(LABELS), width))
    for _ in range(STEPS):

        def part(batches: Iterator[pa.RecordBatch], sums: dict, lines: np.ndarray = lines) -> None:
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = np.column_stack([batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1), np.ones(batch.num_rows)])
                y = batch.column(0).to_numpy()
                for c in range(len(LABELS)):
                    p = 1 / (1 + np.exp(-np.clip(x @ lines[c], -30, 30)))
                    rows = np.vstack([((y == c) - p) @ x, (x * (p * (1 - p))[:, None]).T @ x])
                    for i, row in enumerate(rows):
                        sums[c * (width + 1) + i] = sums.get(c * (width + 1) + i, 0) + row

        found = _summed(own, part, width)
        if not found:
            break
        step = []
        for c in range(len(LABELS)):
            rows = np.array([found[c * (width + 1) + i] for i in range(width + 1)])
            step.append(np.linalg.solve(rows[1:] + RIDGE * np.eye(width), rows[0] - RIDGE * lines[c]))
        lines = lines + np.array(step)
    scratch.drop(own)
    return Sentiment(embedder, lines)
