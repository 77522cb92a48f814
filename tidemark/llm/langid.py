"""Operator 4: language identification by prediction by partial matching under frozen statistics."""

from __future__ import annotations

import hashlib
import pickle

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bound_batches, remainder, spread, work_slices, worker_state

#: Longest context in bytes.
ORDER = 3
#: Per language the model learns from documents of smallest hash, about so many, of each at most so many characters, of
#: longer ones from windows that lie evenly over the whole text.
TRAIN_DOCS, TRAIN_CHARS = 1200, 4000
UNKNOWN = "und"
_START = b"\n" * ORDER
_LETTER = regex.compile(r"\p{L}")


class _Keys:
    """Finds the position of integer keys in a fixed list, by open addressing."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys.astype(np.uint32)
        self.shift = np.uint32(32 - max(4, int(4 * len(keys)).bit_length()))
        self.slots = np.full((1 << int(32 - self.shift)) + 64, -1, np.int32)
        left, step = np.arange(len(keys), dtype=np.int32), 0
        while len(left):
            at = self._slot(self.keys[left]) + step
            if at.max(initial=0) >= len(self.slots):
                self.slots = np.append(self.slots, np.full(64, -1, np.int32))
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]
            left, step = left[self.slots[at] != left], step + 1
        self.slots = np.append(self.slots, np.int32(-1))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint32(2654435769)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Position of each key, -1 where it isn't there."""
        at = self._slot(keys)
        out = self.slots[at]
        if not len(self.keys):
            return out
        open_ = np.flatnonzero((out >= 0) & (self.keys[out] != keys))
        while len(open_):
            at[open_] += 1
            out[open_] = now = self.slots[at[open_]]
            open_ = open_[(now >= 0) & (self.keys[now] != keys[open_])]
        return out


class ContextTrees:
    """One byte context tree per language, with the code length of every byte after every context.

    In a context c of n bytes with q different ones, byte s of count k costs -log2(k / (n + q)). A byte that c never saw
    costs the escape, q / (n + q), and what it costs in the context one byte shorter, from which the bytes that c did
    see are excluded (its probabilities are divided by what is left); below the empty context all bytes cost the same.
    So the code lengths in any context are those of a proper distribution. Since the statistics are frozen, the costs
    of all strings that some language saw are worked out when the model is built, for all languages side by side.
    """

    def __init__(self, texts: dict[str, list[bytes]]):
        self.langs = sorted(texts)
        self.grams, self.costs, self.contexts, self.escapes = [], [], [], []
        streams = [np.frombuffer(b"".join(_START + t for t in texts[x]), np.uint8).astype(np.uint32) for x in self.langs]
        for order in range(ORDER + 1):
            counts = [np.unique(_grams(s, order), return_counts=True) for s in streams]
            grams = np.unique(np.concatenate([g for g, _ in counts] or [np.zeros(0, np.uint32)]))
            contexts = np.unique(grams >> np.uint32(8))
            lower = self._cost(grams, order - 1)
            cost, escape = lower.copy(), np.zeros((len(contexts), len(self.langs)), np.float32)
            of = np.searchsorted(contexts, grams >> np.uint32(8))
            for i, (own, k) in enumerate(counts):
                at = np.searchsorted(grams, own)
                ctx = of[at]
                n, q = np.bincount(ctx, k, len(contexts)), np.bincount(ctx, minlength=len(contexts))
                rest = 1 - np.bincount(ctx, 2.0 ** -lower[at, i].astype(np.float64), len(contexts))
                seen = q > 0
                escape[seen, i] = -np.log2(q[seen] / (n + q)[seen] / np.maximum(rest[seen], 1e-9))
                cost[:, i] += escape[of, i]
                cost[at, i] = -np.log2(k / (n + q)[ctx])
            self.grams.append(_Keys(grams))
            self.costs.append(cost)
            self.contexts.append(_Keys(contexts))
            self.escapes.append(escape)

    def _cost(self, grams: np.ndarray, order: int) -> np.ndarray:
        """Bits of the last byte of each string after the `order` bytes before it, for every language."""
        if order < 0:
            return np.full((len(grams), len(self.langs)), 8, np.float32)
        if order < 3:
            grams = grams & np.uint32((1 << 8 * (order + 1)) - 1)
        at = self.grams[order].find(grams)
        out = self.costs[order][at] if len(self.costs[order]) else np.zeros((len(grams), len(self.langs)), np.float32)
        new = np.flatnonzero(at < 0)
        if len(new):
            out[new] = self._cost(grams[new], order - 1)
            ctx = self.contexts[order].find(grams[new] >> np.uint32(8))
            known = ctx >= 0
            out[new[known]] += self.escapes[order][ctx[known]]
        return out

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Code length of each text (none is empty) in each language."""
        stream = np.frombuffer(b"".join(_START + t for t in texts), np.uint8).astype(np.uint32)
        lens = np.fromiter(map(len, texts), np.int64, len(texts)) + ORDER
        cost = self._cost(_grams(stream, ORDER), ORDER)
        first = np.cumsum(lens) - lens  # of the strings that end at a text's first byte; those across two texts don't count
        edges = np.stack([first, np.append(first[1:] - ORDER, len(cost))], 1).ravel()
        return np.add.reduceat(np.append(cost, np.zeros((1, len(self.langs)), np.float32), 0), edges, dtype=np.float64)[::2]


def _grams(stream: np.ndarray, order: int) -> np.ndarray:
    """Every byte with the `order` bytes before it, as one integer."""
    out = stream[order:].copy()
    for i in range(1, order + 1):
        out |= stream[order - i : len(stream) - i] << np.uint32(8 * i)
    return out


def train(df: DataFrame, learn: Column, *, key: str = "doc_id", text: str = "text", lang: str = "lang", docs: int = TRAIN_DOCS, chars: int = TRAIN_CHARS) -> ContextTrees:
    """The model from a bounded sample, spread by a hash of key and text, of the rows for which learn holds and lang isn't null.

    Repeated rows count once in it, and rows that share a key are drawn one by one, so however often a key occurs the
    sample is bounded.
    """
    from_ = df.where(learn & F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = {r.l: r.n for r in from_.groupBy(F.col(lang).alias("l")).agg(F.count("*").alias("n")).collect()}
    if not counts:
        return ContextTrees({})
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, docs / n))])
    drawn = (F.pmod(F.xxhash64(F.lit("lang"), F.col(key), F.col(text)), F.lit(1 << 20)) / F.lit(1 << 20)) < share[F.col(lang)]
    texts: dict[str, list[bytes]] = {k: [] for k in counts}
    for r in from_.where(drawn).select(F.col(lang).alias("l"), spread(F.col(text), chars).alias("t")).distinct().toLocalIterator():
        texts[r.l].append(r.t.encode())
    return ContextTrees({k: sorted(v) for k, v in texts.items()})


def predict(df: DataFrame, model: ContextTrees, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of df: key, lang_pred, score, from the whole text only."""
    bound_batches(df.sparkSession)
    data = pickle.dumps(model)
    shared, ident = df.sparkSession.sparkContext.broadcast(data), hashlib.sha256(data).hexdigest()

    def score(batches):
        model = worker_state(ident, lambda: pickle.loads(shared.value))
        for batch in batches:
            texts = batch.column(1).to_pylist()
            langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            for a, b in work_slices([len(t or "") for t in texts], 500_000):
                own = [i for i in range(a, b) if texts[i] and model.langs and _LETTER.search(texts[i])]
                if own:
                    bits = model.bits([texts[i].encode("utf-8", "surrogatepass") for i in own])
                    best = bits.argmin(1)
                    scores[own] = 1 / np.exp2(np.maximum(bits.min(1, keepdims=True) - bits, -1000)).sum(1)
                    for i, k in zip(own, best, strict=True):
                        langs[i] = model.langs[k]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs), pa.array(scores)], ["k", "lang_pred", "score"])

    kind = df.select(F.col(key).alias("k")).schema[0].dataType.simpleString()
    out = df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(score, f"k {kind}, lang_pred string, score double")
    return out.withColumnRenamed("k", key)


def language_id(df: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = 4, held_out: int = 2) -> DataFrame:
    """Per row of df: key, held_out, lang_pred, score; learned from the rows outside the held-out fold.

    lang_pred is `und` with score 0 for null texts, texts without letters, and if nothing could be learned; the score
    is else the posterior of the best language under equal priors. Ties go to the language that sorts first. A null
    key counts as the empty text for the fold. Repeated rows give repeated rows, an empty table an empty one; other
    columns are ignored whatever their names. Two scans for the sample and one for the prediction; no shuffle of texts.
    """
    model = train(df, remainder(F.col(key), folds) != held_out, key=key, text=text, lang=lang)
    return predict(df, model, key=key, text=text).select(key, (remainder(F.col(key), folds) == held_out).alias("held_out"), "lang_pred", "score")
