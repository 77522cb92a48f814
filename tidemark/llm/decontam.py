"""Operator 6: benchmark decontamination with a BM25 index of the test items and block-max WAND."""

from __future__ import annotations

import hashlib
import math
import pickle
import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bound_batches, work_slices, worker_state

#: BM25's constants, and the share of an item's own score that a passage must reach to be retrieved.
K1, B, LEAST_SCORE = 1.2, 0.75, 0.6
#: Words in a shingle; shares of the question's and of the answer's shingles that must stand in the passage.
SHINGLE, QUESTION, ANSWER = 5, 0.8, 0.5
#: Longer items enter the index in parts of so many words; a passage is twice as long as the longest part, by half steps.
PART_WORDS = 256
#: Postings whose maximum is kept together; share of the asked score that a part's commonest words may make up together
#: to be left out of the first bound.
BLOCK, COMMON = 32, 0.6
#: Items and characters of one index, which every worker holds; more items make more indexes and passes.
INDEX_ITEMS, INDEX_CHARS = 20_000, 16 << 20
_WORD = re.compile(r"[^\W_]+")
_SENTENCE = re.compile(r"(?<=[.!?\n])\s+")


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def question_answer(text: str) -> tuple[list[str], list[str]]:
    """The words of an item's question and of its answer.

    The answer is made of the last sentences that have at least SHINGLE words together; if nothing is left of the
    item before them, it is the last third of the words.
    """
    parts = [w for w in (words(s) for s in _SENTENCE.split(text)) if w]
    own = [w for p in parts for w in p]
    n = 0
    while parts and n < SHINGLE:
        n += len(parts.pop())
    if not parts:
        n = max(1, len(own) // 3)
    return own[: len(own) - n] or own, own[len(own) - n :]


def _shingles(own: list[str], size: int = SHINGLE) -> set[tuple[str, ...]]:
    return {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if own else set()


def contained(part: list[str], passage: list[str]) -> float:
    """Share of the part's shingles, of SHINGLE words or of all if it has fewer, that stand in the passage."""
    size = min(SHINGLE, len(part))
    own = _shingles(part, size)
    return len(own & _shingles(passage, size)) / len(own) if own else 1.0


class Statistics:
    """What scores need to know of all items, whatever index they are in: parts, their words, the longest, and in how
    many parts each word stands."""

    def __init__(self):
        self.parts = self.words = self.longest = 0
        self.df: dict[str, int] = {}

    def add(self, items: list[tuple[object, str]]) -> None:
        for _, t in items:
            for part in parts_of(words(t)):
                self.parts += 1
                self.words += len(part)
                self.longest = max(self.longest, len(part))
                for w in set(part):
                    self.df[w] = self.df.get(w, 0) + 1


def parts_of(own: list[str]) -> list[list[str]]:
    return [own[a : a + PART_WORDS] for a in range(0, len(own), PART_WORDS)]


class ItemIndex:
    """Postings of the items' parts. Impacts are BM25 contributions divided by the score that the part asks for, so
    every passage of scaled score 1 or more is retrieved. Parts are numbered by that score, which keeps the bounds of
    neighbours alike. The statistics are those of all items if these are only some of them."""

    def __init__(self, items: list[tuple[object, str]], of_all: Statistics | None = None):
        if of_all is None:
            of_all = Statistics()
            of_all.add(items)
        self.items = [(k, *question_answer(t), words(t)) for k, t in items]
        self.items = [x for x in self.items if x[3]]
        parts = [(i, set(part), part) for i, (_, _, _, w) in enumerate(self.items) for part in parts_of(w)]
        df = {w: of_all.df[w] for _, s, _ in parts for w in s}
        mean = of_all.words / max(1, of_all.parts)
        scored = []
        for i, s, own in parts:
            tf = {w: 0 for w in s}
            for w in own:
                tf[w] += 1
            norm = K1 * (1 - B + B * len(own) / mean)
            impact = {w: math.log(1 + (of_all.parts - df[w] + 0.5) / (df[w] + 0.5)) * n * (K1 + 1) / (n + norm) for w, n in tf.items()}
            scored.append((sum(impact.values()) * LEAST_SCORE, i, impact))
        scored.sort(key=lambda x: (x[0], x[1]))
        self.part_item = [i for _, i, _ in scored]
        self.longest = max(1, of_all.longest)
        self.terms = {w: t for t, w in enumerate(sorted(df))}
        self.docs: list[list[int]] = [[] for _ in self.terms]
        self.impacts: list[list[float]] = [[] for _ in self.terms]
        rare: list[tuple[int, int, float]] = []
        self.need = np.zeros(len(scored))
        for d, (least, _, impact) in enumerate(scored):
            # of every part the commonest words, which make up COMMON at most, are left out of the first bound
            common = 0.0
            for w, x in sorted(impact.items(), key=lambda y: (y[1], y[0])):
                if common + x / least <= COMMON:
                    common += x / least
                else:
                    rare.append((self.terms[w], d, x / least))
            self.need[d] = 1 - common - 1e-6
            for w, x in impact.items():
                t = self.terms[w]
                self.docs[t].append(d)
                self.impacts[t].append(x / least)
        rare.sort()
        self.rare_part = np.array([d for _, d, _ in rare], np.int64)
        self.rare_impact = np.array([x for _, _, x in rare])
        self.rare_from = np.searchsorted(np.array([t for t, _, _ in rare], np.int64), np.arange(len(self.terms) + 2))
        self.most = [max(x) for x in self.impacts]
        self.blocks: list[dict[int, float]] = []
        for own, x in zip(self.docs, self.impacts, strict=True):
            best: dict[int, float] = {}
            for d, v in zip(own, x, strict=True):
                best[d // BLOCK] = max(best.get(d // BLOCK, 0.0), v)
            self.blocks.append(best)

    def retrieve(self, terms: list[int]) -> list[tuple[int, float]]:
        """All parts of scaled score >= 1 for a passage of these distinct terms, by block-max WAND."""
        docs, most, blocks = self.docs, self.most, self.blocks
        cursors = [[docs[t][0], t, 0] for t in terms]
        out = []
        while cursors:
            cursors.sort()
            total, pivot = 0.0, None
            for n, c in enumerate(cursors):
                total += most[c[1]]
                if total >= 1 - 1e-9:
                    pivot = c[0]
                    break
            if pivot is None:
                break
            while n + 1 < len(cursors) and cursors[n + 1][0] == pivot:
                n += 1
            block = pivot // BLOCK
            if sum(blocks[c[1]].get(block, 0.0) for c in cursors[: n + 1]) >= 1 - 1e-9:
                if cursors[0][0] == pivot:
                    score = sum(self.impacts[c[1]][c[2]] for c in cursors[: n + 1])
                    if score >= 1 - 1e-9:
                        out.append((pivot, score))
                    to = pivot + 1
                else:
                    to = pivot
            else:  # no part of this block up to the next cursor can reach the score
                to = (block + 1) * BLOCK
                if n + 1 < len(cursors):
                    to = min(to, cursors[n + 1][0])
                to = max(to, pivot + 1)
            left = []
            for c in cursors[: n + 1]:
                if c[0] < to:
                    own = docs[c[1]]
                    c[2] = bisect_left(own, to, c[2])
                    if c[2] == len(own):
                        continue
                    c[0] = own[c[2]]
                left.append(c)
            cursors = left + cursors[n + 1 :]
        return out

    def passages(self, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, first and end word of the passages of documents of so many words."""
        size = 2 * self.longest
        step = self.longest
        n = np.maximum(1, -(-(lens - size) // step) + 1)
        doc = np.repeat(np.arange(len(lens)), n)
        first = (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * step
        return doc, first, np.minimum(first + size, lens[doc])

    def _worth_asking(self, ids: np.ndarray, lens: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Passages in which some part's rarer words reach what the part asks for less all its common words: no other
        passage can reach a score of 1."""
        count = np.diff(self.rare_from)
        at = np.flatnonzero(count[ids])
        owner = np.repeat(np.arange(len(lens)), lens)[at]
        step = (at - (np.cumsum(lens) - lens)[owner]) // self.longest
        n = np.bincount(doc, minlength=len(lens))
        start = np.cumsum(n) - n
        here, before = step < n[owner], step > 0
        passage = np.concatenate([(start[owner] + step)[here], (start[owner] + step - 1)[before]])
        term = ids[np.concatenate([at[here], at[before]])]
        both = np.unique(passage * (len(self.terms) + 1) + term)
        passage, term = np.divmod(both, len(self.terms) + 1)
        k = count[term]
        post = np.repeat(self.rare_from[term] - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))
        pair, inverse = np.unique(np.repeat(passage, k) * len(self.need) + self.rare_part[post], return_inverse=True)
        reached = np.bincount(inverse, self.rare_impact[post], len(pair)) >= self.need[pair % len(self.need)] if len(pair) else np.zeros(0, bool)
        return np.unique(pair[reached] // len(self.need))

    def hits(self, texts: list[list[str]]) -> list[list[tuple]]:
        """Per text, of every item found in it: (item key, score in shares of its own, question's share, answer's share)."""
        out: list[list[tuple]] = [[] for _ in texts]
        none = len(self.terms)
        get = self.terms.get
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        ids = np.fromiter((get(w, none) for t in texts for w in t), np.int64, int(lens.sum()))
        doc, first, end = self.passages(lens)
        base = (np.cumsum(lens) - lens)[doc]
        for p in self._worth_asking(ids, lens, doc):
            d, a, b = int(doc[p]), int(first[p]), int(end[p])
            terms = np.unique(ids[base[p] + a : base[p] + b]).tolist()
            if terms and terms[-1] == none:
                terms.pop()
            for part, score in self.retrieve(terms):
                key, question, answer, own = self.items[self.part_item[part]]
                near = texts[d][max(0, a - len(own)) : b + len(own)]
                q, r = contained(question, near), contained(answer, near)
                if q >= QUESTION and r >= ANSWER:
                    out[d].append((key, score * LEAST_SCORE, q, r))
        for d, found in enumerate(out):
            if found:
                best: dict = {}
                for x in found:
                    best[x[0]] = max(best.get(x[0], x), x, key=lambda y: y[1:])
                out[d] = [best[k] for k in sorted(best)]
        return out


def item_blocks(items: DataFrame, key: str, text: str):
    """The items in blocks of bounded size, streamed to the driver one after the other in the order of their keys."""
    block, chars = [], 0
    rows = items.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t")).distinct().orderBy("k", "t")
    for r in rows.toLocalIterator():
        if block and (len(block) >= INDEX_ITEMS or chars + len(r.t) > INDEX_CHARS):
            yield block
            block, chars = [], 0
        block.append((r.k, r.t))
        chars += len(r.t)
    if block:
        yield block


def with_hits(docs: DataFrame, items: DataFrame, *, text: str = "text", item_key: str = "item_id", item_text: str = "text", hits: str = "benchmark_hits") -> DataFrame:
    """docs with an array column: the items found in each row's whole text, with score and overlaps.

    Texts are cut into overlapping passages, and every passage queries the index; what it retrieves is verified by the
    question's and the answer's 5-word shingles. Null and empty texts, and items without words, have no hits. Items with
    a null key have no name to be reported by and are left out: give them one to have them searched for. A column
    of docs that has the name of the new one is replaced. Narrow: no row is moved. Items are indexed in blocks of
    bounded size; more blocks make more passes over the texts within the same job. Words are counted over all items
    first, so scores don't depend on the blocks.
    """
    bound_batches(docs.sparkSession)
    names = [c for c in docs.columns if c != hits]
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    item_kind = items.select(item_key).schema[0].dataType.simpleString()
    own = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]
    names_of_hit = ("item_id", "score", "question", "answer")
    struct = f"array<struct<item_id:{item_kind},score:double,question:double,answer:double>>"
    out = docs.select(F.col(f"`{text}`").alias("t"), *own, F.array().cast(struct).alias("h"))
    of_all, blocks = Statistics(), 0
    for block in item_blocks(items, item_key, item_text):
        of_all.add(block)
        blocks += 1
        first = block if blocks == 1 else None
    for block in item_blocks(items, item_key, item_text) if blocks > 1 else [first] if blocks else []:
        data = pickle.dumps(ItemIndex(block, of_all))
        shared, ident = docs.sparkSession.sparkContext.broadcast(data), hashlib.sha256(data).hexdigest()

        def search(batches, shared=shared, ident=ident):
            index = worker_state(ident, lambda: pickle.loads(shared.value))
            for batch in batches:
                texts, found = batch.column(0).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
                for a, b in work_slices([len(t or "") for t in texts]):
                    for i, new in enumerate(index.hits([words(t) for t in texts[a:b]]), a):
                        if new:
                            both = [tuple(x[c] for c in names_of_hit) for x in found[i] or []] + new
                            best: dict = {}
                            for x in both:  # an item's texts may be in several blocks
                                best[x[0]] = max(best.get(x[0], x), x, key=lambda y: y[1:])
                            found[i] = [dict(zip(names_of_hit, best[k], strict=True)) for k in sorted(best)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, batch.schema.field(batch.num_columns - 1).type)], batch.schema.names)

        out = out.mapInArrow(search, ", ".join(["t string", *[f"c{i} {kinds[c]}" for i, c in enumerate(names)], f"h {struct}"]))
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], F.col("h").alias(hits))


def contamination(docs: DataFrame, items: DataFrame, *, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row for each document and item found in it: key, item_id, score, question, answer.

    Documents without a hit have no row; an empty table of either kind gives none. A null key is carried along;
    repeated rows give repeated rows. The other cases are those of with_hits().
    """
    found = with_hits(docs.select(F.col(key).alias("k"), F.col(text).alias("t")), items, text="t", item_key=item_key, item_text=item_text)
    return found.select(F.col("k").alias(key), F.explode("benchmark_hits").alias("x")).select(key, "x.item_id", "x.score", "x.question", "x.answer")
