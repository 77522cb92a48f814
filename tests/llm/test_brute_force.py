"""Operators against brute force or held-out accuracy, on tables of their own and on the small shared ones."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontam, minhash_dedup
from tidemark.llm.common import bound_batches, worker_state
from tidemark.llm.decontam import ItemIndex, contained, contamination, words
from tidemark.llm.embed_dedup import near_vectors
from tidemark.llm.langid import language_id
from tidemark.llm.line_dedup import dedup_lines, pieces, split_lines
from tidemark.llm.minhash_dedup import aligned, near_duplicates, shingles, word_hashes
from tidemark.llm.quality import quality_scores
from tidemark.llm.suffix_dedup import remove_repeats

SMALL = "/root/testdata/sf0.01"


def classes(links, nodes):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {x: find(x) for x in nodes}


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def held_out(key, n, which):
    return zlib.crc32(str(key).encode()) % n == which


def test_quality_on_held_out_documents(spark, documents):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    got = {r.doc_id: r for r in quality_scores(documents, labels).collect()}
    own = {r.doc_id: r.quality for r in labels.collect() if r.quality is not None and r.doc_id in got}
    out = [k for k in own if held_out(k, 5, 0)]
    assert all(got[k].held_out == held_out(k, 5, 0) for k in got)
    assert len(out) > 30 and sum(got[k].predicted == own[k] for k in out) / len(out) >= 0.9


def test_language_on_held_out_documents(documents):
    got = {r.doc_id: r for r in language_id(documents).collect()}
    out = [r for r in documents.collect() if r.lang is not None and held_out(r.doc_id, 4, 2) and got[r.doc_id].lang_pred != "und"]
    assert len(out) > 100 and sum(got[r.doc_id].lang_pred == r.lang for r in out) / len(out) >= 0.97


def lines_by_brute_force(rows):
    """What dedup_lines promises, from all pieces of all texts in one dictionary."""
    firsts, times = {}, Counter()
    own = {k: split_lines(t) for k, t in rows}
    for k in sorted(own):
        for a, _, part in pieces(own[k]):
            firsts.setdefault(part, (k, a))
            times[part] += 1
    out = {}
    for k, lines in own.items():
        gone, ends = [False] * len(lines), {}
        for a, b, part in pieces(lines):
            ends[a, part] = b
            if firsts[part] != (k, a) and (firsts[part][0] != k or ends[firsts[part][1], part] <= a):
                gone[a:b] = [True] * (b - a)
        out[k] = b"".join(x for x, g in zip(lines, gone, strict=True) if not g)
    return {k: (len(own[k]), sum(1 for _ in own[k]) - out[k].count(b"\n") - (1 if out[k] and not out[k].endswith(b"\n") else 0), hashlib.sha256(v).hexdigest()) for k, v in out.items()}


def test_lines_of_the_small_table(documents):
    got = {r.doc_id: (r.n_lines, r.n_removed_lines, r.kept_sha256) for r in dedup_lines(documents).collect()}
    assert got == lines_by_brute_force([(r.doc_id, r.text) for r in documents.collect()])


def test_hits_of_every_passage_and_item(spark, documents):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    index = ItemIndex(items)
    want = set()
    for r in documents.select("doc_id", "text").collect():
        own = words(r.text)
        lens = np.array([len(own)])
        for _, a, b in zip(*(x.tolist() for x in index.passages(lens)), strict=True):
            terms = sorted({index.terms[w] for w in own[a:b] if w in index.terms})
            # every passage is asked, without the first bound, and by adding up every part's score
            scores = Counter()
            for t in terms:
                for d, x in zip(index.docs[t], index.impacts[t], strict=True):
                    scores[d] += x
            full = {d for d, x in scores.items() if x >= 1 - 1e-9}
            assert {d for d, _ in index.retrieve(terms)} == full
            for d in full:
                key, question, answer, of_item = index.items[index.part_item[d]]
                near = own[max(0, a - len(of_item)) : b + len(of_item)]
                if contained(question, near) >= decontam.QUESTION and contained(answer, near) >= decontam.ANSWER:
                    want.add((r.doc_id, key))
    got = [(r.doc_id, r.item_id) for r in contamination(documents, spark.read.parquet(f"{SMALL}/benchmark.parquet")).collect()]
    assert want and len(got) == len(set(got)) and set(got) == want


def near_by_brute_force(rows):
    """Classes from the alignment of all pairs of different texts that share a shingle."""
    texts = {}
    for k, t in rows:
        if t:
            texts.setdefault(t, []).append(k)
    own = [(min(ks), shingles(t)) for t, ks in texts.items()]
    by_shingle = {}
    for i, (_, s) in enumerate(own):
        for x in s.tolist():
            by_shingle.setdefault(x, []).append(i)
    shared = Counter((i, j) for m in by_shingle.values() for n, i in enumerate(m) for j in m[n + 1 :])
    links = [(own[i][0], own[j][0]) for (i, j), n in shared.items() if n / (len(own[i][1]) + len(own[j][1]) - n) >= 0.8 and aligned(own[i][1], own[j][1]) >= 0.8]
    links += [(ks[0], k) for ks in texts.values() for k in ks[1:]]
    return classes(links, [k for k, _ in rows])


def test_near_duplicates_of_the_small_table(documents):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    assert {r.doc_id: r.class_id for r in near_duplicates(documents).collect()} == near_by_brute_force(rows)


def test_near_duplicates_in_any_order_and_blocks(spark, monkeypatch):
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]

    def copy(own, n):
        own = list(own)
        for _ in range(n):
            own[r.randrange(len(own))] = r.choice(vocabulary)
        return " ".join(own)

    base = [[r.choice(vocabulary) for _ in range(200)] for _ in range(3)]
    rows = [(i, copy(base[i % 3], r.choice([0, 1, 2, 4, 9]))) for i in range(120)] + [(500, copy(base[0], 1)), (500, copy(base[1], 1)), (501, ""), (502, None), (503, "one two")]
    want = near_by_brute_force(rows[:-5])
    for block, size in ((512, 1 << 18), (7, 1 << 18), (512, 1500)):
        monkeypatch.setattr(minhash_dedup, "BLOCK", block)
        monkeypatch.setattr(minhash_dedup, "BLOCK_SHINGLES", size)
        for seed in (1, 2):
            random.Random(seed).shuffle(rows)
            got = {(x.doc_id, x.class_id) for x in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(seed + 1)).collect()}
            assert len(got) == 124 and {(k, v) for k, v in got if v != k and k < 500} == {(k, v) for k, v in classes([(k, v) for k, v in want.items()] + [(0, 1), (0, 500)], [*want, 500]).items() if v != k and k < 500}
            assert (500, 0) in got and {(501, 501), (502, 502), (503, 503)} <= got


def test_a_large_group_of_near_copies_and_a_very_long_text(spark):
    r = random.Random(4)
    base = [f"v{r.randrange(5000)}" for _ in range(150)]
    rows = [(i, " ".join([*base, f"end{i}"])) for i in range(2100)]
    long_text = " ".join(f"x{i % 9973}y{i % 61}" for i in range(2_000_000))
    assert len(long_text) > 16 << 20
    rows += [(9000, long_text), (9001, long_text + " more words at the end")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {x.doc_id: x.class_id for x in near_duplicates(df).collect()}
    assert got == {**{i: 0 for i in range(2100)}, 9000: 9000, 9001: 9000}


def test_words_of_a_text_cut_into_parts(monkeypatch):
    text = "Ab cd-ef " * 50 + "x" * 300 + " Ende ÄÖ"
    whole = word_hashes(text)
    monkeypatch.setattr(minhash_dedup, "PART", 17)
    assert word_hashes(text).tolist() == whole.tolist()


def vectors_by_brute_force(rows):
    x = np.array([v for _, v, _ in rows], np.float64)
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    label = np.array([g for _, _, g in rows])
    near = (x @ x.T >= 0.98) & (label[:, None] == label)
    np.fill_diagonal(near, False)
    keys = [k for k, _, _ in rows]
    comps = classes([(keys[i], keys[j]) for i, j in zip(*np.nonzero(near), strict=True)], keys)
    return {k: (int(n), comps[k]) for k, n in zip(keys, near.sum(1), strict=True)}


def test_vectors_of_dense_groups_over_several_blocks(spark):
    r = np.random.default_rng(6)
    rows = []
    for g in range(6):
        centre = r.standard_normal(64)
        for i in range(450 if g < 2 else 60):  # the first groups are larger than a block
            rows.append((len(rows), (centre + r.standard_normal(64) * r.choice([0.01, 0.1, 0.2])).astype(np.float32).tolist(), g % 2))
    rows += [(len(rows) + i, r.standard_normal(64).astype(np.float32).tolist(), i % 3) for i in range(300)]
    want = vectors_by_brute_force(rows)
    got = {x.vec_id: (x.n_links, x.component_id) for x in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(5)).collect()}
    found, all_links = sum(n for n, _ in got.values()), sum(n for n, _ in want.values())
    assert all_links > 100_000 and 0.99 * all_links <= found <= all_links
    assert sum(got[k][1] == want[k][1] for k in want) >= 0.99 * len(want)


def repeats_by_brute_force(rows, length=50):
    own, first = [(k, (t or "").encode()) for k, t in rows], {}
    for k, t in own:
        if k is not None:
            for i in range(len(t) - length + 1):
                first[t[i : i + length]] = min(k, first.get(t[i : i + length], k))
    out = []
    for k, t in own:
        gone, to = [], 0
        for i in range(len(t) - length + 1 if k is not None else 0):
            if first[t[i : i + length]] < k:
                gone += range(max(i, to), i + length)
                to = i + length
        lost = set(gone)
        rest = bytes(x for j, x in enumerate(t) if j not in lost)
        out.append((k, len(t), len(gone), sum(1 for j in gone if j - 1 not in lost), hashlib.sha256(rest).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("shard", [1 << 20, 3000, 600])
def test_repeated_strings_over_shards_and_hot_anchors(spark, shard):
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9))) for _ in range(60)]

    def prose(n):
        return " ".join(r.choice(vocabulary) for _ in range(n))

    base, hot, rows = prose(40), "https://www.example.com/a/very/common/prefix?", []
    for i in range(160):
        parts = [prose(r.randint(0, 40))]
        if i % 3 == 0:
            parts.append(base[r.randint(0, 50) : r.randint(100, len(base))])
        if i % 4 == 0:
            parts.append(hot + prose(3))  # one anchor with many distinct parts
        if i % 17 == 0:
            parts.append("ab" * r.randint(30, 2500))
        if i % 23 == 0:
            parts.append("x" * r.randint(40, 6000))
        r.shuffle(parts)
        rows.append((r.randint(0, 120), " ".join(parts)))
    rows += [(None, base * 3), (5, None), (6, ""), (7, "x" * 49), (8, "x" * 50), (9, "é" * 26)] + rows[:10]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = remove_repeats(df, shard_bytes=shard)
    assert sorted([tuple(x) for x in got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()], key=str) == repeats_by_brute_force(rows)


def test_a_megabyte_of_one_byte(spark):
    rows = [(1, "a" * (1 << 20)), (2, "a" * 100 + "b" * 100), (3, "b" * (1 << 20))]
    got = {x.doc_id: (x.n_removed, x.n_spans) for x in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (0, 0), 2: (100, 1), 3: (1 << 20, 1)}


def test_session_settings_are_only_lowered(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "7")
        bound_batches(spark)
        assert spark.conf.get(name) == "7"
        spark.conf.set(name, "1000000")
        bound_batches(spark)
        assert spark.conf.get(name) == "2000"
    finally:
        spark.conf.set(name, before)


def test_a_worker_keeps_one_state():
    made = []

    def make(x):
        return lambda: made.append(x) or x

    assert [worker_state(x, make(x)) for x in ("a", "a", "b", "a")] == ["a", "a", "b", "a"] and made == ["a", "b", "a"]
