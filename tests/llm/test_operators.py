"""Every operator on nulls, empty and long texts, ties, repeated rows, clashing columns and empty tables, and against brute force."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm.components import components
from tidemark.llm.decontam import contamination, with_hits
from tidemark.llm.embed_dedup import near_vectors
from tidemark.llm.langid import language_id
from tidemark.llm.line_dedup import dedup_lines
from tidemark.llm.minhash_dedup import near_duplicates
from tidemark.llm.mixing import mix_documents, mixed
from tidemark.llm.quality import quality_scores
from tidemark.llm.suffix_dedup import remove_repeats
from tidemark.llm.token_counts import token_counts
from tidemark.llm.token_output import read_document, token_output, write_tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
LONG = " ".join(f"word{i % 997} and{i % 31}" for i in range(3000))
SHARED = "one shared passage of many words that stands in several documents and is longer than fifty bytes"
ROWS = [
    (1, f"Intro a.\n{SHARED}\nsecond shared line follows here\nend one", "en", "s1"), (2, f"Other start.\nx\n{SHARED}\nsecond shared line follows here\nend two", "en", "s1"),
    (3, None, None, None), (4, "", "en", None), (5, LONG, "en", "s2"), (6, LONG, "en", "s2"), (7, LONG.replace("word500", "changed"), "fr", "s2"),
    (8, "le chat est sur le tapis " * 8, "fr", "s3"), (9, "12 34 !!", "fr", "s3"), (9, "12 34 !!", "fr", "s3"), (None, "no key here", "en", "s1"), (10, "the cat sat on the mat " * 9, "en", "s3"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    # columns whose names the operators use themselves
    return spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.lit("own") for c in ("k", "t", "n", "h", "score", "size", "n_tokens", "start", "component", "node", "kept", "h1")}).repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_token_counts(docs, none):
    library = Tokenizer.from_file(PATH)
    want = [(k, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for k, t, _, _ in ROWS]
    got = token_counts(docs, PATH)
    assert rows(got, "doc_id", "n_bytes", "n_tokens") == sorted(want, key=str)
    assert {r.over_limit for r in got.where("doc_id = 5").collect()} == {True}
    assert token_counts(none, PATH).count() == 0


def test_token_files_round_trip(spark, docs, none, tmp_path):
    library = Tokenizer.from_file(PATH)
    ordered = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0))
    start, want = 0, []
    for k, t, _, _ in ordered:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((k, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert rows(token_output(docs, PATH), "doc_id", "start", "n_tokens", "ids_crc32") == sorted(want, key=str)
    assert token_output(none, PATH).count() == 0
    write_tokens(docs, PATH, str(tmp_path))
    assert [x.tolist() for x in read_document(spark, str(tmp_path), 8)] == [[*library.encode(ROWS[7][1], add_special_tokens=False).ids, 2]]


def test_line_dedup(docs, none):
    got = {r.doc_id: r for r in dedup_lines(docs).collect()}
    assert got[5].n_removed_lines == 0 and got[3].kept_text == "" and got[None].kept_text == "no key here" and len(got) == 11
    assert dedup_lines(none).count() == 0


def test_repeated_chunks_go_but_the_first(spark):
    block = "\n".join(f"a repeated line number {i} of the block" for i in range(12))
    df = spark.createDataFrame([(i, f"start {i}\n{block}\nend {i}" if i != 3 else block) for i in range(4)], "doc_id long, text string")
    got = {r.doc_id: (r.n_lines, r.n_removed_lines) for r in dedup_lines(df).collect()}
    assert got[0][1] == 0 and all(got[i][1] >= 6 for i in (1, 2, 3))


@pytest.mark.parametrize("n", range(1, 7))
def test_short_passages_go_in_any_surroundings(spark, n):
    r = np.random.default_rng(n)
    data, passages = [], []
    for i in range(30):
        lines = [f"line {i} {j} " + " ".join(map(str, r.integers(0, 99, 60 if n == 1 else 5))) for j in range(n)]
        passages.append(lines)
        data += [(2 * i + side, "\n".join([f"before {i} {side} {x}" for x in range(i % 4)] + lines + [f"after {i} {side} {x}" for x in range(i % 3)])) for side in (0, 1)]
    got = {x.doc_id: x for x in dedup_lines(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    for i, lines in enumerate(passages):
        assert got[2 * i].n_removed_lines == 0 and got[2 * i].kept_text == data[2 * i][1]
        assert got[2 * i + 1].n_removed_lines == n and got[2 * i + 1].n_removed_chunks == 1
        assert not set(lines) & set(got[2 * i + 1].kept_text.split("\n"))


def test_equal_lines_in_a_row_keep_their_first_passage(spark):
    data = [(1, "x\na\na\na\na\ny"), (2, "p\n\na\na\na\nq"), (3, "a"), (4, "b\n\nc\nz"), (5, "b\nc\nw"), (6, "o\nb\n\nc"), (7, "u\r\nv\r\n"), (8, "u\nv\n")]
    got = {x.doc_id: x.kept_text for x in dedup_lines(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got == {**dict(data), 1: "x\na\na\ny", 2: "p\n\nq", 6: "o\n"}


def test_quality(spark, docs, none):
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(1, 11)] + [(None, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    got = quality_scores(docs, labels).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert {r.doc_id: r.held_out for r in got}[5] == (zlib.crc32(b"5") % 5 == 0)
    assert quality_scores(none, labels).count() == 0
    assert {r.score for r in quality_scores(docs, labels.limit(0)).collect()} == {0.5}


def test_language(docs, none):
    got = {r.doc_id: r for r in language_id(docs).collect()}
    assert got[3].lang_pred == got[4].lang_pred == got[9].lang_pred == "und" and got[9].score == 0
    assert {got[k].lang_pred for k in (1, 8, 10)} <= {"en", "fr"}
    assert language_id(none).count() == 0
    assert {r.lang_pred for r in language_id(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_mixing(docs, none):
    got = mixed(docs).collect()
    assert len(got) == len(ROWS) and all(r.taken == r["size"] * r.copies and 0 <= r.copies <= 3 for r in got)
    total = sum(r["size"] for r in got)
    assert sum(r.taken for r in got) <= total and sum({r.source: r.target for r in got}.values()) == pytest.approx(total)
    assert sorted(map(str, got)) == sorted(map(str, mixed(docs.repartition(5)).collect()))
    out = mix_documents(docs)
    assert out.columns == docs.columns and out.count() == sum(r.copies for r in got)
    assert mixed(none).count() == mix_documents(none).count() == 0


def test_mixing_tells_rows_of_a_key_apart_by_their_other_columns(spark):
    data = [(1, f"word {'more ' * 30}", "a", i) for i in range(6)] + [(10 + i, "few words", "b", i) for i in range(4)]
    got = {tuple(sorted(map(tuple, mix_documents(spark.createDataFrame(data, "doc_id long, text string, source string, extra int").repartition(n)).collect()))) for n in (1, 3, 5)}
    assert len(got) == 1


def test_samples_of_repeated_rows_are_bounded(spark):
    rows = [(1, "good text " * 5, 1)] * 50 + [(2, "bad text " * 5, 0)] * 50 + [(3, "good words " * 4, 1), (4, "bad words " * 4, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    got = quality_scores(df.select("doc_id", "text"), df.select("doc_id", "quality")).collect()
    assert len(got) == 102 and all(0 <= r.score <= 1 for r in got)
    assert token_output(df, PATH).count() == 102


def test_decontamination(spark, docs, none):
    items = spark.createDataFrame([(1, SHARED + ". And the answer is five words long."), (2, SHARED), (3, None), (4, ""), (None, "x")], "item_id long, text string")
    assert rows(contamination(docs, items), "doc_id", "item_id") == [(1, 2), (2, 2)]
    assert with_hits(docs, items).columns == [*docs.columns, "benchmark_hits"]
    assert contamination(docs, items.limit(0)).count() == contamination(none, items).count() == 0


def test_scores_do_not_depend_on_the_blocks_of_items(spark, monkeypatch):
    r = np.random.default_rng(6)
    items = [(i // 2, " ".join(f"w{x}" for x in r.integers(0, 40 + 20 * i, 12 + 9 * i))) for i in range(14)]
    data = [(i, f"before {i} " + " ".join(t.split()[: len(t.split()) - i % 3]) + " after it") for i, (_, t) in enumerate(items)] + [(99, " ".join(t for _, t in items))]
    docs, bench = spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")

    def found():
        return sorted((x.doc_id, x.item_id, round(x.score, 9), x.question, x.answer) for x in contamination(docs, bench).collect())

    whole = found()
    assert len(whole) > 14
    for n in (1, 3):
        monkeypatch.setattr("tidemark.llm.decontam.INDEX_ITEMS", n)
        assert found() == whole


def test_suffix_dedup(docs, none):
    data = [(k, (t or "").encode()) for k, t, _, _ in ROWS]
    first: dict[bytes, int] = {}
    for k, b in sorted((x for x in data if x[0] is not None), key=lambda x: x[0]):
        for p in range(len(b) - 49):
            first.setdefault(b[p : p + 50], k)
    want = []
    for k, b in data:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 49 if k is not None else 0):
            if first[b[p : p + 50]] < k:
                gone[p : p + 50] = True
        edges = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        want.append((k, len(b), int(gone.sum()), edges, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    assert rows(remove_repeats(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(want, key=str)
    assert remove_repeats(none).count() == 0


def test_near_duplicates(docs, none):
    got = {r.doc_id: r.class_id for r in near_duplicates(docs).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 5, 7: 5, 8: 8, 9: 9, 10: 10, None: None}
    assert near_duplicates(none).count() == 0


def test_near_duplicates_of_every_text_of_a_key(spark):
    def text(i, change=None):
        return " ".join("other" if j == change else f"w{i} v{i * 7 + j}" for j in range(60))

    data = [(100 + i, text(2 * i + side)) for i in range(20) for side in (0, 1)] + [(200 + j, text(j, 30)) for j in range(40)] + [(100, text(0))] * 5
    for parts in (1, 3):
        got = {(r.doc_id, r.class_id) for r in near_duplicates(spark.createDataFrame(data, "doc_id long, text string").repartition(parts)).collect()}
        assert got == {(100 + i, 100 + i) for i in range(20)} | {(200 + j, 100 + j // 2) for j in range(40)}


def test_copies_without_words_are_one_class(spark):
    data = [(1, "--- !!"), (2, "--- !!"), (3, "--- !"), (4, " "), (5, " "), (6, ""), (7, ""), (8, None), (9, None), (None, "--- !!")]
    got = {r.doc_id: (r.class_id, r.kept) for r in near_duplicates(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got == {**{k: (k, True) for k in (1, 3, 4, 6, 7, 8, 9, None)}, 2: (1, False), 5: (4, False)}


def test_vectors(spark):
    r = np.random.default_rng(1)
    a, b = (r.standard_normal(64).tolist() for _ in range(2))
    near = (np.array(a) + 0.01).tolist()
    data = [(1, a, 1), (2, a, 1), (3, near, 1), (4, a, 2), (5, b, 1), (6, None, 1), (7, [0.0] * 64, 1), (8, [float("nan")] + a[1:], 1), (9, [None] + a[1:], 1), (10, a, None), (11, [], 1), (12, a[:32], 1), (13, [2 * x for x in a], 1)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").withColumns({c: F.lit("own") for c in ("k", "g", "x", "n")})
    got = {x.vec_id: (x.n_links, x.component_id, x.kept) for x in near_vectors(df).collect()}
    assert got == {**{k: (0, k, True) for k in (4, 5, 6, 7, 8, 9, 10, 11, 12)}, 1: (3, 1, True), 2: (3, 1, False), 3: (3, 1, False), 13: (3, 1, False)}
    assert near_vectors(df.limit(0)).count() == 0


def test_links_of_every_vector_of_a_key(spark):
    r = np.random.default_rng(2)
    a, b = r.standard_normal((2, 64))
    data = [(1, a.tolist(), 1), (1, b.tolist(), 1), (1, (a + 0.001).tolist(), 1), (2, (a + 0.01).tolist(), 1), (3, (a + 0.02).tolist(), 1), (4, (b + 0.01).tolist(), 1)]
    got = near_vectors(spark.createDataFrame(data, "vec_id long, embedding array<float>, label int"))
    assert rows(got, "vec_id", "n_links", "component_id") == [(1, 1, 1), (1, 3, 1), (1, 3, 1), (2, 3, 1), (3, 3, 1), (4, 1, 1)]


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(50, 51), (51, 50), (60, 60)], "a long, b long")
    assert dict(rows(components(edges), "node", "component")) == {**{i: 0 for i in range(41)}, 50: 50, 51: 50}
