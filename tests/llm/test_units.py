import random
import time

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm.bpe import pieces
from tidemark.llm.decontam import ItemIndex, question_answer, words
from tidemark.llm.embed_dedup import PARTS, Rotation, links_in_blocks, unit
from tidemark.llm.langid import ContextTrees
from tidemark.llm.line_dedup import bounds, chunks
from tidemark.llm.minhash_dedup import aligned, links_in_block, shingles, sketches
from tidemark.llm.quality import QualityModel
from tidemark.llm.suffix_dedup import anchors
from tidemark.llm.suffixes import _named_order, permuted_matches, suffix_array
from tidemark.llm.token_counts import PieceCounter, read_model
from tidemark.llm.token_output import PieceEncoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", None, " ", "  a", "x<|endoftext|>y <|endoftext|>", "<|endoftext|> x", "a" * 300, "日本語 テキスト 😀", "it's we'll I'VE", "a\x85b \x85 c", "\x1c a\x1d b", "a \n b\n", "\r\n\t x"]


def odd_texts():
    r = random.Random(1)
    return ODD + ["".join(r.choice(" \n\t  abcdeé日😀'1²_-.,<|>") for _ in range(r.randint(0, 40))) for _ in range(2000)]


def test_tokens_are_those_of_the_library():
    library = Tokenizer.from_file(PATH)
    ids = [x.ids for x in library.encode_batch([t or "" for t in odd_texts()], add_special_tokens=False)]
    assert PieceCounter(read_model(PATH))(odd_texts()).tolist() == [len(x) for x in ids]
    assert [x.tolist() for x in PieceEncoder(read_model(PATH))(odd_texts())] == ids


def test_pieces_join_to_the_text():
    for t in odd_texts():
        assert " ".join(pieces(t or "")) == (t or "")


@pytest.mark.parametrize("seed", range(60))
def test_suffix_arrays_and_matches(seed):
    r = np.random.default_rng(seed)
    t = r.integers(0, r.integers(1, 5) + 1, r.integers(1, 80)).astype(np.uint8)
    b = (np.tile(t, 3) if seed % 3 == 0 else t).tobytes()
    t = np.frombuffer(b, np.uint8)
    order = suffix_array(t)
    assert order.tolist() == sorted(range(len(b)), key=lambda i: b[i:])
    whole = order[order + 9 <= len(b)]
    assert permuted_matches(t, whole, 9).tolist() == [k > 0 and b[whole[k] :][:9] == b[whole[k - 1] :][:9] for k in range(len(whole))]


def test_suffix_arrays_of_long_runs_and_periods():
    for b in (b"a" * 3000, b"ab" * 1500, bytes(range(97, 117)) * 150, b"b" + b"a" * 2000 + b"b" * 500 + b"ab" * 300):
        t = np.frombuffer(b, np.uint8)
        assert suffix_array(t).tolist() == sorted(range(len(b)), key=lambda i: b[i:])
        shallow = [b[i : i + 50] for i in suffix_array(t, 50).tolist()]
        assert shallow == sorted(shallow)


@pytest.mark.parametrize("seed", range(30))
def test_names_are_sorted_recursively(seed):
    r = np.random.default_rng(seed)
    names = np.repeat(r.integers(0, 4, 40), r.integers(1, 5, 40))
    assert _named_order(np.unique(names, return_inverse=True)[1], None).tolist() == sorted(range(len(names)), key=lambda i: names[i:].tolist())


def test_a_run_of_one_byte_costs_its_length():
    began = time.process_time()
    suffix_array(np.full(1 << 20, 97, np.uint8), 50)
    assert time.process_time() - began < 5


def test_equal_strings_have_equal_anchors():
    r = random.Random(2)
    shared = bytes(r.randrange(256) for _ in range(70))
    a, b = (bytes(r.randrange(256) for _ in range(n)) + shared + bytes(r.randrange(256) for _ in range(n)) for n in (13, 41))
    assert anchors(a)[13:34].tolist() == anchors(b)[41:62].tolist()
    assert len(anchors(b"x" * 49)) == 0 and len(anchors(b"x" * 50)) == 1


def test_alignment_and_sketches():
    text = " ".join(f"w{i}" for i in range(300))
    one = text.replace("w150 ", "other ")
    a, b = shingles(text), shingles(one)
    assert aligned(a, a) == 1 and aligned(a, b) == pytest.approx(291 / 301)
    assert set(sketches(a)) & set(sketches(b))
    swapped = " ".join(text.split()[150:] + text.split()[:150])
    assert aligned(a, shingles(swapped)) < 0.8
    assert links_in_block([1, 2, 3], [a, b, shingles(swapped)]) == [(1, 2)]
    assert len(shingles("")) == len(shingles(None)) == 0 and len(shingles("one two")) == 1
    assert len(set(shingles("a b c d e " * 9).tolist())) == 41


def test_line_chunks_resist_shifts():
    r = random.Random(3)
    lines = [f"line {r.random()}" for _ in range(60)]
    whole = {p for _, p, _ in chunks("\n".join(lines))}
    moved = {p for _, p, _ in chunks("\n".join(["new"] * 3 + lines))}
    assert len(whole & moved) >= len(whole) - 2
    assert chunks(None) == chunks("") == chunks("only one line") == [] and bounds([]) == []


def test_vectors_against_all_pairs():
    r = np.random.default_rng(4)
    base = r.standard_normal((40, 64))
    x = unit(np.concatenate([base + 0.08 * r.standard_normal((40, 64)) for _ in range(20)]))
    turn = Rotation(x)
    parts = turn.parts(x)
    true = np.triu(x @ x.T >= 0.98, 1)
    links = np.zeros(len(x), np.int64)
    from tidemark.llm.embed_dedup import tables

    for t, (a, b) in enumerate(tables()):
        code = parts[:, a] * 256 + parts[:, b]
        order = np.argsort(code, kind="stable")
        n = len(x)
        got, span = links_in_blocks(code[order], np.zeros(n, bool), np.ones(n, bool), np.full(n, t), np.ones(n, np.int64), x[order], parts[order])
        links[order] += got
        assert all(true[tuple(sorted((order[i], order[j])))] for i, j in span)
    assert parts.shape == (800, PARTS) and links.sum() <= 2 * true.sum() and links.sum() >= 0.9 * 2 * true.sum()


def test_wand_finds_all_that_scoring_everything_finds():
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(200)]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randint(5, 60)))) for i in range(150)]
    index = ItemIndex(items)
    for _ in range(60):
        passage = {r.choice(vocabulary) for _ in range(60)}
        terms = sorted(index.terms[w] for w in passage if w in index.terms)
        scores: dict[int, float] = {}
        for t in terms:
            for d, x in zip(index.docs[t], index.impacts[t], strict=True):
                scores[d] = scores.get(d, 0) + x
        assert sorted(d for d, _ in index.retrieve(terms)) == sorted(d for d, s in scores.items() if s >= 1 - 1e-9)
    found = index.hits([words("before it " + items[3][1] + " after it"), [], words("nothing here")])
    assert 3 in [x[0] for x in found[0]] and found[1:] == [[], []]
    assert question_answer("One two three four. Five six seven eight nine.")[1] == ["five", "six", "seven", "eight", "nine"]


def test_code_lengths_are_proper():
    m = ContextTrees({"a": [b"the cat sat on the mat " * 5], "b": [b"le chat est sur le tapis " * 5]})
    for context in (b"the", b"xyz", b"le "):
        bits = np.array([m._cost(np.array([int.from_bytes(context + bytes([c]), "big")], np.uint32), 3)[0] for c in range(256)])
        assert np.allclose((2.0 ** -bits.astype(float)).sum(0), 1, atol=1e-3)
    assert m.bits([b"the mat", b"le tapis"]).argmin(1).tolist() == [0, 1]


def test_quality_without_examples_gives_the_rate():
    m = QualityModel([], [])
    assert (m.b, m.a) == (0.0, 0.0)


def test_windows_lie_over_the_whole_text(spark):
    from tidemark.llm.common import spread

    texts = ["", "short", "x" * 60, "".join(chr(97 + i // 100) for i in range(1000)), None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(spread(F.col("t"), 60, 6).alias("s")).collect()
    assert [r.s for r in rows[:3]] == texts[:3] and rows[4].s is None
    assert rows[3].s == "".join(texts[3][i * 990 // 5 : i * 990 // 5 + 10] for i in range(6)) and rows[3].s[-1] == texts[3][-1]


def test_strings_of_a_hot_anchor_come_in_bounded_slices():
    """Eight megabytes under one anchor: every string once, a few megabytes at a time, in little more memory than that."""
    import tracemalloc

    import pyarrow as pa

    from tidemark.llm.suffix_dedup import STRING_BYTES, Parts

    r = np.random.default_rng(3)
    texts = [r.integers(0, 256, n, np.uint8).tobytes() for n in (50, 49, 4000, 8 << 20)]
    table = pa.table({"anchor": pa.array([1] * 4, pa.int64()), "k": pa.array([1, 2, 3, 4], pa.int64()), "r": pa.array([0] * 4, pa.int64()), "at": pa.array([7, 0, 100, 5], pa.int64()), "part": pa.array(texts, pa.binary())})
    parts = Parts(table)
    tracemalloc.start()
    n = 0
    for batch in parts.strings(50):
        assert batch.num_rows * 50 <= STRING_BYTES
        for i in {0, batch.num_rows // 2, batch.num_rows - 1}:
            k, _, a, _, _, s = (c[i].as_py() for c in batch.columns)
            at = {1: 7, 3: 100, 4: 5}[k]
            assert texts[k - 1][a - at : a - at + 50] == s
        n += batch.num_rows
    assert n == 1 + 3951 + (8 << 20) - 49
    assert tracemalloc.get_traced_memory()[1] < 40 << 20
    tracemalloc.stop()


def test_only_parts_that_share_a_string_enter_a_suffix_array(monkeypatch):
    """A thousand different parts under one anchor, and two that share a string with another owner's."""
    import pyarrow as pa

    from tidemark.llm import suffix_dedup

    r = np.random.default_rng(5)
    texts = [r.integers(0, 256, 80, np.uint8).tobytes() for _ in range(1000)]
    texts[700] = texts[700][:10] + texts[300][20:70] + texts[700][:20]
    texts[900] = texts[300][:49] + texts[900][:31]
    n, entered = len(texts), []
    table = pa.table({"anchor": pa.array([1] * n, pa.int64()), "k": pa.array(range(n), pa.int64()), "r": pa.array([0] * n, pa.int64()), "at": pa.array([5] * n, pa.int64()), "part": pa.array(texts, pa.binary())})
    whole = suffix_dedup.least_owners
    monkeypatch.setattr(suffix_dedup, "least_owners", lambda t, lens, owner, length: entered.append(owner.tolist()) or whole(t, lens, owner, length))
    found = suffix_dedup.Parts(table).judged(50).to_pydict()
    assert entered == [[300, 700]]
    assert (found["k"], found["a"], found["b"]) == ([700], [15], [65])


def test_equal_strings_have_equal_hashes():
    from tidemark.llm.suffix_dedup import string_hashes

    r = np.random.default_rng(4)
    rows = r.integers(0, 256, (20_000, 50), np.uint8)
    h = string_hashes(rows)
    assert (string_hashes(rows[::-1].copy())[::-1] == h).all() and len(np.unique(h)) == len(rows)
    one = rows[:1].repeat(400, 0)
    one[np.arange(400), np.arange(400) % 50] ^= np.uint8(1) << (np.arange(400) % 8).astype(np.uint8)
    assert len(np.unique(string_hashes(one))) == len(np.unique(one, axis=0))
