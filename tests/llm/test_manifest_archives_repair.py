"""Operators 11 to 13 against plain programs and SQL: nulls, ties, repeated rows, long texts, clashing names, empty tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.llm import conversations, merkle, warc
from tidemark.llm.queries import ORACLE_SQL, QUERIES

DIR = "/root/testdata/sf0.001"
CLASH = ("k", "n", "i", "at", "tree", "part", "seq", "digest", "level", "first", "value", "body", "mark", "cost", "symbols")


def clashing(df):
    return df.withColumns({c: F.lit("own") for c in CLASH if c not in df.columns})


# --- operator 11 -------------------------------------------------------------------------------------------------------

def joined(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([joined(*out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def siblings(tree, i):
    out = []
    for nodes in tree[:-1]:
        first = i - i % 3
        out.append(("".join(nodes[first:i]), "".join(nodes[i + 1 : first + 3])))
        i //= 3
    return out


def plain_manifest(rows):
    """rows: (doc_id, text, lang, source, n_chars)."""
    leaf = lambda r, text: joined(*map(field, (r[0], r[3], r[2], r[4], text)))
    names = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    own = {s: sorted((r for r in rows if r[3] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1]))) for s in names}
    trees = {s: levels([leaf(r, r[1]) for r in own[s]]) for s in names}
    top = levels([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, r in enumerate(own[s]):
            path = siblings(trees[s], i) + siblings(top, k)
            text = r[1].replace("\n", "") if r[1] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 else r[1]
            h = leaf(r, text)
            for a, b in path:
                h = joined(a, h, b)
            out.append((r[0], trees[s][0][i], trees[s][-1][0], top[-1][0], joined(*[x for pair in path for x in pair]), h, h == top[-1][0]))
    return Counter(out)


@pytest.mark.parametrize("rows", [
    [(i, f"text {i}\nline", "en", f"s{i % 7}", i) for i in range(200)] + [(i, None if i % 2 else "", None, None, None) for i in range(300, 305)] + [(None, "no\nid", "en", "s1", 1), (None, "no\nid", "en", "s1", 1), (5, "other\ntext", "en", "s5", 1), (7, "text 7\nline", "en", "s0", 7), (7, "text 7\nline", "en", "s0", 7)],
    [(1, "é\n" * 50_000, "fr", "", 3)],
    [(i, "same\ntext", "en", "one", 1) for i in range(28)] + [(900, "x", "en", "é", 1), (901, "x", "en", "z", 1)],
    [(9, "dup\n", "en", "s", 1)] * 40,
])
def test_manifest_is_the_plain_tree(spark, rows):
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).repartition(3)
    assert Counter(map(tuple, merkle.manifest(df).collect())) == plain_manifest(rows)


def test_manifest_of_nothing(spark):
    out = merkle.manifest(spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long"))
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"] and out.count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 26, 27, 28, 100, 365])
def test_mountains_of_ranges_merge_to_the_tree(n):
    """Leaves cut at any places: every node comes out once, and what is open climbs to the same tops."""
    r = random.Random(n)
    digests = [joined(str(i)) for i in range(n)]
    want = levels(digests)
    for _ in range(5):
        cuts = sorted({0, n, *(r.randrange(n + 1) for _ in range(r.randrange(4)))})
        found, waiting = {}, {}
        for a, b in zip(cuts, cuts[1:], strict=False):
            for level, index, digest, is_open in merkle.mountains(a, digests[a:b], n):
                assert (level, index) not in found
                found[level, index] = digest
                if is_open:
                    waiting.setdefault(level, {})[index] = digest
        high = len(want) - 1
        for low in range(0, high, 2):
            for level, index, digest in merkle.climbed(waiting, low, low + 2, n):
                assert (level, index) not in found or found[level, index] == digest
                found[level, index] = digest
        assert found[high, 0] == want[-1][0]
        assert all(want[level][index] == digest for (level, index), digest in found.items())
        assert {k for k in found if k[0]} == {(level, i) for level, nodes in enumerate(want) if level for i in range(len(nodes))}


# --- operator 12 -------------------------------------------------------------------------------------------------------

FAKE = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
BIG = "x" * 200
PAGES = [
    (1, "u", BIG), (2, "u\r\nWARC-Type: evil\r\nContent-Length: 3", BIG), (3, None, None), (4, "é", "é" * 300), (5, "a", FAKE * 3), (6, "a", "pre" + FAKE + "post" * 100),
    (None, "b", BIG), (7, "a", "WARC/1.0\r\n" * 50), (8, "a", "small"), (9, "a", "small"), (10, "a", "WARC/1.0\r\nContent-Length: 99999999999999999999\r\n\r\n" + "z" * 100),
    (10, "a", "dup" * 50), (10, "a", "dup" * 50), (11, "z", "end\r\n\r\n" * 40), (12, "q", FAKE * 3), (13, "q", ""), (14, "q", "y" * 99), (15, "q", "y" * 99), (16, "q", "y" * 100), (17, "q", "y" * 100),
    (18, "long", ("a long page " * 9 + FAKE) * 400),
]


def plain_archive(rows):
    first, out = {}, []
    for p, _, h in rows:
        b = (h or "").encode()
        if len(b) >= 100 and p is not None:
            first[b] = min(first.get(b, p), p)
    for p, _, h in rows:
        b = (h or "").encode()
        f = first.get(b)
        revisit = f is not None and p != f
        out.append((p, len(b), hashlib.sha256(b).hexdigest(), "revisit" if revisit else "response", f if revisit else None))
    return Counter(out)


@pytest.mark.parametrize("size", ["128m", "900"])
def test_archives_read_back_what_was_written(spark, size):
    rows = PAGES + [(100 + i, "h", f"k{i % 7}" * (100 + i % 50) + FAKE) for i in range(80)]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        df = clashing(spark.createDataFrame(rows, "page_id long, url string, html string")).repartition(2)
        assert Counter(map(tuple, warc.archive(df).collect())) == plain_archive(rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_archives_are_warc_files(spark):
    path = warc.write_warc(spark.createDataFrame([(1, "http://a", BIG), (2, "http://b", BIG)], "page_id long, url string, html string").coalesce(1))
    text = "".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    at, kinds = 0, []
    while at < len(text):
        head, _, rest = text[at:].partition("\r\n\r\n")
        assert head.startswith("WARC/1.0\r\n")
        n = int(re.search(r"Content-Length: (\d+)$", head).group(1))
        kinds.append(re.search("WARC-Type: (.*)\r", head).group(1))
        assert rest[n : n + 4] == "\r\n\r\n" and rest.startswith("HTTP/1.1 200 OK\r\n")
        at += len(head) + 4 + n + 4
    assert sorted(kinds) == ["response", "revisit"]
    found = warc.read_warc(spark, path)
    assert found.where("intact").count() == 2 and [r.target_uri for r in found.orderBy("target_uri").collect()] == ["http://a", "http://b"]


def test_pointers_reach_what_a_walk_reaches(spark):
    """Random successors over many byte ranges, against a walk from each file's start."""
    r = random.Random(6)
    rows = []
    for file in ("a", "b", "c"):
        at = sorted(r.sample(range(1, 4000), 300)) if file != "c" else [7, 9]
        at = [0, *at] if file != "c" else at  # c doesn't start with a record
        rows += [(file, x // 100 * 100, x, r.choice([y for y in at if y > x][:4] + [x + 1]) if any(y > x for y in at) else 5000) for x in at]
    step = {(f, x): s for f, _, x, s in rows}
    want = set()
    for file in "abc":
        x = 0
        while (file, x) in step:
            want.add((file, x))
            x = step[file, x]
    found = warc.reachable(spark.createDataFrame(rows, "file string, block long, at long, succ long"))
    assert {tuple(x) for x in found.collect()} == want


def test_archive_of_nothing(spark):
    assert warc.archive(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# --- operator 13 -------------------------------------------------------------------------------------------------------

NEXT = {"0": {"s": "1", "u": "2"}, "1": {"u": "2"}, "2": {"a": "3"}, "3": {"u": "2"}}
FULL = {"u": "user", "a": "assistant"}


def plain_rows(rows):
    ids = {}
    for c, t, role, text in rows:
        out = ids.setdefault(c, [])
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if k:
            text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
            out += [(t, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return {c: sorted(own, key=lambda z: (z[0] is not None, z[0] or 0, z[1].encode(), hashlib.sha256(f"{len(z[1].encode())}:{z[1]}{z[2]}".encode()).digest()[:16])) for c, own in ids.items()}


def plain_repair(rows):
    """Least (cost, audit) from every row and grammar state on, from the end."""
    out = {}
    for c, own in plain_rows(rows).items():
        faults, seen = [], set()
        for _, role, text in own:
            core = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("b" if not core else "d" if (role, text) in seen else "t" if core[-1] not in ".!?" else "")
            seen.add((role, text))
        best = {q: (0 if q in "03" else 10**9, "", ()) for q in "0123"}

        def inserted(best):
            for _ in range(4):
                for q, to in NEXT.items():
                    for role in set(to) & set("ua"):
                        z = best[to[role]]
                        best[q] = min(best[q], (z[0] + 5, "I" + z[1], (FULL[role] + ":", *z[2])), key=lambda x: x[:2])
            return best

        best = inserted(best)
        for (_, role, text), fault in zip(reversed(own), reversed(faults), strict=True):
            now = {}
            for q, to in NEXT.items():
                z = best[q]
                options = [(z[0] + 2, "D" + z[1], z[2])]
                if fault not in ("b", "d"):
                    late = 5 * (fault == "t")
                    if role[:1] in to:
                        z = best[to[role[:1]]]
                        options.append((z[0] + late, "K" + z[1], (f"{role}:{text}", *z[2])))
                    for g in set(to) & set("ua"):
                        z = best[to[g]]
                        options.append((z[0] + late + 1, "R" + z[1], (f"{FULL[g]}:{text}", *z[2])))
                now[q] = min(options, key=lambda x: x[:2])
            best = inserted(now)
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        bad = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        cost, audit, lines = best["0"]
        out[c] = (gaps, *(faults.count(f) for f in "bdt"), bad, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def conversation_rows():
    r = random.Random(1)
    rows = []
    for c, n in [(0, 1), (1, 2), (2, 5), (3, 9), (4, 60), (5, 300), (6, 3), (None, 40), *((i, 4) for i in range(10, 40))]:
        for t in range(n):
            rows.append((c, r.choice([t, t, t, None, t * 3]), r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "usher"]), r.choice(["Hi.", "no end", "", " \n", None, "What?", "a" * 50 + "!", " ", f"own {c} {t}.", f"own {t}"])))
    return [*rows, (50, 0, "user", "long " * 40_000 + "end."), (50, 1, "assistant", "yes."), *[(51, 3, "user", "the same.")] * 3]


def test_repair_is_the_cheapest_and_least(spark):
    rows = conversation_rows()
    df = clashing(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).repartition(3)
    got = conversations.repair_conversations(df).collect()
    assert {r.conv_id: tuple(r)[1:] for r in got} == plain_repair(rows) and len(got) == len(plain_repair(rows))


def test_conversations_that_lose_all_rows_and_none_at_all(spark):
    turn = next(t for t in range(1000) if zlib.crc32(f"7:{t}".encode()) % 20 == 0)
    schema = "conv_id long, turn long, role string, text string"
    got = conversations.repair_conversations(spark.createDataFrame([(7, turn, "user", "gone.")], schema)).collect()
    assert [tuple(r) for r in got] == [(7, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert conversations.repair_conversations(spark.createDataFrame([], schema)).count() == 0


def test_ranges_give_what_the_whole_gives():
    """A conversation cut anywhere: matrices give the costs, entry states the same audit."""
    r = random.Random(2)
    for _ in range(60):
        symbols = "".join(r.choice("xsuaoSUAO") for _ in range(r.randrange(1, 25)))
        whole = conversations.Determinised()
        states, costs = whole.scan(symbols)
        edits, q = whole.trace(symbols, states)
        cuts = sorted({0, len(symbols), *(r.randrange(len(symbols) + 1) for _ in range(3))})
        parts = [symbols[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        own, v, after = conversations.Determinised(), conversations.END, []
        for part in reversed(parts):
            after.append(v)
            v = conversations.before(own.matrix(part), v)
        assert v == costs
        state, found = 0, []
        for part, end in zip(parts, reversed(after), strict=True):
            more, state = own.trace(part, own.scan(part, end)[0], state)
            found += more
        assert found == edits and state == q


# --- queries against their SQL ---------------------------------------------------------------------------------------------

@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op12_warc", "op13_conversation_repair"])
def test_queries_equal_their_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    cursor = c.execute(ORACLE_SQL[name])
    columns = [d[0] for d in cursor.description]
    df = QUERIES[name](spark, DIR)
    assert sorted(df.columns) == sorted(columns)
    assert Counter(map(tuple, df.select(*columns).collect())) == Counter(map(tuple, cursor.fetchall()))
