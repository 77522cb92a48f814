"""Operator 13: repair of conversations, by the cheapest edits that give them a legal structure.

The edits of a row are arcs of a weighted automaton over its symbol (fault and role). Its determinisation is made
lazily, from the last row to the first: an automaton state is a vector of costs to go, one for each state of the grammar,
less their minimum; transitions are cached in a table, so that a row costs one lookup. The trace then runs against the
scan, along arcs that are tight, and takes the least letter at each.

Long conversations lie over several ranges of rows. There every range gives the costs between the grammar's states as a
matrix, the matrices give the costs to go at each range's end, these the state in which each range is entered, and these
the range's part of the audit.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.llm.common import bound_batches, dropped, ranged, written
from tidemark.llm.merkle import CRC32_SQL

#: Costs of the edits, and of a truncated row that isn't deleted.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: States of the grammar `(s?(ua)+)?`: nothing yet, after s, after u, after a; the role initials each reads, and where they lead.
STEPS: tuple[dict[str, int], ...] = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
FINAL = (0, 3)
#: The role that an edit can give in each state; in the last and the first it is a user's turn.
GIVES = ("u", "u", "a", "u")
ROLE = {"u": "user", "a": "assistant"}
#: Initials of adjacent rows that may stand beside each other.
LEGAL = ("su", "ua", "au")
INFINITE = 1 << 40
_NO_SPACE = re.compile(r"[^\x20\x09-\x0D]")

Vector = tuple[int, ...]


def fault(text: str, seen: bool) -> str:
    """b(lank), d(uplicate), t(runcated) or an empty string: a row's first fault."""
    if not _NO_SPACE.search(text):
        return "b"
    if seen:
        return "d"
    return "" if text.rstrip("\x20\x09\x0a\x0b\x0c\x0d")[-1] in ".!?" else "t"


def symbol(kind: str, role: str) -> str:
    """What the automaton reads of a row: x if it must go, else its role's initial (o for all others), a capital if it is truncated."""
    if kind in ("b", "d"):
        return "x"
    initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
    return initial.upper() if kind == "t" else initial


def inserted(v: list[int]) -> Vector:
    """Costs to go from each state when rows may be inserted first."""
    out = list(v)
    for _ in STEPS:
        for q in range(len(out)):
            out[q] = min(out[q], INSERT + out[STEPS[q][GIVES[q]]])
    return tuple(min(x, INFINITE) for x in out)


#: Costs to go where no row follows.
END: Vector = inserted([0 if q in FINAL else INFINITE for q in range(len(STEPS))])


def arcs(q: int, read: str) -> Iterator[tuple[str, int, int]]:
    """(edit, cost, next state) of a row read in state q, the least letter first."""
    yield "D", DELETE, q
    if read != "x":
        late = TRUNCATED if read.isupper() else 0
        if read.lower() in STEPS[q]:
            yield "K", KEEP + late, STEPS[q][read.lower()]
        yield "R", REROLE + late, STEPS[q][GIVES[q]]


class Determinised:
    """The lazily determinised automaton: vectors by number, and the cached table of transitions and of tight arcs."""

    def __init__(self):
        self.vectors: list[Vector] = []
        self.number: dict[Vector, int] = {}
        self.table: dict[tuple[int, str], tuple[int, int]] = {}
        self.tight: dict[tuple[int, str, int], tuple[str, int]] = {}

    def state(self, v: Vector) -> tuple[int, int]:
        """The state of a vector, and the minimum that it is less by."""
        low = min(v)
        v = tuple(INFINITE if x >= INFINITE else x - low for x in v)
        if v not in self.number:
            self.number[v] = len(self.vectors)
            self.vectors.append(v)
        return self.number[v], low

    def step(self, state: int, read: str) -> tuple[int, int]:
        """The state before a row, given that after it, and what the costs rise by."""
        found = self.table.get((state, read))
        if found is None:
            v = self.vectors[state]
            found = self.table[state, read] = self.state(inserted([min(c + v[p] for _, c, p in arcs(q, read)) for q in range(len(STEPS))]))
        return found

    def scan(self, symbols: str, end: Vector = END) -> tuple[list[int], Vector]:
        """The states before each row and after the last one, and the costs to go before the first."""
        state, total = self.state(end)
        states = [state]
        for read in reversed(symbols):
            state, more = self.step(state, read)
            total += more
            states.append(state)
        states.reverse()
        return states, tuple(min(INFINITE, total + x) for x in self.vectors[state])

    def edits(self, before: int, after: int, read: str, q: int) -> tuple[str, int]:
        """The least tight edits, up to the one that takes the row, in state q, and the state that they lead to."""
        found = self.tight.get((after, read, q))
        if found is None:
            v, w = self.vectors[before], self.vectors[after]
            rise, letters, p = self.step(after, read)[1], "", q
            while True:
                taken = next(((e, to) for e, c, to in arcs(p, read) if e == "D" and c + w[to] == rise + v[p]), None)
                if taken is None:
                    to = STEPS[p][GIVES[p]]
                    if INSERT + v[to] == v[p]:
                        letters, p = letters + "I", to
                        continue
                    taken = next((e, to) for e, c, to in arcs(p, read) if c + w[to] == rise + v[p])
                found = (letters + taken[0], taken[1])
                break
            self.tight[after, read, q] = found
        return found

    def trace(self, symbols: str, states: list[int], q: int = 0) -> tuple[list[str], int]:
        """The edits of each row from state q on, and the state after the last row."""
        out = []
        for i, read in enumerate(symbols):
            letters, q = self.edits(states[i], states[i + 1], read, q)
            out.append(letters)
        return out, q

    def matrix(self, symbols: str) -> list[int]:
        """Costs from each state before the rows to each state after them, row by row of the matrix."""
        columns = [self.scan(symbols, tuple(0 if p == q else INFINITE for p in range(len(STEPS))))[1] for q in range(len(STEPS))]
        return [columns[q][p] for p in range(len(STEPS)) for q in range(len(STEPS))]


def before(matrix: list[int], v: Vector) -> Vector:
    """Costs to go before a range, given its matrix and those after it."""
    n = len(STEPS)
    return tuple(min(INFINITE, min(matrix[p * n + q] + v[q] for q in range(n))) for p in range(n))


def closing(q: int) -> str:
    """The edits after the last row, in state q."""
    out = ""
    while q not in FINAL:
        out, q = out + "I", STEPS[q][GIVES[q]]
    return out


def repaired(edits: list[str], roles: list[str], texts: list[str], q: int = 0, end: str = "") -> tuple[list[str], int]:
    """The lines `role:text` that edits make of rows from state q on, and the state after them; `end`: edits after the last row."""
    out = []
    for letters, role, text in zip([*edits, end], [*roles, ""], [*texts, ""], strict=True):
        for edit in letters:
            if edit == "D":
                continue
            given = GIVES[q] if edit in "IR" else role[:1]
            out.append(f"{role if edit == 'K' else ROLE[given]}:{'' if edit == 'I' else text}")
            q = STEPS[q][given]
    return out, q


def illegal(roles: list[str]) -> int:
    return sum(x[:1] + y[:1] not in LEGAL for x, y in zip(roles, roles[1:], strict=False))


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the damage that each row's CRC-32 of `conv_id:turn` calls for; nulls are one space.

    In that key too; a null conv_id stays a conversation of its own, and a null turn stays null where rows are sorted.
    """
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = (F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn")).cast("binary")) % 20).cast("int")
    own = rows.select("conv_id", "turn", filled("role").alias("role"), filled("text").alias("text"), kind.alias("_k")).where("_k != 0")
    text = F.when(F.col("_k") == 1, "").when(F.col("_k") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_k") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("_k") == 3, 2).otherwise(1)))
    return own.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("_c")).drop("_c")


BLOCK = "part int, whole boolean, rows long, blank long, duplicate long, truncated long, illegal long, first string, last string, least long, most long, turns long, least_end long, symbols string, matrix array<long>, cost long, audit string, repaired_sha256 string"


def _block(rows: dict[str, list], part: int, whole: bool, earlier: set, automaton: Determinised) -> tuple:
    """A conversation's rows of one range as a row of BLOCK; audit, cost and hash only if it is the whole conversation."""
    faults, seen = [], set(earlier)
    for mark, text in zip(rows["mark"], rows["text"], strict=True):
        faults.append(fault(text, mark in seen))
        seen.add(mark)
    symbols = "".join(symbol(f, r) for f, r in zip(faults, rows["role"], strict=True))
    turns = [t for t in rows["turn"] if t is not None]
    out = [part, whole, len(faults), faults.count("b"), faults.count("d"), faults.count("t"), illegal(rows["role"]), rows["role"][0][:1], rows["role"][-1][:1]]
    out += [turns[0], turns[-1], len(set(turns)), turns[0]] if turns else [None, None, 0, None]
    if not whole:
        return (*out, symbols, automaton.matrix(symbols), None, None, None)
    states, costs = automaton.scan(symbols)
    edits, q = automaton.trace(symbols, states)
    lines, _ = repaired(edits, rows["role"], rows["text"], end=closing(q))
    return (*out, None, None, costs[0], "".join(edits) + closing(q), sha256("\n".join(lines).encode()).hexdigest())


def _groups(table: pa.Table) -> Iterator[tuple[object, dict[str, list]]]:
    """(conv_id, columns) of each conversation in a range's rows."""
    table = table.sort_by("seq")
    columns = {c: table.column(c).to_pylist() for c in table.column_names}
    ids, first = columns["conv_id"], 0
    for i in range(1, len(ids) + 1):
        if i == len(ids) or ids[i] != ids[first]:
            yield ids[first], {c: v[first:i] for c, v in columns.items()}
            first = i


def repair_conversations(rows: DataFrame) -> DataFrame:
    """Per conv_id of rows (conv_id, turn, role, text): gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows are damaged first (damaged()) and taken by turn, nulls first; rows of one turn by role and then by the hash of
    role and text. The audit has the least initials among the cheapest edits. A conversation without rows after the damage
    has zeros, an empty audit and the hash of an empty text; an empty table gives an empty one. A null conv_id is a
    conversation. A role can be kept if its initial is s, u or a; other roles, the empty one too, can't. Other columns
    are ignored whatever their names.

    Rows are sorted into ranges of bounded size. A conversation within one range, as all but one a range are, is repaired
    there. Of the others, ranges give matrices and take states, so that no task sees more than a range's rows and the
    matrices of one conversation's ranges; only the hash of the repaired text and the audit, which are one value, are
    drawn range after range in one task, without holding the text.
    """
    spark = rows.sparkSession
    bound_batches(spark)
    kind = rows.schema["conv_id"].dataType
    conv, arrow = f"conv_id {kind.simpleString()}", to_arrow_type(kind)
    mark = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256))
    own = damaged(rows).withColumn("turn", F.col("turn").cast("long")).withColumn("mark", F.substring(mark, 1, 16))
    own = ranged(own, ["conv_id", "turn", "role", "mark"], "conversation-rows")
    spans = own.groupBy("conv_id", "part").agg(F.count("*").alias("c"))
    several = written(spans.groupBy("conv_id").agg(F.count("*").alias("parts"), F.min("part").alias("first")).where("parts > 1"), "conversations-cut")
    # all but one conversation of a range end in it: no more are cut than there are ranges
    cut = own.join(F.broadcast(several.select(F.col("conv_id").alias("_id"))), F.col("conv_id").eqNullSafe(F.col("_id")), "left_semi")
    marks = cut.groupBy("conv_id", "mark", "part").agg(F.lit(1).alias("_"))
    oldest = marks.groupBy("conv_id", "mark").agg(F.min("part").alias("oldest"), F.max("part").alias("newest")).where("oldest < newest")
    oldest = oldest.select(F.col("conv_id").alias("_id"), F.col("mark").alias("_mark"), "oldest")
    earlier = marks.join(oldest, F.col("conv_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark"))).where("part > oldest").select("conv_id", "mark", "part")
    parts_of = cut.select("conv_id", "part").distinct().select("conv_id", F.lit(None).cast("binary").alias("mark"), "part")
    known = written(earlier.union(parts_of), "conversation-marks")

    def blocks(table: pa.Table, known: pa.Table) -> pa.Table:
        automaton, of = Determinised(), {}
        for c, m in zip(known.column("conv_id").to_pylist(), known.column("mark").to_pylist(), strict=True):
            of.setdefault(c, set()).add(m)
        part = table.column("part")[0].as_py()
        out = [(c, *_block(g, part, c not in of, of.get(c, set()), automaton)) for c, g in _groups(table)]
        return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=names)

    names = ["conv_id", *(x.split()[0] for x in BLOCK.split(", "))]
    types = [arrow, pa.int32(), pa.bool_(), *[pa.int64()] * 5, pa.string(), pa.string(), *[pa.int64()] * 4, pa.string(), pa.list_(pa.int64()), pa.int64(), pa.string(), pa.string()]
    needed = own.select("part", "conv_id", "seq", "turn", "role", "text", "mark")
    found = written(needed.groupBy("part").cogroup(known.groupBy("part")).applyInArrow(blocks, f"{conv}, {BLOCK}"), "conversation-blocks")
    gaps = lambda least, most, turns: F.coalesce(F.col(most) - F.col(least) + 1 - F.col(turns), F.lit(0))
    result = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    out = found.where("whole").withColumn("gaps", gaps("least", "most", "turns")).select(*result)
    if several.limit(1).count():
        out = out.union(_of_several(found.where("not whole"), cut, conv, arrow).select(*result))
    ids = rows.select("conv_id").distinct()
    out = ids.join(out.withColumnRenamed("conv_id", "_id"), F.col("conv_id").eqNullSafe(F.col("_id")), "left")
    nothing = sha256(b"").hexdigest()
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in result[1:7]]
    dropped(several)
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))


def _of_several(found: DataFrame, cut: DataFrame, conv: str, arrow: pa.DataType) -> DataFrame:
    """The results of conversations over several ranges, from their blocks and rows."""

    def chain(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        col = {c: table.column(c).to_pylist() for c in table.column_names}
        n, v, after = len(table), END, []
        for m in reversed(col["matrix"]):
            after.append(v)
            v = before(m, v)
        after.reverse()
        turns = [i for i in range(n) if col["turns"][i]]
        distinct = sum(col["turns"][i] for i in turns) - sum(col["most"][i] == col["least"][j] for i, j in zip(turns, turns[1:], strict=False))
        gaps = col["most"][turns[-1]] - col["least"][turns[0]] + 1 - distinct if turns else 0
        pairs = sum(x + y not in LEGAL for x, y in zip(col["last"], col["first"][1:], strict=False))
        same = lambda x: pa.array([x] * n, pa.int64())
        totals = {c: same(sum(col[c])) for c in ("blank", "duplicate", "truncated")}
        return pa.table({"conv_id": table.column("conv_id"), "part": table.column("part"), "after": pa.array([list(x) for x in after], pa.list_(pa.int64())), "gaps": same(gaps), **totals, "illegal": same(sum(col["illegal"]) + pairs), "cost": same(v[0])})

    edge = ["conv_id", "part", "matrix", "least", "most", "turns", "first", "last", "blank", "duplicate", "truncated", "illegal"]
    chained = found.select(*edge).groupBy("conv_id").applyInArrow(chain, f"{conv}, part int, after array<long>, gaps long, blank long, duplicate long, truncated long, illegal long, cost long")
    chained = written(chained, "conversation-costs")
    ends = chained.select(F.col("conv_id").alias("_id"), F.col("part").alias("_part"), "after")
    with_ends = found.select("conv_id", "part", "symbols").join(ends, F.col("conv_id").eqNullSafe(F.col("_id")) & (F.col("part") == F.col("_part"))).select("conv_id", "part", "symbols", "after")

    def exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Determinised()
        for b in batches:
            own = []
            for symbols, after in zip(b.column("symbols").to_pylist(), b.column("after").to_pylist(), strict=True):
                states, _ = automaton.scan(symbols, tuple(after))
                own.append([automaton.trace(symbols, states, q)[1] for q in range(len(STEPS))])
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("part"), b.column("symbols"), b.column("after"), pa.array(own, pa.list_(pa.int32()))], ["conv_id", "part", "symbols", "after", "exits"])

    traced = written(with_ends.mapInArrow(exits, f"{conv}, part int, symbols string, after array<long>, exits array<int>"), "conversation-exits")

    def enter(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        q, entry = 0, []
        for to in table.column("exits").to_pylist():
            entry.append(q)
            q = to[q]
        last = [False] * (len(entry) - 1) + [True]
        return pa.table({"conv_id": table.column("conv_id"), "part": table.column("part"), "entry": pa.array(entry, pa.int32()), "final": last})

    entered = written(traced.select("conv_id", "part", "exits").groupBy("conv_id").applyInArrow(enter, f"{conv}, part int, entry int, final boolean"), "conversation-entries")
    start = entered.select(F.col("conv_id").alias("_id"), F.col("part").alias("_part"), "entry", "final")
    with_entry = traced.join(start, F.col("conv_id").eqNullSafe(F.col("_id")) & (F.col("part") == F.col("_part"))).select("conv_id", "part", "symbols", "after", "entry", "final")
    with_entry = written(with_entry, "conversation-traces")

    def edit(table: pa.Table, traces: pa.Table) -> pa.Table:
        automaton, out = Determinised(), []
        of = {t["conv_id"]: t for t in traces.to_pylist()}
        part = table.column("part")[0].as_py()
        for c, g in _groups(table):
            t = of[c]
            states, _ = automaton.scan(t["symbols"], tuple(t["after"]))
            edits, q = automaton.trace(t["symbols"], states, t["entry"])
            end = closing(q) if t["final"] else ""
            lines, _ = repaired(edits, g["role"], g["text"], t["entry"], end)
            out.append((c, part, "".join(edits) + end, len(lines), "\n".join(lines)))
        kinds = [arrow, pa.int32(), pa.string(), pa.int64(), pa.string()]
        return pa.table([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["conv_id", "part", "audit", "lines", "text"])

    needed = cut.select("part", "conv_id", "seq", "role", "text")
    pieces = written(needed.groupBy("part").cogroup(with_entry.groupBy("part")).applyInArrow(edit, f"{conv}, part int, audit string, lines long, text string"), "conversation-pieces")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, audit, digest, any_line = None, [], sha256(), False

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now[0]], arrow), pa.array(["".join(audit)], pa.string()), pa.array([digest.hexdigest()], pa.string())], ["_id", "audit", "repaired_sha256"])

        for b in batches:
            for r in b.to_pylist():
                if now is None or now[0] != r["conv_id"]:
                    if now is not None:
                        yield done()
                    now, audit, digest, any_line = (r["conv_id"],), [], sha256(), False
                audit.append(r["audit"])
                if r["lines"]:
                    digest.update((b"\n" if any_line else b"") + r["text"].encode())
                    any_line = True
        if now is not None:
            yield done()

    joined = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(join, f"{conv.replace('conv_id', '_id')}, audit string, repaired_sha256 string")
    totals = chained.drop("part", "after").distinct()
    return totals.join(joined, F.col("conv_id").eqNullSafe(F.col("_id"))).drop("_id")


def _least_sql(*options: str) -> str:
    return f"list_sort([{', '.join(options)}])[1]"


def _edit_sql(letter: str, cost: object, to: str, line: str = "") -> str:
    """A struct (cost, audit, lines) of an edit before those of `to`."""
    return f"{{'c': {cost} + {to}.c, 'a': '{letter}' || {to}.a, 'l': {f'[{line}] || ' if line else ''}{to}.l}}"


def _row_sql(state: int) -> str:
    """The least edits of a row in a state of the grammar; those that aren't allowed cost very much."""
    lost = f"CASE WHEN f IN ('b', 'd') THEN {INFINITE} WHEN f = 't' THEN {TRUNCATED} ELSE 0 END"
    options = [_edit_sql("D", DELETE, f"z.q{state}")]
    options += [_edit_sql("K", f"CASE WHEN left(role, 1) = '{i}' THEN {KEEP} ELSE {INFINITE} END + {lost}", f"z.q{p}", "role || ':' || text") for i, p in STEPS[state].items()]
    options.append(_edit_sql("R", f"{REROLE} + {lost}", f"z.q{STEPS[state][GIVES[state]]}", f"'{ROLE[GIVES[state]]}:' || text"))
    return _least_sql(*options)


def _insert_sql(state: int, to: str) -> str:
    return _edit_sql("I", INSERT, to, f"'{ROLE[GIVES[state]]}:'")


_EMPTY = "{'c': CAST(0 AS BIGINT), 'a': '', 'l': CAST([] AS VARCHAR[])}"
_DAMAGE = CRC32_SQL.format(x="coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')") + " % 20"

#: The repair in SQL: the cheapest and least edits from every row on, from the last row to the first.
ORACLE = f"""WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_DAMAGE} AS k FROM conversations),
w AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE WHEN k = 1 THEN '' WHEN k = 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN k = 3 THEN [0, 1] ELSE [0] END) AS copy FROM k WHERE k <> 0),
y AS (SELECT *, left(sha256(CAST(strlen(role) AS VARCHAR) || ':' || role || text), 32) AS mark FROM w),
x AS (SELECT *, row_number() OVER o AS i, lag(role) OVER o AS before FROM y WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, mark, copy)),
e AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS seen, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS core FROM x),
f AS (SELECT *, CASE WHEN core = '' THEN 'b' WHEN seen THEN 'd' WHEN right(core, 1) IN ('.', '!', '?') THEN '' ELSE 't' END AS f FROM e),
g AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (f = 'b') AS blank, count(*) FILTER (f = 'd') AS duplicate, count(*) FILTER (f = 't') AS truncated,
count(*) FILTER (i > 1 AND left(before, 1) || left(role, 1) NOT IN ({", ".join(f"'{p}'" for p in LEGAL)})) AS illegal FROM f GROUP BY conv_id),
z AS (SELECT conv_id, n AS i, {_EMPTY} AS q0, {_edit_sql("I", INSERT, _edit_sql("I", INSERT, f"({_EMPTY})", "'assistant:'").join("()"), "'user:'")} AS q1, {_edit_sql("I", INSERT, f"({_EMPTY})", "'assistant:'")} AS q2, {_EMPTY} AS q3 FROM g
UNION ALL SELECT conv_id, i, {_least_sql("w0", _insert_sql(0, "e2"))}, {_least_sql("w1", _insert_sql(1, "e2"))}, e2, e3 FROM (
SELECT *, {_least_sql("w2", _insert_sql(2, "w3"))} AS e2, {_least_sql("w3", _insert_sql(3, "w2"))} AS e3 FROM (
SELECT z.conv_id, z.i - 1 AS i, {", ".join(f"{_row_sql(q)} AS w{q}" for q in range(len(STEPS)))} FROM z JOIN f ON z.conv_id IS NOT DISTINCT FROM f.conv_id AND z.i = f.i)))
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
coalesce(z.q0.c, 0) AS cost, coalesce(z.q0.a, '') AS audit, sha256(coalesce(array_to_string(z.q0.l, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN g ON c.conv_id IS NOT DISTINCT FROM g.conv_id LEFT JOIN z ON c.conv_id IS NOT DISTINCT FROM z.conv_id AND z.i = 0"""
