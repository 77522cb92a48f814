"""Operator 11: a Merkle manifest of a dataset, with a proof for every row.

Rows are sorted into ranges. Every range keeps a mountain range of its own: a stack of unfinished runs, one per level,
that carries like a number to the base of the fan-out. What a range can't finish, because a run began or ends in
another one, is merged by strides of levels in groups of bounded size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from tidemark.llm.common import bound_batches, dropped, ranged, written

#: Nodes in a run, and levels that one round of merging climbs: a group then holds FANOUT ** STRIDE nodes of a level at most.
FANOUT, STRIDE = 3, 8
#: No tree is higher: 3 ** 39 is the largest power of three in a long.
HIGHEST = 39

NODE = "tree string, level int, idx long, n long, digest string"


def joined_hash(digests: list[str]) -> str:
    return sha256("".join(digests).encode()).hexdigest()


def widths(n: int) -> list[int]:
    """Nodes on each level of a tree of n leaves, leaves first, down to one."""
    out = [n]
    while out[-1] > 1:
        out.append(-(-out[-1] // FANOUT))
    return out


def mountains(start: int, digests: list[str], n: int) -> Iterator[tuple[int, int, str, bool]]:
    """(level, index, digest, open) of the nodes that `digests`, leaves start, start + 1, ... of a tree of n leaves, give.

    Open nodes wait for other ranges: their run isn't wholly here, or they are the top. All others but leaves are
    given as finished. Each node is given once. One unfinished run a level is kept.
    """
    width = widths(n)
    stack: list[list[tuple[int, str]]] = [[] for _ in width]
    for leaf, digest in enumerate(digests, start):
        level, index = 0, leaf
        while True:
            run = stack[level]
            run.append((index, digest))
            last = index + 1 == width[level]
            if width[level] == 1 or ((index + 1) % FANOUT and not last):
                break
            whole = run[0][0] % FANOUT == 0
            if whole:
                digest = joined_hash([d for _, d in run])
            if level or not whole:
                yield from ((level, i, d, not whole) for i, d in run)
            run.clear()
            if not whole:
                break
            level, index = level + 1, index // FANOUT
    for level, run in enumerate(stack):
        yield from ((level, i, d, True) for i, d in run)


def climbed(nodes: dict[int, dict[int, str]], low: int, high: int, n: int) -> Iterator[tuple[int, int, str]]:
    """(level, index, digest) of the parents, levels low + 1 to high, of open nodes by level and index; the parents join them."""
    width = widths(n)
    for level in range(low, min(high, len(width) - 1)):
        own = nodes.get(level, {})
        for index in sorted({i // FANOUT for i in own}):
            run = range(index * FANOUT, min((index + 1) * FANOUT, width[level]))
            digest = joined_hash([own[i] for i in run])
            nodes.setdefault(level + 1, {})[index] = digest
            yield level + 1, index, digest


class Paths:
    """Siblings of a range's leaves, level by level up to the top; leaves are asked for in order, so one path is kept."""

    def __init__(self, known: dict[tuple[int, int], str], n: int, upper: list[tuple[str, str]]):
        self.known, self.width, self.upper = known, widths(n), upper
        self.kept: list[tuple[int, list]] = [(-1, [])] * len(self.width)

    def of(self, level: int, index: int) -> list[tuple[str, str]]:
        """What stands left and right of a node in its run, of its parent in its own, and so on."""
        if self.kept[level][0] != index:
            if self.width[level] == 1:
                out = self.upper
            else:
                first = index - index % FANOUT
                left = "".join(self.known[level, i] for i in range(first, index))
                right = "".join(self.known[level, i] for i in range(index + 1, min(first + FANOUT, self.width[level])))
                out = [(left, right), *self.of(level + 1, index // FANOUT)]
            self.kept[level] = (index, out)
        return self.kept[level][1]

    def top(self) -> str:
        return self.known[len(self.width) - 1, 0]


def folded(digest: str, path: list[tuple[str, str]]) -> str:
    for left, right in path:
        digest = joined_hash([left, digest, right])
    return digest


def spans_of(leaves: DataFrame) -> DataFrame:
    """tree, part, start (index in its tree of the part's first leaf of that tree), c (its leaves there), n (leaves of the tree)."""
    per = leaves.groupBy("tree", "part").agg(F.count("*").alias("c"))
    w = Window.partitionBy("tree")
    before = F.sum("c").over(w.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return per.select("tree", "part", F.coalesce(before, F.lit(0)).alias("start"), "c", F.sum("c").over(w).alias("n"))


def _runs(table: pa.Table) -> Iterator[tuple[str, int, int]]:
    """(tree, from, to) of a part's leaves, sorted by seq."""
    trees, first = table.column("tree").to_pylist(), 0
    for i in range(1, len(trees) + 1):
        if i == len(trees) or trees[i] != trees[first]:
            yield trees[first], first, i
            first = i


def _nodes(rows: list[tuple]) -> pa.Table:
    kinds = [("tree", pa.string()), ("level", pa.int32()), ("idx", pa.int64()), ("n", pa.int64()), ("digest", pa.string())]
    return pa.table({name: pa.array([r[i] for r in rows], kind) for i, (name, kind) in enumerate(kinds)})


def _merging(low: int, high: int) -> Callable[[pa.Table], pa.Table]:
    """Climbs from level low to high within a group of open nodes of one tree."""

    def merge(table: pa.Table) -> pa.Table:
        nodes: dict[int, dict[int, str]] = {}
        for level, index, digest in zip(table.column("level").to_pylist(), table.column("idx").to_pylist(), table.column("digest").to_pylist(), strict=True):
            nodes.setdefault(level, {})[index] = digest
        tree, n = table.column("tree")[0].as_py(), table.column("n")[0].as_py()
        return _nodes([(tree, level, index, n, digest) for level, index, digest in climbed(nodes, low, high, n)])

    return merge


def built(leaves: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """spans (spans_of), local (nodes finished within a part, with it) and outer (nodes open in a part or merged) of leaves.

    leaves: tree, part, seq, digest of a table made by ranged() by tree first. outer has the top of every tree.
    """
    spans = written(spans_of(leaves), "tree-spans")

    def build(own: pa.Table, span: pa.Table) -> pa.Table:
        own = own.sort_by("seq")
        at = {t: (s, n) for t, s, n in zip(span.column("tree").to_pylist(), span.column("start").to_pylist(), span.column("n").to_pylist(), strict=True)}
        digests, rows, is_open = own.column("digest").to_pylist(), [], []
        for tree, i, j in _runs(own):
            for level, index, digest, waits in mountains(at[tree][0], digests[i:j], at[tree][1]):
                rows.append((tree, level, index, at[tree][1], digest))
                is_open.append(waits)
        part = own.column("part")[0].as_py()
        return _nodes(rows).append_column("open", pa.array(is_open, pa.bool_())).append_column("part", pa.array([part] * len(rows), pa.int32()))

    rows = leaves.select("part", "tree", "seq", "digest").groupBy("part").cogroup(spans.groupBy("part")).applyInArrow(build, f"{NODE}, open boolean, part int")
    rows = written(rows, "tree-nodes")
    waiting, outer = rows.where("open").select("tree", "level", "idx", "n", "digest"), []
    outer.append(waiting)
    height = len(widths(spans.agg(F.max("n")).first()[0] or 1)) - 1
    for low in range(0, height, STRIDE):
        high = low + STRIDE
        power = F.element_at(F.array(*[F.lit(FANOUT ** (high - level)) for level in range(low, high)]), F.col("level") - low + 1)
        groups = waiting.where(F.col("level") < high).withColumn("_p", power).withColumn("_g", F.expr("idx div _p"))
        merged = written(groups.groupBy("tree", "_g").applyInArrow(_merging(low, high), NODE), "tree-merged")
        outer.append(merged)
        waiting = waiting.where(F.col("level") >= high).union(merged.where(F.col("level") == high))
    all_outer = outer[0]
    for more in outer[1:]:
        all_outer = all_outer.union(more)
    return spans, rows.where("not open").select("part", "tree", "level", "idx", "n", "digest"), all_outer


def asked_nodes(spans: DataFrame, outer: DataFrame) -> DataFrame:
    """part with each node of outer in the runs of that part's first and last ancestors, level by level, and the tops."""
    levels = F.array(*[F.struct(F.lit(i).alias("level"), F.lit(FANOUT**i).alias("p")) for i in range(HIGHEST + 1)])
    # a level is there if the one below it has more than one node
    own = spans.select("tree", "part", "start", (F.col("start") + F.col("c") - 1).alias("end"), "n", F.explode(levels).alias("l"))
    own = own.select("tree", "part", "start", "end", "n", "l.*").where(f"p = 1 or p div {FANOUT} < n")
    run = lambda c: F.expr(f"sequence(({c} div p) div {FANOUT} * {FANOUT}, ({c} div p) div {FANOUT} * {FANOUT} + {FANOUT - 1})")
    asked = own.select("part", "tree", "level", F.explode(F.array_union(run("start"), run("end"))).alias("idx"))
    return asked.join(outer, ["tree", "level", "idx"]).select("part", "tree", "level", "idx", "n", "digest")


def proved(leaves: DataFrame, trees: tuple[DataFrame, DataFrame, DataFrame], upper: DataFrame | None, emit: Callable, schema: str) -> DataFrame:
    """emit(rows as a dictionary of lists, their paths, the tree's top, the root) as rows of schema, for the leaves of each part and tree.

    upper: tree, path (_packed) of the tree's top in a tree above, root of that one; None if there is no tree above.
    """
    spans, local, outer = trees
    marks = spans.select("part", "tree", F.lit(-1).alias("level"), F.col("start").alias("idx"), "n", F.lit("").alias("digest"))
    known = local.union(asked_nodes(spans, outer)).union(marks)
    if upper is not None:
        above = spans.join(upper, "tree")
        known = known.union(above.select("part", "tree", F.lit(-2).alias("level"), F.lit(0).cast("long").alias("idx"), "n", F.concat("root", F.lit("|"), "path").alias("digest")))

    def prove(own: pa.Table, known: pa.Table) -> pa.Table:
        own, at = own.sort_by("seq"), {}
        for tree, level, index, n, digest in zip(*[known.column(c).to_pylist() for c in ("tree", "level", "idx", "n", "digest")], strict=True):
            nodes = at.setdefault(tree, {})
            nodes[level, index if level >= 0 else 0] = (index, n) if level == -1 else digest
        out = []
        for tree, i, j in _runs(own):
            nodes = at[tree]
            start, n = nodes[-1, 0]
            rows = {name: own.column(name).slice(i, j - i).to_pylist() for name in own.column_names}
            nodes.update(((0, start + k), d) for k, d in enumerate(rows["digest"]))
            root, _, above = nodes.get((-2, 0), "").partition("|")
            paths = Paths(nodes, n, _unpacked(above))
            out.append(emit(rows, [paths.of(0, start + k) for k in range(j - i)], paths.top(), root or paths.top()))
        return pa.concat_tables(out)

    return leaves.groupBy("part").cogroup(known.groupBy("part")).applyInArrow(prove, schema)


def _packed(path: list[tuple[str, str]]) -> str:
    return ";".join(f"{left},{right}" for left, right in path)


def _unpacked(text: str) -> list[tuple[str, str]]:
    return [tuple(pair.split(",")) for pair in text.split(";")] if text else []


def field(c: Column) -> Column:
    """`-` for null, else the UTF-8 byte count, `:` and the value."""
    own = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(own).cast("string"), F.lit(":"), own), F.lit("-"))


def manifest(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    A leaf is the hash of the row's doc_id, source, lang, n_chars and text. The leaves of a source, by doc_id, give its
    subroot, and the subroots, by source, the root: runs of three nodes, the last one of fewer, become their hash, until
    one node remains. folded_root is folded from the row as a tamperer left it (who deletes the line feeds of texts where
    2 divides the CRC-32 of the decimal doc_id) and the siblings of its path; verified says whether it is the root.

    A null source comes first and a null doc_id first in its source; a row without a doc_id isn't tampered with. Rows
    that share a doc_id come in the order of their leaves; each equal row is a leaf of its own. Empty texts are texts.
    Other columns are ignored whatever their names. An empty table gives an empty one, without a root.

    The texts are read once and never shuffled; what is sorted are digests. Ranges have a bounded number of rows, also
    where one source or one doc_id holds most of them; groups of merging have FANOUT ** STRIDE nodes of a level at most.
    """
    bound_batches(docs.sparkSession)
    fields = {c: field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars", "text")}
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, field(F.replace(F.col("text"), F.lit("\n"), F.lit("")))).otherwise(fields["text"])
    leaf = F.sha2(F.concat(*fields.values()).cast("binary"), 256)
    other = F.sha2(F.concat(*{**fields, "text": tampered}.values()).cast("binary"), 256)
    # a null source sorts before any other
    tree = F.coalesce(F.concat(F.lit("v"), F.col("source")), F.lit("n"))
    leaves = ranged(docs.select(tree.alias("tree"), "doc_id", leaf.alias("digest"), other.alias("other")), ["tree", "doc_id", "digest"], "tree-leaves")
    trees = built(leaves)
    height = F.size(F.filter(F.array(*[F.lit(FANOUT**i) for i in range(HIGHEST + 1)]), lambda p: p < F.col("n")))
    sources = ranged(trees[2].where(F.col("level") == height).select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"), ["tree", "name"], "tree-sources")

    def path_rows(rows: dict, paths: list, top: str, root: str) -> pa.Table:
        return pa.table({"tree": rows["name"], "path": [_packed(p) for p in paths], "root": [root] * len(paths)})

    above = proved(sources.select("part", "tree", "seq", "name", "digest"), built(sources), None, path_rows, "tree string, path string, root string")
    above = written(above, "tree-paths")
    kind, ids = docs.schema["doc_id"].dataType.simpleString(), to_arrow_type(docs.schema["doc_id"].dataType)

    def proofs(rows: dict, paths: list, top: str, root: str) -> pa.Table:
        n, again = len(paths), [folded(other, path) for other, path in zip(rows["other"], paths, strict=True)]
        proof = [joined_hash([d for pair in path for d in pair]) for path in paths]
        return pa.table({"doc_id": pa.array(rows["doc_id"], ids), "leaf": rows["digest"], "subroot": [top] * n, "root": [root] * n, "proof_sha256": proof, "folded_root": again, "verified": [f == root for f in again]})

    schema = f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    out = proved(leaves.select("part", "tree", "seq", "doc_id", "digest", "other"), trees, above, proofs, schema)
    dropped(sources)
    return out


#: The unsigned CRC-32 of an ASCII text in SQL.
CRC32_SQL = """xor(list_reduce(list_transform(string_split({x}, ''), lambda c: CAST(ascii(c) AS BIGINT)),
lambda r, b: xor(r >> 8, list_reduce([xor(r, b) & 255, 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295), 4294967295)"""


def _field_sql(c: str) -> str:
    return f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"


def _tree_sql(name: str, leaves: str, key: str) -> str:
    """A recursive table of (key, level, i, h): every level from the one below."""
    return f"""{name} AS (SELECT {key}, 0 AS level, i, h FROM {leaves} UNION ALL SELECT {key}, level + 1, i // 3, sha256(string_agg(h, '' ORDER BY i))
FROM (SELECT *, count(*) OVER (PARTITION BY {key}) AS n FROM {name}) WHERE n > 1 GROUP BY {key}, level, i // 3)"""


def _siblings_sql(tree: str, key: str) -> str:
    run = f"OVER (PARTITION BY {key}, level, i // 3 ORDER BY i ROWS BETWEEN"
    return f"""SELECT {key}, level, i, coalesce(string_agg(h, '') {run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(h, '') {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
FROM (SELECT *, count(*) OVER (PARTITION BY {key}, level) AS n FROM {tree}) WHERE n > 1"""


#: The manifest in SQL.
ORACLE = f"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS id, doc_id, source, {" || ".join(_field_sql(c) for c in ("doc_id", "source", "lang", "n_chars"))} AS f, text,
CASE WHEN {CRC32_SQL.format(x="CAST(doc_id AS VARCHAR)")} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS t FROM documents),
x AS (SELECT id, doc_id, source, sha256(f || {_field_sql("text")}) AS h, sha256(f || {_field_sql("t")}) AS other FROM d),
v AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, h) - 1 AS i FROM x),
{_tree_sql("a", "v", "source")},
s AS (SELECT source AS name, 0 AS k, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i FROM (SELECT * FROM a QUALIFY level = max(level) OVER (PARTITION BY source))),
{_tree_sql("b", "s", "k")},
p AS (SELECT v.id, g.level, g.l, g.r FROM v JOIN ({_siblings_sql("a", "source")}) g ON v.source IS NOT DISTINCT FROM g.source AND v.i // CAST(pow(3, g.level) AS BIGINT) = g.i
UNION ALL SELECT v.id, 100 + g.level, g.l, g.r FROM v JOIN s ON v.source IS NOT DISTINCT FROM s.name JOIN ({_siblings_sql("b", "k")}) g ON s.i // CAST(pow(3, g.level) AS BIGINT) = g.i),
q AS (SELECT id, sha256(string_agg(l || r, '' ORDER BY level)) AS proof, list(l || '|' || r ORDER BY level) AS pairs FROM p GROUP BY id),
o AS (SELECT v.*, s.h AS subroot, (SELECT arg_max(h, level) FROM b) AS root, coalesce(q.proof, sha256('')) AS proof,
list_reduce(coalesce(q.pairs, []), lambda y, z: sha256(split_part(z, '|', 1) || y || split_part(z, '|', 2)), v.other) AS again
FROM v JOIN s ON v.source IS NOT DISTINCT FROM s.name LEFT JOIN q ON v.id = q.id)
SELECT doc_id, h AS leaf, subroot, root, proof AS proof_sha256, again AS folded_root, again = root AS verified FROM o"""
