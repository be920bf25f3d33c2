"""Merkle manifest of a dataset: one tree per group, one over the groups, and a proof for every row by octopus multiproofs.

Rows are leaves, in order inside their group; two neighbours become one node, a last one alone becomes a node too, until one node
is left, the group's subroot. Subroots, in the order of groups (null first, then by UTF-8 bytes), become the root in the same way.

1. Leaf digests are made by built-in functions. Only they and the order columns travel, never the other fields.
2. Rows are sorted by range over (group, order, leaf, row number), so a group that holds most rows, or one row repeated for ever, is spread.
   `LEAVES` neighbours are a leaf partition. Counts per group and partition, summed in order, give each its first leaf number.
3. A leaf partition computes all nodes whose leaves it holds, and hands on only those whose sibling it lacks: two a level at most.
   These edges are joined for `GROUP` neighbouring partitions at a time, then for `GROUP` of these ranges, until every tree has its top.
4. Octopus: of all proofs of a leaf partition the missing nodes are, level by level, the left sibling of its first node and the right
   sibling of its last one. This union is joined once to the nodes of step 3, with the siblings of the partition's groups in the upper tree.
   The partition then derives every node that several proofs share and expands the proofs of its leaves locally.

A digest is the lowercase hex SHA-256 of what it covers, digests taken as hex text. Nothing passes through the driver but numbers of
partitions; tables between the steps are stored, so a lost executor repeats a step's part only.

Defined results: a null field counts as "-", any other as byte length, ":" and its text; rows with a null group are a group of their own, the
first; null order values come first, equal ones are ordered by leaf digest, and equal rows are leaves of their own; an empty table gives none;
texts of any length are hashed whole; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import small_side, stored

LEAVES = 1 << 14                # leaves that a task holds with their proofs, a few tens of MB
GROUP = 64                      # neighbouring ranges whose edges are joined together
_NODES = "tree string, n bigint, level int, idx bigint, digest string"
_LEAF, _TOP, _SIBLING, _ROOT = 0, 1, 2, 3


def field(value: Column) -> Column:
    """How a field enters a leaf: "-" if null, else its length in UTF-8 bytes, a colon and its text."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(c) for c in fields]).cast("binary"), 256)


def _hash(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def _height(n: str) -> Column:
    """Levels above the leaves of a tree of n leaves."""
    return F.when(F.col(n) <= 1, 0).otherwise(F.length(F.bin(F.col(n) - 1)))


class _Forest:
    """Trees over the rows (tree, order columns, digest, ...), each ordered by the order columns."""

    def __init__(self, rows: DataFrame, order: list[str], name: str):
        spark = rows.sparkSession
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        order = [F.col("tree"), *[F.col(c).asc_nulls_first() for c in order]]
        spread = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
        placed = stored(spread.withColumn("at", F.monotonically_increasing_id()), name)
        ranges = F.shiftright("at", 33)
        blocks = (placed.groupBy(ranges.alias("range")).agg((F.max(F.col("at").bitwiseAND((1 << 33) - 1)).cast("bigint")).alias("last"))
                  .select("range", F.expr(f"last div {LEAVES} + 1").alias("blocks")))           # one row a shuffle partition
        before = F.sum("blocks").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
        first = stored(blocks.select("range", F.coalesce(before, F.lit(0)).alias("first")), "ranges")
        block = F.expr(f"(at & {(1 << 33) - 1}) div {LEAVES}")
        self.rows = (placed.withColumn("range", ranges).join(small_side(first, 32), "range")
                     .withColumn("part", F.col("first") + block).drop("range", "first"))
        counts = self.rows.groupBy("tree", "part").agg(F.count("*").alias("here"))
        tree = Window.partitionBy("tree")
        lo = F.coalesce(F.sum("here").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        self.segments = stored(counts.select("tree", "part", lo.alias("lo"), F.col("here"), F.sum("here").over(tree).alias("n"))
                               .withColumn("hi", F.col("lo") + F.col("here")).withColumn("height", _height("n")), "segments")
        self.nodes = stored(self._nodes(), "nodes")

    def _nodes(self) -> DataFrame:
        """(tree, n, level, idx, digest) of all nodes that two leaf partitions share, and of all edges and tops."""
        leaves = self.rows.select("part", "at", "tree", "digest").groupBy("part")
        lows = self.segments.select("part", "tree", "lo", "n").groupBy("part")
        edges = stored(leaves.cogroup(lows).applyInArrow(_edges, f"part bigint, {_NODES}"), "edges")
        found, last = edges.drop("part"), self.segments.agg(F.max("part")).first()[0] or 0
        edges = edges.where(F.col("level") < _height("n"))
        while last:
            last //= GROUP
            joined = stored(edges.withColumn("group", F.expr(f"part div {GROUP}")).groupBy("group")
                            .applyInArrow(_joined, f"part bigint, {_NODES}, fresh boolean, open boolean"), "edges")
            found = found.union(joined.where("fresh").select(*found.columns))
            edges = joined.where("open").select(*edges.columns)
        return found

    def tops(self) -> DataFrame:
        return self.nodes.where(F.col("level") == _height("n")).select("tree", F.col("digest").alias("top"))

    def missing(self) -> DataFrame:
        """(part, tree, level, idx, digest): per leaf partition the nodes that its proofs need and it cannot compute."""
        levels = self.segments.where("height > 0").withColumn("level", F.explode(F.sequence(F.lit(0), F.col("height") - 1)))
        up = lambda c: F.call_function("shiftright", F.col(c) + F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("level")) - 1, F.col("level"))
        sides = levels.select("part", "tree", "level", F.call_function("shiftright", F.col("lo"), F.col("level")).alias("lo"), up("hi").alias("hi"), up("n").alias("n"))
        want = F.array_compact(F.array(F.when(F.col("lo") % 2 == 1, F.col("lo") - 1),
                                       F.when((F.col("hi") % 2 == 1) & (F.col("hi") < F.col("n")), F.col("hi"))))
        return (sides.select("part", "tree", "level", F.explode(want).alias("idx"))
                .join(self.nodes.select("tree", "level", "idx", "digest"), ["tree", "level", "idx"]).select("part", "tree", "level", "idx", "digest"))


def _by_tree(table: pa.Table, *columns: str) -> dict[str, list[tuple]]:
    out: dict[str, list[tuple]] = {}
    for tree, *rest in zip(*[table.column(c).to_pylist() for c in ("tree", *columns)]):
        out.setdefault(tree, []).append(tuple(rest))
    return out


def _table(rows: list[tuple], schema: list[tuple[str, pa.DataType]]) -> pa.Table:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.table({name: pa.array(values, type=kind) for (name, kind), values in zip(schema, columns)})


_NODE = [("part", pa.int64()), ("tree", pa.string()), ("n", pa.int64()), ("level", pa.int32()), ("idx", pa.int64()), ("digest", pa.string())]


def _edges(leaves: pa.Table, lows: pa.Table) -> pa.Table:
    """The nodes of a leaf partition whose sibling it lacks, and the tops of trees that it holds whole."""
    out, where = [], {tree: rows[0] for tree, rows in _by_tree(lows, "lo", "n", "part").items()}
    for tree, rows in _by_tree(leaves, "at", "digest").items():
        first, n, part = where[tree]
        total, level, nodes = n, 0, [d for _, d in sorted(rows)]
        while nodes:
            end = first + len(nodes)
            if n == 1:
                out.append((part, tree, total, level, 0, nodes[0]))
                break
            if first % 2:
                out.append((part, tree, total, level, first, nodes[0]))
            if end % 2 and end < n:
                out.append((part, tree, total, level, end - 1, nodes[-1]))
            whole = nodes[first % 2:len(nodes) - (1 if end % 2 and end < n else 0)]
            nodes = [_hash(*whole[i:i + 2]) for i in range(0, len(whole), 2)]
            first, n, level = (first + 1) // 2, (n + 1) // 2, level + 1
    return _table(out, _NODE)


def _joined(table: pa.Table) -> pa.Table:
    """Edges of neighbouring ranges: the nodes that come of them (fresh), and the edges of the whole (open)."""
    part, out = table.column("group")[0].as_py(), []
    for tree, rows in _by_tree(table, "n", "level", "idx", "digest").items():
        total = rows[0][0]
        there: dict[int, dict[int, tuple[str, bool]]] = {}
        for _, level, idx, d in rows:
            there.setdefault(level, {})[idx] = (d, False)
        level, n = 0, total
        while n > 1:
            here = there.get(level, {})
            for idx in sorted(here):
                if idx % 2 == 0 and (idx + 1 in here or idx + 1 == n):
                    up = _hash(*[here[i][0] for i in (idx, idx + 1) if i in here])
                    there.setdefault(level + 1, {})[idx // 2] = (up, True)
                alone = idx ^ 1 not in here and (idx % 2 == 1 or idx + 1 < n)
                out.append((part, tree, total, level, idx, *here[idx], alone))
            level, n = level + 1, (n + 1) // 2
        out += [(part, tree, total, level, idx, *node, False) for idx, node in there.get(level, {}).items()]
    return _table(out, [*_NODE, ("fresh", pa.bool_()), ("open", pa.bool_())])


def _levels(leaves: list[str], lo: int, n: int, fetched: dict[tuple[int, int], str]) -> list[tuple[int, list[str], int]]:
    """(first number, nodes, nodes of the whole tree) per level: what the leaves' proofs need, completed by fetched nodes."""
    out, level, nodes = [], 0, leaves
    while n > 1:
        if lo % 2:
            nodes, lo = [fetched[level, lo - 1], *nodes], lo - 1
        if (lo + len(nodes)) % 2 and lo + len(nodes) < n:
            nodes = [*nodes, fetched[level, lo + len(nodes)]]
        out.append((lo, nodes, n))
        nodes, lo, n, level = [_hash(*nodes[i:i + 2]) for i in range(0, len(nodes), 2)], lo // 2, (n + 1) // 2, level + 1
    return out


def _path(at: int, levels: list[tuple[int, list[str], int]]) -> list[tuple[bool, str | None]]:
    """(sibling stands left, sibling or none) of each level upwards."""
    out = []
    for first, nodes, n in levels:
        beside = at ^ 1
        out.append((at % 2 == 1, nodes[beside - first] if beside < n else None))
        at //= 2
    return out


def fold(leaf: str, path: list[tuple[bool, str | None]]) -> str:
    """The root that a leaf and the siblings on its way up give."""
    for left, sibling in path:
        leaf = _hash(leaf) if sibling is None else _hash(sibling, leaf) if left else _hash(leaf, sibling)
    return leaf


def _upper_paths(rows: pa.Table, fetched: pa.Table) -> pa.Table:
    """The siblings of each group's subroot in the upper tree, level by level."""
    out = []
    segment, nodes = _help(fetched)
    for tree, leaves in _by_tree(rows, "at", "digest", "of").items():
        leaves.sort()
        lo, n = segment[tree][:2]
        levels = _levels([d for _, d, _ in leaves], lo, n, nodes.get(tree, {}))
        for k, (_, _, of) in enumerate(leaves):
            out += [(of, level, left, sibling) for level, (left, sibling) in enumerate(_path(lo + k, levels))]
    return _table(out, [("tree", pa.string()), ("level", pa.int32()), ("left", pa.bool_()), ("sibling", pa.string())])


def _help(table: pa.Table) -> tuple[dict, dict]:
    segment = {tree: rows[0][1:] for tree, rows in _by_tree(table.filter(pc.equal(table.column("kind"), _LEAF)), "kind", "idx", "n", "digest").items()}
    nodes: dict[str, dict[tuple[int, int], str]] = {}
    for tree, rows in _by_tree(table.filter(pc.equal(table.column("kind"), _TOP)), "level", "idx", "digest").items():
        nodes[tree] = {(level, idx): d for level, idx, d in rows}
    return segment, nodes


def _proofs(rows: pa.Table, fetched: pa.Table) -> pa.Table:
    segment, nodes = _help(fetched)
    upper: dict[str, list[tuple[bool, str | None]]] = {}
    for tree, found in _by_tree(fetched.filter(pc.equal(fetched.column("kind"), _SIBLING)), "level", "idx", "digest").items():
        upper[tree] = [(left == 1, sibling) for _, left, sibling in sorted(found, key=lambda r: r[0])]
    root = next(d for kind, d in zip(fetched.column("kind").to_pylist(), fetched.column("digest").to_pylist()) if kind == _ROOT)
    number, out = [], {name: [] for name in ("leaf", "subroot", "root", "siblings", "folded_root")}
    for tree, leaves in _by_tree(rows.append_column("row", pa.array(range(rows.num_rows))), "at", "digest", "presented", "row").items():
        leaves.sort()
        lo, n, top = segment[tree]
        levels = _levels([r[1] for r in leaves], lo, n, nodes.get(tree, {}))
        for k, (_, leaf, presented, row) in enumerate(leaves):
            path = _path(lo + k, levels) + upper.get(tree, [])
            number.append(row)
            for name, value in (("leaf", leaf), ("subroot", top), ("root", root), ("folded_root", fold(presented or leaf, path)),
                                ("siblings", "".join(s for _, s in path if s is not None))):
                out[name].append(value)
    doc = rows.column("doc").take(pa.array(number, type=pa.int64()))
    return pa.table({"doc": doc} | {name: pa.array(values, type=pa.string()) for name, values in out.items()})


def manifest(table: DataFrame, fields: list[str], group_col: str, order_col: str, presented: Column | None = None) -> DataFrame:
    """(doc, leaf, subroot, root, siblings, folded_root) of every row, doc being the order column. `siblings` is the row's proof,
    the digests of its siblings one after another, up to the root. `presented` is the `digest` of the row as somebody presents it for
    a check (null: as it is); the fold starts from there, so it gives the root only if the row is unchanged."""
    leaf = digest([F.col(c) for c in fields])
    shown = F.lit(None).cast("string") if presented is None else presented
    tree = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit("")).alias("tree")
    leaves = stored(table.select(tree, F.col(order_col).alias("doc"), leaf.alias("digest"), shown.alias("presented"))
                    .withColumn("presented", F.expr("nullif(presented, digest)")).withColumn("row", F.monotonically_increasing_id()), "leaves")
    lower = _Forest(leaves, ["doc", "digest", "row"], "ordered")
    tops = lower.tops()
    upper = _Forest(tops.select(F.lit("").alias("tree"), F.col("tree").alias("of"), F.col("top").alias("digest")), ["of"], "subroots")
    part = lambda forest: forest.segments.join(forest.tops(), "tree").select(
        "part", "tree", F.lit(_LEAF).alias("kind"), "height", F.col("lo").alias("idx"), "n", F.col("top").alias("digest"))
    node = lambda forest: forest.missing().select("part", "tree", F.lit(_TOP).alias("kind"), "level", "idx", F.lit(0).cast("bigint").alias("n"), "digest")
    names = ["part", "tree", "kind", "level", "idx", "n", "digest"]
    above = stored(upper.rows.groupBy("part").cogroup(part(upper).toDF(*names).union(node(upper)).groupBy("part"))
                   .applyInArrow(_upper_paths, "tree string, level int, left boolean, sibling string"), "upper paths")
    held = lower.segments.select("part", "tree")
    siblings = held.join(above, "tree").select("part", "tree", F.lit(_SIBLING), "level", F.col("left").cast("bigint"), F.lit(0).cast("bigint"), "sibling")
    top = upper.tops().first()                                                                  # one digest
    root = held.select("part").distinct().select("part", F.lit(""), F.lit(_ROOT), F.lit(0), F.lit(0).cast("bigint"), F.lit(0).cast("bigint"),
                                                 F.lit(top and top["top"]))
    fetched = part(lower).toDF(*names).union(node(lower)).union(siblings).union(root)
    kind = leaves.schema["doc"].dataType.simpleString()
    return lower.rows.select("part", "at", "tree", "doc", "digest", "presented").groupBy("part").cogroup(fetched.groupBy("part")).applyInArrow(
        _proofs, f"doc {kind}, leaf string, subroot string, root string, siblings string, folded_root string")
