"""Merkle manifest of a dataset whose parents retain their hash states.

A parent is the SHA-256 of its children's digests as hex text, one behind the other. While it hashes, it
keeps a copy of its state before each child slot: a changed child is folded in by resuming the state of
its slot with the replacement and the siblings to the right only; what stands to the left is in the
state already.

Rows are numbered by a range sort and prefix sums of counts. Trees are built in tiers: chunks of at most
CHUNK consecutive nodes each become one node of the next tier, so a tree of a billion leaves has three,
and no task holds more than a chunk and the path above it. The paths of the chunks come down the same
tiers, and in the last step every leaf is folded through the parents of its chunk and of its chunk's path.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, materialize

#: Nodes of a tree that one task reduces at once, at most.
CHUNK = 1024
NODE = "tree string, pos long, n long, digest string"
PATH = "slots array<int>, siblings array<string>, subroot string, root string"


class Parent:
    """A node's children, its digest, and its hash state before each child slot."""

    __slots__ = ("children", "digest", "states")

    def __init__(self, children: list[bytes]) -> None:
        state, self.children, self.states = hashlib.sha256(), children, []
        for child in children:
            self.states.append(state.copy())
            state.update(child)
        self.digest = state.hexdigest().encode()

    def resumed(self, slot: int, replacement: bytes) -> bytes:
        """The digest with another child in a slot."""
        state = self.states[slot].copy()
        state.update(replacement)
        for child in self.children[slot + 1 :]:
            state.update(child)
        return state.hexdigest().encode()

    def others(self, slot: int) -> bytes:
        return b"".join(self.children[:slot] + self.children[slot + 1 :])


def grown(digests: list[bytes], fan: int, height: int | None) -> list[list[Parent]]:
    """The levels of parents over digests: so many as height, or until one node remains."""
    levels, nodes = [], digests
    while len(levels) < height if height is not None else len(nodes) > 1:
        levels.append([Parent(nodes[k : k + fan]) for k in range(0, len(nodes), fan)])
        nodes = [p.digest for p in levels[-1]]
    return levels


def above(slots: list[int], siblings: list[str], own: bytes, fan: int) -> list[Parent]:
    """The parents on a path, from the digest that stands at its foot."""
    out = []
    for slot, text in zip(slots, siblings, strict=True):
        children = [text[k : k + 64].encode() for k in range(0, len(text), 64)]
        out.append(Parent([*children[:slot], own, *children[slot:]]))
        own = out[-1].digest
    return out


class _Shape:
    """Of a chunk of a tier: its nodes in order and its parents."""

    def __init__(self, nodes: pa.Table, fan: int, height: int) -> None:
        self.nodes, self.n = nodes.sort_by("pos"), nodes.column("n")[0].as_py()
        self.digests = [d.encode() for d in self.nodes.column("digest").to_pylist()]
        self.levels = grown(self.digests, fan, height if self.n > fan**height else None)
        self.top = self.levels[-1][0].digest if self.levels else self.digests[0]


def _rise(fan: int, height: int):
    def run(key: tuple, nodes: pa.Table) -> pa.Table:
        shape, width = _Shape(nodes, fan, height), fan**height
        return pa.table({"tree": [key[0].as_py()], "pos": pa.array([key[1].as_py()], pa.int64()), "n": pa.array([-(-shape.n // width)], pa.int64()), "digest": [shape.top.decode()]})

    return run


def _descend(fan: int, height: int):
    """Of a chunk and the path of its root: the path of each of its nodes."""

    def run(key: tuple, nodes: pa.Table, path: pa.Table) -> pa.Table:
        shape, p = _Shape(nodes, fan, height), path.to_pylist()[0]
        slots, siblings = [], []
        for at in range(len(shape.digests)):
            own, texts, place = [], [], at
            for parents in shape.levels:
                own.append(place % fan)
                texts.append(parents[place // fan].others(place % fan).decode())
                place //= fan
            slots.append(own + p["slots"])
            siblings.append(texts + p["siblings"])
        n = len(slots)
        same = [shape.nodes.column(c) for c in ("tree", "pos")]
        return pa.table([*same, pa.array(slots, pa.list_(pa.int32())), pa.array(siblings, pa.list_(pa.string())), pa.array([p["subroot"]] * n, pa.string()), pa.array([p["root"]] * n, pa.string())], names=["tree", "pos", "slots", "siblings", "subroot", "root"])

    return run


def _fold(fan: int, height: int):
    """Of a chunk of leaves and the path of its root: every leaf's proof, and the root that its replacement, or itself, folds to."""

    def run(key: tuple, nodes: pa.Table, path: pa.Table) -> pa.Table:
        shape, p = _Shape(nodes, fan, height), path.to_pylist()[0]
        upper = list(zip(p["slots"], above(p["slots"], p["siblings"], shape.top, fan), strict=True))
        tail, proofs, folded = "".join(p["siblings"]).encode(), [], []
        for at, replacement in enumerate(shape.nodes.column("changed").to_pylist()):
            value, place, proof = replacement.encode() if replacement else shape.digests[at], at, hashlib.sha256()
            for parents in shape.levels:
                parent, slot = parents[place // fan], place % fan
                proof.update(parent.others(slot))
                value, place = parent.resumed(slot, value), place // fan
            proof.update(tail)
            for slot, parent in upper:
                value = parent.resumed(slot, value)
            proofs.append(proof.hexdigest())
            folded.append(value.decode())
        n = len(folded)
        return pa.table([shape.nodes.column("doc_id"), shape.nodes.column("digest"), pa.array([p["subroot"]] * n, pa.string()), pa.array([p["root"]] * n, pa.string()), pa.array(proofs, pa.string()), pa.array(folded, pa.string())], names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root"])

    return run


def numbered(rows: DataFrame, *order: Column) -> DataFrame:
    """Adds pos (from 0), the place of each row in its tree, and n, the rows of the tree.

    Rows are dealt by ranges, so a tree that holds most rows is many tasks; only counts of ranges are summed up.
    """
    by = [F.col("tree"), *order]
    placed = materialize(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id()), "placed")
    placed = placed.withColumn("part", F.shiftright("at", 33))
    runs = placed.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    tree = Window.partitionBy("tree")  # a row for each range that the tree reaches into
    before = F.coalesce(F.sum("rows").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("tree", "part", (before - F.col("first")).alias("shift"), F.sum("rows").over(tree).alias("n"))
    return placed.join(runs, ["tree", "part"]).withColumn("pos", F.col("at") + F.col("shift")).drop("at", "part", "shift")


class Forest:
    """The trees of numbered nodes (tree, pos, n, digest), tier over tier, as tables of the job's scratch folder."""

    def __init__(self, nodes: DataFrame, fan: int, scratch: Scratch) -> None:
        self.fan, self.height, self.scratch = fan, 1, scratch
        while fan ** (self.height + 1) <= CHUNK:
            self.height += 1
        self.tiers = [nodes]
        while (self.tiers[-1].agg(F.max("n")).first()[0] or 0) > 1:
            up = self.chunked(self.tiers[-1].select("tree", "pos", "n", "digest")).groupBy("tree", "chunk").applyInArrow(_rise(fan, self.height), NODE)
            self.tiers.append(scratch.table(up, "tier"))

    @property
    def tops(self) -> DataFrame:
        """tree, digest of each tree's last node."""
        return self.tiers[-1].select("tree", "digest")

    def chunked(self, nodes: DataFrame) -> DataFrame:
        return nodes.withColumn("chunk", F.floor(F.col("pos") / self.fan**self.height).cast("long"))

    def meet(self, nodes: DataFrame, paths: DataFrame):
        """A tier's chunks, each with the path of its root."""
        roots = paths.withColumnRenamed("pos", "chunk").groupBy("tree", "chunk")
        return self.chunked(nodes).groupBy("tree", "chunk").cogroup(roots)

    def down(self, paths: DataFrame) -> DataFrame:
        """The paths (tree, pos, slots, siblings, subroot, root) of the chunks of the lowest tier, from those of the tops."""
        for nodes in self.tiers[-2:0:-1]:
            paths = self.scratch.table(self.meet(nodes, paths).applyInArrow(_descend(self.fan, self.height), f"tree string, pos long, {PATH}"), "paths")
        return paths


def field(c: Column) -> Column:
    """`-` if null, else the number of UTF-8 bytes, a colon and the value."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(n_chars: Column) -> Column:
    return F.sha2(F.concat(*(field(c) for c in (F.col("doc_id").cast("long"), F.col("source"), F.col("lang"), n_chars, F.col("text")))), 256)


def leaves(docs: DataFrame, changed: Column | None = None) -> DataFrame:
    """doc_id, tree (the lang, null before all others), digest, and changed: the leaf with other n_chars where the condition holds."""
    n = F.col("n_chars").cast("long")
    other = F.when(changed & n.isNotNull(), leaf(F.try_add(n, F.lit(1)))) if changed is not None else F.lit(None).cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.concat(F.lit("="), "lang"), F.lit("-")).alias("tree"), leaf(n).alias("digest"), other.alias("changed"))


def tampered() -> Column:
    """Rows whose doc_id's decimal digits have a CRC-32 that 7 divides; a null doc_id has none."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("long").cast("string")) % 7 == 0, F.lit(False))


def manifest(docs: DataFrame, changed: Column | None = None, fan: int = 2) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row.

    A leaf is the hash of doc_id, source, lang, n_chars and text. Leaves of a lang ascend by doc_id, a null
    one first, rows of one doc_id by their leaves; every fan consecutive nodes become one, the last run may
    be shorter, until one remains. The subroots, in the order of their langs' bytes, null first, likewise
    give the root. Where changed holds, 1 is added to n_chars (nulls stay, and so does what 64 bits can't
    hold: it is hashed as null) and the leaf is folded anew to folded_root, from the states that parents
    retained; all other leaves are folded as they are. Other columns are ignored; an empty table gives an
    empty result.
    """
    scratch = Scratch(docs.sparkSession)
    rows = scratch.table(numbered(leaves(docs, changed), F.col("doc_id").asc_nulls_first(), F.col("digest")), "leaves")
    trees = Forest(rows, fan, scratch)
    subroots = numbered(trees.tops.withColumnRenamed("tree", "lang").withColumn("tree", F.lit("")), F.col("lang"))
    whole = Forest(scratch.table(subroots, "subroots"), fan, scratch)
    none = [F.array().cast("array<int>").alias("slots"), F.array().cast("array<string>").alias("siblings"), F.lit(None).cast("string").alias("subroot")]
    paths = whole.down(whole.tiers[-1].select("tree", "pos", *none, F.col("digest").alias("root")))
    if len(whole.tiers) > 1:
        paths = whole.meet(whole.tiers[0].select("tree", "pos", "n", "digest"), paths).applyInArrow(_descend(fan, whole.height), f"tree string, pos long, {PATH}")
    of = whole.tiers[0].select("pos", "lang", F.col("digest").alias("_subroot"))
    paths = paths.join(of, "pos").select(F.col("lang").alias("tree"), F.lit(0).cast("long").alias("pos"), "slots", "siblings", F.col("_subroot").alias("subroot"), "root")
    paths = trees.down(scratch.table(paths, "paths"))
    folded = trees.meet(rows.select("tree", "pos", "n", "digest", "doc_id", "changed"), paths).applyInArrow(_fold(fan, trees.height), "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string")
    out = materialize(folded.withColumn("verified", F.col("folded_root") == F.col("root")), "manifest")
    scratch.clear()
    return out


ORACLE = r"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b::UBIGINT, range(8)::UBIGINT[]), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::UBIGINT) ELSE c // 2 END)) AS t),
f AS (SELECT *, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT)), lambda c, b: xor(c // 256, t[(xor(c % 256, b) + 1)::INT])) AS c FROM documents, crc),
h AS (SELECT doc_id, lang, n_chars, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
  coalesce(strlen(text) || ':' || text, '-') AS tail, xor(c, 4294967295::UBIGINT) % 7 = 0 AS hit FROM f),
leaves AS (SELECT doc_id, lang, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
  CASE WHEN hit AND n_chars IS NOT NULL THEN sha256(head || strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1) || tail) END AS changed FROM h),
ranked AS (SELECT *, coalesce('=' || lang, '-') AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM leaves),
nodes AS (SELECT tree, 0 AS level, pos, n, leaf AS digest FROM ranked UNION ALL
  SELECT tree, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY tree, level, n, pos // 2),
subs AS (SELECT tree, digest AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (SELECT 0 AS level, pos, n, subroot AS digest FROM subs UNION ALL
  SELECT level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY pos)) FROM tops WHERE n > 1 GROUP BY level, n, pos // 2),
low AS (SELECT doc_id, tree, leaf, 0 AS level, pos, n, coalesce(changed, leaf) AS value, '' AS proof FROM ranked UNION ALL
  SELECT doc_id, l.tree, leaf, l.level + 1, l.pos // 2, (l.n + 1) // 2, sha256(CASE WHEN l.pos % 2 = 0 THEN value || coalesce(digest, '') ELSE digest || value END), proof || coalesce(digest, '')
  FROM low l LEFT JOIN nodes s ON s.tree = l.tree AND s.level = l.level AND s.pos = xor(l.pos, 1) WHERE l.n > 1),
high AS (SELECT doc_id, leaf, subroot, 0 AS level, s.pos, s.n, value, proof FROM low JOIN subs s USING (tree) WHERE low.n = 1 UNION ALL
  SELECT doc_id, leaf, subroot, l.level + 1, l.pos // 2, (l.n + 1) // 2, sha256(CASE WHEN l.pos % 2 = 0 THEN value || coalesce(digest, '') ELSE digest || value END), proof || coalesce(digest, '')
  FROM high l LEFT JOIN tops s ON s.level = l.level AND s.pos = xor(l.pos, 1) WHERE l.n > 1)
SELECT doc_id, leaf, subroot, digest AS root, sha256(proof) AS proof_sha256, value AS folded_root, value = digest AS verified FROM high, (SELECT digest FROM tops WHERE n = 1) WHERE high.n = 1
"""
