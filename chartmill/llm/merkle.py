"""Merkle manifest of a dataset by slot pivots: digests, inclusion proofs and their check."""

from __future__ import annotations

import string
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartmill.llm.common import write_table
from chartmill.operators.ordered import numbered

# fixed values: children of a node, fields of a leaf in their order
FANOUT = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<left:string,right:string>>"
SLOTS = [f"c{k}" for k in range(FANOUT)]


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of the joined parts, null parts counting as empty."""
    return F.sha2(F.concat_ws("", *parts), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the count of UTF-8 bytes, a colon and the value."""
    spelt = value.cast("string")
    return F.when(spelt.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(spelt).cast("string"), F.lit(":"), spelt))


def leaf_digest(**changed: Column) -> Column:
    """Digest of a row of ``documents``; ``changed`` replaces columns by name."""
    return digest(*[field(changed.get(c, F.col(c))) for c in FIELDS])


@dataclass(frozen=True)
class Tree:
    """Trees over ``nodes(tree, pos, digest)``.

    ``levels[L]`` holds the parents of level L nodes, one row each with the
    children's digests in the columns ``c0..c15``; ``roots`` is ``(tree,
    level, digest)``, the level being that of the node that is left over.
    """

    levels: list[DataFrame]
    roots: DataFrame | None


def build(nodes: DataFrame, label: str) -> Tree:
    """Pivot every 16 consecutive nodes of a tree into one row, level by level.

    Conditional aggregates spread the children over the slot columns; joining
    these hashes the parent. A tree is done when its first node has no
    neighbour, which the pivoted row shows by itself, so no tree is counted.
    Groups have 16 rows at most, however large a tree is. Each level is
    written, a sixteenth of the one below.
    """
    levels, roots = [], []
    while True:
        slots = [F.max(F.when(F.col("pos") % FANOUT == k, F.col("digest"))).alias(c) for k, c in enumerate(SLOTS)]
        parents = nodes.groupBy("tree", F.expr(f"pos div {FANOUT}").alias("pos")).agg(*slots)
        alone = (F.col("pos") == 0) & F.col("c1").isNull()
        parents = write_table(parents.select("*", digest(*map(F.col, SLOTS)).alias("digest"), alone.alias("alone")), f"{label}-level")
        roots.append(parents.filter("alone").select("tree", F.lit(len(levels)).alias("level"), F.col("c0").alias("digest")))
        rest = parents.filter("NOT alone").drop("alone")
        if rest.isEmpty():
            break
        levels.append(rest)
        nodes = rest.select("tree", "pos", "digest")
    return Tree(levels, reduce(DataFrame.unionByName, roots))


def around(slot: Column) -> Column:
    """The siblings of a slot, left and right of it: all slot columns but its own."""
    left = F.concat_ws("", *[F.when(slot > k, F.col(c)) for k, c in enumerate(SLOTS)])
    right = F.concat_ws("", *[F.when(slot < k, F.col(c)) for k, c in enumerate(SLOTS)])
    return F.struct(left.alias("left"), right.alias("right"))


def _same(a: DataFrame, b: DataFrame, *more: Column) -> Column:
    return reduce(Column.__and__, more, a.tree.eqNullSafe(b.tree))


def parents_with_paths(tree: Tree, roots: DataFrame) -> DataFrame | None:
    """The parents of the leaves with the ``path`` of siblings from them to the root.

    ``roots`` is ``(tree, level, subroot, path)``: what every tree's root
    hands down. A path is stored once for 16 leaves. None if no tree has more
    than a leaf.
    """
    held = None
    for level in reversed(range(len(tree.levels))):
        parents = tree.levels[level].drop("digest")
        tops = roots.filter(F.col("level") == level + 1).select("tree", F.lit(0).cast("bigint").alias("pos"), "subroot", "path")
        if held is not None:
            slot = F.explode(F.sequence(F.lit(0), F.lit(FANOUT - 1)))
            below = held.select("*", slot.alias("slot"))
            own = F.element_at(F.array(*SLOTS), F.col("slot") + 1)
            tops = tops.unionByName(below.filter(own.isNotNull()).select(
                "tree", (F.col("pos") * FANOUT + F.col("slot")).alias("pos"), "subroot", F.concat(F.array(around(F.col("slot"))), F.col("path")).alias("path")
            ))
        held = parents.join(tops, _same(parents, tops, parents.pos == tops.pos)).select(parents["*"], tops.subroot, tops.path)
    return held


@dataclass(frozen=True)
class Manifest:
    """Leaves in their order (``tree`` is the source) with their trees, the tree over the sources, and the root, null for no rows."""

    leaves: DataFrame
    sources: Tree
    top_leaves: DataFrame
    top: Tree
    root: str | None


def manifest(leaves: DataFrame) -> Manifest:
    """Manifest of ``leaves(tree, doc_id, digest, ...)``.

    Leaves of a source ascend by id, a null id first, equal ids by digest.
    Positions come from range partitions, so a source with most of the rows is
    spread out. The roots of the sources, null first and then by their bytes,
    are the leaves of the tree above.
    """
    placed = write_table(numbered(leaves, ["tree"], ["doc_id", "digest"], "pos").withColumn("pos", F.col("pos") - 1), "merkle-leaves")
    sources = build(placed.select("tree", "pos", "digest"), "merkle")
    named = sources.roots.select(F.lit("").alias("tree"), F.col("tree").alias("source"), "level", "digest")
    top_leaves = write_table(numbered(named, ["tree"], ["source"], "pos").withColumn("pos", F.col("pos") - 1), "merkle-sources")
    top = build(top_leaves.select("tree", "pos", "digest"), "merkle-top")
    root = top.roots.first()
    return Manifest(placed, sources, top_leaves, top, root.digest if root else None)


def with_paths(tree: Tree, roots: DataFrame, leaves: DataFrame) -> DataFrame:
    """``leaves`` with ``subroot`` and ``path``, the siblings of all levels from the leaf on."""
    single = roots.filter("level = 0")
    first = leaves.filter("pos = 0")
    out = first.join(single, _same(first, single)).select(first["*"], single.subroot, single.path)
    held = parents_with_paths(tree, roots)
    if held is None:
        return out
    keyed = leaves.withColumns({"parent": F.expr(f"pos div {FANOUT}"), "slot": F.col("pos") % FANOUT})
    joined = keyed.join(held, _same(keyed, held, keyed.parent == held.pos))
    path = F.concat(F.array(around(F.col("slot"))), F.col("path")).alias("path")
    return out.unionByName(joined.select(*[keyed[c] for c in leaves.columns], held.subroot, path))


def inclusion_paths(m: Manifest) -> DataFrame:
    """Every leaf of a manifest with its ``subroot`` and its ``path`` to the root, as ``PATH``."""
    none = m.top.roots.select("tree", "level", F.col("digest").alias("subroot"), F.array().cast(PATH).alias("path"))
    tops = with_paths(m.top, none, m.top_leaves.withColumnRenamed("level", "height"))
    roots = tops.select(F.col("source").alias("tree"), F.col("height").alias("level"), F.col("digest").alias("subroot"), "path")
    return with_paths(m.sources, write_table(roots, "merkle-roots"), m.leaves)


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf digest and the siblings of a path give."""
    return F.aggregate(path, start, lambda h, s: digest(s["left"], h, s["right"]))


def tampered(doc_id: Column) -> Column:
    """Rows whose text the check lower-cases: the checksum of their id divides by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def verify_manifest(docs: DataFrame) -> DataFrame:
    """Manifest of ``docs`` and the proof of every row: ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``.

    Rows of ``tampered`` ids are changed (A-Z of the text in lower case) after
    the manifest was made; ``folded_root`` is what their leaf and the original
    siblings give, ``verified`` whether that is the root. A change that leaves
    the text as it was is none.

    Nulls count as ``-`` in a leaf and differ from empty values. Null sources
    are one source, the first; a null id comes first in its source and is not
    tampered. Repeated rows are leaves of their own with one digest, in
    neighbouring places; which of them has which place does not show but in
    their proofs. Extra columns are not read. No rows give no rows.
    """
    low = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    changed = F.when(tampered(F.col("doc_id")), leaf_digest(text=low))
    leaves = write_table(docs.select(F.col("source").alias("tree"), "doc_id", leaf_digest().alias("digest"), changed.alias("changed")), "merkle-digests")
    m = manifest(leaves)
    proof = F.transform("path", lambda s: F.concat(s["left"], s["right"]))
    out = inclusion_paths(m).select(
        "doc_id", F.col("digest").alias("leaf"), "subroot", F.lit(m.root).cast("string").alias("root"), F.sha2(F.array_join(proof, ""), 256).alias("proof_sha256"),
        folded(F.coalesce("changed", "digest"), F.col("path")).alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
