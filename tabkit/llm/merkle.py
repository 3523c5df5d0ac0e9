"""Merkle manifest of a table: a tree of hashes for each group of rows, a tree over the groups, and a proof for each row.

Only every few levels of a tree are kept. Proofs take the rest from them:

1. Leaves are hashed where their rows lie and sorted by (group, order, leaf) over range partitions, which split large groups. A leaf's
   place in its group is its place in its partition plus the rows before, counted once for each group and partition.
2. ``every`` levels up from a stored level, the nodes of one aligned subtree (at most arity ** every) meet, make the levels between
   in an array, and only the top one is written: a checkpoint. A group ends where one node is left. A step up is one shuffle of rows cut by
   arity ** every; no task holds more than its subtrees.
3. A proof is made from the top down. The stored nodes of a subtree meet again, the levels between are made again from them, each
   node notes its siblings level by level, and the levels are dropped. The part of the proof above a subtree belongs to its stored top, so it
   joins on (group, subtree): a key with few rows, also in a hot group.

Hashing, sorting and folding are built-in functions. The tree over the groups is made by the same steps, so their number needs no bound.
Written tables cut the lineage. To the driver goes one row: the root, the deepest tree and the number of groups.

Null fields are hashed as ``-``, others as their length in UTF-8 bytes, ``:`` and the value as text, so empty and null differ. A null group is a group, the
first; a null order comes first in its group; ties are broken by the leaf, so repeated rows are leaves of their own with equal hashes.
Columns of any name may stand beside; only those named are read. An empty table has no root and no proofs.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabkit.llm.common import name, stage

EVERY = 4  # levels from one stored level to the next
_POWERS = 64


def leaf_of(fields: list[Column]) -> Column:
    """Hash of the values: `-` if null, else UTF-8 byte count, `:` and the value."""
    written = [F.coalesce(F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string")), F.lit("-")) for f in fields]
    return F.sha2(F.concat(*written).cast("binary"), 256)


class Tree(NamedTuple):
    """Stored levels of one tree for each group. Columns: grp, place (from 0), node, depth (levels of the group's tree); the first also the payload ``row``."""

    levels: list[DataFrame]
    tops: DataFrame  # grp, top, depth
    arity: int
    every: int


class Manifest(NamedTuple):
    tree: Tree
    groups: Tree  # over the groups' tops, as one group
    root: str | None


def _number(rows: DataFrame, order: list[str], label: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` sorted by (grp, order) with their place in their group, and one row per group with its size."""
    by = [F.col("grp").asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in order]]
    tied = rows.withColumn("tie", F.xxhash64(F.monotonically_increasing_id()))  # equal rows may lie in several partitions
    ranged = tied.repartitionByRange(*by, "tie").sortWithinPartitions(*by).drop("tie")
    ranged = stage(ranged.withColumn("at", F.monotonically_increasing_id()), f"{label}-sorted").withColumn("part", F.shiftright("at", 33))
    runs = ranged.groupBy("grp", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = stage(runs.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), f"{label}-runs")
    return ranged, runs


def _depth(size: Column, arity: int) -> Column:
    """Levels above the leaves until one node is left."""
    powers = [arity**k for k in range(_POWERS) if arity**k < 1 << 62]
    return F.size(F.filter(F.array(*[F.lit(p).cast("long") for p in powers]), lambda p: p < size))


def _up(nodes: Column, arity: int) -> Column:
    """The next level: each run of ``arity`` nodes becomes the hash of their texts."""
    return F.transform(F.sequence(F.lit(1), F.size(nodes), F.lit(arity)), lambda s: F.sha2(F.array_join(F.slice(nodes, s, arity), "").cast("binary"), 256))


def _subtrees(nodes: DataFrame, level: int, arity: int, every: int) -> tuple[DataFrame, list[str]]:
    """One row per aligned subtree above ``level`` with its members and, made from them, the levels up to the next stored one."""
    block = F.floor(F.col("place") / F.lit(arity**every)).cast("long")  # exact: places stay far below 2**53
    carried = [c for c in nodes.columns if c not in ("grp", "depth")]
    met = nodes.withColumn("block", block).groupBy("grp", "block").agg(F.min("depth").alias("depth"), F.sort_array(F.collect_list(F.struct("place", *[c for c in carried if c != "place"]))).alias("members"))
    met = met.withColumn("level0", F.col("members.node"))
    names = ["level0"]
    for k in range(1, every + 1):  # a group whose tree ends below keeps its last level
        met = met.withColumn(f"level{k}", F.when(F.col("depth") >= level + k, _up(F.col(names[-1]), arity)).otherwise(F.col(names[-1])))
        names.append(f"level{k}")
    return met, names


def build(leaves: DataFrame, arity: int = 3, every: int = EVERY, label: str = "tree") -> Tree:
    """The trees over (grp, place, node, depth, row): every ``every``-th level is written."""
    levels, tops, level = [leaves], [leaves.where("depth = 0").select("grp", F.col("node").alias("top"), "depth")], 0
    deepest = leaves.agg(F.max("depth")).first()[0] or 0
    while level < deepest:
        met, names = _subtrees(levels[-1].where(F.col("depth") > level).select("grp", "place", "node", "depth"), level, arity, every)
        nodes = stage(met.select("grp", F.col("block").alias("place"), F.col(names[-1])[0].alias("node"), "depth"), f"{label}-level")
        level += every
        levels.append(nodes)
        tops.append(nodes.where(F.col("depth") <= level).select("grp", F.col("node").alias("top"), "depth"))
    every_top = tops[0]
    for t in tops[1:]:
        every_top = every_top.unionByName(t)
    return Tree(levels, every_top, arity, every)


def proofs(tree: Tree, above: DataFrame) -> DataFrame:
    """For each leaf: grp, place, node, row and ``steps``, the siblings before and after it level by level, then those of ``above``.

    ``above`` has for each grp the steps that follow its top, and further columns to hand down.
    """
    extra = [c for c in above.columns if c not in ("grp", "steps")]
    upper = None
    for k in range(len(tree.levels) - 1, -1, -1):
        level = k * tree.every
        nodes = tree.levels[k]
        payload = [c for c in nodes.columns if c not in ("grp", "place", "node", "depth")]
        ended = nodes.where((F.col("depth") <= level) & (F.col("place") == 0)).select("grp", "place", *(["node", *payload] if k == 0 else []))
        ended = ended.join(above, "grp")
        if upper is None:
            upper = ended
            continue
        met, names = _subtrees(nodes.where(F.col("depth") > level), level, tree.arity, tree.every)
        met = met.join(upper.withColumnRenamed("place", "block"), ["grp", "block"])
        made = met.select("grp", "depth", "steps", *extra, *names, F.posexplode("members").alias("at", "member"))
        steps = []
        for j in range(tree.every):
            nodes_j, at = F.col(names[j]), F.floor(F.col("at") / F.lit(tree.arity**j)).cast("int")
            run = at - at % tree.arity
            both = F.struct(F.array_join(F.slice(nodes_j, run + 1, at - run), "").alias("before"), F.array_join(F.slice(nodes_j, at + 2, run + tree.arity - 1 - at), "").alias("after"))
            steps.append(F.when(F.col("depth") > level + j, both))
        own = F.filter(F.array(*steps), lambda s: s.isNotNull())
        upper = made.select("grp", F.col("member.place").alias("place"), *([F.col(f"member.{c}").alias(c) for c in ["node", *payload]] if k == 0 else []), F.concat(own, "steps").alias("steps"), *extra)
        upper = upper.unionByName(ended)
    return upper


def fold(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(steps, leaf, lambda node, s: F.sha2(F.concat(s["before"], node, s["after"]).cast("binary"), 256))


def proof_hash(steps: Column) -> Column:
    return F.sha2(F.array_join(F.transform(steps, lambda s: F.concat(s["before"], s["after"])), "").cast("binary"), 256)


def manifest(rows: DataFrame, fields: list[str], group: str, order: str, keep: dict[str, Column] | None = None, arity: int = 3, every: int = EVERY) -> Manifest:
    """The stored trees of ``rows``: leaves are hashes of ``fields``, one tree for each ``group`` by ``order``. ``keep`` adds named columns to the leaves."""
    carried = F.struct(name(order).alias("order"), *[c.alias(n) for n, c in (keep or {}).items()])
    leaves = rows.select(name(group).cast("string").alias("grp"), name(order).alias("__order"), leaf_of([name(f) for f in fields]).alias("node"), carried.alias("row"))
    ranged, runs = _number(leaves, ["__order", "node"], "leaves")
    sizes = runs.groupBy("grp").agg(F.sum("n").alias("size")).select(F.lit(0).alias("grp"), F.col("grp").alias("name"), "size")
    listed, offsets = _number(sizes, ["name"], "groups")
    groups = listed.join(offsets.drop("grp"), "part").select("name", "size", (F.col("at") - F.col("first") + F.col("before")).alias("gid"))
    groups = stage(groups.withColumn("depth", _depth(F.col("size"), arity)), "groups")
    runs = runs.join(groups, runs["grp"].eqNullSafe(groups["name"])).select(F.col("grp").alias("of"), F.col("part").alias("of_part"), "first", "before", "gid", "depth")
    placed = ranged.join(runs, F.col("grp").eqNullSafe(F.col("of")) & (F.col("part") == F.col("of_part")))
    placed = placed.select(F.col("gid").alias("grp"), (F.col("at") - F.col("first") + F.col("before")).alias("place"), "node", "depth", "row")
    tree = build(stage(placed, "leaves"), arity, every, "leaves")
    n_groups = groups.count()
    tops = tree.tops.select(F.lit(0).cast("long").alias("grp"), F.col("grp").alias("place"), F.col("top").alias("node"), _depth(F.lit(n_groups).cast("long"), arity).alias("depth"))
    over = build(stage(tops, "tops"), arity, every, "groups")
    root = over.tops.first()
    return Manifest(tree, over, root["top"] if root else None)


def prove(made: Manifest) -> DataFrame:
    """For each row: row (its order and what was kept), leaf, subroot, root and steps, its proof from the leaf up to the root."""
    start = made.groups.tops.select("grp", F.expr("cast(array() as array<struct<before: string, after: string>>)").alias("steps"))
    over = proofs(made.groups, start).select(F.col("place").alias("grp"), F.col("node").alias("subroot"), "steps")
    shown = proofs(made.tree, stage(over, "group-proofs"))
    return shown.select("row", F.col("node").alias("leaf"), "subroot", F.lit(made.root).alias("root"), "steps")
