"""Merkle manifest of a dataset by sibling-shift self-joins.

Every row is a leaf: the SHA-256 of its columns, each ``-`` if null, else its
UTF-8 byte count, ``:`` and its value. The rows of each group (source) are
numbered by id; while a group has several nodes, every ``fanout`` consecutive
ones become the digest of their digests. The groups' last nodes, in the order
of the groups, are hashed up to one root in the same way.

No node ever learns its siblings by a walk: a level is an equi-join of its
nodes with themselves at computed indices. The node in slot zero of each run
asks for its siblings (index XOR 1 for a binary tree, index + 1, 2, ...
otherwise), and slot-zero rows emit the parents. Going down again, each run
meets the path of its parent, a list of (digests to the left, digests to the
right) up to the root, and each leaf takes what stands around its own slot.
So a proof is folded row by row, without another shuffle.

Numbering is distributed: rows are range-sorted, numbered within their
partition, and shifted by the counts of the partitions before. No group is
sorted, or collected, in one task; runs hold at most ``fanout`` nodes.

Nulls and edge cases: null ids come first, a null group before all others (an
empty name is a group of its own). Rows with equal ids are ordered by their
leaf, so equal rows may stand in any order. A group's only leaf is its
subroot, and a table's only leaf its root, with a proof of no digests. An
empty table gives an empty result. Columns that are not named are not read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, stage

FANOUT = 16
COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
PATH = "array<struct<pre:string,post:string>>"


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts, one after the other."""
    return F.sha2(F.concat(*parts) if parts else F.lit(""), 256)


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns: dict[str, Column]) -> Column:
    return digest(*map(field, columns.values()))


def numbered(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``df``, staged, with ``idx`` (from 0, by ``order`` within its group) and ``n``, the group's size."""
    placed = stage(df.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
                   .withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.spark_partition_id()), "placed")
    own = [F.col(group).alias("_g"), F.col("_part").alias("_p")]
    counts = stage(placed.groupBy(*own).agg(F.min("_at").alias("_from"), F.count("*").alias("_n")), "counts")  # a row for each group in a partition
    shifts = _running(counts)
    joined = placed.join(shifts, (F.col(group) == F.col("_g")) & (F.col("_part") == F.col("_p")))
    return joined.select(*df.columns, (F.col("_at") - F.col("_from") + F.col("_before")).alias("idx"), F.col("_all").alias("n"))


def _running(counts: DataFrame) -> DataFrame:
    """The rows of a group before each of its partitions, and all of them. A group has at most one row for each partition."""
    from pyspark.sql import Window

    one = Window.partitionBy("_g")
    before = one.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).withColumn("_all", F.sum("_n").over(one))


def level_up(nodes: DataFrame, fanout: int) -> DataFrame:
    """Runs (tree, base, n, children) of a level's nodes (tree, idx, n, hash); ``base`` is the index of slot zero."""
    shifts = F.array(F.col("idx"), F.col("idx").bitwiseXOR(1)) if fanout == 2 else F.sequence("idx", F.col("idx") + (fanout - 1))
    wanted = nodes.where(F.col("idx") % fanout == 0).select(F.col("tree").alias("t"), F.col("idx").alias("base"), F.explode(shifts).alias("i"))
    met = wanted.join(nodes, (F.col("t") == F.col("tree")) & (F.col("i") == F.col("idx")))
    return met.groupBy("tree", "base").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("idx", "hash"))).alias("c")) \
        .select("tree", "base", "n", F.transform("c", lambda x: x["hash"]).alias("children"))


def build(nodes: DataFrame, fanout: int) -> tuple[list[DataFrame], DataFrame]:
    """Levels of runs from the leaves up, and (tree, hash, level) of each tree's last node, from nodes (tree, idx, n, hash)."""
    most = nodes.agg(F.max("n")).first()[0] or 0  # one number
    levels, tops, level = [], [], 0
    while True:
        tops.append(nodes.where("n = 1").select("tree", "hash", F.lit(level).alias("level")))
        if most <= 1:
            break
        runs = stage(level_up(nodes.where("n > 1"), fanout), "runs")
        levels.append(runs)
        up = digest(F.array_join("children", ""))
        nodes = runs.select("tree", (F.col("base") / fanout).cast("long").alias("idx"), F.ceil(F.col("n") / fanout).alias("n"), up.alias("hash"))
        most, level = -(-most // fanout), level + 1
    top = tops[0]
    for t in tops[1:]:
        top = top.union(t)
    return levels, stage(top, "tops")


def beside(children: Column, slot: Column) -> Column:
    """What stands before and after a slot."""
    return F.struct(F.array_join(F.slice(children, F.lit(1), slot), "").alias("pre"),
                    F.array_join(F.slice(children, slot + 2, F.size(children)), "").alias("post"))


def run_paths(levels: list[DataFrame], tops: DataFrame, fanout: int) -> DataFrame:
    """The lowest runs (t, base, children) with the path (array<struct<pre, post>>) of each one's parent.

    ``tops``: (tree, level, path). Each level's runs meet the paths of their parents by an equi-join on the parent's index.
    """
    paths = None
    for level in range(len(levels) - 1, -1, -1):
        done = tops.where(F.col("level") == level + 1).select("tree", F.lit(0).cast("long").alias("idx"), "path")
        paths = done if paths is None else done.union(paths)
        runs = levels[level].select(F.col("tree").alias("t"), "base", "children", (F.col("base") / fanout).cast("long").alias("up"))
        met = runs.join(paths, (F.col("t") == F.col("tree")) & (F.col("up") == F.col("idx"))).select("t", "base", "children", "path")
        if level:
            child = met.select("t", "base", "children", "path", F.explode(F.sequence(F.lit(0), F.size("children") - 1)).alias("slot"))
            paths = stage(child.select(F.col("t").alias("tree"), (F.col("base") + F.col("slot")).alias("idx"),
                                       F.concat(F.array(beside(F.col("children"), F.col("slot"))), "path").alias("path")), "paths")
        else:
            return met
    raise ValueError("no levels")


def leaf_paths(nodes: DataFrame, levels: list[DataFrame], tops: DataFrame, fanout: int) -> DataFrame:
    """``nodes`` with ``path``. ``tops``: (tree, level, path)."""
    alone = nodes.where("n = 1").join(tops.where("level = 0").select(F.col("tree").alias("t"), "path"), F.col("tree") == F.col("t")) \
        .select(*nodes.columns, "path")
    if not levels:
        return alone
    runs = run_paths(levels, tops, fanout).withColumnRenamed("path", "above")
    base = F.col("idx") - F.col("idx") % fanout
    met = nodes.where("n > 1").join(runs, (F.col("tree") == F.col("t")) & (base == F.col("base")))
    own = beside(F.col("children"), (F.col("idx") % fanout).cast("int"))
    return met.select(*nodes.columns, F.concat(F.array(own), "above").alias("path")).union(alone)


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, start, lambda h, p: digest(p["pre"], h, p["post"]))


def manifest(leaves: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """``leaves`` (tree, doc_id, leaf, and more) with ``subroot``, ``root`` and ``path``, from the leaf's siblings to the root's children.

    ``tree`` is not null; trees are ordered by it.
    """
    nodes = numbered(leaves, "tree", ["doc_id", "leaf"]).withColumn("hash", F.col("leaf"))
    nodes = stage(nodes, "leaves")
    levels, tops = build(nodes.select("tree", "idx", "n", "hash"), fanout)
    roots = stage(numbered(tops.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "hash", "level"), "tree", ["name"]), "subroots")
    upper, top = build(roots.select("tree", "idx", "n", "hash"), fanout)
    empty = F.array().cast(PATH)
    top = top.select("tree", "level", empty.alias("path"), F.col("hash").alias("root"))
    ways = stage(leaf_paths(roots, upper, top, fanout).select(F.col("name").alias("tree"), "level", "path", F.col("hash").alias("subroot")), "ways")
    root = top.select("root").first()
    found = leaf_paths(nodes, levels, ways, fanout)
    subroots = ways.select(F.col("tree").alias("t"), "subroot")
    return found.join(subroots, F.col("tree") == F.col("t")).select(*leaves.columns, "subroot", F.lit(root[0] if root else None).cast("string").alias("root"), "path")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    columns = {c: F.col(c) for c in COLUMNS}
    lower = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    struck = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    leaves = docs.select("doc_id", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")).alias("tree"), leaf(columns).alias("leaf"),
                         F.when(struck, leaf(columns | {"text": lower})).alias("tampered"))
    proved = manifest(leaves)
    siblings = F.array_join(F.transform("path", lambda p: F.concat(p["pre"], p["post"])), "")
    return proved.select("doc_id", "leaf", "subroot", "root", digest(siblings).alias("proof_sha256"),
                         fold(F.coalesce("tampered", "leaf"), F.col("path")).alias("folded_root")) \
        .withColumn("verified", F.col("folded_root") == F.col("root"))
