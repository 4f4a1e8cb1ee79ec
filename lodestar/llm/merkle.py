"""A Merkle manifest of a dataset by supersteps over RDDs, in the manner of Pregel.

Rows become leaves; those of a group make a tree, in order, and the groups' roots make the tree above them. Parents are H
(SHA-256 in hex) of their children's digests, one after the other; of ``fanout`` nodes in a row, the last parent may have fewer.

Going up, every node sends its digest to the block that it belongs to, of ``fanout ** stride`` consecutive nodes; a block holds
the whole subtree above its nodes, hashes its parents level by level as they are complete, and forwards the one on top in the
next superstep. So a superstep covers ``stride`` levels, a message goes to a group of at most 256 nodes, and a billion leaves
take four supersteps. Going down, each block gets its top node's path to the root and sends every node its own: the siblings
inside the block, then that path. Nothing of a tree meets in one task but its top block.

Leaves are put in order by a range partitioning (repeated rows too, by a random number that is written with them), and a row's
place in its group is its place in the partition less where the group begins there; the driver sees one row for each partition.
Numbered leaves and the nodes of each superstep are files in the shared folder, so a lost executor costs only its tasks.

Defined results: a null in any column is hashed as ``-``; null groups are one group, before the others; null keys come first;
rows with equal keys are in order of their leaves, so repeated rows have the same leaf but a place and a path each; a group
of one row has its leaf as root; an empty table gives an empty manifest; columns that aren't named are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

from pyspark import RDD
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import stage, staging_path, task_count
from .names import column

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Children of a node; levels that a superstep covers.
FANOUT, STRIDE = 2, 8
_PROOF = "array<struct<left: string, right: string>>"


def leaf_digest(*values: Column) -> Column:
    """H of the values in turn: ``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def leaves(docs: DataFrame, presented: dict[str, Column] | None = None, columns: tuple[str, ...] = COLUMNS, group: str = "lang", key: str = "doc_id") -> DataFrame:
    """(key, group, leaf, presented) of every row. ``presented``: columns that are other than recorded in the digest that is held against the manifest."""
    own = [column(c) for c in columns]
    seen = [(presented or {}).get(c, column(c)) for c in columns]
    return docs.select(column(key).alias("key"), column(group).alias("group"), leaf_digest(*own).alias("leaf"), leaf_digest(*seen).alias("presented"))


def _borders(heads: list) -> tuple[list[tuple[int, int, int, int, int]], int, int]:
    """For each partition the number of its first tree, that tree's leaves before it, and all leaves of its first and of its last tree; how many trees there are, and the most leaves of a tree at a border. ``heads``: a row for each partition in order."""
    places, totals, trees, last = [], {}, 0, None
    for row in heads:
        goes_on = last is not None and last[0] == row["first"]["group"]
        tree, before = (last[1], totals[last[1]]) if goes_on else (trees, 0)
        totals[tree] = before + row["first"]["n"]
        end = tree + row["groups"] - 1
        if end > tree:
            totals[end] = row["last"]["n"]
        places.append((row["part"], tree, before, end))
        trees, last = end + 1, (row["last"]["group"], end)
    return [(part, tree, before, totals[tree], totals[end]) for part, tree, before, end in places], trees, max(totals.values(), default=0)


def _numbered(rows: DataFrame) -> tuple[DataFrame, int, int]:
    """The leaves with tree, index and the tree's number of leaves n; how many trees there are, and the most leaves of one."""
    spark = rows.sparkSession
    rows = stage(rows.withColumn("salt", F.rand(7)), "leaves")
    order = ["group", "key", "leaf", "salt"]
    rows = stage(rows.repartitionByRange(task_count(spark), *order).sortWithinPartitions(*order).drop("salt").withColumn("place", F.monotonically_increasing_id()), "leaves-in-order")
    rows = rows.withColumn("part", F.shiftright("place", 33))
    groups = stage(rows.groupBy("part", "group").agg(F.count("*").alias("n"), F.min("place").alias("begin")), "groups")
    held = F.struct("group", "n")
    heads = groups.groupBy("part").agg(F.count("*").alias("groups"), F.min_by(held, "begin").alias("first"), F.max_by(held, "begin").alias("last")).orderBy("part").collect()  # a row for each partition
    places, trees, most = _borders(heads)
    borders = F.broadcast(spark.createDataFrame(places, "part long, tree long, before long, first_n long, last_n long"))  # likewise
    within = Window.partitionBy("part")
    number = F.row_number().over(within.orderBy("begin"))
    groups = groups.join(borders, "part").withColumns({"number": number, "groups": F.count("*").over(within)})
    groups = groups.select(
        F.col("part").alias("p"), F.col("group").alias("g"), (F.col("tree") + F.col("number") - 1).alias("tree"), (F.col("begin") - F.when(F.col("number") == 1, F.col("before")).otherwise(0)).alias("zero"),
        F.when(F.col("number") == 1, F.col("first_n")).when(F.col("number") == F.col("groups"), F.col("last_n")).otherwise(F.col("n")).alias("n"),
    )
    found = rows.join(groups.hint("merge"), (F.col("part") == F.col("p")) & F.col("group").eqNullSafe(F.col("g")))
    most = max(most, max((r["most"] or 0 for r in groups.agg(F.max("n").alias("most")).collect()), default=0))
    return stage(found.select("tree", (F.col("place") - F.col("zero")).alias("index"), "n", "key", "leaf", "presented"), "numbered-leaves"), trees, most


def _hash(digests: list[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def _subtree(digests: list[str], n: int, fanout: int, stride: int) -> tuple[list[list[str]], int]:
    """The levels of the subtree above consecutive nodes of a level of ``n``, ``stride`` of them or until one node is the whole level; how many nodes the last level has in the tree."""
    rows = [digests]
    while n > 1 and len(rows) <= stride:
        rows.append([_hash(rows[-1][i : i + fanout]) for i in range(0, len(rows[-1]), fanout)])
        n = -(-n // fanout)
    return rows, n


def _staged(rdd: RDD, spark, name: str) -> RDD:
    path = staging_path(spark, name)
    rdd.saveAsPickleFile(path)
    return spark.sparkContext.pickleFile(path)


def _climb(nodes: RDD, most: int, spark, fanout: int, stride: int) -> list[RDD]:
    """The nodes (tree, index, n, digest, payload) that begin each superstep; those with n = 1 are roots."""
    size, parts, levels = fanout**stride, task_count(spark), [nodes]

    def complete(block: tuple[tuple[int, int], Iterable]) -> tuple:
        (tree, index), children = block
        children = sorted(children)
        rows, n = _subtree([digest for _, _, digest in children], children[0][1], fanout, stride)
        return tree, index, n, rows[-1][0], None

    while most > 1:
        messages = levels[-1].filter(lambda x: x[2] > 1).map(lambda x: ((x[0], x[1] // size), (x[1], x[2], x[3])))
        levels.append(_staged(messages.groupByKey(parts).map(complete), spark, "nodes"))
        most = -(-most // size)
    return levels


def _descend(levels: list[RDD], given: RDD, spark, fanout: int, stride: int) -> RDD:
    """(node, path, facts) of the nodes of the first level. ``given``: (tree, (path, facts)) of the roots, a path of (left, right) siblings' digests."""
    size, parts = fanout**stride, task_count(spark)

    def below(block: tuple[tuple[int, int], tuple[Iterable, Iterable]]) -> Iterator[tuple]:
        _, (children, messages) = block
        children = sorted(children, key=lambda x: x[1])
        if not children:
            return
        path, facts = next(iter(messages))
        rows, _ = _subtree([x[3] for x in children], children[0][2], fanout, stride)
        for place, child in enumerate(children):
            steps = []
            for row in rows[:-1]:
                first = place - place % fanout
                steps.append(("".join(row[first:place]), "".join(row[place + 1 : first + fanout])))
                place //= fanout
            yield child, (*steps, *path), facts

    found = None
    for level in reversed(levels):
        roots = level.filter(lambda x: x[2] == 1).map(lambda x: (x[0], x)).join(given, parts).map(lambda x: (x[1][0], *x[1][1]))
        if found is None:
            found = roots
            continue
        messages = found.map(lambda x: ((x[0][0], x[0][1]), (x[1], x[2])))
        found = level.filter(lambda x: x[2] > 1).map(lambda x: ((x[0], x[1] // size), x)).cogroup(messages, parts).flatMap(below).union(roots)
    return found


def manifest(rows: DataFrame, fanout: int = FANOUT, stride: int = STRIDE) -> DataFrame:
    """One row per leaf (``leaves`` makes them): key, leaf, presented, tree (the groups' number in order), index in it, subroot, root, and proof: the digests left and right of the node at each level from the leaf to the root."""
    spark = rows.sparkSession
    numbered, trees, most = _numbered(rows)
    kind = numbered.schema["key"].dataType.simpleString()
    schema = T.StructType.fromDDL(f"key {kind}, leaf string, presented string, tree long, index long, subroot string, root string, proof {_PROOF}")
    if not trees:
        return spark.createDataFrame([], schema)
    nodes = numbered.rdd.map(lambda r: (r["tree"], r["index"], r["n"], r["leaf"], (r["key"], r["presented"])))
    levels = _climb(nodes, most, spark, fanout, stride)
    subroots = spark.sparkContext.union([x.filter(lambda x: x[2] == 1) for x in levels]).map(lambda x: (0, x[0], trees, x[3], None))
    above = _climb(_staged(subroots, spark, "subroots"), trees, spark, fanout, stride)
    top = above[-1].filter(lambda x: x[2] == 1).map(lambda x: (x[0], ((), x[3])))
    given = _staged(_descend(above, top, spark, fanout, stride).map(lambda x: (x[0][1], (x[1], (x[0][3], x[2])))), spark, "paths")
    found = _descend(levels, given, spark, fanout, stride)
    return spark.createDataFrame(found.map(lambda x: (x[0][4][0], x[0][3], x[0][4][1], x[0][0], x[0][1], *x[2], list(x[1]))), schema, verifySchema=False)


def folded(digest: Column, proof: Column) -> Column:
    """The root that a leaf's digest and its proof give."""
    return F.aggregate(proof, digest, lambda d, step: F.sha2(F.concat(step["left"], d, step["right"]), 256))


def proof_digest(proof: Column) -> Column:
    """H of the siblings on the path, from the leaf's level up, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda step: F.concat(step["left"], step["right"])), ""), 256)


def verified(found: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root (from what is presented) and whether that is the root."""
    rows = found.withColumns({"folded_root": folded(F.col("presented"), F.col("proof")), "proof_sha256": proof_digest(F.col("proof"))})
    return rows.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
