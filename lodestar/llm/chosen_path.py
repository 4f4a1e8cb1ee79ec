"""N-gram Jaccard join by chosen paths.

A text is the set of its shingles (``words`` words after lower-casing A-Z). Texts with equal sets are one node. In a run,
a node goes to the buckets of the shingles that a hash, seeded by run and path, samples with probability BRANCHES / |set|:
two sets that are alike sample the same shingle often. A bucket of at most ``limit`` nodes is brute-forced; a larger one
splits again by shingles sampled along the path, down to DEPTH, unless its nodes are alike on average, when splitting parts
nothing. One of over ``block`` nodes is compared in blocks, all pairs of blocks in groups of their own, so no size is too much
and none is dropped. ``runs_for`` repeats runs until a pair at the
threshold is missed with probability at most 1 - recall, by the branching process that the sampling is.

A pair is judged once, in the least leaf bucket that both are in. There bottom-k sketches rule most pairs out, and exact
set sizes decide the rest. A bucket returns each node's number of links and its root in the bucket, never the pairs, so
its output is as long as its input; alternating stars join the roots to classes.

Defined results: texts of fewer words are one shingle, texts without words are one class without links; null text is
empty; rows that repeat a doc_id are judged each by its own text, and so are rows with a null doc_id; class_id is the least
doc_id of the class and copy_id that of the equal sets, null only where no row has one; an empty table gives an empty
result; very long texts are whole sets like others; other columns are not read, whatever their names.

Every join by a key that many rows may share (a bucket, a node with many copies, the root of a large class) broadcasts the few
frequent keys. Counting the links among the n different texts of one group compares all of them, n / block * n / block products of
matrices spread over as many groups; only counts and roots leave a group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage, task_count
from .arrays import LOWER, MIX1, MIX2, mix, slices, span_hashes, text_bytes, words
from .components import components
from .hot_keys import join_spread
from .names import fresh

#: Words of a shingle, least Jaccard similarity, recall of a pair at it.
WORDS, SIMILARITY, RECALL = 5, 0.8, 0.9999
#: Expected shingles sampled at a node, levels, nodes brute-forced at once, least hashes kept in a sketch.
BRANCHES, DEPTH, LIMIT, SKETCH = 2.5, 3, 256, 64
#: Nodes compared in one task, mean agreement from which a large bucket isn't split.
BLOCK, ALIKE = 1024, 0.5
#: Standard deviations that a sketch's estimate may lie below the threshold.
SLACK = 4.5
_U = np.uint64


def runs_for(similarity: float, recall: float, branches: float = BRANCHES, depth: int = DEPTH) -> int:
    """Runs until a pair at the threshold is in one leaf bucket with probability ``recall``: a branching process whose nodes have Poisson(branches * similarity) common children."""
    missed = 0.0
    for _ in range(depth):
        missed = math.exp(-branches * similarity * (1 - missed))
    return math.ceil(math.log(1 - recall) / math.log(missed))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data = LOWER[data]
    starts, ends, owner = words(data, offsets)
    hashes = span_hashes(data, starts, ends)
    first = np.searchsorted(owner, np.arange(len(offsets)))
    rolled = np.zeros(max(0, len(hashes) - n + 1), _U)
    for i in range(n):
        rolled += mix(hashes[i : i + len(rolled)] + _U(i)) * _U(2 * i + 1)
    rolled = mix(rolled)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= n:
            own = np.sort(rolled[a : b - n + 1])
            out.append(own[np.append(True, own[1:] != own[:-1])])
        elif b > a:
            own = _U(b - a)
            with np.errstate(over="ignore"):
                for h in hashes[a:b]:
                    own = mix(np.array([own * MIX1 + h]))[0]
            out.append(np.array([own], _U))
        else:
            out.append(np.zeros(0, _U))
    return out


def _sampled(tokens: np.ndarray, seeds: np.ndarray, branches: float) -> tuple[np.ndarray, np.ndarray]:
    """(seed number, child key) of the tokens that each seed samples."""
    bound = _U(min(2**64 - 1, int(branches / len(tokens) * 2.0**64)))
    rows, keys = [], []
    for a in range(0, len(tokens), 8192):
        part = tokens[a : a + 8192]
        drawn = (part[None, :] ^ seeds[:, None]) * MIX1
        drawn = (drawn ^ (drawn >> _U(32))) * MIX2
        row, at = np.nonzero(drawn <= bound)
        rows.append(row)
        keys.append(mix(seeds[row] * MIX2 + part[at]))
    return np.concatenate(rows), np.concatenate(keys)


def path_tree(tokens: np.ndarray, runs: int, depth: int = DEPTH, branches: float = BRANCHES) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each level (key of the parent, key): the buckets that a set chooses."""
    seeds, levels = mix(np.arange(1, runs + 1, dtype=_U) * MIX1), []
    for _ in range(depth):
        if not len(tokens) or not len(seeds):
            levels.append((np.zeros(0, _U), np.zeros(0, _U)))
            continue
        row, keys = _sampled(tokens, seeds, branches)
        levels.append((seeds[row], keys))
        seeds = np.unique(keys)
    return levels


def node_of(tokens: np.ndarray) -> int:
    """The 64-bit name of a set."""
    if not len(tokens):
        return 0
    with np.errstate(over="ignore"):
        return int(mix(np.array([np.bitwise_xor.reduce(mix(tokens)) * MIX2 + tokens.sum() + _U(len(tokens))]))[0].view(np.int64))


def _lists(parts: list[np.ndarray]) -> pa.Array:
    edges = np.concatenate([[0], np.cumsum([len(x) for x in parts])])
    return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(np.concatenate([*parts, np.zeros(0, _U)]).astype(_U).view(np.int64)))


def text_key(text_col: str) -> Column:
    """A text's 64-bit hash, which tells rows of one doc_id apart."""
    return F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))


def features(docs: DataFrame, runs: int, n: int, text_col: str, id_col: str) -> DataFrame:
    """doc_id, text_key, node, size, the bucket keys of each level with their parents, and the sketch of each text."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(source, "text", 1 << 20):
            sets = shingle_sets(*text_bytes(part.column("text")), n)
            trees = [path_tree(s, runs) for s in sets]
            columns = [part.column("doc_id"), part.column("text_key"), pa.array([node_of(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), _lists([s[:SKETCH] for s in sets])]
            for level in range(DEPTH):
                columns += [_lists([t[level][0] for t in trees]), _lists([t[level][1] for t in trees])]
            yield pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", "text_key", "node", "size", "sketch", *[f"{x}{i}" for i in range(1, DEPTH + 1) for x in ("from", "to")]]
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_key(text_col).alias("text_key"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(batches, ", ".join(["doc_id long", "text_key long", "node long", "size long", *[f"{x} array<long>" for x in names[4:]]]))


def _alike(posts: DataFrame, nodes: DataFrame) -> DataFrame:
    """(key, alike): the chance that two nodes of a bucket agree on a minimum of their sketches, under the bucket's own hash."""
    own = posts.groupBy("node").agg(F.collect_list(F.struct("key", "n")).alias("at"))  # at most a tree's keys; a node meets its sketch once
    least = F.expr("transform(at, a -> struct(a.key AS key, a.n AS n, array_min(transform(sketch, x -> xxhash64(x, a.key))) AS m))")
    rows = own.join(nodes.select("node", "sketch"), "node").select(F.explode(least).alias("a")).select("a.*")
    held = rows.groupBy("key", "n", "m").agg(F.count("*").alias("c"))
    return held.groupBy("key").agg((F.sum(F.col("c") * F.col("c")) / F.max(1.0 * F.col("n") * F.col("n"))).alias("alike"), F.max("n").alias("n"))


def leaves(nodes: DataFrame, limit: int) -> DataFrame:
    """(node, bucket, n): the buckets of two or more nodes that are brute-forced.

    Larger ones split again, but for those at the last level and those whose nodes are alike on average, which no split would part.
    """
    found = None
    reached = None  # (node, ups) of the nodes in buckets that split again
    for level in range(1, DEPTH + 1):
        if reached is None:
            posts = nodes.select("node", F.explode(f"to{level}").alias("key"))
        else:
            tree = nodes.select("node", F.arrays_zip(F.col(f"from{level}").alias("up"), F.col(f"to{level}").alias("key")).alias("tree")).join(reached, "node")
            posts = tree.select("node", F.explode(F.expr("transform(filter(tree, x -> array_contains(ups, x.up)), x -> x.key)")).alias("key"))
        sizes = stage(posts.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), f"sizes{level}")
        total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
        posts = stage(join_spread(posts, sizes, "key", "n", total, F.xxhash64("node")), f"posts{level}")
        large = posts.filter(F.col("n") > limit)
        if level == DEPTH or large.isEmpty():
            return (posts if found is None else found.unionByName(posts)).select("node", F.col("key").alias("bucket"), "n")
        alike = stage(_alike(large, nodes).select("key", F.col("n").alias("m"), (F.col("alike") >= ALIKE).alias("stuck")), f"alike{level}")
        large = stage(join_spread(large, alike, "key", "m", total, F.xxhash64("node")).drop("m"), f"large{level}")
        own = posts.filter(F.col("n") <= limit).unionByName(large.filter("stuck").drop("stuck"))
        found = own if found is None else found.unionByName(own)
        reached = large.filter("not stuck").groupBy("node").agg(F.collect_set("key").alias("ups"))  # at most a tree's keys


def _incidence(rows: list[np.ndarray]) -> Iterator[np.ndarray]:
    """0/1 matrices, a chunk of values that two or more rows have at a time."""
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    values, place, count = np.unique(np.concatenate(rows), return_inverse=True, return_counts=True)
    number = np.cumsum(count > 1) - 1
    keep = count[place] > 1
    owner, column = owner[keep], number[place[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        i, j = np.searchsorted(column, [a, a + 4096])
        chunk = np.zeros((len(rows), min(4096, int(column[-1]) + 1 - a)), np.float32)
        chunk[owner[i:j], column[i:j] - a] = 1
        yield chunk


def common(rows: list[np.ndarray]) -> np.ndarray:
    """How many values each two rows share."""
    out = np.zeros((len(rows), len(rows)), np.float32)
    for chunk in _incidence(rows):
        out += chunk @ chunk.T
    return out


def _own_pairs(group: dict, bucket: int) -> np.ndarray:
    """The pairs (upper triangle) that are judged here: of different blocks if the group is of two, and in no lesser common leaf."""
    m = len(group["node"])
    pairs = np.triu(np.ones((m, m), bool), 1)
    if group["low"] != group["high"]:
        pairs &= group["block"][:, None] != group["block"][None, :]
    lesser = [x[x < bucket] for x in group["leaves"]]
    return pairs & (common(lesser) == 0) if any(map(len, lesser)) else pairs


def _sketched(group: dict, pairs: np.ndarray, similarity: float) -> np.ndarray:
    """Which ``pairs`` may reach ``similarity`` by their sizes and sketches."""
    sizes, sketches = group["size"], group["sketch"]
    pairs = pairs & (np.minimum(sizes[:, None], sizes) >= similarity * np.maximum(sizes[:, None], sizes) - 1e-9)
    if not pairs.any():
        return pairs
    last = np.array([s[-1] if n > len(s) else _U(2**64 - 1) for s, n in zip(sketches, sizes)], _U)
    below = np.array([np.searchsorted(s, np.minimum(last[i], last), "right") for i, s in enumerate(sketches)])
    shared = common(sketches)
    union = below + below.T - shared
    return pairs & (shared >= (similarity - SLACK * math.sqrt(similarity * (1 - similarity) / SKETCH)) * union)


def _groups(source: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The groups of sorted rows, over the batches' edges."""
    held: list[pa.RecordBatch] = []

    def made(rows: list[pa.RecordBatch]) -> Iterator[dict]:
        table = pa.Table.from_batches(rows).combine_chunks()
        keys = np.column_stack([table[c].to_numpy() for c in ("bucket", "low", "high")])
        edges = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(1)))
        for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(keys)]):
            if b - a > 1:
                part = table.slice(a, b - a)
                group = {c: part[c].to_numpy() for c in ("node", "size", "block") if c in table.column_names}
                for c in ("sketch", "leaves", "set"):
                    if c in table.column_names:
                        kind = np.int64 if c == "leaves" else _U
                        group[c] = [np.asarray(x.values, np.int64).view(kind) for x in part[c]]
                yield group | {c: int(k) for c, k in zip(("bucket", "low", "high"), keys[a])}

    for batch in source:
        if not batch.num_rows:
            continue
        key = [tuple(batch.column(c)[i].as_py() for c in ("bucket", "low", "high")) for i in (0, batch.num_rows - 1)]
        if held and tuple(held[-1].column(c)[held[-1].num_rows - 1].as_py() for c in ("bucket", "low", "high")) != key[0]:
            yield from made(held)
            held = []
        if key[0] == key[1]:
            held.append(batch)
            continue
        same = np.ones(batch.num_rows, bool)
        for c, k in zip(("bucket", "low", "high"), key[1]):
            same &= batch.column(c).to_numpy() == k
        cut = int(np.flatnonzero(same)[0])
        yield from made([*held, batch.slice(0, cut)])
        held = [batch.slice(cut)]
    if held:
        yield from made(held)


def _wanted(similarity: float):
    schema = pa.schema([("node", pa.int64()), ("bucket", pa.int64()), ("low", pa.int32()), ("high", pa.int32()), ("block", pa.int32()), ("leaves", pa.list_(pa.int64())), ("size", pa.int64()), ("sketch", pa.list_(pa.int64()))])

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The nodes of each group that are in a pair worth an exact look."""
        out: list[list] = [[] for _ in schema]
        for g in _groups(source):
            pairs = _sketched(g, _own_pairs(g, g["bucket"]), similarity)
            for i in np.flatnonzero(pairs.any(0) | pairs.any(1)).tolist():
                for column, value in zip(out, (g["node"][i], g["bucket"], g["low"], g["high"], g["block"][i], g["leaves"][i], g["size"][i], g["sketch"][i].view(np.int64))):
                    column.append(value)
            if len(out[0]) >= 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, schema.types)], schema=schema)
                out = [[] for _ in schema]
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, schema.types)], schema=schema)

    return batches


def _links(similarity: float):
    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each node's links in its group, and its root there."""
        nodes, roots, counts = [], [], []
        for g in _groups(source):
            pairs = _sketched(g, _own_pairs(g, g["bucket"]), similarity)
            if not pairs.any():
                continue
            shared = common(g["set"]).astype(np.float64)
            sizes = g["size"].astype(np.float64)
            linked = pairs & (shared >= similarity * (sizes[:, None] + sizes - shared) - 1e-9)
            linked |= linked.T
            degree = linked.sum(0)
            label = g["node"].copy()
            while True:  # least node that each reaches
                least = np.minimum(label, np.where(linked, label[None, :], np.iinfo(np.int64).max).min(1))
                if (least == label).all():
                    break
                label = least
            own = np.flatnonzero(degree)
            nodes += g["node"][own].tolist()
            roots += label[own].tolist()
            counts += degree[own].tolist()
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(roots, pa.int64()), pa.array(counts, pa.int64())], ["node", "root", "links"])

    return batches


def _dealt(rows: DataFrame) -> DataFrame:
    keys = ("bucket", "low", "high")
    return rows.repartition(task_count(rows.sparkSession), *keys).sortWithinPartitions(*keys, "node")


def _judged(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", n: int = WORDS, similarity: float = SIMILARITY, recall: float = RECALL, limit: int = LIMIT, block: int = BLOCK) -> DataFrame:
    """``similar_texts`` with each row's text_key and the root of its class."""
    spark = docs.sparkSession
    runs = runs_for(similarity, recall)
    found = stage(features(docs, runs, n, text_col, id_col), "features")
    copies = stage(found.groupBy("node").agg(F.min("doc_id").alias("copy_id"), F.count("*").alias("n_copies")), "copies")
    nodes = found.filter("size > 0").dropDuplicates(["node"])
    leaf = stage(leaves(nodes, limit), "leaves")
    lists = leaf.groupBy("node").agg(F.sort_array(F.collect_set("bucket")).alias("leaves"), F.collect_set(F.struct("bucket", "n")).alias("at"))  # at most a tree's keys
    blocks = F.ceil(F.col("a.n") / block).cast("int")
    posts = (
        nodes.select("node", "size", "sketch").join(lists, "node").select("*", F.explode("at").alias("a"))
        .select("node", "size", "sketch", "leaves", F.col("a.bucket").alias("bucket"), blocks.alias("blocks"), F.pmod(F.xxhash64("node"), blocks).cast("int").alias("block"))
        .select("*", F.explode(F.expr("sequence(0, blocks - 1)")).alias("other"))
        .select("node", "bucket", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "leaves", "size", "sketch")
    )
    # both blocks of a pair, and each block by itself, meet in one group
    shape = "node long, bucket long, low int, high int, block int, leaves array<long>, size long, sketch array<long>"
    wanted = stage(_dealt(posts).mapInArrow(_wanted(similarity), shape), "wanted")
    ids = copies.join(wanted.select("node").distinct(), "node", "left_semi").select(F.col("copy_id").alias("id")).distinct()
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    texts = rows.join(ids.hint("merge"), "id", "left_semi").unionByName(rows.filter("id is null"))  # a join by null would be one task's

    def sets(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(source, "text", 1 << 20):
            own = shingle_sets(*text_bytes(part.column("text")), n)
            yield pa.RecordBatch.from_arrays([pa.array([node_of(s) for s in own], pa.int64()), _lists(own)], ["node", "set"])

    full = texts.mapInArrow(sets, "node long, set array<long>").dropDuplicates(["node"])
    judged = stage(_dealt(wanted.join(full, "node")).mapInArrow(_links(similarity), "node long, root long, links long"), "links")
    links = judged.groupBy("node").agg(F.sum("links").alias("n_links"))
    roots = components(judged.select(F.col("node").alias("u"), F.col("root").alias("v")))
    named = copies.join(links, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = stage(named, "named")
    classes = named.groupBy("root").agg(F.min("copy_id").alias("class_id"), F.count("*").alias("n_nodes"))
    answers = join_spread(named, stage(classes, "classes"), "root", "n_nodes", named.count(), F.xxhash64("node"))
    answers = stage(answers.select("node", "root", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "copy_id", "n_copies"), "answers")
    rows = join_spread(found.select("doc_id", "text_key", "node"), answers, "node", "n_copies", found.count(), F.xxhash64("doc_id", "text_key"))
    return rows.select("doc_id", "text_key", "root", "class_id", "n_links", "copy_id", "n_copies")


def similar_texts(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """One row per document: doc_id, class_id, n_links (different sets of shingles that it is linked to), copy_id (the least doc_id of its equal set), n_copies. ``options``: n, similarity, recall, limit and block, the module's constants unless given."""
    return _judged(docs, text_col, id_col, **options).drop("text_key", "root")


def keep_one(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` with one document of each class, that of the least id, or one with a null id where the class has no other; of several texts of that id the one of the least text_key (rows of one id with the same text stay together)."""
    least = _judged(docs, text_col, id_col, **options).filter(F.col("doc_id").eqNullSafe(F.col("class_id")))
    kept_id, kept_key = fresh(docs, "_kept"), fresh(docs, "_key")
    kept = least.groupBy("root").agg(F.min(F.struct("text_key", "doc_id")).alias("k")).select(F.col("k.doc_id").alias(kept_id), F.col("k.text_key").alias(kept_key))
    return docs.join(kept, (text_key(text_col) == F.col(kept_key)) & F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col(kept_id)), "left_semi")
