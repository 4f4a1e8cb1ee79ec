"""Connected components by alternating stars over DataFrames; nothing is collected."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above u is linked to the least of u and its neighbours."""
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    """u and every neighbour below it are linked to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
    return moved.filter("u <> v").distinct()


def _contract(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of one batch, replaced by those from each node to the least that it reaches by them."""
    for batch in source:
        nodes, places = np.unique(np.concatenate([batch.column("u").to_numpy(), batch.column("v").to_numpy()]), return_inverse=True)
        a, b = places[: batch.num_rows], places[batch.num_rows :]
        root = np.arange(len(nodes))
        while True:
            least = np.minimum(root[a], root[b])
            now = root.copy()
            for side in (a, b, root[a], root[b]):
                np.minimum.at(now, side, least)
            now = now[now]
            if (now == root).all():
                break
            root = now
        keep = np.flatnonzero(root != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(nodes[root[keep]])], ["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of the component, for every node of ``edges`` (u long, v long) that isn't the root."""
    now = stage(edges.filter("u <> v").mapInArrow(_contract, "u long, v long"), "edges")
    seen = None
    while True:
        mark = now.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
        if mark == seen or not mark["n"]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = mark
        now = stage(_small_star(_large_star(now)), "edges")
