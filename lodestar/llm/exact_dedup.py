"""Exact dedup by an extendible-hash index on shared files (DataFrame operations only).

Every text is keyed by a 64-bit hash. A directory of 2^depth slots maps the leading bits of a key to a bucket, and a bucket
is a Parquet partition on the shared folder. The index begins at the depth that the number of rows asks for; while a bucket
holds more than ``bucket_rows`` entries, the entries of all overfull buckets are read back and written again by one more
bit, and the directory doubles where a bucket was as deep as it is. A bucket at ``max_depth`` stays whole (its entries are
still found by key, nothing is dropped).

Equal texts are combined by comparing bytes (key, text) before and after the shuffle, so a group of copies of any size is
one entry per map task. Entries go without texts to the owner task of their bucket, which owns that range of keys and chains
the entries whose keys collide, told apart by the SHA-256 of their bytes. A document then follows its key through the
directory to a bucket, there to the key's chain, and in the chain to the entry of its own bytes. Entries of groups that hold
over 1/1000 of all rows are at most 1000, so only those are broadcast, and their rows skip the shuffle; chains of texts that
occur once are not sent, since a document that finds no entry is alone.

Defined results: null text counts as empty; repeated rows count each in ``group_size``; rows that share the largest doc_id
are all marked kept; a null doc_id is below every other, so such a row is kept only in groups without any doc_id, whose
keep_id is null; an empty table gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import staging_path
from .names import column

#: Entries a bucket may hold before it splits, and the most bits of the directory (65,536 slots of 16 bytes).
BUCKET_ROWS, MAX_DEPTH = 20_000, 16
#: A group over 1/HOT_SHARE of all rows is looked up by broadcast; there are at most HOT_SHARE of them.
HOT_SHARE = 1000
#: Chains by key. A bucket's number is 2^depth + its leading bits, so buckets of all depths differ.
_CHAINS = "key long, chain array<struct<sha: string, n: long, keep_id: long>>, bucket int"


def text_key(text: Column, hash_bits: int = 64) -> Column:
    key = F.xxhash64(text)
    return key if hash_bits == 64 else F.shiftleft(key, 64 - hash_bits)


def _leading(depth: int) -> Column:
    return F.shiftrightunsigned("key", 64 - depth).cast("int") if depth else F.lit(0)


class Index:
    """Bucket files below ``path``, and the directory: the bucket of every slot."""

    def __init__(self, spark: SparkSession, depth: int, bucket_rows: int, max_depth: int) -> None:
        self.spark, self.path, self.depth = spark, staging_path(spark, "exact-index"), depth
        self.bucket_rows, self.max_depth = bucket_rows, max_depth
        self.slots = [(1 << depth) + i for i in range(1 << depth)]

    def insert(self, entries: DataFrame) -> None:
        """``entries`` (key, sha, n, keep_id): the owner task of a bucket chains the entries of equal keys."""
        buckets = entries.withColumn("bucket", (F.lit(1 << self.depth) + _leading(self.depth)).cast("int")).repartition(1 << self.depth, "bucket")
        self._write(buckets.groupBy("bucket", "key").agg(F.sort_array(F.collect_list(F.struct("sha", "n", "keep_id"))).alias("chain")))  # as long as a key's collisions
        while self._split():
            pass

    def _write(self, chains: DataFrame) -> None:
        chains.select("key", "chain", "bucket").write.mode("append").partitionBy("bucket").parquet(self.path)

    def chains(self) -> DataFrame:
        """All bucket files, those that were split too."""
        return self.spark.read.schema(_CHAINS).parquet(self.path)

    def _split(self) -> bool:
        """Writes the chains of every overfull bucket again by one more bit; False if there was none."""
        live = sorted(b for b in set(self.slots) if b.bit_length() <= self.max_depth)
        if not live:
            return False
        held = self.chains().filter(F.col("bucket").isin(live)).groupBy("bucket").agg(F.sum(F.size("chain")).alias("n")).filter(F.col("n") > self.bucket_rows)
        full = {r["bucket"] for r in held.collect()}  # a row per bucket, of which there are at most 2^max_depth
        if not full:
            return False
        if any(b.bit_length() - 1 == self.depth for b in full):  # no slot to spare: the directory doubles
            self.slots = [b for b in self.slots for _ in (0, 1)]
            self.depth += 1
        for slot, b in enumerate(self.slots):
            if b in full:
                self.slots[slot] = 2 * b + (slot >> (self.depth - b.bit_length()) & 1)
        local = F.length(F.bin("bucket")) - 1  # the bucket's depth
        bit = F.expr("shiftrightunsigned(key, 63 - (length(bin(bucket)) - 1)) & 1").cast("int")
        moved = self.chains().filter(F.col("bucket").isin(sorted(full)) & (local < self.max_depth))
        self._write(moved.withColumn("bucket", (2 * F.col("bucket") + bit).cast("int")).repartition(2 * len(full), "bucket"))
        return True

    def directory(self) -> DataFrame:
        """(slot, bucket), at most 2^max_depth rows, written beside the buckets."""
        path = f"{self.path}-directory"
        self.spark.createDataFrame(list(enumerate(self.slots)), "slot int, bucket int").coalesce(1).write.mode("overwrite").parquet(path)
        return self.spark.read.schema("slot int, bucket int").parquet(path)

    def bucket_of(self, rows: DataFrame, directory: DataFrame) -> DataFrame:
        """``rows`` (with a key) with the bucket that the directory gives."""
        return rows.withColumn("slot", _leading(self.depth)).join(F.broadcast(directory), "slot").drop("slot")


def index(docs: DataFrame, text: Column, doc_id: Column, *, bucket_rows: int = BUCKET_ROWS, max_depth: int = MAX_DEPTH, start_depth: int | None = None, hash_bits: int = 64) -> tuple[Index, int]:
    """The index of all distinct texts, and the number of rows. ``start_depth``: the directory's bits at first."""
    total = docs.count()
    if start_depth is None:
        start_depth = min(max_depth, math.ceil(math.log2(max(1, total / bucket_rows))))
    rows = docs.select(F.coalesce(text, F.lit("")).alias("t"), doc_id.cast("long").alias("id")).withColumn("key", text_key(F.col("t"), hash_bits))
    entries = rows.groupBy("key", "t").agg(F.count("*").alias("n"), F.max("id").alias("keep_id")).select("key", F.sha2("t", 256).alias("sha"), "n", "keep_id")
    found = Index(docs.sparkSession, start_depth, bucket_rows, max_depth)
    found.insert(entries)
    return found, total


def _looked_up(docs: DataFrame, text_col: str, id_col: str, row: Column, **options) -> DataFrame:
    """row, doc_id, keep_id, group_size, kept, text_sha256 of every document."""
    hash_bits = options.get("hash_bits", 64)
    found, total = index(docs, column(text_col), column(id_col), **options)
    directory = found.directory()
    live = found.chains().join(F.broadcast(directory.select("bucket").distinct()), "bucket", "left_semi")
    shared = live.filter(F.exists("chain", lambda e: e["n"] > 1))
    big = F.filter("chain", lambda e: e["n"] * HOT_SHARE >= total)
    hot = F.broadcast(shared.filter(F.size(big) > 0).select(F.col("bucket").alias("hot_bucket"), F.col("key").alias("hot_key"), big.alias("hot_chain")))
    cold = shared.select(F.col("bucket").alias("cold_bucket"), F.col("key").alias("cold_key"), F.filter("chain", lambda e: (e["n"] > 1) & (e["n"] * HOT_SHARE < total)).alias("cold_chain"))
    text = F.coalesce(column(text_col), F.lit(""))
    rows = docs.select(row.alias("row"), column(id_col).cast("long").alias("id"), column(id_col).alias("doc_id"), text_key(text, hash_bits).alias("key"), F.sha2(text, 256).alias("sha"))
    rows = found.bucket_of(rows, directory)
    entry = lambda chain: F.try_element_at(F.filter(chain, lambda e: e["sha"] == F.col("sha")), F.lit(1))
    rows = rows.join(hot, (F.col("bucket") == F.col("hot_bucket")) & (F.col("key") == F.col("hot_key")), "left").withColumn("hot", entry("hot_chain")).drop("hot_bucket", "hot_key", "hot_chain")
    # rows of hot groups have their answer: a key of their own in no bucket spreads them over all tasks
    answered = F.col("hot").isNotNull()
    rows = rows.withColumns({"key": F.when(answered, F.xxhash64("id", F.rand(5))).otherwise(F.col("key")), "bucket": F.when(answered, F.lit(-1)).otherwise(F.col("bucket"))})
    rows = rows.join(cold.hint("merge"), (F.col("key") == F.col("cold_key")) & (F.col("bucket") == F.col("cold_bucket")), "left").withColumn("e", F.coalesce("hot", entry("cold_chain")))
    keep = F.when(F.col("e").isNull(), F.col("id")).otherwise(F.col("e.keep_id"))
    return rows.select("row", "doc_id", keep.alias("keep_id"), F.coalesce("e.n", F.lit(1)).cast("long").alias("group_size"), F.col("id").eqNullSafe(keep).alias("kept"), F.col("sha").alias("text_sha256"))


def exact_dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256. ``options``: those of ``index``."""
    return _looked_up(docs, text_col, id_col, F.lit(None).cast(T.BooleanType()), **options).drop("row")


def drop_copies(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` without the copies: of equal texts the row with the largest id stays, one of them if rows tie."""
    whole = F.struct(*[column(c).alias(c) for c in docs.columns])
    rows = _looked_up(docs, text_col, id_col, whole, **options).filter("kept")
    single = rows.filter("group_size = 1").select("row")
    several = rows.filter("group_size > 1").dropDuplicates(["text_sha256"]).select("row")
    return single.unionByName(several).select("row.*")
