"""A join that a few very frequent keys don't hold up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key that over 1/HOT_SHARE of all rows have is joined by broadcast; there are at most HOT_SHARE of them.
HOT_SHARE = 1000


def join_spread(rows: DataFrame, facts: DataFrame, key: str, n: str, total: int, spread: Column) -> DataFrame:
    """``rows`` joined to ``facts`` (a row for each ``key``; rows without one are dropped).

    ``n`` is the column of ``facts`` that says how many rows have the key, at most, and ``total`` how many rows there are. The
    facts of the at most HOT_SHARE frequent keys are broadcast; their rows go through the shuffle for the others by ``spread``.
    """
    held = F.struct(*[F.col(c) for c in facts.columns if c != key])
    frequent = F.col(n) * HOT_SHARE >= total
    hot = F.broadcast(facts.filter(frequent).select(F.col(key).alias("_hot_key"), held.alias("_hot")))
    cold = facts.filter(~frequent).select(F.col(key).alias("_cold_key"), held.alias("_cold"))
    met = rows.join(hot, F.col(key) == F.col("_hot_key"), "left")
    met = met.withColumn("_look", F.when(F.col("_hot_key").isNull(), F.col(key)).otherwise(spread))
    met = met.join(cold.hint("merge"), (F.col("_look") == F.col("_cold_key")) & F.col("_hot_key").isNull(), "left").withColumn("_held", F.coalesce("_hot", "_cold"))
    return met.filter(F.col("_held").isNotNull()).select(*rows.columns, *[F.col(f"_held.{c}").alias(c) for c in facts.columns if c != key])
