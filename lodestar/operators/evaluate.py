"""Retrieval quality and latency (AGG-10..15, JOIN-8, JOIN-9)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def recall(retrieved: Column, relevant: Column) -> Column:
    """AGG-10: relevant ones among the retrieved (repeated ones count each) to relevant ones; 1 if none is."""
    hits = F.size(F.filter(retrieved, lambda x: F.array_contains(relevant, x)))
    return F.when(F.size(relevant) == 0, F.lit(1.0)).otherwise(hits / F.size(relevant))


def reciprocal_rank(retrieved: Column, relevant: Column) -> Column:
    """AGG-11: of the first relevant one, 0 if none is."""
    first = F.array_min(F.filter(F.transform(retrieved, lambda x, i: F.when(F.array_contains(relevant, x), i + 1)), lambda p: p.isNotNull()))
    return F.coalesce(1 / first, F.lit(0.0))


def hit(expected: Column, retrieved: Column) -> Column:
    """AGG-15, JOIN-9: whether any expected one was retrieved; null without expectation."""
    return F.when(F.size(F.coalesce(expected, F.array())) > 0, F.arrays_overlap(expected, retrieved))


def percentile(value: str, p: float) -> Column:
    """AGG-13: exact, linear between ranks; 0 for no rows."""
    return F.coalesce(F.percentile(value, F.lit(p / 100)), F.lit(0.0))


def p95_by_rank(value: str) -> Column:
    """AGG-15: the value at int(0.95 n) - 1 of the sorted ones. Gathers one number a query of the evaluation set."""
    ordered = F.sort_array(F.collect_list(value))
    return F.try_element_at(ordered, F.greatest(F.floor(0.95 * F.size(ordered)), F.lit(1)).cast("int"))


def report(results: DataFrame) -> DataFrame:
    """AGG-12, AGG-14: one row from (recall, rr, latency) of each query."""
    return results.agg(
        F.count("*").alias("n_queries"), F.coalesce(F.avg("recall"), F.lit(0.0)).alias("mean_recall"), F.coalesce(F.avg("rr"), F.lit(0.0)).alias("mrr"),
        *[percentile("latency", p).alias(f"p{p}") for p in (50, 95, 99)],
    )


def eval_summary(results: DataFrame) -> DataFrame:
    """AGG-15: one row from (hit, latency): the rate is over queries with an expectation only."""
    return results.agg(F.count("*").alias("n_queries"), F.count("hit").alias("n_labelled"), F.avg(F.col("hit").cast("int")).alias("hit_rate"), F.coalesce(F.median("latency"), F.lit(0.0)).alias("median_latency"), p95_by_rank("latency").alias("p95_latency"))
