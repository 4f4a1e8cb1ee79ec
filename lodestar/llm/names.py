"""Helper columns that can't clash with a table's own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fresh(docs: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``docs`` has it (Spark compares names without case)."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def column(name: str) -> Column:
    return F.col(f"`{name}`")


def columns(docs: DataFrame) -> list[Column]:
    """All columns of ``docs`` by name, whatever stands in the names."""
    return [column(c) for c in docs.columns]
