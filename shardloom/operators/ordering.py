"""ORDER BY, LIMIT and set operations with their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.messages import Refusal


def order_by(df: DataFrame, *keys: str | tuple[str | Column, str]) -> DataFrame:
    """Sorts by names or (name, 'desc'); null is the lowest value, first ascending and last descending."""
    out = []
    for key in keys:
        column, direction = key if isinstance(key, tuple) else (key, "asc")
        column = F.col(column) if isinstance(column, str) else column
        out.append(column.desc_nulls_last() if direction.lower() == "desc" else column.asc_nulls_first())
    return df.orderBy(*out)


def limit(df: DataFrame, count: int, offset: int = 0) -> DataFrame:
    """LIMIT offset, count."""
    return (df.offset(offset) if offset else df).limit(count)


def union(*branches: DataFrame, distinct: bool = True) -> DataFrame:
    """UNION [ALL]: names come from the first branch, columns match by place; equal rows are equal in every value."""
    first = branches[0]
    for b in branches[1:]:
        if len(b.columns) != len(first.columns):
            raise Refusal("union_columns")
    out = first
    for b in branches[1:]:
        out = out.union(b)
    return out.distinct() if distinct else out
