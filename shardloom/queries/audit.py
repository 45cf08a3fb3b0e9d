"""What the audit queries share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import read_table


def micros(column: str) -> Column:
    """Microseconds since 1970-01-01 of a timestamp without zone, as UTC."""
    return F.unix_micros(F.col(column).cast("timestamp"))


def statements(spark: SparkSession, directory: str, *columns: str, nullable: tuple[str, ...] = ()) -> DataFrame:
    """The audit lines with each audit_id once, none of ``columns`` null; columns ``nullable`` come along as they are.

    A line shipped again equals the first in every column but the time of arrival, so among the columns read it is a
    repeated row. The shuffle is never skewed, as audit_id is part of its key, and carries only the columns asked for.
    Without an aggregate function the plan is deterministic, which lets several readers share one exchange.
    """
    rows = read_table(spark, directory, "audit").select("audit_id", *columns, *nullable).dropna(subset=["audit_id", *columns])
    return rows.distinct()
