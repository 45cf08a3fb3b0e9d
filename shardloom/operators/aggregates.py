"""Aggregations beyond Spark's own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def loose_group_by(df: DataFrame, keys: list[str], aggregates: dict[str, Column], bare: list[str]) -> DataFrame:
    """GROUP BY with bare columns outside keys and aggregates: each takes the value of some row of its group."""
    return df.groupBy(*keys).agg(*(c.alias(n) for n, c in aggregates.items()), *(F.any_value(c).alias(c) for c in bare))


def group_concat(column: Column, separator: str = ",", distinct: bool = False) -> Column:
    """Non-null values as text, in sorted order, joined by the separator; null for a group without values."""
    values = (F.collect_set if distinct else F.collect_list)(column.cast("string"))
    return F.when(F.size(values) > 0, F.array_join(F.array_sort(values), separator))


def row_checksum(df: DataFrame) -> Column:
    """CRC-32 of each row: its columns joined by a separator, with a mark for null, so that nulls and blanks differ."""
    cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x1e")) for c in df.columns]
    return F.crc32(F.concat_ws("\x1f", *cells))


def checksum(df: DataFrame) -> DataFrame:
    """Order-insensitive checksum of a table: sum of the rows' CRC-32, wrapped to 32 bits; null for an empty table."""
    return df.select(row_checksum(df).alias("crc")).agg((F.sum("crc") % (1 << 32)).cast("bigint").alias("checksum"))


def combine_checksums(parts: DataFrame) -> DataFrame:
    """Checksum of a table from those of its shards."""
    return parts.agg((F.sum("checksum") % (1 << 32)).cast("bigint").alias("checksum"))


def table_status(shards: DataFrame) -> DataFrame:
    """One row per table from one per sub-table: (name, rows, avg_row_length, data_length, index_length, update_time).

    The suffix _0000 of a sub-table is cut off; rows and lengths are added up, the greatest average and the latest
    update win. Tables without suffix are copies on several backends, of which one counts.
    """
    base = F.regexp_replace("name", "_[0-9]{4}$", "")
    numbers = ["rows", "data_length", "index_length"]
    copy = F.col("name") == base
    sums = [F.when(F.bool_and("copy"), F.max(c)).otherwise(F.sum(c)).alias(c) for c in numbers]
    rows = shards.select(base.alias("base"), copy.alias("copy"), *numbers, "avg_row_length", "update_time")
    grouped = rows.groupBy("base").agg(*sums, F.max("avg_row_length").alias("avg_row_length"), F.max("update_time").alias("update_time"))
    return grouped.select(F.col("base").alias("name"), "rows", "avg_row_length", "data_length", "index_length", "update_time")


def rebalance_advice(shards: DataFrame, kinds: DataFrame, least_mb: int = 100) -> DataFrame:
    """The sub-table to move from the fullest to the emptiest backend: (table, size_mb, source, target), or no row.

    ``shards``: (name, backend, size_mb), ``kinds``: (base, kind). Advice is given if the backends differ by
    ``least_mb``: the largest HASH sub-table that leaves the target smaller than the source. A backend's total counts
    every sub-table on it; all steps are over one row per sub-table or backend.
    """
    sizes = shards.groupBy("backend").agg(F.sum("size_mb").alias("mb"))
    ends = sizes.agg(F.max_by("backend", F.struct("mb", "backend")).alias("source"), F.max("mb").alias("most"), F.min_by("backend", F.struct("mb", "backend")).alias("target"), F.min("mb").alias("least"))
    ends = ends.where(f"most - least >= {least_mb}")
    named = shards.withColumn("base", F.regexp_replace("name", "_[0-9]{4}$", "")).where("name <> base")
    hashed = named.join(kinds.where("kind = 'HASH'").select("base").distinct(), "base", "left_semi")
    fit = hashed.join(F.broadcast(ends), hashed["backend"] == ends["source"]).where("least + size_mb < most - size_mb")
    return fit.orderBy(F.desc("size_mb"), "name").limit(1).select(F.col("name").alias("table"), "size_mb", "source", "target")
