"""Joins in the vocabulary of the SQL surface, planned by Catalyst."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lineage import cut
from ..plans.messages import Refusal
from .prefix import fresh

#: A side is only broadcast if Catalyst's own estimate of its size is at most this many bytes.
BROADCAST_BYTES = 32 << 20


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of a plan's size; for files it comes from their lengths."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """Marks ``df`` for broadcast if its estimated size is within bounds; leaves it to a shuffled join otherwise."""
    return F.broadcast(df) if estimated_bytes(df) <= most else df


def global_join(df: DataFrame, table: DataFrame, on: Column | list[str], how: str = "inner") -> DataFrame:
    """Join with a GLOBAL table, of which every backend holds a copy: broadcast while it is small."""
    return df.join(small(table), on, how)


def null_safe_join(a: DataFrame, b: DataFrame, pairs: list[tuple[Column, Column]], how: str = "inner") -> DataFrame:
    """Join on ``<=>``: null keys match one another."""
    on = pairs[0][0].eqNullSafe(pairs[0][1])
    for x, y in pairs[1:]:
        on = on & x.eqNullSafe(y)
    return a.join(b, on, how)


def anti_join(a: DataFrame, b: DataFrame, on: Column | list[str]) -> DataFrame:
    """Rows of ``a`` without partner, the LEFT JOIN .. WHERE b.x IS NULL idiom."""
    return a.join(b, on, "left_anti")


def band_join(a: DataFrame, b: DataFrame, value: str, low: str, high: str, width: float) -> DataFrame:
    """Inner join on ``b.low <= a.value <= b.high`` without a nested loop.

    Ranges are laid out over buckets of ``width``, so the sides meet by an equi-join on the bucket; each pair meets in
    one bucket only, that of the value. Null values and ranges match nothing. Choose a width near the usual length of
    a range. Column names must not clash.
    """
    bucket, = fresh(a.columns + b.columns, "_bucket")
    left = a.withColumn(bucket, F.floor(F.col(value) / width))
    right = b.where(F.col(low) <= F.col(high)).withColumn(bucket, F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    met = left.join(right, bucket).where(F.col(value).between(F.col(low), F.col(high)))
    return met.drop(bucket)


def write_bucketed(df: DataFrame, name: str, keys: list[str], buckets: int, path: str) -> DataFrame:
    """Writes a table cut into buckets by the hash of its keys, each sorted by them, and returns it read back.

    Equal keys of tables with the same number of buckets lie in buckets of the same number. Joins and groupings by the
    keys then need no shuffle, however often they are run; the one shuffle is here. ``name`` is the table's name in the
    session, ``path`` a shared folder. Null keys have a bucket, too.
    """
    keyed = df.repartition(buckets, *keys)
    keyed.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)


class TooManyRows(Refusal):
    """A result larger than the limit set for joins."""


def guard_rows(df: DataFrame, most: int) -> DataFrame:
    """``df``, if it has at most ``most`` rows. It is worked out once, no further than that, and read back."""
    held = cut(df.limit(most + 1), "guarded")
    if held.count() > most:
        raise TooManyRows("join_rows", most=most)
    return held
