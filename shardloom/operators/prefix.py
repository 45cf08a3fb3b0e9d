"""Running sums of one entity spread over many tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, each with underscores appended until no column has it (in any letter case)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def running_sums(df: DataFrame, entity: list[str], bucket: str, order: list, sums: dict[str, str]) -> DataFrame:
    """Adds to each row the inclusive running totals of ``sums`` (new name -> column) of its entity.

    An entity's rows are cut into buckets that follow one another in ``order``; each bucket is summed in a task of
    its own, and the totals of the buckets before it are carried in. An entity of any size is thereby spread over as
    many tasks as it has buckets; only one row per bucket goes through a window over the whole entity.
    Entity columns and bucket must not be null.
    """
    local = Window.partitionBy(*entity, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*entity).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    carried = dict(zip(sums, fresh([*df.columns, *sums], *(f"_carry_{k}" for k in range(len(sums)))), strict=True))
    carry = df.groupBy(*entity, bucket).agg(*(F.sum(c).alias(carried[n]) for n, c in sums.items()))
    carry = carry.select(*entity, bucket, *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in carried.values()))
    return (
        df.select("*", *(F.sum(c).over(local).alias(n) for n, c in sums.items()))
        .join(carry, [*entity, bucket])
        .withColumns({n: F.col(n) + F.col(c) for n, c in carried.items()})
        .drop(*carried.values())
    )
