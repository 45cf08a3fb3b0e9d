"""Totals over trailing days (problem 7)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import cut


def trailing_totals(df: DataFrame, entity: str, day: str, value: str, windows: tuple[int, ...] = (7, 30)) -> DataFrame:
    """For each entity and each calendar day from its first to its last row: totals of the trailing ``windows``.

    Returns (entity, day date, first_day date, sum_W, n_W, avg_W for each W): the sum, the number of rows and the
    average per calendar day of the W days ending with that day (days before the first row count as empty days).

    Rows are first added up by entity and day, before anything is shuffled. Each calendar day is then joined to the
    daily totals within its bounds: both sides carry the number of a coarse bucket as wide as the longest window, so
    a day meets only the totals of its own bucket and the one before, and no group holds more than that many days.

    Rows with a null entity or day are left out, a null value counts as 0 (its row still counts). Repeated rows count
    each. An empty table gives no rows. Extra columns are ignored, whatever their names.
    """
    width = max(windows)
    daily = (
        df.select(F.col(entity).alias("e"), F.unix_date(F.col(day).cast("date")).alias("d"), F.coalesce(F.col(value), F.lit(0)).alias("v"))
        .where("e IS NOT NULL AND d IS NOT NULL")
        .groupBy("e", "d")
        .agg(F.sum("v").alias("v"), F.count(F.lit(1)).alias("n"))
    )
    daily = cut(daily, "daily")  # small beside the rows, and used three times
    spans = daily.groupBy("e").agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    calendar = spans.select("e", "lo", F.explode(F.sequence("lo", "hi")).alias("day"))
    calendar = calendar.select("*", F.explode(F.expr(f"array_distinct(array(floor(day / {width}), floor((day - {width - 1}) / {width})))")).alias("b"))
    totals = daily.select("e", F.floor(F.col("d") / width).alias("b"), "d", "v", "n")
    near = calendar.join(totals, ["e", "b"]).where(f"d BETWEEN day - {width - 1} AND day")
    sums = [a for w in windows for a in (F.sum(F.expr(f"CASE WHEN d > day - {w} THEN v END")).alias(f"sum_{w}"), F.sum(F.expr(f"CASE WHEN d > day - {w} THEN n ELSE 0 END")).alias(f"n_{w}"))]
    met = near.groupBy("e", "day", "lo").agg(*sums)
    # Days none of whose trailing days has a row meet nothing in the join, and still are days of the calendar.
    every = spans.select("e", "lo", F.explode(F.sequence("lo", "hi")).alias("day")).join(met, ["e", "day", "lo"], "left")
    out = [F.col("e").alias(entity), F.date_from_unix_date("day").alias("day"), F.date_from_unix_date("lo").alias("first_day")]
    for w in windows:
        out += [F.coalesce(f"sum_{w}", F.lit(0)).alias(f"sum_{w}"), F.coalesce(f"n_{w}", F.lit(0)).alias(f"n_{w}"), (F.coalesce(f"sum_{w}", F.lit(0)) / w).alias(f"avg_{w}")]
    return every.select(*out)
