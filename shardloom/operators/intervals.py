"""Continuous periods and gaps of overlapping intervals (problem 4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Width of the time buckets one entity's events are spread over.
BUCKET_US = 3_600_000_000


def sweep(df: DataFrame, entity: str, start_us: str, end_us: str, bucket_us: int = BUCKET_US, event_id: str | None = None) -> DataFrame:
    """Merges the intervals of each entity by a sweep line.

    ``start_us`` and ``end_us`` are integers (microseconds). Each interval becomes a plus event at its start and a
    minus event at its end; events of one instant are added up, and prefix sums give the number of open intervals
    before and after each instant. A period begins where none is open before, and ends where none is open after.
    Intervals that only touch share an instant and so form one period.

    Returns one row per period, (entity, from_us, to_us, n, next_us): ``n`` counts the intervals in it, ``next_us`` is
    the start of the entity's next period (null for the last), so the gap is ``[to_us, next_us]``.

    An interval within one bucket of time is shuffled as one row, another as two, its ends; events are made of them
    where they meet.

    Rows with a null entity, start or end, or ending before they start, are left out. Repeated rows count each; with
    ``event_id``, rows equal in it and in entity, start and end count once, and those with a null id are left out.
    An empty table gives no rows. Extra columns are ignored, whatever their names.
    """
    rows = df.select(F.col(entity).alias("e"), F.col(start_us).cast("long").alias("s"), F.col(end_us).cast("long").alias("t"), *([F.col(event_id).alias("id")] if event_id else []))
    rows = rows.where("e IS NOT NULL AND s <= t" + (" AND id IS NOT NULL" if event_id else ""))
    first, last = (f"floor({c} / {bucket_us})" for c in ("s", "t"))
    ends = F.expr(f"IF({first} = {last}, array(struct({first} AS b, s, t)), array(struct({first} AS b, s, CAST(NULL AS BIGINT) AS t), struct({last} AS b, CAST(NULL AS BIGINT) AS s, t)))")
    held = rows.select("e", *(["id"] if event_id else []), F.explode(ends).alias("v")).select("e", *(["id"] if event_id else []), "v.*")
    # The filter holds anyway; where it stands, both readers of the partitioned rows have it, and so share them.
    held = held.where("b IS NOT NULL").repartition("e", "b")
    if event_id:
        held = held.dropDuplicates()  # in place: what is equal lies together
    moments = F.expr("filter(array(struct(s AS at, 1L AS plus, 0L AS minus), struct(t AS at, 0L AS plus, 1L AS minus)), v -> v.at IS NOT NULL)")
    events = held.select("e", "b", F.explode(moments).alias("v")).select("e", "b", "v.*")
    instants = events.groupBy("e", "b", "at").agg(F.sum("plus").alias("plus"), F.sum(F.expr("plus - minus")).alias("net"))
    # Within a bucket, counted from its beginning. What is open can only fall to 0 where this count is lowest.
    upto = Window.partitionBy("e", "b").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = instants.select("*", F.sum("net").over(upto).alias("count"), F.sum("plus").over(upto).alias("seen"))
    rows = rows.withColumn("lowest", F.least(F.lit(0), F.min("count").over(Window.partitionBy("e", "b"))))
    rows = rows.selectExpr("e", "b", "at", "plus", "net", "seen", "lowest", "count - net = lowest AS opens", "count = lowest AS closes")
    rows = rows.withColumn("period", F.sum(F.col("opens").cast("long")).over(upto))
    edges = rows.where("opens OR closes").join(_carried(rows), ["e", "b"])
    edges = edges.selectExpr("e", "at", "plus", "seen + seen_before AS seen", "opens", "closes", "period + periods_before AS period")
    # Each edge tells its period its start or end; a start also tells the period before where the gap ends.
    told = edges.select(
        "e",
        F.explode(
            F.expr("""filter(array(
                named_struct('k', period, 's', CASE WHEN opens THEN at END, 't', CASE WHEN closes THEN at END, 'n',
                             CASE WHEN closes THEN seen ELSE 0L END - CASE WHEN opens THEN seen - plus ELSE 0L END, 'x', CAST(NULL AS BIGINT)),
                CASE WHEN opens AND period > 1 THEN
                    named_struct('k', period - 1, 's', CAST(NULL AS BIGINT), 't', CAST(NULL AS BIGINT), 'n', 0L, 'x', at) END
            ), v -> v IS NOT NULL)""")
        ).alias("v"),
    ).select("e", "v.*")
    return (
        told.groupBy("e", "k")
        .agg(F.max("s").alias("from_us"), F.max("t").alias("to_us"), F.sum("n").alias("n"), F.max("x").alias("next_us"))
        .select(F.col("e").alias(entity), "from_us", "to_us", "n", "next_us")
    )


def _carried(rows: DataFrame) -> DataFrame:
    """What the buckets before it hand to each bucket in which the count does fall to 0.

    One row per bucket goes through a window over the entity. Intervals, and periods of buckets that do not fall to 0,
    are left open by them.
    """
    buckets = rows.groupBy("e", "b").agg(F.sum("net").alias("net"), F.sum("plus").alias("plus"), F.min("lowest").alias("lowest"), F.sum(F.col("opens").cast("long")).alias("opens"))
    before = Window.partitionBy("e").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    carried = buckets.select("*", F.coalesce(F.sum("net").over(before), F.lit(0)).alias("open"), F.coalesce(F.sum("plus").over(before), F.lit(0)).alias("seen_before"))
    carried = carried.withColumn("falls", F.expr("open + lowest = 0"))
    carried = carried.withColumn("periods_before", F.coalesce(F.sum(F.when(F.col("falls"), F.col("opens")).otherwise(0)).over(before), F.lit(0)))
    return carried.where("falls").select("e", "b", "seen_before", "periods_before")


def periods_and_gaps(df: DataFrame, entity: str, start_us: str, end_us: str, min_count: int = 1, min_gap_us: int = 1, bucket_us: int = BUCKET_US, event_id: str | None = None) -> DataFrame:
    """(entity, kind, from_us, to_us): 'busy' periods of ``min_count`` intervals or more, 'gap's of ``min_gap_us`` or more.

    Periods of fewer intervals are not listed, yet bound the gaps. Nulls, ties and empty tables: see :func:`sweep`.
    """
    swept = sweep(df, entity, start_us, end_us, bucket_us, event_id)
    kinds = F.expr(f"""filter(array(
        CASE WHEN n >= {int(min_count)} THEN named_struct('kind', 'busy', 'from_us', from_us, 'to_us', to_us) END,
        CASE WHEN next_us - to_us >= {int(min_gap_us)} THEN named_struct('kind', 'gap', 'from_us', to_us, 'to_us', next_us) END
    ), v -> v IS NOT NULL)""")
    return swept.select(entity, F.explode(kinds).alias("_v")).select(entity, "_v.*")
