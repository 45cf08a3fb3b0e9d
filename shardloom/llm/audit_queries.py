"""Queries over audit: distinct counts (p1), formatting duplicates (p2), frequent items (p3), percentiles (p5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import read_table
from . import compactors, heavylight, samesort, setsketch
from .statements import canonical

# ---- p1: distinct counts -------------------------------------------------------------------------------------------

#: An account and day is listed from this many different values on.
MANY = 50
#: No count among millions should be off by so many standard errors and whole identifiers more: in a small set two
#: identifiers that share a register cost one, which is seldom and then more than the error's share of so few.
SIGMAS, WHOLE = 5, 2


def _fields(*names: str) -> Column:
    return F.explode(F.array(*(F.struct(F.lit(n).alias("field_name"), F.xxhash64(n).alias("item"), F.col(n).isNotNull().alias("there")) for n in names)))


def _registers(spark: SparkSession, d: str, *fields: str) -> DataFrame:
    """Registers per field, account and day, either of which may be null: levels leave out rows null in what they group by.

    Lines shipped again change nothing, as registers take the maximum.
    """
    rows = read_table(spark, d, "audit").select(F.col("user").alias("user_name"), F.to_date("start").alias("day"), _fields(*fields).alias("f"))
    rows = rows.where("f.there").select("f.field_name", "user_name", "day", "f.item")
    return setsketch.fill(rows, ["field_name", "user_name", "day"], F.col("item"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Accounts and days with 50 or more different hosts or connections."""
    keys = ["field_name", "user_name", "day"]
    fine = _registers(spark, d, "user_host", "thread_id").where("user_name IS NOT NULL AND day IS NOT NULL")
    counts = setsketch.estimate(setsketch.pack(fine, keys), keys)
    return counts.where(F.col("estimate") >= MANY).select("field_name", "user_name", F.date_format("day", "yyyy-MM-dd").alias("day"))


def p1_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts with their standard error per day, per account, and per account and day, merged from one set of registers."""
    keys = ["field_name", "user_name", "day"]
    fine = _registers(spark, d, "user_host", "thread_id", "user")
    both, account, day = "struct(user_name, day)", "struct(user_name, CAST(NULL AS DATE) AS day)", "struct(CAST(NULL AS STRING) AS user_name, day)"
    levels = F.explode(F.expr(f"array_compact(array(IF(user_name IS NOT NULL AND day IS NOT NULL, {both}, NULL), IF(user_name IS NOT NULL, {account}, NULL), IF(day IS NOT NULL, {day}, NULL)))"))
    all_levels = fine.select("field_name", levels.alias("g"), "register", "value").select("field_name", "g.*", "register", "value")
    counts = setsketch.estimate(setsketch.pack(setsketch.merge(all_levels, keys), keys), keys)
    return counts.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


def p1_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Union, intersection and Jaccard of each day's values and the next day's, with standard errors."""
    keys = ["field_name", "day"]
    fine = _registers(spark, d, "user_host", "thread_id", "user").where("day IS NOT NULL")
    days = setsketch.pack(setsketch.merge(fine, keys), keys)
    after = days.select("field_name", F.date_sub("day", 1).alias("day"), F.col("sketch").alias("next"))
    out = setsketch.compare(days.join(after, keys), keys, "sketch", "next")
    return out.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


def p1_within(spark: SparkSession, d: str) -> DataFrame:
    """Each count of ``p1_counts`` beside the exact one, and whether it lies within SIGMAS standard errors and WHOLE."""
    keys = ["field_name", "user_name", "day"]
    fields = F.explode(F.array(*(F.struct(F.lit(n).alias("field_name"), F.col(n).cast("string").alias("item")) for n in ("user_host", "thread_id", "user"))))
    rows = read_table(spark, d, "audit").select(F.col("user").alias("user_name"), F.to_date("start").alias("day"), fields.alias("f"))
    seen = rows.select("f.field_name", "user_name", "day", "f.item").where("item IS NOT NULL").distinct()
    levels = F.explode(F.expr("array_compact(array(IF(user_name IS NOT NULL AND day IS NOT NULL, struct(user_name, day), NULL), IF(user_name IS NOT NULL, struct(user_name, CAST(NULL AS DATE) AS day), NULL), IF(day IS NOT NULL, struct(CAST(NULL AS STRING) AS user_name, day), NULL)))"))
    each = seen.select("field_name", levels.alias("g"), "item").select("field_name", "g.*", "item").distinct()
    exact = each.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).withColumn("day", F.date_format("day", "yyyy-MM-dd"))
    counted = p1_counts(spark, d)
    same = [exact[k].eqNullSafe(counted[k]) for k in keys]
    within = F.coalesce(F.abs(F.col("estimate") - F.col("n")) <= SIGMAS * F.col("estimate_error") + WHOLE, F.lit(False))
    both = exact.join(counted, same[0] & same[1] & same[2], "full")
    return both.select(*(F.coalesce(exact[k], counted[k]).alias(k) for k in keys), "n", within.cast("int").alias("within"))


def p1_overlap_within(spark: SparkSession, d: str) -> DataFrame:
    """The exact sizes for ``p1_overlap``, and whether the estimates lie within SIGMAS standard errors and WHOLE of them."""
    fields = F.explode(F.array(*(F.struct(F.lit(n).alias("field_name"), F.col(n).cast("string").alias("item")) for n in ("user_host", "thread_id", "user"))))
    rows = read_table(spark, d, "audit").select(F.to_date("start").alias("day"), fields.alias("f")).select("f.*", "day").dropna().distinct()
    # An item of a day stands in that day's pair as first, and in that of the day before as second.
    sides = rows.select("field_name", "item", F.explode(F.expr("array(struct(day, 1 AS first, 0 AS second), struct(date_sub(day, 1) AS day, 0 AS first, 1 AS second))")).alias("s"))
    each = sides.select("field_name", "item", "s.*").groupBy("field_name", "day", "item").agg(F.max("first").alias("first"), F.max("second").alias("second"))
    sums = each.groupBy("field_name", "day").agg(F.count(F.lit(1)).alias("n_union"), F.sum(F.expr("first * second")).alias("n_both"), F.max("first").alias("a"), F.max("second").alias("b"))
    exact = sums.where("a = 1 AND b = 1").withColumn("day", F.date_format("day", "yyyy-MM-dd"))
    near = [(F.abs(F.col(name) - F.col(n)) <= SIGMAS * F.col(f"{name}_error") + WHOLE).cast("int").alias(f"{name}_within") for name, n in (("union", "n_union"), ("intersection", "n_both"))]
    return exact.join(p1_overlap(spark, d), ["field_name", "day"], "left").select("field_name", "day", "n_union", "n_both", *near)


# ---- p2: duplicates hidden by formatting ---------------------------------------------------------------------------

DATA_STATEMENTS = ["SELECT", "INSERT", "UPDATE", "DELETE", "REPLACE"]


def _data_statements(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "audit").where(F.col("command_type").isin(DATA_STATEMENTS)).select("audit_id", "argument")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Each data statement that says the same as an earlier one, with the first that does."""
    return samesort.copies(_data_statements(spark, d), "audit_id", "argument", canonical)


def p2_statements(spark: SparkSession, d: str) -> DataFrame:
    """Each data statement once, in its canonical form, with its number of copies."""
    return samesort.collapse(_data_statements(spark, d), "audit_id", "argument", canonical)


# ---- p3: frequent items --------------------------------------------------------------------------------------------

#: Of a hundred audit_ids, so many must hold an item for it to be listed.
PERCENT = 1
ITEMS = ["argument", "user_host"]


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Values of argument and user_host that 1 % of all audit_ids hold."""
    audit = read_table(spark, d, "audit")
    total = audit.agg(F.count_distinct("audit_id")).first()[0]
    least = max(1, -(-total * PERCENT // 100))
    found = heavylight.frequent(audit, ITEMS, least, event_id="audit_id")
    return found.select(F.col("field").alias("field_name"), "item")


def p3_top(spark: SparkSession, d: str) -> DataFrame:
    """The hundred values of each field that most audit_ids hold, with the bounds of their counts, which are exact."""
    found = heavylight.top(read_table(spark, d, "audit"), ITEMS, 100, event_id="audit_id")
    return found.select(F.col("field").alias("field_name"), "item", F.col("n").alias("lower"), F.col("n").alias("upper"))


# ---- p5: percentiles -----------------------------------------------------------------------------------------------

GROUP = ["user_name", "command_type"]
PARTS = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}
#: Groups of at least so many costs whose 95th percentile is at least so many times the median are listed.
LEAST_ROWS, STRETCH = 40, 20


def _costs(spark: SparkSession, d: str, *more: Column) -> DataFrame:
    """Each audit_id once, brought together with its group by one shuffle, hot groups over many tasks."""
    rows = read_table(spark, d, "audit").select("audit_id", F.col("user").alias("user_name"), "command_type", "cost", *more)
    rows = rows.where("audit_id IS NOT NULL AND user_name IS NOT NULL AND command_type IS NOT NULL AND cost >= 0")
    return compactors.spread(rows, GROUP, F.col("audit_id")).dropDuplicates([*GROUP, "_salt", "audit_id"])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Accounts and kinds of statement whose costs stretch far beyond their median."""
    sketches = compactors.merge(compactors.build(_costs(spark, d), GROUP, "cost"), GROUP)
    found = compactors.quantiles(sketches, GROUP, PARTS)
    return found.where((F.col("n") >= LEAST_ROWS) & (F.col("p95") >= STRETCH * F.col("p50"))).select(*GROUP)


def p5_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles per account and kind of statement, joined from the sketches of single days."""
    daily = compactors.build(_costs(spark, d, F.to_date("start").alias("day")), [*GROUP, "day"], "cost")
    return compactors.quantiles(compactors.merge(daily, GROUP), GROUP, PARTS)


def p5_within(spark: SparkSession, d: str) -> DataFrame:
    """For each percentile of ``p5_quantiles``, whether its rank lies within the stated error of the wanted one."""
    costs, found = _costs(spark, d), p5_quantiles(spark, d)
    met = costs.join(found, GROUP)
    below = [x for name in PARTS for x in (F.count_if(F.col("cost") < F.col(name)).alias(f"{name}_below"), F.count_if(F.col("cost") <= F.col(name)).alias(f"{name}_upto"))]
    ranks = met.groupBy(*GROUP, "rank_error").agg(F.count(F.lit(1)).alias("n"), *below)
    # The answer has some rank of those its value holds; a rank is a whole number of rows.
    room = F.col("rank_error") * F.col("n") + 1
    fits = [((F.col(f"{name}_below") - room <= part * F.col("n")) & (part * F.col("n") <= F.col(f"{name}_upto") + room)).cast("int").alias(f"{name}_within") for name, part in PARTS.items()]
    return ranks.select(*GROUP, "n", *fits)


QUERIES = {"p1_found": p1_found, "p1_counts": p1_counts, "p1_overlap": p1_overlap, "p1_within": p1_within, "p1_overlap_within": p1_overlap_within, "p2_found": p2_found, "p2_statements": p2_statements, "p3_found": p3_found, "p3_top": p3_top, "p5_found": p5_found, "p5_quantiles": p5_quantiles, "p5_within": p5_within}

SQL = {
    "p1_found": " UNION ALL ".join(
        f"""SELECT '{f}' AS field_name, "user" AS user_name, strftime(start, '%Y-%m-%d') AS day FROM audit
        WHERE "user" IS NOT NULL AND start IS NOT NULL AND {f} IS NOT NULL GROUP BY ALL HAVING count(DISTINCT {f}) >= {MANY}"""
        for f in ("user_host", "thread_id")
    ),
    "p3_found": " UNION ALL ".join(
        f"""SELECT '{f}' AS field_name, {f} AS item FROM audit WHERE {f} IS NOT NULL GROUP BY {f}
        HAVING 100 * count(DISTINCT audit_id) >= {PERCENT} * (SELECT count(DISTINCT audit_id) FROM audit)"""
        for f in ITEMS
    ),
    "p3_top": " UNION ALL ".join(
        f"""SELECT * FROM (SELECT '{f}' AS field_name, {f} AS item, count(DISTINCT audit_id) AS lower, count(DISTINCT audit_id) AS upper FROM audit
        WHERE {f} IS NOT NULL GROUP BY {f} ORDER BY lower DESC, item LIMIT 100)"""
        for f in ITEMS
    ),
    "p1_within": " UNION ALL ".join(
        f"""SELECT '{f}' AS field_name, {user} AS user_name, {day} AS day, count(DISTINCT "{f}") AS n, 1 AS within FROM audit
        WHERE "{f}" IS NOT NULL AND {there} GROUP BY ALL"""
        for f in ("user_host", "thread_id", "user")
        for user, day, there in (
            ('"user"', "strftime(start, '%Y-%m-%d')", '"user" IS NOT NULL AND start IS NOT NULL'),
            ('"user"', "CAST(NULL AS VARCHAR)", '"user" IS NOT NULL'),
            ("CAST(NULL AS VARCHAR)", "strftime(start, '%Y-%m-%d')", "start IS NOT NULL"),
        )
    ),
    "p1_overlap_within": " UNION ALL ".join(
        f"""SELECT '{f}' AS field_name, strftime(a.day, '%Y-%m-%d') AS day, (SELECT count(DISTINCT "{f}") FROM audit WHERE CAST(start AS DATE) BETWEEN a.day AND a.day + 1) AS n_union,
        (SELECT count(*) FROM (SELECT "{f}" FROM audit WHERE "{f}" IS NOT NULL AND CAST(start AS DATE) = a.day INTERSECT SELECT "{f}" FROM audit WHERE CAST(start AS DATE) = a.day + 1)) AS n_both,
        1 AS union_within, 1 AS intersection_within
        FROM (SELECT DISTINCT CAST(start AS DATE) AS day FROM audit WHERE "{f}" IS NOT NULL AND start IS NOT NULL) a
        WHERE a.day + 1 IN (SELECT CAST(start AS DATE) FROM audit WHERE "{f}" IS NOT NULL AND start IS NOT NULL)"""
        for f in ("user_host", "thread_id", "user")
    ),
    "p5_within": """SELECT user_name, command_type, count(*) AS n, 1 AS p50_within, 1 AS p90_within, 1 AS p95_within, 1 AS p99_within
        FROM (SELECT DISTINCT audit_id, "user" AS user_name, command_type, cost FROM audit WHERE "user" IS NOT NULL AND command_type IS NOT NULL AND cost >= 0) GROUP BY ALL""",
    "p5_found": f"""SELECT user_name, command_type FROM (SELECT DISTINCT audit_id, "user" AS user_name, command_type, cost FROM audit)
        WHERE user_name IS NOT NULL AND command_type IS NOT NULL AND cost >= 0 GROUP BY ALL
        HAVING count(*) >= {LEAST_ROWS} AND quantile_disc(cost, 0.95) >= {STRETCH} * quantile_disc(cost, 0.5)""",
}
