"""Queries over the audit table: intervals (p4), sessions (p6), trailing totals (p7), and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.intervals import periods_and_gaps, sweep
from ..operators.rolling import trailing_totals
from ..session import read_table
from ..streaming.sessions import replay_sessions
from .audit import micros, statements

TWO_HOURS_US = 7_200_000_000


def _spans(spark: SparkSession, d: str) -> DataFrame:
    """Lines as they are: :func:`sweep` counts each audit_id once, where it brings the account's rows together anyway."""
    rows = read_table(spark, d, "audit")
    return rows.select("audit_id", F.col("user").alias("user_name"), micros("start").alias("s"), micros("end").alias("t"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Busy periods of two statements or more, and gaps of two hours or more, per account."""
    return periods_and_gaps(_spans(spark, d), "user_name", "s", "t", min_count=2, min_gap_us=TWO_HOURS_US, event_id="audit_id")


def p4_periods(spark: SparkSession, d: str) -> DataFrame:
    """Every continuous period per account with its number of statements and the gap after it."""
    return sweep(_spans(spark, d), "user_name", "s", "t", event_id="audit_id").select("user_name", "from_us", "to_us", "n", F.expr("next_us - to_us").alias("gap_us"))


def _trailing(spark: SparkSession, d: str) -> DataFrame:
    rows = statements(spark, d, "user", "start", nullable=("query_rows",))
    rows = rows.select(F.col("user").alias("user_name"), F.to_date("start").alias("day"), F.greatest("query_rows", F.lit(0)).alias("query_rows"))
    return trailing_totals(rows, "user_name", "day", "query_rows", (7, 30))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Days at least 29 days after the account's first, whose last 7 days hold over half of the last 30 days' rows."""
    late = _trailing(spark, d).where("date_diff(day, first_day) >= 29 AND 2 * sum_7 > sum_30")
    return late.select("user_name", F.date_format("day", "yyyy-MM-dd").alias("day"))


def p7_trailing(spark: SparkSession, d: str) -> DataFrame:
    """Totals and daily averages of the last 7 and 30 days for every account and calendar day."""
    out = _trailing(spark, d)
    averages = [F.round(f"avg_{w}", 6).alias(f"avg_{w}") for w in (7, 30)]
    return out.select("user_name", F.date_format("day", "yyyy-MM-dd").alias("day"), "sum_7", "sum_30", "n_7", "n_30", *averages)


HALF_HOUR_US = 1_800_000_000


def _sessions(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "audit").select("audit_id", F.col("user").alias("user_name"), "thread_id", "start")
    return replay_sessions(rows, ["user_name", "thread_id"], "start", HALF_HOUR_US, event_id="audit_id")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """First and last start of each session of an account on a connection."""
    return _sessions(spark, d).select("user_name", "thread_id", micros("first").alias("first_us"), micros("last").alias("last_us"))


def p6_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Each session with its start, end, duration and number of statements."""
    first, last = micros("first"), micros("last")
    return _sessions(spark, d).select("user_name", "thread_id", first.alias("first_us"), last.alias("last_us"), (last - first).alias("duration_us"), "n")


QUERIES = {"p4_found": p4_found, "p4_periods": p4_periods, "p6_found": p6_found, "p6_sessions": p6_sessions, "p7_found": p7_found, "p7_trailing": p7_trailing}

#: Each audit_id once; the copies differ in logged_at only.
ONCE = "(SELECT DISTINCT audit_id, start, \"end\", cost, \"user\", user_host, thread_id, command_type, argument, query_rows FROM audit)"

PERIODS = f"""
    WITH spans AS (
        SELECT "user" AS user_name, epoch_us(start) AS s, epoch_us("end") AS t FROM {ONCE}
        WHERE "user" IS NOT NULL AND start IS NOT NULL AND "end" >= start),
    marked AS (
        SELECT *, CASE WHEN s <= max(t) OVER (PARTITION BY user_name ORDER BY s, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM spans),
    numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY user_name ORDER BY s, t ROWS UNBOUNDED PRECEDING) AS k FROM marked),
    periods AS (SELECT user_name, k, min(s) AS from_us, max(t) AS to_us, count(*) AS n FROM numbered GROUP BY user_name, k),
    followed AS (SELECT *, lead(from_us) OVER (PARTITION BY user_name ORDER BY from_us) AS next_us FROM periods)
"""

SESSIONS = f"""
    WITH ordered AS (
        SELECT "user" AS user_name, thread_id, epoch_us(start) AS ts FROM {ONCE} WHERE "user" IS NOT NULL AND thread_id IS NOT NULL AND start IS NOT NULL),
    marked AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_name, thread_id ORDER BY ts) <= {HALF_HOUR_US} THEN 0 ELSE 1 END AS fresh FROM ordered),
    numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY user_name, thread_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM marked),
    sessions AS (SELECT user_name, thread_id, min(ts) AS first_us, max(ts) AS last_us, count(*) AS n FROM numbered GROUP BY user_name, thread_id, k)
"""

TRAILING = f"""
    WITH daily AS (
        SELECT "user" AS user_name, CAST(start AS DATE) AS day, sum(greatest(coalesce(query_rows, 0), 0)) AS v, count(*) AS n FROM {ONCE}
        WHERE "user" IS NOT NULL AND start IS NOT NULL GROUP BY ALL),
    spans AS (SELECT user_name, min(day) AS lo, max(day) AS hi FROM daily GROUP BY user_name),
    calendar AS (SELECT user_name, lo, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS day FROM spans),
    filled AS (SELECT c.user_name, c.lo, c.day, coalesce(v, 0) AS v, coalesce(n, 0) AS n FROM calendar c LEFT JOIN daily USING (user_name, day)),
    summed AS (
        SELECT user_name, lo, day,
            sum(v) OVER w7 AS s7, sum(v) OVER w30 AS s30, sum(n) OVER w7 AS n7, sum(n) OVER w30 AS n30 FROM filled
        WINDOW w7 AS (PARTITION BY user_name ORDER BY day ROWS 6 PRECEDING), w30 AS (PARTITION BY user_name ORDER BY day ROWS 29 PRECEDING))
"""

SQL = {
    "p4_found": PERIODS
    + f"""SELECT user_name, 'busy' AS kind, from_us, to_us FROM followed WHERE n >= 2
    UNION ALL SELECT user_name, 'gap', to_us, next_us FROM followed WHERE next_us - to_us >= {TWO_HOURS_US}""",
    "p4_periods": PERIODS + "SELECT user_name, from_us, to_us, n, next_us - to_us AS gap_us FROM followed",
    "p6_found": SESSIONS + "SELECT user_name, thread_id, first_us, last_us FROM sessions",
    "p6_sessions": SESSIONS + "SELECT *, last_us - first_us AS duration_us FROM sessions",
    "p7_found": TRAILING + "SELECT user_name, strftime(day, '%Y-%m-%d') AS day FROM summed WHERE day - lo >= 29 AND 2 * s7 > s30",
    "p7_trailing": TRAILING
    + """SELECT user_name, strftime(day, '%Y-%m-%d') AS day, CAST(s7 AS BIGINT) AS sum_7, CAST(s30 AS BIGINT) AS sum_30,
        CAST(n7 AS BIGINT) AS n_7, CAST(n30 AS BIGINT) AS n_30, round(s7 / 7, 6) AS avg_7, round(s30 / 30, 6) AS avg_30 FROM summed""",
}
