"""Intervals, sessions and trailing totals against brute force, and their special cases."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from shardloom.operators.intervals import periods_and_gaps, sweep
from shardloom.operators.prefix import fresh, running_sums
from shardloom.operators.rolling import trailing_totals
from shardloom.streaming.sessions import replay_sessions, session_timers


def brute_periods(rows):
    out = []
    for user in sorted({u for u, _, _ in rows}):
        spans = sorted((s, t) for u, s, t in rows if u == user)
        merged = []
        for s, t in spans:
            if merged and s <= merged[-1][1]:
                merged[-1] = [merged[-1][0], max(merged[-1][1], t), merged[-1][2] + 1]
            else:
                merged.append([s, t, 1])
        for i, (s, t, n) in enumerate(merged):
            out.append((user, s, t, n, merged[i + 1][0] if i + 1 < len(merged) else None))
    return out


@pytest.mark.parametrize("bucket", [7, 50, 10_000])
def test_sweep_matches_brute_force(spark, bucket):
    rng = random.Random(bucket)
    rows = [(rng.choice("aaaaab"), s := rng.randrange(-300, 600), s + rng.choice([0, 0, 1, 3, 40, 200])) for _ in range(250)]
    rows += rows[:20]  # repeated rows count each
    df = spark.createDataFrame(rows, "u string, s long, t long")
    assert sorted(map(tuple, sweep(df, "u", "s", "t", bucket).collect())) == brute_periods(rows)


def test_sweep_special_cases(spark):
    rows = [("a", 0, 10, 1), ("a", 10, 20, 2), ("a", 30, 25, 3), (None, 1, 2, 4), ("a", None, 2, 5), ("a", 3, None, 6), ("a", 50, 50, 7), ("b", 5, 5, 8), ("b", 5, 5, 9)]
    df = spark.createDataFrame(rows, "u string, s long, t long, e int").withColumns({"at": F.lit(1), "b": F.lit("x"), "k": F.lit(None).cast("string")})
    got = sorted(map(tuple, periods_and_gaps(df, "u", "s", "t", min_count=2, min_gap_us=30).collect()))
    assert got == [("a", "busy", 0, 20), ("a", "gap", 20, 50), ("b", "busy", 5, 5)]
    assert sweep(df.limit(0), "u", "s", "t").collect() == []


def test_running_sums_carry_over_buckets(spark):
    rows = [("x", i // 10, i, i % 7) for i in range(100)] + [("y", 3, 1, 5)]
    df = spark.createDataFrame(rows, "k string, b long, i long, v long").withColumn("_carry_0", F.lit(0))
    got = {(r["k"], r["i"]): r["total"] for r in running_sums(df, ["k"], "b", ["i"], {"total": "v"}).collect()}
    total = 0
    for k, _, i, v in rows[:100]:
        total += v
        assert got[(k, i)] == total
    assert got[("y", 1)] == 5
    assert fresh(["A", "b"], "a", "a") == ["a_", "a__"]


def brute_sessions(rows, gap):
    out = []
    for key in sorted({(u, t) for u, t, _ in rows}):
        times = sorted(at for u, t, at in rows if (u, t) == key)
        start = last = times[0]
        n = 1
        for at in times[1:]:
            if at - last > gap:
                out.append((*key, start, last, n))
                start, n = at, 0
            last = at
            n += 1
        out.append((*key, start, last, n))
    return out


@pytest.mark.parametrize("rows_per_core", [20, 100_000])
def test_sessions_match_brute_force(spark, rows_per_core):
    gap, rng = 1_000_000, random.Random(3)
    rows = [(rng.choice("aaab"), rng.choice([1, 1, 1, 2]), rng.choice([0, gap, gap + 1]) * k + rng.randrange(3) * 400_000) for k in range(400)]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "u string, t long, us long, id long").withColumn("at", F.timestamp_micros("us"))
    df = df.union(df.limit(30)).withColumns({"k0": F.lit("clash"), "flush": F.lit(True), "n": F.lit(0)})  # lines shipped again, extra columns
    got = replay_sessions(df, ["u", "t"], "at", gap, "id", rows_per_core).select("u", "t", F.unix_micros("first"), F.unix_micros("last"), "n")
    assert sorted(map(tuple, got.collect())) == brute_sessions(rows, gap)


def test_sessions_special_cases(spark):
    rows = [("a", 1, 5, 1), (None, 1, 5, 2), ("a", None, 5, 3), ("a", 1, None, 4), ("a", 1, 5, None), ("a", 1, 5, 6)]
    df = spark.createDataFrame(rows, "u string, t long, us long, id long").withColumn("at", F.timestamp_micros("us"))
    assert [tuple(r)[-1] for r in replay_sessions(df, ["u", "t"], "at", 10, "id").collect()] == [2]
    assert replay_sessions(df, ["u"], "at", 10).first()["n"] == 4  # every row counts without an id
    assert replay_sessions(df.limit(0), ["u", "t"], "at", 10, "id").collect() == []


def test_session_timers_on_a_live_stream(spark, tmp_path):
    def feed(name, seconds):
        spark.createDataFrame([("a", s) for s in seconds], "u string, s long").select("u", F.timestamp_seconds("s").alias("at")).write.parquet(f"{tmp_path}/in/{name}")

    feed("p1", [100, 105])
    stream = spark.readStream.schema("u string, at timestamp").option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    query = session_timers(stream, ["u"], "at", 10_000_000).writeStream.format("memory").queryName("live").outputMode("append").trigger(processingTime="0 seconds").start()
    try:
        query.processAllAvailable()
        assert spark.table("live").count() == 0  # the timer has not run out
        feed("p2", [115, 200])
        query.processAllAvailable()
        assert [tuple(r) for r in spark.table("live").select(F.unix_seconds("first"), F.unix_seconds("last"), "n").collect()] == [(100, 115, 3)]
    finally:
        query.stop()


def test_trailing_totals_match_brute_force(spark):
    day0, rng = datetime.date(2024, 2, 20), random.Random(5)
    rows = [(rng.choice("ab"), day0 + datetime.timedelta(days=rng.choice([0, 1, 2, 9, 40, 41, 100])), rng.choice([None, 1, 5, 1000])) for _ in range(60)]
    df = spark.createDataFrame(rows, "u string, d date, v long").withColumns({"e": F.lit(1), "lo": F.lit(2), "day_": F.lit(3)})
    got = {(r["u"], r["day"]): r for r in trailing_totals(df, "u", "d", "v").collect()}
    for user in "ab":
        own = [(d, v or 0) for u, d, v in rows if u == user]
        first, last = min(own)[0], max(own)[0]
        for k in range((last - first).days + 1):
            day = first + datetime.timedelta(days=k)
            r = got.pop((user, day))
            for w in (7, 30):
                held = [v for d, v in own if 0 <= (day - d).days < w]
                assert (r[f"sum_{w}"], r[f"n_{w}"], r[f"avg_{w}"]) == (sum(held), len(held), sum(held) / w)
    assert not got


def test_trailing_totals_special_cases(spark):
    df = spark.createDataFrame([(None, "2024-01-01", 1), ("a", None, 2), ("a", "2024-01-05", None)], "u string, d string, v int")
    assert [(r["u"], str(r["day"]), r["sum_7"], r["n_7"]) for r in trailing_totals(df, "u", "d", "v").collect()] == [("a", "2024-01-05", 0, 1)]
    assert trailing_totals(df.limit(0), "u", "d", "v").collect() == []


def test_sweep_counts_an_id_once(spark):
    rows = [("a", 0, 10, 1), ("a", 0, 10, 1), ("a", 5, 90, 2), ("a", 5, 90, 2), ("a", 200, 210, None), (None, 1, 2, 3)]
    df = spark.createDataFrame(rows, "u string, s long, t long, id long").withColumn("b", F.lit("x"))
    for bucket in (7, 1000):
        assert [tuple(r) for r in sweep(df, "u", "s", "t", bucket, "id").collect()] == [("a", 0, 90, 2, None)]
    assert sweep(df.limit(0), "u", "s", "t", event_id="id").collect() == []
