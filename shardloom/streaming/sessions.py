"""Sessions separated by inactivity, closed by the watermark passing their end (problem 6)."""

from __future__ import annotations

import contextlib
import math
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import remove, scratch_path
from ..operators.prefix import fresh

#: Rows that one core takes in per micro-batch of a replay. They bound the sessions a core holds open, each some 200
#: bytes of state; a batch costs about a second besides its rows, for state files and the log of offsets.
ROWS_PER_CORE = 1_000_000


def session_timers(stream: DataFrame, keys: list[str], ts: str, gap_us: int, delay_us: int = 1_000_000) -> DataFrame:
    """Sessions of a stream: (keys, first, last, n), each emitted once, when its timer has run out.

    This is ``session_window`` in append mode. Its state holds the open sessions by key; an event opens one or moves the
    end of the open one to ``gap_us`` after itself, and one exactly ``gap_us`` after the one before still belongs to it.
    There is no timer of its own for each key: when the watermark, the latest event time less ``delay_us``, passes the
    end of a session, the session is given out and leaves the state. Events may come out of order by up to ``delay_us``.
    Keys and ``ts`` (a timestamp) must not be null.
    """
    window, = fresh(stream.columns, "_window")
    timed = stream.withWatermark(ts, f"{delay_us} microseconds")
    grouped = timed.groupBy(*keys, F.session_window(ts, f"{gap_us} microseconds").alias(window))
    return grouped.agg(F.min(ts).alias("first"), F.max(ts).alias("last"), F.count(F.lit(1)).alias("n")).drop(window)


@contextlib.contextmanager
def _conf(spark: SparkSession, **settings: str) -> Iterator[None]:
    old = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _stage(rows: DataFrame, path: str, chunks: int, per_chunk: int) -> None:
    """Writes the rows, repeated (at, id) once, as folders chunk=0, 1, ... that follow one another in time."""
    ranged = rows.repartitionByRange(chunks * per_chunk, "at", "id")
    once = ranged.dropDuplicates(["at", "id"])  # needs no shuffle: the range partitions hold equal (at, id) together
    once.withColumn("chunk", F.floor(F.spark_partition_id() / per_chunk).cast("int")).write.partitionBy("chunk").parquet(path)


def replay_sessions(df: DataFrame, keys: list[str], ts: str, gap_us: int, event_id: str | None = None, rows_per_core: int = ROWS_PER_CORE) -> DataFrame:
    """Sessions of a bounded table, found by playing it through :func:`session_timers` in the order of ``ts``.

    Returns (keys, first, last, n). Rows with a null key, ``ts`` or ``event_id`` are left out; of rows equal in ``ts``
    and ``event_id`` one counts; without ``event_id`` every row counts. An empty table gives no rows. Extra columns
    are ignored, whatever their names; keys must not be called first, last or n.

    The table is range-partitioned by time into chunks of ``rows_per_core`` rows a core. A streaming query takes in
    chunk after chunk; its state holds the sessions of one chunk. The last event is followed by a marker beyond its
    end, so that every session is closed. Events of a key are merged into sessions before the shuffle, so a key
    that holds much of a chunk sends a few sessions per task. Staged rows and results lie in the shared folder.
    """
    spark = df.sparkSession
    names = [f"k{i}" for i in range(len(keys))]
    rows = df.select(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True)), F.col(ts).cast("timestamp").alias("at"), (F.col(event_id) if event_id else F.expr("uuid()")).alias("id")).dropna()
    total, latest = rows.agg(F.count(F.lit(1)), F.max(F.unix_micros("at"))).first()
    cores = spark.sparkContext.defaultParallelism
    chunks = max(1, math.ceil(total / (rows_per_core * cores)))
    base = scratch_path(spark, "sessions")
    schema = ", ".join(f"`{n}` {rows.schema[n].dataType.simpleString()}" for n in names) + ", at timestamp, flush boolean"
    if total:
        _stage(rows.withColumn("flush", F.lit(False)), f"{base}/staged", chunks, cores)
        marker = spark.range(1).select(F.lit(0).alias("chunk"), F.timestamp_micros(F.lit(latest + gap_us + 10_000_000)).alias("at"), F.lit(True).alias("flush"))
        zero = {"string": "''"}
        marker = marker.select(*(F.expr(f"CAST({zero.get(rows.schema[n].dataType.simpleString(), '0')} AS {rows.schema[n].dataType.simpleString()})").alias(n) for n in names), "at", "flush")
        marker.coalesce(1).write.parquet(f"{base}/staged/chunk={chunks}")
        _play(spark, base, schema, names, gap_us, chunks)
        found = spark.read.parquet(f"{base}/out").where("NOT flush")  # in the stream, this would filter the marker before it moves the watermark
    else:
        found = spark.createDataFrame([], schema + ", first timestamp, last timestamp, n bigint")
    return found.select(*(F.col(n).alias(k) for k, n in zip(keys, names, strict=True)), "first", "last", "n")


def _play(spark: SparkSession, base: str, schema: str, names: list[str], gap_us: int, chunks: int) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(base).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(hadoop(f"{base}/live"))

    def release(k: int) -> None:
        if fs.exists(hadoop(f"{base}/staged/chunk={k}")) and not fs.rename(hadoop(f"{base}/staged/chunk={k}"), hadoop(f"{base}/live/part{k:09d}")):
            raise OSError(f"chunk {k} of {base} could not be moved")

    # Without partial merging a key that holds a third of the rows would meet in one task row by row.
    with _conf(spark, **{"spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true"}):
        release(0)
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{base}/live")
        closed = session_timers(stream, [*names, "flush"], "at", gap_us)
        query = (
            closed.writeStream.outputMode("append").format("parquet")
            .option("checkpointLocation", f"{base}/log").trigger(processingTime="0 seconds").start(f"{base}/out")
        )
        try:
            query.processAllAvailable()
            for k in range(1, chunks + 1):
                release(k)
                query.processAllAvailable()
        finally:
            query.stop()
    for done in ("staged", "live", "log"):
        remove(spark, f"{base}/{done}")
