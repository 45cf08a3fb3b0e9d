"""Change capture: applying row images to a table, in batches and from a stream."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..hadoop import names, put_new, read_text, remove
from ..operators.dml import last_per_key
from ..operators.prefix import fresh

INSERT, UPDATE, DELETE = "insert", "update", "delete"


class SchemaChanged(RuntimeError):
    """The captured table's columns changed while it was being moved."""


def guard_schema(changes: DataFrame, table: DataFrame, op: str, seq: str) -> None:
    """A change of the columns during capture is an error."""
    got = {(f.name, f.dataType) for f in changes.schema if f.name not in (op, seq)}
    want = {(f.name, f.dataType) for f in table.schema}
    if got != want:
        raise SchemaChanged(f"columns {sorted(n for n, _ in got ^ want)} differ from the table's")


def apply_changes(table: DataFrame, changes: DataFrame, keys: list[str], op: str = "op", seq: str = "seq") -> DataFrame:
    """The table after the changes: of each key the image with the highest ``seq`` wins, whole, nulls included.

    ``changes`` has the table's columns, ``op`` (insert, update or delete) and ``seq`` (a total order per key). The
    latest image per key comes from one aggregation; one anti join takes known keys out of the table. Keys are compared
    null-safely in both.
    """
    guard_schema(changes, table, op, seq)
    latest = last_per_key(changes, keys, seq)
    known = latest.select(*(F.col(f"`{k}`").alias(f"_key{i}") for i, k in enumerate(keys)))
    same = [table[k].eqNullSafe(known[f"_key{i}"]) for i, k in enumerate(keys)]
    kept = table.join(known, same, "left_anti")
    return kept.union(latest.where(F.col(op) != DELETE).select(*table.columns))


def apply_keyless(table: DataFrame, inserts: DataFrame, deletes: DataFrame) -> DataFrame:
    """Changes of a table without key: rows are told apart by all columns; each delete takes one of the equal rows.

    Equal rows are counted on both sides, and what is left is laid out again.
    """
    n, copy = fresh(table.columns, "_n", "_copy")
    signed = table.withColumn(n, F.lit(1)).unionByName(inserts.withColumn(n, F.lit(1))).unionByName(deletes.withColumn(n, F.lit(-1)))
    left = signed.groupBy(*table.columns).agg(F.sum(n).alias(n)).where(F.col(n) > 0)
    return left.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*table.columns)


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Catch-up check: equal number of rows, and equal sums of two 64-bit hashes of the rows, in any order."""

    def digest(df: DataFrame) -> tuple:
        cells: list[Column] = [x for c in a.columns for x in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())]
        hashes = (F.xxhash64(F.lit(seed), *cells).cast("decimal(38,0)") for seed in (1, 2))
        return tuple(df.agg(F.count(F.lit(1)), *(F.sum(h) for h in hashes)).first())

    return set(a.columns) == set(b.columns) and digest(a) == digest(b)


class BucketedCopy:
    """A copy of a table cut into buckets by the hash of its keys, so that changes rewrite only the buckets they fall in.

    ``path/states/`` holds the states, each the folder of every bucket and the number of the batch that made it; the
    highest counts. A state appears at once, when its folders are complete, and a batch that was applied already is
    left out, so a batch run again after a failure changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str, schema, keys: list[str], buckets: int = 256) -> None:
        self.spark, self.path, self.schema, self.keys, self.buckets = spark, path.rstrip("/"), schema, keys, buckets
        self.bucket, = fresh(schema.fieldNames(), "_bucket")

    def _states(self) -> list[int]:
        return sorted(int(n[:-5]) for n in names(self.spark, f"{self.path}/states") if n.endswith(".json"))

    def _state(self) -> dict:
        return json.loads(read_text(self.spark, f"{self.path}/states/{self._states()[-1]:012d}.json"))

    @property
    def started(self) -> bool:
        return bool(self._states())

    def _write(self, rows: DataFrame, name: str) -> dict[str, str]:
        """Writes rows cut by bucket: the folder of each bucket that has any."""
        folder = f"{self.path}/{name}-{uuid.uuid4().hex}"
        bucket = F.pmod(F.xxhash64(*(F.col(f"`{k}`") for k in self.keys)), F.lit(self.buckets)).cast("int")
        rows.withColumn(self.bucket, bucket).hint("rebalance", F.col(self.bucket)).write.partitionBy(self.bucket).parquet(folder)
        return {n.split("=")[1]: f"{folder}/{n}" for n in names(self.spark, folder) if n.startswith(f"{self.bucket}=")}

    def start(self, snapshot: DataFrame) -> None:
        """Takes the snapshot, unless there is a copy already. State 0 has seen no batch."""
        if not self.started:
            put_new(self.spark, f"{self.path}/states/{0:012d}.json", json.dumps({"folders": self._write(snapshot, "snapshot")}))

    def load(self, buckets: list[int] | None = None) -> DataFrame:
        """The table, or the rows of some buckets."""
        folders = self._state()["folders"]
        paths = [p for b, p in sorted(folders.items()) if buckets is None or int(b) in buckets]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def apply(self, changes: DataFrame, batch: int, op: str = "op", seq: str = "seq") -> None:
        """Applies a batch of changes; see :func:`apply_changes`. Batches count from 0."""
        if self._states()[-1] > batch:
            return
        hashed = F.pmod(F.xxhash64(*(F.col(f"`{k}`") for k in self.keys)), F.lit(self.buckets)).cast("int")
        touched = [r[0] for r in changes.select(hashed).distinct().collect()]  # at most one a bucket
        folders = self._state()["folders"]
        if touched:
            new = self._write(apply_changes(self.load(touched), changes, self.keys, op, seq), f"batch{batch}")
            folders = {b: p for b, p in folders.items() if int(b) not in touched} | new
        put_new(self.spark, f"{self.path}/states/{batch + 1:012d}.json", json.dumps({"folders": folders}))
        self._forget(folders)

    def _forget(self, folders: dict[str, str]) -> None:
        """Deletes states but the last two, and folders that neither names."""
        states = self._states()
        before = json.loads(read_text(self.spark, f"{self.path}/states/{states[-2]:012d}.json"))["folders"] if len(states) > 1 else {}
        used = {p.split("/")[-2] for p in (*folders.values(), *before.values())}
        for n in names(self.spark, self.path):
            if n.startswith(("batch", "snapshot-")) and n not in used:
                remove(self.spark, f"{self.path}/{n}")
        for k in states[:-2]:
            remove(self.spark, f"{self.path}/states/{k:012d}.json")


def follow(stream: DataFrame, load: Callable[[], DataFrame], store: Callable[[DataFrame, int], None], keys: list[str], checkpoint: str, op: str = "op", seq: str = "seq"):
    """Starts a query that applies each micro-batch of changes to the table ``load`` gives and hands it to ``store``.

    ``store`` gets the number of the batch and must replace the table at once, so that a batch run again after a
    failure finds or makes the same state: applying the same images twice changes nothing. Each batch reads the whole
    table; for large ones see :class:`BucketedCopy`.
    """

    def one(batch: DataFrame, number: int) -> None:
        store(apply_changes(load(), batch, keys, op, seq), number)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class NotCaughtUp(RuntimeError):
    """The copy still differs from the source after all tries."""


def migrate(snapshot: DataFrame, stream: DataFrame, source: Callable[[], DataFrame], path: str, keys: list[str], tries: int = 30, wait_s: float = 5.0, buckets: int = 256) -> DataFrame:
    """Copies a table, applies the changes made meanwhile, and compares until the copy equals ``source()``.

    The copy lies below ``path`` as a :class:`BucketedCopy`. A migration begun before goes on from its last state: the
    snapshot is taken once, and each batch of the log is applied once. Where the snapshot was not completed, nothing of
    the log had been applied, and both begin anew.
    """
    spark = snapshot.sparkSession
    copy = BucketedCopy(spark, f"{path}/copy", snapshot.schema, keys, buckets)
    if not copy.started:
        remove(spark, f"{path}/log")
        copy.start(snapshot)
    for left in reversed(range(tries)):
        query = stream.writeStream.foreachBatch(copy.apply).option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start()
        query.awaitTermination()
        if same_rows(source(), copy.load()):
            return copy.load()
        if left:
            time.sleep(wait_s)
    raise NotCaughtUp(f"{path} differs from its source after {tries} tries")
