"""Percentiles of huge numeric columns with bounded error, mergeable (problem 5).

A sketch is a hierarchy of compactors. A value at level h stands for 2**h values. A level that is full is sorted, and
its even or its odd places, by the toss of a coin, move up one level; the others are dropped. Capacities shrink
geometrically from the top level, ``k`` values, downwards. Sketches merge level by level and are then compacted.

Error: the rank of an answer is off by at most :func:`rank_error` * n with 99 % probability, whatever the order of
values and merges. Groups of up to ``k`` values are held whole, and answered exactly.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K = 512
SHRINK = 2 / 3


def rank_error(k: int = K) -> float:
    """Normalised rank error of one answer, kept with 99 % probability.

    A compaction at level h moves a rank by at most 2**h, up or down with equal chance, and level h sees at most
    n / (2**h k c**(H-h)) of them (c: the shrink factor, H: the top level). Added up over h < H, the variance is at
    most n 2**H / (k (2c - 1)), and 2**H <= 2n / (k c), as level H - 1 was full. 2.58 deviations hold 99 %.
    """
    return 2.58 * (2 / (SHRINK * (2 * SHRINK - 1))) ** 0.5 / k


class Compactors:
    """One sketch."""

    def __init__(self, k: int = K, seed: int = 0) -> None:
        self.k, self.n, self.levels = k, 0, [np.empty(0, np.float64)]
        self.coin = np.random.default_rng(seed)

    def capacity(self, h: int) -> int:
        return max(8, int(self.k * SHRINK ** (len(self.levels) - 1 - h)))

    def add(self, values: np.ndarray) -> None:
        """Takes in values in pieces no longer than the sketch, so that memory stays bounded."""
        for at in range(0, len(values), 16 * self.k):
            piece = values[at : at + 16 * self.k]
            self.n += len(piece)
            self.levels[0] = np.concatenate([self.levels[0], piece])
            self.compress()

    def merge(self, n: int, levels: list[np.ndarray]) -> None:
        while len(self.levels) < len(levels):
            self.levels.append(np.empty(0, np.float64))
        for h, values in enumerate(levels):
            self.levels[h] = np.concatenate([self.levels[h], values])
        self.n += n
        self.compress()

    def size(self) -> int:
        return sum(map(len, self.levels))

    def compress(self) -> None:
        """Compacts full levels, from the lowest, until the sketch is within its size."""
        while self.size() > sum(self.capacity(h) for h in range(len(self.levels))):
            h = next(h for h, x in enumerate(self.levels) if len(x) > self.capacity(h))
            if h + 1 == len(self.levels):
                self.levels.append(np.empty(0, np.float64))
            x = np.sort(self.levels[h])
            even = len(x) & ~1
            self.levels[h] = x[even:]
            self.levels[h + 1] = np.concatenate([self.levels[h + 1], x[int(self.coin.integers(2)) : even : 2]])

    def quantiles(self, at: list[float]) -> list[float]:
        """The smallest held values whose estimated rank reaches each part of n."""
        values = np.concatenate(self.levels)
        weight = np.repeat(2.0 ** np.arange(len(self.levels)), [len(x) for x in self.levels])
        order = np.argsort(values, kind="stable")
        ranks = np.cumsum(weight[order])
        where = np.searchsorted(ranks, np.array(at) * ranks[-1] - 1e-9 * ranks[-1])
        return values[order][np.minimum(where, len(values) - 1)].tolist()


def _seed(*parts: object) -> int:
    return zlib.crc32(repr(parts).encode())


def _runs(batch: pa.RecordBatch, keys: list[str]) -> list[tuple[tuple, int, int]]:
    """(key values, from, to) of the runs of equal keys."""
    if not batch.num_rows:
        return []
    codes = [batch.column(k).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False) for k in keys]
    change = np.zeros(batch.num_rows, bool)
    change[0] = True
    for c in codes:
        change[1:] |= c[1:] != c[:-1]
    starts = np.flatnonzero(change)
    ends = np.append(starts[1:], batch.num_rows)
    heads = [batch.column(k).take(pa.array(starts)).to_pylist() for k in keys]
    return [(tuple(h[i] for h in heads), int(s), int(e)) for i, (s, e) in enumerate(zip(starts, ends, strict=True))]


def _schema(df: DataFrame, keys: list[str], more: str) -> str:
    return ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys) + ", " + more


def _records(df_keys: pa.Schema, keys: list[str], done: list[tuple[tuple, Compactors]]) -> pa.RecordBatch:
    columns = [pa.array([key[i] for key, _ in done], df_keys.field(k).type) for i, k in enumerate(keys)]
    n = pa.array([s.n for _, s in done], pa.int64())
    levels = pa.array([s.levels for _, s in done], pa.list_(pa.list_(pa.float64())))
    return pa.RecordBatch.from_arrays([*columns, n, levels], names=[*keys, "n", "levels"])


def build(df: DataFrame, keys: list[str], value: str, k: int = K) -> DataFrame:
    """Sketches (keys, n, levels) of ``value`` per group, one per partition the group has rows in.

    Rows come to a task sorted by the keys, so it holds one sketch at a time, whatever the number of groups. No row is
    moved: spread hot groups over partitions beforehand and :func:`merge` afterwards. Null and NaN values are left
    out; null keys are a group like any other. An empty table gives no rows. Extra columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, sketch, done, held, schema = None, None, [], 0, None
        for batch in batches:
            schema = batch.schema
            values = batch.column("_value").to_numpy(zero_copy_only=False)
            for key, start, end in _runs(batch, keys):
                if key != current:
                    if sketch is not None:
                        done.append((current, sketch))
                        held += sketch.size() + 8
                        if held > 50_000:
                            yield _records(schema, keys, done)
                            done, held = [], 0
                    current, sketch = key, Compactors(k, _seed(key))
                sketch.add(values[start:end])
        if sketch is not None:
            yield _records(schema, keys, [*done, (current, sketch)])

    rows = df.select(*keys, F.col(value).cast("double").alias("_value")).where("_value IS NOT NULL AND NOT isnan(_value)")
    return rows.sortWithinPartitions(*keys).mapInArrow(run, _schema(df, keys, "n bigint, levels array<array<double>>"))


def merge(sketches: DataFrame, keys: list[str], k: int = K) -> DataFrame:
    """One sketch per group of (coarser) ``keys`` from all partial ones, merged level by level.

    Sketches of a group come to one task one after another and are merged into one of bounded size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, sketch, done, schema = None, None, [], None
        for batch in batches:
            schema = batch.schema
            n, levels = batch.column("n").to_pylist(), batch.column("levels").to_pylist()
            for key, start, end in _runs(batch, keys):
                if key != current:
                    if sketch is not None:
                        done.append((current, sketch))
                    current, sketch = key, Compactors(k, _seed(key, "merge"))
                for i in range(start, end):
                    sketch.merge(n[i], [np.array(x, np.float64) for x in levels[i]])
            if len(done) > 500:
                yield _records(schema, keys, done)
                done = []
        if sketch is not None:
            yield _records(schema, keys, [*done, (current, sketch)])

    rows = sketches.select(*keys, "n", "levels").repartition(*keys).sortWithinPartitions(*keys)
    return rows.mapInArrow(run, _schema(sketches, keys, "n bigint, levels array<array<double>>"))


def quantiles(sketches: DataFrame, keys: list[str], at: dict[str, float], k: int = K) -> DataFrame:
    """(keys, n, one column per entry of ``at`` (name -> part of n), rank_error): answers of each sketch.

    ``rank_error`` is 0 for a group that is held whole.
    """
    parts = list(at.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, levels = batch.column("n").to_pylist(), batch.column("levels").to_pylist()
            answers, errors = [], []
            for count, held in zip(n, levels, strict=True):
                s = Compactors(k)
                s.n, s.levels = count, [np.array(x, np.float64) for x in held]
                answers.append(s.quantiles(parts))
                errors.append(rank_error(k) if len(held) > 1 else 0.0)
            columns = [pa.array([a[i] for a in answers], pa.float64()) for i in range(len(parts))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keys), batch.column("n"), *columns, pa.array(errors, pa.float64())], names=[*keys, "n", *at, "rank_error"])

    return sketches.mapInArrow(run, _schema(sketches, keys, "n bigint, " + ", ".join(f"`{a}` double" for a in at) + ", rank_error double"))


def spread(df: DataFrame, keys: list[str], by: Column, salts: int = 32) -> DataFrame:
    """Partitions by the keys and a salt taken from ``by``, so that a hot group meets ``salts`` tasks.

    Rows equal in the keys and ``by`` stay together.
    """
    return df.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int")).repartition(*keys, "_salt")
