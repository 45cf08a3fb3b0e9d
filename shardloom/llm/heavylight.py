"""Most frequent items with bounded memory (problem 3).

Heavy part: ``buckets`` exact buckets, each with a resident item, its votes, and the votes against it. An item that
meets its own bucket adds to its votes; another adds to the votes against and is counted in the light part. When the
votes against reach ``ratio`` times the resident's, the resident is evicted, its votes go to the light part, and the
other takes the bucket. Light part: one array of ``cells`` counters.

So for every item, true count <= votes (if resident) + its light cell, and true count >= votes. Parts made on separate
partitions or days merge: light arrays are added, residents of one bucket are recombined (votes of the same item add,
the greatest stays, the others go to the light part). The bounds survive any order of merging. An item whose count
exceeds the threshold is thus a resident above it or lies in a light cell above it: no frequent item can be missed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..lineage import cut
from ..operators.prefix import fresh


@dataclass(frozen=True)
class HeavyLight:
    """buckets, cells: sizes of the two parts (powers of two, cells >= buckets); ratio: votes against for an eviction;
    blocks: into how many pieces a sketch is cut for merging."""

    buckets: int = 2048
    cells: int = 65536
    ratio: int = 8
    blocks: int = 32

    def __post_init__(self) -> None:
        for n in (self.buckets, self.cells, self.blocks):
            if n < 2 or n & (n - 1):
                raise ValueError("sizes must be powers of two, 2 or more")
        if self.blocks > self.buckets or self.buckets > self.cells:
            raise ValueError("blocks <= buckets <= cells")


class Sketch:
    """The two parts of one column on one partition. Items are told apart by their 64-bit hash."""

    def __init__(self, p: HeavyLight) -> None:
        self.p = p
        self.key = np.zeros(p.buckets, np.int64)
        self.votes = np.zeros(p.buckets, np.int64)
        self.against = np.zeros(p.buckets, np.int64)
        self.item = np.empty(p.buckets, object)
        self.light = np.zeros(p.cells, np.int64)

    def cell(self, key: np.ndarray) -> np.ndarray:
        """Light cell of a hash: its top bits, so that a block holds adjacent cells and buckets."""
        return (key.view(np.uint64) >> np.uint64(65 - self.p.cells.bit_length())).astype(np.int64)

    def add(self, key: np.ndarray, count: np.ndarray, items: np.ndarray) -> None:
        """Takes in different items with their counts."""
        order = np.argsort(-count, kind="stable")
        key, count, items = key[order], count[order], items[order]
        # Bits between those of the cell and the lowest pick the place in the bucket's block.
        bucket = self.bucket(key)
        own = (self.votes[bucket] > 0) & (self.key[bucket] == key)
        self.votes[bucket[own]] += count[own]
        key, count, items, bucket = key[~own], count[~own], items[~own], bucket[~own]
        free, where = np.unique(bucket, return_index=True)  # the first of a bucket is its most frequent
        take = self.votes[free] == 0
        self._seat(free[take], key, count, items, where[take])
        rest = np.ones(len(key), bool)
        rest[where[take]] = False
        key, count, items, bucket = key[rest], count[rest], items[rest], bucket[rest]
        np.add.at(self.against, bucket, count)
        np.add.at(self.light, self.cell(key), count)
        rivals, where = np.unique(bucket, return_index=True)
        lost = self.against[rivals] >= self.p.ratio * self.votes[rivals]
        rivals, where = rivals[lost], where[lost]
        np.add.at(self.light, self.cell(self.key[rivals]), self.votes[rivals])
        np.subtract.at(self.light, self.cell(key[where]), count[where])
        self._seat(rivals, key, count, items, where)

    def bucket(self, key: np.ndarray) -> np.ndarray:
        per = self.p.buckets // self.p.blocks
        block = key.view(np.uint64) >> np.uint64(65 - self.p.blocks.bit_length())
        return (block * np.uint64(per) + key.view(np.uint64) % np.uint64(per)).astype(np.int64)

    def _seat(self, buckets: np.ndarray, key: np.ndarray, count: np.ndarray, items: np.ndarray, where: np.ndarray) -> None:
        self.key[buckets], self.votes[buckets], self.against[buckets] = key[where], count[where], 0
        self.item[buckets] = items[where]

    def pieces(self) -> Iterator[tuple[int, bytes, np.ndarray, np.ndarray, list]]:
        """(block, light counters, keys, votes, items) of each block that is not empty."""
        per, wide = self.p.buckets // self.p.blocks, self.p.cells // self.p.blocks
        for b in range(self.p.blocks):
            light = self.light[b * wide : (b + 1) * wide]
            seats = b * per + np.flatnonzero(self.votes[b * per : (b + 1) * per])
            if len(seats) or light.any():
                yield b, light.tobytes(), self.key[seats], self.votes[seats], list(self.item[seats])

    def merge(self, light_at: int, light: np.ndarray, key: np.ndarray, votes: np.ndarray, items: np.ndarray) -> None:
        """Takes in a piece of another sketch: residents of one bucket are recombined."""
        self.light[light_at : light_at + len(light)] += light
        bucket = self.bucket(key)
        same = (self.votes[bucket] > 0) & (self.key[bucket] == key)
        self.votes[bucket[same]] += votes[same]
        key, votes, items, bucket = key[~same], votes[~same], items[~same], bucket[~same]
        wins = votes > self.votes[bucket]
        old = bucket[wins]
        np.add.at(self.light, self.cell(self.key[old]), self.votes[old])
        np.add.at(self.light, self.cell(key[~wins]), votes[~wins])
        self.key[old], self.votes[old], self.item[old] = key[wins], votes[wins], items[wins]


SKETCH = "field string, block int, light binary, keys array<bigint>, votes array<bigint>, items array<string>"


def _rows(sketches: dict[str, Sketch]) -> Iterator[pa.RecordBatch]:
    for field, s in sketches.items():
        for block, light, key, votes, items in s.pieces():
            yield pa.RecordBatch.from_pylist(
                [{"field": field, "block": block, "light": light, "keys": key.tolist(), "votes": votes.tolist(), "items": items}],
                schema=pa.schema([("field", pa.string()), ("block", pa.int32()), ("light", pa.binary()), ("keys", pa.list_(pa.int64())), ("votes", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))]),
            )


def build(df: DataFrame, columns: list[str], p: HeavyLight = HeavyLight()) -> DataFrame:
    """Sketches of the columns (as strings), one per partition, cut into blocks; see :func:`merged`.

    Memory of a task is that of one sketch per column, however many rows it reads. Nulls are no items; empty and very
    long strings are items like any other. An empty table gives no rows. Extra columns are not read.
    """
    names = [f"c{i}" for i in range(len(columns))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketches = {c: Sketch(p) for c in columns}
        for batch in batches:
            for column, name in zip(columns, names, strict=True):
                values = batch.column(name)
                keys = batch.column(f"h{name}").to_numpy()
                if values.null_count:
                    there = values.is_valid().to_numpy(zero_copy_only=False)
                    values, keys = values.filter(pa.array(there)), keys[there]
                if len(keys):
                    key, first, count = np.unique(keys, return_index=True, return_counts=True)
                    sketches[column].add(key, count.astype(np.int64), np.array(values.take(pa.array(first)).to_pylist(), object))
        yield from _rows(sketches)

    strings = [F.col(c).cast("string") for c in columns]
    rows = df.select(*(s.alias(n) for s, n in zip(strings, names, strict=True)), *(F.xxhash64(s).alias(f"h{n}") for s, n in zip(strings, names, strict=True)))
    return rows.mapInArrow(run, SKETCH)


def merged(sketches: DataFrame, p: HeavyLight = HeavyLight()) -> DataFrame:
    """One sketch per field of all partial ones, cut into blocks as before.

    The pieces of a block meet in one task and are taken in one after another; the task holds one sketch per field,
    of fixed size, however many there are.
    """
    wide = p.cells // p.blocks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketches: dict[str, Sketch] = {}
        for batch in batches:
            for row in batch.to_pylist():
                s = sketches.setdefault(row["field"], Sketch(p))
                s.merge(row["block"] * wide, np.frombuffer(row["light"], np.int64), np.array(row["keys"], np.int64), np.array(row["votes"], np.int64), np.array(row["items"], object))
        yield from _rows(sketches)

    return sketches.repartition(p.blocks, "block").mapInArrow(run, SKETCH)


def residents(sketch: DataFrame, p: HeavyLight = HeavyLight()) -> DataFrame:
    """(field, item, key, lower, upper): the residents of a merged sketch with the bounds of their counts."""
    wide = p.cells // p.blocks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell = Sketch(p).cell
        for batch in batches:
            for row in batch.to_pylist():
                key, votes = np.array(row["keys"], np.int64), np.array(row["votes"], np.int64)
                light = np.frombuffer(row["light"], np.int64)
                upper = votes + light[cell(key) - row["block"] * wide]
                yield pa.RecordBatch.from_arrays([pa.array([row["field"]] * len(key)), pa.array(row["items"], pa.string()), pa.array(key), pa.array(votes), pa.array(upper)], names=["field", "item", "key", "lower", "upper"])

    return sketch.mapInArrow(run, "field string, item string, key bigint, lower bigint, upper bigint")


def hot_cells(sketch: DataFrame, least: dict[str, int], p: HeavyLight = HeavyLight()) -> DataFrame:
    """(field, cell): light cells that reach ``least`` of their field: at most (number of rows) / least of them."""
    wide = p.cells // p.blocks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                hot = np.flatnonzero(np.frombuffer(row["light"], np.int64) >= least[row["field"]]) + row["block"] * wide
                yield pa.RecordBatch.from_arrays([pa.array([row["field"]] * len(hot), pa.string()), pa.array(hot.astype(np.int64))], names=["field", "cell"])

    return sketch.mapInArrow(run, "field string, cell bigint")


def _among(cell: Column, cells: list[int], p: HeavyLight) -> Column:
    """Whether the cell is one of ``cells``: a map of bits, of one size even if all cells are hot."""
    words = np.zeros(max(1, p.cells // 64), np.uint64)
    at = np.array(cells, np.int64)
    np.bitwise_or.at(words, at // 64, np.uint64(1) << (at % 64).astype(np.uint64))
    return F.getbit(F.get(F.lit(words.view(np.int64)), F.shiftright(cell, 6).cast("int")), cell.bitwiseAND(63).cast("int")) == 1


def _counted(df: DataFrame, columns: list[str], keys: dict[str, list[int]], cells: dict[str, list[int]], event_id: str | None, p: HeavyLight) -> DataFrame:
    """(field, item, n): exact counts of the items of each column whose hash is in ``keys`` or whose cell is in ``cells``.

    Their rows are picked by their hash while reading, first brought together by item and id, so that a hot item is
    spread.
    """
    taken, = fresh(df.columns, "_f")
    parts = []
    for c in columns:
        s = F.col(c).cast("string")
        key = F.xxhash64(s)
        picked = key.isin(keys.get(c, []))
        if cells.get(c):
            picked |= _among(F.shiftrightunsigned(key, 65 - p.cells.bit_length()), cells[c], p)
        parts.append(F.when(s.isNotNull() & picked, F.struct(F.lit(c).alias("field"), s.alias("item"))))
    rows = df.select(F.explode(F.array_compact(F.array(*parts))).alias(taken), *([F.col(event_id).alias("_id")] if event_id else []))
    grouped = rows.groupBy(F.col(f"{taken}.field").alias("field"), F.col(f"{taken}.item").alias("item"))
    n = F.count_distinct(F.col("_id")) if event_id else F.count(F.lit(1))
    return grouped.agg(n.alias("n"))


def _by_field(rows: list[Row], column: str) -> dict[str, list[int]]:
    out: dict[str, list[int]] = {}
    for r in rows:
        out.setdefault(r["field"], []).append(r[column])
    return out


def _reaching(df: DataFrame, columns: list[str], sketch: DataFrame, least: dict[str, int], event_id: str | None, p: HeavyLight) -> DataFrame:
    """(field, item, n): all items of each column that reach its ``least``, counted exactly.

    The sketch names the candidates: residents whose upper bound reaches it, and items in a light cell that does.
    """
    near = [r for r in residents(sketch, p).select("field", "key", "upper").collect() if r["upper"] >= least[r["field"]]]
    cells = hot_cells(sketch, least, p).collect()
    floor = F.coalesce(*(F.when(F.col("field") == c, F.lit(n)) for c, n in least.items()))
    return _counted(df, columns, _by_field(near, "key"), _by_field(cells, "cell"), event_id, p).where(F.col("n") >= floor)


def frequent(df: DataFrame, columns: list[str], least: int, event_id: str | None = None, p: HeavyLight = HeavyLight()) -> DataFrame:
    """(field, item, n): all items held by ``least`` rows or more (with ``event_id``: by that many different ids).

    Candidates, residents and light cells, are at most (rows / least) per column, and never more than the sketch has
    places. Only their rows are then counted exactly.
    """
    if least < 1:
        raise ValueError("least must be at least 1")
    sketch = cut(merged(build(df, columns, p), p), "heavylight")
    return _reaching(df, columns, sketch, dict.fromkeys(columns, least), event_id, p)


def top(df: DataFrame, columns: list[str], k: int, event_id: str | None = None, p: HeavyLight = HeavyLight()) -> DataFrame:
    """(field, item, n): the ``k`` items of each column held by most rows (with ``event_id``: by most different ids).

    Of equal counts the smaller item goes first. The residents are counted exactly; the k-th greatest of their counts
    is the least any of the k can have, and all items that reach it are found as in :func:`frequent`, so none is missed
    that was pushed out of its bucket. With fewer than k residents all items are counted. The flatter the counts near
    the k-th, the more light cells reach it; the rows counted then grow up to the whole table, the result stays exact.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    sketch = cut(merged(build(df, columns, p), p), "heavylight")
    best = Window.partitionBy("field").orderBy(F.desc("n"), "item")

    def ranked(counts: DataFrame) -> DataFrame:
        return counts.where("n > 0").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    seated = _by_field(residents(sketch, p).select("field", "key").collect(), "key")
    last = ranked(_counted(df, columns, seated, {}, event_id, p)).where(F.col("rank") == k).select("field", "n").collect()
    least = dict.fromkeys(columns, 1) | {r["field"]: r["n"] for r in last}
    return ranked(_reaching(df, columns, sketch, least, event_id, p)).drop("rank")
