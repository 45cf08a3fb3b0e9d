"""Where the rows of a table lie: kinds of tables, slot layouts, pruning, and sharded writes."""

from __future__ import annotations

import bisect
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.slots import SLOTS, key_kind, range_of, slot_of
from .messages import Refusal

HASH, LIST, GLOBAL, SINGLE = "HASH", "LIST", "GLOBAL", "SINGLE"
PARTITION_COUNTS = (8, 16, 32, 64)
BLOCKS = 64
#: Column that names a row's segment in tables written by shard.
SHARD = "_shard"


class PlacementError(Refusal):
    """A row or statement that the table's placement refuses."""


@dataclass(frozen=True)
class Segment:
    """A sub-table and the slots [low, high) or the list value it holds."""

    table: str
    backend: str
    low: int | None = None
    high: int | None = None
    value: str | None = None


@dataclass(frozen=True)
class Placement:
    kind: str
    shard_key: str | None = None
    segments: tuple[Segment, ...] = field(default_factory=tuple)
    key_type: str = "bigint"

    def segment_of(self, value: int | float | str | None) -> Segment:
        """The segment that holds a key value."""
        if self.kind == HASH:
            if value is None:
                raise PlacementError("shard_key_null", key=self.shard_key)
            at = slot_of(value)
            return self.segments[bisect.bisect_right([s.low for s in self.segments], at) - 1]
        if self.kind == LIST:
            for s in self.segments:
                if s.value == str(value):
                    return s
            raise PlacementError(f"Table has no partition for value {value}")
        return self.segments[0]

    def prune(self, values: list[int | float | str]) -> list[Segment] | None:
        """The segments that ``key = v`` or ``key IN (..)`` needs; values of no list partition need none.

        None if a literal is of another kind than the key, so that equal values need not look alike.
        """
        found = []
        for v in values:
            v = self._as_key(v)
            if v is None:
                return None
            try:
                found.append(self.segment_of(v))
            except PlacementError:
                if self.kind != LIST:
                    raise
        return list(dict.fromkeys(found))

    def _as_key(self, value: int | float | str) -> int | str | None:
        """The literal as the key's type has it."""
        text = isinstance(value, str)
        if self.key_type == "string":
            return value if text else None
        if key_kind(self.key_type) != "number":
            return None
        if text:
            return int(value) if re.fullmatch(r"\s*[+-]?\d+\s*", value) else None
        return int(value)

    def number_column(self, key: Column) -> Column:
        """Place, from 0, of each row's segment in ``segments``; null where a list has no partition for the value."""
        if self.kind == HASH:
            return range_of(key, [s.low for s in self.segments], self.key_type) - 1
        if self.kind == LIST:
            pairs = [x for i, s in enumerate(self.segments) for x in (F.lit(s.value), F.lit(i))]
            return F.try_element_at(F.create_map(*pairs), key.cast("string"))
        return F.lit(0)

    def shard_column(self, key: Column) -> Column:
        """Name of the segment of each row; null where a list has no partition for the value."""
        if self.kind in (HASH, LIST):
            return F.get(F.array(*(F.lit(s.table) for s in self.segments)), self.number_column(key))
        return F.lit(self.segments[0].table)


def hash_layout(table: str, shard_key: str, backends: list[str], partitions: int | None = None, key_type: str = "bigint") -> Placement:
    """Slots dealt evenly to the backends in order, each backend's range cut into blocks; the last takes the rest."""
    if not table:
        raise PlacementError("no_table_name")
    if not shard_key:
        raise PlacementError("no_shard_key")
    if partitions is not None and partitions not in PARTITION_COUNTS:
        raise PlacementError("partition_count")
    if not backends:
        raise PlacementError("no_backends")
    if len(backends) >= SLOTS:
        raise PlacementError("many_backends", n=len(backends), most=SLOTS)
    width = SLOTS // partitions if partitions else BLOCKS
    names, segments = sorted(backends), []
    share = SLOTS // len(names)
    for n, backend in enumerate(names):
        low, end = n * share, SLOTS if n + 1 == len(names) else (n + 1) * share
        while low < end:
            # What is left after the last whole block is not worth a sub-table of its own.
            high = end if end - low < 2 * width else low + width
            segments.append(Segment(f"{table}_{len(segments):04d}", backend, low, high))
            low = high
    return Placement(HASH, shard_key, tuple(segments), key_type)


def list_layout(table: str, shard_key: str, values: dict[str, list[str]], key_type: str = "bigint") -> Placement:
    """One sub-table per list value, in the order of the sorted values; backend -> its values."""
    pairs = sorted({(str(v), b) for b, vs in values.items() for v in vs})
    if not pairs:
        raise PlacementError("no_list")
    if len({v for v, _ in pairs}) < len(pairs):
        raise PlacementError("list_twice")
    return Placement(LIST, shard_key, tuple(Segment(f"{table}_{i:04d}", b, value=v) for i, (v, b) in enumerate(pairs)), key_type)


def global_layout(table: str, backends: list[str]) -> Placement:
    return Placement(GLOBAL, None, tuple(Segment(table, b) for b in sorted(backends)))


def single_layout(table: str, backend: str) -> Placement:
    return Placement(SINGLE, None, (Segment(table, backend),))


def from_rows(rows: list[dict], table: str) -> Placement:
    """Placement of a table from rows of a shard map."""
    own = [r for r in rows if r["table_name"] == table]
    if not own:
        raise PlacementError(f"Table '{table}' doesn't exist (errno 1146) (sqlstate 42S02)")
    own.sort(key=lambda r: (r["slot_from"] is None, r["slot_from"] or 0, r["list_value"] if r["list_value"] is not None else 0, r["segment"]))
    segments = (Segment(r["segment"], r["backend"], r["slot_from"], r["slot_to"], None if r["list_value"] is None else str(r["list_value"])) for r in own)
    return Placement(own[0]["kind"], own[0]["shard_key"], tuple(segments))


def same_layout(a: Placement, b: Placement) -> bool:
    """Whether equal keys of both tables lie on the same backend, so that a join on the keys needs no shuffle."""
    if a.kind != b.kind or a.kind not in (HASH, LIST):
        return False
    return [(s.backend, s.low, s.high, s.value) for s in a.segments] == [(s.backend, s.low, s.high, s.value) for s in b.segments]


def with_shard(df: DataFrame, placement: Placement, numbered: bool = False) -> DataFrame:
    """Adds the segment of each row as column ``_shard``: its name, or its place in the layout."""
    column = placement.number_column if numbered else placement.shard_column
    return df.withColumn(SHARD, column(F.col(f"`{placement.shard_key}`")) if placement.shard_key else column(F.lit(None)))


def check_rows(df: DataFrame, placement: Placement, numbered: bool = False) -> DataFrame:
    """``with_shard`` that fails, while it runs, at the first row whose key has no segment."""
    placed = with_shard(df, placement, numbered)
    if placement.kind not in (HASH, LIST):
        return placed
    value = F.coalesce(F.col(f"`{placement.shard_key}`").cast("string"), F.lit("NULL"))
    text = F.concat(F.lit("Table has no partition for value "), value) if placement.kind == LIST else F.lit(str(PlacementError("shard_key_null", key=placement.shard_key)))
    return placed.withColumn(SHARD, F.when(F.col(SHARD).isNull(), F.raise_error(text)).otherwise(F.col(SHARD)))


def write_sharded(df: DataFrame, path: str, placement: Placement, mode: str = "errorifexists", numbered: bool = False) -> None:
    """Writes a table by shard.

    One shuffle brings a shard's rows together; adaptive execution cuts what is large into files of its advisory size,
    however large a shard is, and lets one task write what is small.
    """
    placed = check_rows(df, placement, numbered)
    placed.hint("rebalance", F.col(SHARD)).write.mode(mode).partitionBy(SHARD).parquet(path)


def read_pruned(df: DataFrame, placement: Placement, values: list[int | float | str]) -> DataFrame:
    """Rows with one of the key values from a table written by shard: only their shards' folders are read."""
    pruned = placement.prune(values)
    shards = [s.table for s in (placement.segments if pruned is None else pruned)]
    return df.where(F.col(SHARD).isin(shards) & F.col(placement.shard_key).isin(list(values)))
