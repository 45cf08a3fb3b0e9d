"""Hash slots of shard keys: jump consistent hashing (Lamping and Veach, 2014)."""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

SLOTS = 4096
# Fixed value: multiplier of the generator in the paper.
MULTIPLIER = 2862933555777941757
# Fixed value: reflected CRC-64 polynomial of ECMA-182.
POLYNOMIAL = 0xC96C5795D7870F42


def jump(keys: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """Slots of unsigned 64-bit keys."""
    state = keys.astype(np.uint64, copy=True)
    slot, ahead = np.zeros(len(state), np.int64), np.zeros(len(state), np.int64)
    open_ = np.arange(len(state))
    while len(open_):
        slot[open_] = ahead[open_]
        with np.errstate(over="ignore"):
            state[open_] = state[open_] * np.uint64(MULTIPLIER) + np.uint64(1)
        scale = float(1 << 31) / ((state[open_] >> np.uint64(33)).astype(np.float64) + 1)
        ahead[open_] = ((slot[open_] + 1) * scale).astype(np.int64)
        open_ = open_[ahead[open_] < slots]
    return slot


def _crc_table() -> list[int]:
    table = []
    for byte in range(256):
        for _ in range(8):
            byte = (byte >> 1) ^ (POLYNOMIAL if byte & 1 else 0)
        table.append(byte)
    return table


_TABLE = _crc_table()


def crc64(data: bytes) -> int:
    """CRC-64 of a string key, with inverted start and end."""
    crc = 0xFFFFFFFFFFFFFFFF
    for b in data:
        crc = _TABLE[(crc ^ b) & 0xFF] ^ (crc >> 8)
    return crc ^ 0xFFFFFFFFFFFFFFFF


def slot_of(value: int | float | str, slots: int = SLOTS) -> int:
    """Slot of one literal: floats are truncated, negative numbers wrap, strings go through CRC-64."""
    if isinstance(value, bool) or not isinstance(value, int | float | str):
        raise TypeError(f"a value of type {type(value).__name__} cannot be hashed to a slot")
    key = crc64(value.encode()) if isinstance(value, str) else int(value) % 2**64
    return int(jump(np.array([key], np.uint64), slots)[0])


_TABLE_ARRAY = np.array(_TABLE, np.uint64)


def crc64_all(keys: pa.Array) -> np.ndarray:
    """CRC-64 of many string keys at once; 0 for a null.

    Keys are sorted by length, so that those with a byte at a place are the first ones; each step takes one place of
    all of them through the table. Work grows with the bytes of the keys, not with the longest.
    """
    keys = keys.cast(pa.large_binary())
    out = np.zeros(len(keys), np.uint64)
    if not len(keys):
        return out
    data = np.frombuffer(keys.buffers()[2] or b"", np.uint8)
    offsets = np.frombuffer(keys.buffers()[1], np.int64)[keys.offset : keys.offset + len(keys) + 1]
    lengths = np.diff(offsets)
    order = np.argsort(-lengths, kind="stable")
    begin = offsets[:-1][order]
    crc = np.full(len(keys), 0xFFFFFFFFFFFFFFFF, np.uint64)
    longer = np.searchsorted(-lengths[order], -np.arange(int(lengths.max(initial=0))), "left")  # rows with a byte at each place
    for place, n in enumerate(longer.tolist()):
        byte = data[begin[:n] + place]
        crc[:n] = _TABLE_ARRAY[(crc[:n] ^ byte) & np.uint64(0xFF)] ^ (crc[:n] >> np.uint64(8))
    out[order] = crc ^ np.uint64(0xFFFFFFFFFFFFFFFF)
    if keys.null_count:
        out[keys.is_null().to_numpy(zero_copy_only=False)] = 0
    return out


def key_kind(spark_type: str) -> str:
    """How a key of a Spark type is hashed: as a number, or as its text."""
    return "number" if spark_type.split("(")[0] in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal") else "string"


def _as_key(column: Column, kind: str) -> Column:
    """Text, or a signed 64-bit number; unsigned ones beyond it keep their bits."""
    if key_kind(kind) == "string":
        return column.cast("string")
    if kind.startswith("decimal"):
        whole = column.cast("decimal(38,0)")
        return F.when(whole >= F.lit(Decimal(1 << 63)), whole - F.lit(Decimal(1 << 64))).otherwise(whole).cast("bigint")
    return column.cast("bigint")


def _hashed(kind: str, slots: int, after):
    """An Arrow UDF from key values to ``after`` of their slots; null for a null key."""
    text = key_kind(kind) == "string"

    def run(keys: pa.Array) -> pa.Array:
        if isinstance(keys, pa.ChunkedArray):
            keys = keys.combine_chunks()
        values = crc64_all(keys) if text else keys.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        nulls = keys.is_null().to_numpy(zero_copy_only=False) if keys.null_count else None
        return pa.array(after(jump(values, slots)).astype(np.int32), pa.int32(), mask=nulls)

    run.__annotations__ = {"keys": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "int")


def slot(column: Column, kind: str = "bigint", slots: int = SLOTS) -> Column:
    """Slot of a key column (``kind``: its Spark type); null for a null key. Arrow batches, vectorised."""
    return _hashed(kind, slots, lambda at: at)(_as_key(column, kind))


def range_of(column: Column, lows: list[int], kind: str = "bigint", slots: int = SLOTS) -> Column:
    """Number, from 1, of the slot range a key falls in; ``lows``: the first slot of each, ascending."""
    bounds = np.array(lows)
    return _hashed(kind, slots, lambda at: np.searchsorted(bounds, at, "right"))(_as_key(column, kind))
