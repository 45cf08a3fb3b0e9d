"""Distinct counts, unions and intersections of huge identifier sets (problem 1).

A set is held as ``m`` registers. The hash of an identifier picks one register and a uniform u in (0, 1); the
register keeps the maximum of 1 + floor(-log_b(u)) over its identifiers, so the base b tunes how finely it resolves.
Registers of partial sets merge by maximum, which makes results of days, partitions or files add up, in any order
and however often one identifier is seen. Only registers that are not empty are stored, so small sets stay small.

Errors. Under the Poisson model the registers are independent with P(K <= k) = exp(-n b**-k / m). The count is the
maximum-likelihood estimate of n; its relative standard error is :func:`standard_error`, and less for sets much
smaller than m. Union, intersection and Jaccard of two sets come from the joint likelihood of both sets' registers
over the three disjoint parts; their standard errors come from the Fisher information at the maximum.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.prefix import fresh


@dataclass(frozen=True)
class Registers:
    """m: number of registers, a power of two; b: base, above 1. Values fit in one byte for b >= 1.2."""

    m: int = 4096
    b: float = 1.2
    seed: int = 42

    def __post_init__(self) -> None:
        if self.m < 16 or self.m > 1 << 20 or self.m & (self.m - 1):
            raise ValueError("m must be a power of two from 16 to 2**20")
        if self.top > 255 or self.b <= 1:
            raise ValueError("b must be at least 1.2, for register values to fit in a byte")

    @property
    def top(self) -> int:
        """The greatest value a register takes."""
        return 1 + math.floor(53 * math.log(2) / math.log(self.b))


def standard_error(p: Registers) -> float:
    """Relative standard error of the count of a set much larger than m."""
    return math.sqrt(((p.b + 1) / (p.b - 1) * math.log(p.b) - 1) / p.m)


def register_of(item: Column, p: Registers) -> tuple[Column, Column]:
    """(register, value) of an identifier; two independent hashes, built-in expressions only."""
    pick = F.xxhash64(item, F.lit(p.seed))
    u = (F.shiftrightunsigned(F.xxhash64(pick, item, F.lit(p.seed + 1)), 11).cast("double") + 0.5) * 2.0**-53
    value = F.floor(-F.log(u) * (1 / math.log(p.b))) + 1
    return F.pmod(pick, F.lit(p.m)).cast("int"), F.least(value, F.lit(p.top)).cast("int")


def fill(df: DataFrame, keys: list[str], item: Column, p: Registers = Registers()) -> DataFrame:
    """The non-empty registers of the set of ``item`` per group: (keys, register, value).

    One aggregation with partial maxima before the shuffle, on group and register: a group of any size is spread over
    its registers and sends at most m rows from each task. Null items are in no set. Null keys are a group like any
    other. An empty table gives no rows.
    """
    reg, val = register_of(item, p)
    rows = df.where(item.isNotNull()).select(*keys, reg.alias("register"), val.alias("value"))
    return rows.groupBy(*keys, "register").agg(F.max("value").alias("value"))


def merge(registers: DataFrame, keys: list[str]) -> DataFrame:
    """Registers of unions: those of all partial results of the same (coarser) ``keys``, by maximum."""
    return registers.groupBy(*keys, "register").agg(F.max("value").alias("value"))


def pack(registers: DataFrame, keys: list[str]) -> DataFrame:
    """One row per set, to be stored: (keys, sketch), sketch an array of register * 256 + value, at most m long."""
    return registers.groupBy(*keys).agg(F.array_sort(F.collect_list(F.col("register") * 256 + F.col("value"))).alias("sketch"))


def unpack(packed: DataFrame, keys: list[str]) -> DataFrame:
    """The inverse of :func:`pack`."""
    rows = packed.select(*keys, F.explode("sketch").alias("_x"))
    return rows.select(*keys, F.shiftright("_x", 8).alias("register"), F.col("_x").bitwiseAND(255).alias("value"))


def counts_of(lengths: np.ndarray, values: np.ndarray, p: Registers) -> np.ndarray:
    """Maximum-likelihood counts of many sets at once; ``values`` holds their non-empty registers one after another."""
    out = np.zeros(len(lengths))
    some = lengths > 0
    if not some.any():
        return out
    n_of = lengths[some]
    first = np.concatenate([[0], np.cumsum(n_of)[:-1]])
    weight = p.b ** -values.astype(float)
    # Start from the harmonic estimate; bisect on log(n) where Newton's step leaves the bracket.
    empty = p.m - n_of
    sums = np.add.reduceat(weight, first)
    t = np.maximum(p.m * (1 - 1 / p.b) / (math.log(p.b) * (empty + sums)), 1e-12)  # n / m
    lo, hi = np.full(len(t), 1e-12), np.full(len(t), p.b ** (p.top + 2))
    gap = weight * (p.b - 1)  # b**-(k-1) - b**-k
    plain = values < p.top
    gap = np.where(plain, gap, p.b * weight)  # the top value stands for all above it
    linear = empty + np.add.reduceat(np.where(plain, weight, 0.0), first)
    for _ in range(60):
        x = np.minimum(np.repeat(t, n_of) * gap, 700)
        e = np.expm1(x)
        slope = np.add.reduceat(gap / e, first) - linear  # derivative of the log-likelihood in t
        curve = np.add.reduceat(gap**2 * (e + 1) / e**2, first)
        lo, hi = np.where(slope > 0, t, lo), np.where(slope > 0, hi, t)
        new = t + slope / curve
        new = np.where((new <= lo) | (new >= hi), np.sqrt(lo * hi), new)
        done = np.abs(new - t) <= 1e-9 * t
        t = new
        if done.all():
            break
    out[some] = t * p.m
    return out


def estimate(packed: DataFrame, keys: list[str], p: Registers = Registers(), output: str = "estimate") -> DataFrame:
    """(keys, estimate double, error double): the count of each packed set and its absolute standard error."""
    relative = standard_error(p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("sketch")
            lengths = np.diff(lists.offsets.to_numpy()).astype(np.int64)
            values = lists.flatten().to_numpy(zero_copy_only=False) & 255
            n = counts_of(lengths, values, p)
            columns = [batch.column(k) for k in keys]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n), pa.array(n * relative)], names=[*keys, output, f"{output}_error"])

    schema = ", ".join(f"`{k}` {packed.schema[k].dataType.simpleString()}" for k in keys) + f", `{output}` double, `{output}_error` double"
    return packed.select(*keys, "sketch").mapInArrow(run, schema)


def _less(parts: np.ndarray, k: np.ndarray, q: np.ndarray, p: Registers) -> np.ndarray:
    """P(first register <= k, second <= q) for the sizes (first only, second only, both); nothing is below 0."""
    steps = np.append(p.b ** -np.arange(p.top, dtype=float), 0.0)  # the top value is certain
    sk, sq = steps[np.maximum(k, 0)], steps[np.maximum(q, 0)]
    a, c, both = parts / p.m
    return np.where((k >= 0) & (q >= 0), np.exp(-(a * sk + c * sq + both * np.maximum(sk, sq))), 0.0)


def _probability(parts: np.ndarray, i: np.ndarray, j: np.ndarray, p: Registers) -> np.ndarray:
    return _less(parts, i, j, p) - _less(parts, i - 1, j, p) - _less(parts, i, j - 1, p) + _less(parts, i - 1, j - 1, p)


def _covariance(parts: np.ndarray, p: Registers) -> np.ndarray:
    """Inverse of the expected Fisher information of the three sizes; also at the border, where one is near 0."""
    i, j = (x.ravel() for x in np.indices((p.top + 1, p.top + 1)))
    base = _probability(parts, i, j, p)
    step = 1e-3 * math.sqrt(max(parts.sum(), 1.0)) + 1e-4 * parts
    slope = np.array([(_probability(parts + h * np.eye(3)[k], i, j, p) - base) / h for k, h in enumerate(step)])
    info = p.m * (slope / np.maximum(base, 1e-12)) @ slope.T
    scale = np.sqrt(np.diag(info))
    return np.linalg.pinv(info / np.outer(scale, scale), rcond=1e-9) / np.outer(scale, scale)


def joint(x: np.ndarray, y: np.ndarray, p: Registers = Registers()) -> dict[str, float]:
    """Union, intersection and Jaccard of two sets from their full register arrays (0: empty), with standard errors.

    Maximises the joint likelihood over the logarithms of the sizes of the three disjoint parts by damped Newton
    steps. Two empty sets have union, intersection and Jaccard 0.
    """
    sizes = [float(counts_of(np.array([int((v > 0).sum())]), v[v > 0], p)[0]) for v in (x, y, np.maximum(x, y))]
    if sizes[2] == 0:
        return dict.fromkeys(("union", "intersection", "jaccard", "union_error", "intersection_error", "jaccard_error"), 0.0)
    cells, n = np.unique(x.astype(np.int64) * 256 + y, return_counts=True)
    i, j = cells // 256, cells % 256
    both = max(sizes[0] + sizes[1] - sizes[2], 0.01 * min(sizes[0], sizes[1]), 1e-3)
    theta = np.log(np.array([max(sizes[0] - both, 1e-2), max(sizes[1] - both, 1e-2), both]))

    def f(t: np.ndarray) -> float:
        return float(n @ np.log(np.maximum(_probability(np.exp(t), i, j, p), 1e-300)))

    def derivatives(t: np.ndarray, h: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
        e = np.eye(3) * h
        base = f(t)
        up, down = [f(t + e[k]) for k in range(3)], [f(t - e[k]) for k in range(3)]
        g = (np.array(up) - np.array(down)) / (2 * h)
        hess = np.diag([(up[k] - 2 * base + down[k]) / h**2 for k in range(3)])
        for k, q in ((0, 1), (0, 2), (1, 2)):
            hess[k, q] = hess[q, k] = (f(t + e[k] + e[q]) - up[k] - up[q] + 2 * base - down[k] - down[q] + f(t - e[k] - e[q])) / (2 * h**2)
        return g, hess

    best = f(theta)
    damping = 1.0
    for _ in range(80):
        g, hess = derivatives(theta)
        for _ in range(12):
            step = np.clip(np.linalg.solve(-hess + (damping + max(0.0, float(np.linalg.eigvalsh(hess)[-1]))) * np.eye(3), g), -2, 2)
            trial = np.maximum(theta + step, math.log(1e-6))
            value = f(trial)
            if value >= best:
                damping = max(damping / 8, 1e-9)
                break
            damping *= 8
        else:
            break
        moved = float(np.abs(trial - theta).max())
        theta, best = trial, value
        if moved < 1e-7:
            break
    parts = np.exp(theta)
    union, inter = float(parts.sum()), float(parts[2])
    cov = _covariance(parts, p)

    def error(gradient: list[float]) -> float:
        v = np.array(gradient)
        return float(math.sqrt(max(v @ cov @ v, 0.0)))

    jac = inter / union
    return {
        "union": union, "intersection": inter, "jaccard": jac,
        "union_error": error([1, 1, 1]), "intersection_error": error([0, 0, 1]),
        "jaccard_error": error([-jac / union, -jac / union, (1 - jac) / union]),
    }


def compare(pairs: DataFrame, keys: list[str], left: str, right: str, p: Registers = Registers()) -> DataFrame:
    """(keys, union, intersection, jaccard, *_error) of the packed sets in columns ``left`` and ``right`` of each row.

    A null sketch is the empty set.
    """
    names = ["union", "intersection", "jaccard", "union_error", "intersection_error", "jaccard_error"]
    l, r = fresh(keys, "left_", "right_")

    def dense(packed: list[int] | None) -> np.ndarray:
        out = np.zeros(p.m, dtype=np.int64)
        if packed is not None and len(packed):
            v = np.asarray(packed, dtype=np.int64)
            out[v >> 8] = v & 255
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [joint(dense(a), dense(b), p) for a, b in zip(batch.column(l).to_pylist(), batch.column(r).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *(pa.array([x[n] for x in found], pa.float64()) for n in names)], names=[*keys, *names])

    schema = ", ".join(f"`{k}` {pairs.schema[k].dataType.simpleString()}" for k in keys) + "".join(f", {n} double" for n in names)
    # A pair takes more time than room, so that rows few enough for one task are still dealt to all cores.
    dealt = pairs.select(*keys, F.col(left).alias(l), F.col(right).alias(r)).repartition(pairs.sparkSession.sparkContext.defaultParallelism)
    return dealt.mapInArrow(run, schema)
