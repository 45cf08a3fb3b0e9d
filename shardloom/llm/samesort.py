"""Exact duplicates of a canonical form, found by range partition and external sort (problem 2)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import cut

#: Rows sampled per partition to place the bounds of the ranges, and at most.
SAMPLE_PER_PARTITION, SAMPLE_MOST = 200, 1_000_000

_KEYED = pa.schema([("h", pa.int64()), ("key", pa.string()), ("id", pa.int64())])


def _keyed(batch: pa.RecordBatch, canonical: Callable[[str], str]) -> pa.RecordBatch:
    """(h, key, id) of a batch of (id, text); equal spellings are worked out once."""
    spelled = batch.column("text").dictionary_encode()
    forms = [canonical(t) for t in spelled.dictionary.to_pylist()]
    hashes = np.array([xxhash.xxh64_intdigest(f.encode("utf-8", "surrogatepass")) for f in forms], np.uint64).view(np.int64)
    at = spelled.indices
    return pa.RecordBatch.from_arrays([pa.array(hashes).take(at), pa.array(forms, pa.string()).take(at), batch.column("id")], schema=_KEYED)


def _place(h: np.ndarray, ids: np.ndarray, bound_h: np.ndarray, bound_id: np.ndarray) -> np.ndarray:
    """Number of bounds below (h, id), the bounds sorted by hash and id."""
    low, high = np.searchsorted(bound_h, h, "left"), np.searchsorted(bound_h, h, "right")
    for at in np.unique(low[low < high]):  # keys so hot that they fill ranges of their own, each all at once
        rows = np.flatnonzero((low == at) & (high > at))
        low[rows] += np.searchsorted(bound_id[at : high[rows[0]]], ids[rows], "left")
    return low


def _bounds(rows: DataFrame, canonical: Callable[[str], str], partitions: int) -> tuple[np.ndarray, np.ndarray]:
    """Bounds that cut the canonical rows into even ranges of (hash, id), from a bounded sample of the rows."""
    total = rows.count()
    wanted = min(SAMPLE_MOST, SAMPLE_PER_PARTITION * partitions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _keyed(batch, canonical).select(["h", "id"])

    sample = rows.sample(min(1.0, wanted / max(total, 1)), seed=7).mapInArrow(run, "h bigint, id bigint").toArrow()
    h, ids = sample.column("h").to_numpy(), sample.column("id").to_numpy()
    order = np.lexsort((ids, h))
    at = order[(np.arange(1, partitions) * len(order)) // partitions] if len(order) else order
    return h[at], ids[at]


_SCANNED = pa.schema([("kept", pa.int64()), ("copy", pa.int64()), ("n", pa.int64()), ("h", pa.int64()), ("key", pa.string())])


def _some(rows: int, **columns: pa.Array) -> pa.RecordBatch:
    """A batch of the scan's result; columns not given are null."""
    return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(rows, f.type) for f in _SCANNED], schema=_SCANNED)


@dataclass
class _Run:
    """A run that may go on in the next batch: its hash and key, first and last id, and number of ids."""

    h: int
    key: str
    head: int
    last: int
    n: int

    def row(self, shown: bool) -> pa.RecordBatch:
        h = pa.array([int(self.h)]) if shown else pa.nulls(1, pa.int64())
        return _some(1, kept=pa.array([int(self.head)]), n=pa.array([int(self.n)]), h=h, key=pa.array([self.key], pa.string()))


def _scan(rows: DataFrame, pairs: bool, runs: bool) -> DataFrame:
    """Scans sorted partitions for runs of adjacent rows with equal full keys; an id counts once in a run.

    Gives, with ``pairs``, a row (kept, copy) for each further id of a run, and with ``runs`` a row (kept, n, key) for
    each run. What belongs to the first or last run of a partition may go on in the next one: such run rows are always
    given, and they and the pairs of the first run carry the hash.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run: _Run | None = None
        first = True
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, ids, hashes = batch.column("key"), batch.column("id").to_numpy(), batch.column("h").to_numpy()
            starts = np.ones(len(ids), bool)
            starts[1:] = pc.not_equal(keys.slice(1), keys.slice(0, len(ids) - 1)).to_numpy(zero_copy_only=False)
            goes_on = run is not None and keys[0].as_py() == run.key
            at = np.flatnonzero(starts)
            new = np.ones(len(ids), bool)  # whether an id is another one than that of the row before in its run
            new[1:] = starts[1:] | (ids[1:] != ids[:-1])
            new[0] = not goes_on or ids[0] != run.last
            number = np.cumsum(starts) - 1
            heads, counts = ids[at].copy(), np.bincount(number[new], minlength=len(at))
            if goes_on:
                heads[0] = run.head
                counts[0] += run.n
            elif run is not None and (runs or first):
                yield run.row(first)
            first = first and (run is None or goes_on)  # whether the first run of the batch is that of the partition
            if pairs:
                mine = np.flatnonzero(new & (ids != heads[number]))
                if len(mine):
                    shown = pa.array(hashes[mine], mask=~(first & (number[mine] == 0)))
                    yield _some(len(mine), kept=pa.array(heads[number[mine]]), copy=pa.array(ids[mine]), h=shown)
            done = len(at) - 1  # runs that end within the batch
            if done and (runs or first):
                upto = done if runs else 1
                shown = pa.array(hashes[at[:upto]], mask=np.array([not (first and k == 0) for k in range(upto)]))
                yield _some(upto, kept=pa.array(heads[:upto]), n=pa.array(counts[:upto]), h=shown, key=keys.take(pa.array(at[:upto])))
            first = first and not done
            run = _Run(hashes[at[-1]], keys[int(at[-1])].as_py(), heads[-1], ids[-1], counts[-1])
        if run is not None:
            yield run.row(True)

    return rows.mapInArrow(scan, "kept bigint, copy bigint, n bigint, h bigint, key string")


def _sorted(df: DataFrame, record_id: str, text: str, canonical: Callable[[str], str], partitions: int | None) -> DataFrame:
    """The canonical records (h, key, id), range-partitioned and sorted by hash, full key and id."""
    rows = df.select(F.col(record_id).cast("bigint").alias("id"), F.col(text).alias("text")).dropna()
    partitions = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bound_h, bound_id = _bounds(rows, canonical, partitions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keyed = _keyed(batch, canonical)
            place = _place(keyed.column("h").to_numpy(), keyed.column("id").to_numpy(), bound_h, bound_id)
            yield pa.RecordBatch.from_arrays([*keyed.columns, pa.array(place.astype(np.int32))], names=[*_KEYED.names, "place"])

    keyed = rows.mapInArrow(run, "h bigint, key string, id bigint, place int")
    return keyed.repartitionById(partitions, "place").drop("place").sortWithinPartitions("h", "key", "id")


def _heads(scanned: DataFrame) -> DataFrame:
    """(h, kept, head): for the runs at the ends of partitions, the smallest id of the whole run; two rows a partition."""
    ends = scanned.where("n IS NOT NULL AND h IS NOT NULL")
    whole = ends.groupBy("h", "key").agg(F.min("kept").alias("head"))
    return ends.join(whole, ["h", "key"]).where("kept <> head").select("h", "kept", "head").distinct()


def copies(df: DataFrame, record_id: str, text: str, canonical: Callable[[str], str], partitions: int | None = None) -> DataFrame:
    """(kept_id, copy_id): for each record whose canonical text another has too, the smallest id that has it.

    The canonical records are cut into even ranges of (hash, id), each is sorted by Spark's external sort by hash,
    full key and id, and adjacent runs are scanned, comparing full keys. A key may fill many ranges, so a hot one is
    spread; the runs at the ends of partitions are joined up afterwards, at most two a partition. Ids identify
    records: rows equal in id and text count once. Rows with a null id or text are left out; empty texts are copies of
    one another. An empty table gives no rows. Extra columns are not read.
    """
    scanned = cut(_scan(_sorted(df, record_id, text, canonical, partitions), pairs=True, runs=False), "samesort")
    heads = F.broadcast(_heads(scanned))  # at most two rows a partition
    pairs = scanned.where("copy IS NOT NULL").join(heads, ["h", "kept"], "left")
    pairs = pairs.select(F.coalesce("head", "kept").alias("kept_id"), F.col("copy").alias("copy_id"))
    return pairs.union(heads.select("head", "kept"))


def collapse(df: DataFrame, record_id: str, text: str, canonical: Callable[[str], str], partitions: int | None = None) -> DataFrame:
    """(kept_id, canonical, copies): one row per canonical text, with the smallest id and the exact number of ids.

    See :func:`copies` for the method and the cases.
    """
    scanned = cut(_scan(_sorted(df, record_id, text, canonical, partitions), pairs=False, runs=True), "samesort")
    ends = scanned.where("h IS NOT NULL").groupBy("h", "key").agg(F.min("kept").alias("kept"), F.sum("n").alias("n"))
    both = scanned.where("h IS NULL").select("kept", "key", "n").union(ends.select("kept", "key", "n"))
    return both.select(F.col("kept").alias("kept_id"), F.col("key").alias("canonical"), F.col("n").alias("copies"))
