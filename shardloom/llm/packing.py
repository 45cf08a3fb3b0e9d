"""Items of varying size in containers of fixed capacity (problem 8)."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import cut

#: Items packed together in one task.
GROUP_SIZE = 8192
#: Capacities for which items are packed at once.
MOST_KINDS = 1000


class Bins:
    """Free room of open bins in a tournament tree: each inner node holds the greatest room below it."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.count, self.leaves, self.room = capacity, 0, 1, [-1, -1]

    def place(self, size: int) -> int:
        """Number of the first bin with room for the item; a new one if there is none."""
        room = self.room
        if room[1] < size:
            at = self._open()
            room = self.room
        else:
            at = 1
            while at < self.leaves:
                at *= 2
                if room[at] < size:
                    at += 1
        number = at - self.leaves
        left = room[at] - size
        room[at] = left
        while at > 1:
            at //= 2
            best = max(room[2 * at], room[2 * at + 1])
            if room[at] == best:
                break
            room[at] = best
        return number

    def _open(self) -> int:
        if self.count == self.leaves:  # double the tree
            rooms = self.room[self.leaves :] + [-1] * self.leaves
            self.leaves *= 2
            self.room = [-1] * self.leaves + rooms
            for i in range(self.leaves - 1, 0, -1):
                self.room[i] = max(self.room[2 * i], self.room[2 * i + 1])
        at = self.leaves + self.count
        self.count += 1
        self.room[at] = self.capacity
        i = at // 2
        while i:
            self.room[i] = max(self.room[2 * i], self.room[2 * i + 1])
            i //= 2
        return at


def first_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each item, the items taken in the order given."""
    bins = Bins(capacity)
    return np.fromiter((bins.place(s) for s in sizes.tolist()), np.int64, len(sizes))


def pack(df: DataFrame, item: str, size: str, capacities: list[int], group_size: int = GROUP_SIZE) -> DataFrame:
    """(capacity, grp, bin, item, piece, pieces, size): the bin (grp, bin) of every item, for each capacity.

    Items are dealt at random into groups of about ``group_size``, each packed on its own by first-fit decreasing. An
    item larger than a container, and no other, is cut into pieces of the capacity and a rest. Nothing but the order
    of sizes, ids and pieces decides within a group, so equal sizes have a defined place.

    Items with a null id or size are left out; size 0 takes no room, in the first bin of its group. Repeated rows are
    items of their own, and dealt to different groups. An empty table gives no rows. Extra columns are not read.
    """
    if len(set(capacities)) > MOST_KINDS:
        raise ValueError(f"more than {MOST_KINDS} capacities")
    kind = df.schema[item].dataType.simpleString()
    items = cut(df.select(F.col(item).alias("item"), F.col(size).cast("bigint").alias("size")).where("item IS NOT NULL AND size >= 0"), "packing")
    groups = max(1, math.ceil(items.count() / group_size))
    # The place of a row in the written table is part of the hash, so that a repeated id does not fill one group.
    dealt = items.withColumn("grp", F.pmod(F.xxhash64("item", F.monotonically_increasing_id()), F.lit(groups)))
    pieces = dealt.select("*", F.explode(F.array(*map(F.lit, sorted(set(capacities))))).alias("capacity"))
    pieces = pieces.withColumn("pieces", F.greatest(F.lit(1), F.ceil(F.col("size") / F.col("capacity"))).cast("int"))
    pieces = pieces.select("capacity", "grp", "item", F.explode(F.expr("sequence(0, pieces - 1)")).alias("piece"), "pieces", F.col("size").alias("whole"))
    pieces = pieces.select("capacity", "grp", "item", "piece", "pieces", F.expr("least(CAST(capacity AS BIGINT), whole - piece * CAST(capacity AS BIGINT))").alias("size"))

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("size", "descending"), ("item", "ascending"), ("piece", "ascending")])
        bins = first_fit(group.column("size").to_numpy(), group.column("capacity")[0].as_py())
        return group.append_column("bin", pa.array(bins))

    schema = f"capacity int, grp bigint, item {kind}, piece int, pieces int, size bigint, bin bigint"
    packed = pieces.groupBy("capacity", "grp").applyInArrow(run, schema)
    return packed.select("capacity", "grp", "bin", F.col("item").alias(item), "piece", "pieces", F.col("size").alias(size))
