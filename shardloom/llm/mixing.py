"""Records of several sources in target shares of the total size (problem 9)."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..lineage import cut
from ..operators.prefix import running_sums

#: Greatest size of a block, the unit in which sources are scheduled.
BLOCK = 512
#: Blocks are made smaller until the source of the least share has so many slots.
LEAST_SLOTS = 8
#: Rows whose running sum is taken in one task.
ROWS_PER_BUCKET = 16384
GOLDEN = (math.sqrt(5) - 1) / 2
#: Sources the schedule can tell apart; what is known of each is sent to all tasks.
MOST_SOURCES = 1000
#: Parts of the unit interval by which a point finds its source.
CELLS = 4096
#: Different record sizes per source that are looked at together when the end of a quota is filled.
SIZES = 1024


@dataclass(frozen=True)
class Target:
    """A source, its share of the total size, and how often a record of it may be used."""

    source: str
    share: float
    max_repeats: int


def reachable_total(available: dict[str, int], targets: list[Target], mean: dict[str, float] | None = None) -> float:
    """The greatest total size at which no source must repeat more than it may.

    With ``mean``, the mean record size of each source: sources so scarce that, at the total they allow, the share of
    some source is less than one mean record of it do not count, as the shares cannot be met with so few records.
    """
    usable = [t for t in targets if t.share > 0 and available.get(t.source)]
    limits = sorted(t.max_repeats * available[t.source] / t.share for t in usable)
    least = max((mean[t.source] / t.share for t in usable), default=0.0) if mean else 0.0
    return next((n for n in limits if n >= least), 0.0)


def _schedule(spark: SparkSession, used: list[Target], slots: int) -> DataFrame:
    """(slot, source, rank): slot i goes to the source within whose cumulative share the point frac((i + 1) * golden ratio) lies."""
    cells, upper = [], 0.0
    for n, t in enumerate(used):
        lower, upper = upper, 2.0 if n + 1 == len(used) else upper + t.share
        cells += [(c, t.source, lower, upper) for c in range(int(lower * CELLS), min(CELLS - 1, int(upper * CELLS)) + 1)]
    where = spark.createDataFrame(cells, "cell bigint, source string, lower double, upper double")  # at most CELLS and two a source
    points = spark.range(slots).select(F.col("id").alias("slot"), F.expr(f"(id + 1) * {GOLDEN!r}D % 1").alias("u")).withColumn("cell", F.floor(F.col("u") * CELLS))
    chosen = points.join(F.broadcast(where), "cell").where("lower <= u AND u < upper")
    chosen = chosen.select("slot", "source", F.expr(f"slot div {ROWS_PER_BUCKET}").alias("b"), F.lit(1).alias("one"))
    return running_sums(chosen, ["source"], "b", ["slot"], {"rank": "one"}).select("slot", "source", (F.col("rank") - 1).alias("rank"))


def _table(spark: SparkSession, **columns: dict[str, int]) -> DataFrame:
    """One row a source, to be sent to all tasks."""
    names = list(columns)
    sources = columns[names[0]]
    rows = [(s, *(columns[n][s] for n in names)) for s in sources]
    return F.broadcast(spark.createDataFrame(rows, "source string, " + ", ".join(f"{n} bigint" for n in names)))


Taken = dict[tuple[str, int], int]


class _Sizes:
    """Sizes of the records of each source and how many have them, fetched around a limit, SIZES of them on either side.

    ``counts``: (source, size, out, n), of which ``out`` counts the records the last pass leaves out.
    """

    def __init__(self, counts: DataFrame, limits: dict[str, int]) -> None:
        self.counts, self.known = counts, {s: {} for s in limits}
        self.low, self.high = dict(limits), dict(limits)  # all sizes in between are known
        self.fetch(limits)

    def fetch(self, limits: dict[str, int]) -> None:
        """One query; what was known stays known, as the limits are at its ends."""
        limits = {s: g for s, g in limits.items() if s in self.known}
        if not limits:
            return
        near = self.counts.join(_table(self.counts.sparkSession, limit=limits), "source").withColumn("over", F.expr("size > limit"))
        order = Window.partitionBy("source", "over").orderBy(F.abs(F.col("size") - F.col("limit")))
        rows = near.withColumn("k", F.row_number().over(order)).where(F.col("k") <= SIZES).collect()
        for s in limits:
            mine = sorted((r["over"], r["size"], r["out"], r["n"]) for r in rows if r["source"] == s)
            self.known[s] |= {size: (out, n) for _, size, out, n in mine}
            below, above = [r[1] for r in mine if not r[0]], [r[1] for r in mine if r[0]]
            self.low[s] = min(self.low[s], below[0] if len(below) == SIZES else 0)
            self.high[s] = max(self.high[s], above[-1] if len(above) == SIZES else 1 << 62)

    def fill(self, gaps: dict[str, int], k: int) -> Taken:
        """How many records of which size to put into the gap of each source, which shrinks by them; ``k``: 0 for those left out, 1 for all.

        The greatest that fit are taken first, so that each size at least halves what is missing; then no record fits.
        """
        taken: Taken = {}
        limits = {s: g for s, g in gaps.items() if g > 0}
        while limits:
            for s in list(limits):
                for size in sorted((z for z in self.known[s] if z <= limits[s]), reverse=True):
                    c = min(self.known[s][size][k], gaps[s] // size)
                    if c:
                        taken[(s, size)], gaps[s] = c, gaps[s] - c * size
                if self.low[s] <= 1 or not gaps[s]:
                    del limits[s]
                else:
                    limits[s] = min(gaps[s], self.low[s] - 1)
            self.fetch(limits)
        return taken

    def above(self, s: str, gap: int, k: int, taken: Taken) -> int | None:
        """The smallest size above a gap of which a record is left."""
        while True:
            size = next((z for z in sorted(self.known[s]) if z > gap and self.known[s][z][k] > taken.get((s, z), 0)), None)
            if size is not None or self.high[s] >= 1 << 62:
                return size
            self.fetch({s: self.high[s]})


def _fills(records: DataFrame, gaps: dict[str, int], repeats: dict[str, int]) -> list[Taken]:
    """What to put into the gaps: of the records the last pass leaves out, then of all in up to ``repeats`` passes more.

    Where a last record would overshoot by less than what is missing, it is taken, too.
    """
    if not any(g > 0 for g in gaps.values()):
        return []
    counts = records.groupBy("source", "size").agg(F.count_if("out").alias("out"), F.count(F.lit(1)).alias("n"))
    sizes = _Sizes(counts, {s: g for s, g in gaps.items() if g > 0})
    fills = [sizes.fill(gaps, 0)]
    while True:
        mine = {s: g for s, g in gaps.items() if g > 0 and repeats[s] >= len(fills)}
        more = sizes.fill(mine, 1) if mine else {}
        if not more:
            break
        fills.append(more)
        gaps |= mine
    for s, gap in gaps.items():
        if gap > 0:
            # In a further pass all records are there again, but for what it has taken already.
            for step, k in ((0, 0), (1, 1)) if repeats[s] >= 1 else ((0, 0),):
                while len(fills) <= step:
                    fills.append({})
                size = sizes.above(s, gap, k, fills[step])
                if size is not None and size < 2 * gap:
                    fills[step][(s, size)] = fills[step].get((s, size), 0) + 1
                    break
    return fills


def _drawn(records: DataFrame, fill: Taken, begun: dict[str, int], step: int) -> DataFrame:
    """The first records of each wanted size, placed behind what the source has given before."""
    wanted = records.sparkSession.createDataFrame([(s, z, n) for (s, z), n in fill.items()], "source string, size bigint, wanted bigint")
    alike = Window.partitionBy("source", "size").orderBy("h", "id")
    found = records.join(F.broadcast(wanted), ["source", "size"])  # one row a size taken, at most SIZES a round and source
    found = found.withColumn("k", F.row_number().over(alike)).where(F.col("k") <= max(fill.values())).where("k <= wanted")
    # All that fills a gap together is no larger than one record.
    upto = F.sum("size").over(Window.partitionBy("source").orderBy("h", "id").rowsBetween(Window.unboundedPreceding, 0))
    ended = found.withColumn("upto", upto).join(_table(records.sparkSession, begun=begun), "source")
    return ended.selectExpr("source", "id", "size", f"passes + {step} AS pass", "passes * held + begun + upto - size div 2 AS at")


def mix(df: DataFrame, record_id: str, source: str, size: str, targets: list[Target], total: float | None = None, block: int = BLOCK, seed: int = 1) -> DataFrame:
    """(slot, source, pass, record_id, size): the records of the mix, to be read in the order of ``slot``.

    Slot i of the schedule goes to the source within whose cumulative share the point frac((i + 1) * golden ratio)
    lies; these points are spread so evenly that any stretch of slots is close to the shares. The records of each
    source are shuffled and cut into blocks of equal size, and the r-th slot of a source takes its r-th block; a record
    lies in the block of its middle and so takes the room of as many slots as it has tokens. After the last record the
    source starts over, at most ``max_repeats`` times.

    Each source has a quota, its share of ``total``. Of the pass in which the quota ends, the shuffled records before
    its end are taken; what is then missing is filled with others that fit, first with those the pass leaves out, then
    with any that may be repeated, see :func:`_fills`. So each source's size differs from its quota by at most half of
    the smallest record the last pass leaves out, or, if it leaves out none, half of the record taken last.

    ``total`` defaults to the greatest size at which every source reaches its share, apart from sources that are too
    scarce for that (see :func:`reachable_total`): these run out, as some do if a greater total is asked, and leave
    their slots empty. Blocks have ``block`` at most, and less where the source of the least share would get fewer than
    LEAST_SLOTS slots.

    Sources without a target, records with a null id or source, and of size null or 0 are left out. A source without
    records gets no slots; the others keep their proportions. Repeated rows are records of their own. An empty table
    gives no rows. Extra columns are not read. Running sums are spread over tasks by ranges of the shuffled order, so
    a source that holds most of the records is no bottleneck.
    """
    spark = df.sparkSession
    if len(targets) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    kind = df.schema[record_id].dataType.simpleString()
    rows = df.select(F.col(record_id).alias("id"), F.col(source).alias("source"), F.col(size).cast("bigint").alias("size"))
    rows = cut(rows.where((F.col("size") > 0) & F.col("id").isNotNull() & F.col("source").isin([t.source for t in targets])), "mixing")
    sums = {r["source"]: (r["n"], r["size"]) for r in rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")).collect()}
    available = {s: held for s, (_, held) in sums.items()}
    used = [t for t in targets if available.get(t.source) and t.share > 0 and t.max_repeats > 0]
    whole = sum(t.share for t in used)
    used = [replace(t, share=t.share / whole) for t in used]
    total = reachable_total(available, used, {s: held / n for s, (n, held) in sums.items()}) if total is None else total
    block = max(1, min(block, int(total * min((t.share for t in used), default=0.0) / LEAST_SLOTS)))
    slots = int(total // block)
    if not used or not slots:
        return spark.createDataFrame([], f"slot bigint, source string, pass int, `{record_id}` {kind}, `{size}` bigint")
    schedule = _schedule(spark, used, slots)
    last = dict.fromkeys((t.source for t in used), 0) | {r["source"]: r["count"] - 1 for r in schedule.groupBy("source").count().collect()}  # one row a target
    quota = {t.source: min(round(t.share * total), t.max_repeats * available[t.source]) for t in used}
    passes, rest = {s: q // available[s] for s, q in quota.items()}, {s: q % available[s] for s, q in quota.items()}

    bits = max(0, min(62, math.ceil(math.log2(max(1, sum(n for n, _ in sums.values()) / ROWS_PER_BUCKET)))))
    place = F.xxhash64("id", F.monotonically_increasing_id(), F.lit(seed))  # the row's place in the written table
    shuffled = rows.withColumn("h", F.shiftrightunsigned(place, 1)).withColumn("b", F.shiftright("h", 63 - bits))
    known = {"passes": passes, "rest": rest, "held": {s: available[s] for s in quota}}
    cumulated = cut(running_sums(shuffled, ["source"], "b", ["h", "id"], {"upto": "size"}).select("source", "id", "size", "h", "upto"), "mixing").join(_table(spark, **known), "source")
    taken = {r["source"]: r["upto"] or 0 for r in cumulated.groupBy("source").agg(F.max(F.expr("CASE WHEN upto <= rest THEN upto END")).alias("upto")).collect()}
    fills = _fills(cumulated.select("source", "size", F.expr("upto > rest").alias("out")), {s: r - taken.get(s, 0) for s, r in rest.items()}, {t.source: t.max_repeats - 1 - passes[t.source] for t in used})

    runs = F.expr("sequence(0L, passes - IF(upto <= rest, 0L, 1L))")
    drawn = cumulated.where("passes > 0 OR upto <= rest").select("source", "id", "size", F.explode(runs).alias("pass"), "held", "upto").selectExpr("source", "id", "size", "pass", "pass * held + upto - size div 2 AS at")
    begun = {s: taken.get(s, 0) for s in quota}
    for step, fill in enumerate(fills):
        if fill:
            drawn = drawn.union(_drawn(cumulated.where("upto > rest") if step == 0 else cumulated, fill, begun, step))
            for (s, z), n in fill.items():
                begun[s] += n * z
    placed = drawn.join(_table(spark, last=last), "source").withColumn("rank", F.expr(f"least(at div {block}, last)"))
    mixed = schedule.join(placed, ["source", "rank"])
    return mixed.select("slot", "source", F.col("pass").cast("int").alias("pass"), F.col("id").alias(record_id), F.col("size").alias(size))


def shares(mixed: DataFrame, size: str, targets: list[Target]) -> DataFrame:
    """(source, target_share, actual_share, size, uses, most_uses): what each target's source contributes to a mix."""
    spark = mixed.sparkSession
    wanted = spark.createDataFrame([(t.source, t.share) for t in targets], "source string, target_share double")
    got = mixed.groupBy("source").agg(F.sum(size).alias("size"), F.count(F.lit(1)).alias("uses"), (F.max("pass") + 1).alias("most_uses"))
    got = got.withColumn("actual_share", F.col("size") / F.sum("size").over(Window.partitionBy()))  # one row a target
    joined = wanted.join(F.broadcast(got), "source", "left")
    return joined.select("source", "target_share", *(F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("actual_share", "size", "uses", "most_uses")))
