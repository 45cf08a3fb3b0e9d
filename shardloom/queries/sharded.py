"""Placement, data changes, change capture, metadata and the MySQL dialect over the supplied tables."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..engine import Engine
from ..functions.slots import MULTIPLIER, SLOTS, slot
from ..lineage import scratch_path
from ..operators import aggregates, dml
from ..plans import placement as P
from ..session import read_table
from ..streaming import cdc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of (spark, directory) under its name, with its SQL twin."""

    def add(make: Callable[[SparkSession, str], DataFrame]):
        QUERIES[make.__name__] = make
        if sql:
            SQL[make.__name__] = sql
        return make

    return add


def placement_of(spark: SparkSession, d: str, table: str) -> P.Placement:
    """Placement of a table from the shard map, which has one row per sub-table."""
    rows = read_table(spark, d, "shard_map").where(F.col("table_name") == table).collect()
    return P.from_rows([r.asDict() for r in rows], table)


# ---- placement -----------------------------------------------------------------------------------------------------

#: Jump consistent hashing as a recursive query.
JUMP = f"""WITH RECURSIVE steps AS (
        SELECT DISTINCT CAST(id AS HUGEINT) AS id, CAST(id AS HUGEINT) AS key, CAST(-1 AS BIGINT) AS slot, CAST(0 AS BIGINT) AS ahead FROM {{}} WHERE id IS NOT NULL
        UNION ALL
        SELECT id, (key * {MULTIPLIER} + 1) % 18446744073709551616, ahead,
            CAST(floor((ahead + 1) * (2147483648.0::DOUBLE / (CAST(((key * {MULTIPLIER} + 1) % 18446744073709551616) // 8589934592 AS DOUBLE) + 1))) AS BIGINT)
        FROM steps WHERE ahead < {SLOTS}),
    slots AS (SELECT CAST(id AS BIGINT) AS id, max(slot) AS slot FROM steps GROUP BY id)
"""


@query(JUMP.format("mock_a") + "SELECT id, CAST(slot AS INTEGER) AS slot FROM slots")
def shard_slots(spark, d):
    return read_table(spark, d, "mock_a").select(F.col("id").cast("long").alias("id")).where("id IS NOT NULL").distinct().select("id", slot(F.col("id")).alias("slot"))


@query(
    JUMP.format("mock_a")
    + """SELECT segment, backend, count(*) AS n FROM mock_a JOIN slots USING (id)
    JOIN shard_map ON table_name = 'mock_a' AND slot >= slot_from AND slot < slot_to GROUP BY segment, backend"""
)
def shard_rows(spark, d):
    placed = placement_of(spark, d, "mock_a")
    where = spark.createDataFrame([(s.table, s.backend) for s in placed.segments], "segment string, backend string")
    rows = P.with_shard(read_table(spark, d, "mock_a").where("id IS NOT NULL"), placed).groupBy(F.col(P.SHARD).alias("segment")).agg(F.count(F.lit(1)).alias("n"))
    return rows.join(F.broadcast(where), "segment")  # one row a segment


def _written(spark: SparkSession, d: str, table: str) -> tuple[DataFrame, P.Placement]:
    placed, path = placement_of(spark, d, table), scratch_path(spark, f"sharded-{table}")
    P.write_sharded(read_table(spark, d, table), path, placed)
    return spark.read.parquet(path), placed


@query("SELECT id, k, c FROM benchyou0 WHERE id = 77")
def shard_prune_eq(spark, d):
    rows, placed = _written(spark, d, "benchyou0")
    return P.read_pruned(rows, placed, [77]).select("id", "k", "c")


@query("SELECT id, k, c FROM benchyou0 WHERE id IN (1, 50, 99, 120)")
def shard_prune_in(spark, d):
    rows, placed = _written(spark, d, "benchyou0")
    return P.read_pruned(rows, placed, [1, 50, 99, 120]).select("id", "k", "c")


@query("SELECT segment, count(*) AS n, CAST(sum(c2) AS BIGINT) AS total FROM t_list JOIN shard_map ON table_name = 't_list' AND list_value = c1 GROUP BY segment")
def list_rows(spark, d):
    placed = P.with_shard(read_table(spark, d, "t_list"), placement_of(spark, d, "t_list"))
    return placed.where(F.col(P.SHARD).isNotNull()).groupBy(F.col(P.SHARD).alias("segment")).agg(F.count(F.lit(1)).alias("n"), F.sum("c2").alias("total"))


@query("SELECT c1, c2 FROM t_list WHERE c1 IN (3, 8)")
def list_prune(spark, d):
    placed, path = placement_of(spark, d, "t_list"), scratch_path(spark, "sharded-t_list")
    rows = P.with_shard(read_table(spark, d, "t_list"), placed).where(F.col(P.SHARD).isNotNull()).drop(P.SHARD)
    P.write_sharded(rows, path, placed)
    return P.read_pruned(spark.read.parquet(path), placed, [3, 8]).select("c1", "c2")


@query("SELECT c1, count(*) AS n FROM t_list WHERE c1 IS NULL OR c1 NOT IN (SELECT list_value FROM shard_map WHERE table_name = 't_list') GROUP BY c1")
def list_refused(spark, d):
    placed = P.with_shard(read_table(spark, d, "t_list"), placement_of(spark, d, "t_list"))
    return placed.where(F.col(P.SHARD).isNull()).groupBy("c1").agg(F.count(F.lit(1)).alias("n"))


# ---- data changes --------------------------------------------------------------------------------------------------


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL VALUES (25, 'ATLANTIS', 1), (26, 'LEMURIA', NULL)")
def dml_insert(spark, d):
    rows = spark.createDataFrame([(25, "ATLANTIS", 1), (26, "LEMURIA", None)], "n_nationkey int, n_name string, n_regionkey int")
    return dml.insert(read_table(spark, d, "nation"), rows)


@query("SELECT * FROM nation UNION ALL SELECT r_regionkey + 100, r_name, r_regionkey FROM region")
def dml_insert_select(spark, d):
    rows = read_table(spark, d, "region").select((F.col("r_regionkey") + 100).alias("n_nationkey"), F.col("r_name").alias("n_name"), F.col("r_regionkey").alias("n_regionkey"))
    return dml.insert(read_table(spark, d, "nation"), rows)


@query(
    """SELECT coalesce(s.s_suppkey, n.k) AS s_suppkey, coalesce(s.s_name, n.name) AS s_name, s.s_nationkey,
    CASE WHEN s.s_suppkey IS NULL THEN n.bal WHEN n.k IS NULL THEN s.s_acctbal ELSE s.s_acctbal + n.bal END AS s_acctbal
    FROM supplier s FULL JOIN (SELECT s_suppkey * 2 AS k, 'new' AS name, 10.5 AS bal FROM supplier) n ON s.s_suppkey = n.k"""
)
def dml_upsert(spark, d):
    table = read_table(spark, d, "supplier")
    rows = table.select((F.col("s_suppkey") * 2).alias("s_suppkey"), F.lit("new").alias("s_name"), F.lit(10.5).alias("s_acctbal"))
    return dml.upsert(table, rows, ["s_suppkey"], {"s_acctbal": F.col("t.s_acctbal") + F.col("n.s_acctbal")})


@query(
    """SELECT * FROM supplier WHERE s_suppkey % 3 <> 0 UNION ALL
    SELECT s_suppkey, 'last', s_nationkey, s_acctbal + 2 FROM supplier WHERE s_suppkey % 3 = 0"""
)
def dml_replace(spark, d):
    table = read_table(spark, d, "supplier")
    hit = table.where("s_suppkey % 3 = 0")
    first, last = (hit.withColumn("s_name", F.lit(n)).withColumn("s_acctbal", F.col("s_acctbal") + k).withColumn("seq", F.lit(k)) for k, n in ((1, "first"), (2, "last")))
    return dml.replace(table, first.union(last), ["s_suppkey"], "seq")


@query("SELECT s_suppkey, s_name, s_nationkey, CASE WHEN s_nationkey < 10 AND s_acctbal > 0 THEN s_acctbal * 2 ELSE s_acctbal END AS s_acctbal FROM supplier")
def dml_update(spark, d):
    where = (F.col("s_nationkey") < 10) & (F.col("s_acctbal") > 0)
    return dml.update(read_table(spark, d, "supplier"), {"s_acctbal": F.col("s_acctbal") * 2}, where, shard_key="s_suppkey")


@query("SELECT * FROM mock_a WHERE NOT coalesce(a > 100, false)")
def dml_delete(spark, d):
    return dml.delete(read_table(spark, d, "mock_a"), F.col("a") > 100)


@query("SELECT * FROM supplier WHERE s_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey > 5 ORDER BY s_acctbal DESC, s_suppkey LIMIT 10)")
def dml_delete_limit(spark, d):
    return dml.delete(read_table(spark, d, "supplier"), F.col("s_nationkey") > 5, [F.desc("s_acctbal"), F.col("s_suppkey")], 10)


@query("SELECT c_custkey, 1000 + row_number() OVER (ORDER BY c_custkey) AS number FROM customer")
def dml_autoinc(spark, d):
    rows = read_table(spark, d, "customer").select("c_custkey", F.lit(None).cast("long").alias("number"))
    return dml.auto_increment(rows, "number", 1000, ["c_custkey"])


# ---- change capture ------------------------------------------------------------------------------------------------

CHANGED = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"


def _changes(orders: DataFrame) -> DataFrame:
    """A log: orders divisible by 7 deleted, by 5 updated twice, by 11 inserted anew under another key."""
    k = F.col("o_orderkey")
    first = orders.where(k % 5 == 0).select("*", F.lit("update").alias("op"), F.lit(1).alias("seq")).withColumn("o_orderstatus", F.lit("X"))
    second = orders.where(k % 5 == 0).select("*", F.lit("update").alias("op"), F.lit(2).alias("seq")).withColumn("o_orderstatus", F.lit(None).cast("string"))
    gone = orders.where(k % 7 == 0).select("*", F.lit("delete").alias("op"), F.lit(3).alias("seq"))
    new = orders.where(k % 11 == 0).withColumn("o_orderkey", k + 1000000000).select("*", F.lit("insert").alias("op"), F.lit(1).alias("seq"))
    return first.union(second).union(gone).union(new)


@query(
    """SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
    FROM orders WHERE o_orderkey % 7 <> 0 UNION ALL
    SELECT o_orderkey + 1000000000, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_orderkey % 11 = 0"""
)
def cdc_apply(spark, d):
    orders = read_table(spark, d, "orders")
    return cdc.apply_changes(orders, _changes(orders), ["o_orderkey"])


@query(
    """SELECT id, name, a, b FROM mock_b EXCEPT ALL SELECT * FROM (SELECT DISTINCT id, name, a, b FROM mock_b WHERE a % 2 = 0)
    UNION ALL SELECT id, name, a, b FROM mock_b WHERE b = 3"""
)
def cdc_keyless(spark, d):
    table = read_table(spark, d, "mock_b")
    return cdc.apply_keyless(table, table.where("b = 3"), table.where("a % 2 = 0").distinct())


# ---- metadata ------------------------------------------------------------------------------------------------------


@query(
    """SELECT regexp_replace(segment, '_?[0-9]+$', '') AS name, count(*) AS segments, count(DISTINCT backend) AS backends, CAST(sum(coalesce(slot_to - slot_from, 0)) AS BIGINT) AS slots
    FROM shard_map GROUP BY 1"""
)
def meta_segments(spark, d):
    m = read_table(spark, d, "shard_map")
    return m.groupBy(F.regexp_replace("segment", "_?[0-9]+$", "").alias("name")).agg(F.count(F.lit(1)).alias("segments"), F.count_distinct("backend").alias("backends"), F.sum(F.coalesce(F.col("slot_to") - F.col("slot_from"), F.lit(0))).alias("slots"))


@query(
    """SELECT table_name AS name, CAST(sum(n) AS BIGINT) AS rows, max(avg) AS avg_row_length, CAST(sum(n * avg) AS BIGINT) AS data_length, CAST(0 AS BIGINT) AS index_length, max(moment) AS update_time
    FROM (SELECT table_name, 10 + length(segment) AS n, 5 + length(backend) AS avg, TIMESTAMP '2025-01-01' + INTERVAL (length(segment)) DAY AS moment
        FROM shard_map WHERE kind = 'HASH' AND regexp_matches(segment, '_[0-9]{4}$')) GROUP BY table_name"""
)
def meta_table_status(spark, d):
    shards = read_table(spark, d, "shard_map").where("kind = 'HASH' AND segment RLIKE '_[0-9]{4}$'")
    n, avg = (F.length("segment") + 10).cast("long"), (F.length("backend") + 5).cast("long")
    moment = F.expr("timestamp_ntz'2025-01-01' + make_dt_interval(length(segment))")
    rows = shards.select(F.col("segment").alias("name"), n.alias("rows"), avg.alias("avg_row_length"), (n * avg).alias("data_length"), F.lit(0).cast("long").alias("index_length"), moment.alias("update_time"))
    return aggregates.table_status(rows)


#: CRC-32 (reflected polynomial 0xEDB88320) of each row's text, and their sum, in SQL.
CHECKSUM = """WITH steps AS (
        SELECT i, list_reduce(list_prepend(CAST(i AS BIGINT), [CAST(0 AS BIGINT) FOR _ IN range(8)]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS crc FROM range(256) t(i)),
    crcs AS (SELECT list(crc ORDER BY i) AS crc_of FROM steps),
    texts AS (SELECT {cells} AS t FROM {table}),
    sums AS (SELECT xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(t, ''), lambda x: CAST(ascii(x) AS BIGINT))),
        lambda c, b: xor(c >> 8, crc_of[(xor(c, b) & 255) + 1]))) AS crc FROM texts, crcs)
    """
BENCHYOU_CRC = CHECKSUM.format(cells="coalesce(CAST(id AS VARCHAR), chr(30)) || chr(31) || coalesce(CAST(k AS VARCHAR), chr(30)) || chr(31) || coalesce(c, chr(30)) || chr(31) || coalesce(pad, chr(30))", table="benchyou0")


@query(BENCHYOU_CRC + "SELECT CAST(sum(crc) % 4294967296 AS BIGINT) AS checksum FROM sums")
def checksum_wrap_sum(spark, d):
    return aggregates.checksum(read_table(spark, d, "benchyou0"))


@query(BENCHYOU_CRC + "SELECT 'benchyou0' AS name, CAST(sum(crc) % 4294967296 AS BIGINT) AS checksum FROM sums")
def checksum_combine(spark, d):
    # The sum over the shards of a table is the checksum of the whole.
    placed = placement_of(spark, d, "benchyou0")
    table = read_table(spark, d, "benchyou0")
    parts = P.with_shard(table, placed).groupBy(P.SHARD).agg((F.sum(aggregates.row_checksum(table)) % (1 << 32)).alias("checksum"))
    return aggregates.combine_checksums(parts).select(F.lit("benchyou0").alias("name"), "checksum")


# ---- the dialect ---------------------------------------------------------------------------------------------------

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "mock_a", "mock_b", "articles", "benchyou0", "t_list"]


def engine(spark: SparkSession, d: str, **options) -> Engine:
    """An engine with the supplied tables registered; those of the shard map with their placement."""
    e = Engine(spark, scratch_path(spark, "engine"), **options)
    for name in TABLES:
        e.register(name, read_table(spark, d, name))
    return e


@functools.lru_cache(maxsize=4)
def _reader(spark: SparkSession, d: str, fold_case: bool) -> Engine:
    """An engine that only queries are put to, made once."""
    return engine(spark, d, fold_case=fold_case)


def dialect(name: str, mysql: str, sql: str, fold_case: bool = False) -> None:
    QUERIES[name] = lambda spark, d: _reader(spark, d, fold_case).sql(mysql)
    SQL[name] = sql


dialect("dialect_limit_comma", "select c_custkey, c_name from customer order by c_custkey limit 3, 7", "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 7 OFFSET 3")
dialect("dialect_bools", "select id, a > 100 as big, name = 'go' or c as either, a between 5 and 9 mid from mock_a where score and not (c = 3)",
        "SELECT id, CAST(a > 100 AS INTEGER) AS big, CAST(name = 'go' OR c <> 0 AS INTEGER) AS either, CAST(a BETWEEN 5 AND 9 AS INTEGER) AS mid FROM mock_a WHERE score <> 0 AND NOT (c = 3)")
dialect("dialect_group_concat", "select n_regionkey r, group_concat(n_name order by n_name desc separator ';') names from nation group by n_regionkey",
        "SELECT n_regionkey AS r, string_agg(n_name, ';' ORDER BY n_name DESC) AS names FROM nation GROUP BY n_regionkey")
dialect("dialect_casts", "select id, cast(score as signed) s, cast(a as char) t, length(name) n, c div 2 half, c mod 2 odd from mock_a where id >= 0",
        "SELECT id, CAST(score AS BIGINT) AS s, CAST(a AS VARCHAR) AS t, strlen(name) AS n, CAST(c // 2 AS BIGINT) AS half, c % 2 AS odd FROM mock_a WHERE id >= 0 AND (c IS NULL OR c >= 0)"
        " UNION ALL SELECT id, CAST(score AS BIGINT), CAST(a AS VARCHAR), strlen(name), CAST(c // 2 AS BIGINT), c % 2 FROM mock_a WHERE id >= 0 AND c < 0")  # fmt: skip
dialect("dialect_join", "select A.id, ifnull(B.b, -1) b from mock_a as A left join mock_b B on A.id = B.id and B.name <=> 'go' where A.c in (1, 2)",
        "SELECT a.id, ifnull(b.b, -1) AS b FROM mock_a a LEFT JOIN mock_b b ON a.id = b.id AND b.name IS NOT DISTINCT FROM 'go' WHERE a.c IN (1, 2)")
dialect("dialect_straight_join", "select straight_join a.id, b.b from mock_a a straight_join mock_b b on a.id = b.id", "SELECT a.id, b.b FROM mock_a a JOIN mock_b b ON a.id = b.id")
dialect("dialect_union", "(select n_name from nation order by n_nationkey limit 3) union select r_name from region union all select 'lang' from dual order by n_name limit 2, 5",
        "SELECT * FROM ((SELECT n_name FROM nation ORDER BY n_nationkey LIMIT 3) UNION SELECT r_name FROM region UNION ALL SELECT 'lang') ORDER BY n_name LIMIT 5 OFFSET 2")
dialect("dialect_having", "select o_custkey k, count(*) n from orders group by k having n > 12 && count(*) < 100", "SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12 AND count(*) < 100")
dialect("dialect_implicit_order", "select o_custkey, count(*) n from orders group by o_custkey limit 10", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey ORDER BY o_custkey LIMIT 10")
dialect("dialect_date_format", "select o_orderkey, date_format(o_orderdate, '%y-%m-%d') d from orders where o_orderstatus = 'F'", "SELECT o_orderkey, strftime(o_orderdate, '%y-%m-%d') AS d FROM orders WHERE o_orderstatus = 'F'")
dialect("dialect_xor", "select id from mock_a where a > 100 xor c = 1", "SELECT id FROM mock_a WHERE (a > 100) <> (c = 1)")
dialect("dialect_fulltext", "select id from articles where match(title, body) against('einhof' in boolean mode)",
        "SELECT id FROM articles WHERE contains(lower(coalesce(title, '')), 'einhof') OR contains(lower(coalesce(body, '')), 'einhof')")
dialect("dialect_fold_case", "select count(*) n from customer where c_mktsegment = 'building'", "SELECT count(*) AS n FROM customer WHERE lower(c_mktsegment) = 'building'", fold_case=True)
dialect("dialect_subquery", "select c_custkey from customer where c_custkey in (select o_custkey from orders where o_totalprice > 250000)", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)")


dialect("dialect_arith_zero", "select id, a / c r, a div c q, a % c m, a / 0 none, 7 div (c - c) gone from mock_a",
        "SELECT id, CASE WHEN c <> 0 THEN CAST(a AS DOUBLE) / c END AS r, CASE WHEN c <> 0 THEN CAST(trunc(CAST(a AS DOUBLE) / c) AS BIGINT) END AS q, CASE WHEN c <> 0 THEN a % c END AS m, CAST(NULL AS DOUBLE) AS none, CAST(NULL AS BIGINT) AS gone FROM mock_a")
dialect("dialect_mod", "select id, mod(a, 7) m, mod(a, b) r, a mod b s from mock_a where mod(id, 3) = 1",
        "SELECT id, a % 7 AS m, CASE WHEN b <> 0 THEN a % b END AS r, CASE WHEN b <> 0 THEN a % b END AS s FROM mock_a WHERE id % 3 = 1")
dialect("dialect_unsigned", "select id, cast(cast(0 - a as unsigned) as char) u, cast(concat(a, 'x') as signed) s, cast(name as signed) n, cast(18446744073709551615 as signed) w from mock_a",
        """SELECT id, CAST(CASE WHEN a > 0 THEN CAST(18446744073709551616 AS HUGEINT) - a ELSE -a END AS VARCHAR) AS u, CAST(a AS BIGINT) AS s,
        CASE WHEN name IS NOT NULL THEN CAST(0 AS BIGINT) END AS n, CAST(-1 AS BIGINT) AS w FROM mock_a""")  # fmt: skip
dialect("dialect_addtime", "select id, addtime(cast(concat(abs(a) % 30, ':', abs(b) % 60, ':5') as time), cast('1:0:0' as time)) t from mock_a where a is not null and b is not null",
        """SELECT id, printf('%02d:%02d:05', (s // 3600)::BIGINT, (s // 60 % 60)::BIGINT) AS t
        FROM (SELECT id, (abs(a) % 30) * 3600 + (abs(b) % 60) * 60 + 3605 AS s FROM mock_a WHERE a IS NOT NULL AND b IS NOT NULL)""")  # fmt: skip
dialect("dialect_group_concat_distinct", "select c, group_concat(distinct a order by a desc separator '|') falling, group_concat(distinct a) rising from mock_a group by c",
        """SELECT c, nullif(array_to_string(list_reverse_sort(list_distinct(list(a) FILTER (a IS NOT NULL))), '|'), '') AS falling,
        nullif(array_to_string(list_sort(list_distinct(list(a) FILTER (a IS NOT NULL))), ','), '') AS rising FROM mock_a GROUP BY c""")  # fmt: skip
dialect("dialect_functions",
        "select id, truncate(a / 8, 1) t, field(name, 'go', 'lang') f, strcmp(name, 'lang') s, insert(name, 2, 1, 'XY') i, date_add('2024-01-31', interval c day) d, a > 100 is true b from mock_a where c between 0 and 40",
        """SELECT id, CAST(trunc(a * 10 / 8.0) / 10 AS DOUBLE) AS t, CASE name WHEN 'go' THEN 1 WHEN 'lang' THEN 2 ELSE 0 END AS f, CASE WHEN name < 'lang' THEN -1 WHEN name > 'lang' THEN 1 WHEN name = 'lang' THEN 0 END AS s,
        CASE WHEN length(name) >= 2 THEN name[1:1] || 'XY' || name[3:] ELSE name END AS i, CAST(DATE '2024-01-31' + c AS DATE) AS d, CAST(coalesce(a > 100, false) AS INTEGER) AS b FROM mock_a WHERE c BETWEEN 0 AND 40""")  # fmt: skip


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 17 AND o_totalprice > 1000")
def dialect_prepared(spark, d):
    return _reader(spark, d, False).sql("select o_orderkey, o_totalprice from orders where o_custkey = ? and o_totalprice > ?", args=[17, 1000])


def _explained(spark: SparkSession, d: str) -> DataFrame:
    e = engine(spark, d)
    for name in ("mock_a", "mock_b"):
        e.placements[name] = placement_of(spark, d, name)
    return e.sql("explain select a.id, sum(b.b) from mock_a a join mock_b b on a.id = b.id where a.id in (0, 1) group by a.id order by a.id limit 5")


@query()
def explain_join(spark, d):
    return _explained(spark, d)


@query(
    """SELECT DISTINCT segment AS "table", backend, '[' || slot_from || '-' || slot_to || ')' AS slots FROM shard_map, (VALUES (0), (2323)) wanted(slot)
    WHERE table_name IN ('mock_a', 'mock_b') AND slot >= slot_from AND slot < slot_to"""
)
def explain_partitions(spark, d):
    # Slots of the keys 0 and 1; the equal key of the other table is pinned with them.
    plan = F.from_json("EXPLAIN", "Partitions array<struct<Table string, Backend string, Range string>>")
    return _explained(spark, d).select(F.inline(plan["Partitions"])).selectExpr("Table AS `table`", "Backend AS backend", "Range AS slots")


@query("SELECT 'a.id, sum(b.b)' AS project, 'INNER JOIN' AS joined, 'sum(b.b)' AS aggregates, 'a.id' AS groups, 'a.id' AS orders, 0 AS skipped, 5 AS most")
def explain_shape(spark, d):
    kind = "Project string, Join struct<Type string>, Aggregate array<string>, HashGroupBy array<string>, GatherMerge array<string>, Limit struct<Offset int, Limit int>"
    plan = _explained(spark, d).select(F.from_json("EXPLAIN", kind).alias("p"))
    return plan.selectExpr("p.Project AS project", "p.Join.Type AS joined", "array_join(p.Aggregate, ',') AS aggregates", "array_join(p.HashGroupBy, ',') AS groups", "array_join(p.GatherMerge, ',') AS orders", "p.Limit.Offset AS skipped", "p.Limit.Limit AS most")


@query("SELECT 1 AS a, 4 AS b UNION ALL SELECT 3, 9 UNION ALL SELECT 7, NULL")
def engine_changes(spark, d):
    """A table's life: created, filled, replaced, updated, deleted from, rolled back."""
    e = engine(spark, d)
    for statement in (
        "create database shop", "use shop", "create table t (a int key, b int)", "insert into t (b, a) values (4, 1), (5, 2), (6, 3)", "replace into t values (2, 8)",
        "insert into t values (3, 2) on duplicate key update b = b + values(b) + 1", "delete from t where b = 8", "begin", "delete from t", "rollback", "insert into t set a = 7",
    ):
        e.sql(statement)
    return e.sql("select a, b from t")


def life(name: str, sql: str, *statements: str) -> None:
    """Registers a table's life: statements over the supplied tables, the last of which is the query."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        e = engine(spark, d)
        e.sql("create database shop")
        e.sql("use shop")
        for statement in statements[:-1]:
            e.sql(statement)
        return e.sql(statements[-1])

    QUERIES[name], SQL[name] = run, sql


life(
    "engine_update_limit",
    """SELECT s_suppkey AS id, CASE WHEN top THEN 'top' ELSE s_name END AS name, s_nationkey AS nation, CASE WHEN top THEN s_acctbal + 1000 ELSE s_acctbal END AS bal
    FROM (SELECT *, s_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_nationkey > 5 ORDER BY s_acctbal DESC, s_suppkey LIMIT 25) AS top FROM supplier)""",
    "create table s (id bigint primary key, name varchar(40), nation int, bal double)",
    "insert into s select s_suppkey, s_name, s_nationkey, s_acctbal from supplier",
    "update s set bal = bal + 1000, name = 'top' where nation > 5 order by bal desc, id limit 25",
    "select * from s",
)
life(
    "engine_delete_limit",
    "SELECT c_custkey AS id, c_nationkey AS nation FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0 ORDER BY c_nationkey DESC, c_custkey LIMIT 30)",
    "create table c (id bigint primary key, nation int, bal double)",
    "insert into c select c_custkey, c_nationkey, c_acctbal from customer",
    "delete from c where bal < 0 order by nation desc, id limit 30",
    "select id, nation from c",
)
life(
    "engine_upsert_null_key",
    """SELECT a, n, count(*) AS copies FROM (
        SELECT a, count(*) AS n FROM mock_a WHERE a IS NOT NULL GROUP BY a UNION ALL SELECT a, 1 FROM mock_a WHERE a IS NULL) GROUP BY a, n""",
    "create table m (id int, a int, n bigint, unique key (a)) single",
    "insert into m select id, a, 1 from mock_a order by id on duplicate key update n = n + values(n)",
    "select a, n, count(*) copies from m group by a, n",
)
life(
    "engine_upsert_repeated",
    """SELECT o_custkey AS k, list_reduce(list(CAST(o_orderkey % 97 AS BIGINT) ORDER BY o_orderkey), lambda x, y: (x * 3 + y) % 10007) AS v FROM orders GROUP BY o_custkey""",
    "create table o (k bigint primary key, v bigint)",
    "insert into o select o_custkey, o_orderkey % 97 from orders order by o_orderkey on duplicate key update v = (v * 3 + values(v)) % 10007",
    "select * from o",
)
life(
    "engine_upsert_second_key",
    """SELECT c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 4 = 0 THEN 20 ELSE 10 END AS n FROM customer WHERE c_custkey % 2 = 0
    UNION ALL SELECT c_custkey + 1000000, c_name, 1 FROM customer WHERE c_custkey % 2 = 1""",
    "create table c (id bigint primary key, name varchar(40) unique, n int) single",
    "insert into c select c_custkey, c_name, 0 from customer where c_custkey % 2 = 0",
    "insert into c select c_custkey + 1000000, c_name, 1 from customer on duplicate key update n = n + 10",
    "insert into c select c_custkey, concat(c_name, 'x'), 2 from customer where c_custkey % 4 = 0 on duplicate key update n = n + 10",
    "select * from c",
)
life(
    "engine_insert_ignore",
    "SELECT o_custkey AS k, min_by(o_orderkey, o_orderkey) AS first FROM orders GROUP BY o_custkey",
    "create table o (k bigint primary key, first bigint)",
    "insert into o select o_custkey, o_orderkey from orders where o_orderkey < 2000 order by o_orderkey on duplicate key update first = first",
    "insert ignore into o select o_custkey, o_orderkey from orders order by o_orderkey",
    "select * from o",
)
life(
    "engine_replace",
    """SELECT s_suppkey AS id, s_name AS name, s_acctbal AS bal FROM supplier WHERE s_suppkey % 3 <> 0
    UNION ALL SELECT s_suppkey, 'last', s_acctbal + 2 FROM supplier WHERE s_suppkey % 3 = 0""",
    "create table s (id bigint primary key, name varchar(40), bal double)",
    "insert into s select s_suppkey, s_name, s_acctbal from supplier",
    """replace into s select id, name, bal from (select s_suppkey id, 'first' name, s_acctbal + 1 bal, 1 seq from supplier where s_suppkey % 3 = 0
        union all select s_suppkey, 'last', s_acctbal + 2, 2 from supplier where s_suppkey % 3 = 0) x order by seq""",
    "select * from s",
)
life(
    "engine_pruned_select",
    "SELECT b.id, b.k, b.c, coalesce(m.n, 0) AS n FROM benchyou0 b LEFT JOIN (SELECT id, count(*) AS n FROM mock_b GROUP BY id) m ON b.id = m.id WHERE b.id IN (50, 77)",
    "create table b (id bigint, k bigint, c text) partition by hash(id) partitions 16",
    "insert into b select id, k, c from benchyou0",
    "create table m (id bigint, a int) partition by hash(id) partitions 16",
    "insert into m select id, a from mock_b",
    "select b.id, b.k, b.c, ifnull(m.n, 0) n from b left join (select id, count(*) n from m where id in (50, 77) group by id) m on b.id = m.id where b.id in (50, 77)",
)
life(
    "engine_pruned_update",
    """SELECT o_orderkey AS id, o_custkey AS cust, CASE WHEN o_orderkey IN (1, 5, 9, 40) THEN 'Z' ELSE o_orderstatus END AS status FROM orders WHERE o_orderkey NOT IN (7, 8)""",
    "create table o (id bigint primary key, cust bigint, status varchar(3)) partition by hash(id) partitions 16",
    "insert into o select o_orderkey, o_custkey, o_orderstatus from orders",
    "update o set status = 'Z' where id in (1, 5, 9) or id = 40",
    "delete from o where id = 7",
    "delete from o where id = 8 and cust > 0",
    "select * from o",
)
life(
    "engine_transactions",
    "SELECT n_nationkey AS id, CASE WHEN n_regionkey = 1 THEN lower(n_name) ELSE n_name END AS name FROM nation WHERE n_regionkey <> 2",
    "create table n (id int primary key, name varchar(40), region int)",
    "begin",
    "insert into n select n_nationkey, n_name, n_regionkey from nation",
    "update n set name = lower(name) where region = 1",
    "commit",
    "begin",
    "delete from n where region <> 2",
    "rollback",
    "start transaction",
    "delete from n where region = 2",
    "commit",
    "select id, name from n",
)
life(
    "engine_definitions",
    "SELECT n_nationkey AS id, n_name AS title, CASE WHEN n_nationkey < 20 THEN 7 ELSE n_nationkey END AS size, CAST(n_regionkey AS BIGINT) AS region FROM nation",
    "create table a (id int primary key, name varchar(40), region int, gone int) partition by hash(id) partitions 8",
    "insert into a select n_nationkey, n_name, n_regionkey, 1 from nation where n_nationkey < 20",
    "alter table a add column size int not null default 7",
    "alter table a modify column region bigint",
    "alter table a drop column gone",
    "create unique index names on a (id, name)",
    "insert into a (id, name, region, size) select n_nationkey, n_name, n_regionkey, n_nationkey from nation where n_nationkey >= 20",
    "rename table a to b",
    "create table a (id int primary key)",
    "select b.id, b.name title, b.size, b.region from b left join a on a.id = b.id",
)
life(
    "engine_auto_increment",
    "SELECT row_number() OVER (ORDER BY n_nationkey) AS id, n_name AS name FROM nation UNION ALL SELECT 1000, 'given' UNION ALL SELECT 1000 + row_number() OVER (ORDER BY r_regionkey), r_name FROM region",
    "create table a (id bigint not null auto_increment primary key, name varchar(40) default 'x')",
    "insert into a (name) select n_name from nation order by n_nationkey",
    "insert into a values (1000, 'given')",
    "insert into a select 0, r_name from region order by r_regionkey",
    "select * from a",
)
life(
    "engine_checksum",
    BENCHYOU_CRC + "SELECT 'shop.b' AS \"Table\", CAST(sum(crc) % 4294967296 AS BIGINT) AS \"Checksum\" FROM sums UNION ALL SELECT 'shop.none', NULL",
    "create table b (id bigint, k bigint, c text, pad text) partition by hash(id) partitions 8",
    "insert into b select id, k, c, pad from benchyou0",
    "optimize table b",
    "checksum table b, none",
)
life(
    "engine_list_table",
    "SELECT c1, c2 FROM t_list WHERE c1 IN (SELECT list_value FROM shard_map WHERE table_name = 't_list') AND c1 IN (1, 3, 8)",
    "create table l (c1 int, c2 int) partition by list(c1) (partition backend0 values in (1, 3, 7), partition backend1 values in (2, 5, 8))",
    "insert into l select c1, c2 from t_list where c1 in (1, 2, 3, 5, 7, 8)",
    "select c1, c2 from l where c1 in (1, 3, 8, 9)",
)
