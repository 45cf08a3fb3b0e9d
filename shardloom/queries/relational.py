"""Scans, projections, filters, joins, aggregations, sorts and set operations over the supplied tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import mysql as M
from ..lineage import scratch_path
from ..operators import aggregates, joins, ordering
from ..session import read_table

Tables = Callable[[str], DataFrame]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of the tables under its name, with its SQL twin."""

    def add(make: Callable[[Tables], DataFrame]):
        QUERIES[make.__name__] = lambda spark, d: make(lambda name: read_table(spark, d, name))
        if sql:
            SQL[make.__name__] = sql
        return make

    return add


def money(column: str):
    """Exact decimal of an amount with two places, so that sums do not depend on their order."""
    return F.col(column).cast("decimal(18,2)")


def exact(column):
    return column.cast("double")


MONEY = "CAST({} AS DECIMAL(18,2))".format

# ---- scans and projections -----------------------------------------------------------------------------------------


@query("SELECT * FROM nation")
def scan_star(t):
    return t("nation").select("*")


@query("SELECT n.n_name AS name, n.n_regionkey AS region FROM nation n")
def scan_alias(t):
    return t("nation").alias("n").select(F.col("n.n_name").alias("name"), F.col("n.n_regionkey").alias("region"))


@query("SELECT count(*) AS n, count(DISTINCT l_orderkey) AS orders FROM lineitem")
def scan_scatter(t):
    return t("lineitem").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("l_orderkey").alias("orders"))


@query(
    f"""SELECT l_orderkey, l_linenumber, CAST(round({MONEY('l_extendedprice')} * (1 - {MONEY('l_discount')}), 2) AS DOUBLE) AS net,
    l_quantity + 1 AS more, -l_linenumber AS minus, l_linenumber % 2 AS odd FROM lineitem"""
)
def project_expr(t):
    net = exact(F.round(money("l_extendedprice") * (1 - money("l_discount")), 2))
    return t("lineitem").select("l_orderkey", "l_linenumber", net.alias("net"), (F.col("l_quantity") + 1).alias("more"), (-F.col("l_linenumber")).alias("minus"), (F.col("l_linenumber") % 2).alias("odd"))


@query("SELECT id, CAST(score > 50 AS INTEGER) AS high, CAST(name <> 'go' AS INTEGER) AS other, CAST(a = b AS INTEGER) AS same FROM mock_a")
def project_bool_int(t):
    return t("mock_a").select("id", M.truth(F.col("score") > 50).alias("high"), M.truth(F.col("name") != "go").alias("other"), M.truth(F.col("a") == F.col("b")).alias("same"))


@query("SELECT o.*, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey")
def project_table_star(t):
    o, c = t("orders").alias("o"), t("customer").alias("c")
    return o.join(c, F.col("o.o_custkey") == F.col("c.c_custkey")).select("o.*", "c.c_name")


@query("SELECT 1 AS one, 'lang' AS word, CAST(NULL AS INTEGER) AS nothing")
def dual_const(t):
    spark = t("region").sparkSession
    return spark.range(1).select(F.lit(1).alias("one"), F.lit("lang").alias("word"), F.lit(None).cast("int").alias("nothing"))


# ---- filters -------------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 100000 AND o_orderdate >= TIMESTAMP '1995-01-01'")
def filter_and(t):
    return t("orders").where((F.col("o_orderstatus") == "O") & (F.col("o_totalprice") > 100000) & (F.col("o_orderdate") >= F.lit("1995-01-01").cast("timestamp_ntz"))).select("o_orderkey", "o_totalprice")


@query("SELECT id, a FROM mock_a WHERE a = 1 OR a = 5 OR a = 9 OR b IN (2, 3)")
def filter_or_in(t):
    return t("mock_a").where((F.col("a") == 1) | (F.col("a") == 5) | (F.col("a") == 9) | F.col("b").isin(2, 3)).select("id", "a")


@query("SELECT c_custkey, c_name FROM customer WHERE c_acctbal BETWEEN 0 AND 5000 AND c_mktsegment LIKE 'B%' AND NOT (c_nationkey = 3) AND c_name NOT LIKE '%7'")
def filter_between_like(t):
    return t("customer").where(F.col("c_acctbal").between(0, 5000) & F.col("c_mktsegment").like("B%") & ~(F.col("c_nationkey") == 3) & ~F.col("c_name").like("%7")).select("c_custkey", "c_name")


@query("SELECT r_regionkey FROM region WHERE 1 = 1")
def filter_const(t):
    return t("region").where(F.lit(1) == F.lit(1)).select("r_regionkey")


@query("SELECT r_regionkey FROM region WHERE 1 = 2")
def filter_const_false(t):
    return t("region").where(F.lit(1) == F.lit(2)).select("r_regionkey")


@query("SELECT id, name FROM mock_a WHERE name IS NULL OR score IS NOT NULL AND a IS NULL")
def filter_isnull(t):
    return t("mock_a").where(F.col("name").isNull() | F.col("score").isNotNull() & F.col("a").isNull()).select("id", "name")


@query("SELECT id FROM mock_a WHERE a IS NOT DISTINCT FROM b OR c IS NOT DISTINCT FROM NULL")
def filter_nullsafe(t):
    return t("mock_a").where(F.col("a").eqNullSafe(F.col("b")) | F.col("c").eqNullSafe(F.lit(None))).select("id")


@query("SELECT id FROM mock_a WHERE 7 < a AND 3 = c")
def filter_flipped(t):
    return t("mock_a").where((F.lit(7) < F.col("a")) & (F.lit(3) == F.col("c"))).select("id")


@query("SELECT event_id, CASE WHEN value < 10 THEN 'low' WHEN value < 50 THEN 'mid' ELSE 'high' END AS band FROM events WHERE user_id & 3 = 1")
def filter_case_bits(t):
    band = F.when(F.col("value") < 10, "low").when(F.col("value") < 50, "mid").otherwise("high")
    return t("events").where(F.col("user_id").bitwiseAND(3) == 1).select("event_id", band.alias("band"))


# ---- joins ---------------------------------------------------------------------------------------------------------


@query("SELECT a.id, a.name, b.b FROM mock_a a JOIN mock_b b ON a.id = b.id")
def join_inner(t):
    return t("mock_a").alias("a").join(t("mock_b").alias("b"), F.col("a.id") == F.col("b.id")).select("a.id", "a.name", "b.b")


@query("SELECT a.id, b.b FROM mock_a a, mock_b b WHERE a.id = b.id AND a.c > 2")
def join_comma(t):
    return t("mock_a").alias("a").crossJoin(t("mock_b").alias("b")).where((F.col("a.id") == F.col("b.id")) & (F.col("a.c") > 2)).select("a.id", "b.b")


@query("SELECT a.id, b.b FROM mock_a a JOIN mock_b b ON a.id = b.id")
def join_sort_merge(t):
    return t("mock_a").alias("a").join(t("mock_b").hint("merge").alias("b"), F.col("a.id") == F.col("b.id")).select("a.id", "b.b")


@query("SELECT a.id, b.id AS other FROM mock_a a JOIN mock_b b ON a.id = b.id AND a.name = b.name")
def join_multikey(t):
    return t("mock_a").alias("a").join(t("mock_b").alias("b"), (F.col("a.id") == F.col("b.id")) & (F.col("a.name") == F.col("b.name"))).select("a.id", F.col("b.id").alias("other"))


@query(
    f"""SELECT n_name, count(*) AS n, CAST(sum({MONEY('l_extendedprice')}) AS DOUBLE) AS price FROM lineitem
    JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY n_name"""
)
def join_nway(t):
    nations = t("nation").join(joins.small(t("region").where("r_name = 'ASIA'")), F.col("n_regionkey") == F.col("r_regionkey"))
    customers = t("customer").join(joins.small(nations), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    rows = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return rows.groupBy("n_name").agg(F.count(F.lit(1)).alias("n"), exact(F.sum(money("l_extendedprice"))).alias("price"))


@query("SELECT x.n_name AS a, y.n_name AS b FROM nation x JOIN nation y ON x.n_regionkey = y.n_regionkey AND x.n_nationkey < y.n_nationkey")
def join_self(t):
    n = t("nation")
    x, y = n.alias("x"), n.alias("y")
    return x.join(y, (F.col("x.n_regionkey") == F.col("y.n_regionkey")) & (F.col("x.n_nationkey") < F.col("y.n_nationkey"))).select(F.col("x.n_name").alias("a"), F.col("y.n_name").alias("b"))


@query("SELECT x.n_nationkey AS a, y.n_nationkey AS b FROM nation x JOIN nation y ON x.n_nationkey + 1 = y.n_nationkey")
def join_expr_key(t):
    x, y = t("nation").alias("x"), t("nation").alias("y")
    return x.join(y, F.col("x.n_nationkey") + 1 == F.col("y.n_nationkey")).select(F.col("x.n_nationkey").alias("a"), F.col("y.n_nationkey").alias("b"))


@query("SELECT s_suppkey, n_nationkey FROM supplier JOIN nation ON s_nationkey >= n_nationkey")
def join_theta(t):
    return t("supplier").join(joins.small(t("nation")), F.col("s_nationkey") >= F.col("n_nationkey")).select("s_suppkey", "n_nationkey")


@query("SELECT p_partkey, low FROM part JOIN (SELECT n_nationkey * 50.0 + 900 AS low, n_nationkey * 50.0 + 940 AS high FROM nation) ON p_retailprice BETWEEN low AND high")
def join_band(t):
    bands = t("nation").select((F.col("n_nationkey") * 50.0 + 900).alias("low"), (F.col("n_nationkey") * 50.0 + 940).alias("high"))
    return joins.band_join(t("part").select("p_partkey", "p_retailprice"), bands, "p_retailprice", "low", "high", 50.0).select("p_partkey", "low")


@query(
    """SELECT x.id AS left_id, y.id AS right_id FROM mock_a x JOIN (SELECT * FROM mock_b WHERE b = 7) y
    ON x.name IS NOT DISTINCT FROM y.name AND x.id = y.id"""
)
def join_nullsafe(t):
    x, y = t("mock_a").alias("x"), t("mock_b").where("b = 7").alias("y")
    return joins.null_safe_join(x, y, [(F.col("x.name"), F.col("y.name")), (F.col("x.id"), F.col("y.id"))]).select(F.col("x.id").alias("left_id"), F.col("y.id").alias("right_id"))


@query("SELECT x.id AS left_id, y.id AS right_id FROM mock_a x JOIN mock_b y ON x.name IS NOT DISTINCT FROM y.name AND x.id = y.id")
def join_nullsafe_whole(t):
    x, y = t("mock_a").alias("x"), t("mock_b").alias("y")
    return joins.null_safe_join(x, y, [(F.col("x.name"), F.col("y.name")), (F.col("x.id"), F.col("y.id"))]).select(F.col("x.id").alias("left_id"), F.col("y.id").alias("right_id"))


@query("SELECT r_name, n_name FROM region CROSS JOIN nation")
def join_cross(t):
    return t("region").crossJoin(t("nation")).select("r_name", "n_name")


@query("SELECT a.id, b.b FROM mock_a a LEFT JOIN mock_b b ON a.id = b.id")
def join_left(t):
    return t("mock_a").alias("a").join(t("mock_b").alias("b"), F.col("a.id") == F.col("b.id"), "left").select("a.id", "b.b")


@query("SELECT a.name, b.id FROM mock_a a RIGHT JOIN mock_b b ON a.id = b.id")
def join_right(t):
    return t("mock_a").alias("a").join(t("mock_b").alias("b"), F.col("a.id") == F.col("b.id"), "right").select("a.name", "b.id")


@query("SELECT a.id, b.b FROM mock_a a JOIN mock_b b ON a.id = b.id")
def join_straight(t):
    from ..plans.dialect import to_spark

    spark = t("mock_a").sparkSession
    return spark.sql(to_spark("SELECT a.id, b.b FROM {a} a STRAIGHT_JOIN {b} b ON a.id = b.id"), a=t("mock_a"), b=t("mock_b"))


@query("SELECT a.id, b.b FROM mock_a a LEFT JOIN mock_b b ON a.id = b.id AND a.c = 1")
def join_left_on_residual_l(t):
    return t("mock_a").alias("a").join(t("mock_b").alias("b"), (F.col("a.id") == F.col("b.id")) & (F.col("a.c") == 1), "left").select("a.id", "b.b")


@query("SELECT a.id, b.b FROM mock_a a LEFT JOIN mock_b b ON a.id = b.id AND b.name = 'go'")
def join_left_on_residual_r(t):
    return t("mock_a").alias("a").join(t("mock_b").alias("b"), (F.col("a.id") == F.col("b.id")) & (F.col("b.name") == "go"), "left").select("a.id", "b.b")


@query("SELECT a.id, b.b FROM mock_a a LEFT JOIN mock_b b ON a.id = b.id WHERE a.c = b.b")
def join_left_where_cross(t):
    return t("mock_a").alias("a").join(t("mock_b").alias("b"), F.col("a.id") == F.col("b.id"), "left").where(F.col("a.c") == F.col("b.b")).select("a.id", "b.b")


@query("SELECT a.id, coalesce(b.b, 0) AS b FROM mock_a a LEFT JOIN mock_b b ON a.id = b.id WHERE ifnull(b.b, 0) = 0")
def join_left_where_ifnull(t):
    return t("mock_a").alias("a").join(t("mock_b").alias("b"), F.col("a.id") == F.col("b.id"), "left").where(F.ifnull("b.b", F.lit(0)) == 0).select("a.id", F.coalesce("b.b", F.lit(0)).alias("b"))


@query("SELECT a.id FROM mock_a a LEFT JOIN mock_b b ON a.id = b.id WHERE b.id IS NULL")
def join_anti_idiom(t):
    return joins.anti_join(t("mock_a"), t("mock_b"), ["id"]).select("id")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def join_semi(t):
    return t("customer").join(t("orders").where("o_totalprice > 300000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT a.id AS left_id, b.id AS right_id FROM mock_a a FULL JOIN mock_b b ON a.id = b.id AND a.c = 1")
def join_full(t):
    return t("mock_a").alias("a").join(t("mock_b").alias("b"), (F.col("a.id") == F.col("b.id")) & (F.col("a.c") == 1), "full").select(F.col("a.id").alias("left_id"), F.col("b.id").alias("right_id"))


@query("SELECT c_custkey, n_name, r_name FROM customer JOIN (nation JOIN region ON n_regionkey = r_regionkey) ON c_nationkey = n_nationkey")
def join_paren_tree(t):
    inner = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return t("customer").join(joins.small(inner), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name", "r_name")


@query("SELECT a.id, a.a + b.b AS total, a.str || b.name AS text FROM mock_a a JOIN mock_b b ON a.id = b.id WHERE a.a > b.b")
def join_cross_side_expr(t):
    j = t("mock_a").alias("a").join(t("mock_b").alias("b"), F.col("a.id") == F.col("b.id")).where(F.col("a.a") > F.col("b.b"))
    return j.select("a.id", (F.col("a.a") + F.col("b.b")).alias("total"), F.concat("a.str", "b.name").alias("text"))


@query("SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 7")
def join_global(t):
    return joins.global_join(t("orders"), t("customer").where("c_nationkey = 7"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_mktsegment")


@query("SELECT a.id, count(*) AS n FROM mock_a a JOIN mock_b b ON a.id = b.id GROUP BY a.id")
def join_colocated(t):
    # Both tables are written in buckets of the shard key; join and grouping by it then need no shuffle.
    a, b = (_bucketed(t(name).select("id"), name) for name in ("mock_a", "mock_b"))
    return a.hint("merge").join(b, "id").groupBy("id").agg(F.count(F.lit(1)).alias("n"))


def _bucketed(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, f"bucketed-{name}")
    return joins.write_bucketed(df, path.rsplit("/", 1)[1].replace("-", "_"), ["id"], 8, path)


@query("SELECT a.id, b.b FROM mock_a a JOIN mock_b b ON a.id = b.id WHERE a.id = 32")
def join_transitive(t):
    return t("mock_a").alias("a").join(t("mock_b").alias("b"), F.col("a.id") == F.col("b.id")).where("a.id = 32").select("a.id", "b.b")


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def join_guarded(t):
    return joins.guard_rows(t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name"), 32768)


# ---- aggregates ----------------------------------------------------------------------------------------------------


@query(
    f"""SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum({MONEY('l_quantity')}) AS DOUBLE) AS qty,
    CAST(sum({MONEY('l_extendedprice')}) AS DOUBLE) AS price, min(l_shipdate) AS first, max(l_shipdate) AS last,
    round(CAST(sum({MONEY('l_quantity')}) AS DOUBLE) / count(l_quantity), 4) AS avg_qty FROM lineitem GROUP BY l_returnflag, l_linestatus"""
)
def agg_sum_count_min_max_avg(t):
    qty = exact(F.sum(money("l_quantity")))
    return t("lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), qty.alias("qty"), exact(F.sum(money("l_extendedprice"))).alias("price"), F.min("l_shipdate").alias("first"),
        F.max("l_shipdate").alias("last"), F.round(qty / F.count("l_quantity"), 4).alias("avg_qty"),
    )


@query(
    """SELECT c, count(DISTINCT a) AS n, CAST(sum(DISTINCT a) AS BIGINT) AS total, min(DISTINCT a) AS low, max(DISTINCT a) AS high,
    round(avg(DISTINCT a), 6) AS mean FROM mock_a GROUP BY c"""
)
def agg_distinct(t):
    return t("mock_a").groupBy("c").agg(F.count_distinct("a").alias("n"), F.sum_distinct("a").alias("total"), F.min("a").alias("low"), F.max("a").alias("high"), F.round(F.expr("avg(DISTINCT a)"), 6).alias("mean"))


@query("SELECT count(*) AS n, CAST(sum(a) AS BIGINT) AS total, min(a) AS low, avg(a) AS mean, any_value(name) AS name FROM mock_a WHERE id < 0")
def agg_empty(t):
    return t("mock_a").where("id < 0").agg(F.count(F.lit(1)).alias("n"), F.sum("a").alias("total"), F.min("a").alias("low"), F.avg("a").alias("mean"), F.any_value("name").alias("name"))


@query("SELECT round(avg(a + 1), 6) AS plus, round(avg(c * 100), 6) AS times, CAST(sum(a - b) AS BIGINT) AS gap FROM mock_a")
def agg_expr(t):
    return t("mock_a").agg(F.round(F.avg(F.col("a") + 1), 6).alias("plus"), F.round(F.avg(F.col("c") * 100), 6).alias("times"), F.sum(F.col("a") - F.col("b")).alias("gap"))


@query("SELECT c + d AS cd, count(*) AS n FROM mock_a GROUP BY c + d")
def agg_group_alias(t):
    return t("mock_a").groupBy((F.col("c") + F.col("d")).alias("cd")).agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""SELECT c_mktsegment, count(DISTINCT o_custkey) AS customers, CAST(sum({MONEY('o_totalprice')}) AS DOUBLE) AS total
    FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment"""
)
def agg_over_join(t):
    j = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    return j.groupBy("c_mktsegment").agg(F.count_distinct("o_custkey").alias("customers"), exact(F.sum(money("o_totalprice"))).alias("total"))


@query("SELECT round(avg(a) * 1000, 3) AS m, round(avg(b), 0) AS r FROM mock_a")
def agg_in_expr(t):
    return t("mock_a").agg(F.round(F.avg("a") * 1000, 3).alias("m"), F.round(F.avg("b"), 0).alias("r"))


@query("SELECT c, bit_and(a) AS low_bits, bit_or(a) AS bits, round(stddev_samp(a), 6) AS dev FROM mock_a WHERE a IS NOT NULL AND c IS NOT NULL GROUP BY c")
def agg_other(t):
    return t("mock_a").where("a IS NOT NULL AND c IS NOT NULL").groupBy("c").agg(F.bit_and("a").alias("low_bits"), F.bit_or("a").alias("bits"), F.round(F.stddev_samp("a"), 6).alias("dev"))


@query("SELECT c AS kind, count(*) AS n FROM mock_a GROUP BY c HAVING c > 3")
def having_col(t):
    return t("mock_a").groupBy(F.col("c").alias("kind")).agg(F.count(F.lit(1)).alias("n")).where("kind > 3")


@query("SELECT name, count(*) AS n FROM mock_a GROUP BY name HAVING count(*) > 20 AND min(a) < 100")
def having_agg(t):
    return t("mock_a").groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("a").alias("low")).where("n > 20 AND low < 100").drop("low")


@query("SELECT DISTINCT c, d FROM mock_a")
def select_distinct(t):
    return t("mock_a").select("c", "d").distinct()


@query("SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
def group_concat(t):
    return t("nation").groupBy("n_regionkey").agg(aggregates.group_concat(F.col("n_name")).alias("names"))


@query("SELECT n_regionkey, count(*) AS n, min(n_regionkey) AS bare FROM nation GROUP BY n_regionkey")
def agg_loose_group_by(t):
    rows = t("nation").withColumn("bare", F.col("n_regionkey"))
    return aggregates.loose_group_by(rows, ["n_regionkey"], {"n": F.count(F.lit(1))}, ["bare"])


@query("SELECT c, d, count(*) AS n, grouping(c) AS all_c FROM mock_a GROUP BY ROLLUP (c, d)")
def agg_rollup(t):
    return t("mock_a").rollup("c", "d").agg(F.count(F.lit(1)).alias("n"), F.grouping("c").cast("long").alias("all_c"))


@query("SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey")
def agg_group_shard_key(t):
    return t("lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))


# ---- sorts, limits, windows ----------------------------------------------------------------------------------------


@query("SELECT c_nationkey, c_acctbal, c_custkey FROM customer ORDER BY c_nationkey, c_acctbal DESC, c_custkey")
def order_multi(t):
    return ordering.order_by(t("customer").select("c_nationkey", "c_acctbal", "c_custkey"), "c_nationkey", ("c_acctbal", "desc"), "c_custkey")


@query("SELECT c_name FROM customer ORDER BY c_acctbal, c_custkey LIMIT 25")
def order_hidden_col(t):
    return ordering.order_by(t("customer"), "c_acctbal", "c_custkey").select("c_name").limit(25)


@query("SELECT id, a FROM mock_a ORDER BY a ASC NULLS FIRST, id LIMIT 40")
def order_nulls(t):
    return ordering.limit(ordering.order_by(t("mock_a").select("id", "a"), "a", "id"), 40)


@query("SELECT id, a FROM mock_a ORDER BY a DESC NULLS LAST, id LIMIT 40")
def order_nulls_desc(t):
    return ordering.limit(ordering.order_by(t("mock_a").select("id", "a"), ("a", "desc"), "id"), 40)


@query("SELECT id, c + d AS cd FROM mock_a ORDER BY c + d NULLS FIRST, id LIMIT 30")
def order_expr(t):
    rows = t("mock_a").select("id", (F.col("c") + F.col("d")).alias("cd"))
    return ordering.limit(ordering.order_by(rows, "cd", "id"), 30)


@query("SELECT c_name FROM customer ORDER BY c_acctbal, c_custkey")
def order_hidden_col_whole(t):
    return ordering.order_by(t("customer"), "c_acctbal", "c_custkey").select("c_name")


@query("SELECT id, a FROM mock_a ORDER BY a ASC NULLS FIRST, id")
def order_nulls_whole(t):
    return ordering.order_by(t("mock_a").select("id", "a"), "a", "id")


@query("SELECT id, a FROM mock_a ORDER BY a DESC NULLS LAST, id")
def order_nulls_desc_whole(t):
    return ordering.order_by(t("mock_a").select("id", "a"), ("a", "desc"), "id")


@query("SELECT id, c + d AS cd FROM mock_a ORDER BY c + d NULLS FIRST, id")
def order_expr_whole(t):
    return ordering.order_by(t("mock_a").select("id", (F.col("c") + F.col("d")).alias("cd")), "cd", "id")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5")
def limit_offset(t):
    return ordering.limit(ordering.order_by(t("orders").select("o_orderkey", "o_totalprice"), ("o_totalprice", "desc"), "o_orderkey"), 10, 5)


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey LIMIT 10")
def topk(t):
    rows = ordering.order_by(t("lineitem"), ("l_extendedprice", "desc"), "l_orderkey", "l_linenumber", "l_partkey")
    return ordering.limit(rows, 10).select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey ORDER BY o_custkey LIMIT 10")
def group_limit_implicit_order(t):
    return ordering.limit(ordering.order_by(t("orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")), "o_custkey"), 10)


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders")
def window_rank(t):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return t("orders").select("o_orderkey", F.row_number().over(w).alias("rn"))


# ---- set operations ------------------------------------------------------------------------------------------------


@query("SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region UNION ALL SELECT r_name FROM region")
def union_all(t):
    return ordering.union(t("nation").select(F.col("n_name").alias("name")), t("region").select("r_name"), t("region").select("r_name"), distinct=False)


@query("SELECT c, d FROM mock_a UNION SELECT a, b FROM mock_b")
def union_distinct(t):
    return ordering.union(t("mock_a").select("c", "d"), t("mock_b").select("a", "b"))


@query(
    """(SELECT n_name AS name FROM nation WHERE n_regionkey = 1 UNION SELECT r_name FROM region)
    UNION ALL (SELECT c_name FROM customer ORDER BY c_custkey LIMIT 3)"""
)
def union_nested(t):
    inner = ordering.union(t("nation").where("n_regionkey = 1").select(F.col("n_name").alias("name")), t("region").select("r_name"))
    return ordering.union(inner, t("customer").orderBy("c_custkey").limit(3).select("c_name"), distinct=False)


@query("SELECT r_regionkey AS id, r_name AS name FROM region UNION SELECT 5, 'lang'")
def union_const(t):
    row = t("region").sparkSession.range(1).select(F.lit(5).alias("id"), F.lit("lang").alias("name"))
    return ordering.union(t("region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name")), row)


@query("SELECT n_name AS name FROM nation UNION SELECT r_name FROM region ORDER BY name DESC LIMIT 7")
def union_order_limit(t):
    u = ordering.union(t("nation").select(F.col("n_name").alias("name")), t("region").select("r_name"))
    return ordering.limit(ordering.order_by(u, ("name", "desc")), 7)


@query("SELECT 'ab' AS a, 'c' AS b UNION SELECT 'a', 'bc' UNION SELECT '', NULL UNION SELECT NULL, ''")
def union_true_equality(t):
    spark = t("region").sparkSession
    rows = [spark.range(1).select(F.lit(a).cast("string").alias("a"), F.lit(b).cast("string").alias("b")) for a, b in (("ab", "c"), ("a", "bc"), ("", None), (None, ""))]
    return ordering.union(*rows)


@query("SELECT id FROM mock_a INTERSECT SELECT id FROM mock_b")
def set_intersect(t):
    return t("mock_a").select("id").intersect(t("mock_b").select("id"))


@query("SELECT id FROM mock_b EXCEPT SELECT id FROM mock_a")
def set_except(t):
    return t("mock_b").select("id").subtract(t("mock_a").select("id"))


# ---- functions -----------------------------------------------------------------------------------------------------


@query("SELECT id, name || '-' || str AS joined, coalesce(name, str, 'none') AS first, CASE WHEN a > 100 THEN 'big' ELSE 'small' END AS kind FROM mock_a")
def fn_concat_coalesce_if(t):
    kind = F.expr("if(a > 100, 'big', 'small')")
    return t("mock_a").select("id", F.concat("name", F.lit("-"), "str").alias("joined"), F.coalesce("name", "str", F.lit("none")).alias("first"), kind.alias("kind"))


@query("SELECT id, ifnull(a, -1) AS a, CAST(id AS VARCHAR) AS text, CAST(score AS BIGINT) AS score, CAST(TIMESTAMP '2024-02-03 04:05:06' AS DATE) AS day FROM mock_a")
def fn_ifnull_cast(t):
    day = F.lit("2024-02-03 04:05:06").cast("timestamp_ntz").cast("date")
    return t("mock_a").select("id", F.ifnull("a", F.lit(-1)).alias("a"), F.col("id").cast("string").alias("text"), M.to_signed(F.col("score")).alias("score"), day.alias("day"))


@query("SELECT id, abs(e) AS e, round(score / 7, 3) AS part, strlen(title) AS bytes, length(title) AS chars FROM (SELECT m.id, m.e, m.score, t.title FROM mock_a m LEFT JOIN articles t ON m.id = t.id)")
def fn_abs_round_length(t):
    j = t("mock_a").alias("m").join(t("articles").alias("t"), F.col("m.id") == F.col("t.id"), "left")
    return j.select("m.id", F.abs("m.e").alias("e"), F.round(F.col("m.score") / 7, 3).alias("part"), M.length(F.col("t.title")).alias("bytes"), F.length("t.title").alias("chars"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%y-%m-%d') AS day, strftime(o_orderdate, '%d/%m/%Y at %H:%M') AS text FROM orders")
def fn_date_format(t):
    return t("orders").select("o_orderkey", M.date_format(F.col("o_orderdate"), "%y-%m-%d").alias("day"), M.date_format(F.col("o_orderdate"), "%d/%m/%Y at %H:%i").alias("text"))


@query("SELECT event_id, ts + INTERVAL '26 hours 3 minutes 4 seconds' AS later FROM events")
def fn_addtime(t):
    return t("events").select("event_id", M.addtime(F.col("ts"), "1 2:03:04").alias("later"))


@query("SELECT id, a & 6 AS both, a | 1 AS either, xor(a, 3) AS one, a << 2 AS up FROM mock_a WHERE a >= 0")
def fn_bitops(t):
    a = F.col("a")
    return t("mock_a").where("a >= 0").select("id", a.bitwiseAND(6).alias("both"), a.bitwiseOR(1).alias("either"), a.bitwiseXOR(3).alias("one"), F.shiftleft(a, 2).alias("up"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def fn_json_get(t):
    return t("events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@query("SELECT id, name FROM mock_a WHERE lower(name) = lower('GO')")
def fn_collation(t):
    return t("mock_a").where(M.same_text(F.col("name"), F.lit("GO"))).select("id", "name")


@query("SELECT id FROM articles WHERE contains(lower(coalesce(title, '')), 'einhof') OR contains(lower(coalesce(body, '')), 'einhof') OR contains(lower(coalesce(title, '')), 'konver') OR contains(lower(coalesce(body, '')), 'konver')")
def fulltext_match(t):
    return t("articles").where(M.match_against([F.col("title"), F.col("body")], "einhof konver")).select("id")


FLAGSHIP_SQL = f"""
    SELECT n_name, o_orderpriority, count(*) AS n, CAST(sum({MONEY('l_extendedprice')}) AS DOUBLE) AS price,
        round(CAST(sum({MONEY('l_quantity')}) AS DOUBLE) / count(l_quantity), 4) AS avg_qty
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    WHERE o_orderdate >= TIMESTAMP '1995-01-01' GROUP BY n_name, o_orderpriority ORDER BY price DESC, n_name, o_orderpriority LIMIT 50"""


@query(FLAGSHIP_SQL)
def flagship(t):
    orders = t("orders").where(F.col("o_orderdate") >= F.lit("1995-01-01").cast("timestamp_ntz")).select("o_orderkey", "o_custkey", "o_orderpriority")
    customers = t("customer").join(joins.small(t("nation")), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    rows = t("lineitem").select("l_orderkey", "l_extendedprice", "l_quantity").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey"))
    qty = exact(F.sum(money("l_quantity"))) / F.count("l_quantity")
    grouped = rows.groupBy("n_name", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), exact(F.sum(money("l_extendedprice"))).alias("price"), F.round(qty, 4).alias("avg_qty"))
    return ordering.limit(ordering.order_by(grouped, ("price", "desc"), "n_name", "o_orderpriority"), 50)
