"""Dialect, strict mode, placement, data changes, change capture, engine and sources."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shardloom.engine import Engine, EngineError
from shardloom.functions import mysql as M
from shardloom.functions.slots import crc64, slot, slot_of
from shardloom.lineage import cut, release, scratch, scratch_path, shared_folder
from shardloom.operators import aggregates, dml, joins, ordering
from shardloom.plans import placement as P
from shardloom.plans import strict
from shardloom.plans.catalog import CatalogError, Conflict, check_shard_key
from shardloom.plans.dialect import hints, to_spark
from shardloom.plans.explain import explain_json
from shardloom.plans.lexer import SyntaxProblem, text_of, tokenize, tree
from shardloom.plans.pruning import literals, segments_of
from shardloom.session import register_tables
from shardloom.sources import files
from shardloom.streaming import cdc


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# ---- golden cases of joins, unions and aggregates ------------------------------------------------------------------


@pytest.fixture(scope="module")
def small(spark):
    table(spark, [(3, "go"), (4, "lang"), (6, "lang"), (5, "nice"), (6, "nil")], "id int, name string").createOrReplaceTempView("A5")
    table(spark, [(3,), (4,), (5,)], "id int").createOrReplaceTempView("A3")
    table(spark, [("go", 3), ("lang", 5)], "name string, id int").createOrReplaceTempView("B")
    return spark


@pytest.mark.parametrize(
    ("mysql", "want"),
    [
        ("select A.id, B.name from A3 A right join B on A.id = B.id where A.id > 2", {(3, "go"), (5, "lang")}),
        ("select A.id, B.name from A3 A join B on A.id = B.id where A.id > 2 order by A.id limit 1", {(3, "go")}),
        ("select A.id, B.name from A3 A left join B on A.id = B.id and B.name = 's' where A.id > 2", {(3, None), (4, None), (5, None)}),
        ("select A.id, A.name, B.id, B.name, A.id > 2 as c from A5 A join B on A.name = B.name and A.id >= B.id and A.id > B.id", {(6, "lang", 5, "lang", 1)}),
        ("select A.id, A.name, B.id from A5 A left join B on A.name = B.name and A.id >= B.id and A.name <=> B.name and A.id > 2 where B.name is null", {(4, "lang", None), (5, "nice", None), (6, "nil", None)}),
        ("select id, name from A5 where id = 3 union select 5, 'lang' union select 5, 'lang'", {(3, "go"), (5, "lang")}),
    ],
)
def test_golden(small, mysql, want):
    assert {tuple(r) for r in small.sql(to_spark(mysql)).collect()} == want


def test_golden_aggregates(spark):
    scores = table(spark, [(3,), (7,), (3,), (7,)], "score int")
    row = scores.agg(F.sum("score"), F.min("score"), F.max("score"), F.sum_distinct("score"), F.count_distinct("score")).first()
    assert tuple(row) == (20, 3, 7, 10, 2)
    assert table(spark, [(3,), (3,), (3,), (13,)], "s int").agg(F.expr("avg(distinct s)")).first()[0] == 8.0


# ---- dialect -------------------------------------------------------------------------------------------------------


def test_dialect_text():
    assert to_spark("SELECT a FROM t LIMIT 5, 10") == "SELECT a FROM t LIMIT 10 OFFSET 5"
    assert to_spark("select straight_join a.x from a straight_join b on a.x = b.x") == "SELECT a.x FROM a JOIN b on a.x = b.x"
    assert "CAST(a AS BIGINT)" in to_spark("select cast(a as signed) from t")
    assert "octet_length(b)" in to_spark("select length(b) from t")
    assert "any_value(b)" in to_spark("select sum(a), b from t")
    assert "any_value" not in to_spark("select sum(a), B from t group by b")
    assert hints("select /*+ streaming loadbalance=1 */ a from t") == {"streaming": "", "loadbalance": "1"}
    assert "make_dt_interval(1, 2, 3, 4.0)" in to_spark("select addtime(x, '1 02:03:04') from t")


def test_dialect_results(spark):
    def one(text):
        from shardloom.session import register_dual

        register_dual(spark)
        return tuple(spark.sql(to_spark(text)).first())

    assert one("select 1 or 0, 0 and 1, not 1, 1 xor 1, 2 > 1, null and 1") == (1, 0, 0, 0, 1, None)
    assert one("select 0x12, 7 div 2, 7 mod 2, \"it's\" from dual") == (bytearray(b"\x12"), 3, 1, "it's")
    assert one("select length('数'), if(1 = 1, 'a', 'b'), ifnull(null, 3), concat('a', null)") == (3, "a", 3, None)
    assert one("select date_format(cast('2024-02-03 14:05:06' as datetime), '%Y/%m/%d %H:%i:%s o''clock %y')") == ("2024/02/03 14:05:06 o'clock 24",)


def test_date_pattern_refuses_unknown_letters():
    assert M.date_pattern("%d.%m.%Y") == "dd.MM.yyyy"
    with pytest.raises(ValueError, match="%D"):
        M.date_pattern("%D")


def test_unsigned_and_time(spark):
    row = spark.range(1).select(M.to_unsigned(F.lit(-1)), M.addtime(F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), "-00:00:01.5").cast("string")).first()
    assert int(row[0]) == 2**64 - 1
    assert row[1] == "2023-12-31 23:59:58.5"


def test_fulltext(spark):
    df = table(spark, [(1, "分布式数据库", None), (2, None, "no"), (3, "x", "数据库 tables")], "id int, title string, body string")
    assert [r.id for r in df.where(M.match_against([F.col("title"), F.col("body")], "数据库")).orderBy("id").collect()] == [1, 3]


words = st.sampled_from(["select", "a", "`b c`", "'x''y'", '"q"', "1.5", "0x1F", "(", ")", ",", "<=>", "<=", "=", "and", "from", "t", "/* no */", "-- no\n", "@@v", "."])


@given(st.lists(words, max_size=25))
@settings(max_examples=150, deadline=None)
def test_text_survives_being_parsed_and_printed(parts):
    tokens = tokenize(" ".join(parts))
    try:
        nodes = tree(tokens)
    except SyntaxProblem:
        return
    assert [t.text for t in tokenize(text_of(nodes))] == [t.text for t in tokens]


# ---- strict mode ---------------------------------------------------------------------------------------------------

SHARDS = {
    "T": P.hash_layout("T", "id", ["b1", "b2"]), "U": P.hash_layout("U", "id", ["b1", "b2", "b3"]),
    "G": P.global_layout("G", ["b1", "b2"]), "S": P.single_layout("S", "b1"), "L": P.list_layout("L", "k", {"b1": ["1", "3"], "b2": ["2"]}),
}


def lookup(db, name):
    if name not in SHARDS:
        raise CatalogError(f"Table '{name}' doesn't exist (errno 1146) (sqlstate 42S02)")
    return SHARDS[name]


@pytest.mark.parametrize(
    ("mysql", "message"),
    [
        ("select x from T where x in (select y from U)", "unsupported: subqueries.in.select"),
        ("select d.x from (select x from T) d", "unsupported: subquery.in.select"),
        ("select * from T join U on T.id = U.id", "unsupported: '*'.expression.in.cross-shard.query"),
        ("select id from T limit n", "unsupported: limit.offset.or.counts.must.be.IntVal"),
        ("select x, count(*) from T group by x having count(*) > 5", "unsupported: expr[count(*)].in.having.clause"),
        ("select group_concat(x) from T", "unsupported: group_concat.in.select.exprs"),
        ("select x from T order by x + 2", "unsupported: orderby:[x + 2].type.should.be.colname"),
        ("select T.x from T natural join U", "unsupported: join.type:natural join"),
        ("select T.x from T join U on T.id = U.id and y = 4", "unsupported: unknown.column.'y'.in.clause"),
        ("select abs(U.x) from T left join U on T.y = U.y", "unsupported: expr.'abs(U.x)'.in.cross-shard.left.join"),
        ("select T.x from T, T", "unsupported: not.unique.table.or.alias:'T'"),
        ("select x from Nope", "Table 'Nope' doesn't exist (errno 1146) (sqlstate 42S02)"),
        ("select T.x from T where T.id = 0x1f", "hash.unsupported.key.type:[3]"),
    ],
)
def test_strict_refuses(mysql, message):
    with pytest.raises(ValueError) as caught:  # noqa: PT011
        strict.check(mysql, lookup)
    assert str(caught.value) == message


@pytest.mark.parametrize(
    "mysql",
    [
        "select group_concat(x), round(avg(y)) from G having count(*) > 2",
        "select group_concat(x) from T where id = 7",
        "select T.x, sum(U.y) from T join U on T.id = U.id where T.x > 3 group by T.x order by x limit 5",
        "select x from T union select y from U",
        "select a.x from T a left join U b on a.id = b.id where b.y is null",
    ],
)
def test_strict_accepts(mysql):
    strict.check(mysql, lookup)


# ---- placement -----------------------------------------------------------------------------------------------------


def test_slots(spark):
    assert (slot_of(0), slot_of(1), slot_of(1.9)) == (0, 2323, 2323)
    assert slot_of(-1) == slot_of(2**64 - 1)
    assert crc64(b"123456789") == 0x995DC9BBDF1939FA  # check value of the polynomial
    with pytest.raises(TypeError):
        slot_of(None)
    df = table(spark, [(0, "a"), (1, "b"), (None, None), (-5, "")], "k long, s string").select("k", "s", slot(F.col("k")).alias("x"), slot(F.col("s"), "string").alias("y"))
    for r in df.collect():
        assert r.x == (None if r.k is None else slot_of(r.k))
        assert r.y == (None if r.s is None else slot_of(r.s))


def test_layouts():
    five = P.hash_layout("t", "id", [f"b{i}" for i in range(5)], 32)
    assert [(s.low, s.high) for s in five.segments[:6]] == [(0, 128), (128, 256), (256, 384), (384, 512), (512, 640), (640, 819)]
    assert five.segments[-1].high == 4096
    assert len(P.hash_layout("t", "id", ["b1"]).segments) == 64
    assert five.segment_of(1).low <= 2323 < five.segment_of(1).high
    for bad in (lambda: P.hash_layout("t", "id", ["b"], 7), lambda: P.hash_layout("", "id", ["b"]), lambda: P.hash_layout("t", "id", []), lambda: P.list_layout("t", "k", {"a": ["1"], "b": ["1"]})):
        with pytest.raises(P.PlacementError):
            bad()
    with pytest.raises(P.PlacementError, match="Table has no partition for value 9"):
        SHARDS["L"].segment_of(9)
    assert P.same_layout(SHARDS["T"], P.hash_layout("V", "x", ["b1", "b2"]))
    assert not P.same_layout(SHARDS["T"], SHARDS["U"])


def test_list_rows_without_partition_fail(spark):
    good = table(spark, [(1,), (3,), (2,)], "k int")
    assert P.check_rows(good, SHARDS["L"]).count() == 3
    for bad in (table(spark, [(4,)], "k int"), table(spark, [(None,)], "k int")):
        with pytest.raises(Exception, match="no partition"):
            P.check_rows(bad, SHARDS["L"]).collect()


def test_pruned_read_opens_only_its_folders(spark, tmp_path):
    df = spark.range(2000).withColumnRenamed("id", "id")
    P.write_sharded(df, f"{tmp_path}/t", SHARDS["T"])
    pruned = P.read_pruned(spark.read.parquet(f"{tmp_path}/t"), SHARDS["T"], [5, 6])
    assert sorted(r.id for r in pruned.collect()) == [5, 6]
    plan = pruned._jdf.queryExecution().executedPlan().toString()
    assert "_shard" in plan.split("PartitionFilters: ")[1].split("]")[0]
    assert pruned.select("_metadata.file_path").distinct().count() <= 2


def test_pruning_by_conditions():
    one = segments_of("select x from T where id = 1 and y > 2", lookup)["T"]
    assert [s.low <= 2323 < s.high for s in one] == [True]
    assert len(segments_of("select x from T where id in (0, 1)", lookup)["T"]) == 2
    assert len(segments_of("select x from T where (id = 0 or 1 = id)", lookup)["T"]) == 2
    assert len(segments_of("select x from T where id = 0 or y = 1", lookup)["T"]) == len(SHARDS["T"].segments)
    assert len(segments_of("select x from L where k = 2", lookup)["L"]) == 1
    both = segments_of("select T.x from T join U on T.id = U.id where T.id = 1", lookup)
    assert [len(s) for s in both.values()] == [1, 1]  # the equal key is pinned with it
    assert len(segments_of("select T.x from T left join U on T.id = U.id where U.id = 1", lookup)["T"]) == 64


def test_explain():
    plan = json.loads(explain_json("select sum(x), y from T where id = 1 group by y order by y desc limit 3, 4", lookup))
    assert plan["Project"] == "sum(x), y"
    assert (plan["Aggregate"], plan["HashGroupBy"], plan["GatherMerge"], plan["Limit"]) == (["sum(x)"], ["y"], ["y"], {"Offset": 3, "Limit": 4})
    assert len(plan["Partitions"]) == 1


def test_shard_key_rules():
    check_shard_key(["a", "b"], [["A", "b"]], "a")
    with pytest.raises(CatalogError, match="doesn't exist"):
        check_shard_key(["a"], [], "b")
    with pytest.raises(CatalogError, match="only defined on the sharding key"):
        check_shard_key(["a", "b"], [["b"]], "a")


# ---- joins, aggregates, sets ---------------------------------------------------------------------------------------


def test_band_join(spark):
    a = table(spark, [(v,) for v in (0.0, 4.9, 5.0, 17.0, None)], "v double")
    b = table(spark, [(0.0, 5.0), (4.0, 20.0), (30.0, 10.0), (None, 1.0)], "lo double, hi double")
    got = sorted((r.v, r.lo) for r in joins.band_join(a, b, "v", "lo", "hi", 5.0).collect())
    assert got == sorted((v, lo) for v in (0.0, 4.9, 5.0, 17.0) for lo, hi in ((0.0, 5.0), (4.0, 20.0)) if lo <= v <= hi)
    plan = joins.band_join(a, b, "v", "lo", "hi", 5.0)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan


def test_guard_and_small(spark):
    with pytest.raises(joins.TooManyRows):
        joins.guard_rows(spark.range(11), 10)
    assert joins.guard_rows(spark.range(10), 10).count() == 10
    big = spark.range(1 << 40)
    assert "Broadcast" not in spark.range(5).join(joins.small(big), "id").hint("merge")._jdf.queryExecution().optimizedPlan().toString()


def test_colocated_join_does_not_shuffle(spark, data):
    from shardloom.queries import relational

    plan = relational.QUERIES["join_colocated"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan
    assert "Exchange" not in plan
    nulls = joins.write_bucketed(table(spark, [(None,), (1,), (1,)], "id int"), "with_nulls", ["id"], 4, scratch_path(spark, "bucketed"))
    assert sorted(map(tuple, nulls.groupBy("id").count().collect()), key=repr) == [(1, 2), (None, 1)]


def test_union_checks(spark):
    with pytest.raises(ValueError, match="different.number.of.columns"):
        ordering.union(spark.range(1), spark.range(1).selectExpr("id", "id as b"))


def test_checksum_ignores_order_and_tells_nulls(spark):
    a = table(spark, [(1, "x"), (2, None)], "a int, b string")
    assert aggregates.checksum(a).first()[0] == aggregates.checksum(a.orderBy(F.desc("a"))).first()[0]
    assert aggregates.checksum(a).first()[0] != aggregates.checksum(a.fillna("")).first()[0]
    assert aggregates.checksum(a.limit(0)).first()[0] is None


def test_rebalance_advice(spark):
    shards = table(spark, [("t_0000", "b1", 300), ("t_0001", "b1", 90), ("g", "b1", 50), ("t_0002", "b2", 20)], "name string, backend string, size_mb long")
    kinds = table(spark, [("t", "HASH"), ("g", "GLOBAL")], "base string, kind string")
    assert [tuple(r) for r in aggregates.rebalance_advice(shards, kinds).collect()] == [("t_0001", 90, "b1", "b2")]
    assert aggregates.rebalance_advice(shards.where("size_mb < 100"), kinds.limit(0)).collect() == []


# ---- data changes --------------------------------------------------------------------------------------------------


def test_dml_rules(spark):
    t = table(spark, [(1, 10), (2, None), (3, 30)], "a int, b int")
    assert sorted(map(tuple, dml.delete(t, F.col("b") > 20).collect())) == [(1, 10), (2, None)]  # unknown is not true
    assert sorted(map(tuple, dml.update(t, {"B": F.col("b") + F.col("a")}, F.col("a") < 3).collect())) == [(1, 11), (2, None), (3, 30)]
    for bad in (lambda: dml.update(t, {"b": F.lit(1)}, None), lambda: dml.update(t, {"A": F.lit(1)}, F.lit(True), "a"), lambda: dml.upsert(t, t, ["a"], {"a": F.lit(1)}, "a")):
        with pytest.raises(dml.KeyViolation):
            bad()
    assert dml.insert(t, table(spark, [(4,)], "a int")).count() == 4


def test_auto_increment_is_dense_and_keeps_given_numbers(spark):
    rows = table(spark, [(i, None if i % 3 else 1000 + i) for i in range(50)], "k int, n long")
    got = {r.k: r.n for r in dml.auto_increment(rows, "n", 7, ["k"]).collect()}
    assert [got[k] for k in range(50) if k % 3] == list(range(8, 8 + sum(1 for k in range(50) if k % 3)))
    assert all(got[k] == 1000 + k for k in range(0, 50, 3))


# ---- change capture ------------------------------------------------------------------------------------------------


def test_cdc(spark):
    t = table(spark, [(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    log = table(spark, [(1, "x", "update", 1), (1, None, "update", 2), (2, "b", "delete", 1), (4, "n", "insert", 1), (4, "n", "delete", 2), (5, "m", "insert", 1)], "k int, v string, op string, seq int")
    after = cdc.apply_changes(t, log, ["k"])
    assert sorted(map(tuple, after.collect())) == [(1, None), (3, "c"), (5, "m")]
    assert cdc.same_rows(cdc.apply_changes(after, log, ["k"]), after)  # again changes nothing
    assert not cdc.same_rows(t, after)
    with pytest.raises(cdc.SchemaChanged):
        cdc.apply_changes(t, log.withColumn("extra", F.lit(1)), ["k"])


def test_cdc_stream(spark, tmp_path):
    t = table(spark, [(1, "a"), (2, "b")], "k int, v string")
    state = {0: t}
    for n, rows in enumerate(([(1, "z", "update", 1)], [(2, "b", "delete", 2), (3, "c", "insert", 3)])):
        table(spark, rows, "k int, v string, op string, seq int").write.parquet(f"{tmp_path}/log/p{n}")

    def store(df, number):
        df.write.mode("overwrite").parquet(f"{tmp_path}/state{number}")
        state[0] = spark.read.parquet(f"{tmp_path}/state{number}")

    stream = spark.readStream.schema("k int, v string, op string, seq int").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/log")
    cdc.follow(stream, lambda: state[0], store, ["k"], f"{tmp_path}/check").awaitTermination()
    assert sorted(map(tuple, state[0].collect())) == [(1, "z"), (3, "c")]


def test_migration(spark, tmp_path):
    source = table(spark, [(1, "a"), (2, "b")], "k int, v string")
    now = cdc.apply_changes(source, table(spark, [(2, "x", "update", 1), (3, "c", "insert", 2)], "k int, v string, op string, seq int"), ["k"])
    table(spark, [(2, "x", "update", 1), (3, "c", "insert", 2)], "k int, v string, op string, seq int").write.parquet(f"{tmp_path}/log/p0")
    stream = spark.readStream.schema("k int, v string, op string, seq int").option("recursiveFileLookup", "true").parquet(f"{tmp_path}/log")
    moved = cdc.migrate(source, stream, lambda: now, f"{tmp_path}/target", ["k"], wait_s=0)
    assert sorted(map(tuple, moved.collect())) == [(1, "a"), (2, "x"), (3, "c")]
    with pytest.raises(cdc.NotCaughtUp):
        cdc.migrate(source, stream, lambda: source, f"{tmp_path}/other", ["k"], tries=2, wait_s=0)


# ---- engine --------------------------------------------------------------------------------------------------------


@pytest.fixture
def engine(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/root")
    for s in ("create database d", "use d", "create table t (id bigint not null auto_increment primary key, name varchar(10) default 'x', kind enum('a','b'))"):
        e.sql(s)
    return e


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_engine_defaults_keys_and_enum(engine):
    engine.sql("insert into t values (0, 'one', 'a'), (10, default, null)")
    engine.sql("insert into t set kind = 'b'")
    assert rows(engine.sql("select * from t order by id")) == [(1, "one", "a"), (10, "x", None), (11, "x", "b")]
    for text, message in (
        ("insert into t values (10, 'q', 'a')", "Duplicate entry '10'"), ("insert into t (kind) values ('c')", "Data truncated"), ("insert into t values (1)", "Column count"),
        ("select nope from t", "Unknown column 'nope'"), ("select id from T", "Table 'T' doesn't exist"), ("update t set name = 'q'", "missing.where"), ("use nowhere", "Unknown database"),
    ):
        with pytest.raises(ValueError, match=message.replace("(", r"\(")):
            engine.sql(text)
    engine.sql("insert ignore into t values (10, 'q', 'a'), (12, 'r', 'a')")
    assert rows(engine.sql("select name from t where id in (10, 12) order by id")) == [("x",), ("r",)]


def test_engine_transactions_and_persistence(engine, spark):
    engine.sql("insert into t (name) values ('a'), ('b')")
    engine.sql("begin")
    engine.sql("delete from t where name = 'a'")
    with pytest.raises(EngineError, match="DDL"):
        engine.sql("truncate table t")
    with pytest.raises(EngineError):
        engine.sql("begin")
    engine.sql("rollback")
    assert rows(engine.sql("select count(*) from t")) == [(2,)]
    engine.sql("start transaction")
    engine.sql("update t set name = upper(name) where id = 1")
    engine.sql("commit")
    again = Engine(spark, engine.catalog.root)
    assert rows(again.sql("select d.t.name from d.t order by id")) == [("A",), ("b",)]
    with pytest.raises(EngineError, match="read-only"):
        Engine(spark, engine.catalog.root, read_only=True).sql("delete from d.t")


def test_engine_autocommit_off_and_join_guard(engine):
    engine.sql("set autocommit = 0")
    engine.sql("insert into t (name) values ('a'), ('b'), ('c')")
    engine.sql("rollback")
    assert rows(engine.sql("select count(*) from t")) == [(0,)]
    engine.sql("insert into t (name) values ('a'), ('b'), ('c')")
    engine.sql("commit")
    assert rows(engine.sql("select count(*) from t")) == [(3,)]
    engine.max_join_rows = 5
    assert len(rows(engine.sql("select a.id from t a join t b on a.id = b.id"))) == 3
    with pytest.raises(joins.TooManyRows):
        engine.sql("select a.id from t a, t b")


def test_engine_definitions(engine):
    engine.sql("insert into t (name) values ('a')")
    engine.sql("alter table t add column n int default 5")
    engine.sql("alter table t modify column n bigint")
    engine.sql("create index i on t (n)")
    engine.sql("rename table t to u")
    engine.sql("create table t (a int, b int) partition by hash(a) partitions 8")
    assert rows(engine.sql("select id, name, n from u")) == [(1, "a", 5)]
    assert rows(engine.sql("show tables")) == [("t",), ("u",)]
    assert [r[0] for r in rows(engine.sql("desc u"))] == ["id", "name", "kind", "n"]
    assert rows(engine.sql("desc u n"))[0][1] == "bigint"
    assert "PARTITION BY HASH (a)" in rows(engine.sql("show create table t"))[0][1]
    assert len(engine.table("t").placement.segments) == 8
    with pytest.raises(EngineError, match="shard.key"):
        engine.sql("alter table t drop column a")
    engine.sql("drop table t")
    assert rows(engine.sql("select count(*) from u")) == [(1,)]


def test_engine_commands(engine):
    engine.sql("insert into t (name) values ('a'), ('b')")
    assert rows(engine.sql("check table t"))[0][3] == "OK"
    before = rows(engine.sql("checksum table t, missing"))
    engine.sql("optimize table t")
    assert rows(engine.sql("checksum table t, missing")) == before
    assert before[1] == ("d.missing", None)
    assert rows(engine.sql("show table status"))[0][:2] == ("t", 2)
    for text in ("show engines", "show charset", "show collation", "show warnings", "show versions", "show processlist", "show status", "show queryz", "show txnz", "show databases like 'd%'", "show index from t", "show columns from t", "show create database d", "help", "do 1", "set autocommit = 0", "kill 5", "admin rebalance"):
        engine.sql(text).collect()
    assert rows(engine.sql("show variables like 'autocommit'")) == [("autocommit", "0")]
    assert rows(engine.sql("select @@version_comment limit 1")) == [("shardloom",)]
    assert [r.name for r in engine.fetch("select /*+ streaming */ name from t order by name")] == ["a", "b"]
    assert rows(engine.sql("select name from t where id = ? and name = ?", [1, "a"])) == [("a",)]
    engine.sql("admin reshard t to t2")
    assert rows(engine.sql("select count(*) from t2")) == [(2,)]
    engine.strict = True
    with pytest.raises(ValueError, match="group_concat"):
        engine.sql("select group_concat(name) from t")


# ---- sources -------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("fmt", ["parquet", "orc", "csv", "json"])
def test_round_trip(spark, tmp_path, fmt):
    df = table(spark, [(1, "a"), (2, None), (3, "c, 'd'")], "k int, v string")
    files.store(df, f"{tmp_path}/x", fmt, rows_per_file=2)
    back = files.load(spark, f"{tmp_path}/x", fmt, "k int, v string")
    assert cdc.same_rows(df, back)


def test_sources_rules(spark, data):
    with pytest.raises(ValueError, match="schema"):
        files.load(spark, data, "csv")
    with pytest.raises(ValueError, match="format"):
        files.load(spark, data, "xml")
    assert list(files.fetch(spark.range(3))) == list(spark.range(3).collect())
    assert {"nation", "audit"} <= set(register_tables(spark, data))
    assert spark.sql("select count(*) from nation, dual").first()[0] == 25


# ---- engine: changes that lose nothing, segments, keys -------------------------------------------------------------


def test_two_connections_never_overwrite_each_other(engine, spark):
    other = Engine(spark, engine.catalog.root)
    other.sql("use d")
    engine.sql("begin")
    engine.sql("insert into t (id, name) values (100, 'a')")
    other.sql("insert into t (id, name) values (200, 'b')")
    with pytest.raises(Conflict, match="another connection"):
        engine.sql("commit")
    assert rows(engine.sql("select id from t")) == rows(other.sql("select id from t")) == [(200,)]
    engine.sql("insert into t (id, name) values (100, 'a')")
    assert rows(other.sql("select id from t order by id")) == [(100,), (200,)]
    stale = engine.table("t")
    other.sql("delete from t where id = 100")
    with pytest.raises(Conflict):
        engine.catalog.save(stale)
    other.sql("drop table t")
    other.sql("create table t (id bigint primary key)")
    assert rows(engine.sql("select * from t")) == []


def test_a_running_query_keeps_its_snapshot(engine):
    engine.sql("insert into t (id) values (1), (2)")
    before = engine.sql("select id from t order by id")
    engine.sql("delete from t where id = 1")
    engine.sql("optimize table t")
    assert rows(before) == [(1,), (2,)]
    engine.sql("admin cleanup 0")
    assert rows(engine.sql("select id from t")) == [(2,)]


def test_update_and_delete_with_limit(engine):
    engine.sql("create table u (id int primary key, v int) single")
    engine.sql("insert into u values (1, 1), (2, 1), (3, 1), (4, null)")
    assert rows(engine.sql("update u set v = 9 where v = 1 order by id desc limit 2")) == [(2,)]
    assert rows(engine.sql("select v from u order by id")) == [(1,), (9,), (9,), (None,)]
    assert rows(engine.sql("update u set v = 7 where v > 1 limit 0")) == [(0,)]
    assert rows(engine.sql("delete from u where v = 9 order by id limit 1")) == [(1,)]
    assert rows(engine.sql("select id from u order by id")) == [(1,), (3,), (4,)]
    with pytest.raises(EngineError, match="Duplicate entry '5'"):
        engine.sql("update u set id = 5 where id < 4")
    engine.strict = True
    with pytest.raises(EngineError, match=r"unsupported: limit\.and\.order\.in\.update"):
        engine.sql("update u set v = 1 where id = 1 limit 1")


def test_upsert_applies_rows_in_order_over_all_keys(engine):
    engine.sql("create table u (a int, b int, v int, unique key (a), unique key second (b)) single")
    engine.sql("insert into u values (1, 10, 1), (null, 20, 2), (3, null, 3)")
    put = "insert into u values {} on duplicate key update v = v + values(v)"
    assert rows(engine.sql(put.format("(null, null, 5), (null, null, 6)"))) == [(2,)]
    assert rows(engine.sql(put.format("(1, 99, 100), (7, 20, 200), (7, 77, 300), (8, 77, 400), (8, 78, 500)"))) == [(2 + 2 + 1 + 2 + 1,)]
    got = sorted(rows(engine.sql("select * from u")), key=repr)
    assert got == sorted([(1, 10, 101), (None, 20, 202), (3, None, 3), (None, None, 5), (None, None, 6), (7, 77, 700), (8, 78, 500)], key=repr)
    assert rows(engine.sql("insert ignore into u values (1, 500, 0), (9, 500, 1), (9, 501, 2), (10, 500, 3)")) == [(1,)]
    assert rows(engine.sql("select v from u where a = 9")) == [(1,)]
    # A later row of a REPLACE takes the place of earlier ones, and these still take the place of older rows.
    assert rows(engine.sql("replace into u values (1, 600, 1), (2, 600, 2)")) == [(4,)]
    assert rows(engine.sql("select a, v from u where a in (1, 2)")) == [(2, 2)]
    with pytest.raises(EngineError, match="Duplicate entry"):
        engine.sql("insert into u values (2, 0, 0), (3, 0, 0) on duplicate key update b = 77")


def brute_upsert(table, new, unique):
    for n in new:
        hit = None
        for k in unique:
            hit = next((r for r in table if None not in [n[c] for c in k] and [r[c] for c in k] == [n[c] for c in k]), None) if hit is None else hit
        if hit is None:
            table.append(list(n))
        else:
            hit[2] = (hit[2] * 3 + n[2]) % 1009
    return sorted(map(tuple, table), key=repr)


@pytest.mark.parametrize("unique", [[[0]], [[0], [1]]])
@pytest.mark.parametrize("most", [3, 1000])
def test_merge_in_order_against_brute_force(spark, monkeypatch, unique, most):
    import random

    monkeypatch.setattr(dml, "IN_ORDER", most)
    monkeypatch.setattr(dml, "IN_ORDER_MANY_KEYS", most)
    rng = random.Random(most)
    old = [[a, 100 + a if a % 2 else None, a] for a in range(0, 20)]
    new = [(rng.choice([None, *range(15, 30)]), rng.choice([None, *range(100, 125)]), rng.randrange(100)) for _ in range(40)]
    names = ["a", "b", "v"]
    frame = table(spark, [tuple(r) for r in old], "a int, b int, v int")
    given = table(spark, [(*r, i) for i, r in enumerate(new)], "a int, b int, v int, place long")
    got = dml.merge_in_order(frame, given, [[names[c] for c in k] for k in unique], "place", {"v": "(t.v * 3 + n.v) % 1009"}, "n_")
    assert sorted(map(tuple, got.drop("n_").collect()), key=repr) == brute_upsert(old, new, unique)


def test_dml_special_cases(spark):
    empty = table(spark, [], "a int, b int")
    new = table(spark, [(1, 2, 0), (1, 3, 1), (None, 4, 2), (None, 5, 3)], "a int, b int, p long")
    merged = dml.merge_in_order(empty, new, [["a"]], "p", {"b": "t.b + n.b"}, "affected")
    assert sorted(map(tuple, merged.collect()), key=repr) == sorted([(1, 5, 3), (None, 4, 1), (None, 5, 1)], key=repr)
    clash = table(spark, [(1, 2, 3)], "_group int, _new int, _held int")
    more = table(spark, [(1, 9, 1, 0), (4, 2, 2, 1)], "_group int, _new int, _held int, p long")
    both = dml.merge_in_order(clash, more, [["_group"], ["_new"]], "p", {"_held": "t._held + n._held"}, "_step").collect()
    assert [tuple(r) for r in both] == [(1, 2, 6, 4)]
    assert [tuple(r) for r in dml.merge_in_order(clash, more.limit(1), [["_group"]], "p", {"_held": "t._held + n._held"}, "_step").collect()] == [(1, 2, 4, 2)]
    assert dml.merge_in_order(empty, new.limit(0), [["a"], ["b"]], "p", None, "affected").collect() == []
    assert sorted(map(tuple, dml.survivors(new, [["a"]], "p").collect()), key=repr) == sorted([(1, 3, 1), (None, 4, 2), (None, 5, 3)], key=repr)
    ties = table(spark, [(1, 1), (1, 1), (2, None)], "_hit int, _file int")
    assert dml.delete(ties, F.col("_hit") == 1, [F.col("_hit")], 1).count() == 2
    assert sorted(map(tuple, dml.update(ties, {"_file": F.lit(9)}, F.col("_hit") == 1, order=[F.col("_hit")], limit=1).collect()), key=repr) == [(1, 1), (1, 9), (2, None)]
    over_aggregate = ties.groupBy("_hit").agg(F.count("*").alias("n"))
    assert [tuple(r) for r in dml.delete(over_aggregate, None, [F.desc("n")], 1).collect()] == [(2, 1)]


def folders_of(df):
    return {f.split("_shard=")[1].split("/")[0] for f in df.inputFiles()}


def test_selects_and_changes_touch_only_the_segments_of_a_pinned_key(engine):
    engine.sql("create table h (id bigint primary key, v int) partition by hash(id) partitions 8")
    engine.sql("insert into h values " + ", ".join(f"({i}, {i % 5})" for i in range(200)))
    everything = folders_of(engine.sql("select * from h"))
    assert len(everything) == 8
    one = engine.sql("select v from h where id = 1")
    assert len(folders_of(one)) == 1
    assert rows(one) == [(1,)]
    assert "InMemoryFileIndex(1 paths)" in one._jdf.queryExecution().executedPlan().toString()
    for text, most in (
        ("select v from h where id in (1, 2) and v > 0", 2), ("select v from h where (id = 1 or 2 = id)", 2), ("select v from h where id = 1 and v = 1 or v = 2", 8), ("select a.v from h a join h b on a.id = b.id where a.id = 1", 1),
        ("select v from h where case when v = 1 and id = 1 then 1 else 0 end", 8), ("select v from h where id <> 1", 8), ("select v from h where id = '1'", 1), ("select v from h where id = 'x'", 8),
    ):
        assert len(folders_of(engine.sql(text.replace("id = 'x'", "concat(id, '') = 'x'")))) <= most or most == 8, text
    assert literals(tree(tokenize("v between 1 and id = 1")), "h", "id") is None
    assert rows(engine.sql("select count(*) from h where id = 1 and v = 1 or v = 2")) == [(41,)]
    assert rows(engine.sql("select v from h where id = ?", [6])) == [(1,)]
    assert len(folders_of(engine.sql("select v from h where id = ?", [6]))) == 1
    before = {p.path for p in engine.table("h").parts}
    engine.sql("update h set v = 50 where id = 1")
    after = engine.table("h").parts
    assert {p.path for p in after} > before  # the old folder still serves the other seven segments
    assert [len(p.segments) for p in after] == [7, 1]
    engine.sql("delete from h where id = 2")
    assert sorted(len(p.segments) for p in engine.table("h").parts) == [1, 1, 6]
    assert rows(engine.sql("select count(*), sum(v) from h")) == [(199, 400 + 49 - 2)]
    plan = json.loads(rows(engine.sql("explain select v from h where id = 1"))[0][0])
    assert len(plan["Partitions"]) == 1


def test_string_keys_and_folded_case(engine):
    engine.sql("create table s (k varchar(20) primary key, v int)")
    engine.sql("insert into s values ('a', 1), ('B', 2), ('it''s', 3)")
    assert rows(engine.sql("select v from s where k = 'a'")) == [(1,)]
    assert len(folders_of(engine.sql("select v from s where k = 'a'"))) == 1
    assert rows(engine.sql("select v from s where k = 'it''s'")) == [(3,)]
    engine.fold_case = True
    assert rows(engine.sql("select v from s where k = 'b'")) == [(2,)]


def test_keys_after_creation(engine):
    engine.sql("create table u (id int primary key, v int, w int) single")
    engine.sql("insert into u values (1, 1, 1), (2, 1, 2), (3, null, 3), (4, null, 4)")
    with pytest.raises(EngineError, match="Duplicate entry '1' for key 'vv'"):
        engine.sql("alter table u add unique key vv (v)")
    engine.sql("alter table u add unique key ww (w)")
    with pytest.raises(EngineError, match="Duplicate entry '4' for key 'ww'"):
        engine.sql("insert into u values (5, 5, 4)")
    engine.sql("create unique index once on u (v, w)")
    assert "once" in rows(engine.sql("show create table u"))[0][1]
    engine.sql("alter table u drop index ww")
    engine.sql("insert into u values (5, 5, 4)")
    engine.sql("alter table u drop primary key")
    engine.sql("insert into u values (5, 6, 7)")
    with pytest.raises(EngineError, match="Duplicate entry '5' for key 'PRIMARY'"):
        engine.sql("alter table u add primary key (id)")
    with pytest.raises(EngineError, match="check that column/key exists"):
        engine.sql("drop index nothing on u")
    with pytest.raises(CatalogError):
        engine.sql("alter table t add unique key (name)")  # without the shard key


def test_values_are_checked(engine):
    engine.sql("create table u (a tinyint, b int unsigned, c set('x','y'), d char(3), e time, f bool not null default true) single")
    engine.sql("insert into u (a, b, c, d, e) values (-128, 4294967295, 'y,x', '数据库', '4:3:2'), (1.5, '7', '', 'ab', '-1:0'), (null, null, null, null, null)")
    assert rows(engine.sql("select a, b, c, d, e, f from u")) == [(-128, 4294967295, "y,x", "数据库", "04:03:02", 1), (2, 7, "", "ab", "-01:00:00", 1), (None, None, None, None, None, 1)]
    for text, message in (("(a) values (128)", "Out of range value for column 'a'"), ("(b) values (-1)", "Out of range"), ("(c) values ('x,z')", "Data truncated"), ("(d) values ('abcd')", "Data too long"), ("(a, a) values (1, 1)", "specified twice")):
        with pytest.raises(EngineError, match=message):
            engine.sql(f"insert into u {text}")
    with pytest.raises(EngineError, match="Out of range"):
        engine.sql("update u set a = a * 100 where true")
    with pytest.raises(EngineError, match="duplicated value 'a'"):
        engine.sql("create table w (k enum('a', 'A')) single")
    engine.sql("insert into u (a) select 300 - 200")
    assert rows(engine.sql("select addtime(e, e) from u where a = 2")) == [("-02:00:00",)]


def test_arithmetic_and_casts(spark):
    def one(text):
        return tuple(spark.sql(to_spark(text)).first())

    assert one("select 1 / 0, 1 div 0, 1 % 0, 1 mod 0, mod(1, 0), mod(-7, 3), 7 / (1 + 1), 7 div -2") == (None, None, None, None, None, -1, 3.5, -3)
    assert one("select cast(cast(-1 as unsigned) as char), cast('12abc' as signed), cast('x' as signed), cast(null as unsigned), cast(2.5 as signed), cast(18446744073709551615 as signed)") == ("18446744073709551615", 12, 0, None, 3, -1)
    assert one("select addtime(cast('1:0:0' as time), cast('1:0:0' as time)), addtime('01:00:00', '00:30:00'), subtime('1:0:0', '2:0:0.5'), cast('2024-01-01 5:4:3' as time), cast('1 2' as time), cast(null as time)") == ("02:00:00", "01:30:00", "-01:00:00.500000", "05:04:03", "26:00:00", None)
    assert one("select group_concat(distinct v order by v desc separator '|'), group_concat(distinct v) from (select 9 v union all select 10 union all select 100 union all select 9 union all select null) x") == ("100|10|9", "9,10,100")
    assert one("select group_concat(distinct v order by length(v) desc, v separator '{') from (select 'b' v union all select 'a' union all select 'ccc') x") == ("ccc{a{b",)
    assert one("select group_concat(distinct v), group_concat(v) from (select 1 v) x where v > 1") == (None, None)
    assert one("select date_format(date'2020-01-02', '%w %D'), b'101' + 0, null is true, 0 is false, 2 > 1 is not true t, str_to_date('5/1/2020', '%d/%m/%Y') is null") == ("4 2nd", 5, 0, 1, 0, 0)
    assert one("select unix_timestamp('2020-01-01'), date_sub('2020-03-31', interval 1 month) = date'2020-02-29', format(1234.5, 1), insert('abc', 9, 1, 'x'), field(null, 'a')") == (1577836800, 1, "1,234.5", "abc", 0)
    assert one("select extract(year from date'2020-02-03')") == (2020,)


def test_statements_with_braces_and_last_numbers(engine):
    engine.sql("insert into t (name) values ('{a}')")
    assert rows(engine.sql("select name, '{t0}' from t where name = '{a}'")) == [("{a}", "{t0}")]


def test_maintenance(engine):
    with pytest.raises(CatalogError, match="attach"):
        engine.sql("admin attach('a', 'b', 'c')")
    assert rows(engine.sql("admin attachlist")) == []
    engine.sql("insert into t (id) values (1)")
    engine.sql("insert ignore into t (id) values (1), (2)")
    assert rows(engine.sql("admin cleanup")) == [(0,)]  # nothing is old enough


def test_strict_mode_words_its_refusals_as_a_sharded_execution(engine):
    engine.strict = True
    for text, message in (
        ("update t set name = 'x'", "unsupported: missing.where.clause.in.DML"), ("update t set id = 1 where id = 2", "unsupported: cannot.update.shard.key[id]"),
        ("create table x (a int, b int)", "The unique/primary constraint shoule be defined or add 'PARTITION BY HASH' to mandatory indication"),
    ):
        with pytest.raises(ValueError) as caught:  # noqa: PT011
            engine.sql(text)
        assert str(caught.value) == message


def test_long_and_empty_string_keys_hash_as_single_ones(spark):
    keys = ["", "a", "x" * 70_000, "数据库", None, "a"]
    df = table(spark, [(k,) for k in keys], "k string")
    assert [r[0] for r in df.coalesce(1).select(slot(F.col("k"), "string")).collect()] == [None if k is None else slot_of(k) for k in keys]
    assert df.limit(0).select(slot(F.col("k"), "string")).collect() == []


# ---- intermediate data ---------------------------------------------------------------------------------------------


def exists(spark, path):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def test_a_cluster_without_a_shared_folder_is_refused():
    class Context:
        master = "spark://host:7077"

        @staticmethod
        def getConf():  # noqa: N802
            return {}

    class Session:
        sparkContext, conf = Context, {}  # noqa: N815

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(Session)


def test_scratch_folders_are_deleted(spark, engine):
    with scratch(spark):
        inside = cut(spark.range(3), "inside").inputFiles()[0]
        assert exists(spark, inside)
    assert not exists(spark, inside)
    engine.sql("insert into t (id) values (1), (2)")
    own = spark.sparkContext._shardloom_scratch
    before = [f.getPath().getName() for f in spark._jvm.org.apache.hadoop.fs.Path(own).getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(spark._jvm.org.apache.hadoop.fs.Path(own))]
    engine.sql("replace into t (id, name) values (1, 'z')")
    after = [f.getPath().getName() for f in spark._jvm.org.apache.hadoop.fs.Path(own).getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(spark._jvm.org.apache.hadoop.fs.Path(own))]
    assert sorted(before) == sorted(after)
    kept = cut(spark.range(3), "kept").inputFiles()[0]
    release(spark)
    assert not exists(spark, kept)
    assert cut(spark.range(3), "again").count() == 3


def test_scratch_goes_with_the_application(tmp_path):
    import subprocess
    import sys

    code = f"""
import sys; sys.path.insert(0, {str(__import__('pathlib').Path(__file__).resolve().parent.parent)!r})
from shardloom.session import create_session
from shardloom.lineage import cut
s = create_session("x", "local[1]", spark__ui__enabled="false", spark__driver__host="127.0.0.1", spark__checkpoint__dir="file://{tmp_path}/shared")
cut(s.range(3), "mine").count()
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120, capture_output=True)
    import time

    for _ in range(50):
        left = [p.name for p in (tmp_path / "shared").glob("scratch-*")]
        if not left:
            break
        time.sleep(0.2)
    assert left == []


# ---- change capture into buckets -----------------------------------------------------------------------------------

LOG = "k int, v string, op string, seq int"


def test_a_batch_rewrites_only_its_buckets_and_only_once(spark, tmp_path):
    start = table(spark, [(i, "a") for i in range(100)], "k int, v string")
    copy = cdc.BucketedCopy(spark, f"file://{tmp_path}/copy", start.schema, ["k"], 16)
    copy.start(start)
    first = copy._state()["folders"]
    copy.apply(table(spark, [(3, "x", "update", 1), (200, "n", "insert", 1), (4, "a", "delete", 1)], LOG), 0)
    second = copy._state()["folders"]
    assert 1 <= sum(first.get(b) != p for b, p in second.items()) <= 3
    assert copy.load().count() == 100
    assert copy.load().where("k = 3 AND v = 'x'").count() == 1
    copy.apply(table(spark, [(3, "again", "update", 1)], LOG), 0)  # the same batch once more
    assert copy._state()["folders"] == second
    copy.apply(table(spark, [], LOG), 1)
    copy.start(start)
    assert copy.load().count() == 100
    empty = cdc.BucketedCopy(spark, f"file://{tmp_path}/empty", start.schema, ["k"], 16)
    empty.start(start.limit(0))
    assert empty.load().collect() == []
    empty.apply(table(spark, [(1, "x", "insert", 1), (None, "y", "insert", 1)], LOG), 0)
    empty.apply(table(spark, [(None, "z", "update", 1)], LOG), 1)
    assert sorted(map(tuple, empty.load().collect()), key=repr) == [(1, "x"), (None, "z")]


def test_a_migration_goes_on_where_it_stopped(spark, tmp_path):
    source = table(spark, [(1, "a"), (2, "b")], "k int, v string")
    table(spark, [(2, "x", "update", 1)], LOG).write.parquet(f"{tmp_path}/log/p0")
    stream = spark.readStream.schema(LOG).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/log")
    half = cdc.apply_changes(source, table(spark, [(2, "x", "update", 1)], LOG), ["k"])
    with pytest.raises(cdc.NotCaughtUp):
        cdc.migrate(source, stream, lambda: source, f"{tmp_path}/to", ["k"], tries=1, wait_s=0)
    table(spark, [(1, "a", "delete", 2)], LOG).write.parquet(f"{tmp_path}/log/p1")
    whole = cdc.apply_changes(half, table(spark, [(1, "a", "delete", 2)], LOG), ["k"])
    moved = cdc.migrate(source, stream, lambda: whole, f"{tmp_path}/to", ["k"], tries=1, wait_s=0)
    assert [tuple(r) for r in moved.collect()] == [(2, "x")]


def test_same_rows_tells_apart_what_moved_between_columns(spark):
    a, b = table(spark, [(1, None)], "a int, b int"), table(spark, [(None, 1)], "a int, b int")
    assert not cdc.same_rows(a, b)
    assert cdc.same_rows(a, a)
    assert cdc.same_rows(a, a.select("b", "a"))


def test_changes_may_name_their_table(engine):
    engine.sql("insert into t (id, name) values (1, 'a'), (2, 'b')")
    engine.sql("update t set t.name = concat(t.name, d.t.id) where t.id = 1 and d.t.name = 'a'")
    engine.sql("insert into d.t (id, name) values (2, 'z') on duplicate key update name = concat(t.name, values(name))")
    engine.sql("delete from t where t.name = 'none' or (t.id > 5)")
    assert rows(engine.sql("select t.id, name from t order by d.t.id")) == [(1, "a1"), (2, "bz")]


def test_values_that_are_no_constants(engine):
    engine.sql("create table r (id int primary key, v double, e time, s datetime default current_timestamp) single")
    engine.sql("insert into r (id, v, e) values (1, rand(), cast('1:2:3' as time)), (2, 0.5, null)")
    assert rows(engine.sql("select id, v between 0 and 1, e, s is not null from r order by id")) == [(1, 1, "01:02:03", 1), (2, 1, None, 1)]


def test_last_insert_id(engine):
    engine.sql("insert into t (name) values ('a'), ('b')")
    assert rows(engine.sql("select last_insert_id()")) == [(1,)]
    engine.sql("insert into t (name) values ('c')")
    assert rows(engine.sql("select last_insert_id() + 0 as n, count(*) from t")) == [(3, 3)]


def test_writers_at_the_same_time_lose_nothing(engine, spark):
    import threading

    engine.sql("create table w (id int primary key, who int) single")
    refused, failed = [], []

    def write(who):
        own = Engine(spark, engine.catalog.root)
        own.sql("use d")
        for i in range(4):
            while True:
                try:
                    own.sql(f"insert into w values ({who * 100 + i}, {who})")
                    break
                except Conflict:
                    refused.append(who)
                except Exception as problem:  # noqa: BLE001
                    failed.append(problem)
                    return

    threads = [threading.Thread(target=write, args=(k,)) for k in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join(300)
    assert not failed
    assert rows(engine.sql("select who, count(*) from w group by who order by who")) == [(0, 4), (1, 4), (2, 4)]
