"""Every core query against its SQL twin on DuckDB, over whole tables."""

import __spark_entry__ as entry
import compare
import pytest

from shardloom.queries import general, relational, sharded

CORE = {n: q for m in (relational, sharded, general) for n, q in m.QUERIES.items()}
SQL = {n: q for m in (relational, sharded, general) for n, q in m.SQL.items()}


@pytest.fixture(scope="module")
def con(data):
    return compare.connect(data)


@pytest.mark.parametrize("name", sorted(CORE))
def test_query(spark, data, con, name):
    got = compare.spark_rows(CORE[name](spark, data))
    if name in SQL:
        assert got == compare.duck_rows(con, SQL[name])
    else:
        assert got[1]


@pytest.mark.parametrize("name", ["order_nulls_whole", "order_nulls_desc_whole", "order_hidden_col_whole", "order_expr_whole"])
def test_whole_tables_come_out_in_order(spark, data, con, name):
    got = [tuple(r) for r in CORE[name](spark, data).collect()]
    assert got == con.execute(SQL[name]).fetchall()
    assert len(got) == con.execute(f"SELECT count(*) FROM {'customer' if 'hidden' in name else 'mock_a'}").fetchone()[0]
    assert len(got) > 40


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(CORE) <= set(entry.queries())
