"""Texts of refusals: the engine's own words, and those strict mode has to give instead."""

from __future__ import annotations

import copy

# What strict mode says, word for word, as clients of a sharded execution compare these texts.
FIXED = {
    "no_where": "unsupported: missing.where.clause.in.DML",
    "shard_key_changed": "unsupported: cannot.update.shard.key[{key}]",
    "shard_key_dropped": "unsupported: cannot.drop.the.column.on.shard.key",
    "shard_key_modified": "unsupported: cannot.modify.the.column.on.shard.key",
    "shard_key_missing": "unsupported: shardkey.column[{key}].missing",
    "shard_key_null": "unsupported: shardkey[{key}].type.canot.be[*sqlparser.NullVal]",
    "shard_key_type": "hash.unsupported.key.type:[{kind}]",
    "update_limit": "unsupported: limit.and.order.in.update",
    "key_needed": "The unique/primary constraint shoule be defined or add 'PARTITION BY HASH' to mandatory indication",
    "key_unknown": "Sharding Key column '{key}' doesn't exist in table",
    "key_elsewhere": "The unique/primary constraint should be only defined on the sharding key column[{key}]",
    "no_table_name": "table.cant.be.null",
    "no_shard_key": "shard.key.cant.be.null",
    "partition_count": "number.of.partitions.must.be.one.of.the.list.[8, 16, 32, 64]",
    "no_backends": "router.compute.backends.is.null",
    "many_backends": "router.compute.backends[{n}].too.many:[max:{most}]",
    "no_list": "router.compute.partition.list.is.null",
    "list_twice": "partition.list.different.backend.with.same.values",
    "storage_engine": "Unknown storage engine '{name}', currently we only support InnoDB and TokuDB (errno 1286) (sqlstate 42000)",
    "encryption": "The encryption option is not supported (errno 1149) (sqlstate 42000)",
    "ddl_in_transaction": "in.multiStmtTrans.unsupported.DDL",
    "nested_begin": "You have an error in your SQL syntax, in.transaction: nested BEGIN (errno 1149) (sqlstate 42000)",
    "statement": "unsupported.query: {text} (errno 1105) (sqlstate HY000)",
    "join_rows": "unsupported: join.row.count.exceeded.allowed.limit.of.'{most}'",
    "union_columns": "unsupported: the.used.'select'.statements.have.a.different.number.of.columns",
    "subquery_items": "unsupported: subqueries.in.select.exprs",
    "subquery": "unsupported: subqueries.in.select",
    "subquery_from": "unsupported: subquery.in.select",
    "nextval": "unsupported: nextval.in.select.exprs",
    "order_expr": "unsupported: orderby:[{text}].type.should.be.colname",
    "join_type": "unsupported: join.type:{text}",
    "join_using": "unsupported: join.with.USING",
    "alias_twice": "unsupported: not.unique.table.or.alias:'{text}'",
    "on_one_side": "unsupported: join.on.condition.should.cross.left-right.tables",
    "column_unknown": "unsupported: unknown.column.'{text}'.in.{where}",
    "table_unknown": "unsupported:  unknown.table.'{text}'.in.field.list",
    "star_join": "unsupported: '*'.expression.in.cross-shard.query",
    "star_aggregate": "unsupported: exists.aggregate.and.'*'.select.exprs",
    "distinct": "unsupported: distinct",
    "aggregate_inside": "unsupported: '{text}'.contain.aggregate.in.select.exprs",
    "group_concat": "unsupported: group_concat.in.select.exprs",
    "aggregate_empty": "unsupported: invalid.use.of.group.function[{text}]",
    "aggregate_star": "unsupported: syntax.error.at.'{text}'",
    "function": "unsupported: function:{text}",
    "outer_expr": "unsupported: expr.'{text}'.in.cross-shard.left.join",
    "limit_value": "unsupported: limit.offset.or.counts.must.be.IntVal",
    "group_expr": "unsupported: group.by.[{text}].type.should.be.colname",
    "group_table": "unsupported: unknow.table.in.group.by.field[{text}]",
    "group_listed": "unsupported: group.by.field[{text}].should.be.in.select.list",
    "having_expr": "unsupported: expr[{text}].in.having.clause",
    "having_alias": "unsupported: aggregation.in.having.clause",
}

#: The engine's own words for what is refused in default mode, too.
PLAIN = {
    "no_where": "refused: missing where clause; add WHERE TRUE to change every row",
    "shard_key_changed": "refused: column {key} decides where a row lies and cannot be updated",
    "shard_key_dropped": "refused: the column is the shard key of the table and cannot be dropped",
    "shard_key_modified": "refused: the column is the shard key of the table and cannot be modified",
    "shard_key_missing": "refused: no value for {key}, which decides where a row lies",
    "shard_key_null": "refused: {key} decides where a row lies and must not be null",
    "shard_key_type": "a value of type {kind} cannot be hashed to a slot",
    "update_limit": "refused: UPDATE with ORDER BY or LIMIT",
    "key_needed": "a primary or unique key, or PARTITION BY HASH, is needed to place the rows",
    "key_unknown": "the table doesn't exist with such a key: no column {key}",
    "key_elsewhere": "every primary or unique key must contain {key}: keys are only defined on the sharding key or more",
    "no_table_name": "the table has no name",
    "no_shard_key": "the shard key is not named",
    "partition_count": "PARTITIONS must be 8, 16, 32 or 64",
    "no_backends": "there is no backend to place the table on",
    "many_backends": "{n} backends are more than the {most} there is room for",
    "no_list": "PARTITION BY LIST needs at least one value",
    "list_twice": "a value is listed for two backends",
    "storage_engine": "Unknown storage engine '{name}' (errno 1286) (sqlstate 42000)",
    "encryption": "databases are stored as the file system stores them; ENCRYPTION is refused",
    "ddl_in_transaction": "DDL is refused inside a transaction",
    "nested_begin": "a transaction is open already",
    "statement": "statement not known: {text}",
    "join_rows": "the join has more rows than the {most} allowed",
    "union_columns": "the SELECTs of a UNION have a different number of columns",
}


class Refusal(ValueError):
    """What is refused: a key of the tables above with its values, or a text of its own."""

    def __init__(self, key: str, /, **values: object) -> None:
        self.key, self.values = key, values
        super().__init__((PLAIN.get(key) or FIXED[key]).format(**values) if key in FIXED else key)

    def strict(self) -> Refusal:
        """The same in strict mode's words."""
        if self.key not in FIXED:
            return self
        worded = copy.copy(self)
        worded.args = (FIXED[self.key].format(**self.values),)
        return worded

    def __reduce__(self):
        return (type(self), (str(self),))
