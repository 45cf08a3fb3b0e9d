"""Data changes as functions from one DataFrame to the next; committing the result is the catalogue's part."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import cut
from ..plans.messages import Refusal
from .prefix import fresh, running_sums

#: Rows of one statement that are applied to one row of the table in one step; more of them take more steps.
IN_ORDER = 65_536
#: The same where rows hang together by several keys: each step then looks through all rows of such a group.
IN_ORDER_MANY_KEYS = 1024
#: Rows whose places are counted in one task.
ROWS_PER_BUCKET = 16_384


class KeyViolation(Refusal):
    """A change of a shard key, or a missing WHERE."""


def insert(table: DataFrame, rows: DataFrame) -> DataFrame:
    """Adds rows by column name; columns that the rows lack become null."""
    return table.unionByName(rows, allowMissingColumns=True).select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in table.schema))


def last_per_key(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rows equal in the keys, the last in the order; keys are compared null-safely. No window: one aggregation."""
    rest = [c for c in rows.columns if c not in keys]
    held, = fresh(rows.columns, "_held")
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias(held))
    return last.select(*(F.col(k) if k in keys else F.col(held)[k].alias(k) for k in rows.columns))


def replace(table: DataFrame, rows: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """REPLACE: rows take the place of those with equal keys; of new rows with one key the last in ``order`` stays.

    A key with a null equals no other, as in a unique index.
    """
    if order:
        keyed, loose = rows.dropna(subset=keys), rows.where(" OR ".join(f"`{k}` IS NULL" for k in keys))
        rows = last_per_key(keyed, keys, order).union(loose).drop(order)
    return insert(table.join(rows.select(*keys), keys, "left_anti").select(*table.columns), rows)


def upsert(table: DataFrame, rows: DataFrame, keys: list[str], updates: dict[str, Column], shard_key: str | None = None) -> DataFrame:
    """INSERT .. ON DUPLICATE KEY UPDATE: new keys are inserted; known ones get ``updates``.

    In the update expressions old values are ``t.column`` and new ones ``n.column``. ``rows`` must have each key once.
    One full join on the keys; unmatched rows on either side pass through.
    """
    if shard_key and any(c.lower() == shard_key.lower() for c in updates):
        raise KeyViolation("shard_key_changed", key=shard_key)
    old, new = fresh(table.columns, "_old", "_new")
    t, n = table.withColumn(old, F.lit(True)).alias("t"), rows.withColumn(new, F.lit(True)).alias("n")
    on = [F.col(f"t.`{k}`") == F.col(f"n.`{k}`") for k in keys]
    both = t.join(n, on, "full")
    out = []
    for f in table.schema:
        before = F.col(f"t.`{f.name}`")
        after = F.col(f"n.`{f.name}`") if f.name in rows.columns else F.lit(None)
        changed = F.when(F.col(new).isNotNull(), updates[f.name]).otherwise(before) if f.name in updates else before
        out.append(F.when(F.col(old).isNull(), after).otherwise(changed).cast(f.dataType).alias(f.name))
    return both.select(*out)


def mark(table: DataFrame, where: Column | None, order: list[Column], limit: int | None, identity: tuple[str, ...], hit: str) -> DataFrame:
    """Adds column ``hit``: whether a row is one of those that an UPDATE or DELETE is meant for.

    With a limit, which counts over the whole table, these are the first in ``order``, then in that of ``identity``,
    columns that tell the rows of ``table`` apart and stay the same when it is read again. They are found by a top-k.
    """
    holds = F.coalesce(where, F.lit(False)) if where is not None else F.lit(True)
    if limit is None:
        return table.withColumn(hit, holds)
    first = table.where(holds).orderBy(*order, *(F.col(f"`{c}`") for c in identity)).limit(limit)
    chosen = cut(first.select(*(f"`{c}`" for c in identity)), "chosen").withColumn(hit, F.lit(True))
    return table.join(chosen, list(identity), "left").withColumn(hit, F.coalesce(F.col(hit), F.lit(False)))


def _identified(table: DataFrame) -> tuple[DataFrame, tuple[str, str]]:
    """The table written once, so that each row has a file and a place in it, however often it is read."""
    file, place = fresh(table.columns, "_file", "_place")
    return cut(table, "rows").select("*", F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(place)), (file, place)


def changed(table: DataFrame, changes: dict[str, Column], hit: Column) -> DataFrame:
    """The columns of ``table``, with the changes where ``hit`` is true, all worked out from the old values."""
    by_name = {c.lower(): v for c, v in changes.items()}
    return table.select(*(F.when(hit, by_name[f.name.lower()]).otherwise(F.col(f"`{f.name}`")).cast(f.dataType).alias(f.name) if f.name.lower() in by_name else F.col(f"`{f.name}`") for f in table.schema))


def update(table: DataFrame, changes: dict[str, Column], where: Column | None, shard_key: str | None = None, order: list[Column] | None = None, limit: int | None = None) -> DataFrame:
    """UPDATE .. WHERE [ORDER BY] [LIMIT]: rows for which the condition holds get the changes.

    The limit counts over the whole table; ties are decided by the place of the rows. A condition that is unknown for
    a row does not hold. An empty table stays empty. Extra columns are kept, whatever their names.
    """
    if where is None:
        raise KeyViolation("no_where")
    if shard_key and any(c.lower() == shard_key.lower() for c in changes):
        raise KeyViolation("shard_key_changed", key=shard_key)
    if limit is None:
        return changed(table, changes, F.coalesce(where, F.lit(False)))
    rows, identity = _identified(table)
    hit, = fresh(rows.columns, "_hit")
    return changed(mark(rows, where, order or [], limit, identity, hit), changes, F.col(hit)).select(*(f"`{c}`" for c in table.columns))


def delete(table: DataFrame, where: Column | None = None, order: list[Column] | None = None, limit: int | None = None) -> DataFrame:
    """DELETE [WHERE] [ORDER BY] [LIMIT]: what is left. The limit counts over the whole table, not per shard.

    With a limit the table is written once, as its rows then need an identity.
    """
    if limit is None:
        return table.where(~(F.coalesce(where, F.lit(False)) if where is not None else F.lit(True)))
    rows, identity = _identified(table)
    hit, = fresh(rows.columns, "_hit")
    return mark(rows, where, order or [], limit, identity, hit).where(~F.col(hit)).select(*(f"`{c}`" for c in table.columns))


def without(table: DataFrame, rows: DataFrame, unique: list[list[str]]) -> DataFrame:
    """Rows of the table that share no key with ``rows``; a key with a null equals no other."""
    for k in unique:
        table = table.join(rows.select(*k), k, "left_anti").select(*table.columns)
    return table


def _has_null(key: list[str]) -> Column:
    return F.expr(" OR ".join(f"`{c}` IS NULL" for c in key))


def survivors(rows: DataFrame, unique: list[list[str]], order: str) -> DataFrame:
    """Of the rows of a REPLACE those that are left at its end: no later row shares one of their keys."""
    last, = fresh(rows.columns, "_last")
    out = rows
    for k in unique:
        latest = rows.dropna(subset=k).groupBy(*k).agg(F.max(order).alias(last))
        out = out.join(latest, k, "left").where(F.col(last).isNull() | (F.col(last) == F.col(order))).select(*rows.columns)
    return out


def merge_in_order(table: DataFrame, rows: DataFrame, unique: list[list[str]], order: str, updates: dict[str, str] | None, affected: str) -> DataFrame:
    """INSERT .. ON DUPLICATE KEY UPDATE, or INSERT IGNORE if ``updates`` is None, with rows applied one after another.

    ``rows`` have the table's columns and ``order``, their place in the statement. A row that shares a unique key with
    one in the table, be it an earlier row of the statement, updates that (that of the first key, if several are
    shared) or is ignored; another is inserted. ``updates`` are SQL texts with old values as ``t.column`` and new ones
    as ``n.column``. A key with a null equals no other. The keys must be unique in ``table``.

    Returns the table's columns and ``affected``: 1 for a row inserted, 2 for one changed, more if changed again, 0
    for one left as it is.

    Rows of one key meet in an array and are folded by the JVM, at most ``IN_ORDER`` of them in a step; of a key
    repeated more often in one statement, the next ones follow in a further step over the table.
    """
    if not unique:
        return insert(table, rows.drop(order)).withColumn(affected, F.lit(1).cast("bigint"))
    rows = cut(rows, "merged")
    label, = fresh([*table.columns, order, affected], "_group")
    changed_keys = {c.lower() for c in updates or {}} & {c.lower() for c in unique[0]}
    by_key = len(unique) == 1 and not changed_keys
    state = table.withColumn(affected, F.lit(0).cast("bigint"))
    if by_key:
        loose = rows.where(_has_null(unique[0])).drop(order)
        rows = rows.where(~_has_null(unique[0]))
    else:
        loose = None
        rows = _grouped(table, rows, unique, order, label)
    step, = fresh(rows.columns, "_step")
    rows, steps = _in_steps(rows, unique[0] if by_key else [label], order, step, IN_ORDER if by_key else IN_ORDER_MANY_KEYS)
    one = _fold_by_key if by_key else _fold_groups
    for k in range(steps):
        part = rows.where(F.col(step) == k).drop(step) if steps > 1 else rows.drop(step)
        state = one(state, part, unique, order, updates, affected, label)
        if k + 1 < steps:
            state = cut(state, "merged")
    if loose is not None:
        state = state.unionByName(loose.withColumn(affected, F.lit(1).cast("bigint")), allowMissingColumns=True)
    return state


def _in_steps(rows: DataFrame, group: list[str], order: str, step: str, most: int) -> tuple[DataFrame, int]:
    """Adds the number of the step in which each row is applied, and how many steps there are."""
    largest = rows.groupBy(*group).count().agg(F.max("count")).first()[0] or 0
    if largest <= most:
        return rows.withColumn(step, F.lit(0)), min(largest, 1)
    bucket, one, rank = fresh([*rows.columns, step], "_bucket", "_one", "_rank")
    spread = rows.withColumn(bucket, F.expr(f"`{order}` div {ROWS_PER_BUCKET}")).withColumn(one, F.lit(1))
    ranked = running_sums(spread, group, bucket, [order], {rank: one})
    numbered = ranked.withColumn(step, F.expr(f"CAST((`{rank}` - 1) div {most} AS INT)")).drop(bucket, one, rank)
    return cut(numbered, "merged"), math.ceil(largest / most)


def _struct(columns: list[str], side: str = "") -> str:
    return "named_struct(" + ", ".join(f"'{c}', {side}`{c}`" for c in columns) + ")"


def _type(df: DataFrame) -> str:
    return "struct<" + ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in df.schema) + ">"


def _new_state(table: DataFrame, updates: dict[str, str], affected: str) -> str:
    """SQL of row t after it has been updated by row n."""
    fields = [f for f in table.schema if f.name != affected]
    values = {f.name: f"CAST({updates[f.name]} AS {f.dataType.simpleString()})" if f.name in updates else f"t.`{f.name}`" for f in fields}
    same = " AND ".join(f"{values[c]} <=> t.`{c}`" for c in updates) or "true"
    return "named_struct(" + ", ".join(f"'{c}', {v}" for c, v in values.items()) + f", '{affected}', t.`{affected}` + IF({same}, 0L, 2L))"


def _fold_by_key(state: DataFrame, rows: DataFrame, unique: list[list[str]], order: str, updates: dict[str, str] | None, affected: str, label: str) -> DataFrame:
    """One key: the rows of each of its values, in their order, are folded into the row of the table that has it."""
    key, = unique
    columns = [c for c in state.columns if c != affected]
    new, old = fresh(state.columns, "_new", "_old")
    whole = rows.selectExpr(*(f"`{c}`" for c in key), f"named_struct('{order}', `{order}`, " + ", ".join(f"'{c}', `{c}`" for c in columns) + f") AS `{new}`")
    arrays = whole.groupBy(*key).agg(F.array_sort(F.collect_list(new)).alias(new))
    first = "named_struct(" + ", ".join(f"'{c}', n.`{c}`" for c in columns) + f", '{affected}', 1L)"
    later = _new_state(state, updates, affected) if updates is not None else "t"
    kind = _type(state)
    fold = f"aggregate(`{new}`, CAST({{}} AS {kind}), (t, n) -> IF(t IS NULL, CAST({first} AS {kind}), CAST({later} AS {kind})))"
    met = state.select(*(f"`{c}`" for c in key), F.expr(f"{_struct(state.columns)}").alias(old)).join(arrays, key, "left")
    met = met.select(F.expr(f"CASE WHEN `{new}` IS NULL THEN `{old}` ELSE {fold.format(f'`{old}`')} END").alias(old))
    # Each row of an unknown key is seen once more, against the keys alone.
    fresh_rows = arrays.join(state.select(*key), key, "left_anti").select(F.expr(fold.format("NULL")).alias(old))
    return met.union(fresh_rows).select(f"`{old}`.*")


def _fold_groups(state: DataFrame, rows: DataFrame, unique: list[list[str]], order: str, updates: dict[str, str] | None, affected: str, label: str) -> DataFrame:
    """Several keys: groups of rows that hang together are folded into arrays of the table's rows they meet."""
    columns = [c for c in state.columns if c != affected]
    kind = _type(state)
    new, held = fresh([*state.columns, label], "_new", "_held")
    arrays = rows.groupBy(label).agg(F.array_sort(F.collect_list(F.expr(f"named_struct('{order}', `{order}`, " + ", ".join(f"'{c}', `{c}`" for c in columns) + ")"))).alias(new))
    met = _labelled(state, rows, unique, label)
    mine = met.where(F.col(label).isNotNull()).groupBy(label).agg(F.collect_list(F.expr(_struct(state.columns))).alias(held))
    hits = ", ".join(f"nullif(array_position(transform(s, t -> coalesce({' AND '.join(f't.`{c}` = n.`{c}`' for c in k)}, false)), true), 0)" for k in unique)
    first = "named_struct(" + ", ".join(f"'{c}', n.`{c}`" for c in columns) + f", '{affected}', 1L)"
    later = f"transform(s, (t, i) -> IF(i + 1 = p, CAST({_new_state(state, updates, affected)} AS {kind}), t))" if updates is not None else "s"
    one = f"transform(array(coalesce({hits})), p -> IF(p IS NULL, concat(s, array(CAST({first} AS {kind}))), {later}))[0]"
    fold = f"aggregate(`{new}`, CAST(coalesce(`{held}`, array()) AS array<{kind}>), (s, n) -> CAST({one} AS array<{kind}>))"
    folded = arrays.join(mine, label, "left").select(F.explode(F.expr(fold)).alias(held)).select(f"`{held}`.*")
    return met.where(F.col(label).isNull()).drop(label).union(folded)


def _labelled(table: DataFrame, rows: DataFrame, unique: list[list[str]], label: str) -> DataFrame:
    """The table's rows with the label of the rows of the statement that share a key with them; null if none does."""
    out = table
    names = fresh([*table.columns, label], *(f"_l{i}" for i in range(len(unique))))
    for name, k in zip(names, unique, strict=True):
        out = out.join(rows.dropna(subset=k).groupBy(*k).agg(F.min(label).alias(name)), k, "left")
    return out.select(*table.columns, F.coalesce(*(F.col(n) for n in names)).alias(label))


def _grouped(table: DataFrame, rows: DataFrame, unique: list[list[str]], order: str, label: str) -> DataFrame:
    """Adds the label of the group each row belongs to: rows that share a key, or a row of the table, are of one group.

    Labels are the least place of the group's rows. They spread by key, then by row of the table, until none changes.
    """
    mine, = fresh(rows.columns, "_mine")
    out = rows.withColumn(label, F.col(order))
    while True:
        new = out
        for k in unique:
            least = new.dropna(subset=k).groupBy(*k).agg(F.min(label).alias(mine))
            new = new.join(least, k, "left").select(*(F.col(f"`{c}`") for c in rows.columns), F.least(label, mine).alias(label))
        # A row of the table joins the groups of all rows that share one of its keys.
        names = fresh([*table.columns, label, mine], *(f"_l{i}" for i in range(len(unique))))
        bridge = table
        for name, k in zip(names, unique, strict=True):
            bridge = bridge.join(new.dropna(subset=k).groupBy(*k).agg(F.min(label).alias(name)), k, "left")
        bridge = bridge.where(" OR ".join(f"`{n}` IS NOT NULL" for n in names)).withColumn(mine, F.least(*(F.col(n) for n in names)))
        bridge = cut(bridge.select(*{c: None for k in unique for c in k}, mine), "merged")
        for k in unique:
            least = bridge.dropna(subset=k).groupBy(*k).agg(F.min(mine).alias(mine))
            new = new.join(least, k, "left").select(*(F.col(f"`{c}`") for c in rows.columns), F.least(label, mine).alias(label))
        new = cut(new, "merged")
        before = out.select(order, F.col(label).alias(mine))
        moved = not new.join(before, order).where(F.col(label) != F.col(mine)).isEmpty()
        out = new
        if not moved:
            return out


def auto_increment(rows: DataFrame, column: str, start: int, order: list[str] | None = None) -> DataFrame:
    """Fills null or 0 in ``column`` with unique numbers above ``start``; without an order they have gaps.

    With an order they are dense, numbered in ranges: each of the sorted partitions is counted, then numbered from the
    count of those before it, so no task holds all rows.
    """
    empty = F.col(column).isNull() | (F.col(column) == 0)
    if not order:
        return rows.withColumn(column, F.when(empty, F.monotonically_increasing_id() + start + 1).otherwise(F.col(column)).cast("bigint"))
    part, place, count, n = fresh(rows.columns, "_part", "_place", "_count", "_n")
    fill = rows.withColumn("_fill", empty) if "_fill" not in rows.columns else rows
    ranged = cut(fill.repartitionByRange(*order).withColumn(part, F.spark_partition_id()), "autoinc")
    counts = ranged.where("_fill").groupBy(part).agg(F.count(F.lit(1)).alias(count))
    before = counts.select(part, (F.sum(count).over(Window.orderBy(part)) - F.col(count)).alias(n))  # one row a partition
    within = F.row_number().over(Window.partitionBy(part, "_fill").orderBy(*order))
    numbered = ranged.withColumn(place, within).join(F.broadcast(before), part, "left")
    value = F.when(F.col("_fill"), F.col(place) + F.col(n) + start).otherwise(F.col(column)).cast("bigint")
    return numbered.withColumn(column, value).select(*rows.columns)
