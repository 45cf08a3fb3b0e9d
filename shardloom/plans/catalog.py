"""Databases and tables of the engine: Parquet folders, and the versions of each table's definition.

A definition names the folders that make up the table. It is changed by adding its next version, a file that must not
exist before: of two connections that start from the same version, the later one is refused. Folders have unique names
and are never written twice, so a running query keeps its snapshot and nothing committed is ever overwritten.
"""

from __future__ import annotations

import json
import re
import threading
import time
import urllib.parse
import uuid
from dataclasses import asdict, dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..hadoop import names, path_of, put_new, read_text, remove, statuses, system_of
from . import placement as P
from .messages import Refusal


class CatalogError(Refusal):
    """A name that is unknown or taken, or a table definition that is refused."""


class Conflict(CatalogError):
    """Another connection has changed the table meanwhile; nothing was changed."""


def no_table(name: str) -> CatalogError:
    return CatalogError(f"Table '{name}' doesn't exist (errno 1146) (sqlstate 42S02)")


@dataclass
class ColumnDef:
    """A column as declared. ``default`` is SQL text of an expression, or None."""

    name: str
    sql_type: str
    spark_type: str
    nullable: bool = True
    default: str | None = None
    auto_increment: bool = False
    on_update: bool = False
    values: list[str] = field(default_factory=list)
    comment: str = ""


@dataclass
class Part:
    """A folder of rows. ``segments``: places in the layout of the sub-folders that count, None if it has no sub-folders."""

    path: str
    segments: list[int] | None = None
    #: Whether all its sub-folders count.
    whole: bool = True

    def paths(self, wanted: set[int] | None) -> list[str]:
        if self.segments is None or (wanted is None and self.whole):
            return [self.path]
        return [f"{self.path}/{P.SHARD}={s}" for s in self.segments if wanted is None or s in wanted]


@dataclass
class Table:
    """A table's definition and the folders that make up its present content."""

    db: str
    name: str
    columns: list[ColumnDef]
    primary: list[str] = field(default_factory=list)
    unique: list[list[str]] = field(default_factory=list)
    indexes: list[str] = field(default_factory=list)
    placement: P.Placement = field(default_factory=lambda: P.single_layout("", ""))
    parts: list[Part] = field(default_factory=list)
    version: int = 0
    next_number: int = 0
    store: str = field(default_factory=lambda: uuid.uuid4().hex)
    #: Names of the unique keys, in their order.
    unique_names: list[str] = field(default_factory=list)

    @property
    def schema(self) -> T.StructType:
        """Spark's; TIME columns, kept as text, are marked."""
        kinds = (T._parse_datatype_string(c.spark_type) for c in self.columns)
        return T.StructType([T.StructField(c.name, k, True, {"mysql": "time"} if re.match(r"time\b", c.sql_type) else None) for c, k in zip(self.columns, kinds, strict=True)])

    @property
    def sharded(self) -> bool:
        return self.placement.kind in (P.HASH, P.LIST)

    @property
    def keys(self) -> list[list[str]]:
        """The primary key and the unique ones."""
        return [k for k in [self.primary, *self.unique] if k]

    def key_name(self, key: list[str]) -> str:
        return "PRIMARY" if key == self.primary else self.unique_names[self.unique.index(key)] if key in self.unique and len(self.unique_names) == len(self.unique) else key[0]

    def column(self, name: str) -> ColumnDef:
        for c in self.columns:
            if c.name.lower() == name.lower():
                return c
        raise CatalogError(f"Unknown column '{name}' in 'field list' (errno 1054) (sqlstate 42S22)")

    def swap(self, touched: set[int] | None, new: list[Part]) -> None:
        """Puts new parts in the place of the rows of the touched segments, or of all rows."""
        kept = []
        for p in self.parts if touched is not None else []:
            left = [s for s in p.segments or [] if s not in touched]
            if left:
                kept.append(Part(p.path, left, p.whole and len(left) == len(p.segments)))
        self.parts = [*kept, *new]

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> Table:
        raw = json.loads(text)
        raw["columns"] = [ColumnDef(**c) for c in raw["columns"]]
        raw["parts"] = [Part(**p) for p in raw["parts"]]
        where = raw["placement"]
        raw["placement"] = P.Placement(where["kind"], where["shard_key"], tuple(P.Segment(**s) for s in where["segments"]), where["key_type"])
        return Table(**raw)


def check_shard_key(columns: list[str], unique: list[list[str]], shard_key: str) -> None:
    """The shard key must be a column, and part of every primary or unique key."""
    if shard_key.lower() not in (c.lower() for c in columns):
        raise CatalogError("key_unknown", key=shard_key)
    for key in unique:
        if shard_key.lower() not in (c.lower() for c in key):
            raise CatalogError("key_elsewhere", key=shard_key)


#: One process adds one version at a time; between processes the file system's rename decides.
_LOCK = threading.Lock()


class Catalog:
    """All databases below one folder, shared by any number of connections.

    ``root/db/name.def/`` holds the versions of a table's definition, the highest of which counts, and
    ``root/db/store.rows/`` its folders of rows. A definition is looked up anew by each statement.
    """

    SYSTEM = ("information_schema", "mysql", "performance_schema", "sys")

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._fs = system_of(spark, self.root)
        self._fs.mkdirs(path_of(spark, self.root))
        self._read_before: dict[tuple[str, str], Table] = {}
        self._known: set[str] = set()

    # ---- files -----------------------------------------------------------------------------------------------------

    def _names(self, folder: str) -> list[str]:
        return names(self.spark, folder)

    def _db_folder(self, db: str) -> str:
        return f"{self.root}/{urllib.parse.quote(db, safe='')}"

    def _definition(self, db: str, name: str) -> str:
        return f"{self._db_folder(db)}/{urllib.parse.quote(name, safe='')}.def"

    def _rows(self, table: Table) -> str:
        return f"{self._db_folder(table.db)}/{table.store}.rows"

    def _latest(self, db: str, name: str) -> int:
        """The highest version of a definition, 0 if there is none."""
        return max((int(n[:-5]) for n in self._names(self._definition(db, name)) if re.fullmatch(r"\d+\.json", n)), default=0)

    # ---- definitions -----------------------------------------------------------------------------------------------

    def check_unchanged(self, table: Table) -> None:
        """Refuses if the table has another version by now than the one this one was made from."""
        latest = self._latest(table.db, table.name)
        if latest != table.version or (latest and self._load(table.db, table.name, latest).store != table.store):
            raise Conflict(f"table '{table.name}' has been changed by another connection; run the statement or transaction again (errno 1020) (sqlstate HY000)")

    def _load(self, db: str, name: str, version: int) -> Table:
        held = self._read_before.get((db, name))
        if held is None or held.version != version:
            held = Table.from_json(read_text(self.spark, f"{self._definition(db, name)}/{version:010d}.json"))
            self._read_before[(db, name)] = held
        return held

    def save(self, table: Table) -> None:
        """Adds the table's definition as the version after the one it was made from; see :class:`Conflict`."""
        folder, new = self._definition(table.db, table.name), table.version + 1
        with _LOCK:
            self._read_before.pop((table.db, table.name), None)
            self.check_unchanged(table)
            table.version = new
            made = put_new(self.spark, f"{folder}/{new:010d}.json", table.to_json())
            if not made or self._latest(table.db, table.name) != new:
                # Others were faster, by one version or by several.
                if made:
                    remove(self.spark, f"{folder}/{new:010d}.json")
                table.version = new - 1
                self.check_unchanged(table)
        self._read_before[(table.db, table.name)] = table
        for n in self._names(folder):  # the version before stays for readers that have just listed it
            if re.fullmatch(r"\d+\.json", n) and int(n[:-5]) < new - 1:
                remove(self.spark, f"{folder}/{n}")

    def refresh(self) -> None:
        """Looks up which databases there are."""
        self._known = {urllib.parse.unquote(n) for n in self._names(self.root)}

    def databases(self) -> list[str]:
        if not self._known:
            self.refresh()
        return sorted(self._known)

    def tables(self, db: str) -> dict[str, Table]:
        """The tables of a database by name."""
        names = sorted(urllib.parse.unquote(n[:-4]) for n in self._names(self._db_folder(db)) if n.endswith(".def"))
        return {n: t for n in names if (t := self._find(db, n)) is not None}

    def _find(self, db: str, name: str) -> Table | None:
        version = self._latest(db, name)
        return self._load(db, name, version) if version else None

    def create_database(self, name: str, if_not_exists: bool = False) -> None:
        self.refresh()
        if name in self._known:
            if if_not_exists:
                return
            raise CatalogError(f"Can't create database '{name}'; database exists (errno 1007) (sqlstate HY000)")
        self._fs.mkdirs(path_of(self.spark, self._db_folder(name)))
        self.refresh()

    def drop_database(self, name: str, if_exists: bool = False) -> None:
        self.refresh()
        if name not in self._known:
            if if_exists:
                return
            raise CatalogError(f"Can't drop database '{name}'; database doesn't exist (errno 1008) (sqlstate HY000)")
        remove(self.spark, self._db_folder(name))
        self.refresh()

    def database(self, name: str | None) -> str:
        """The name, if there is such a database."""
        if not name:
            raise CatalogError("No database selected (errno 1046) (sqlstate 3D000)")
        if name not in self._known:
            self.refresh()
        if name not in self._known:
            raise CatalogError(f"Unknown database '{name}' (errno 1049) (sqlstate 42000)")
        return name

    def table(self, db: str | None, name: str) -> Table:
        if db and db not in self._known:
            self.refresh()
            if db not in self._known:
                raise no_table(f"{db}.{name}")
        found = self._find(self.database(db), name)
        if found is None:
            raise no_table(name)
        return found

    def add(self, table: Table, if_not_exists: bool = False) -> None:
        self.database(table.db)
        if self._find(table.db, table.name) is not None:
            if if_not_exists:
                return
            raise CatalogError(f"Table '{table.name}' already exists (errno 1050) (sqlstate 42S01)")
        table.version = 0
        self.save(table)

    def forget(self, table: Table) -> None:
        """Drops a definition; its rows stay."""
        remove(self.spark, self._definition(table.db, table.name))
        self._read_before.pop((table.db, table.name), None)

    def drop(self, table: Table) -> None:
        self.forget(table)
        remove(self.spark, self._rows(table))

    # ---- rows ------------------------------------------------------------------------------------------------------

    def read(self, table: Table, segments: set[int] | None = None, identity: tuple[str, str] | None = None) -> DataFrame:
        """The table's rows, or those of some segments: a fixed list of folders, so a running query keeps its snapshot.

        ``identity``: names of two more columns that tell rows apart, file and place in it.
        """
        paths = [path for p in table.parts for path in p.paths(segments)]
        if not paths:
            more = f", `{identity[0]}` string, `{identity[1]}` bigint" if identity else ""
            return self.spark.createDataFrame([], T._parse_datatype_string(", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema) + more))
        rows = self.spark.read.schema(table.schema).option("recursiveFileLookup", "true").parquet(*paths)
        if identity:
            rows = rows.select("*", F.col("_metadata.file_path").alias(identity[0]), F.col("_metadata.row_index").alias(identity[1]))
        return rows

    @staticmethod
    def segment_of_file(file: Column) -> Column:
        """Place in the layout of the segment a file belongs to; 0 in tables without segments."""
        return F.coalesce(F.nullif(F.regexp_extract(file, f"/{P.SHARD}=(\\d+)/", 1), F.lit("")).cast("int"), F.lit(0))

    def write(self, table: Table, df: DataFrame, counts: dict[str, Column] | None = None) -> tuple[list[Part], dict[str, int]]:
        """Writes rows to a folder of their own, cut by segment if the table is: the part, or none if there are no rows.

        ``counts``: aggregates worked out on the way over ``df``, which may have more columns than the table.
        """
        path = f"{self._rows(table)}/{uuid.uuid4().hex}"
        seen = Observation()
        rows = df.observe(seen, F.count(F.lit(1)).alias("_rows"), *(c.alias(n) for n, c in (counts or {}).items()))
        rows = rows.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in table.schema))
        if table.sharded:
            P.write_sharded(rows, path, table.placement, numbered=True)
        else:
            rows.write.parquet(path)
        found = self._seen(seen, df, counts or {})
        segments = sorted(int(n.split("=")[1]) for n in self._names(path) if n.startswith(f"{P.SHARD}=")) if table.sharded else None
        if not found["_rows"]:
            remove(self.spark, path)
            return [], found
        return [Part(path, segments)], found

    @staticmethod
    def _seen(seen: Observation, df: DataFrame, counts: dict[str, Column]) -> dict[str, int]:
        """What was counted on the way; a plan known to be empty has nothing to count."""
        try:
            return {k: v or 0 for k, v in seen.get.items()}
        except Py4JJavaError:
            found = df.agg(F.count(F.lit(1)).alias("_rows"), *(c.alias(n) for n, c in counts.items())).first()
            return {k: v or 0 for k, v in found.asDict().items()}

    def discard(self, parts: list[Part]) -> None:
        """Deletes folders that no definition names."""
        for p in parts:
            remove(self.spark, p.path)

    def segment_bytes(self, table: Table) -> dict[int, int]:
        """Bytes on disk by segment."""
        out: dict[int, int] = {}
        for p in table.parts:
            for s in p.segments if p.segments is not None else [0]:
                where = p.path if p.segments is None else f"{p.path}/{P.SHARD}={s}"
                out[s] = out.get(s, 0) + self._fs.getContentSummary(path_of(self.spark, where)).getLength()
        return out

    def clean_up(self, hours: float) -> int:
        """Deletes folders of rows older than so many hours that no definition names; how many."""
        gone, oldest = 0, (time.time() - hours * 3600) * 1000
        for db in self.databases():
            tables = self.tables(db).values()
            used = {p.path.rsplit("/", 1)[1] for t in tables for p in t.parts}
            for store in (n for n in self._names(self._db_folder(db)) if n.endswith(".rows")):
                for f in statuses(self.spark, f"{self._db_folder(db)}/{store}"):
                    if f.getPath().getName() not in used and f.getModificationTime() <= oldest:
                        self._fs.delete(f.getPath(), True)
                        gone += 1
        return gone
