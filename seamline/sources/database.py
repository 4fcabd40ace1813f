"""SQLite and DuckDB files as a Spark data source: ranges of a key are read in parallel, by the files' own queries.

The file must lie where every executor can open it, and the package where the driver's Python workers find it. ``register(spark)``, then
``spark.read.format("seamline_db").option("path", ...).option("table", ...).load()``. Conditions and columns are options of a scan: Spark 4.1
keeps what one query pushed to a Python source for the next query of the same DataFrame, so filters of the plan stay in Spark.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator
from contextlib import closing
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: Spark's types for the names that the two engines give theirs; any other column is read as text.
TYPES = {"BIGINT": "bigint", "INTEGER": "bigint", "INT": "bigint", "SMALLINT": "bigint", "TINYINT": "bigint", "UBIGINT": "decimal(20,0)", "HUGEINT": "decimal(38,0)", "DOUBLE": "double", "REAL": "double", "FLOAT": "double", "BOOLEAN": "boolean"}
#: The same for DuckDB alone, which gives values of these types; in SQLite they are numbers or text.
DUCK_TYPES = TYPES | {"DATE": "date", "TIMESTAMP": "timestamp_ntz"}


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


@dataclass
class Range(InputPartition):
    """Rows whose key is at least ``low`` and below ``high``; either may be open. The first range holds the rows without a key too."""

    low: int | None
    high: int | None


class Table:
    """One table or query of one file."""

    def __init__(self, options: dict):
        self.path, self.kind = options["path"], options.get("kind") or ("sqlite" if options["path"].endswith((".sqlite", ".sqlite3", ".db")) else "duckdb")
        if self.kind not in ("sqlite", "duckdb"):
            raise ValueError(f"unknown kind of file {self.kind!r}")
        if ("table" in options) == ("query" in options):
            raise ValueError("either a table or a query is needed")
        self.source = quoted(options["table"]) if "table" in options else f"({options['query']})"
        self.where, self.picked = options.get("where"), options.get("columns")
        self.key, self.parts = options.get("key"), int(options.get("partitions", 8))

    def connect(self):
        if self.kind == "sqlite":
            return closing(sqlite3.connect(f"file:{self.path}?mode=ro", uri=True))
        import duckdb

        return closing(duckdb.connect(self.path, read_only=True))

    def columns(self) -> list[tuple[str, str]]:
        known = self._columns()
        if not self.picked:
            return known
        kinds = dict(known)
        if missing := [c for c in self.picked.split(",") if c not in kinds]:
            raise KeyError(f"no columns {missing}")
        return [(c, kinds[c]) for c in self.picked.split(",")]

    def _columns(self) -> list[tuple[str, str]]:
        with self.connect() as db:
            if self.kind == "duckdb":
                return [(r[0], DUCK_TYPES.get(r[1].upper(), "string")) for r in db.execute(f"describe select * from {self.source}").fetchall()]
            told = {r[1]: r[2] for r in db.execute(f"pragma table_info({self.source})").fetchall()} if self.source.startswith('"') else {}
            first = db.execute(f"select * from {self.source} limit 1")
            row = first.fetchone()
            kinds = {int: "bigint", float: "double"}
            return [(c[0], TYPES.get(told.get(c[0], "").upper().split("(")[0]) or ("string" if told.get(c[0]) else kinds.get(type(row[i]) if row else str, "string"))) for i, c in enumerate(first.description)]


class Reader(DataSourceReader):
    def __init__(self, table: Table, schema: StructType):
        self.table, self.schema = table, schema

    def partitions(self) -> list[Range]:
        if not self.table.key:
            return [Range(None, None)]
        with self.table.connect() as db:
            only = f" where {self.table.where}" if self.table.where else ""
            low, high = db.execute(f"select min({quoted(self.table.key)}), max({quoted(self.table.key)}) from {self.table.source}{only}").fetchone()
        if low is None:
            return [Range(None, None)]
        step = max(1, -(-(int(high) - int(low) + 1) // self.table.parts))
        cuts = list(range(int(low) + step, int(high) + 1, step))
        return [Range(a, b) for a, b in zip([None, *cuts], [*cuts, None], strict=True)]

    def read(self, part: Range) -> Iterator[tuple]:
        where, key = [(f"({self.table.where})", [])] if self.table.where else [], quoted(self.table.key) if self.table.key else None
        if part.low is not None:
            where.append((f"{key} >= ?", [part.low]))
        if part.high is not None:
            where.append((f"({key} < ?{' or ' + key + ' is null' if part.low is None else ''})", [part.high]))
        text = f"select {', '.join(quoted(f.name) for f in self.schema)} from {self.table.source}" + (" where " + " and ".join(w for w, _ in where) if where else "")
        texts = [i for i, f in enumerate(self.schema) if f.dataType.simpleString() == "string"]
        with self.table.connect() as db:
            rows = db.execute(text, [v for _, values in where for v in values])
            while some := rows.fetchmany(2_000):
                for row in some:
                    row = list(row)
                    for i in texts:
                        row[i] = row[i] if row[i] is None else str(row[i])
                    yield tuple(row)


class FileDatabase(DataSource):
    """Options: ``path``; ``table`` or ``query``; ``kind`` (``sqlite`` or ``duckdb``, told from the path otherwise); ``key``, an integer column whose ranges are read in ``partitions`` (8) tasks; ``where``, a condition in the file's own SQL; ``columns``, with commas between."""

    @classmethod
    def name(cls) -> str:
        return "seamline_db"

    def schema(self) -> str:
        return ", ".join(f"`{c}` {kind}" for c, kind in Table(self.options).columns())

    def reader(self, schema: StructType) -> Reader:
        return Reader(Table(self.options), schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FileDatabase)


def scan(spark: SparkSession, path: str, dates: list[str] = (), columns: list[str] | None = None, **options) -> DataFrame:
    """A table or query of a SQLite or DuckDB file; columns in ``dates``, which SQLite keeps as text, become dates.

    ``where`` and ``columns`` are the file's own work: no other rows and columns leave it.
    """
    register(spark)
    if columns:
        options["columns"] = ",".join(columns)
    rows = spark.read.format("seamline_db").options(path=path, **{k: str(v) for k, v in options.items()}).load()
    return rows.withColumns({c: F.to_date(c) for c in dates})
