"""SQLite files as a read-only Spark data source.

``spark.dataSource.register(SqliteSource)``, then
``spark.read.format("ravelin_sqlite").option("path", file).option("table", name).load()``.
"""

from __future__ import annotations

import sqlite3

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BinaryType, DoubleType, LongType, StringType, StructField, StructType

_TYPES = {"INTEGER": LongType(), "INT": LongType(), "REAL": DoubleType(), "BLOB": BinaryType()}


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro&immutable=1", uri=True)


class SqliteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ravelin_sqlite"

    def schema(self) -> StructType:
        with _open(self.options["path"]) as c:
            cols = c.execute(f'PRAGMA table_info("{self.options["table"]}")').fetchall()
        return StructType([StructField(n, _TYPES.get((t or "").upper(), StringType())) for _, n, t, *_ in cols])

    def reader(self, schema: StructType) -> DataSourceReader:
        return SqliteReader(self.options, schema)


class Range(InputPartition):
    def __init__(self, lo: int, hi: int):
        self.lo, self.hi = lo, hi


class SqliteReader(DataSourceReader):
    """Reads ranges of row ids in parallel."""

    def __init__(self, options, schema: StructType):
        self.path, self.table, self.schema = options["path"], options["table"], schema
        self.parts = int(options.get("partitions", 4))

    def partitions(self):
        with _open(self.path) as c:
            lo, hi = c.execute(f'SELECT coalesce(min(rowid), 0), coalesce(max(rowid), -1) FROM "{self.table}"').fetchone()
        step = max(1, -(-(hi - lo + 1) // self.parts))
        return [Range(a, min(a + step, hi + 1)) for a in range(lo, hi + 1, step)] or [Range(0, 0)]

    def read(self, partition: Range):
        cols = ", ".join(f'"{f.name}"' for f in self.schema)
        with _open(self.path) as c:
            yield from c.execute(f'SELECT {cols} FROM "{self.table}" WHERE rowid >= ? AND rowid < ?', (partition.lo, partition.hi))


#: Tables of a graph file and their keys (fixed values).
_DDL = {
    "schema_versions": "version INTEGER PRIMARY KEY",
    "nodes": "id TEXT PRIMARY KEY, kind TEXT, name TEXT, qualified_name TEXT, file_path TEXT, language TEXT, start_line INTEGER, end_line INTEGER, start_column INTEGER, end_column INTEGER, docstring TEXT, signature TEXT, visibility TEXT, "
    "is_exported INTEGER, is_async INTEGER, is_static INTEGER, is_abstract INTEGER, decorators TEXT, type_parameters TEXT, updated_at INTEGER",
    "edges": "id INTEGER PRIMARY KEY, source TEXT REFERENCES nodes(id) ON DELETE CASCADE, target TEXT REFERENCES nodes(id) ON DELETE CASCADE, kind TEXT, metadata TEXT, line INTEGER, col INTEGER, provenance TEXT",
    "files": "path TEXT PRIMARY KEY, content_hash TEXT, language TEXT, size INTEGER, modified_at INTEGER, indexed_at INTEGER, node_count INTEGER, errors TEXT",
}


def export_graph(nodes: DataFrame, edges: DataFrame, files: DataFrame, path: str, block: int = 1_000) -> None:
    """Writes the graph of one package as an SQLite file: the first node of an id, every edge,
    the last file of a path, versions and statistics.

    Rows come to the driver one partition at a time and are written in blocks; such a file
    holds one package, the tables of many stay Parquet.
    """
    con = sqlite3.connect(path)
    try:
        con.execute("PRAGMA foreign_keys = OFF")
        for t, ddl in _DDL.items():
            con.execute(f"DROP TABLE IF EXISTS {t}")
            con.execute(f"CREATE TABLE {t} ({ddl})")
        con.executemany("INSERT INTO schema_versions VALUES (?)", [(1,), (4,)])
        for t, df, how in (("nodes", nodes, "IGNORE"), ("edges", edges, "ABORT"), ("files", files, "REPLACE")):
            cols = [c.split()[0] for c in _DDL[t].split(", ") if c.split()[0] in df.columns and not (t == "edges" and c.startswith("id "))]
            sql = f"INSERT OR {how} INTO {t} ({', '.join(cols)}) VALUES ({', '.join('?' * len(cols))})"
            held: list[tuple] = []
            for r in df.select(*cols).toLocalIterator():
                held.append(tuple(int(v) if isinstance(v, bool) else v for v in r))
                if len(held) == block:
                    con.executemany(sql, held)
                    held = []
            con.executemany(sql, held)
        con.execute("CREATE INDEX edges_by_source ON edges(source, kind)")
        con.execute("CREATE INDEX edges_by_target ON edges(target, kind)")
        con.execute("ANALYZE")
        con.commit()
    finally:
        con.close()
