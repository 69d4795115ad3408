"""Schemas of the symbol graph, the chunk tables and the search hits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_s, _i, _l, _d, _b = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, t) for k, t in fields.items()])


NODES = _struct(
    package=_s, id=_s, kind=_s, name=_s, qualified_name=_s, file_path=_s, language=_s, start_line=_i, end_line=_i, start_column=_i, end_column=_i,
    docstring=_s, signature=_s, visibility=_s, is_exported=_b, is_async=_b, is_static=_b, is_abstract=_b, decorators=_s, type_parameters=_s, updated_at=_l,
)
EDGES = _struct(source=_s, target=_s, kind=_s, metadata=_s, line=_i, col=_i, provenance=_s)
FILES = _struct(package=_s, path=_s, content_hash=_s, language=_s, size=_l, modified_at=_l, indexed_at=_l, node_count=_l, errors=_s)
DOCS = _struct(package=_s, path=_s, chunk_index=_i, content=_s, start_line=_i, end_line=_i, start_byte=_i, end_byte=_i)
CODE = _struct(package=_s, path=_s, symbol=_s, kind=_s, signature=_s, content=_s, start_line=_i, end_line=_i)
HITS = _struct(
    seq=_l, run=_i, package=_s, origin=_s, path=_s, start_line=_i, end_line=_i, snippet=_s, symbol=_s, kind=_s, signature=_s, rrf=_d, from_original=_b, merged_count=_i
)

#: The newest schema version that can be read.
SCHEMA_VERSION = 4

#: File extension to language (fixed values).
EXTENSIONS = {
    "rs": "rust", "py": "python", "pyi": "python", "ts": "typescript", "mts": "typescript", "cts": "typescript", "tsx": "typescript", "js": "javascript",
    "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "hh": "cpp",
    "hxx": "cpp", "go": "go", "java": "java", "rb": "ruby", "php": "php", "kt": "kotlin", "kts": "kotlin", "swift": "swift", "scala": "scala", "sc": "scala", "cs": "csharp",
}


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` with exactly the columns of ``schema``: absent ones are null, others dropped."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def check_version(df: DataFrame, column: str = "version") -> int:
    """The schema version of a version table; an error if it is newer than can be read."""
    v = df.agg(F.coalesce(F.max(column), F.lit(0))).first()[0]
    if v > SCHEMA_VERSION:
        raise ValueError(f"schema version {v} is newer than {SCHEMA_VERSION}")
    return v


def language_of(path):
    """Language by file extension; null if unknown."""
    table = F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])
    return F.try_element_at(table, F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9_]+)$", 1)))
