"""Vectors: normalisation, compatibility and nearest neighbours."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def norm(v):
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def normalized(v):
    """The vector with length 1; a zero vector stays as it is."""
    n = norm(v)
    return F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))


def dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def compatible(metadata: DataFrame, model_id: str, dim: int) -> DataFrame:
    """Tables whose vectors come from the same model and have the same length."""
    return metadata.where((F.col("model_id") == model_id) & (F.col("dim") == dim))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", column: str = "embedding", block: int = 512, by: str | None = None) -> DataFrame:
    """(query_id, key, cosine, rank): the ``k`` nearest vectors of every query, itself left out.

    ``queries`` (query_id, query_vector) is a stated set, sent to the tasks in blocks of
    ``block``; each task keeps its best ``k`` of every query over all its rows and gives them
    out once, so what is shuffled grows with tasks and not with the table.  With ``by`` the
    ``k`` nearest of every group are kept, and the group is in the result.  Ties go to the
    smaller key.  Vectors of another length or of length zero match nothing.
    """
    spark = vectors.sparkSession
    g = [by] if by else []
    schema = ", ".join(f"`{c}` {dict(vectors.dtypes)[c]}" for c in g)
    out_schema = f"query_id bigint, {schema + ', ' if schema else ''}`{key}` bigint, cosine double"
    out, held = None, []

    def turn(rows):
        ids = np.array([r[0] for r in rows], dtype=np.int64)
        kept = spark.sparkContext.broadcast((ids, np.array([r[1] for r in rows], dtype=np.float64)))

        def run(batches):
            ids, q = kept.value
            best: dict = {}
            for pdf in batches:
                pdf = pdf[[x is not None and len(x) == q.shape[1] for x in pdf[column]]]
                if pdf.empty:
                    continue
                m = np.stack(pdf[column].to_numpy()).astype(np.float64)
                n = np.linalg.norm(m, axis=1)
                s = np.full((len(ids), len(m)), -np.inf)
                s[:, n > 0] = np.round((m[n > 0] / n[n > 0][:, None] @ q.T).T, 6)
                keys = pdf[key].to_numpy().astype(np.int64)
                s[ids[:, None] == keys[None, :]] = -np.inf
                groups = pdf[by].to_numpy() if by else np.zeros(len(m), dtype=np.int64)
                for name in pd.unique(groups):
                    own = groups == name
                    c, kk = s[:, own], np.broadcast_to(keys[own], (len(ids), int(own.sum())))
                    if name in best:
                        c, kk = np.concatenate([best[name][0], c], axis=1), np.concatenate([best[name][1], kk], axis=1)
                    # Sorted by key, then stably by cosine: ties stay with the smaller key.
                    o = np.argsort(kk, axis=1, kind="stable")
                    c, kk = np.take_along_axis(c, o, 1), np.take_along_axis(kk, o, 1)
                    o = np.argsort(-c, axis=1, kind="stable")[:, :k]
                    best[name] = (np.take_along_axis(c, o, 1), np.take_along_axis(kk, o, 1))
            for name, (c, kk) in best.items():
                a, b = np.nonzero(np.isfinite(c))
                frame = {"query_id": ids[a], **({by: name} if by else {}), key: kk[a, b], "cosine": c[a, b]}
                yield pd.DataFrame(frame)

        return vectors.select(*g, key, column).mapInPandas(run, out_schema)

    for r in queries.select("query_id", normalized(F.col("query_vector")).alias("v")).toLocalIterator():
        held.append(r)
        if len(held) == block:
            out, held = (turn(held) if out is None else out.unionByName(turn(held))), []
    if held:
        out = turn(held) if out is None else out.unionByName(turn(held))
    if out is None:
        return spark.createDataFrame([], out_schema + ", rank int")
    w = Window.partitionBy("query_id", *g).orderBy(F.desc("cosine"), key)
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def hashed_embedding(dim: int = 64):
    """A deterministic text embedder: signed feature hashing of words, length 1."""
    import re
    import zlib

    word = re.compile(r"\w+")

    @F.pandas_udf("array<float>")
    def embed(s: pd.Series) -> pd.Series:
        out = []
        for t in s:
            v = np.zeros(dim, dtype=np.float64)
            for w in word.findall((t or "").lower()):
                h = zlib.crc32(w.encode("utf-8", "surrogatepass"))
                v[h % dim] += 1.0 if h >> 31 else -1.0
            n = np.linalg.norm(v)
            out.append((v / n if n else v).astype(np.float32).tolist())
        return pd.Series(out)

    return embed


def embed_table(chunks: DataFrame, content: str, dim: int = 64, force: bool = False, column: str = "vector") -> DataFrame:
    """Adds a vector to every row, or only where it is missing unless ``force``."""
    made = hashed_embedding(dim)(F.col(content))
    if column in chunks.columns and not force:
        return chunks.withColumn(column, F.coalesce(F.col(column), made))
    return chunks.withColumn(column, made)


def stamped(chunks: DataFrame, content: str, model, force: bool = False, column: str = "vector") -> tuple[DataFrame, dict]:
    """(table with vectors, what to note about them): model id, dimension and column.

    ``model``: model_id, dim and embed_document (see ``models``); texts are embedded in
    batches.  Vectors of another dimension than the model says are an error.
    """
    @F.pandas_udf("array<float>")
    def embed(s: pd.Series) -> pd.Series:
        out = [model.embed_document(t or "") for t in s]
        if any(len(v) != model.dim for v in out):
            raise ValueError(f"{model.model_id} gave vectors of another length than {model.dim}")
        return pd.Series([np.asarray(v, dtype=np.float32).tolist() for v in out])

    made = embed(F.col(content))
    table = chunks.withColumn(column, F.coalesce(F.col(column), made)) if column in chunks.columns and not force else chunks.withColumn(column, made)
    return table, {"embedding_model": model.model_id, "embedding_dim": model.dim, "vector_column": column}


def to_embed(tables: DataFrame, model_id: str, dim: int, force: bool = False) -> DataFrame:
    """Tables (name, model_id, dim) that have no vectors of this model yet; all if ``force``."""
    return tables if force else tables.where(~(F.col("model_id").eqNullSafe(F.lit(model_id)) & F.col("dim").eqNullSafe(F.lit(dim))))
