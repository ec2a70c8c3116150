"""Embedding columns and exact nearest neighbours by inner product."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEY = ["source", "chunk_index"]
#: Queries and vectors of a cell, and tasks that work on cells, at most.
QUERIES_PER_CELL, VECTORS_PER_CELL, MOST_TASKS = 1 << 13, 1 << 15, 10_000
#: Scores held at once: a tile of queries times a tile of vectors.
QUERIES_PER_TILE, VECTORS_PER_TILE = 512, 4096
#: Characters of texts that are encoded in one call, at most, if they are more than one.
CHARACTERS_AT_ONCE = 1 << 20


def hashing_encoder(dim: int = 64) -> Callable[[list[str]], np.ndarray]:
    """A deterministic stand-in for a model: words hashed to signed buckets. Not semantic."""

    def encode(texts: list[str]) -> np.ndarray:
        words = [(t or "").lower().split() for t in texts]
        flat = [w for x in words for w in x]
        known = {w: zlib.crc32(w.encode()) for w in set(flat)}
        h = np.fromiter(map(known.__getitem__, flat), dtype=np.int64, count=len(flat))
        row = np.repeat(np.arange(len(texts)), [len(x) for x in words])
        out = np.bincount(row * dim + h % dim, weights=np.where(h & 0x8000_0000, 1.0, -1.0), minlength=len(texts) * dim).reshape(len(texts), dim).astype(np.float32)
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norm, out=out, where=norm > 0)

    return encode


def _encoded_at_once(texts: pd.Series) -> Iterator[list[str]]:
    """Neighbouring texts of CHARACTERS_AT_ONCE characters together, or a longer one alone; missing ones are empty."""
    held, size = [], 0
    for text in texts:
        text = "" if text is None or text is pd.NA or text != text else text
        if held and size + len(text) > CHARACTERS_AT_ONCE:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


def embed(df: DataFrame, text_col: str, encode: Callable[[list[str]], np.ndarray], out_col: str = "embedding") -> DataFrame:
    """df with normalised float vectors of a text column, encoded in Arrow batches."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([v for part in _encoded_at_once(texts) for v in _normalised(part)], dtype=object)

    def _normalised(texts: list[str]) -> np.ndarray:
        v = np.asarray(encode(texts), dtype=np.float32)
        norm = np.linalg.norm(v, axis=1, keepdims=True)
        return np.divide(v, norm, out=v.copy(), where=norm > 0)

    return df.withColumn(out_col, run(text_col))


def vector_topk(queries: DataFrame, vectors: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """(query_id, rank, source, chunk_index, score): exact top k by inner product.

    queries(query_id, query_vec, user_id) and vectors(source, chunk_index, embedding,
    user_id); query_id may be of any type that Spark can hash. A query with a user_id sees
    that user's vectors only, before the cut. Scores are rounded first; ties go to the smaller
    source and chunk_index. Queries and vectors without a value, and vectors of another length
    than the query, take no part. Both sides are dealt into blocks, and each pair of blocks is
    one task's work, which hands on k rows for each query; nothing passes through the driver.
    """
    if "user_id" not in queries.columns:
        queries = queries.withColumn("user_id", F.lit(None).cast("string"))
    if "user_id" not in vectors.columns:
        vectors = vectors.withColumn("user_id", F.lit(None).cast("string"))
    asked = queries.select("query_id", F.col("query_vec").alias("vec"), F.col("user_id").cast("string").alias("user_id")).where("vec IS NOT NULL").withColumn("dim", F.size("vec"))
    held = vectors.select(*KEY, F.col("embedding").alias("vec"), F.col("user_id").cast("string").alias("user_id")).where("vec IS NOT NULL").withColumn("dim", F.size("vec"))
    rows, columns = (max(1, -(-df.count() // most)) for df, most in ((asked, QUERIES_PER_CELL), (held, VECTORS_PER_CELL)))
    block = lambda key, n: F.pmod(F.xxhash64(*key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cell = ["dim", "row", "column"]
    asked = asked.withColumn("row", block(["query_id"], rows)).withColumn("column", every(columns)).repartition(min(rows * columns, MOST_TASKS), *cell)
    held = held.withColumn("column", block(KEY, columns)).withColumn("row", every(rows)).repartition(min(rows * columns, MOST_TASKS), *cell)
    out = T.StructType([queries.schema["query_id"], T.StructField("source", T.StringType()), T.StructField("chunk_index", T.IntegerType()), T.StructField("score", T.DoubleType())])
    best = asked.groupBy(*cell).cogroup(held.groupBy(*cell)).applyInArrow(lambda q, v: _best_in_cell(q, v, k, digits), out)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), *KEY)
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", *KEY, "score")


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """List values of one length as rows; missing components are not numbers."""
    flat = column.combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _owners(column: pa.ChunkedArray) -> np.ndarray:
    return np.array([u or "" for u in column.to_pylist()], dtype=object)


def _best_in_cell(queries: pa.Table, vectors: pa.Table, k: int, digits: int) -> pa.Table:
    """The k best vectors of a block for each query of a block."""
    vectors = vectors.sort_by([(c, "ascending") for c in KEY])  # of equal scores the first row then wins
    taken: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if queries.num_rows and vectors.num_rows:
        asked, asking = _matrix(queries.column("vec")).astype(np.float64), _owners(queries.column("user_id"))
        held, owner = _matrix(vectors.column("vec")), _owners(vectors.column("user_id"))
        for a in range(0, len(asked), QUERIES_PER_TILE):
            who = asking[a : a + QUERIES_PER_TILE]
            q, v, s = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
            floor = np.full(len(who), -np.inf)
            for b in range(0, len(held), VECTORS_PER_TILE):
                score = np.round(asked[a : a + QUERIES_PER_TILE] @ held[b : b + VECTORS_PER_TILE].astype(np.float64).T, digits)
                score[np.isnan(score)] = -np.inf
                if (who != "").any():
                    score[(who[:, None] != "") & (who[:, None] != owner[None, b : b + VECTORS_PER_TILE])] = -np.inf
                least = -np.partition(-score, min(k, score.shape[1]) - 1, axis=1)[:, min(k, score.shape[1]) - 1]
                x, y = np.nonzero((score > floor[:, None]) & (score >= least[:, None]) & np.isfinite(score))
                q, v, s = np.concatenate([q, x]), np.concatenate([v, y + b]), np.concatenate([s, score[x, y]])
                order = np.lexsort((v, -s, q))
                q, v, s = q[order], v[order], s[order]
                place = np.arange(len(q)) - np.searchsorted(q, q)
                floor[q[place == k - 1]] = s[place == k - 1]
                q, v, s = (z[place < k] for z in (q, v, s))
            taken.append((q + a, v, s))
    q, v, s = (np.concatenate([np.zeros(0, dtype=t), *(x[n] for x in taken)]) for n, t in enumerate((np.int64, np.int64, np.float64)))
    hits = vectors.select(KEY).take(pa.array(v))
    return pa.table([queries.column("query_id").take(pa.array(q)), hits.column(0), hits.column(1).cast(pa.int32()), pa.array(s)], names=["query_id", *KEY, "score"])


def validate_vectors(chunks: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
    """One row: chunks without a vector, vectors without a chunk, vectors of another dimension."""
    missing = chunks.join(vectors, KEY, "left_anti").agg(F.count("*").alias("missing_vectors"))
    orphan = vectors.join(chunks, KEY, "left_anti").agg(F.count("*").alias("orphan_vectors"))
    wrong = vectors.where(F.size("embedding") != dim).agg(F.count("*").alias("wrong_dimension"))
    return missing.crossJoin(orphan).crossJoin(wrong)


def require_valid(chunks: DataFrame, vectors: DataFrame, dim: int) -> None:
    """Raises unless every chunk has one vector of dimension dim."""
    row = validate_vectors(chunks, vectors, dim).first()
    if any(row):
        raise ValueError(f"vectors do not match chunks: {row.asDict()}")
