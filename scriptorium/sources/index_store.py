"""The index on disk: immutable parts of Parquet tables and numbered versions that name them.

A version is one small file in `versions/`; it lists the parts below `data/` that it reads.
A writer puts a new part beside the others and then creates the next version's file, which
must not be there yet: readers see the old version or the new one, a run that dies leaves the
old one, and of two writers at once the second fails. Numbers add up over parts: a part has the
counts by term of its own chunks only, and a deletion takes off what the deleted chunks
counted, so nothing is counted twice until compact_index merges the parts.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.operators import bm25
from scriptorium.operators.vectors import KEY

#: Tables that read_index gives.
TABLES = ("chunks", "vectors", "postings", "collection", "terms")
#: Tables of a part whose rows a deletion takes away.
_ROWS = ("chunks", "vectors", "postings")
_DELETED = "user_id string, source string, version long"
#: Unlisted parts younger than this may belong to a writer that has not finished.
ORPHAN_SECONDS = 7 * 24 * 3600


class VersionConflict(RuntimeError):
    """Another writer made the version first; read it and write again."""


def _fs(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def table_exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a folder or file at path, asked of the path's own file system."""
    fs, hadoop = _fs(spark, path)
    return fs.exists(hadoop)


def _content(spark: SparkSession, path: str) -> dict | None:
    """What a version's file says; None if it was not written to its end."""
    fs, hadoop = _fs(spark, path)
    stream = fs.open(hadoop)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return json.loads(text) if text.endswith("\n") else None


def _numbers(spark: SparkSession, path: str) -> list[int]:
    fs, hadoop = _fs(spark, f"{path}/versions")
    return sorted(int(s.getPath().getName()) for s in fs.listStatus(hadoop) if s.getPath().getName().isdigit()) if fs.exists(hadoop) else []


def versions(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the versions that can be read, oldest first."""
    return [n for n in _numbers(spark, path) if _content(spark, f"{path}/versions/{n:08d}")]


def _parts(spark: SparkSession, path: str, version: int | None) -> list[str]:
    found = versions(spark, path) if version is None else [version]
    if not found:
        return []
    content = _content(spark, f"{path}/versions/{found[-1]:08d}")
    if content is None:
        raise ValueError(f"version {version} was not written to its end")
    return content["parts"]


def _commit(spark: SparkSession, path: str, version: int, parts: list[str]) -> int:
    fs, hadoop = _fs(spark, f"{path}/versions/{version:08d}")
    try:
        stream = fs.create(hadoop, False)
    except Exception as e:
        if fs.exists(hadoop):
            raise VersionConflict(f"version {version} of {path} is there already") from e
        raise
    try:
        stream.write(bytearray((json.dumps({"parts": parts, "at": time.time()}) + "\n").encode()))
    finally:
        stream.close()
    return version


def _next(spark: SparkSession, path: str) -> int:
    return max(_numbers(spark, path), default=0) + 1


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _owned(df: DataFrame, version: int) -> DataFrame:
    user = F.col("user_id").cast("string") if "user_id" in df.columns else F.lit(None).cast("string")
    return df.withColumn("user_id", user).withColumn("version", F.lit(version).cast("long"))


def _write_part(path: str, version: int, chunks: DataFrame, vectors: DataFrame, post: DataFrame | None = None) -> str:
    """Write the tables of further chunks; post has their postings if there are any already."""
    spark, part = chunks.sparkSession, f"data/{version:08d}-{uuid.uuid4().hex}"
    at = f"{path}/{part}"
    kept = _written(_owned(chunks, version), f"{at}/chunks")
    _owned(vectors, version).write.parquet(f"{at}/vectors")
    post = _written(_owned(bm25.postings(kept) if post is None else post, version), f"{at}/postings")
    bm25.term_counts(post).write.parquet(f"{at}/counts")
    bm25.collection_counts(post).write.parquet(f"{at}/totals")
    spark.createDataFrame([], _DELETED).write.parquet(f"{at}/deleted")
    return part


def _write_deletion(path: str, version: int, index: dict[str, DataFrame], gone: DataFrame) -> str:
    """Write a part that takes off the chunks of (user_id, source), as they are in the index now."""
    spark, part = gone.sparkSession, f"data/{version:08d}-{uuid.uuid4().hex}"
    at = f"{path}/{part}"
    gone = _written(_owned(gone.select(*(c for c in ("user_id", "source") if c in gone.columns)), version).select("user_id", "source", "version").distinct(), f"{at}/deleted")
    lost = _matched(index["postings"], gone.drop("version"), "left_semi")
    bm25.term_counts(lost).select("term", (-F.col("df")).alias("df")).write.parquet(f"{at}/counts")
    bm25.collection_counts(lost).select((-F.col("n")).alias("n"), (-F.col("tokens")).alias("tokens")).write.parquet(f"{at}/totals")
    return part


def _matched(table: DataFrame, gone: DataFrame, how: str) -> DataFrame:
    """Rows of a table whose owner and source are, or are not, among those of gone."""
    few = gone.limit(bm25.MOST_BROADCAST_TERMS + 1).count() <= bm25.MOST_BROADCAST_TERMS
    named = gone.select(F.col("user_id").alias("_user"), F.col("source").alias("_source"), *(F.col(c).alias("_until") for c in gone.columns if c == "version"))
    met = table["user_id"].eqNullSafe(named["_user"]) & (table["source"] == named["_source"])
    if "_until" in named.columns:
        met &= table["version"] < named["_until"]
    return table.join(F.broadcast(named) if few else named, met, how)


def _read(spark: SparkSession, path: str, parts: list[str], table: str) -> DataFrame | None:
    found = [f"{path}/{p}/{table}" for p in parts]
    found = [p for p in found if table_exists(spark, p)]
    return spark.read.option("mergeSchema", True).parquet(*found) if found else None


def read_index(spark: SparkSession, path: str, version: int | None = None) -> dict[str, DataFrame]:
    """The tables by name, of the latest version or of a given one; keyword search takes this as its index.

    The parts are fixed when this is called: what is written later does not show. Rows of
    deleted sources are left out, and the statistics are those of the rest.
    """
    parts = _parts(spark, path, version)
    if not parts:
        raise AnalysisException(f"no index at {path}")
    deleted = _read(spark, path, parts, "deleted").groupBy("user_id", "source").agg(F.max("version").alias("version"))
    tables = {t: _read(spark, path, parts, t) for t in _ROWS}
    if deleted.limit(1).count():
        tables = {t: _matched(df, deleted, "left_anti") for t, df in tables.items()}
    whole = bm25.mean_length(_read(spark, path, parts, "totals").agg(F.sum("n").alias("n"), F.sum("tokens").alias("tokens")))
    counts = _read(spark, path, parts, "counts").groupBy("term").agg(F.sum("df").alias("df"))
    tables = {t: df.drop("version") for t, df in tables.items()}
    return tables | {"collection": whole, "terms": bm25.term_statistics(counts.where("df > 0"), whole)}


def write_index(chunks: DataFrame, vectors: DataFrame, path: str) -> int:
    """Write an index anew as the next version, which is returned; earlier versions stay readable."""
    spark = chunks.sparkSession
    version = _next(spark, path)
    return _commit(spark, path, version, [_write_part(path, version, chunks, vectors)])


def append_index(chunks: DataFrame, vectors: DataFrame, path: str) -> int:
    """Add chunks and vectors of further sources as the next version; only they are counted."""
    spark = chunks.sparkSession
    version, parts = _next(spark, path), _parts(spark, path, None)
    return _commit(spark, path, version, [*parts, _write_part(path, version, chunks, vectors)])


def delete_sources(gone: DataFrame, path: str) -> int:
    """Delete the chunks of (user_id, source) from all tables, as the next version.

    Another user's source of the same name stays; rows without a user_id are of no user.
    Sources that the index does not hold change nothing.
    """
    spark = gone.sparkSession
    version, parts = _next(spark, path), _parts(spark, path, None)
    return _commit(spark, path, version, [*parts, _write_deletion(path, version, read_index(spark, path), gone)])


def replace_sources(chunks: DataFrame, vectors: DataFrame, path: str, target: str | None = None) -> int:
    """Replace the sources of `chunks`, whatever their number of rows was, as the next version.

    With a target, the result is written there as an index of its own and the one at path
    stays as it is.
    """
    spark = chunks.sparkSession
    again = _owned(chunks, 0).select("user_id", "source").distinct()
    old = read_index(spark, path)
    if target is None:
        version, parts = _next(spark, path), _parts(spark, path, None)
        return _commit(spark, path, version, [*parts, _write_deletion(path, version, old, again), _write_part(path, version, chunks, vectors)])
    version = _next(spark, target)
    kept = {t: _matched(old[t], again, "left_anti") for t in ("chunks", "vectors", "postings")}
    return _commit(spark, target, version, [_write_part(target, version, kept["chunks"], kept["vectors"], kept["postings"]), _write_part(target, version, chunks, vectors)])


def compact_index(spark: SparkSession, path: str) -> int:
    """Write the rows that are left as one part, as the next version; postings are not made again."""
    version, index = _next(spark, path), read_index(spark, path)
    return _commit(spark, path, version, [_write_part(path, version, index["chunks"], index["vectors"], index["postings"])])


def reset_index(spark: SparkSession, path: str) -> int:
    """An empty index with the same columns, as the next version."""
    version, index = _next(spark, path), read_index(spark, path)
    return _commit(spark, path, version, [_write_part(path, version, *(index[t].where("false") for t in ("chunks", "vectors", "postings")))])


def expire_versions(spark: SparkSession, path: str, keep: int = 2, orphan_seconds: float = ORPHAN_SECONDS) -> list[int]:
    """Forget all but the latest versions, and delete the parts that none of them reads.

    Readers pinned to a forgotten version fail on their next read. Parts that no version ever
    named, left by runs that died, go once they are old enough. The remaining numbers are returned.
    """
    stays = versions(spark, path)[-max(1, keep) :]
    named = {p for n in _numbers(spark, path) for p in (_content(spark, f"{path}/versions/{n:08d}") or {"parts": []})["parts"]}
    needed = {p for n in stays for p in _parts(spark, path, n)}
    fs, _ = _fs(spark, path)
    at = spark._jvm.org.apache.hadoop.fs.Path
    for n in _numbers(spark, path):
        if n < stays[0]:
            fs.delete(at(f"{path}/versions/{n:08d}"), False)
    for s in fs.listStatus(at(f"{path}/data")):
        part = f"data/{s.getPath().getName()}"
        if part not in needed and (part in named or time.time() - s.getModificationTime() / 1000 > orphan_seconds):
            fs.delete(s.getPath(), True)
    return stays


def points(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Chunks with their vectors and a stable id."""
    return chunks.join(vectors.select(*KEY, "embedding"), KEY).withColumn("point_id", F.sha2(F.concat_ws("\0", "source", F.col("chunk_index").cast("string")), 256))


def append_points(chunks: DataFrame, vectors: DataFrame, path: str) -> None:
    """Append points; those that are stored already are not stored twice."""
    new, spark = points(chunks, vectors), chunks.sparkSession
    if table_exists(spark, path):
        new = new.join(spark.read.parquet(path).select("point_id"), "point_id", "left_anti").select(*new.columns)
    new.write.mode("append").parquet(path)
