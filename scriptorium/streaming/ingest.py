"""Incremental indexing of arriving files with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from scriptorium.operators.chunking import chunk_documents
from scriptorium.operators.manifest import changed_files
from scriptorium.shipping import ship_package
from scriptorium.sources.files import FILES, decode_text, document_metadata, file_rows, filter_hidden, filter_supported, open_system
from scriptorium.sources.index_store import table_exists
from scriptorium.streaming.changes import SETTLE_SECONDS, ChangedFiles


def arriving_files(spark: SparkSession, path: str, settle: float = SETTLE_SECONDS) -> DataFrame:
    """A stream of the files below path with their hashes; a file that is written again comes again.

    In a store that only Spark opens, paths that it has seen are not read again; there a
    changed file must arrive under a new name or through index_files.
    """
    ship_package(spark)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()
    try:
        open_system(full)
    except (ValueError, OSError, pa.ArrowException):
        return hashed(spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", True).load(path))
    spark.dataSource.register(ChangedFiles)
    return hashed(spark.readStream.format("changed_files").option("path", full).option("settle", str(settle)).load())


def hashed(files: DataFrame) -> DataFrame:
    """File rows as supported documents with the hash of their bytes."""
    docs = filter_hidden(filter_supported(document_metadata(files)))
    return docs.withColumn("hash", F.sha2("content", 256)).withColumn("content", decode_text(F.col("content")))


MANIFEST = "path string, hash string, batch long"


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path) if table_exists(spark, path) else spark.createDataFrame([], schema)


def current_manifest(spark: SparkSession, index_path: str, before: int | None = None) -> DataFrame:
    """(path, hash, batch): the latest row of each path, of batches below `before` if given."""
    rows = _read(spark, f"{index_path}/manifest", MANIFEST)
    rows = rows if before is None else rows.where(F.col("batch") < before)
    return rows.groupBy("path").agg(F.max(F.struct("batch", "hash")).alias("m")).select("path", "m.hash", "m.batch")


def current_chunks(spark: SparkSession, index_path: str) -> DataFrame:
    """The chunks of every source's latest version; those of replaced versions are left out."""
    latest = current_manifest(spark, index_path).select(F.col("path").alias("source"), "batch")
    return spark.read.parquet(f"{index_path}/chunks").join(latest, ["source", "batch"], "left_semi")


def index_batches(index_path: str, chunker: Callable[[DataFrame], DataFrame] = chunk_documents) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: skip files that are as their latest version, chunk the rest,
    write data first and the manifest last.

    Every batch writes its own folders, replaced if the batch is tried again. A changed
    file's chunks replace the earlier ones in current_chunks. Of two versions of one path
    in a batch the one of the greater hash counts.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        manifest = current_manifest(spark, index_path, batch_id)
        files = batch.withColumnRenamed("source", "path")
        newest = files.groupBy("path").agg(F.max_by(F.struct(*files.columns), F.col("hash")).alias("f")).select("f.*")
        fresh = changed_files(newest, manifest).withColumnRenamed("path", "source").persist()
        chunker(fresh).write.mode("overwrite").parquet(f"{index_path}/chunks/batch={batch_id}")
        fresh.select(F.col("source").alias("path"), "hash").write.mode("overwrite").parquet(f"{index_path}/manifest/batch={batch_id}")
        fresh.unpersist()

    return run


def stream_index(spark: SparkSession, path: str, index_path: str, checkpoint: str, chunker: Callable[[DataFrame], DataFrame] = chunk_documents, settle: float = SETTLE_SECONDS) -> StreamingQuery:
    """Index what is there and what arrived or changed since, then stop (availableNow)."""
    return arriving_files(spark, path, settle).writeStream.foreachBatch(index_batches(index_path, chunker)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def index_files(spark: SparkSession, path: str, index_path: str, chunker: Callable[[DataFrame], DataFrame] = chunk_documents) -> None:
    """Index every file below path that is new or changed, as one batch after those of the manifest."""
    latest = _read(spark, f"{index_path}/manifest", MANIFEST).agg(F.max("batch")).first()[0]
    index_batches(index_path, chunker)(hashed(file_rows(spark, path)), 0 if latest is None else latest + 1)


def stream_dedupe(files: DataFrame) -> DataFrame:
    """In-stream alternative: one row of each (source, hash)."""
    return files.dropDuplicates(["source", "hash"])
