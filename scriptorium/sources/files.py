"""Text documents from files and index requests."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.shipping import ship_package
from scriptorium.storage import stored

#: Fixed list of file types.
SUPPORTED = (".txt", ".md", ".pdf")
#: Entries of a folder handed on at once; files and bytes that one task reads, about.
ENTRIES_AT_ONCE, FILES_OF_TASK, BYTES_OF_TASK = 10_000, 2_000, 128 << 20
FILES = "path string, modificationTime timestamp, length long, content binary"


def decode_text(content: Column) -> Column:
    """UTF-8, else Latin-1; line ends become newlines."""
    as_text = F.when(F.call_function("is_valid_utf8", content.cast("string")), F.decode(content, "UTF-8")).otherwise(F.decode(content, "ISO-8859-1"))
    return F.regexp_replace(as_text, "\r\n?", "\n")


def filename_of(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension_of(filename: Column) -> Column:
    """The last suffix in lower case with its dot, or empty."""
    return F.lower(F.regexp_extract(filename, r".(\.[^.]+)$", 1))


def document_metadata(files: DataFrame) -> DataFrame:
    """(path, content, length) to document columns; content stays as it is."""
    named = files.withColumn("filename", filename_of(F.col("path")))
    return named.select(
        F.col("path").alias("source"),
        "filename",
        extension_of(F.col("filename")).alias("extension"),
        F.col("length").alias("size_bytes"),
        F.current_timestamp().alias("created_at"),
        F.lit("unknown").alias("language"),
        "content",
    )


def filter_supported(docs: DataFrame, extensions: tuple[str, ...] = SUPPORTED) -> DataFrame:
    return docs.where(F.lower("extension").isin(*extensions))


def filter_hidden(docs: DataFrame) -> DataFrame:
    """Without files whose own name starts with a dot."""
    return docs.where(~F.col("filename").startswith("."))


def open_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it, for Python tasks; ValueError or ArrowException if Python has none for it."""
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file:{path}")


def folder_entries(path: str) -> Iterator[fs.FileInfo]:
    """What a folder holds, or the file itself; nothing if it is gone."""
    system, inner = open_system(path)
    (own,) = system.get_file_info([inner])
    if own.type == fs.FileType.File:
        yield own
    elif own.type == fs.FileType.Directory:
        yield from system.get_file_info(fs.FileSelector(inner))


def read_file(path: str) -> bytes | None:
    """A file's bytes; None if it cannot be read."""
    try:
        system, inner = open_system(path)
        with system.open_input_stream(inner, compression=None) as f:
            return f.read()
    except OSError:
        return None


def _entries(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(path) of folders to the rows of their entries, a folder at a time."""
    for frame in frames:
        for folder in frame["path"]:
            prefix = folder[: len(folder) - len(open_system(folder)[1])]
            rows = [(prefix + e.path, e.mtime, e.size or 0, e.type == fs.FileType.Directory) for e in folder_entries(folder)]
            for lo in range(0, len(rows), ENTRIES_AT_ONCE):
                yield pd.DataFrame(rows[lo : lo + ENTRIES_AT_ONCE], columns=["path", "modificationTime", "length", "folder"])


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, modificationTime, length) of every file at or below path, whatever its name.

    Tasks list the folders, level by level; the driver only learns whether a level has more.
    """
    ship_package(spark)
    schema = "path string, modificationTime timestamp, length long, folder boolean"
    level = spark.createDataFrame([(path.rstrip("/") or "/",)], "path string")
    found = None
    while True:
        entries = stored(level.mapInPandas(_entries, schema), "listed")
        files = entries.where("NOT folder").drop("folder")
        found = files if found is None else found.unionByName(files)
        folders = entries.where("folder").select("path")
        if not folders.limit(1).count():
            return found
        level = folders.repartition(F.xxhash64("path"))


def _contents(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """File rows, one at a time, so that a task holds the bytes of one file."""
    for frame in frames:
        for row in frame.itertuples(index=False):
            content = read_file(row.path)
            if content is not None:
                yield pd.DataFrame([(row.path, row.modificationTime, row.length, content)], columns=["path", "modificationTime", "length", "content"])


def file_rows(spark: SparkSession, path: str) -> DataFrame:
    """(path, modificationTime, length, content) of every supported file at or below path.

    Files are listed and read by tasks, one file in memory at a time, and dealt by their number
    and bytes; those that cannot be read are left out. A store that only Spark opens goes
    through Spark's own reader, which leaves out names with a leading _ or dot.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(hadoop):
        return spark.createDataFrame([], FILES)
    full = system.makeQualified(hadoop).toString()
    try:
        open_system(full)
    except (ValueError, OSError, pa.ArrowException):
        return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    wanted = filter_supported(list_files(spark, full).withColumn("extension", extension_of(filename_of(F.col("path"))))).drop("extension")
    n, size = wanted.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    tasks = max(1, -(-n // FILES_OF_TASK), -(-size // BYTES_OF_TASK))
    return wanted.repartition(tasks, F.xxhash64("path")).mapInPandas(_contents, FILES)


def load_documents(spark: SparkSession, path: str, page_extractor: Callable | None = None) -> DataFrame:
    """Documents of a file or a folder and all below it; a missing path gives none.

    Only a file's own leading dot hides it. PDF bytes go through page_extractor (a column
    function from binary to text); without one their content is empty.
    """
    docs = filter_hidden(filter_supported(document_metadata(file_rows(spark, path))))
    pdf = page_extractor(F.col("content")) if page_extractor else F.lit("")
    return docs.withColumn("content", F.when(F.col("extension") == ".pdf", pdf).otherwise(decode_text(F.col("content"))))


def inline_or_file(requests: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(request_id, content, file_path) with files(source, content): accepted and rejected requests.

    A file path wins over inline content; requests without text are rejected.
    """
    texts = files.select(F.col("source").alias("file_path"), F.col("content").alias("file_text"))
    joined = requests.join(texts, "file_path", "left").withColumn("content", F.when(F.coalesce("file_path", F.lit("")) != "", F.col("file_text")).otherwise(F.col("content"))).drop("file_text")
    has_text = F.coalesce("content", F.lit("")) != ""
    return joined.where(has_text), joined.where(~has_text)


def stamp_user(chunks: DataFrame, user_id: str | None) -> DataFrame:
    return chunks.withColumn("user_id", F.lit(user_id or None).cast("string"))
