"""The manifest of indexed files: (path, hash, chunks_count)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENTRIES = "map<string,struct<hash:string,chunks_count:int>>"


def changed_files(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files (path, hash) that are new or have another hash."""
    return files.join(manifest.select("path", "hash"), ["path", "hash"], "left_anti")


def skipped_count(files: DataFrame, manifest: DataFrame) -> DataFrame:
    return files.join(manifest.select("path", "hash"), ["path", "hash"], "left_semi").agg(F.count("*").alias("skipped"))


def mark_indexed(manifest: DataFrame, indexed: DataFrame) -> DataFrame:
    """The manifest with the indexed files added or replaced."""
    fields = ["path", "hash", "chunks_count"]
    return manifest.select(*fields).join(indexed.select("path"), "path", "left_anti").unionByName(indexed.select(*fields))


def remove_indexed(manifest: DataFrame, paths: DataFrame) -> DataFrame:
    return manifest.join(paths.select("path"), "path", "left_anti")


def indexed_count(manifest: DataFrame) -> DataFrame:
    return manifest.agg(F.count("*").alias("indexed"))


def read_manifest(raw: DataFrame) -> DataFrame:
    """JSON texts (column value), whole manifests or lines of one, to manifest rows."""
    parsed = F.from_json("value", f"struct<version:string,files:{ENTRIES}>")
    return raw.select(F.explode(parsed["files"]).alias("path", "entry")).select("path", "entry.*")


def manifest_json(manifest: DataFrame, version: str = "1.0") -> DataFrame:
    """The manifest as one JSON text, for export; its size is that of the manifest."""
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct("path", F.struct("hash", "chunks_count")))))
    return manifest.agg(F.to_json(F.struct(F.lit(version).alias("version"), entries.alias("files"))).alias("value"))


def manifest_lines(manifest: DataFrame, version: str = "1.0") -> DataFrame:
    """The manifest as JSON lines, one entry each, written by all tasks; read_manifest reads them back."""
    entry = F.create_map("path", F.struct("hash", "chunks_count"))
    return manifest.select(F.to_json(F.struct(F.lit(version).alias("version"), entry.alias("files"))).alias("value"))


def is_changed(old_hash: Column, new_hash: Column) -> Column:
    return old_hash.isNull() | (old_hash != new_hash)
