"""Shared pieces of the training-data operators: materialised tables and graph components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.shipping import ship_package

#: Bytes of one Arrow batch handed to Python, unless the session sets its own bound.
BATCH_BYTES = 4 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
_LOCAL_DIR: dict[str, str] = {}


def prepare(spark: SparkSession) -> None:
    """Ship the package and bound Arrow batches by bytes, so that long texts come few at a time."""
    ship_package(spark)
    if spark.conf.get(_BATCH_CONF, None) is None:
        spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only a plain local master (tests) may go without that setting; it then gets a
    temporary folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith(("local[", "local")) or spark.sparkContext.master.startswith("local-"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all machines")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIR:
        _LOCAL_DIR[app] = tempfile.mkdtemp(prefix="scriptorium-")
        spark.sparkContext.setCheckpointDir(_LOCAL_DIR[app])
    return _LOCAL_DIR[app]


def materialise(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write df as Parquet in the shared folder and return a reader of that table.

    This cuts the lineage: a lost executor costs at most a reread of the files.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/scriptorium/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables that no later result reads."""
    for df in tables:
        jvm = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_at)
        jvm.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(jvm, True)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `rows`, so that few texts are Python objects at once."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def crc_fold(column: str, folds: int):
    """crc32 of a column written as text, modulo folds (null stays null)."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % folds


def _is_settled(edges: DataFrame) -> bool:
    """Whether the edges (a, b) are stars around their b: every a has one b, and no b is an a."""
    ends = edges.select("a", F.lit(1).alias("out"), F.lit(0).alias("met")).unionByName(edges.select(F.col("b").alias("a"), F.lit(0).alias("out"), F.lit(1).alias("met")))
    nodes = ends.groupBy("a").agg(F.sum("out").alias("out"), F.max("met").alias("met"))
    return not nodes.where("out > 1 OR (out = 1 AND met = 1)").limit(1).count()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of the undirected edges (a, b), as rows (node, root).

    root is the smallest node of the component. Nodes without an edge do not appear.
    Alternating large-star and small-star rounds until only stars around the smallest nodes
    are left; each round is a pair of min aggregations joined back to the edges and is
    written to the shared folder. No part of the graph reaches the driver, only whether it
    is settled.
    """
    current = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(max_rounds):
        if _is_settled(current):
            break
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        current = materialise(small, "edges")
    else:
        raise RuntimeError("components did not settle")
    nodes = current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return nodes.unionByName(roots)
