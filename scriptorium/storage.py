"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only a plain local master may go without that setting; it then uses one below the warehouse.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not configured and master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all machines")
    return configured or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared"


def stored(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write df as Parquet in the shared folder and return a reader of that table.

    This cuts the lineage: a lost executor costs at most a reread of the files.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/scriptorium/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df dealt out to all cores if it comes in fewer splits than there are cores; larger tables stay as read.

    A file of one row group is one task, however much work its rows bring.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
