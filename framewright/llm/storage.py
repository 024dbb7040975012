"""Tables between the steps of an operator, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session without that setting (tests, one machine) gets a folder of its own; on a
    cluster its executors would not see it, so there the setting is required.
    """
    path = spark.conf.get(SETTING, None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{SETTING} must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="framewright-llm-")
        spark.conf.set(SETTING, path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a step as Parquet and read it again: it cuts the lineage, a lost executor costs no
    earlier step, and all later reads see the same rows."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def passing(df: DataFrame, name: str) -> Iterator[DataFrame]:
    """A step that only the block reads; its files go at the end of the block."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.parquet(path)
    try:
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        _remove(spark, path)


@contextmanager
def bucketed(df: DataFrame, name: str, *keys: str) -> Iterator[DataFrame]:
    """Like ``passing``, bucketed by ``keys``: joins on them in the block read it without a shuffle.

    As many buckets as shuffle partitions, so a table that is partitioned by the keys is written as it is.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    table_name = path.rpartition("/")[2].replace("-", "_")
    df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).option("path", path).saveAsTable(table_name)
    try:
        yield spark.table(table_name)
    finally:
        spark.sql(f"DROP TABLE {table_name}")
        _remove(spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
