"""Session helpers.

The library never creates a session inside an operator.  ``get_session`` is
for scripts, tests and the bench; on a cluster pass your own session and set
``spark.checkpoint.dir`` to a shared folder.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings the operators rely on for Python-equal results.
SEMANTIC_CONF = {
    # Python json.loads keeps the last of duplicate keys; Variant parsing
    # rejects duplicates unless this is on.
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.session.timeZone": "UTC",
}

# Execution settings: adaptive planning and skew handling.
EXECUTION_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, app: str = "framewright",
                shuffle_partitions: int | None = None,
                extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = {**EXECUTION_CONF, **SEMANTIC_CONF}
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    apply_semantic_conf(spark)
    ensure_checkpoint_dir(spark)
    return spark


def apply_semantic_conf(spark: SparkSession) -> None:
    """Set the result-affecting SQL settings on an existing session."""
    for k, v in SEMANTIC_CONF.items():
        spark.conf.set(k, v)


def ensure_checkpoint_dir(spark: SparkSession) -> str | None:
    """The session's checkpoint folder: the shared folder that ``spark.checkpoint.dir``
    names, None where it is unset.  No folder is made here."""
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
    return configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet into the session's checkpoint folder and read from there, a fraction of
    the volume of an RDD checkpoint; without that folder the frame stays lazy and is computed where it is used."""
    folder = ensure_checkpoint_dir(df.sparkSession)
    if not folder:
        return df
    path = f"{folder.rstrip('/')}/step-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")
