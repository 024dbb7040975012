"""Dataset sources and sinks.

The interchange form of the original tools is one JSON array per file; it
is read once with an explicit schema (``multiLine``) and written back as
Spark writes data: one JSON record per line, or Parquet, partitioned where
a stage produces several outputs (splits).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.schemas import EVAL_RESULT, FILE_RECORD
from framewright.session import cut_lineage


def with_file_keys(df: DataFrame, file_id: str = "file_id") -> DataFrame:
    """``file_key`` (text form of the id) and ``file_no`` (integer ids only)."""
    return df.withColumn("file_key", F.col(file_id).cast("string")) \
        .withColumn("file_no", F.col(file_id).try_cast("bigint"))


def read_dataset(spark: SparkSession, path: str, multiline: bool = True, mode: str = "FAILFAST") -> DataFrame:
    """A1: a labelled dataset (JSON array files, or JSON lines with
    ``multiline=False``) with the explicit record schema.  A malformed file or
    line raises; ``mode="PERMISSIVE"`` keeps what can be read instead."""
    df = spark.read.schema(FILE_RECORD).option("multiLine", multiline).option("mode", mode).json(path)
    return with_file_keys(df)


def read_array(spark: SparkSession, path: str, schema: T.StructType = FILE_RECORD) -> DataFrame:
    """A1 in parallel: the objects of JSON array files as rows, however large a file is.

    Files are read by byte ranges as pieces that end at ``}``, the only place where an object can end.  A
    piece's effect on the reader's state (inside a string, depth) is known without the text before it, so
    running sums, in each range and then over a file's ranges, give the state at every piece; an object ends
    where the depth falls back to that of the array.  Anything but one array of objects raises.
    """
    raw = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("range"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("v"))
    count = lambda t, chars: F.length(t) - F.length(F.translate(t, chars, ""))
    plain = F.regexp_replace("v", r"(?s)\\.", "")  # without escaped characters every quote opens or closes a string

    def depth(inside: int) -> Column:
        """Change of depth by a piece that begins inside a string or outside."""
        text = F.array_join(F.filter(F.split(plain, '"'), lambda x, i: i % 2 == inside), "")
        return count(text, "{[") - count(text, "]")

    inside_range = Window.partitionBy("file", "range").orderBy("at")
    before, upto = inside_range.rowsBetween(Window.unboundedPreceding, -1), inside_range.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def carried(pieces: DataFrame, name: str) -> DataFrame:
        """``pieces`` with the sum of ``name`` over the file's earlier ranges; the sums are one row a range."""
        w = Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
        sums = pieces.groupBy("file", "range").agg(F.sum(name).alias("_n")).select("file", "range", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias(f"{name}0"))
        return pieces.join(sums, ["file", "range"])

    pieces = carried(raw.withColumn("quotes", count(plain, '"')), "quotes")
    start = (F.col("quotes0") + F.coalesce(F.sum("quotes").over(before), F.lit(0))) % 2
    closed = (F.col("start") + F.col("quotes")) % 2 == 0  # the brace after the piece is none of a string
    pieces = pieces.withColumn("start", start).withColumn("closed", closed) \
        .withColumn("d", F.when(F.col("start") == 0, depth(0)).otherwise(depth(1)) - F.col("closed").cast("int")).select("file", "range", "at", "v", "closed", "d")
    pieces = carried(cut_lineage(pieces), "d")
    pieces = pieces.withColumn("end", (F.col("closed") & (F.col("d0") + F.sum("d").over(upto) == 1)).cast("int")).select("file", "range", "at", "v", "end")
    pieces = carried(pieces, "end").withColumn("record", F.col("end0") + F.coalesce(F.sum("end").over(before), F.lit(0)))

    objects = pieces.groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("range", "at", "v"))).alias("parts"), F.max("end").alias("whole"))
    text = F.concat(F.array_join(F.transform("parts", lambda x: x["v"]), "}"), F.when(F.col("whole") == 1, "}").otherwise(""))
    objects = objects.select("file", "record", "whole", text.alias("text"))
    # The first object follows the bracket, the others a comma; what follows the last is the closing bracket.
    fits = F.when(F.col("whole") == 1, F.when(F.col("record") == 0, F.col("text").rlike(r"^\s*\[\s*\{")).otherwise(F.col("text").rlike(r"^\s*,\s*\{"))) \
        .otherwise(F.when(F.col("record") == 0, F.col("text").rlike(r"^\s*\[\s*\]\s*$")).otherwise(F.col("text").rlike(r"^\s*\]\s*$")))
    checked = F.when(fits, F.regexp_replace("text", r"^\s*[\[,]\s*", "")).otherwise(F.raise_error(F.concat(F.lit("no JSON array of objects: "), F.col("file"))))
    # The check also sees the rest of a file: it is filtered by its own column afterwards.
    rows = objects.select("whole", checked.alias("text")).filter((F.col("whole") == 1) | F.col("text").isNull())
    # A file whose last piece ends an object has no closing bracket.
    last = pieces.groupBy("file").agg(F.max(F.struct("range", "at", "end"))["end"].alias("whole"), F.max("file").alias("f")).filter("whole = 1")
    rows = rows.unionByName(last.select("whole", F.raise_error(F.concat(F.lit("array without an end: "), F.col("f"))).cast("string").alias("text")))
    return with_file_keys(rows.select(F.from_json("text", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*"))


def ingest(spark: SparkSession, path: str, out: str, partitions: int, multiline: bool = True) -> DataFrame:
    """A1: read the interchange form once, deal its records over ``partitions`` and keep them as Parquet:
    a JSON array is one task's work however large it is, so later stages should not start from it."""
    read_dataset(spark, path, multiline).repartition(partitions).write.mode("overwrite").parquet(out)
    return spark.read.parquet(out)


def write_dataset(df: DataFrame, path: str, fmt: str = "json", mode: str = "overwrite",
                  partition_by: list[str] | None = None, compression: str | None = None) -> None:
    """A4: write records (one compact JSON object per line, or Parquet); ``compression``: a codec that the readers know by the
    files' names (``gzip`` for JSON), none by default."""
    cols = [c for c in ["file_id", "source_code_c", "assembly_code", "label"] if c in df.columns]
    extra = [c for c in (partition_by or []) if c not in cols]
    w = df.select(*cols, *extra).write.mode(mode)
    if compression:
        w = w.option("compression", compression)
    if partition_by:
        w = w.partitionBy(*partition_by)
    getattr(w, fmt)(path)


def write_keyed(df: DataFrame, path: str, partitions: int, key: str = "file_id") -> None:
    """A4: Parquet records dealt over ``partitions`` folders by a hash of their key, the form that ``rewrite`` updates."""
    part = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(partitions)).cast("int")
    df.withColumn("part", part).repartition("part").write.mode("overwrite").partitionBy("part").parquet(path)


def rewrite(spark: SparkSession, path: str, update: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """D14/A4 in place: replace the records of a keyed dataset by ``update(records)``.

    The new records are first written whole to a staging folder beside the dataset; then the folders
    they fall into are overwritten from it.  A failure while they are made leaves the dataset as it
    was; one during the overwrite is mended by running the same call again.  ``update`` returns
    records with the columns of the dataset; ``part`` stays a record's folder."""
    old = spark.read.parquet(path)
    staging = f"{path.rstrip('/')}-staging-{uuid.uuid4().hex}"
    update(old).select(*old.columns).write.partitionBy("part").parquet(staging)
    new = spark.read.schema(old.schema).parquet(staging)
    new.select(*old.columns).repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(staging)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    spark.catalog.refreshByPath(path)
    return spark.read.parquet(path)


def stage_path(base: str, stage: str) -> str:
    """A5: output folder of one stage beside its input (``stage=<name>``)."""
    return f"{base.rstrip('/')}/stage={stage}"


def write_splits(df: DataFrame, path: str, split_col: str = "split", fmt: str = "json") -> None:
    """One output folder per split (``split=train`` / ``split=val``)."""
    write_dataset(df, path, fmt=fmt, partition_by=[split_col])


def write_eval_report(metrics: DataFrame, results: DataFrame, path: str, model: str | None = None,
                      adapter: str | None = None) -> None:
    """Evaluation report: metrics (one row, optional model / adapter
    columns) and per-sample results ordered by index."""
    m = metrics
    if model is not None:
        m = m.withColumn("model", F.lit(model))
    if adapter is not None:
        m = m.withColumn("adapter", F.lit(adapter))
    m.write.mode("overwrite").json(f"{path.rstrip('/')}/metrics")
    results.select(*[f.name for f in EVAL_RESULT.fields]).orderBy("sample_idx") \
        .write.mode("overwrite").json(f"{path.rstrip('/')}/results")
