"""Training-run folders (A8): which checkpoint folders exist, whether they
hold a state file, and the log history of a state file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.operators.runs import STATE_FILE
from framewright.schemas import TRAINER_STATE


def run_entries(spark: SparkSession, base_dir: str) -> DataFrame:
    """``folder, has_state`` for every first-level folder under ``base_dir``
    (from the files inside; only paths are read), plus the root as
    ``folder = ''``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base_dir).select("path")
    base = base_dir.rstrip("/")
    rel = F.regexp_extract("path", r"^(?:file:)?" + _escape(base) + r"/(.*)$", 1)
    parts = F.split(rel, "/")
    top = F.when(F.size(parts) > 1, parts[0]).otherwise(F.lit(""))
    name = F.element_at(parts, -1)
    is_state = (name == STATE_FILE) & ((F.size(parts) == 2) | (F.size(parts) == 1))
    return files.select(top.alias("folder"), is_state.alias("s")).groupBy("folder") \
        .agg(F.max("s").alias("has_state"))


def _escape(s: str) -> str:
    import re
    return re.escape(s)


def read_log_history(spark: SparkSession, state_path: str) -> DataFrame:
    """``step, loss, eval_loss`` rows of one trainer state file."""
    st = spark.read.schema(TRAINER_STATE).option("multiLine", True).json(state_path)
    return st.select(F.explode("log_history").alias("e")).select("e.step", "e.loss", "e.eval_loss")
