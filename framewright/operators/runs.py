"""Run metrics (J1-J4): latest checkpoint state, loss curves, throughput
report, epoch estimate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: checkpoint folders and throughput-tool defaults ----------
CHECKPOINT_PREFIX = "checkpoint-"
STATE_FILE = "trainer_state.json"
WARMUP_STEPS = 5
DEFAULT_TRAIN_EXAMPLES = 13211
DEFAULT_SEQ_LEN = 1828
DEFAULT_BATCH_SIZE = 4
DEFAULT_GRAD_ACCUM = 4


def latest_checkpoint(entries: DataFrame, folder: str = "folder", has_state: str = "has_state") -> DataFrame:
    """``entries(folder, has_state)`` lists the sub-folders of one output
    directory; the root itself is the row with ``folder = ''``.  Picks the
    highest ``checkpoint-N`` (non-numeric N ignored); if that folder has no
    state file, falls back to the root state; else none.  One aggregation,
    one row: ``state_path`` (nullable), ``latest_folder``."""
    name = F.col(folder)
    step = F.when(name.startswith(CHECKPOINT_PREFIX),
                  F.try_element_at(F.split(name, "-"), F.lit(2)).try_cast("bigint"))
    agg = entries.agg(
        F.max_by(F.struct(name.alias("folder"), F.col(has_state).alias("has_state")), step).alias("b"),
        F.max(F.when(name == "", F.col(has_state))).alias("root"))
    path = F.when(F.col("b.has_state"), F.concat(F.col("b.folder"), F.lit("/" + STATE_FILE))) \
        .when(F.coalesce(F.col("root"), F.lit(False)), F.lit(STATE_FILE))
    return agg.select(path.alias("state_path"), F.col("b.folder").alias("latest_folder"))


def loss_curve(log_history: DataFrame, step: str = "step", loss: str = "loss", eval_loss: str = "eval_loss") -> DataFrame:
    """Train rows (have loss and step) and eval rows (eval_loss and step)."""
    train = log_history.filter(F.col(loss).isNotNull() & F.col(step).isNotNull()) \
        .select(F.lit("train").alias("series"), F.col(step).alias("step"), F.col(loss).alias("value"))
    ev = log_history.filter(F.col(eval_loss).isNotNull() & F.col(step).isNotNull()) \
        .select(F.lit("eval").alias("series"), F.col(step).alias("step"), F.col(eval_loss).alias("value"))
    return train.unionByName(ev)


def _ratio(a: Column, b: Column) -> Column:
    """``a / b`` of doubles as IEEE 754 has it: a step that took no time runs at infinite speed."""
    a = a.cast("double")
    at_zero = F.when(a > 0, float("inf")).when(a < 0, float("-inf")).when(a == 0, float("nan"))
    return F.when(b == 0, F.when(F.isnan(a), float("nan")).otherwise(at_zero)).otherwise(F.try_divide(a, b))


def throughput_report(steps: DataFrame, step: str = "step", elapsed: str = "elapsed_s",
                      tokens: str = "real_tokens", peak: str = "peak_gb", warmup: int = WARMUP_STEPS) -> DataFrame:
    """Drop the first ``warmup`` steps; mean/min/max step time,
    tokens/s = sum(tokens) / sum(time), per-step min/max tokens/s (infinite where
    a step took no time); peak memory over all steps (warm-up included).  The warm-up steps are a
    top-k of ``warmup`` rows; one aggregation computes the rest."""
    first = steps.select(step).orderBy(step).limit(warmup).withColumn("_warm", F.lit(True))
    d = steps.join(F.broadcast(first), step, "left")
    m = F.col("_warm").isNull()
    tps = _ratio(F.col(tokens), F.col(elapsed))
    return d.agg(F.avg(F.when(m, F.col(elapsed))).alias("avg_step_s"),
                 F.min(F.when(m, F.col(elapsed))).alias("min_step_s"),
                 F.max(F.when(m, F.col(elapsed))).alias("max_step_s"),
                 _ratio(F.sum(F.when(m, F.col(tokens))), F.sum(F.when(m, F.col(elapsed)))).alias("avg_tokens_per_s"),
                 F.min(F.when(m, tps)).alias("min_tokens_per_s"), F.max(F.when(m, tps)).alias("max_tokens_per_s"),
                 F.count_if(m).cast("bigint").alias("measured_steps"),
                 F.max(peak).alias("peak_gb"))


def epoch_estimate(report: DataFrame, train_examples: int = DEFAULT_TRAIN_EXAMPLES,
                   seq_len: int = DEFAULT_SEQ_LEN, batch_size: int = DEFAULT_BATCH_SIZE,
                   grad_accum: int = DEFAULT_GRAD_ACCUM) -> DataFrame:
    """Steps per epoch, tokens per epoch, seconds and minutes per epoch."""
    eff = batch_size * grad_accum
    tokens = train_examples * seq_len
    return report.select(
        F.lit(-(-train_examples // eff)).cast("bigint").alias("steps_per_epoch"),
        F.lit(tokens).cast("bigint").alias("tokens_per_epoch"),
        _ratio(F.lit(float(tokens)), F.col("avg_tokens_per_s")).alias("epoch_seconds"),
        (_ratio(F.lit(float(tokens)), F.col("avg_tokens_per_s")) / 60.0).alias("epoch_minutes"))
