"""Seeded exact-size splits and slices.

Rows are ranked by ``md5('<seed>|<key>')``.  A global sort would funnel
every row through one ordering; instead the place of the cut is found by radix
refinement: the first four hex digits of the hash give 65,536 buckets, their
histogram locates the bucket that holds the cut, and only that bucket's distinct
keys are summed up in hash order.  The result is one pair ``(hash, key)``, a scalar
subquery of the plan: every row is decided by one comparison with it, in one scan,
and no job runs before the frame is used.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.functions.patterns import SPLIT_SEED, VAL_FRACTION

_BUCKET_HEX_DIGITS = 4


def rank_hash(key: Column, seed: int = SPLIT_SEED) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(key.cast("string"), F.lit("null"))))


def _cut(keys: DataFrame, n_first: Callable[[Column], Column]) -> DataFrame:
    """One row ``(total, h, key)``: the rows, and the last pair that comes first (null when none does)."""
    # At most 65,536 buckets, as one sorted array.
    hist = keys.groupBy("b").agg(F.count(F.lit(1)).alias("n")).agg(
        F.sort_array(F.collect_list(F.struct("b", "n"))).alias("hist"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    step = lambda acc, x: F.when(acc["b"].isNotNull(), acc).otherwise(F.struct(
        (acc["before"] + x["n"]).alias("before"), F.when(acc["before"] + x["n"] >= acc["need"], x["b"]).alias("b"),
        F.when(acc["before"] + x["n"] >= acc["need"], acc["need"] - acc["before"]).otherwise(acc["need"]).alias("need")))
    start = F.struct(F.lit(0).cast("bigint").alias("before"), F.lit(None).cast("string").alias("b"), F.least(n_first(F.col("total")).cast("bigint"), F.col("total")).alias("need"))
    at = hist.select("total", F.aggregate("hist", start, step).alias("x")).select("total", F.col("x.b").alias("b"), F.col("x.need").alias("need"))
    # Of the cut's bucket (about a 65,536th of the keys), the distinct keys with their rows.
    inside = keys.join(F.broadcast(at.select("b", "need")), "b").groupBy("b", "need", "h", "key").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("b").orderBy("h", "key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = inside.withColumn("before", before).filter(F.col("before") < F.col("need")).agg(F.max(F.struct("h", "key")).alias("m"))
    return last.select(F.struct("m.h", "m.key").alias("cut"))


def first_by_hash(df: DataFrame, key: str, n_first: int | Callable[[Column], Column], seed: int = SPLIT_SEED, flag: str = "is_first") -> DataFrame:
    """Add ``flag``: true for the ``n_first`` rows with the smallest hash rank.

    ``n_first``: a row count, or an expression of the total row count.  Rows that share a key stay
    together: those of the key at the cut all come first, so there may be more than ``n_first`` of
    them; with distinct keys the count is exact.  A null key counts as the text null."""
    want = n_first if callable(n_first) else lambda n: F.lit(n_first)
    h, k = rank_hash(F.col(key), seed), F.coalesce(F.col(key).cast("string"), F.lit("null"))
    cut = _cut(df.select(h.alias("h"), k.alias("key"), F.substring(h, 1, _BUCKET_HEX_DIGITS).alias("b")), want).scalar()
    return df.withColumn(flag, F.coalesce(F.struct(h.alias("h"), k.alias("key")) <= cut, F.lit(False)))


def split_train_val(df: DataFrame, key: str, val_fraction: float = VAL_FRACTION, seed: int = SPLIT_SEED) -> DataFrame:
    """add ``split`` in {train, val}; val size = ceil(fraction * n)."""
    out = first_by_hash(df, key, lambda n: F.ceil(F.lit(val_fraction) * n), seed, "_val")
    return out.withColumn("split", F.when(F.col("_val"), "val").otherwise("train")).drop("_val")


def slice_sample(df: DataFrame, key: str, keep_fraction: float, seed: int = SPLIT_SEED) -> DataFrame:
    """keep the first floor(fraction * n) rows of the seeded order."""
    return first_by_hash(df, key, lambda n: F.floor(n * F.lit(keep_fraction)), seed, "_keep").filter("_keep").drop("_keep")


def sample_limit(df: DataFrame, order_col: str, limit: int) -> DataFrame:
    """first ``limit`` rows by ``order_col`` (0 keeps all).  A top-k: the
    limit is the feature."""
    if limit <= 0:
        return df
    return df.orderBy(order_col).limit(limit)


def split_report(df: DataFrame, split_col: str = "split") -> DataFrame:
    """rows per split."""
    return df.groupBy(split_col).agg(F.count(F.lit(1)).cast("bigint").alias("n_rows"))
