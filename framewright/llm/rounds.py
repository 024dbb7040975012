"""Linking the members of shared keys, in rounds that stop comparing what is connected.

Only links that join components matter. First each member is compared with the least
member of its keys; then, in each key that still spans several labels, with that
key's leader; at last all remaining pairs of different labels, so nothing is left
out, while a large group of copies is not compared pair by pair.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.storage import stage

STAR_ROUNDS = 2
LABEL_STEPS = 2  # each doubles the steps of a label


def shared_keys(rows: DataFrame) -> DataFrame:
    """The rows of ``rows(token, c, ...)`` whose key has several members, with low, the least of them."""
    several = rows.groupBy("token").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").drop("high")
    return stage(rows.join(several, "token").distinct(), "candidates")


def _labelled(rows: DataFrame, links: DataFrame) -> DataFrame:
    """``rows`` with k, a label that only connected members share.

    It is the least member reached in a few steps, not the component: a label that is too fine costs a
    comparison, no link.  Links are near stars here, so few steps reach most of a component."""
    both = links.unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    label = stage(both.groupBy("src").agg(F.min("dst").alias("k")).select(F.col("src").alias("c"), F.least("src", "k").alias("k")), "labels")
    for _ in range(LABEL_STEPS):
        onward = label.select(F.col("c").alias("k"), F.col("k").alias("next"))
        label = stage(label.join(onward, "k").select("c", F.col("next").alias("k")), "labels")
    return rows.join(label, "c", "left").withColumn("k", F.coalesce("k", "c"))


def _open(rows: DataFrame) -> DataFrame:
    spans = rows.groupBy("token").agg(F.min("k").alias("low"), F.max("k").alias("high")).where("low < high").drop("high")
    return stage(rows.join(spans, "token"), "open")


def ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()


def link(rows: DataFrame, verify: Callable[[DataFrame], DataFrame], rest: Callable[[DataFrame, DataFrame], DataFrame],
         detail: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """Links ``(src, dst)`` that connect what the keys of ``rows(token, c, low, ...)`` connect.

    ``verify`` gives those of ``(a, b)`` that link; ``rest`` the candidate pairs ``(a, b)`` of two copies
    of the rows, their columns prefixed x and y, that it is joined on; ``detail`` adds columns to these.
    """
    tried = stage(ordered(rows.groupBy("c").agg(F.min("low").alias("a")).withColumnRenamed("c", "b")), "tried")
    links = verify(tried)
    rows = rows.drop("low")
    for _ in range(STAR_ROUNDS):
        rows = _open(_labelled(rows, links))
        leaders = rows.where("k = low").groupBy("token").agg(F.min("c").alias("a"))
        star = ordered(rows.where("k <> low").join(leaders, "token").select("a", F.col("c").alias("b")))
        star = stage(star.join(tried, ["a", "b"], "left_anti"), "tried")
        found = verify(star)
        rows = rows.drop("k", "low")
        tried, links = tried.unionByName(star), links.unionByName(found)
        if found.isEmpty():
            break
    rows = detail(_open(_labelled(rows, links)).drop("low"))
    x = rows.select(*(F.col(c).alias("x" + c) for c in rows.columns))
    y = rows.select(*(F.col(c).alias("y" + c) for c in rows.columns))
    left = stage(rest(x, y).join(tried, ["a", "b"], "left_anti"), "tried")
    return links.unionByName(verify(left))
