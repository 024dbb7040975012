"""Connected components of an edge table by alternating stars.

Each round points neighbours at the smallest node they see, first those larger
than a node (large star), then those smaller (small star); the edges end as one
star per component. A hub holds no group in memory: the smallest neighbour is an
aggregate with map-side combine, and the join back is one that Spark can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.storage import stage

EDGE = "src BIGINT, dst BIGINT"


def _smallest(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.min("dst").alias("low")).withColumn("low", F.least("src", "low"))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    if large:
        both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        near = both.join(_smallest(both), "src").where("dst > src").select(F.col("dst").alias("src"), F.col("low").alias("dst"))
    else:
        down = edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
        low = _smallest(down)
        near = down.join(low, "src").select(F.col("dst").alias("src"), F.col("low").alias("dst")) \
            .unionByName(low.select("src", F.col("low").alias("dst")))
    return near.where("src <> dst").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for each node of ``edges(src, dst)``; the component is its smallest node.

    Nulls and loops are no edges. An empty table gives an empty result.
    """
    now = stage(edges.select(F.col("src").cast("long"), F.col("dst").cast("long"))
                .where("src <> dst").distinct(), "edges")
    mark = None
    while True:
        now = stage(_star(_star(now, True), False), "edges")
        n = now.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        if n == mark or not n[0]:
            break
        mark = n
    return now.select(F.col("src").alias("node"), F.col("dst").alias("component")) \
        .unionByName(now.select(F.col("dst").alias("node"), F.col("dst").alias("component"))).distinct()
