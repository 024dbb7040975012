"""Mixing sources to target weights, in DataFrame functions only.

Each document gets a hash-random key. Within its source, documents are sorted by
key; their running sum of sizes is the sum of all earlier key ranges plus the sum
inside their own range, so a source of any size is sorted and summed by many tasks.
A source whose target is above its size repeats whole epochs; the running sum is
cut at the exact rest of its budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.llm.storage import stage
from framewright.llm.text_expr import WORD, free_name, whole, words

MAX_EPOCHS = 3  # a source's target is at most this many times its size
WEIGHTS = (1, 2, 3)  # by source in code-point order, repeating
SEED = "mix-1"
RANGE_ROWS = 20_000  # documents of a key range, about
_KEY_DIGITS = 15


def _key(doc_id: Column, text: Column) -> Column:
    """Hash-random key of 60 bits, the same in every run."""
    digest = F.md5(F.concat(F.lit(SEED + "|"), F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit("|"), F.md5(text)))
    return F.conv(F.substring(digest, 1, _KEY_DIGITS), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = MAX_EPOCHS) -> DataFrame:
    """``sizes(source, source_size)`` with target_num / target_den, the exact target as a fraction.

    The targets share the total by weight; one that reaches ``epochs`` times its source's size stops
    there and the rest is shared again by weight. So a target is the smaller of its cap and one common
    level times its weight: sources are taken by cap per weight, and the level is what the sources not
    yet stopped share when the next of them is not above its cap. Sources, not documents, are in one window.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*(F.lit(x) for x in weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("weight", w.cast("long")).withColumn("cap", F.lit(epochs) * F.col("source_size"))
    by_level = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    s = s.withColumn("total", F.sum("source_size").over(every)) \
        .withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))) \
        .withColumn("share", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))) \
        .withColumn("below", F.col("cap") * F.col("share") >= F.col("left") * F.col("weight")) \
        .withColumn("place", F.row_number().over(by_level))
    # The first source whose cap is not below its share gives the level for itself and all after it.
    s = s.withColumn("first", F.min(F.when(F.col("below"), F.col("place"))).over(every))
    level = [F.max(F.when(F.col("place") == F.col("first"), F.col(c))).over(every) for c in ("left", "share")]
    stopped = F.col("first").isNull() | (F.col("place") < F.col("first"))
    return s.select("source", "source_size",
                    F.when(stopped, F.col("cap")).otherwise(level[0] * F.col("weight")).alias("target_num"),
                    F.when(stopped, F.lit(1)).otherwise(level[1]).cast("long").alias("target_den"))


def _sized(docs: DataFrame, doc_id: str, source: str, text: str) -> DataFrame:
    t = whole(F.col(f"`{text}`"))
    return docs.select(F.col(f"`{doc_id}`").alias("i"), F.col(f"`{source}`").alias("source"), F.size(words(t)).cast("long").alias("size"),
                       _key(F.col(f"`{doc_id}`"), t).alias("key"))


def shares(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text",
           weights: tuple[int, ...] = WEIGHTS, epochs: int = MAX_EPOCHS, range_rows: int = RANGE_ROWS) -> DataFrame:
    """A row per row of ``docs``: i (doc_id), source, key, size, source_size, target, taken, before, budget.

    taken is what the mix takes of the document, repeats counted. Null texts have size 0 and none is
    taken; a null source is a source, the last. Rows that share doc_id and text have one key and stand
    next to each other; documents with equal keys follow by doc_id, then size. An empty table gives no row; if no text has a word, all targets are 0.
    """
    rows = stage(_sized(docs, doc_id, source, text), "sizes")
    goal = stage(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, epochs), "targets")
    n = rows.count()
    ranges = max(1, -(-n // range_rows))
    width = -(-(16 ** _KEY_DIGITS) // ranges)
    rows = rows.withColumn("range", F.floor(F.col("key") / F.lit(width)).cast("long")) if ranges > 1 else rows.withColumn("range", F.lit(0).cast("long"))
    sums = rows.groupBy("source", "range").agg(F.sum("size").alias("sum"))
    earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source", F.col("range").alias("r"), F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("earlier"))
    goal = goal.withColumnRenamed("source", "g")
    sums = sums.join(goal, F.col("source").eqNullSafe(F.col("g"))).drop("g").withColumnRenamed("source", "s")
    both = rows.join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r"))).drop("s", "r")
    inside = Window.partitionBy("source", "range").orderBy("key", F.col("i").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, -1)
    both = both.withColumn("before", F.col("earlier") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    both = both.withColumn("budget", F.expr("target_num div target_den")) \
        .withColumn("target", F.col("target_num").cast("double") / F.col("target_den"))
    whole_epochs = F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(0)
    both = both.withColumn("epochs", whole_epochs).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size"))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before")))
    return both.withColumn("taken", F.col("epochs") * F.col("size") + part).drop("range", "earlier", "target_num", "target_den")


def mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", **settings) -> DataFrame:
    """The rows of the mix, with the columns of ``docs``: a document as often as the mix repeats it.

    Whole documents: the one in which the budget ends is taken once more if half of it at least is
    inside. Documents without words are taken in each whole epoch of their source, and once at least.
    """
    s = shares(docs, doc_id, source, text, **settings)
    last = F.when((F.col("size") > 0) & (2 * F.col("before") + F.col("size") <= 2 * F.col("rest")), 1).otherwise(0)
    times = F.when(F.col("size") == 0, F.greatest(F.col("epochs"), F.lit(1))).otherwise(F.col("epochs") + last)
    names = [free_name(docs.columns, x) for x in ("_i", "_key", "_times")]
    # Rows that share doc_id and text are alike, so each gets the mean place of its key: the most times of them all,
    # one row of the right side for each.
    wide = docs.withColumn(names[1], _key(F.col(f"`{doc_id}`"), whole(F.col(f"`{text}`"))))
    copies = s.select(F.col("i").alias(names[0]), F.col("key").alias(names[1]), times.cast("int").alias(names[2])) \
        .groupBy(names[0], names[1]).agg(F.max(names[2]).alias(names[2]))
    out = wide.join(copies, wide[f"`{doc_id}`"].eqNullSafe(copies[names[0]]) & (wide[names[1]] == copies[names[1]]))
    return out.where(F.col(names[2]) > 0).withColumn(names[2], F.explode(F.sequence(F.lit(1), F.col(names[2])))) \
        .select(*(F.col(f"`{c}`") for c in docs.columns))


def op8_mixing(docs: DataFrame) -> DataFrame:
    return shares(docs).select(F.col("i").alias("doc_id"), "size", "source_size", "target", "taken")


OP8_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size,
    ('0x' || substr(md5('{SEED}|' || coalesce(doc_id::VARCHAR, 'null') || '|' || md5(coalesce(text, ''))), 1, {_KEY_DIGITS}))::BIGINT AS key
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
        [{', '.join(map(str, WEIGHTS))}][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1]::BIGINT AS weight
      FROM d GROUP BY source),
c AS (SELECT *, {MAX_EPOCHS} * source_size AS cap FROM s),
o AS (SELECT *, (sum(source_size) OVER ())::BIGINT - coalesce(sum(cap) OVER w, 0)::BIGINT AS rest,
        (sum(weight) OVER ())::BIGINT - coalesce(sum(weight) OVER w, 0)::BIGINT AS share, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS place
      FROM c WINDOW w AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT min(place) FILTER (cap * share >= rest * weight) AS first FROM o),
t AS (SELECT o.source, o.source_size,
        CASE WHEN f.first IS NULL OR o.place < f.first THEN o.cap ELSE l.rest * o.weight END AS num,
        CASE WHEN f.first IS NULL OR o.place < f.first THEN 1 ELSE l.share END AS den
      FROM o, f LEFT JOIN o l ON l.place = f.first),
r AS (SELECT d.doc_id, d.size, t.source_size, t.num, t.den, (t.num // t.den)::BIGINT AS budget,
        coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id NULLS FIRST, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM r)
SELECT doc_id, size, source_size, num::DOUBLE / den AS target,
  (epochs * size + greatest(0, least(size, budget - epochs * source_size - before)))::BIGINT AS taken
FROM e
"""
