"""Order MinHash fingerprints, in DataFrame functions only.

A text is cut into tokens of up to ``TOKEN`` characters that are not white space.
Its k-mers (k tokens in a row) are numbered by occurrence, so a repeated k-mer is
several elements. An element is ranked by the hash of its k-mer and its number
together, so each occurrence has a rank of its own. The first bits of that hash give
the bin. In a bin that has any, the smallest element and the next ones in the order of
hashes, ``TUPLE`` in all, are put back in text order and hashed together. In a long text
they are of that bin; in a short one, with few elements a bin, the next may be of a later
bin (after the last comes the first), so that a tuple always has an order. So each bin
is a MinHash that also sees the order of its k-mers: moving a passage changes it though
the set of k-mers stays. The likeness of two fingerprints is the share of equal bins among
those that either fills.

One sort of the k-mers' hashes with their places brings equal k-mers together in text
order and so numbers them; a second sort, of the elements' hashes with their places,
gives bins and ranks. Hash and place are two fields, so texts of any length are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.llm.storage import stage
from framewright.llm.text_expr import whole, words

TOKEN = 40
K = 2
BIN_BITS = 6
TUPLE = 2
BLOCK_IDS = 512  # neighbouring ids that one task sorts: bounds what a window holds
_LONG = rf"[^\x20\x09-\x0D]{{{TOKEN + 1}}}"
_TOKENS = rf"[^\x20\x09-\x0D]{{1,{TOKEN}}}"


def with_fingerprint(df: DataFrame, text: str, name: str, k: int = K, bin_bits: int = BIN_BITS, size: int = TUPLE) -> DataFrame:
    """``df`` with column ``name``: the filled bins in order, ``bin:hash`` in hex, joined by commas.

    A text of fewer than k tokens has one k-mer of them all; null, empty and blank texts have an empty
    fingerprint. Equal texts have equal fingerprints.
    """
    t = [f"_fp{j}" for j in range(4)]

    def element(h: Column, i: Column) -> Column:
        return F.struct(h.alias("h"), i.alias("i"))

    def bin_of(e: Column) -> Column:
        return F.shiftrightunsigned(e["h"], 64 - bin_bits)

    # Words are the tokens; only a text with a longer one needs the slower pattern.
    df = df.withColumn(t[0], F.when(whole(text).rlike(_LONG), F.regexp_extract_all(whole(text), F.lit(_TOKENS), F.lit(0)))
                       .otherwise(words(whole(text))))
    short = F.when(F.size(t[0]) == 0, F.expr("array()").cast("array<struct<h:bigint,i:int>>")).otherwise(
        F.array(element(F.xxhash64(F.array_join(t[0], " ")), F.lit(0))))
    df = df.withColumn(t[1], F.sort_array(F.when(F.size(t[0]) < k, short).otherwise(F.transform(
        F.expr(f"slice({t[0]}, 1, greatest(size({t[0]}) - {k - 1}, 0))"),
        lambda w, i: element(F.xxhash64(w, *(F.get(F.col(t[0]), i + d) for d in range(1, k))), i)))))
    # Where the occurrences of a k-mer begin, carried along: the number is the distance from there.
    df = df.withColumn(t[2], F.filter(F.transform(t[1], lambda e, j: F.when(
        F.get(F.col(t[1]), j - 1)["h"] == e["h"], F.lit(None)).otherwise(j)), lambda j: j.isNotNull()))
    df = df.withColumn(t[1], F.sort_array(F.flatten(F.transform(t[2], lambda a, r: F.transform(
        F.slice(F.col(t[1]), a + 1, F.coalesce(F.get(F.col(t[2]), r + 1), F.size(t[1])) - a),
        lambda e, n: element(F.xxhash64(e["h"], n), e["i"]))))))
    # Places of the bins' smallest elements: the one before is of another bin.
    df = df.withColumn(t[3], F.filter(F.transform(t[1], lambda e, j: F.when(
        F.coalesce(bin_of(F.get(F.col(t[1]), j - 1)) != bin_of(e), F.lit(True)), j)), lambda j: j.isNotNull()))
    # The elements again from the first, for tuples that go beyond the last.
    df = df.withColumn(t[2], F.slice(F.col(t[1]), 1, size - 1))

    def one(j: Column) -> Column:
        beyond = F.greatest(F.least(j, j + size - F.size(t[1])), F.lit(0))
        members = F.concat(F.slice(F.col(t[1]), j + 1, F.lit(size)), F.slice(F.col(t[2]), F.lit(1), beyond))
        ordered = F.sort_array(F.transform(members, lambda e: F.struct(e["i"].alias("i"), e["h"].alias("x"))))
        return F.concat(F.hex(bin_of(F.get(F.col(t[1]), j))), F.lit(":"),
                        F.hex(F.xxhash64(F.transform(ordered, lambda e: e["x"]))))

    return df.withColumn(name, F.array_join(F.transform(t[3], one), ",")).drop(*t)


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bins among the bins that one of the fingerprints fills; 1 for equal fingerprints."""
    x, y = F.split(a, ","), F.split(b, ",")
    filled = F.size(F.array_union(F.transform(x, lambda e: F.substring_index(e, ":", 1)), F.transform(y, lambda e: F.substring_index(e, ":", 1))))
    return F.when(a == b, F.lit(1.0)).when((a == "") | (b == ""), F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / filled)


def following(docs: DataFrame) -> DataFrame:
    """``(i, next)`` for each distinct doc_id of ``docs(doc_id)``: the next one in ascending order, the
    first after the last; null stands before all others.

    Ids are sorted in ranges; the last id of a range is followed by the first id of the next range
    that has any, found among the ranges' first ids, one row a range.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = stage(docs.select("doc_id").distinct().repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).withColumn("r", F.spark_partition_id()), "ids")
    order = Window.partitionBy("r").orderBy(F.col("doc_id").asc_nulls_first())
    ids = ids.withColumn("next", F.lead("doc_id").over(order)).withColumn("place", F.row_number().over(order)) \
        .withColumn("last", F.lead(F.lit(1)).over(order).isNull())
    firsts = ids.where("place = 1").select(F.col("r").alias("fr"), F.col("doc_id").alias("first"))
    by_range = Window.orderBy("fr")
    lead, head = F.lead(F.struct("first")).over(by_range), F.first(F.struct("first")).over(by_range)
    after = firsts.withColumn("wraps", lead.isNull()).withColumn("after", F.coalesce(lead, head)).drop("first")
    return ids.join(after, (F.col("r") == F.col("fr")) & F.col("last"), "left").select(
        F.col("doc_id").alias("i"), F.when(F.col("last"), F.col("after.first")).otherwise(F.col("next")).alias("next"),
        F.coalesce("wraps", F.lit(False)).alias("wraps"))


def _block(doc_id: Column) -> Column:
    """Key of the ``BLOCK_IDS`` ids that are sorted together; null has a block of its own."""
    return F.coalesce(F.floor(doc_id / BLOCK_IDS).cast("long"), F.lit(-(1 << 62)))


def op10_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text, of its edited text and of the next document, with their likeness.

    Texts are dealt once, by blocks of neighbouring ids; the document after a block's last id is sent
    there too. Rows that share a doc_id follow one another by text hash, so the next of several is the
    one with the next hash. A null doc_id stands before all others. A document that is alone is its own
    next. Columns other than doc_id and text are left out; an empty table gives no row.
    """
    base = docs.select("doc_id", whole("text").alias("text"))
    order = stage(following(base), "order")
    edges = order.where(F.col("wraps") | (_block(F.col("i")) != _block(F.col("next")))).select(F.col("next").alias("_next"), _block(F.col("i")).alias("block"))
    guests = base.join(edges, F.col("doc_id").eqNullSafe(F.col("_next"))).select("doc_id", "text", "block", F.lit(True).alias("guest"))
    rows = base.select("doc_id", "text", _block(F.col("doc_id")).alias("block"), F.lit(False).alias("guest")).unionByName(guests).repartition("block")
    rows = with_fingerprint(rows, "text", "fingerprint")
    near = Window.partitionBy("block").orderBy("guest", F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    rows = rows.withColumn("next_text", F.lead("text").over(near)).withColumn("next_fingerprint", F.lead("fingerprint").over(near)).where("NOT guest")
    half = F.floor(F.length("text") / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half)))
    rows = with_fingerprint(rows, "edited", "edited_fingerprint")
    return rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
                       likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
                       likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))
