"""Similarity self-join on word n-grams: prefix filtering, rare n-grams first.

1. Each text becomes its set of distinct n-grams (64-bit hashes of words). Texts with
   equal sets are one class and stand for each other from here on.
2. All n-grams are counted into ``BUCKETS`` cells, a table of fixed size whatever the
   input. Sorting a set by its cells' counts, then by hash, is one order for all sets
   with rare n-grams first, which is all that prefix filtering needs to be exact.
3. Two sets that are similar enough share an n-gram of their prefixes (of a set of n,
   the first n - ceil(t n) + 1). Prefix n-grams of a single class are dropped by an
   aggregate with map-side combine.
4. Candidate pairs pass the length filter, the positional filter (the first shared prefix
   n-gram and what can follow it) and a suffix filter (a lower bound of the
   symmetric difference from hash-range counts), both inside the candidate join, then are
   verified once, on whole sets.

Candidates are verified in rounds (``rounds``) that stop comparing what is connected.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.llm import wordhash
from framewright.llm.components import connected_components
from framewright.llm.rounds import link, shared_keys
from framewright.llm.storage import bucketed, passing, stage

WIDTH = 4
PERCENT = 85
BUCKETS = 1 << 22  # cells of the n-gram counts; 16 MB as a table
BLOCK = 1 << 14  # cells of a row
FAN_IN = 64  # tasks whose counts one task adds
RANGES = 16  # hash ranges of the suffix filter
FINE = 128  # those of the candidate join, counts of 127 and more alike: that only lowers the bound


def _class_of(grams: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(grams.tobytes(), digest_size=8).digest(), "little", signed=True)


def _sets(column, width: int):
    """Row and sorted distinct n-grams of each text."""
    for row, _, _, hashes in wordhash.text_words(column, lower=True):
        yield row, np.unique(wordhash.shingles(hashes, width))


def _measure(docs: DataFrame, width: int) -> DataFrame:
    """A row per document: doc_id, mark, n, c (class, null for an empty set), ranges, fine; and per task a row for
    each block of cells: block, part, counts (a byte a cell, 255 for more: it only blurs the order of
    n-grams that are frequent anyway)."""
    schema = pa.schema([("doc_id", pa.int64()), ("mark", pa.string()), ("n", pa.int64()), ("c", pa.int64()), ("ranges", pa.list_(pa.int32())),
                        ("fine", pa.list_(pa.int8())), ("block", pa.int32()), ("part", pa.int32()), ("counts", pa.binary())])

    def rows(size, **columns):
        return pa.RecordBatch.from_arrays([pa.array(columns.get(f.name, [None] * size), f.type) for f in schema], schema=schema)

    def run(batches):
        from pyspark import TaskContext

        cells = np.zeros(BUCKETS, np.uint32)
        for batch in batches:
            n, c, ranges, fine = [], [], [], []
            for _, grams in _sets(batch.column(1), width):
                n.append(len(grams))
                c.append(_class_of(grams) if len(grams) else None)
                parts = np.bincount((grams >> np.uint64(57)).astype(np.int64), minlength=FINE)
                ranges.append(parts.reshape(RANGES, -1).sum(1).astype(np.int32))
                fine.append(np.minimum(parts, 127).astype(np.int8))
                np.add.at(cells, (grams & np.uint64(BUCKETS - 1)).astype(np.int64), 1)
            if n:
                yield rows(len(n), doc_id=batch.column(0), mark=batch.column(2), n=n, c=c, ranges=ranges, fine=fine)
        part = TaskContext.get().partitionId()
        small = np.minimum(cells, 255).astype(np.uint8).reshape(-1, BLOCK)
        for at in range(0, len(small), 64):
            some = [(k, small[k].tobytes()) for k in range(at, at + 64) if small[k].any()]
            if some:
                yield rows(len(some), block=[k for k, _ in some], part=[part] * len(some), counts=[x for _, x in some])

    return docs.mapInArrow(run, "doc_id BIGINT, mark STRING, n BIGINT, c BIGINT, ranges ARRAY<INT>, fine ARRAY<TINYINT>, block INT, part INT, counts BINARY")


def _counts(measured: DataFrame) -> np.ndarray:
    """Sum of the tasks' cells: added up by blocks, ``FAN_IN`` tasks at a time, then read as one table of
    ``BUCKETS`` numbers."""
    def added(kind):
        def add(table: pa.Table) -> pa.Table:
            total = np.zeros(BLOCK, np.uint32)
            for x in table.column("counts").to_pylist():
                total += np.frombuffer(x, kind)
            return pa.table({"block": pa.array([table["block"][0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})
        return add

    blocks = measured.where("block IS NOT NULL").select("block", F.floor(F.col("part") / FAN_IN).alias("some"), "counts")
    first = blocks.groupBy("block", "some").applyInArrow(added(np.uint8), "block INT, counts BINARY")
    found = first.groupBy("block").applyInArrow(added(np.uint32), "block INT, counts BINARY").collect()
    counts = np.zeros((BUCKETS // BLOCK, BLOCK), np.uint32)
    for r in found:
        counts[r["block"]] = np.frombuffer(bytes(r["counts"]), np.uint32)
    return counts.ravel()


def _prefixes(docs: DataFrame, shared: Broadcast, width: int, percent: int) -> DataFrame:
    def run(batches):
        cells = shared.value
        for batch in batches:
            token, c, n, pos = [], [], [], []
            for _, grams in _sets(batch.column(1), width):
                size = len(grams)
                if not size:
                    continue
                take = size - -(-percent * size // 100) + 1
                order = np.argsort(cells[(grams & np.uint64(BUCKETS - 1)).astype(np.int64)], kind="stable")[:take]
                token.append(grams[order])
                c.append(np.full(take, _class_of(grams), np.int64))
                n.append(np.full(take, size, np.int32))
                pos.append(np.arange(take, dtype=np.int32))
                if sum(map(len, token)) > 200_000:
                    yield _rows(token, c, n, pos)
                    token, c, n, pos = [], [], [], []
            if token:
                yield _rows(token, c, n, pos)

    return docs.mapInArrow(run, "token BIGINT, c BIGINT, n INT, pos INT")


def _rows(token, c, n, pos):
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(token).view(np.int64)), *(pa.array(np.concatenate(x)) for x in (c, n, pos))], ["token", "c", "n", "pos"])


def _texts(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """``(c, d, text)``, one text of each class in ``wanted(c, d)``. The id d keeps a class of many copies
    from meeting in one task; the rows of a pair (c, d) are equal sets, so any of them will do."""
    def run(batches):
        for batch in batches:
            c = [_class_of(g) if len(g) else None for _, g in _sets(batch.column("text"), width)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), batch.column("d"), batch.column("text")], ["c", "d", "text"])

    found = docs.select(_known("doc_id").alias("d"), "text").mapInArrow(run, "c BIGINT, d BIGINT, text STRING")
    return found.join(wanted, ["c", "d"]).dropDuplicates(["c", "d"])


def _known(doc_id: str):
    return F.coalesce(doc_id, F.lit(0).cast("long"))


def _verify(pairs: DataFrame, classes: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of ``pairs(a, b)`` that link, as ``(src, dst)``."""
    def run(batches):
        for batch in batches:
            keep = []
            for (_, x), (_, y) in zip(_sets(batch.column("ta"), width), _sets(batch.column("tb"), width)):
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            table = pa.Table.from_batches([batch]).select(["a", "b"]).rename_columns(["src", "dst"]).filter(pa.array(keep, pa.bool_()))
            yield from table.to_batches()

    def side(x: str) -> DataFrame:
        return classes.select(F.col("c").alias(x), _known("doc_id").alias(f"d{x}"), F.col("n").alias(f"n{x}"), F.col("ranges").alias(f"r{x}"))

    def text_of(x: str) -> DataFrame:
        return texts.select(F.col("c").alias(x), F.col("d").alias(f"d{x}"), F.col("text").alias(f"t{x}"))

    need = F.ceil(F.lit(percent) * (F.col("na") + F.col("nb")) / F.lit(100 + percent))
    apart = F.aggregate(F.zip_with("ra", "rb", lambda x, y: F.abs(x - y)), F.lit(0), lambda s, x: s + x)
    fit = pairs.join(side("a"), "a").join(side("b"), "b") \
        .where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) \
        .where(apart <= F.col("na") + F.col("nb") - 2 * need).select("a", "da", "b", "db")
    fit = fit.join(text_of("a"), ["a", "da"]).join(text_of("b"), ["b", "db"])
    return stage(fit.select("a", "b", "ta", "tb").mapInArrow(run, "src BIGINT, dst BIGINT"), "links")


def ngram_join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """``(doc_id, n_shingles, component_id)``, a row per row of ``docs``; edge cases as in ``components``."""
    return components(docs, doc_id, text, width, percent).select("doc_id", "n_shingles", "component_id")


def components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT,
               mark: Column | None = None) -> DataFrame:
    """``(doc_id, mark, n_shingles, component_id, component)``, a row per row of ``docs``.

    component tells components apart also where rows share a doc_id; it is null for an empty set. ``mark`` is a
    string of the caller's that tells a document's rows apart.

    Two documents link when 100 * |intersection| >= percent * |union| of their n-gram sets; words are
    lower-cased A-Z only. A text of fewer than ``width`` words is one n-gram; null, empty and blank texts
    have none and link with nothing, not even each other. component_id is the smallest doc_id reachable.
    Rows that share a doc_id are documents of their own; a null doc_id is only a component's id if no
    other is there. Other columns are left out; an empty table gives no row.
    """
    docs = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"),
                       (F.lit(None) if mark is None else mark).cast("string").alias("mark"))
    with passing(_measure(docs, width), "sets") as measured:
        counts = _counts(measured)
        nodes = stage(measured.where("n IS NOT NULL").drop("block", "part", "counts"), "nodes")
    # Equal sets have equal counts by range.
    classes = stage(nodes.where("c IS NOT NULL").groupBy("c").agg(F.min("doc_id").alias("doc_id"), F.min("n").alias("n"), F.any_value("ranges").alias("ranges"), F.any_value("fine").alias("fine")), "classes")

    shared = docs.sparkSession.sparkContext.broadcast(counts)  # BUCKETS numbers
    del counts
    with passing(_prefixes(docs.select("doc_id", "text"), shared, width, percent), "prefixes") as prefixes:
        shared.destroy()  # the prefixes are written
        rows = shared_keys(prefixes)
    wanted = rows.select("c").distinct().join(classes, "c").select("c", _known("doc_id").alias("d"))

    def detail(some: DataFrame) -> DataFrame:
        """Rows with their class's counts by hash range and its prefix n-grams here that stand before the row's own:
        no more of the prefix goes through the shuffle of the candidate join."""
        own = some.groupBy("c").agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("p")).select("c", F.col("p.token").alias("tokens"))
        before = F.slice("tokens", F.lit(1), F.array_position("tokens", F.col("token")).cast("int") - 1)
        return some.join(classes.select("c", "fine"), "c").join(own, "c").withColumn("before", before).drop("tokens")

    def rest(x: DataFrame, y: DataFrame) -> DataFrame:
        need = F.ceil(F.lit(percent) * (F.col("xn") + F.col("yn")) / F.lit(100 + percent))
        # A pair is made once, at its first shared n-gram: prefixes are in one order, so nothing before it is shared. Of a
        # pair that needs this overlap it stands in the first n - need + 1 of both sets, and all else shared follows it.
        first = ~F.arrays_overlap("xbefore", "ybefore")
        most = 1 + F.least(F.col("xn") - F.col("xpos") - 1, F.col("yn") - F.col("ypos") - 1)
        # What the counts by hash range differ by, the sets differ by at least.
        apart = F.aggregate(F.zip_with("xfine", "yfine", lambda a, b: F.abs(a - b)), F.lit(0), lambda s, d: s + d)
        pairs = x.join(y, (F.col("xtoken") == F.col("ytoken")) & (F.col("xc") < F.col("yc")) & (F.col("xk") != F.col("yk"))
                       & (100 * F.least("xn", "yn") >= percent * F.greatest("xn", "yn"))
                       & (F.col("xpos") <= F.col("xn") - need) & (F.col("ypos") <= F.col("yn") - need) & (most >= need)
                       & (apart <= F.col("xn") + F.col("yn") - 2 * need) & first)
        return pairs.select(F.col("xc").alias("a"), F.col("yc").alias("b"))

    with bucketed(_texts(docs, wanted, width), "texts", "c", "d") as texts:
        links = link(rows, lambda pairs: _verify(pairs, classes, texts, width, percent), rest,
                     detail)

    component = connected_components(links).withColumnRenamed("node", "c")
    reached = classes.select("c", "doc_id").join(component, "c")
    least = reached.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of_class = classes.select("c", F.col("doc_id").alias("own")).join(component, "c", "left").join(least, "component", "left") \
        .select("c", F.coalesce("component", "c").alias("component"), F.coalesce("component_id", "own").alias("component_id"))
    of_class = stage(of_class, "class-components")
    return nodes.join(of_class, "c", "left").select(
        "doc_id", "mark", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "component")


def op4_ngram_join(docs: DataFrame) -> DataFrame:
    """Every document's component. Edge cases as in ``components``."""
    return ngram_join(docs)
