"""Target-distribution importance resampling on hashed n-grams.

Each document is normalised to its words joined by one space and scanned once: the
running CRC-32 at the end of every word is stored. The CRC of any run of words then
follows from two prefixes: the CRC of the whole is the CRC of what stands before the
run, moved over the run's bytes by a linear map over GF(2), plus (exclusive or) the
CRC of the run; so the earlier prefix cancels. Runs are counted by bucket over all
documents and over the target texts, a document weighs the sum of its runs' gains,
and those with the highest weight plus seeded Gumbel noise are drawn.
"""

from __future__ import annotations

import math
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.llm.storage import stage
from framewright.llm.text_expr import free_name

BUCKETS = 10_000
WIDTH = 3  # words of the longest run
MIN_WORDS = 20  # words of a document that may be drawn, at least
PERCENT = 5  # share of these documents that is drawn
SEED = 42
CHUNK_WORDS = 1 << 18  # words whose runs are derived at once: bounds the temporary arrays

_POLYNOMIAL = 0xEDB88320  # of CRC-32, bits reversed
_TABLED = 64  # moves over fewer bytes have a table of their own
_NORMAL = bytes(x if 48 <= x <= 57 or 97 <= x <= 122 or x > 127 else (x + 32 if 65 <= x <= 90 else 32) for x in range(256))


def _over_byte(crc: np.ndarray) -> np.ndarray:
    """CRCs moved over one zero byte."""
    for _ in range(8):
        crc = np.where(crc & np.uint32(1), (crc >> np.uint32(1)) ^ np.uint32(_POLYNOMIAL), crc >> np.uint32(1))
    return crc


def _apply(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """A linear map as the exclusive or of its values at the four bytes of the argument."""
    return table[0][crc & np.uint32(255)] ^ table[1][(crc >> np.uint32(8)) & np.uint32(255)] \
        ^ table[2][(crc >> np.uint32(16)) & np.uint32(255)] ^ table[3][crc >> np.uint32(24)]


@cache
def _moves() -> tuple[np.ndarray, list[np.ndarray]]:
    """Tables of the moves over 0 to ``_TABLED`` - 1 bytes, and over 2**k bytes for each k."""
    at = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
    short = [at]
    for _ in range(_TABLED - 1):
        short.append(_over_byte(short[-1]))
    doubled = [short[1]]
    for _ in range(40):
        doubled.append(_apply(doubled[-1], doubled[-1]))
    return np.stack(short).reshape(-1), doubled


def moved(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Each CRC moved over ``n`` zero bytes."""
    short, doubled = _moves()
    row = np.where(n < _TABLED, n, 0) << 10
    out = short[row + (crc & np.uint32(255))]
    for k in range(1, 4):
        out ^= short[row + (256 * k) + ((crc >> np.uint32(8 * k)) & np.uint32(255))]
    far = np.flatnonzero(n >= _TABLED)
    if len(far):
        some, left = crc[far], n[far]
        for table in doubled:
            odd = (left & 1).astype(bool)
            some = np.where(odd, _apply(table, some), some)
            left = left >> 1
            if not left.any():
                break
        out[far] = some
    return out


def prefixes(text: str | None) -> tuple[list[int], list[int]]:
    """Running CRCs at the end of each word of the normalised text, and their places in bytes."""
    pieces = b"\0 ".join((text or "").encode().translate(_NORMAL).split()).split(b"\0")
    crc, at = 0, 0
    if not pieces[0]:
        return [], []
    return [crc := zlib.crc32(p, crc) for p in pieces], [at := at + len(p) for p in pieces]


def runs(crcs: np.ndarray, ends: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """CRC and first word of every run of 1 to ``width`` words, by first word, then length.

    ``first`` marks the words that begin a text; ``crcs`` and ``ends`` are those of ``prefixes``.
    """
    n = len(crcs)
    if not n:
        return np.empty(0, np.uint32), np.empty(0, np.int64)
    before, start = np.zeros(n, np.uint32), np.zeros(n, np.int64)
    # The prefix before a word ends with its space: the CRC at the earlier word's end, one byte on.
    before[1:] = moved(crcs[:-1], np.ones(n - 1, np.int64)) ^ np.uint32(zlib.crc32(b" "))
    start[1:] = ends[:-1] + 1
    before[first], start[first] = 0, 0
    text = np.cumsum(first)
    found = np.zeros((n, width), np.uint32)
    there = np.zeros((n, width), bool)
    for k in range(min(width, n)):
        same = text[k:] == text[:n - k]
        found[:n - k, k] = crcs[k:] ^ moved(before[:n - k], np.where(same, ends[k:] - start[:n - k], 0))
        there[:n - k, k] = same
    return found[there], np.nonzero(there)[0]


def hashed(docs: DataFrame, key: list[str], text: str, buckets: int = BUCKETS, width: int = WIDTH) -> DataFrame:
    """``key..., n_words, n_features, codes`` for every row of ``docs``.

    codes holds the bucket of each run in four bytes (two where all buckets fit), repeats counted.
    """
    kind = np.dtype("<u2" if buckets <= 1 << 16 else "<u4")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*(f"`{k}`" for k in key)).schema.fields]

    def coded(held):
        """n_words and codes of some texts together."""
        words = np.array([len(c) for c, _ in held], np.int64)
        crcs = np.array([x for c, _ in held for x in c], np.uint32)
        ends = np.array([x for _, e in held for x in e], np.int64)
        first = np.zeros(len(crcs), bool)
        at = np.concatenate([[0], np.cumsum(words)])
        first[at[:-1][words > 0]] = True
        found, where = runs(crcs, ends, first, width)
        codes = (found % np.uint32(buckets)).astype(kind)
        cut = np.searchsorted(where, at)
        return words, np.diff(cut), [codes[a:b].tobytes() for a, b in zip(cut, cut[1:])]

    def run(batches):
        for batch in batches:
            words, features, codes, held, size = [], [], [], [], 0
            texts = batch.column(batch.num_columns - 1)
            for k in range(batch.num_rows):
                held.append(prefixes(texts[k].as_py()))
                size += len(held[-1][0])
                if size >= CHUNK_WORDS or k + 1 == batch.num_rows:
                    w, f, c = coded(held)
                    words.append(w), features.append(f), codes.extend(c)
                    held, size = [], 0
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:-1], pa.array(np.concatenate(words)), pa.array(np.concatenate(features)), pa.array(codes, pa.binary())],
                    [*key, "n_words", "n_features", "codes"])

    schema = ", ".join([*fields, "n_words BIGINT", "n_features BIGINT", "codes BINARY"])
    return docs.select(*(f"`{k}`" for k in key), F.col(f"`{text}`").cast("string")).mapInArrow(run, schema)


def bucket_counts(coded: DataFrame, buckets: int = BUCKETS) -> dict[int, int]:
    """Runs of each bucket over all rows: summed in each task, then by bucket; ``buckets`` rows at most reach the driver."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for codes in batch.column(0):
                total += np.bincount(np.frombuffer(codes.as_buffer(), kind), minlength=buckets) if len(codes.as_buffer()) > buckets else 0
            small = [c for c in batch.column(0).to_pylist() if 0 < len(c) <= buckets]
            if small:
                total += np.bincount(np.frombuffer(b"".join(small), kind), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    counts = coded.select("codes").mapInArrow(run, "bucket BIGINT, n BIGINT").groupBy("bucket").agg(F.sum("n").alias("n"))
    return {r["bucket"]: r["n"] for r in counts.collect()}


def gains(raw: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> np.ndarray:
    """Gain of each bucket in thousandths: the log of the target's smoothed share over the raw one."""
    s_all, t_all = float(sum(raw.values()) + buckets), float(sum(target.values()) + buckets)
    return np.array([math.floor(1000 * math.log((target.get(b, 0) + 1.0) * s_all / ((raw.get(b, 0) + 1.0) * t_all))) for b in range(buckets)], np.int64)


def weighted(coded: DataFrame, key: list[str], gain: np.ndarray) -> DataFrame:
    """``key..., n_words, n_features, weight``: the sum of the gains of a row's runs."""
    kind = "<u2" if len(gain) <= 1 << 16 else "<u4"

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                weight = [int(gain[np.frombuffer(c, kind)].sum()) for c in batch.column(batch.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(weight, pa.int64())], [*key, "n_words", "n_features", "weight"])

    coded = coded.select(*(f"`{k}`" for k in key), "n_words", "n_features", "codes")
    return coded.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in coded.schema.fields[:-1]) + ", weight BIGINT")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise of a document in thousandths, the same in every run; a null id counts as the text null."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def ranked(rows: DataFrame, eligible: Column, order: list[Column], percent: int) -> DataFrame:
    """``rows`` with rank: 1, 2, 3... for the first ``percent`` of a hundred of the eligible rows in ``order``, else null.

    Rows are dealt by ranges of the order; the rows before a range are those of the earlier ranges,
    so no task sorts more than its own range.
    """
    part = free_name(rows.columns, "_part")
    some = rows.where(eligible)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stage(some.repartitionByRange(parts, *order).withColumn(part, F.spark_partition_id()), "ranges")
    # One row a range.
    sizes = dealt.groupBy(part).agg(F.count("*").alias("_n"))
    sizes = sizes.select(part, F.coalesce(F.sum("_n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
                         F.floor(F.sum("_n").over(Window.partitionBy()) * percent / 100).alias("_drawn"))
    place = F.col("_before") + F.row_number().over(Window.partitionBy(part).orderBy(*order))
    out = dealt.join(F.broadcast(sizes), part).withColumn("rank", place)
    out = out.select(*(f"`{c}`" for c in rows.columns), F.when(F.col("rank") <= F.col("_drawn"), F.col("rank")).cast("long").alias("rank"))
    return out.unionAll(rows.where(~eligible).withColumn("rank", F.lit(None).cast("long")))


def scores(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text",
           percent: int = PERCENT, min_words: int = MIN_WORDS, buckets: int = BUCKETS, width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """``doc_id, copy, n_words, n_features, weight, score, rank``, a row per row of ``docs``.

    copy is a hash of the text. Null and empty texts have no feature and weight 0; an empty target
    or an empty table gives counts of 0. Rows with equal score and id follow each other by ``copy``,
    repeated rows stand side by side; a null id comes after all others of its score. Other columns are left out.
    """
    i = F.col(f"`{doc_id}`").cast("long").alias("doc_id")
    t = F.col(f"`{text}`").cast("string")
    key = ["doc_id", "copy"]
    coded = stage(hashed(docs.select(i, F.xxhash64(t).alias("copy"), t.alias("text")), key, "text", buckets, width), "codes")
    aim = hashed(target.select(F.col(f"`{target_text}`").alias("text")), [], "text", buckets, width)
    gain = gains(bucket_counts(coded, buckets), bucket_counts(aim, buckets), buckets)
    rows = stage(weighted(coded, key, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "weights")
    return ranked(rows, F.col("n_words") >= min_words, [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("copy")], percent)


def resample(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """The drawn rows of ``docs``, with its columns. Rows that share id and text are drawn together."""
    names = [free_name(docs.columns, x) for x in ("_i", "_copy")]
    drawn = scores(docs, target, doc_id, text, **settings).where("rank IS NOT NULL") \
        .select(F.col("doc_id").alias(names[0]), F.col("copy").alias(names[1])).distinct()
    wide = docs.join(drawn, F.col(f"`{doc_id}`").cast("long").eqNullSafe(F.col(names[0]))
                     & (F.xxhash64(F.col(f"`{text}`").cast("string")) == F.col(names[1])), "left_semi")
    return wide.select(*(F.col(f"`{c}`") for c in docs.columns))


def op12_importance(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Every document's importance and draw; edge cases as in ``scores``."""
    return scores(docs, benchmark).select("doc_id", "n_features", "weight", "score", "rank")


# The CRC is computed byte by byte, from a table that follows from the polynomial.
OP12_SQL = rf"""
WITH crc_table AS (SELECT list(list_reduce(range(0, 8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, {_POLYNOMIAL}) ELSE c >> 1 END, n) ORDER BY n) AS t
                   FROM range(0, 256) r(n)),
texts AS (SELECT 0 AS side, doc_id, row_number() OVER () AS row, text FROM documents UNION ALL SELECT 1, NULL, row_number() OVER (), text FROM benchmark),
w AS (SELECT side, doc_id, row, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
g AS (SELECT side, row, unnest(flatten(list_transform(range(1, {WIDTH} + 1), lambda k: list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))))) AS g FROM w),
n AS (SELECT side, row, g, count(*) AS n FROM g GROUP BY ALL),
c AS (SELECT g, xor(list_reduce(list_transform(regexp_extract_all(hex(g), '..'), lambda h: ('0x' || h)::BIGINT),
        lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1]), 4294967295), 4294967295) % {BUCKETS} AS bucket FROM (SELECT DISTINCT g FROM n), crc_table),
b AS (SELECT side, row, bucket, sum(n) AS n FROM n JOIN c USING (g) GROUP BY ALL),
k AS (SELECT bucket, coalesce(sum(n) FILTER (side = 0), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (side = 1), 0)::DOUBLE AS t FROM b GROUP BY bucket),
a AS (SELECT bucket, floor(1000 * ln((t + 1) * ((sum(s) OVER ()) + {BUCKETS}) / ((s + 1) * ((sum(t) OVER ()) + {BUCKETS}))))::BIGINT AS gain FROM k),
d AS (SELECT row, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM b JOIN a USING (bucket) WHERE side = 0 GROUP BY row),
s AS (SELECT doc_id, row, len(w) AS words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
        coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('{SEED}:' || doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
      FROM w LEFT JOIN d USING (row) WHERE side = 0),
r AS (SELECT row, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM s WHERE words >= {MIN_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= {PERCENT} * n // 100 THEN rank END AS rank FROM s LEFT JOIN r USING (row)
"""
