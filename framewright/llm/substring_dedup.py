"""Substring dedup: paragraph MinHash banding, exact verification, components of removals.

Two kinds of paragraphs are compared. A line of ``MIN_WORDS`` words or more is one, and so are the
lines up to a blank line if they have as many words together, however they are wrapped, with a
MinHash signature of its five-word shingles; ``tune`` chooses bands and rows for the wanted
recall, paragraphs that collide in a band are joined unless the hash ranges of their shingles
differ too much, and the exact Jaccard similarity of their shingle sets decides. And since passages
are also copied into the middle of a line, ``MIN_PASSAGE`` words around each place where the hash of
two words is the least of its neighbourhood make a seed: a passage has the same seeds wherever it
stands. Seeds of several documents are candidates, and those that always follow one another with
the same words between them are one. Each place of a candidate is laid beside the first place of it,
goes on to both sides as far as the words are equal, and further over changed, added or left out words while the
similarity of the five-word shingles, as they are laid side by side, is as asked: these are the ends of a passage.
Candidates that end as the same words are one class.
Components of near lines and classes of passages tell what is a copy of what; all but the
first of a class can be removed.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framewright.llm import wordhash
from framewright.llm.components import connected_components
from framewright.llm.rounds import link, shared_keys
from framewright.llm.storage import stage
from framewright.llm.text_expr import free_name

SHINGLE = 5
SIMILARITY = 0.8
RECALL = 0.98
MIN_WORDS = 20
MIN_PASSAGE = 16
REACH = 4  # words on either side that a cut's hash is the least of
CONTEXT = 40  # words on either side of a candidate that it may go on over
EDITS = ((1, 1), (0, 1), (1, 0), (2, 2))  # words passed over on both sides where a passage was changed
FILTER_BITS = 1 << 20  # size of the document filter before texts are fetched
MASKS = ("q0", "q1", "q2", "q3")  # 64 bits each: the hash ranges in which a paragraph has a shingle
_SEEDS = np.random.Generator(np.random.PCG64(77)).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def tune(similarity: float = SIMILARITY, recall: float = RECALL, most: int = 24) -> tuple[int, int]:
    """Bands and rows with the most rows (fewest false collisions) that find a pair of this similarity
    with this probability, within ``most`` hashes."""
    for rows in range(most, 0, -1):
        miss = 1 - similarity ** rows
        bands = 1 if miss <= 0 else math.ceil(math.log(1 - recall) / math.log(miss))
        if bands * rows <= most:
            return bands, rows
    return most, 1


def _cuts(hashes: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Words of a run of texts at which two words have the least hash of their neighbourhood (the first of
    equal ones), and the first word of each text; text k has the words ``cut[k]`` to ``cut[k + 1]``."""
    n, size = len(hashes), np.diff(cut)
    begin = cut[:-1][size > 0]
    if n < 2:
        return begin
    most = np.iinfo(np.uint64).max
    g = np.append(wordhash.shingles(hashes, 2), most)
    g[cut[1:][size > 0] - 1] = most  # the last word of a text begins no two
    at = np.arange(n) + np.repeat(np.arange(len(size)), size) * REACH + REACH  # texts stand ``REACH`` apart
    wide = np.full(n + (len(size) + 2) * REACH, most, np.uint64)
    wide[at] = g
    least = np.ones(len(wide) - 2 * REACH, bool)
    for d in range(1, REACH + 1):
        least &= (wide[REACH:-REACH] < wide[REACH - d:len(wide) - REACH - d]) & (wide[REACH:-REACH] <= wide[REACH + d:len(wide) - REACH + d])
    return np.union1d(np.flatnonzero(least[at - REACH] & (g < most)), begin)


def _seeds(cuts: np.ndarray, cut: np.ndarray, least: int) -> np.ndarray:
    """First words of the seeds, of ``least`` words around each of ``cuts``, none beyond its text."""
    text = np.searchsorted(cut, cuts, "right") - 1
    long = cut[text + 1] - cut[text] >= least
    cuts, text = cuts[long], text[long]
    return np.unique(np.clip(cuts + 1 - least // 2, cut[text], cut[text + 1] - least))


def _run_hashes(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the words of each run, the same wherever it stands."""
    power, inverse = wordhash._tables(len(hashes))
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * power[:len(hashes)], out=total[1:])
    return wordhash.mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def _signatures(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band keys (lines x bands) of lines of words; each has ``SHINGLE`` words at least."""
    grams = wordhash.shingles(hashes, SHINGLE)
    keys = np.zeros((len(starts), bands), np.uint64)
    # Shingles that cross into the next line belong to none: ranges [start, end - SHINGLE + 1).
    edges = np.stack([starts, ends - SHINGLE + 1], 1).ravel()
    for b in range(bands):
        key = np.full(len(starts), b, np.uint64)
        for r in range(rows):
            seed = _SEEDS[b * rows + r]
            x = (grams ^ seed) * _SEEDS[(b * rows + r + 31) % 64]
            x ^= x >> np.uint64(29)
            least = np.minimum.reduceat(np.append(x, np.iinfo(np.uint64).max), edges)[::2]
            key = wordhash.mix(key * np.uint64(0x9E3779B97F4A7C15) + least)
        keys[:, b] = key
    return keys


def _masks(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Bits (lines x 4) of the 256 hash ranges that hold a shingle of the line."""
    grams = wordhash.shingles(hashes, SHINGLE)
    edges = np.stack([starts, ends - SHINGLE + 1], 1).ravel()
    bit = np.uint64(1) << ((grams >> np.uint64(56)) & np.uint64(63))
    word = grams >> np.uint64(62)
    return np.stack([np.bitwise_or.reduceat(np.append(np.where(word == k, bit, np.uint64(0)), np.uint64(0)), edges)[::2] for k in range(len(MASKS))], 1)


_UNITS = pa.schema([("doc_id", pa.int64()), ("t", pa.int64()), ("line", pa.bool_()), ("par", pa.int32()), ("whole", pa.bool_()), ("ord", pa.int32()), ("start", pa.int32()),
                    ("n", pa.int32()), ("h", pa.int64()), ("g", pa.int64()), *((q, pa.int64()) for q in MASKS), ("bands", pa.list_(pa.int64()))])


def _lines(newlines: np.ndarray, starts: np.ndarray, cut: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and end word of the lines, and of the several lines up to a blank line, of ``least`` words
    or more; the first word of the paragraph that each is in, and whether it is all of several lines."""
    line = np.searchsorted(newlines, starts)
    step = np.diff(line, prepend=-2)
    step[cut[:-1][np.diff(cut) > 0]] = 2  # a new text
    first, begin = np.flatnonzero(step), np.flatnonzero(step > 1)
    end, stop = np.append(first[1:], len(line)), np.append(begin[1:], len(line))
    several = np.searchsorted(first, stop) - np.searchsorted(first, begin) > 1
    par = begin[np.searchsorted(begin, first, "right") - 1]
    first, end = np.concatenate([first, begin[several]]), np.concatenate([end, stop[several]])
    par, whole = np.concatenate([par, begin[several]]), np.arange(len(first)) >= len(par)
    long = end - first >= least
    return first[long], end[long], par[long], whole[long]


def _text_key(data) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


def _units(docs: DataFrame, bands: int, rows: int, min_words: int, min_passage: int) -> DataFrame:
    width = max(min_passage, 1)

    def run(batches):
        for batch in batches:
            ids = np.array(batch.column(0).to_pylist(), np.int64)
            for row, data, inner, cut, starts, _, hashes in wordhash.text_runs(batch.column(1), lower=True):
                if not len(hashes):
                    continue
                size = np.diff(cut)
                keys_of = np.array([_text_key(data[inner[k]:inner[k + 1]]) if size[k] else 0 for k in range(len(size))], np.int64)
                seed = _seeds(_cuts(hashes, cut), cut, width)
                first, last, par, several = _lines(np.flatnonzero(data == 10), starts, cut, max(min_words, SHINGLE))
                a, b = len(seed), len(first)
                if not a + b:
                    continue
                keys = _signatures(hashes, first, last, bands, rows) if b else np.empty((0, bands), np.uint64)
                bits = _masks(hashes, first, last).view(np.int64) if b else np.empty((0, len(MASKS)), np.int64)
                at, end = np.concatenate([seed, first]), np.concatenate([seed + width, last])
                text = np.searchsorted(cut, at, "right") - 1
                base = cut[text]
                # g: the words from the seed before to the end of this one
                back = np.concatenate([seed[:1], seed[:-1]])
                back = np.where(back >= base[:a], back, seed)
                g = np.concatenate([_run_hashes(hashes, back, seed + width), np.zeros(b, np.uint64)])
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids[row + text]), pa.array(keys_of[text]), pa.array(np.arange(a + b) >= a),
                    pa.array(np.concatenate([np.zeros(a, np.int64), par - base[a:]]).astype(np.int32)), pa.array(np.concatenate([np.zeros(a, bool), several])),
                    pa.array(np.concatenate([np.arange(a) - np.searchsorted(seed, base[:a]), np.arange(b)]).astype(np.int32)), pa.array((at - base).astype(np.int32)), pa.array((end - at).astype(np.int32)),
                    pa.array(_run_hashes(hashes, at, end).view(np.int64)), pa.array(g.view(np.int64)),
                    *(pa.array(np.concatenate([np.zeros(a, np.int64), bits[:, k]])) for k in range(len(MASKS))),
                    pa.ListArray.from_arrays(pa.array(np.concatenate([np.zeros(a), np.arange(b + 1) * bands]).astype(np.int32)), pa.array(keys.view(np.int64).ravel()))], schema=_UNITS)

    return stage(docs.mapInArrow(run, "doc_id BIGINT, t BIGINT, line BOOLEAN, par INT, whole BOOLEAN, ord INT, start INT, n INT, h BIGINT, g BIGINT, "
                                 + ", ".join(f"{q} BIGINT" for q in MASKS) + ", bands ARRAY<BIGINT>"), "units")


def _some(docs: DataFrame, wanted: DataFrame):
    """The rows of ``docs`` whose doc_id may be in ``wanted``, and the broadcast to destroy after use.

    A filter of fixed size over document ids drops most texts before they are shuffled; where it is
    full it drops none, and the join that follows decides alone.
    """
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS)).cast("int")
    used = wanted.select(slot.alias("s")).distinct().toPandas()["s"].to_numpy(np.int64)  # at most FILTER_BITS numbers
    bits = np.zeros(FILTER_BITS, bool)
    bits[used] = True
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(bits))  # FILTER_BITS bits

    def some(batches):
        member = np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            mask = pa.array(member[batch.column("s").to_numpy()])
            yield from pa.Table.from_batches([batch]).filter(mask).select(["doc_id", "text"]).to_batches()

    return docs.withColumn("s", slot).mapInArrow(some, "doc_id BIGINT, text STRING"), shared


def _fetch(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(h, words)`` text of the wanted paragraphs ``(doc_id, t, start, n, h)``."""
    near, shared = _some(docs, wanted)

    def cut(batches):
        for batch in batches:
            keys, out = [], []
            cols = [batch.column(c).to_pylist() for c in ("text", "t", "start", "n", "h")]
            for (_, starts, ends, _), text, t, start, n, h in zip(wordhash.text_words(batch.column("text")), *cols):
                data = text.encode()
                if _text_key(data) == t:
                    keys.append(h)
                    out.append(data[starts[start]:ends[start + n - 1]].decode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(out, pa.string())], ["h", "words"])

    found = near.join(wanted.withColumnRenamed("doc_id", "_doc"), F.col("doc_id") == F.col("_doc")).select("text", "t", "start", "n", "h")
    out = stage(found.mapInArrow(cut, "h BIGINT, words STRING").dropDuplicates(["h"]), "paragraphs")
    shared.destroy()
    return out


def _shingle_sets(column: pa.Array):
    """The sorted distinct shingles of each text; texts have ``SHINGLE`` words or more."""
    for _, _, inner, cut, _, _, hashes in wordhash.text_runs(column, lower=True):
        grams = wordhash.shingles(hashes, SHINGLE)  # those across two texts are in no slice
        for k in range(len(inner) - 1):
            yield np.unique(grams[cut[k]:cut[k + 1] - SHINGLE + 1])


def _verify(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(_shingle_sets(batch.column("ta")), _shingle_sets(batch.column("tb"))):
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both))
            table = pa.Table.from_batches([batch]).select(["a", "b"]).rename_columns(["src", "dst"])
            yield from table.filter(pa.array(keep, pa.bool_())).to_batches()

    both = pairs.join(texts.select(F.col("h").alias("a"), F.col("words").alias("ta")), "a").join(texts.select(F.col("h").alias("b"), F.col("words").alias("tb")), "b")
    return stage(both.select("a", "b", "ta", "tb").mapInArrow(run, "src BIGINT, dst BIGINT"), "links")


def _paragraphs(docs: DataFrame, lines: DataFrame, similarity: float) -> DataFrame:
    """Lines and paragraphs that have a near copy in another document: doc_id, t, start, n, class_id.

    A line of a paragraph that is itself in the class is no copy of it, and left out."""
    first = F.min(F.struct("doc_id", "t", "start", "n")).alias("first")
    classes = stage(lines.groupBy("h").agg(first, F.max("doc_id").alias("high"), (F.min("n") - (SHINGLE - 1)).alias("u"),
                                           *(F.min(q).alias(q) for q in MASKS), F.any_value("bands").alias("bands")), "classes")
    rows = shared_keys(classes.select(F.explode("bands").alias("token"), F.col("h").alias("c"), "u", *MASKS))
    texts = _fetch(docs, classes.join(rows.select(F.col("c").alias("h")).distinct(), "h").select("first.*", "h"))

    def rest(x: DataFrame, y: DataFrame) -> DataFrame:
        # Sets as similar as asked differ by at most this share of their sizes, of which u is an upper bound; each
        # hash range that only one of them reaches holds a difference.
        apart = sum((F.bit_count(F.col("x" + q).bitwiseXOR(F.col("y" + q))) for q in MASKS), F.lit(0))
        return x.join(y, (F.col("xtoken") == F.col("ytoken")) & (F.col("xc") < F.col("yc")) & (F.col("xk") != F.col("yk"))
                      & (apart <= (1 - similarity) / (1 + similarity) * (F.col("xu") + F.col("yu")) + 1e-6)) \
            .select(F.col("xc").alias("a"), F.col("yc").alias("b")).distinct()

    links = link(rows, lambda pairs: _verify(pairs, texts, similarity), rest)
    found = connected_components(links)
    of = classes.join(found.withColumnRenamed("node", "h"), "h", "left").select("h", F.coalesce("component", "h").alias("class_id"), F.col("first.doc_id").alias("low"), "high")
    across = of.groupBy("class_id").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low < high").select("class_id")
    several = stage(of.select("h", "class_id").join(across, "class_id"), "near-lines")
    inside = Window.partitionBy("doc_id", "t", "class_id", "par")
    return lines.join(several, "h").withColumn("all", F.max("whole").over(inside)).where("whole OR NOT all").select("doc_id", "t", "start", "n", "class_id")


def _candidates(seeds: DataFrame) -> DataFrame:
    """Longest runs of seeds that stand together, with the same words between them, wherever one of them
    stands: doc_id, t, start, n, c (which run) and head (whether it is the first place of the run).

    A seed goes on with the one before it if that comes as often and stands before it each time.
    """
    shared = seeds.groupBy("h").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("h")
    hits = seeds.join(shared, "h").select("doc_id", "t", "ord", "start", "n", "h", "g").distinct()
    order = Window.partitionBy("doc_id", "t").orderBy("start")
    before = F.when(F.lag("ord").over(order) == F.col("ord") - 1, F.col("g"))
    hits = stage(hits.withColumn("before", before).drop("ord", "g"), "hits")
    places = hits.groupBy("h").agg(F.count("*").alias("places"), ((F.count("before") == F.count("*")) & (F.min("before") == F.max("before"))).alias("follows"))
    hits = hits.join(places, "h").withColumn("new", F.when(F.col("follows") & (F.lag("places").over(order) == F.col("places")), 0).otherwise(1))
    runs = stage(hits.withColumn("run", F.sum("new").over(order)).groupBy("doc_id", "t", "run").agg(
        F.min("start").alias("start"), F.max(F.col("start") + F.col("n")).alias("end"), F.min_by("h", "start").alias("c")), "runs")
    first = runs.groupBy("c").agg(F.min(F.struct("doc_id", "t", "start")).alias("first"))
    return runs.join(first, "c").select("doc_id", "t", "start", (F.col("end") - F.col("start")).alias("n"), "c", (F.struct("doc_id", "t", "start") == F.col("first")).alias("head"))


def _surroundings(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """The candidates with the hashes of up to ``CONTEXT`` words on their left and right, 4 bytes a word, nearest first."""
    runs = stage(runs, "places")
    near, shared = _some(docs, runs)
    spans = runs.groupBy(F.col("doc_id").alias("_doc"), "t").agg(F.collect_list(F.struct("start", "n", "c", "head")).alias("spans"))

    def run(batches):
        for batch in batches:
            out = {c: [] for c in ("doc_id", "t", "start", "n", "c", "head", "left", "right")}
            cols = [batch.column(c).to_pylist() for c in ("doc_id", "t", "spans")]
            for row, data, inner, cut, _, _, hashes in wordhash.text_runs(batch.column("text"), lower=True):
                small = (hashes >> np.uint64(32)).astype(np.uint32)
                for k in range(len(inner) - 1):
                    doc, t, found = (c[row + k] for c in cols)
                    if _text_key(data[inner[k]:inner[k + 1]]) != t:
                        continue
                    words = small[cut[k]:cut[k + 1]]
                    for s in found:
                        at, end = s["start"], s["start"] + s["n"]
                        for c, v in zip(out, (doc, t, at, s["n"], s["c"], s["head"], words[max(at - CONTEXT, 0):at][::-1].tobytes(), words[end:end + CONTEXT].tobytes())):
                            out[c].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("doc_id", pa.int64()), ("t", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("c", pa.int64()),
                                                                    ("head", pa.bool_()), ("left", pa.binary()), ("right", pa.binary())]))

    joined = near.join(spans, F.col("doc_id") == F.col("_doc")).select("doc_id", "t", "spans", "text")
    out = stage(joined.mapInArrow(run, "doc_id BIGINT, t BIGINT, start INT, n INT, c BIGINT, head BOOLEAN, left BINARY, right BINARY"), "places")
    shared.destroy()
    return out


def _onward(a: list[int], b: list[int]) -> list[tuple[int, int, int]]:
    """How two texts go on alike: stretches (words passed over in a, in b, equal words after them).

    The first has nothing to pass over; each other one has ``SHINGLE`` equal words or more."""
    out, x, y, skip = [], 0, 0, (0, 0)
    while skip:
        x, y = x + skip[0], y + skip[1]
        most, k = min(len(a) - x, len(b) - y), 0
        while k < most and a[x + k] == b[y + k]:
            k += 1
        out.append((*skip, k))
        x, y = x + k, y + k
        skip = next(((i, j) for i, j in EDITS if len(a) >= x + i + SHINGLE and a[x + i:x + i + SHINGLE] == b[y + j:y + j + SHINGLE]), None)
    return out


def _reach(left: list[tuple[int, int, int]], right: list[tuple[int, int, int]], n: int, similarity: float) -> tuple[int, int, int, int]:
    """Words that a passage of ``n`` equal words goes on to the left in a and b, and to the right in a and b.

    Outer stretches are given up, the shorter one first, until the five-word shingles of both, as the stretches lie
    side by side, have the similarity asked for."""
    while True:
        la, lb, ra, rb = (sum(s[side] + s[2] for s in part) for part in (left, right) for side in (0, 1))
        shared = max(n + left[0][2] + right[0][2] - SHINGLE + 1, 0) + sum(s[2] - SHINGLE + 1 for s in left[1:] + right[1:])
        if len(left) == len(right) == 1 or shared >= similarity * (la + ra + lb + rb + 2 * (n - SHINGLE + 1) - shared):
            return la, lb, ra, rb
        if len(right) == 1 or len(left) > 1 and left[-1][2] <= right[-1][2]:
            left = left[:-1]
        else:
            right = right[:-1]


_SPANS = pa.schema([("c", pa.int64()), ("doc_id", pa.int64()), ("t", pa.int64()), ("at", pa.int32()), ("start", pa.int32()), ("stop", pa.int32())])


def _passages(docs: DataFrame, seeds: DataFrame, similarity: float) -> DataFrame:
    """Passages that stand in several documents, up to their ends: doc_id, t, start, n, class_id."""
    places = _surroundings(docs, _candidates(seeds))
    heads = places.where("head").dropDuplicates(["c"]).select("c", *(F.col(k).alias("h_" + k) for k in ("doc_id", "t", "start", "left", "right")))

    def run(batches):
        for batch in batches:
            cols = batch.to_pydict()
            words = [[np.frombuffer(x, np.uint32).tolist() for x in cols[k]] for k in ("h_left", "left", "h_right", "right")]
            out = []
            for c, doc, t, start, n, hdoc, ht, hstart, hl, l, hr, r in zip(*(cols[k] for k in ("c", "doc_id", "t", "start", "n", "h_doc_id", "h_t", "h_start")), *words):
                if (doc, t) == (hdoc, ht):  # what goes on in one text would meet itself
                    reach = (0, 0, 0, 0)
                else:
                    reach = _reach(_onward(hl, l), _onward(hr, r), n, similarity)
                out.append((c, hdoc, ht, hstart, hstart - reach[0], hstart + n + reach[2]))
                out.append((c, doc, t, start, start - reach[1], start + n + reach[3]))
            yield pa.RecordBatch.from_arrays([pa.array(col, f.type) for col, f in zip(zip(*out) if out else [[]] * len(_SPANS), _SPANS)], schema=_SPANS)

    pairs = places.where("NOT head").join(heads, "c").select("c", "doc_id", "t", "start", "n", "left", "right", "h_doc_id", "h_t", "h_start", "h_left", "h_right")
    spans = stage(pairs.mapInArrow(run, "c BIGINT, doc_id BIGINT, t BIGINT, at INT, start INT, stop INT")
                  .groupBy("c", "doc_id", "t", "at").agg(F.min("start").alias("start"), F.max("stop").alias("stop")), "spans")
    same = spans.groupBy("doc_id", "t", "start", "stop").agg(F.collect_set("c").alias("cs")).where("size(cs) > 1")  # no more than a passage has seeds
    merged = connected_components(same.select(F.explode("cs").alias("src"), F.array_min("cs").alias("dst")))
    return spans.join(merged.withColumnRenamed("node", "c"), "c", "left").select(
        "doc_id", "t", "start", (F.col("stop") - F.col("start")).alias("n"), F.coalesce("component", "c").alias("class_id"))


def substring_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY,
                    min_words: int = MIN_WORDS, min_passage: int = MIN_PASSAGE, recall: float = RECALL) -> DataFrame:
    """A row per copied paragraph: doc_id, kind (line, of one line or of all up to a blank line, or passage), start_word, n_words, class_id, kept, t.

    ``kept`` is true for the first of a class by doc_id and place, all others can be removed; t tells
    texts that share a doc_id apart. Classes have paragraphs of two documents at least. Documents with a null
    doc_id or without words give no row, nor do those that share nothing; rows that share a doc_id are one
    document. A passage may lie inside a copied line, and passages of different classes may overlap. A
    passage has ``min_passage`` words or more in common with the first of its candidates, and shares five-word shingles with it
    as ``similarity`` asks. It ends at most ``CONTEXT`` words beyond its outer seeds. Other columns are left out.
    """
    docs = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    bands, rows = tune(similarity, recall)
    units = _units(docs, bands, rows, min_words, min_passage)
    lines = _paragraphs(docs, units.where("line"), similarity).select(F.lit("line").alias("kind"), "*")
    passages = _passages(docs, units.where("NOT line").drop("bands", "par", "whole", *MASKS), similarity).select(F.lit("passage").alias("kind"), "*")
    both = stage(lines.unionByName(passages).distinct(), "copies")
    first = both.groupBy("kind", "class_id").agg(F.min(F.struct("doc_id", "t", "start")).alias("first"))
    return both.join(first, ["kind", "class_id"]).select(
        "doc_id", "kind", F.col("start").cast("long").alias("start_word"), F.col("n").cast("long").alias("n_words"), "class_id",
        (F.struct("doc_id", "t", "start") == F.col("first")).alias("kept"), "t")


def remove_copies(docs: DataFrame, copies: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the words of the copies that are not kept; other columns, whatever their names,
    and rows stay. Null and empty texts and rows with a null doc_id are left as they are; an empty table
    gives no row."""
    doc, found = free_name(docs.columns, "_doc"), free_name(docs.columns, "_spans")
    spans = copies.where("NOT kept").groupBy(F.col("doc_id").alias(doc)).agg(F.collect_set(F.struct("t", "start_word", "n_words")).alias(found))
    joined = docs.join(spans, F.col(f"`{doc_id}`") == F.col(doc), "left").drop(doc)
    place = joined.columns.index(text)

    def run(batches):
        for batch in batches:
            texts, spans_of = batch.column(place).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
            out = list(texts)
            for row, starts, ends, _ in wordhash.text_words(batch.column(place)):
                if not spans_of[row] or texts[row] is None:
                    continue
                data = texts[row].encode()
                t = _text_key(data)
                keep = np.ones(len(data), bool)
                for s in spans_of[row]:
                    if s["t"] == t:
                        end = s["start_word"] + s["n_words"]
                        keep[starts[s["start_word"]]:starts[end] if end < len(starts) else ends[-1]] = False
                out[row] = np.frombuffer(data, np.uint8)[keep].tobytes().decode()
            columns = [pa.array(out, pa.string()) if k == place else batch.column(k) for k in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-1])

    return joined.mapInArrow(run, docs.schema)


def op1_substring_dedup(docs: DataFrame) -> DataFrame:
    """The copies of ``docs``, a row each. Edge cases as in ``substring_dedup``."""
    return substring_dedup(docs).drop("t")
