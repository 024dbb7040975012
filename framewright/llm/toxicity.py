"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

A lexicon is learned from labelled training rows: words that toxic texts have far
more often than others. Features of a text are densities of its strong and weak
words, their nearness to words that address the reader, capitals, punctuation and
spellings that hide a word. Lexicon and trees are fitted on one part of a bounded sample
of training rows, the calibration on the other; every whole text is scored.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.llm.storage import stage
from framewright.llm.text_expr import whole

SAMPLE_ROWS = 12_000  # labelled rows that the lexicon, the trees and the calibration are fitted on, at most
LEXICON_WORDS = 400  # entries of the learned lexicon, at most
MIN_SUPPORT = 4  # toxic training texts with a word of the lexicon, at least
STRONG_ODDS = 3.0  # log odds of a strong word
WEAK_ODDS = 1.2
NEAR = 5  # words between an address of the reader and a word of the lexicon
TREES = 20
DEPTH = 4
THRESHOLD = 0.3
ADDRESS = frozenset(b"you your yours yourself youre u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos ti usted ustedes tus vosotros".split())
FEATURES = ("strong", "weak", "odds", "strong_count", "distinct", "near", "address", "capitals", "shouted", "exclaimed", "asked", "marks", "symbols",
            "hidden", "hidden_hits", "log_words")

_UPPER = bytes(range(65, 91))
_SPLIT = bytes(32 if (x < 48 or 57 < x < 65 or 90 < x < 97 or 122 < x < 128) else (x + 32 if 65 <= x <= 90 else x) for x in range(256))
_MARKS = b".,;:!?'\"()-"
_SYMBOLS = b"#*$%&|<>@^~=_+/\\"
_HIDDEN = re.compile(rb"[A-Za-z]+(?:[*@$0-9][A-Za-z]*)+|[A-Za-z](?:[.\-_][A-Za-z]){2,}")
_DOTTED = re.compile(rb"\.[A-Za-z]\.")  # in any word that only dots hide
_SHOWN = bytes.maketrans(b"01345@$", b"oieasas")
_SHOUT = re.compile(rb"\b[A-Z]{2,}\b")


def _plain(word: bytes) -> bytes:
    return word.translate(_SHOWN, b"*.-_").lower()


def features(text: str | None, lexicon: dict[bytes, float]) -> list[float]:
    """The features of one whole text, in the order of ``FEATURES``."""
    data = (text or "").encode()
    words = data.translate(_SPLIT).split()
    n = max(len(words), 1)
    size = max(len(data), 1)
    hits = [(k, lexicon[w]) for k, w in enumerate(words) if w in lexicon]
    strong = [k for k, v in hits if v >= STRONG_ODDS]
    address = [k for k, w in enumerate(words) if w in ADDRESS] if hits else []
    near = 0
    if strong and address:
        at = np.array(address)
        k = np.array(strong)
        right = np.searchsorted(at, k)
        gap = np.minimum(np.abs(at[np.minimum(right, len(at) - 1)] - k), np.abs(at[np.maximum(right - 1, 0)] - k))
        near = int((gap <= NEAR).sum())
    upper = len(data) - len(data.translate(None, _UPPER))
    letters = upper + sum(map(len, words))
    odd = len(data) - len(data.translate(None, b"0123456789*@$-_")) or _DOTTED.search(data)
    hidden = _HIDDEN.findall(data) if odd else []
    return [len(strong) / n, (len(hits) - len(strong)) / n, sum(v for _, v in hits) / n, float(min(len(strong), 50)),
            float(len({words[k] for k in strong})), near / n, sum(w in ADDRESS for w in words) / n if not hits else len(address) / n,
            upper / max(letters, 1), len(_SHOUT.findall(data)) / n if upper > 1 else 0.0, data.count(b"!") / size, data.count(b"?") / size,
            (len(data) - len(data.translate(None, _MARKS))) / size, (len(data) - len(data.translate(None, _SYMBOLS))) / size,
            len(hidden) / n, float(sum(_plain(w) in lexicon for w in hidden)), math.log1p(len(words))]


def learn_lexicon(rows: DataFrame, most: int = LEXICON_WORDS) -> dict[bytes, float]:
    """Words and log odds from ``rows(text, label)``: at most ``most`` words reach the driver."""
    def run(batches):
        for batch in batches:
            words, labels = [], []
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words += set((text or "").encode().translate(_SPLIT).split())
                labels += [label] * (len(words) - len(labels))
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(labels, pa.int32())], ["w", "y"])

    total = rows.agg(F.sum("label").alias("p"), F.count("*").alias("n")).first()
    if not total["p"] or total["p"] == total["n"]:
        return {}
    p, n = float(total["p"]), float(total["n"])
    counts = rows.select("text", "label").mapInArrow(run, "w BINARY, y INT").groupBy("w").agg(F.sum("y").alias("a"), F.count("*").alias("m"))
    odds = F.log((F.col("a") + 0.5) / (p - F.col("a") + 0.5)) - F.log((F.col("m") - F.col("a") + 0.5) / (n - p - F.col("m") + F.col("a") + 0.5))
    expected = F.col("m") * (p / n)
    found = counts.withColumn("odds", odds).withColumn("z", (F.col("a") - expected) / F.sqrt(expected)) \
        .where((F.col("a") >= MIN_SUPPORT) & (F.col("odds") >= WEAK_ODDS) & (F.col("z") >= 4)).orderBy(F.desc("z"), "w").limit(most).collect()
    return {bytes(r["w"]): float(r["odds"]) for r in found}


def featured(docs: DataFrame, lexicon: dict[bytes, float]) -> DataFrame:
    """``(doc_id, features...)`` for every whole text of ``docs(doc_id, text)``."""
    def run(batches):
        for batch in batches:
            rows = np.array([features(t, lexicon) for t in batch.column(1).to_pylist()], float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(rows[:, k]) for k in range(len(FEATURES)))], ["doc_id", *FEATURES])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id BIGINT, " + ", ".join(f"{f} DOUBLE" for f in FEATURES))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def score_toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
                   sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``(doc_id, held_out, score, predicted)``, a row per row of ``docs``.

    Labels come from training rows only, those whose crc32 of the id as text is not 2 modulo 4, and of
    these from the ``sample_rows`` with the smallest hashes of the id. Null labels are none; of several
    labels of a document the largest counts. Null and empty texts are scored by their empty features.
    Without two classes to learn from, the score is the share of label 1, 0 without labels. Other columns
    are left out.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.regression import IsotonicRegression

    docs = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), whole(F.col(f"`{text}`")).alias("text"))
    known = labels.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{label}`").cast("int").alias("label")).where("label IS NOT NULL AND doc_id IS NOT NULL")
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("label").alias("label"))
    sample = stage(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows), "labelled")
    train = stage(docs.join(F.broadcast(sample), "doc_id").select("doc_id", "text", "label"), "train-texts")
    fitting = F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(4)) != 0
    lexicon = learn_lexicon(train.where(fitting))
    feats = stage(featured(docs, lexicon), "features")
    rows = stage(featured(train, lexicon).join(sample, "doc_id").repartition(4, "doc_id"), "train")
    out = feats.withColumn("held_out", held_out(F.col("doc_id")))
    totals = rows.agg(F.sum("label").alias("p"), F.count("*").alias("n"), F.sum(F.when(fitting, F.col("label"))).alias("fp"), F.count(F.when(fitting, 1)).alias("fn")).first()
    if not totals["fp"] or totals["fp"] == totals["fn"]:
        out = out.withColumn("score", F.lit(float(totals["p"] or 0) / max(totals["n"], 1)))
    else:
        vector = VectorAssembler(inputCols=list(FEATURES), outputCol="x")
        # Both classes weigh alike while the trees grow; the calibration gives the rates back.
        weight = float(totals["fn"] - totals["fp"]) / float(totals["fp"])
        rows = vector.transform(rows).withColumn("w", F.when(F.col("label") == 1, min(weight, 10.0)).otherwise(1.0)).withColumn("y", F.col("label").cast("double"))
        model = GBTClassifier(featuresCol="x", labelCol="y", weightCol="w", maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, maxBins=32, minInstancesPerNode=4, seed=7).fit(rows.where(fitting))
        raw = vector_to_array("probability")[1]
        rest = model.transform(rows.where(~fitting)).select(raw.alias("raw"), "y")
        calibrated = IsotonicRegression(featuresCol="raw", labelCol="y", predictionCol="iso").fit(rest) if not rest.isEmpty() else None
        out = model.transform(vector.transform(out)).withColumn("raw", raw)
        out = calibrated.transform(out) if calibrated else out.withColumn("iso", F.col("raw"))
        # A hundredth of the raw score keeps the trees' order inside a step of the calibration.
        out = out.withColumn("score", F.least(F.greatest(0.99 * F.col("iso") + 0.01 * F.col("raw"), F.lit(0.0)), F.lit(1.0)))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op2_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every document's score. Edge cases as in ``score_toxicity``; an empty table gives no row."""
    return score_toxicity(docs, labels)
