"""The corpus pipeline: quality rules, line dedup, near duplicates, mixing, packing.

Each stage works on all that its predecessor kept, is written as Parquet and read
again, so an executor lost later costs no earlier stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm import line_dedup, mixing, ngram_join, packing, quality_rules
from framewright.llm.queries import tokenizer_path
from framewright.llm.storage import stage, table
from framewright.llm.text_expr import free_name


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.accepted(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the boilerplate lines of their source; n_chars follows the text."""
    out = line_dedup.line_dedup(docs, "source")
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: that with the smallest doc_id. Documents without a word stay; repeated
    rows stay once.

    Documents link at five-word shingles and a Jaccard similarity of 0.8; op4's values hold for op4 only.
    Rows that share a doc_id are documents of their own, told apart by the digest of their text."""
    digest = F.coalesce(F.md5("text"), F.lit("null"))
    found = ngram_join.components(docs, width=5, percent=80, mark=digest)
    row = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "mark")
    first = found.where("component IS NOT NULL").groupBy("component").agg(F.min(row).alias("first")).select("first.doc_id", "first.mark")
    kept = stage(first.unionByName(found.where("component IS NULL").select("doc_id", "mark")).distinct(), "kept")
    docs = docs.withColumn(name := free_name(docs.columns, "digest"), digest)
    same = docs["doc_id"].eqNullSafe(kept["doc_id"]) & (docs[name] == kept["mark"])
    return docs.join(kept, same, "left_semi").drop(name).dropDuplicates(["doc_id", "text"])


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each source's documents up to its target, as often as they are repeated."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in sequences of at most 1024 tokens, a row per piece."""
    return packing.pack(docs, tokenizer_path())


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("ngram_join", near_duplicates), ("mixing", mixed), ("packing", packed)]

#: Token ids cannot be had in SQL; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), f"stage-{name}")
    return docs
