"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from framewright.llm import (fingerprints, importance, line_dedup, mixing, ngram_join, packing, pii, quality_rules, substring_dedup,
                            token_store, toxicity, vector_codes, warc)
from framewright.llm.storage import table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _documents(function, *more):
    return lambda spark, sf_dir: function(table(spark, sf_dir, "documents"), *(m() for m in more))


QUERIES = {
    "op1_substring_dedup": _documents(substring_dedup.op1_substring_dedup),
    "op2_toxicity": lambda spark, sf_dir: toxicity.op2_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
    "op3_packing": _documents(packing.op3_packing, tokenizer_path),
    "op4_ngram_join": _documents(ngram_join.op4_ngram_join),
    "op5_line_dedup": lambda spark, sf_dir: line_dedup.op5_line_dedup(table(spark, sf_dir, "pages")),
    "op6_warc": lambda spark, sf_dir: warc.op6_warc(table(spark, sf_dir, "pages")),
    "op7_token_store": _documents(token_store.op7_token_store, tokenizer_path),
    "op8_mixing": _documents(mixing.op8_mixing),
    "op9_quality_rules": _documents(quality_rules.op9_quality_rules),
    "op10_fingerprints": _documents(fingerprints.op10_fingerprints),
    "op11_pii": _documents(pii.op11_pii),
    "op12_importance": lambda spark, sf_dir: importance.op12_importance(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")),
    "op13_vector_codes": lambda spark, sf_dir: vector_codes.op13_vector_codes(table(spark, sf_dir, "embeddings")),
}

ORACLES = {
    "op5_line_dedup": line_dedup.OP5_SQL,
    "op8_mixing": mixing.OP8_SQL,
    "op9_quality_rules": quality_rules.OP9_SQL,
    "op12_importance": importance.OP12_SQL,
    "op13_vector_codes": vector_codes.OP13_SQL,
}
