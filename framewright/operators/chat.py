"""Chat-example formatting.

One user/assistant message pair per label function: the user turn is the
instruction prompt (registry of names and sizes, the C function, the
procedure listing); the assistant turn is the compact answer JSON.  All
text is built with ``concat`` / ``transform`` / ``to_json``; no UDF.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.functions.patterns import (
    CHATML_END,
    CHATML_START,
    MAX_SEQ_LENGTH,
    PROMPT_TEMPLATE,
)
from framewright.functions.text import json_string_literal
from framewright.operators.extract import function_texts


def variable_registry(variable_mapping: Column) -> Column:
    """G1: ``array<struct<name, size_bytes>>`` — names and sizes only."""
    return F.transform(variable_mapping, lambda v: F.struct(v["variable_name"].alias("name"),
                                                            v["size_bytes"].alias("size_bytes")))


def registry_json(registry: Column) -> Column:
    """G1 text: the registry as JSON with 2-space indentation."""
    item = lambda r: F.concat(
        F.lit('  {\n    "name": '), json_string_literal(r["name"]),
        F.lit(',\n    "size_bytes": '), F.coalesce(r["size_bytes"].cast("string"), F.lit("null")),
        F.lit("\n  }"))
    body = F.array_join(F.transform(registry, item), ",\n")
    return F.when(F.size(registry) == 0, F.lit("[]")) \
        .otherwise(F.concat(F.lit("[\n"), body, F.lit("\n]")))


def render_prompt(registry_text: Column, c_source: Column, asm_source: Column) -> Column:
    """The instruction prompt (template filled in, then stripped)."""
    head, rest = PROMPT_TEMPLATE.split("{registry}")
    mid1, rest = rest.split("{c_source}")
    mid2, tail = rest.split("{asm_source}")
    tail = tail.replace("{{", "{").replace("}}", "}").rstrip()
    return F.concat(F.lit(head.lstrip()), registry_text, F.lit(mid1), c_source, F.lit(mid2), asm_source,
                    F.lit(tail))


def build_target(fn: Column) -> Column:
    """Compact answer JSON of one label function as Python writes it (nulls kept)."""
    number = lambda n: F.coalesce(n.cast("string"), F.lit("null"))
    variables = F.transform(F.coalesce(fn["variable_mapping"], F.expr("array()").cast("array<struct<variable_name:string,assembly_reference:string,allocation_space_offset:bigint,size_bytes:bigint>>")),
                            lambda v: F.concat(F.lit('{"variable_name":'), json_string_literal(v["variable_name"]),
                                               F.lit(',"assembly_reference":'), json_string_literal(v["assembly_reference"]),
                                               F.lit(',"allocation_space_offset":'), number(v["allocation_space_offset"]), F.lit("}")))
    return F.concat(F.lit('{"stack_allocation_instruction":'), json_string_literal(fn["stack_allocation_instruction"]),
                    F.lit(',"stack_allocation_size_bytes":'), number(fn["stack_allocation_size_bytes"]),
                    F.lit(',"variable_mappings":['), F.array_join(variables, ","), F.lit("]}"))


def format_functions(files: DataFrame, key: str = "file_key", labels: DataFrame | None = None) -> DataFrame:
    """G1-G4 before the skip rule: ``key, fn_ord, function_name, c_function,
    asm_function, both_found, prompt, target`` for every label function.

    ``labels``: optional ``key, fn_ord, fn`` with label structs that replace
    the nested ones of ``files`` (e.g. ``LabelRun.updated_functions()``), so
    a fresh labelling need not be nested back into file records first.  Both
    texts of a function are cut inside its file's row, so the labels are the only
    join; functions of files without a listing stay, with an empty listing part."""
    # The skip rule is read where the texts are cut: a count of it joins no texts.
    j = function_texts(files, key).withColumn("both_found", _both_parts_found())
    if labels is not None:
        j = j.drop("fn").join(labels.select(key, "fn_ord", "fn"), [key, "fn_ord"])
    reg = registry_json(variable_registry(F.col("fn.variable_mapping")))
    return j.select(key, "fn_ord", "function_name", "c_function", "asm_function", "both_found",
                    render_prompt(reg, F.col("c_function"), F.col("asm_function")).alias("prompt"),
                    build_target(F.col("fn")).alias("target"))


def _both_parts_found() -> Column:
    """Skip rule as one predicate over both parts."""
    return F.least(F.length("c_function"), F.length("asm_function")) > 0


def chat_examples(files: DataFrame, key: str = "file_key", labels: DataFrame | None = None) -> DataFrame:
    """One ``messages`` row per function whose C and listing parts
    were both found."""
    f = format_functions(files, key, labels)
    return f.filter("both_found").select(
        key, "fn_ord", "function_name", "prompt", "target",
        F.array(F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content")),
                F.struct(F.lit("assistant").alias("role"), F.col("target").alias("content"))).alias("messages"))


def format_report(files: DataFrame, key: str = "file_key", labels: DataFrame | None = None) -> DataFrame:
    """Formatted / skipped counts."""
    f = format_functions(files, key, labels)
    ok = F.col("both_found")
    return f.agg(F.count_if(ok).cast("bigint").alias("formatted"),
                 F.count_if(~ok).cast("bigint").alias("skipped"))


def conversation_rows(turns: DataFrame, conv: str = "conv_id", turn: str = "turn",
                      role: str = "role", text: str = "text") -> DataFrame:
    """G6 on a turn table: prompt = every non-assistant message in turn
    order, ground truth = first assistant message; rows lacking either drop.

    ``idx, messages, ground_truth``."""
    is_asst = F.col(role) == "assistant"
    g = turns.groupBy(conv).agg(
        F.array_sort(F.collect_list(F.when(~is_asst, F.struct(F.col(turn).alias("t"), F.col(role).alias("role"),
                                                               F.col(text).alias("content"))))).alias("_m"),
        F.min_by(F.col(text), F.when(is_asst, F.col(turn))).alias("ground_truth"),
        F.count_if(is_asst).alias("_n_asst"))
    g = g.filter((F.size("_m") > 0) & (F.col("_n_asst") > 0))
    return g.select(F.col(conv).alias("idx"),
                    F.transform("_m", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
                    .alias("messages"), "ground_truth")


def conversation_rows_from_messages(examples: DataFrame, idx: str = "idx", messages: str = "messages") -> DataFrame:
    """G6 on nested ``messages`` arrays (e.g. the output of ``chat_examples``)."""
    m = F.col(messages)
    prompt = F.filter(m, lambda x: x["role"] != "assistant")
    answers = F.filter(m, lambda x: x["role"] == "assistant")
    return examples.select(F.col(idx).alias("idx"), prompt.alias("messages"),
                           F.try_element_at(answers, F.lit(1))["content"].alias("ground_truth")) \
        .filter((F.size("messages") > 0) & F.col("ground_truth").isNotNull())


def render_chatml(messages: Column, add_generation_prompt: bool = True, default_system: str | None = None) -> Column:
    """ChatML text of a message list (public ``<|im_start|>`` markers).

    ``default_system``: text of a system turn added when the list does not
    start with one (some chat templates do this); none by default."""
    turn = lambda m: F.concat(F.lit(CHATML_START), m["role"], F.lit("\n"), m["content"],
                              F.lit(CHATML_END + "\n"))
    text = F.array_join(F.transform(messages, turn), "")
    if default_system is not None:
        sys_turn = F.lit(f"{CHATML_START}system\n{default_system}{CHATML_END}\n")
        text = F.when(F.try_element_at(messages, F.lit(1))["role"] == "system", text).otherwise(F.concat(sys_turn, text))
    if add_generation_prompt:
        text = F.concat(text, F.lit(f"{CHATML_START}assistant\n"))
    return text


def length_profile(examples: DataFrame, length: Column, order_by: list[str],
                   n: int | None = None) -> DataFrame:
    """Mean and max length over all examples, or the first ``n`` of them (dataset order).

    ``length`` is any column expression: ``functions.tokens.token_length`` for tokens, ``F.length``
    for characters."""
    first = examples.select(*order_by, length.alias("_len"))
    if n is not None:
        first = first.orderBy(*order_by).limit(n)
    return first.agg(F.avg("_len").alias("mean_length"), F.max("_len").cast("bigint").alias("max_length"),
                     F.count(F.lit(1)).cast("bigint").alias("n_examples"))


def over_budget(examples: DataFrame, length: Column, budget: int = MAX_SEQ_LENGTH) -> DataFrame:
    """How many examples exceed the sequence budget, in the unit of ``length``."""
    return examples.agg(F.count_if(length > budget).cast("bigint").alias("over_budget"),
                        F.count(F.lit(1)).cast("bigint").alias("n_examples"),
                        F.max(length).cast("bigint").alias("max_length"))
