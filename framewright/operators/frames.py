"""Frame allocation of a procedure (D1-D3) and the index of the allocating
instruction (D17).

Computed from the lines of a procedure (``locations.classified_lines``) inside its
row: only its first 40 lines are looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.functions.arrays import bind
from framewright.functions.patterns import (
    ALLOC_LINE,
    ALLOC_WINDOW_LINES,
    PUSH_BYTES,
    PUSH_REG,
    PUSH_STOP,
    PUSH_WINDOW_LINES,
)
from framewright.functions.text import py_strip


def size_value(v: Column) -> Column:
    """Allocation size text -> bytes: ``12`` decimal, ``0ffch`` hexadecimal."""
    v = F.lower(v)
    hex_digits = F.regexp_replace(v, "h$", "")
    return F.when(v.endswith("h"), F.conv(hex_digits, 16, 10).cast("bigint")) \
        .otherwise(F.when(v.rlike("^[0-9]+$"), v.try_cast("bigint")))


def frame_line_columns(raw: Column, line_no: Column) -> dict[str, Column]:
    """Per-line facts for the frame rules (null outside their windows)."""
    # Each regex runs only inside its window and only on lines holding the
    # literal the pattern needs ('esp' for allocations).
    lower = F.lower(raw)
    in_alloc = (line_no < ALLOC_WINDOW_LINES) & lower.contains("esp")
    in_push = line_no < PUSH_WINDOW_LINES
    # bind keeps rare work out of the generated loop, which the JVM compiles only while it is short

    def found(code_part: Column) -> Column:
        inst = F.regexp_extract(code_part, ALLOC_LINE, 1)
        neg = F.regexp_extract(code_part, ALLOC_LINE, 2)
        pos = F.regexp_extract(code_part, ALLOC_LINE, 3)
        return F.when(inst != "", F.struct(inst.alias("inst"), size_value(F.when(neg != "", neg).otherwise(pos)).alias("bytes")))

    alloc = F.when(in_alloc, bind(py_strip(F.element_at(F.split(raw, ";"), 1)), found))
    return {
        "alloc": alloc,
        "push_hit": in_push & lower.contains("push") & raw.rlike(PUSH_REG),
        "push_stop": in_push & (lower.contains("call") | lower.contains("jmp")) & raw.rlike(PUSH_STOP),
    }


def frame_facts(raws: Column, lines: Column) -> Column:
    """Partials of the first 40 lines of a procedure, from its raw lines and the ``locations.classified_lines``: ``allocs``
    (in line order), ``pushes`` and ``stop_line``.  ``code_rank`` is the 1-based position of a line among the code lines."""
    head = F.filter(F.slice(lines, F.lit(1), F.lit(ALLOC_WINDOW_LINES)), lambda x: x["line_no"] < ALLOC_WINDOW_LINES)

    def parts(head: Column) -> Column:
        # the other lines hold none of the literals that the rules need (esp, push, call, jmp); a line is looked through for their first letters
        some = F.filter(F.transform(head, lambda x, j: F.struct(x["line_no"].alias("line_no"), j.alias("j"), x["text"].alias("text"))), lambda x: x["text"].rlike("(?i)[epcj](?:sp|ush|all|mp)"))
        facts = F.transform(some, lambda x: bind(F.get(raws, x["line_no"].cast("int")), lambda raw: F.struct(
            x["line_no"].alias("line_no"), x["j"].alias("j"), *(c.alias(n) for n, c in frame_line_columns(raw, x["line_no"]).items()))))
        rank = lambda f: F.size(F.filter(F.slice(head, F.lit(1), f["j"] + 1), lambda x: ~x["is_comment"])).cast("bigint").alias("code_rank")
        return bind(facts, lambda fs: F.struct(
            F.transform(F.filter(fs, lambda f: f["alloc"].isNotNull()), lambda f: F.struct(
                f["line_no"].alias("line_no"), f["alloc"]["inst"].alias("alloc_inst"), f["alloc"]["bytes"].alias("alloc_bytes"), rank(f))).alias("allocs"),
            F.transform(F.filter(fs, lambda f: f["push_hit"]), lambda f: F.struct(f["line_no"].alias("line_no"), rank(f))).alias("pushes"),
            F.get(F.filter(fs, lambda f: f["push_stop"]), F.lit(0))["line_no"].alias("stop_line")))

    return bind(head, parts)


def frames_from_blocks(blocks: DataFrame, key: str = "file_key") -> DataFrame:
    """D1-D3 + D17 per procedure: ``key, lname, stack_allocation_instruction,
    stack_allocation_size_bytes, alloc_index``.

    ``blocks`` carries per-block partials of the first 40 lines (``allocs``,
    ``pushes``, ``stop_line``; see ``locations.block_facts``); this second
    aggregation keeps the procedure partitioning, so it adds no exchange."""
    return blocks.groupBy(key, "lname").agg(*frame_parts()).select(key, "lname", *frame_columns())


def frame_parts() -> list[Column]:
    """The aggregates over a procedure's blocks that ``frame_columns`` reads."""
    return [F.sort_array(F.flatten(F.collect_list("allocs"))).alias("hits"), F.min("stop_line").alias("stop_line"),
            F.flatten(F.collect_list("pushes")).alias("pushes")]


def frame_columns() -> list[Column]:
    """D1-D3 + D17 from ``frame_parts``."""
    has_explicit = F.size("hits") > 0
    explicit_size = F.aggregate("hits", F.lit(0).cast("bigint"),
                                lambda acc, h: acc + F.coalesce(h["alloc_bytes"], F.lit(0).cast("bigint")))
    stop = F.coalesce(F.col("stop_line"), F.lit(PUSH_WINDOW_LINES))
    pushes = F.filter("pushes", lambda p: p["line_no"] < stop)
    n_push = F.size(pushes)
    text = F.when(has_explicit, F.array_join(F.transform("hits", lambda h: h["alloc_inst"]), " | ")) \
        .when(n_push > 0, F.concat(F.lit("push reg (x"), n_push.cast("string"), F.lit(")")))
    size = F.when(has_explicit, explicit_size).otherwise((n_push * PUSH_BYTES).cast("bigint"))
    idx = F.when(has_explicit, F.col("hits")[0]["code_rank"]) \
        .when(n_push > 0, F.array_min(F.transform(pushes, lambda p: p["code_rank"])))
    return [text.alias("stack_allocation_instruction"), F.when(size > 0, size).cast("bigint").alias("stack_allocation_size_bytes"),
            idx.cast("bigint").alias("alloc_index")]
