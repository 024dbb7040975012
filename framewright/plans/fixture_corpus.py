"""Listing corpus derived from the driver tables (orders, lineitem).

Grain: one *variable* per ``(l_orderkey, l_linenumber)`` (``lineitem`` is not
unique on that pair, so it is grouped first), one *function* ``fn_<k>`` per
order, one *file* per customer.  The listing text, C source and label
skeleton are produced with Spark expressions only; their right answers are
known in closed form, which is what the SQL oracles check.

Location kind of a variable is ``partkey % 5``: 0 register, 1 ghost,
2 read, 3 write, 4 read-then-write.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.session import table_path

# --- fixed values: corpus text ---------------------------------------------
TAB = "\t"
SLOT_WIDTH = 10          # mnemonic column width: "push      ebp"
REGISTER_BY_LN_MOD3 = ["EBX", "ESI", "EDI"]
VARIABLE_SIZE_BYTES = 4
STALE_BASE = 1000        # previous-run offsets used by the apply-labels query
ROWS_PER_PARTITION = 100_000  # lineitem rows whose text one task makes


def _op(mnemonic: str) -> str:
    return TAB + mnemonic.ljust(SLOT_WIDTH)


def fixture_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(k, ln, pk, file_no)`` — one row per planted variable."""
    li = spark.read.parquet(table_path(sf_dir, "lineitem"))
    orders = spark.read.parquet(table_path(sf_dir, "orders"))
    v = (li.groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("bigint").alias("ln"))
           .agg(F.min("l_partkey").alias("pk")))
    return v.join(orders.select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("file_no")), "k")


_REG_SQL = "CASE pmod(v.ln, 3) WHEN 0 THEN 'EBX' WHEN 1 THEN 'ESI' ELSE 'EDI' END"


def _function_lines_sql() -> str:
    """SQL text: ``(ord, line)`` structs of the variable ``v`` of a row; line is null where its kind has none."""
    name = "concat('v', v.ln, '_', v.pk)"
    off = "concat('[ebp-', 4 * v.ln, ']')"
    hexv = "lower(hex(4 * v.ln))"
    hex_txt = f"concat(CASE WHEN substr({hexv}, 1, 1) RLIKE '[a-f]' THEN '0' ELSE '' END, {hexv}, 'h')"
    kind = "pmod(v.pk, 5)"
    lines = [
        f"named_struct('ord', -50 + v.ln, 'line', concat(' ;{TAB}    int ', {name}, ';'))",
        # kind 0: register
        f"named_struct('ord', 10 * v.ln, 'line', CASE WHEN {kind} = 0 THEN concat('?live1@', 16 * v.ln, ': ; ', {_REG_SQL}, ' = ', {name}) END)",
        f"named_struct('ord', 10 * v.ln + 1, 'line', CASE WHEN {kind} = 0 THEN concat('{_op('mov')}', lower({_REG_SQL}), ',1') END)",
        # kind 2: read
        f"named_struct('ord', 10 * v.ln, 'line', CASE WHEN {kind} = 2 THEN concat(' ;{TAB}    sink(&', {name}, ');') END)",
        f"named_struct('ord', 10 * v.ln + 1, 'line', CASE WHEN {kind} = 2 THEN concat('{_op('lea')}eax,', {off}) END)",
        f"named_struct('ord', 10 * v.ln + 2, 'line', CASE WHEN {kind} = 2 THEN '{_op('call')}_sink' END)",
        # kind 3: write
        f"named_struct('ord', 10 * v.ln, 'line', CASE WHEN {kind} = 3 THEN concat(' ;{TAB}    ', {name}, ' = 7;') END)",
        f"named_struct('ord', 10 * v.ln + 1, 'line', CASE WHEN {kind} = 3 THEN concat('{_op('mov')}dword ptr ', {off}, ',7') END)",
        # kind 4: read then write
        f"named_struct('ord', 10 * v.ln, 'line', CASE WHEN {kind} = 4 THEN concat(' ;{TAB}    ', {name}, ' = f(&', {name}, ');') END)",
        f"named_struct('ord', 10 * v.ln + 1, 'line', CASE WHEN {kind} = 4 THEN '{_op('lea')}eax,[ebp-99]' END)",
        f"named_struct('ord', 10 * v.ln + 2, 'line', CASE WHEN {kind} = 4 THEN concat('{_op('mov')}[ebp - ', {hex_txt}, '],eax') END)",
    ]
    return "array(" + ", ".join(lines) + ")"


def _fixed_lines_sql() -> str:
    fn = "concat('fn_', k)"
    lines = [
        f"named_struct('ord', -100, 'line', concat('_', {fn}, '{TAB}proc{TAB}near'))",
        f"named_struct('ord', -99, 'line', concat(' ;{TAB}void ', {fn}, '() {{'))",
        f"named_struct('ord', -98, 'line', '{_op('push')}ebp')",
        f"named_struct('ord', -97, 'line', '{_op('mov')}ebp,esp')",
        f"named_struct('ord', -96, 'line', CASE WHEN mx >= 3 AND pmod(k, 7) = 0 THEN '{_op('add')}esp,-0ffch' "
        f"WHEN mx < 3 THEN '{_op('push')}ecx' WHEN pmod(k, 4) = 1 THEN '{TAB}nop' END)",
        f"named_struct('ord', -95, 'line', CASE WHEN mx >= 3 THEN concat("
        f"CASE WHEN pmod(k, 5) = 1 THEN concat('{_op('sub')}esp,', 4 * mx) ELSE concat('{_op('add')}esp,-', 4 * mx) END, "
        f"CASE WHEN pmod(k, 3) = 0 THEN ' ; locals' ELSE '' END) "
        f"WHEN mx = 2 THEN '{_op('push')}ecx' END)",
        f"named_struct('ord', -40, 'line', '{_op('mov')}dword ptr [ebp-77],0')",
        f"named_struct('ord', 9000, 'line', '{_op('pop')}ebp')",
        f"named_struct('ord', 9001, 'line', '{TAB}ret')",
        f"named_struct('ord', 9002, 'line', concat('?debug L ', k))",
        f"named_struct('ord', 9003, 'line', concat('_', {fn}, '{TAB}endp'))",
    ]
    return "array(" + ", ".join(lines) + ")"


def _c_lines_sql() -> str:
    name = "concat('v', v.ln, '_', v.pk)"
    return (f"concat('    int ', {name}, ';\\n', '    if (', {name}, ' > -1) {{\\n', "
            f"'        sink((void*)&', {name}, ');\\n', '    }}')")


def corpus_partitions(spark: SparkSession, sf_dir: str) -> int:
    rows = spark.read.parquet(table_path(sf_dir, "lineitem")).count()
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_PER_PARTITION))


def fixture_functions(spark: SparkSession, sf_dir: str, stale_labels: bool = False) -> DataFrame:
    """One row per function: ``file_key, file_no, k, fn_asm, fn_c, fn_label``.

    Variables are dealt by file while they are numbers: texts are made where their file is, and never shuffled.
    The number of partitions follows the input, since adaptive planning would only see the numbers.  A variable's lines
    are made in its own row, by compiled code; a function only sorts and joins them."""
    v = fixture_variables(spark, sf_dir).withColumn("file_key", F.col("file_no").cast("string")).repartition(corpus_partitions(spark, sf_dir), "file_key")
    if stale_labels:
        ref = f"concat('ebp-', {STALE_BASE} + v.ln)"
        off = f"-({STALE_BASE} + v.ln)"
    else:
        ref, off = "CAST(NULL AS STRING)", "CAST(NULL AS BIGINT)"
    var_struct = (f"named_struct('variable_name', concat('v', v.ln, '_', v.pk), "
                  f"'assembly_reference', {ref}, 'allocation_space_offset', {off}, "
                  f"'size_bytes', CAST({VARIABLE_SIZE_BYTES} AS BIGINT))")
    made = v.alias("v").select("file_key", "file_no", "k", "ln", F.struct(
        "ln", "pk", F.expr(_function_lines_sql()).alias("asm"), F.expr(_c_lines_sql()).alias("c"), F.expr(var_struct).alias("label")).alias("v"))
    fns = made.groupBy("file_key", "file_no", "k").agg(F.max("ln").alias("mx"), F.sort_array(F.collect_list("v")).alias("vs"))
    asm_lines = F.expr(
        f"array_join(sort_array(filter(concat({_fixed_lines_sql()}, flatten(vs.asm)), x -> x.line IS NOT NULL)).line, '\\n')")
    c_text = F.expr("concat('void fn_', k, '() {\\n', array_join(vs.c, '\\n'), '\\n}')")
    # every third function is written without line breaks and indents
    c_text = F.when(F.pmod("k", F.lit(3)) == 1, F.replace(F.replace(c_text, F.lit("\n"), F.lit("")), F.lit("    "), F.lit(""))).otherwise(c_text)
    ptr_struct = (f"named_struct('variable_name', concat('ptr_', k), "
                  f"'assembly_reference', CAST(NULL AS STRING), 'allocation_space_offset', CAST(NULL AS BIGINT), "
                  f"'size_bytes', CAST({VARIABLE_SIZE_BYTES} AS BIGINT))")
    label = F.expr(
        "named_struct('function_name', concat('fn_', k), "
        "'stack_allocation_instruction', CAST(NULL AS STRING), "
        "'stack_allocation_size_bytes', CAST(NULL AS BIGINT), "
        f"'variable_mapping', concat(vs.label, "
        f"CASE WHEN pmod(k, 4) = 0 THEN array({ptr_struct}) ELSE slice(array({ptr_struct}), 1, 0) END))")
    return fns.select("file_key", "file_no", "k", "mx", asm_lines.alias("fn_asm"), c_text.alias("fn_c"), label.alias("fn_label"))


def fixture_files(spark: SparkSession, sf_dir: str, stale_labels: bool = False) -> DataFrame:
    """One row per file: ``file_key, file_no, source_code_c, assembly_code, label``."""
    fns = fixture_functions(spark, sf_dir, stale_labels)
    files = fns.groupBy("file_key", "file_no").agg(
        F.sort_array(F.collect_list(F.struct("k", "fn_asm", "fn_c", "fn_label"))).alias("fs"))
    return files.select(
        "file_key",
        "file_no",
        # a first function calls all others, right after braces, too
        F.concat(F.lit("int main() {"), F.array_join(F.transform("fs", lambda x: F.concat(F.lit("fn_"), x["k"], F.lit("(); if (1) {fn_"), x["k"], F.lit("();}"))), ""),
                 F.lit("}\n"), F.array_join(F.transform("fs", lambda x: x["fn_c"]), "\n")).alias("source_code_c"),
        F.array_join(F.transform("fs", lambda x: x["fn_asm"]), "\n").alias("assembly_code"),
        F.struct(F.transform("fs", lambda x: x["fn_label"]).alias("functions")).alias("label"),
    )


_MEMO: dict = {}


def corpus_files(spark: SparkSession, sf_dir: str, stale_labels: bool = False) -> DataFrame:
    """The fixture files, materialised once per session.

    The corpus is an input table: it is written once with a reliable
    checkpoint (into the session's ``spark.checkpoint.dir``) and every query
    of the session reads that copy instead of rebuilding the text.
    """
    from framewright.session import cut_lineage

    key = (spark.sparkContext.applicationId, sf_dir, stale_labels)
    if key not in _MEMO:
        _MEMO[key] = cut_lineage(fixture_files(spark, sf_dir, stale_labels))
    return _MEMO[key]
