"""Oracle SQL (DuckDB dialect) for the query catalog.

Listing-corpus oracles are closed form: they compute the right answer from
``lineitem`` / ``orders`` directly, never by parsing the generated text.
"""

# Shared CTEs over the driver tables: planted variables and functions.
CORPUS_CTE = """
v AS (
  SELECT l_orderkey AS k, CAST(l_linenumber AS BIGINT) AS ln, min(l_partkey) AS pk
  FROM lineitem GROUP BY 1, 2
),
vf AS (
  SELECT v.*, o.o_custkey AS file_no, CAST(o.o_custkey AS VARCHAR) AS file_key,
         max(v.ln) OVER (PARTITION BY v.k) AS mx,
         CAST(row_number() OVER (PARTITION BY v.k ORDER BY v.ln) - 1 AS BIGINT) AS var_ord,
         'v' || v.ln || '_' || v.pk AS variable_name,
         v.pk % 5 AS kind
  FROM v JOIN orders o ON o.o_orderkey = v.k
),
f AS (
  SELECT k, file_no, file_key, max(ln) AS mx, count(*) AS nv,
         count(*) FILTER (WHERE kind <> 1) AS n_live
  FROM vf GROUP BY 1, 2, 3
),
ff AS (
  SELECT f.*, 'fn_' || k AS function_name,
         CAST(row_number() OVER (PARTITION BY file_no ORDER BY k) - 1 AS BIGINT) AS fn_ord,
         CASE WHEN mx >= 3 THEN
                (CASE WHEN k % 7 = 0 THEN 'add       esp,-0ffch | ' ELSE '' END) ||
                (CASE WHEN k % 5 = 1 THEN 'sub       esp,' || (4 * mx) ELSE 'add       esp,-' || (4 * mx) END)
              ELSE 'push reg (x' || mx || ')' END AS alloc_text,
         CAST(4 * mx + CASE WHEN mx >= 3 AND k % 7 = 0 THEN 4092 ELSE 0 END AS BIGINT) AS alloc_size
  FROM f
),
loc AS (
  SELECT file_key, k, ln, var_ord, variable_name, kind,
         CASE kind WHEN 0 THEN 'register ' || CASE ln % 3 WHEN 0 THEN 'ebx' WHEN 1 THEN 'esi' ELSE 'edi' END
                   WHEN 1 THEN NULL ELSE 'ebp-' || (4 * ln) END AS assembly_reference,
         CASE WHEN kind IN (2, 3, 4) THEN CAST(-4 * ln AS BIGINT) END AS allocation_space_offset,
         CASE kind WHEN 0 THEN 'register' WHEN 1 THEN 'missing' ELSE 'stack' END AS location_kind
  FROM vf
  UNION ALL
  SELECT file_key, k, NULL, CAST(nv AS BIGINT), 'ptr_' || k, -1, NULL, NULL, 'pointer'
  FROM f WHERE k % 4 = 0
)
"""


def corpus(sql: str) -> str:
    return "WITH " + CORPUS_CTE + sql


ORACLES: dict[str, str] = {}

ORACLES["explode_functions"] = corpus("""
SELECT file_key, fn_ord, function_name, CAST(nv + CASE WHEN k % 4 = 0 THEN 1 ELSE 0 END AS BIGINT) AS n_variables FROM ff
""")

ORACLES["alloc_explicit"] = corpus("""
SELECT file_key, function_name, alloc_text AS stack_allocation_instruction, alloc_size AS stack_allocation_size_bytes
FROM ff WHERE mx >= 3
""")

ORACLES["alloc_push_fallback"] = corpus("""
SELECT file_key, function_name, alloc_text AS stack_allocation_instruction, alloc_size AS stack_allocation_size_bytes
FROM ff WHERE mx < 3
""")

ORACLES["parse_offset"] = """
WITH t AS (SELECT l_orderkey, l_linenumber, CAST(l_linenumber AS BIGINT) * l_partkey AS n,
             CASE WHEN l_partkey % 2 = 0 THEN '-' ELSE '+' END AS sign, l_orderkey % 4 AS kind FROM lineitem)
SELECT l_orderkey, l_linenumber,
  CASE kind WHEN 0 THEN sign || n WHEN 1 THEN sign || ' ' || n WHEN 2 THEN sign || '0' || printf('%x', n) || 'h' ELSE sign || printf('%x', n) || 'g' END AS raw,
  CAST(CASE WHEN kind = 3 THEN NULL WHEN sign = '-' THEN -n ELSE n END AS BIGINT) AS parsed
FROM t
"""

ORACLES["stack_allocation"] = corpus("""
SELECT file_key, function_name, alloc_text AS stack_allocation_instruction,
       alloc_size AS stack_allocation_size_bytes
FROM ff
""")

ORACLES["alloc_index"] = corpus("""
SELECT file_key, function_name, CAST(CASE WHEN mx >= 3 AND k % 7 <> 0 AND k % 4 = 1 THEN 4 ELSE 3 END AS BIGINT) AS alloc_index FROM ff
""")

ORACLES["variable_locations"] = corpus("""
SELECT file_key, 'fn_' || k AS function_name, variable_name, assembly_reference,
       allocation_space_offset, location_kind
FROM loc
""")

ORACLES["pointer_rule"] = corpus("""
SELECT file_key, 'fn_' || k AS function_name, variable_name, assembly_reference,
       allocation_space_offset, location_kind
FROM loc WHERE location_kind = 'pointer'
""")

ORACLES["label_report"] = corpus("""
SELECT CAST(count(*) FILTER (WHERE location_kind = 'stack') AS BIGINT) AS stack_allocated,
       CAST(count(*) FILTER (WHERE location_kind IN ('register', 'pointer')) AS BIGINT) AS register_only,
       CAST(count(*) FILTER (WHERE location_kind = 'missing') AS BIGINT) AS missing
FROM loc
""")

ORACLES["region_offset"] = corpus("""
SELECT loc.file_key, 'fn_' || loc.k AS function_name, variable_name, allocation_space_offset,
       ff.alloc_size + allocation_space_offset AS region_offset
FROM loc JOIN ff ON ff.k = loc.k WHERE location_kind = 'stack'
""")

ORACLES["apply_labels"] = corpus("""
SELECT file_key, 'fn_' || k AS function_name, variable_name,
       CASE WHEN location_kind = 'missing' THEN 'ebp-' || (1000 + ln) ELSE assembly_reference END AS assembly_reference,
       CASE WHEN location_kind = 'missing' THEN CAST(-(1000 + ln) AS BIGINT) ELSE allocation_space_offset END
         AS allocation_space_offset,
       location_kind <> 'missing' AS found
FROM loc
""")

ORACLES["updated_labels"] = corpus("""
SELECT ff.file_key, ff.fn_ord, ff.function_name, alloc_text AS stack_allocation_instruction, alloc_size AS stack_allocation_size_bytes,
       string_agg(concat_ws('|', variable_name,
         coalesce(CASE WHEN location_kind = 'missing' THEN 'ebp-' || (1000 + ln) ELSE assembly_reference END, 'null'),
         coalesce(CAST(CASE WHEN location_kind = 'missing' THEN -(1000 + ln) ELSE allocation_space_offset END AS VARCHAR), 'null'), '4'), ';' ORDER BY var_ord) AS variables
FROM ff JOIN loc ON loc.k = ff.k GROUP BY ALL
""")

ORACLES["liveness_registers"] = corpus("""
SELECT file_key, 'fn_' || k AS function_name, variable_name,
       CASE ln % 3 WHEN 0 THEN 'ebx' WHEN 1 THEN 'esi' ELSE 'edi' END AS reg
FROM loc WHERE kind = 0
""")

ORACLES["resolve_offsets"] = corpus("""
SELECT file_key, 'fn_' || k AS function_name, variable_name, allocation_space_offset AS offset
FROM loc WHERE kind IN (2, 3, 4)
""")


# --- text of the corpus, rebuilt in DuckDB from the same rule ---------------
# (the oracle never parses text: it re-creates each line with its ord and
# knows from the rule which lines a stage keeps)

def _op(m: str) -> str:
    return "chr(9) || '" + m.ljust(10) + "'"


LINES_CTE = f"""
fl AS (
  SELECT k, -100 AS ord, '_fn_' || k || chr(9) || 'proc' || chr(9) || 'near' AS line, 'code' AS cls FROM f
  UNION ALL SELECT k, -99, ' ;' || chr(9) || 'void fn_' || k || '() {{', 'comment' FROM f
  UNION ALL SELECT k, -98, {_op('push')} || 'ebp', 'code' FROM f
  UNION ALL SELECT k, -97, {_op('mov')} || 'ebp,esp', 'code' FROM f
  UNION ALL SELECT k, -96, CASE WHEN mx >= 3 AND k % 7 = 0 THEN {_op('add')} || 'esp,-0ffch'
                                WHEN mx < 3 THEN {_op('push')} || 'ecx' WHEN k % 4 = 1 THEN chr(9) || 'nop' END, 'code' FROM f
  UNION ALL SELECT k, -95, CASE WHEN mx >= 3 THEN
        (CASE WHEN k % 5 = 1 THEN {_op('sub')} || 'esp,' || (4 * mx) ELSE {_op('add')} || 'esp,-' || (4 * mx) END)
        || CASE WHEN k % 3 = 0 THEN ' ; locals' ELSE '' END
      WHEN mx = 2 THEN {_op('push')} || 'ecx' END, 'code' FROM f
  UNION ALL SELECT k, -40, {_op('mov')} || 'dword ptr [ebp-77],0', 'code' FROM f
  UNION ALL SELECT k, 9000, {_op('pop')} || 'ebp', 'code' FROM f
  UNION ALL SELECT k, 9001, chr(9) || 'ret', 'code' FROM f
  UNION ALL SELECT k, 9002, '?debug L ' || k, 'debug' FROM f
  UNION ALL SELECT k, 9003, '_fn_' || k || chr(9) || 'endp', 'code' FROM f
  UNION ALL SELECT k, -50 + ln, ' ;' || chr(9) || '    int ' || variable_name || ';', 'comment' FROM vf
  UNION ALL SELECT k, 10 * ln, '?live1@' || (16 * ln) || ': ; '
        || CASE ln % 3 WHEN 0 THEN 'EBX' WHEN 1 THEN 'ESI' ELSE 'EDI' END || ' = ' || variable_name, 'live'
      FROM vf WHERE kind = 0
  UNION ALL SELECT k, 10 * ln + 1, {_op('mov')} || CASE ln % 3 WHEN 0 THEN 'ebx' WHEN 1 THEN 'esi' ELSE 'edi' END || ',1',
      'code' FROM vf WHERE kind = 0
  UNION ALL SELECT k, 10 * ln, ' ;' || chr(9) || '    sink(&' || variable_name || ');', 'comment' FROM vf WHERE kind = 2
  UNION ALL SELECT k, 10 * ln + 1, {_op('lea')} || 'eax,[ebp-' || (4 * ln) || ']', 'code' FROM vf WHERE kind = 2
  UNION ALL SELECT k, 10 * ln + 2, {_op('call')} || '_sink', 'code' FROM vf WHERE kind = 2
  UNION ALL SELECT k, 10 * ln, ' ;' || chr(9) || '    ' || variable_name || ' = 7;', 'comment' FROM vf WHERE kind = 3
  UNION ALL SELECT k, 10 * ln + 1, {_op('mov')} || 'dword ptr [ebp-' || (4 * ln) || '],7', 'code' FROM vf WHERE kind = 3
  UNION ALL SELECT k, 10 * ln, ' ;' || chr(9) || '    ' || variable_name || ' = f(&' || variable_name || ');', 'comment'
      FROM vf WHERE kind = 4
  UNION ALL SELECT k, 10 * ln + 1, {_op('lea')} || 'eax,[ebp-99]', 'code' FROM vf WHERE kind = 4
  UNION ALL SELECT k, 10 * ln + 2, {_op('mov')} || '[ebp - '
        || CASE WHEN substr(lower(hex(4 * ln)), 1, 1) BETWEEN 'a' AND 'f' THEN '0' ELSE '' END
        || lower(hex(4 * ln)) || 'h],eax', 'code' FROM vf WHERE kind = 4
),
lines AS (
  SELECT fl.k, ord, line, cls, f.file_key, f.file_no FROM fl JOIN f USING (k) WHERE line IS NOT NULL
),
clean AS (  -- E1 applied line by line: comment/live/debug lines dropped, inline comment cut
  SELECT k, ord, file_key, file_no, rtrim(split_part(line, ';', 1), ' ' || chr(9)) AS line
  FROM lines WHERE cls = 'code'
),
regs AS (
  SELECT k, '[' || chr(10) || string_agg('  {{' || chr(10) || '    "name": "' || variable_name || '",' || chr(10)
         || '    "size_bytes": 4' || chr(10) || '  }}', ',' || chr(10) ORDER BY var_ord) || chr(10) || ']' AS registry
  FROM (SELECT k, var_ord, variable_name FROM vf UNION ALL SELECT k, nv, 'ptr_' || k FROM f WHERE k % 4 = 0)
  GROUP BY k
),
cfn0 AS (
  SELECT k, 'fn_' || k || '() {{' || chr(10) || string_agg('    int ' || variable_name || ';' || chr(10)
         || '    if (' || variable_name || ' > -1) {{' || chr(10) || '        sink((void*)&' || variable_name || ');'
         || chr(10) || '    }}', chr(10) ORDER BY ln) || chr(10) || '}}' AS c_function
  FROM vf GROUP BY k
),
cfn AS (
  SELECT k, CASE WHEN k % 3 = 1 THEN replace(replace(c_function, chr(10), ''), '    ', '') ELSE c_function END AS c_function FROM cfn0
),
afn AS (
  SELECT k, substr(string_agg(line, chr(10) ORDER BY ord), 2) AS asm_function
  FROM clean WHERE ord BETWEEN -99 AND 9002 GROUP BY k
),
tgt AS (
  SELECT ff.k, '{{"stack_allocation_instruction":"' || ff.alloc_text || '","stack_allocation_size_bytes":'
         || ff.alloc_size || ',"variable_mappings":[' || string_agg('{{"variable_name":"' || loc.variable_name
         || '","assembly_reference":' || coalesce('"' || loc.assembly_reference || '"', 'null')
         || ',"allocation_space_offset":' || coalesce(CAST(loc.allocation_space_offset AS VARCHAR), 'null') || '}}',
         ',' ORDER BY loc.var_ord) || ']}}' AS target,
         '{{"stack_allocation_instruction":"' || ff.alloc_text || '","stack_allocation_size_bytes":'
         || (ff.alloc_size + 1) || ',"variable_mappings":[' || string_agg('{{"variable_name":"' || loc.variable_name
         || '","assembly_reference":' || coalesce('"' || loc.assembly_reference || '"', 'null')
         || ',"allocation_space_offset":' || coalesce(CAST(loc.allocation_space_offset AS VARCHAR), 'null') || '}}',
         ',' ORDER BY loc.var_ord) || ']}}' AS target_plus,
         '{{ "variable_mappings" : [ ' || string_agg('{{ "allocation_space_offset" : '
         || coalesce(CAST(loc.allocation_space_offset AS VARCHAR), 'null') || ', "assembly_reference" : '
         || coalesce('"' || loc.assembly_reference || '"', 'null') || ', "variable_name" : "' || loc.variable_name
         || '" }}', ', ' ORDER BY loc.var_ord) || ' ], "stack_allocation_size_bytes" : ' || ff.alloc_size
         || ', "stack_allocation_instruction" : "' || ff.alloc_text || '" }}' AS reordered,
         ff.alloc_size
  FROM ff JOIN loc ON loc.k = ff.k GROUP BY ff.k, ff.alloc_text, ff.alloc_size
)
"""


def text_corpus(sql: str) -> str:
    return "WITH " + CORPUS_CTE + "," + LINES_CTE + sql


def _sql_lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def prompt_sql(registry: str, c_source: str, asm_source: str) -> str:
    from framewright.functions.patterns import PROMPT_TEMPLATE
    head, rest = PROMPT_TEMPLATE.split("{registry}")
    mid1, rest = rest.split("{c_source}")
    mid2, tail = rest.split("{asm_source}")
    tail = tail.replace("{{", "{").replace("}}", "}").rstrip()
    return (f"({_sql_lit(head)} || {registry} || {_sql_lit(mid1)} || {c_source} || {_sql_lit(mid2)} || "
            f"{asm_source} || {_sql_lit(tail)})")


ORACLES["strip_debug"] = text_corpus("""
SELECT file_key, md5(string_agg(line, chr(10) ORDER BY k, ord)) AS sanitized_md5,
       CAST(count(*) AS BIGINT) AS sanitized_lines
FROM clean GROUP BY file_key
""")

ORACLES["sanitize_dataset"] = ORACLES["strip_debug"]

ORACLES["listing_lines"] = text_corpus("""
SELECT file_key, 'fn_' || k AS function_name,
       CAST(count(*) FILTER (WHERE ord BETWEEN -99 AND 9002) + 2 AS BIGINT) AS n_lines,
       CAST(count(*) FILTER (WHERE ord BETWEEN -99 AND 9002 AND cls IN ('code', 'debug')) AS BIGINT) AS n_code_lines
FROM lines GROUP BY file_key, k
""")

ORACLES["extract_proc"] = text_corpus("""
SELECT file_key, 'fn_' || k AS function_name,
       md5(chr(10) || string_agg(line, chr(10) ORDER BY ord) || chr(10)) AS body_md5
FROM lines WHERE ord BETWEEN -99 AND 9002 GROUP BY file_key, k
""")

ORACLES["extract_c_function"] = text_corpus("""
SELECT f.file_key, 'fn_' || f.k AS function_name, md5(c_function) AS c_md5, CAST(length(c_function) AS BIGINT) AS c_chars
FROM f JOIN cfn USING (k)
""")

ORACLES["segment_blocks"] = corpus("""
SELECT file_key, function_name, CAST(2 + n_live AS BIGINT) AS n_blocks,
       CAST(1 + nv + n_live AS BIGINT) AS n_comment_lines
FROM ff
""")

ORACLES["active_comments"] = corpus("""
SELECT file_key, function_name, CAST(1 + n_live AS BIGINT) AS n_active_comments FROM ff
""")

ORACLES["var_block_mentions"] = corpus("""
SELECT file_key, 'fn_' || k AS function_name, variable_name,
       CAST(1 + row_number() OVER (PARTITION BY k ORDER BY ln) AS BIGINT) AS block_id
FROM vf WHERE kind <> 1
""")

ORACLES["block_write_offset"] = corpus("""
SELECT file_key, function_name, CAST(1 AS BIGINT) AS block_id, CAST(-77 AS BIGINT) AS write_offset FROM ff
UNION ALL
SELECT file_key, 'fn_' || k, CAST(bid AS BIGINT), CAST(-4 * ln AS BIGINT)
FROM (SELECT *, 1 + row_number() OVER (PARTITION BY k ORDER BY ln) AS bid FROM vf WHERE kind <> 1)
WHERE kind IN (3, 4)
""")

ORACLES["block_any_offset"] = corpus("""
SELECT file_key, function_name, CAST(1 AS BIGINT) AS block_id, CAST(-77 AS BIGINT) AS any_offset FROM ff
UNION ALL
SELECT file_key, 'fn_' || k, CAST(bid AS BIGINT),
       CASE kind WHEN 4 THEN CAST(-99 AS BIGINT) ELSE CAST(-4 * ln AS BIGINT) END
FROM (SELECT *, 1 + row_number() OVER (PARTITION BY k ORDER BY ln) AS bid FROM vf WHERE kind <> 1)
WHERE kind IN (2, 3, 4)
""")

ORACLES["build_target"] = text_corpus("""
SELECT f.file_key, 'fn_' || f.k AS function_name, tgt.target FROM f JOIN tgt USING (k)
""")

ORACLES["render_prompt"] = text_corpus(f"""
SELECT file_key, function_name, md5(prompt) AS prompt_md5, CAST(length(prompt) AS BIGINT) AS prompt_chars
FROM (SELECT f.file_key, 'fn_' || f.k AS function_name,
             {prompt_sql('regs.registry', 'cfn.c_function', 'afn.asm_function')} AS prompt
      FROM f JOIN regs USING (k) JOIN cfn USING (k) JOIN afn USING (k))
""")

ORACLES["chat_examples"] = text_corpus(f"""
SELECT file_key, function_name, md5(prompt) AS prompt_md5, target
FROM (SELECT f.file_key, 'fn_' || f.k AS function_name, tgt.target,
             {prompt_sql('regs.registry', 'cfn.c_function', 'afn.asm_function')} AS prompt
      FROM f JOIN regs USING (k) JOIN cfn USING (k) JOIN afn USING (k) JOIN tgt USING (k))
""")

ORACLES["format_report"] = corpus("""
SELECT CAST(count(*) AS BIGINT) AS formatted, CAST(0 AS BIGINT) AS skipped FROM ff
""")

ORACLES["variable_registry"] = corpus("""
SELECT file_key, 'fn_' || k AS function_name,
       string_agg(variable_name, ',' ORDER BY var_ord) AS registry_names,
       CAST(4 * count(*) AS BIGINT) AS registry_bytes
FROM (SELECT file_key, k, var_ord, variable_name FROM vf
      UNION ALL SELECT file_key, k, nv, 'ptr_' || k FROM f WHERE k % 4 = 0)
GROUP BY file_key, k
""")


# --- scoring: expected outcome per planted class (FIXTURES 3.4) --------------
# class: tuned valid, tuned match, fenced valid, fenced match
_CLASS_TABLE = """
cls(c, tv, tm, fv, fm) AS (VALUES
  (0, true, true, true, true), (1, true, true, true, true), (2, true, true, true, true),
  (3, true, true, false, false), (4, false, false, false, false), (5, true, false, true, false),
  (6, true, true, false, false), (7, false, false, false, false), (8, false, false, false, false))
"""

_EVAL = corpus("," + _CLASS_TABLE + """
SELECT k AS sample_idx, tv, tm, fv, fm FROM f JOIN cls ON cls.c = f.k % 9
""")

ORACLES["json_valid"] = f"SELECT sample_idx, tv AS json_parse_success FROM ({_EVAL})"
ORACLES["exact_match"] = f"SELECT sample_idx, tm AS exact_match_success FROM ({_EVAL})"
ORACLES["eval_results"] = f"SELECT sample_idx, tv AS json_parse_success, tm AS exact_match_success FROM ({_EVAL})"
ORACLES["eval_results_fenced"] = f"SELECT sample_idx, fv AS json_parse_success, fm AS exact_match_success FROM ({_EVAL})"
ORACLES["eval_metrics"] = f"""
SELECT CAST(count(*) AS BIGINT) AS total_samples,
       coalesce(100.0 * count(*) FILTER (WHERE tv) / nullif(count(*), 0), 0.0) AS json_parse_rate_pct,
       coalesce(100.0 * count(*) FILTER (WHERE tm) / nullif(count(*), 0), 0.0) AS exact_match_accuracy_pct
FROM ({_EVAL})
"""
ORACLES["eval_metrics_fenced"] = f"""
SELECT CAST(count(*) AS BIGINT) AS total_samples,
       coalesce(100.0 * count(*) FILTER (WHERE fv) / nullif(count(*), 0), 0.0) AS json_parse_rate_pct,
       coalesce(100.0 * count(*) FILTER (WHERE fm) / nullif(count(*), 0), 0.0) AS exact_match_accuracy_pct
FROM ({_EVAL})
"""

# Extracted block text per class, from the rebuilt target texts.
_BLOCKS = text_corpus("""
SELECT f.k AS sample_idx, f.k % 9 AS c, tgt.target AS t, tgt.target_plus AS tp, tgt.reordered AS tr
FROM f JOIN tgt USING (k)
""")
ORACLES["json_block"] = f"""
SELECT sample_idx, md5(CASE c WHEN 2 THEN tr WHEN 4 THEN left(t, length(t) - 2) WHEN 5 THEN tp
                              WHEN 7 THEN 'no json' WHEN 8 THEN '' ELSE t END) AS block_md5
FROM ({_BLOCKS})
"""
ORACLES["json_block_fenced"] = f"""
SELECT sample_idx, md5(CASE c WHEN 2 THEN tr WHEN 3 THEN t || ' }} trailing }}' WHEN 4 THEN left(t, length(t) - 2)
                              WHEN 5 THEN tp WHEN 6 THEN '' WHEN 7 THEN 'no json' WHEN 8 THEN '' ELSE t END) AS block_md5
FROM ({_BLOCKS})
"""


# --- F / H on documents --------------------------------------------------------
ORACLES["split_train_val"] = """
SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5('42|' || doc_id), doc_id)
                         <= ceil(0.2 * count(*) OVER ()) THEN 'val' ELSE 'train' END AS split
FROM documents
"""
ORACLES["slice_sample"] = """
SELECT doc_id FROM (
  SELECT doc_id, row_number() OVER (ORDER BY md5('42|' || doc_id), doc_id) AS r, count(*) OVER () AS n
  FROM documents) WHERE r <= floor(0.5 * n)
"""
ORACLES["sample_limit"] = "SELECT doc_id, n_chars FROM documents ORDER BY doc_id LIMIT 100"
ORACLES["split_report"] = f"""
SELECT split, CAST(count(*) AS BIGINT) AS n_rows FROM ({ORACLES['split_train_val']}) GROUP BY split
"""
_POS = """
SELECT doc_id AS idx, n_chars AS length, CAST(row_number() OVER (ORDER BY n_chars, doc_id) AS BIGINT) AS sort_pos
FROM documents
"""
ORACLES["length_sort"] = _POS
ORACLES["length_batches"] = f"SELECT idx, CAST(floor((sort_pos - 1) / 8) AS BIGINT) AS batch_no FROM ({_POS})"
ORACLES["padding_waste"] = f"""
SELECT CAST(floor((sort_pos - 1) / 8) AS BIGINT) AS batch_no, CAST(count(*) AS BIGINT) AS n_rows,
       CAST(max(length) AS BIGINT) AS max_length, CAST(sum(length) AS BIGINT) AS real_length,
       CAST(count(*) * max(length) AS BIGINT) AS padded_length
FROM ({_POS}) GROUP BY 1
"""
ORACLES["predict_batches"] = ORACLES["eval_results"]

# --- G6-G9 on conversations ----------------------------------------------------
_CONV = """
SELECT conv_id AS idx,
       count(*) FILTER (WHERE role <> 'assistant') AS n_prompt,
       arg_min(text, turn) FILTER (WHERE role = 'assistant') AS ground_truth,
       string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn)
         FILTER (WHERE role <> 'assistant') || '<|im_start|>assistant' || chr(10) AS chatml
FROM conversations GROUP BY conv_id
HAVING count(*) FILTER (WHERE role <> 'assistant') > 0 AND count(*) FILTER (WHERE role = 'assistant') > 0
"""
ORACLES["conversation_eval_rows"] = f"""
SELECT idx, CAST(n_prompt AS BIGINT) AS n_prompt_messages, md5(ground_truth) AS ground_truth_md5 FROM ({_CONV})
"""
ORACLES["render_chatml"] = f"""
SELECT idx, md5(chatml) AS prompt_md5, CAST(length(chatml) AS BIGINT) AS prompt_chars FROM ({_CONV})
"""
ORACLES["length_profile"] = f"""
SELECT avg(l) AS mean_length, CAST(max(l) AS BIGINT) AS max_length, CAST(count(*) AS BIGINT) AS n_examples
FROM (SELECT length(chatml) AS l FROM ({_CONV}))
"""
ORACLES["over_budget"] = f"""
SELECT CAST(count(*) FILTER (WHERE length(chatml) > 4096) AS BIGINT) AS over_budget,
       CAST(count(*) AS BIGINT) AS n_examples, CAST(max(length(chatml)) AS BIGINT) AS max_length
FROM ({_CONV})
"""


# --- B: pairing / stitching ------------------------------------------------------
ORACLES["pair_files"] = """
SELECT 'prog_' || doc_id AS file_id, md5(text) AS c_md5, md5(text || chr(10) || '; asm') AS asm_md5
FROM documents WHERE doc_id % 5 <> 0 AND doc_id % 7 <> 0
"""
ORACLES["stitch_listing"] = """
SELECT doc_id AS file_no, doc_id % 7 <> 0 AS stitched,
       md5(CASE WHEN doc_id % 7 <> 0 THEN text || chr(10) || '; asm' ELSE '' END) AS asm_md5
FROM documents
"""
ORACLES["stitch_report"] = """
SELECT CAST(count(*) FILTER (WHERE doc_id % 7 <> 0) AS BIGINT) AS stitched,
       CAST(count(*) FILTER (WHERE doc_id % 7 = 0) AS BIGINT) AS missing, CAST(0 AS BIGINT) AS no_id
FROM documents
"""

# --- J: run metrics ----------------------------------------------------------------
_STEPS = """
SELECT event_id AS step, value AS elapsed_s, user_id * 10 + 1 AS real_tokens, (user_id % 40) / 2.0 AS peak_gb,
       row_number() OVER (ORDER BY event_id) <= 5 AS warm
FROM events
"""
ORACLES["throughput_report"] = f"""
SELECT avg(elapsed_s) FILTER (WHERE NOT warm) AS avg_step_s, min(elapsed_s) FILTER (WHERE NOT warm) AS min_step_s,
       max(elapsed_s) FILTER (WHERE NOT warm) AS max_step_s,
       sum(real_tokens) FILTER (WHERE NOT warm) / sum(elapsed_s) FILTER (WHERE NOT warm) AS avg_tokens_per_s,
       min(real_tokens / elapsed_s) FILTER (WHERE NOT warm) AS min_tokens_per_s,
       max(real_tokens / elapsed_s) FILTER (WHERE NOT warm) AS max_tokens_per_s,
       CAST(count(*) FILTER (WHERE NOT warm) AS BIGINT) AS measured_steps, max(peak_gb) AS peak_gb
FROM ({_STEPS})
"""
ORACLES["epoch_estimate"] = f"""
SELECT CAST(826 AS BIGINT) AS steps_per_epoch, CAST(13211 * 1828 AS BIGINT) AS tokens_per_epoch,
       (13211 * 1828)::DOUBLE / avg_tokens_per_s AS epoch_seconds,
       (13211 * 1828)::DOUBLE / avg_tokens_per_s / 60.0 AS epoch_minutes
FROM ({ORACLES['throughput_report']})
"""
ORACLES["loss_curve"] = """
SELECT 'train' AS series, event_id AS step, value FROM events WHERE event_type = 'click'
UNION ALL
SELECT 'eval', event_id, value FROM events WHERE event_type = 'view'
"""
ORACLES["latest_checkpoint"] = """
WITH u AS (SELECT user_id, bool_or(event_type = 'purchase') AS has_state FROM events GROUP BY user_id),
best AS (SELECT arg_max(user_id, user_id) AS uid, arg_max(has_state, user_id) AS hs FROM u),
root AS (SELECT bool_or(event_type = 'error') AS r FROM events)
SELECT CASE WHEN hs THEN 'checkpoint-' || uid || '/trainer_state.json' WHEN r THEN 'trainer_state.json' END AS state_path,
       'checkpoint-' || uid AS latest_folder
FROM best, root
"""


# --- K: generator draws recomputed in DuckDB ----------------------------------------

def _u(*parts: str) -> str:
    key = "concat_ws('|', '42', " + ", ".join(parts) + ")"
    return f"((CAST('0x' || substr(md5({key}), 1, 8) AS BIGINT) % 1000000) / 1000000.0)"


def _randint(a: int, b: int, *parts: str) -> str:
    return f"CAST({a} + floor({_u(*parts)} * {b - a + 1}) AS BIGINT)"


def _choice(values: list[str], *parts: str) -> str:
    arr = "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"
    return f"{arr}[CAST(floor({_u(*parts)} * {len(values)}) AS BIGINT) + 1]"


def _gen_sql():
    from framewright.operators import synth as K
    fns = f"""
gf AS (
  SELECT p, CAST(f AS BIGINT) AS f FROM (
    SELECT o_orderkey AS p, unnest(range(CAST({_randint(1, 10, 'o_orderkey', "'nf'")} AS BIGINT))) AS f FROM orders)
),
gfn AS (
  SELECT p, f, {_u('p', 'f', "'micro'")} < 0.15 AS is_micro,
         CASE WHEN {_u('p', 'f', "'ret'")} < 0.6 THEN {_choice(K.RET_TYPES, 'p', 'f', "'rt'")} ELSE 'void' END AS ret_type
  FROM gf
),
gfun AS (
  SELECT p, f, is_micro, ret_type,
         CASE WHEN is_micro THEN {_randint(0, 1, 'p', 'f', "'np'")} ELSE {_randint(0, 4, 'p', 'f', "'np'")} END AS n_params,
         CASE WHEN is_micro THEN {_randint(1, 2, 'p', 'f', "'nv'")} ELSE {_randint(6, 15, 'p', 'f', "'nv'")} END AS n_locals,
         CASE WHEN is_micro THEN CAST(1 AS BIGINT) ELSE {_randint(1, 4, 'p', 'f', "'rounds'")} END AS n_rounds
  FROM gfn
),
gpar AS (
  SELECT p, f, ord, {_choice(K.PARAM_TYPES, 'p', 'f', "'pt'", 'ord')} AS v_type,
         {_choice(K.REALISTIC_PARAM_NAMES, 'p', 'f', "'pn'", 'ord')} || '_' || f || '_' || {_randint(0, 9, 'p', 'f', "'pd'", 'ord')}
           AS raw_name
  FROM (SELECT p, f, CAST(unnest(range(n_params)) AS BIGINT) AS ord FROM gfun)
),
gv0 AS (
  SELECT g.p, g.f, g.is_micro, CAST(unnest(range(g.n_locals)) AS BIGINT) AS ord FROM gfun g
),
gloc AS (
  SELECT p, f, ord,
         CASE WHEN is_micro THEN {_choice(K.C_TYPES, 'p', 'f', "'vt'", 'ord')} ELSE {_choice(K.ALL_TYPES, 'p', 'f', "'vt'", 'ord')} END
           AS v_type,
         (NOT is_micro) AND {_u('p', 'f', "'arr'", 'ord')} < 0.35 AS is_array,
         {_u('p', 'f', "'ghost'", 'ord')} > 0.8 AS is_ghost,
         {_name_sql('var_', "'v'")} AS raw_name
  FROM gv0
),
gptr AS (
  SELECT p, f, ord AS target_ord, {_name_sql('p', "'ptr'")} AS raw_name
  FROM gloc WHERE NOT is_array AND NOT is_ghost AND {_u('p', 'f', "'alias'", 'ord')} < 0.4
),
gall AS (
  SELECT p, f, 0 AS kind, ord, raw_name, false AS is_ghost FROM gpar
  UNION ALL SELECT p, f, 1, ord, raw_name, is_ghost FROM gloc
  UNION ALL SELECT p, f, 2, target_ord, raw_name, false FROM gptr
),
gnames AS (
  SELECT p, f, kind, ord, is_ghost,
         CASE WHEN rn = 1 THEN raw_name ELSE raw_name || '_' || (rn - 1) END AS name
  FROM (SELECT *, row_number() OVER (PARTITION BY p, f, raw_name ORDER BY kind, ord) AS rn FROM gall)
)
"""
    return fns


def _name_sql(prefix: str, tag: str) -> str:
    from framewright.operators import synth as K
    h = f"md5(concat_ws('|', '42', p, f, {tag}, ord, 'name'))"
    sl = [f"CAST('0x' || substr({h}, {1 + 8 * i}, 8) AS BIGINT)" for i in range(4)]
    arr = "[" + ", ".join("'" + v + "'" for v in K.REALISTIC_VAR_NAMES) + "]"
    realistic = f"{arr}[{sl[1]} % {len(K.REALISTIC_VAR_NAMES)} + 1] || ({sl[2]} % 100)"
    letters = " || ".join(f"chr(CAST(97 + floor({sl[3]} / {26 ** i}) % 26 AS INTEGER))" for i in range(4))
    return f"CASE WHEN ({sl[0]} % 1000000) / 1000000.0 < 0.6 THEN {realistic} ELSE '{prefix}' || {letters} END"


GEN = "WITH " + _gen_sql()
ORACLES["gen_functions"] = GEN + "SELECT * FROM gfun"
ORACLES["gen_params"] = GEN + "SELECT p, f, ord, v_type, raw_name FROM gpar"
ORACLES["gen_locals"] = GEN + f"""
SELECT p, f, ord, v_type, is_array,
       CASE WHEN is_array THEN {_randint(8, 256, 'p', 'f', "'asz'", 'ord')} ELSE CAST(0 AS BIGINT) END AS array_size,
       is_ghost, raw_name FROM gloc
"""
ORACLES["gen_pointers"] = GEN + "SELECT p, f, target_ord, raw_name FROM gptr"
ORACLES["gen_names"] = GEN + "SELECT p, f, CAST(kind AS BIGINT) AS kind, ord, name FROM gnames"
ORACLES["gen_labels"] = GEN + """
SELECT p, f, string_agg(name, ',' ORDER BY kind, ord) AS names, CAST(count(*) AS BIGINT) AS n_variables
FROM gnames WHERE kind = 0 OR NOT is_ghost GROUP BY p, f
"""


def _declared_sql() -> str:
    """Locals and parameters with their final names, types, access texts and scalar types."""
    from framewright.operators import synth as K
    case = lambda part: "CASE l.v_type " + " ".join(f"WHEN '{t}' THEN '{ff[part]}'" for t, ff in K.STRUCT_FIRST_FIELD.items()) + " END"
    return f"""
, gd AS (
  SELECT p, f, ord, name, v_type, is_array, is_ghost, array_size, scalar_type, name || CASE WHEN is_array THEN '[0]' ELSE '' END || coalesce('.' || field, '') AS access
  FROM (SELECT l.p, l.f, l.ord, n.name, l.v_type, l.is_array, l.is_ghost, {_randint(K.MIN_ARRAY, K.MAX_ARRAY, 'l.p', 'l.f', "'asz'", 'l.ord')} AS array_size,
               {case(0)} AS field, coalesce({case(1)}, l.v_type) AS scalar_type
        FROM gloc l JOIN gnames n ON n.p = l.p AND n.f = l.f AND n.kind = 1 AND n.ord = l.ord)
),
gp AS (SELECT a.p, a.f, a.ord, n.name, a.v_type FROM gpar a JOIN gnames n ON n.p = a.p AND n.f = a.f AND n.kind = 0 AND n.ord = a.ord)
"""


def _value_sql(t: str, x: str) -> str:
    cents = f"CAST(floor((0.5::DOUBLE + {x} * 999.0::DOUBLE) * 100.0::DOUBLE) AS BIGINT)"
    return (f"CASE WHEN {t} IN ('float', 'double') THEN ({cents} // 100) || '.' || lpad(CAST({cents} % 100 AS VARCHAR), 2, '0') "
            f"WHEN {t} = 'char' THEN chr(39) || chr(CAST(65 + floor({x} * 26) AS INTEGER)) || chr(39) ELSE CAST(CAST(floor({x} * 1001) AS BIGINT) AS VARCHAR) END")


def _lines_sql(rows: str) -> str:
    """Lines ``(p, f, part, ord, line)`` of every function as their number and the digest of their text."""
    return f"""
SELECT g.p, g.f, count(line)::BIGINT AS n_lines, md5(coalesce(string_agg(line, chr(10) ORDER BY part, ord), '')) AS lines_md5
FROM gfun g LEFT JOIN ({rows}) x ON x.p = g.p AND x.f = g.f GROUP BY g.p, g.f
"""


_INTS = "('int', 'short', 'long', 'char')"
ORACLES["gen_declarations"] = GEN + _declared_sql() + _lines_sql(f"""
SELECT p, f, 1 AS part, ord, '    ' || v_type || ' ' || name || '[' || array_size || '];' AS line FROM gd WHERE is_array
UNION ALL SELECT p, f, 2, min(ord), '    ' || CASE WHEN any_value({_u('p', 'f', "'vol'", 'v_type')}) > 0.8 THEN 'volatile ' ELSE '' END || v_type || ' '
  || string_agg(name, ', ' ORDER BY ord) || ';' FROM gd WHERE NOT is_array GROUP BY p, f, v_type
UNION ALL SELECT gd.p, gd.f, 3, gd.ord, '    ' || gd.v_type || '* ' || n.name || ' = &' || gd.name || ';'
  FROM gd JOIN gnames n ON n.p = gd.p AND n.f = gd.f AND n.kind = 2 AND n.ord = gd.ord
""")
ORACLES["gen_inits"] = GEN + _declared_sql() + _lines_sql(f"""
SELECT p, f, 1 AS part, ord, '    ' || access || ' = ' || {_value_sql('scalar_type', _u('p', 'f', "'init'", 'ord'))} || ';' AS line FROM gd
UNION ALL SELECT p, f, 2, ord, '    ' || name || CASE WHEN is_array THEN '[0]' ELSE '' END || ' = (' || v_type || ')'
    || fits[CAST(floor({_u('p', 'f', "'cp'", 'ord')} * len(fits)) AS BIGINT) + 1] || ';'
  FROM (SELECT d.p, d.f, d.ord, d.name, d.is_array, d.v_type, list(q.name ORDER BY q.ord) AS fits
        FROM gd d JOIN gfun g ON g.p = d.p AND g.f = d.f AND NOT g.is_micro JOIN gp q ON q.p = d.p AND q.f = d.f
          AND (q.v_type = d.v_type OR (q.v_type IN {_INTS} AND d.v_type IN {_INTS}))
        WHERE NOT d.is_ghost AND d.v_type NOT LIKE 'struct %' AND {_u('d.p', 'd.f', "'copy'", 'd.ord')} < 0.3 GROUP BY ALL)
""")


ORACLES["dataset_roundtrip"] = text_corpus("""
SELECT a.file_key, n_functions, n_variables, asm_md5, c_md5
FROM (SELECT file_key, md5(string_agg(line, chr(10) ORDER BY k, ord)) AS asm_md5 FROM lines GROUP BY file_key) a
JOIN (SELECT f.file_key, CAST(count(*) AS BIGINT) AS n_functions,
             CAST(sum(f.nv + CASE WHEN f.k % 4 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_variables,
             md5('int main() {' || string_agg('fn_' || f.k || '(); if (1) {fn_' || f.k || '();}', '' ORDER BY f.k) || '}' || chr(10)
                 || string_agg('void ' || cfn.c_function, chr(10) ORDER BY f.k)) AS c_md5
      FROM f JOIN cfn USING (k) GROUP BY f.file_key) c USING (file_key)
""")
