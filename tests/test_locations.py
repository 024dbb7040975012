"""D4-D15 on hand-written listings (FIXTURES section 2)."""

import pytest
from pyspark.sql import functions as F

from framewright.functions.text import parse_offset
from framewright.operators.locations import LabelRun
from framewright.plans.fixture_corpus import fixture_functions
from framewright.session import cut_lineage
from tests.helpers import files_df, proc


def locate(spark, body_lines, variables, name="f", match="substring"):
    df = files_df(spark, [(1, "", proc(name, body_lines), [(name, variables)])])
    run = LabelRun(df, match=match)
    rows = {r["variable_name"]: (r["assembly_reference"], r["allocation_space_offset"], r["location_kind"])
            for r in run.locations().collect()}
    return run, rows


@pytest.mark.parametrize("raw,expected", [
    ("-4", -4), ("- 4", -4), ("+8", 8), ("8", 8), ("-0ffch", -4092), ("+0ffch", 4092), ("-0fc", None),
    ("-12h", -18), ("+ 10h", 16), ("", None),
])
def test_parse_offset(spark, raw, expected):
    got = spark.createDataFrame([(raw,)], "r string").select(parse_offset(F.col("r")).alias("o")).first()["o"]
    assert got == expected


def test_documented_example(spark):
    _, rows = locate(spark, ["\tpush ebp", "\tmov ebp,esp", "\tadd esp,-12", " ; pp.p1 = &l;",
                             "\tlea eax,[ebp-4]", " ; pp.p2 = &y;", "\tmov [ebp-12],eax"], ["l", "pp"])
    assert rows["l"][:2] == ("ebp-4", -4)
    assert rows["pp"][:2] == ("ebp-4", -4)  # substring rule: 'pp' is named in the first block too


def test_write_beats_earlier_read_in_block(spark):
    _, rows = locate(spark, [" ; v = f(&v);", "\tlea eax,[ebp-99]", "\tmov [ebp-8],eax"], ["v"])
    assert rows["v"] == ("ebp-8", -8, "stack")


def test_earlier_block_wins_even_if_read_only(spark):
    _, rows = locate(spark, [" ; use(&v);", "\tlea eax,[ebp-4]", " ; v = 1;", "\tmov dword ptr [ebp-8],1"], ["v"])
    assert rows["v"][:2] == ("ebp-4", -4)


def test_declaration_comment_ignored(spark):
    _, rows = locate(spark, [" ; int j;", "\tmov dword ptr [ebp-77],0"], ["j"])
    assert rows["j"] == (None, None, "missing")


def test_substring_hit_and_word_mode(spark):
    lines = [" ; idx = 0;", "\tmov dword ptr [ebp-4],0"]
    _, rows = locate(spark, lines, ["i"])
    assert rows["i"][:2] == ("ebp-4", -4)
    _, rows = locate(spark, lines, ["i"], match="word")
    assert rows["i"][2] == "missing"


def test_register_only(spark):
    _, rows = locate(spark, ["?live1@16: ; ESI = &n", "\tmov esi,1"], ["n"])
    assert rows["n"] == ("register esi", None, "register")


def test_last_register_wins(spark):
    _, rows = locate(spark, [" ; EBX = n", "\tmov ebx,1", " ; EDI = n", "\tmov edi,1"], ["n"])
    assert rows["n"][0] == "register edi"


def test_register_pairs_do_not_overlap(spark):
    _, rows = locate(spark, [" ; EAX = EBX = v", "\tnop"], ["v", "EBX"])
    assert rows["EBX"][0] == "register eax"
    assert rows["v"][2] == "missing"


def test_unknown_register(spark):
    _, rows = locate(spark, [" ; XYZ = n", "\tnop"], ["n"])
    assert rows["n"][2] == "missing"


def test_parameter(spark):
    _, rows = locate(spark, [" ; a = 1;", "\tmov [ebp+8],eax"], ["a"])
    assert rows["a"] == ("ebp+8", 8, "stack")


def test_pointer_prefix(spark):
    _, rows = locate(spark, [" ; ptr_x = &y;", "\tmov [ebp-8],eax"], ["ptr_x"])
    assert rows["ptr_x"] == (None, None, "pointer")


def test_stale_value_kept_and_counted(spark):
    df = files_df(spark, [(1, "", proc("f", [" ; q = 1;", "\tmov [ebp-4],1"]),
                           [("f", [("gone", "ebp-4", -4), ("q", None, None), ("ptr_p", "x", 1)])])])
    run = LabelRun(df)
    app = {r["variable_name"]: (r["assembly_reference"], r["allocation_space_offset"]) for r in run.applied().collect()}
    assert app == {"gone": ("ebp-4", -4), "q": ("ebp-4", -4), "ptr_p": (None, None)}
    rep = run.report().first().asDict()
    assert rep == {"stack_allocated": 1, "register_only": 1, "missing": 1}


def test_missing_listing_counts_nowhere(spark):
    df = files_df(spark, [(1, "", proc("g", ["\tnop"]), [("f", ["a"])]), (2, "", "", [("f", ["b"])])])
    run = LabelRun(df)
    assert run.report().first().asDict() == {"stack_allocated": 0, "register_only": 0, "missing": 0}
    upd = run.updated_files(df).orderBy("file_key").collect()
    assert upd[0]["label"]["functions"][0]["variable_mapping"][0]["assembly_reference"] is None


def test_mention_plan_has_no_nested_loop(spark):
    run, _ = locate(spark, [" ; v = 1;", "\tmov [ebp-4],1"], ["v"])
    plan = run.locations()._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_first_proc_occurrence_and_suffix_fallback(spark):
    asm = "\n".join([proc("g", ["\tsub esp,4"]), proc("f", ["\tsub esp,8"]), proc("f", ["\tsub esp,12"]),
                     proc("my_h", ["\tsub esp,16"])])
    df = files_df(spark, [(1, "", asm, [("f", []), ("F", []), ("h", [])])])
    got = {r["function_name"]: r["stack_allocation_size_bytes"] for r in LabelRun(df).function_frames().collect()}
    # first occurrence, case-insensitive name; 'h' only exists as the tail of 'my_h'
    assert got == {"f": 8, "F": 8, "h": 16}


def test_tail_name_header_before_exact_one(spark):
    # the per-name rule has no left boundary: '_my_f proc near' answers to 'f'
    asm = "\n".join([proc("my_f", ["\tsub esp,4"]), proc("f", ["\tsub esp,8"])])
    df = files_df(spark, [(1, "", asm, [("f", []), ("my_f", []), ("y_f", [])])])
    got = {r["function_name"]: r["stack_allocation_size_bytes"] for r in LabelRun(df).function_frames().collect()}
    # '_y_f' does not occur in '_my_f' (no '_' before 'y'): not found
    assert got == {"f": 4, "my_f": 4}


def test_mentions_of_a_hot_procedure_are_the_pairs_themselves(spark):
    lines = [x for k in range(300) for x in (f" ; use_v{k}_ = 1;", f"\tmov dword ptr [ebp-{4 * k + 4}],1")]
    run, rows = locate(spark, lines, [f"v{k}_" for k in range(300)])
    assert run.mentions().count() == 300
    assert all(rows[f"v{k}_"][1] == -4 * k - 4 for k in range(300))


def test_functions_and_procedures_are_joined_once(spark):
    df = files_df(spark, [(1, "", proc("f", [" ; v = 1;", "\tmov [ebp-4],1"]), [("f", ["v"])])])
    run = LabelRun(df, materialize=None)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = run.locations()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("Exchange hashpartitioning") - plan.count("ReusedExchange") <= 4


def test_parameters_suffix_procedures_and_empty_bodies(spark):
    asm = "\n".join([proc("my_f", [" ; p = 1;", "\tmov [ebp+8],1"]), "_e proc near\n_e endp"])
    df = files_df(spark, [(1, "", asm, [("f", ["p"]), ("my_f", ["p", (None, None, None)]), ("e", ["q"]), ("gone", ["p"])])])
    run = LabelRun(df)
    got = {(r["function_name"], r["variable_name"]): (r["assembly_reference"], r["location_kind"]) for r in run.locations().collect()}
    assert got == {("f", "p"): ("ebp+8", "stack"), ("my_f", "p"): ("ebp+8", "stack"), ("my_f", None): (None, "missing"), ("e", "q"): (None, "missing")}
    assert {r["function_name"] for r in run.function_frames().collect()} == {"f", "my_f", "e"}
    assert {r["fn_ord"]: r["fn"]["variable_mapping"][0]["assembly_reference"] for r in run.updated_functions().collect()} == {0: "ebp+8", 1: "ebp+8", 2: None, 3: None}


def test_bodies_keep_the_partitions_asked_for(spark):
    """Adaptive planning may not merge procedures by their compressed size: their lines are many times larger."""
    from framewright.operators.extract import function_bodies
    from tests.helpers import files_df, proc
    files = files_df(spark, [(i, "", proc("f", [" ; int a;", "\tnop"]), [("f", ["a"])]) for i in range(40)])
    _, bodies = function_bodies(files, partitions=13)
    assert bodies.rdd.getNumPartitions() == 13 and bodies.count() == 40
    assert "REPARTITION_BY_NUM" in bodies._jdf.queryExecution().executedPlan().toString()


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_shared_steps_are_written_as_parquet(spark):
    kept = cut_lineage(spark.createDataFrame([("a", [1, 2]), (None, None)], "k string, n array<int>"))
    assert kept.inputFiles() and all(f.endswith(".parquet") for f in kept.inputFiles())
    assert sorted(kept.collect(), key=str) == sorted([("a", [1, 2]), (None, None)], key=str)


def test_register_facts_are_read_in_the_row_of_a_block(spark):
    run, rows = locate(spark, [" ; EBX = n", "\tmov ebx,1", " ; no fact", "\tnop", " ; XYZ = n", "\tnop", " ; EDI = m", "\tnop"], ["n", "m"])
    assert rows == {"n": ("register ebx", None, "register"), "m": ("register edi", None, "register")}
    grouped = next(line for line in plan_of(run.procedures).splitlines() if "Aggregate" in line and "collect_list" in line)
    assert "comment_text" not in grouped


def test_texts_of_a_variable_are_made_in_its_row(spark, tmp_dir):
    spark.createDataFrame([(1, 1, 20), (1, 2, 33), (2, 1, 4), (2, 1, 3), (3, 1, 5)], "l_orderkey long, l_linenumber int, l_partkey long").write.parquet(f"{tmp_dir}/lineitem.parquet")
    spark.createDataFrame([(1, 7), (2, 7), (4, 7)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_dir}/orders.parquet")
    fns = fixture_functions(spark, tmp_dir)
    assert "transform(" not in plan_of(fns)
    got = {r["k"]: r for r in fns.collect()}
    assert sorted(got) == [1, 2] and [v["variable_name"] for v in got[1]["fn_label"]["variable_mapping"]] == ["v1_20", "v2_33"]
    assert got[2]["fn_asm"].split("\n") == [
        "_fn_2\tproc\tnear", " ;\tvoid fn_2() {", "\tpush      ebp", "\tmov       ebp,esp", "\tpush      ecx", " ;\t    int v1_3;", "\tmov       dword ptr [ebp-77],0",
        " ;\t    v1_3 = 7;", "\tmov       dword ptr [ebp-4],7", "\tpop       ebp", "\tret", "?debug L 2", "_fn_2\tendp"]


def test_bodies_alone_make_no_line_table(spark, monkeypatch):
    from framewright.operators import locations
    kept = []
    monkeypatch.setattr(locations, "cut_lineage", lambda df: kept.append(1) or cut_lineage(df))
    run = LabelRun(files_df(spark, [(1, "", proc("f", [" ; x = 1", "\tnop"]), [("f", ["x"])])]))
    assert [r["lname"] for r in run.bodies.collect()] == ["f"] and run.functions.count() == 1 and not kept
    assert run.blocks.count() == 1 and run.found.count() == 1 and len(kept) == 1


def test_blocks_are_made_in_the_row_of_a_body(spark):
    """Lines are neither exploded nor sorted, and the comments of a block are kept once."""
    body = ["\tpush ebx", " ", "\tadd esp,-8", " ; EBX = a", "\tmov [ebp-0fc],1", "\tmov [ebp - 0ch],1", "; int b;", "?live1@2: ; ESI = &b", "\tlea eax,[ebp+4]"]
    run = LabelRun(files_df(spark, [(1, "", proc("f", body), [("f", ["a"])])]), materialize=None)
    plan = run.every._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "collect_list" not in plan and "comment_text" not in run.every.columns
    rows = run.blocks.select("block_id", "write_off", "any_off", "active", "n_comment", "n_code", "stop_line").orderBy("block_id").collect()
    assert [tuple(r) for r in rows] == [(0, None, None, [], 0, 2, None), (1, -12, -12, ["; EBX = a"], 1, 2, None), (2, None, 4, ["?live1@2: ; ESI = &b"], 2, 1, None)]
    assert {(r["var"], r["reg"]) for r in run.registers().collect()} == {("a", "ebx"), ("b", "esi")}
    assert [(r["stack_allocation_instruction"], r["alloc_index"]) for r in run.frames.collect()] == [("add esp,-8", 2)]


def test_new_labels_are_dealt_by_file_once(spark):
    df = files_df(spark, [(1, "", proc("f", ["\tsub esp,4"]), [("f", ["a"]), ("", [])]), (2, "", None, [("g", [])]), (3, "", proc("h", ["\tnop"]), []),
                          (4, "", proc("f", ["\tsub esp,8"]), [("f", [])]), (4, "", proc("g", ["\tsub esp,12"]), [("g", [])])])
    run = LabelRun(df)
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        plan = run.updated_files(df)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("Exchange hashpartitioning") - plan.count("ReusedExchange") <= 2
    got = sorted((r["file_key"], [(f["function_name"], f["stack_allocation_size_bytes"]) for f in r["label"]["functions"]]) for r in run.updated_files(df).collect())
    both = [("f", 8), ("f", 8), ("g", 12), ("g", 12)]  # files that share a key share their functions
    assert got == [("1", [("f", 4), ("", None)]), ("2", [("g", None)]), ("3", []), ("4", both), ("4", both)]
