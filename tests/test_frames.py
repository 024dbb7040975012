"""D1-D3, D17 on hand-written listings (FIXTURES section 2)."""

from framewright.operators.locations import LabelRun
from tests.helpers import files_df, proc


def frames(spark, body_lines, name="f"):
    df = files_df(spark, [(1, "", proc(name, body_lines), [(name, [])])])
    r = LabelRun(df).function_frames().collect()
    assert len(r) == 1
    return r[0]["stack_allocation_instruction"], r[0]["stack_allocation_size_bytes"], r[0]["alloc_index"]


def test_documented_example(spark):
    assert frames(spark, ["\tpush ebp", "\tmov ebp,esp", "\tadd esp,-12", "\tlea eax,[ebp-4]"]) == \
        ("add esp,-12", 12, 3)


def test_two_chunk_frame(spark):
    got = frames(spark, ["\tpush ebp", "\tmov ebp,esp", "\tadd esp,-4092", "\tadd esp,-100"])
    assert got[:2] == ("add esp,-4092 | add esp,-100", 4192)


def test_hex_frame(spark):
    assert frames(spark, ["\tpush ebp", "\tsub esp,0ffch"])[:2] == ("sub esp,0ffch", 4092)


def test_push_frame(spark):
    got = frames(spark, ["\tpush      ebp", "\tpush      ecx", "\tpush      ebx", "\tcall      _x", "\tpush      eax"])
    assert got == ("push reg (x2)", 8, 2)


def test_match_after_line_40_ignored(spark):
    lines = ["\tnop"] * 39 + ["\tadd esp,-8"]  # index 40 of the body (line 0 is the proc line rest)
    assert frames(spark, lines)[:2] == (None, None)


def test_match_on_line_39_counted(spark):
    lines = ["\tnop"] * 38 + ["\tadd esp,-8"]
    assert frames(spark, lines)[:2] == ("add esp,-8", 8)


def test_no_frame(spark):
    assert frames(spark, ["\tpush ebp", "\tret"]) == (None, None, None)


def test_comment_cut_before_match(spark):
    assert frames(spark, ["\tmov eax,1 ; add esp,-4", "\tsub esp,8 ; locals"])[:2] == ("sub esp,8", 8)
