"""E1/E2 and C3."""

import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from framewright.operators.extract import _brace_table, c_functions
from framewright.operators.sanitize import sanitize_dataset, strip_debug
from tests.helpers import files_df


#: Lines and what the sanitizer leaves of them; None for a line that goes.
LINES = [("mov eax,1", "mov eax,1"), (" ;c", None), ("?live1@0: ; EBX = x", None), ("?debug L 1", None), ("", None), ("  ", None), ("\t", None),
         ("a ; b", "a"), ("\r", None), ("x\r", "x"), (" ?livex", None), ("push ebp  ", "push ebp"), ("b;", "b"), (";", None), ("q r", "q r"),
         (" y ", " y"), ("  z;;w", "  z"), ("x ?live", "x ?live")]


def test_sanitize_documented_case(spark):
    raw = "; c\n?live1@0: ; EBX = x\n?debug L 1\n\n\tmov eax,1 ; set\n"
    got = spark.createDataFrame([(raw,)], "s string").select(strip_debug(F.col("s"))).first()[0]
    assert got == "\tmov eax,1"


def listing(lines):
    """A listing of lines of known classes, and what is left of it."""
    return "\n".join(x for x, _ in lines), "\n".join(x for _, x in lines if x is not None)


def test_sanitize_random_listings_of_known_lines(spark):
    rnd = random.Random(7)
    cases = [listing([rnd.choice(LINES) for _ in range(rnd.randint(0, 9))]) for _ in range(2000)]
    df = spark.createDataFrame([(k, c) for k, (c, _) in enumerate(cases)], "k int, s string")
    got = [r[0] for r in df.orderBy("k").select(strip_debug(F.col("s"))).collect()]
    assert got == [want for _, want in cases]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.sampled_from(LINES), max_size=8))
def test_sanitize_idempotent(spark, lines):
    raw, want = listing(lines)
    once = spark.createDataFrame([(raw,)], "s string").select(strip_debug(F.col("s")).alias("s"))
    twice = once.select(strip_debug(F.col("s")).alias("t"), "s").first()
    assert twice["t"] == twice["s"] == want


def test_sanitize_dataset_leaves_empty_listing(spark):
    df = files_df(spark, [(1, "", "", []), (2, "", "; x\nmov a,b", [])])
    got = {r["file_key"]: r["assembly_code"] for r in sanitize_dataset(df).collect()}
    assert got == {"1": "", "2": "mov a,b"}


def test_c_cut(spark):
    c = "int g(int a);\nint x;\nint g(int a) { if (a) { } }\nint h() { }"
    df = files_df(spark, [(1, c, "", [("g", []), ("h", []), ("zz", [])])])
    got = {r["function_name"]: r["c_function"] for r in c_functions(df).collect()}
    assert got == {"g": "g(int a) { if (a) { } }", "h": "h() { }", "zz": ""}


def test_c_cut_unmatched_and_braces_in_strings(spark):
    c = 'void f() { puts("}"); }\nvoid u() { {'
    df = files_df(spark, [(1, c, "", [("f", []), ("u", [])])])
    got = {r["function_name"]: r["c_function"] for r in c_functions(df).collect()}
    assert got == {"f": 'f() { puts("}', "u": ""}  # braces inside strings count


def plain_cut(c, name):
    """The rule: from the first signature to the brace at which the depth is back."""
    at = re.search(rf"\b{re.escape(name)}\s*\([^)]*\)\s*\{{", c)
    depth = 0
    for k in range(at.end() - 1, len(c)) if at else ():
        depth += {"{": 1, "}": -1}.get(c[k], 0)
        if not depth:
            return c[at.start():k + 1].strip()
    return ""


def test_c_cut_on_compact_code(spark):
    f = "f(int a) { return a; }"
    for c in ("int g() {f(1); if (x) {y();}}\nint " + f, "int g() { if (x) {f(2);} }\nint " + f, "f(1);\nint " + f, "{f(1)}{f(2);}int " + f):
        assert c_functions(files_df(spark, [(1, c, "", [("f", [])])])).first()["c_function"] == f


def test_c_cut_equals_the_rule_on_random_text(spark):
    rng = random.Random(3)
    pieces = ["f", "g", "(", ")", "{", "}", " ", "\n", "int ", "(a)", "f(a) {", "g(){", "if (x) {", "}", ";", "f(1);", "é", "f(a, g(b) {", "{}"]
    names = ["f", "g", "if", "f("]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    df = files_df(spark, [(i, c, "", [(n, []) for n in names]) for i, c in enumerate(texts)])
    got = {(int(r["file_key"]), r["function_name"]): r["c_function"] for r in c_functions(df).collect()}
    assert got == {(i, n): plain_cut(c, n) for i, c in enumerate(texts) for n in names}


def test_c_cut_of_absent_names_and_open_braces(spark):
    import time
    n = 5000
    closed = "\n".join(f"int f{k}(int a) {{ if (a) {{ return {k}; }} }}" for k in range(n))
    opened = "\n".join(f"int f{k}(int a) {{ if (a) {{ return {k}; }} " for k in range(n))
    for c, found in ((closed, n), (opened, 0)):
        df = files_df(spark, [(1, c, "", [(f"f{k}", []) for k in range(n)] + [(f"z{k}", []) for k in range(n)])])
        began = time.time()
        assert c_functions(df).where("c_function <> ''").count() == found
        assert time.time() - began < 30


def test_c_cut_counts_characters_beyond_the_basic_plane(spark):
    c = "/* \U0001F600\U0001F600 */ int f(int a) { return a; }"
    df = files_df(spark, [(1, c, "", [("f", [])])])
    assert c_functions(df).first()["c_function"] == "f(int a) { return a; }"


def bodies(spark, asm, names):
    from framewright.operators.extract import function_bodies
    df = files_df(spark, [(1, "", asm, [(n, []) for n in names])])
    return {r["lname"]: r["body"] for r in function_bodies(df)[1].collect()}


def test_proc_cut_nested_suffix_and_case(spark):
    nested = "_outer proc near\na\n_f proc near\ninner\n_f endp\nb\n_outer endp\n_f proc near\nlater\n_f endp\n"
    got = bodies(spark, nested, ["f", "outer"])
    assert got == {"f": "\ninner\n", "outer": "\na\n_f proc near\ninner\n_f endp\nb\n"}
    assert bodies(spark, "_my_f proc near\nret\n_my_f endp", ["f", "my_f", "g"]) == {"f": "\nret\n_my", "my_f": "\nret\n"}
    assert bodies(spark, "x_F\tPROC  NEAR\nret\n_f\nEndP", ["F", "x"]) == {"f": "\nret\n"}


def test_cuts_of_files_with_thousands_of_functions(spark):
    import time
    n = 3000
    c = "\n".join(f"int f{k}(int a) {{ if (a) {{ return {k}; }} }}" for k in range(n))
    asm = "\n".join(f"_f{k} proc near\n\tret\n_f{k} endp" for k in range(n))
    df = files_df(spark, [(1, c, asm, [(f"f{k}", []) for k in range(n)])])
    began = time.time()
    assert c_functions(df).where("c_function LIKE 'f%(int a) { if (a) { return %; } }'").count() == n
    assert len(bodies(spark, asm, [f"f{k}" for k in range(n)])) == n
    assert time.time() - began < 60


def test_brace_table_takes_one_running_sum(spark):
    """The depth is the only running sum of a text; a signature whose ``)`` stands in a later piece finds the brace there."""
    texts = {"f({x}) { a } }": "f({x}) { a }", "f({) { } } f(){}": "f({) { }", "f({ } {) {{}}": "f({ } {) {{}}", "f() { } }": "f() { }", "f() {{ }": "", "} f() {}": "f() {}"}
    df = files_df(spark, [(str(i), t, "", [("f", [])]) for i, t in enumerate(texts)])
    cut = c_functions(df)
    assert [r["c_function"] for r in cut.orderBy(F.col("file_key").cast("int")).collect()] == list(texts.values())
    plan = df.select(_brace_table(F.col("source_code_c")).alias("t"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") == 2  # of the chunks and over them
