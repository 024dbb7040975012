"""Function and line extraction (flatten labels, cut procedures, cut C
functions, number listing lines).

A listing is split once at its procedure headers and ends, whatever number of
functions it holds.  The rule of a name has no left boundary, so ``_my_f proc near``
also answers to ``f``, and ``_my_f endp`` also ends it: headers and ends are
written out under the name after each ``_``, in text order.  A name's body runs from
its first header to the first end after it, also across other procedures.  C
files are split once at signatures and braces, and all braces of a file are
matched in one pass (``_brace_table``).  Only names that are no plain word (which
no such split can find) take a pattern of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.functions.arrays import bind, running_sum
from framewright.functions.patterns import C_BRACE_END, C_SIGNATURE_START, C_SIGNATURE_TEMPLATE, PROC_HEADER, PROC_MARKER, PROC_SPLIT
from framewright.functions.text import py_strip, quote_regex


def explode_functions(files: DataFrame, key: str = "file_key") -> DataFrame:
    """One row per label function: ``key, fn_ord, function_name, fn``.

    Functions with a null/empty name are dropped (the reference skips them).
    """
    out = files.select(key, F.posexplode(F.col("label.functions")).alias("fn_ord", "fn"))
    out = out.select(key, F.col("fn_ord").cast("bigint").alias("fn_ord"),
                     F.col("fn.function_name").alias("function_name"), "fn")
    return out.filter(F.col("function_name").isNotNull() & (F.col("function_name") != ""))


def explode_variables(functions: DataFrame, key: str = "file_key") -> DataFrame:
    """One row per variable of each function (``var_ord`` keeps list order)."""
    extra = [c for c in ("lname",) if c in functions.columns]
    out = functions.select(key, "fn_ord", "function_name", *extra,
                           F.posexplode(F.col("fn.variable_mapping")).alias("var_ord", "v"))
    return out.select(key, "fn_ord", "function_name", *extra, F.col("var_ord").cast("bigint").alias("var_ord"),
                      F.col("v.variable_name").alias("variable_name"),
                      F.col("v.size_bytes").alias("size_bytes"),
                      F.col("v.assembly_reference").alias("old_assembly_reference"),
                      F.col("v.allocation_space_offset").alias("old_allocation_space_offset"))


def _tails(ident: Column) -> Column:
    """Every name that a header or end of this identifier answers to: what
    follows each ``_`` (``_a_b`` -> ``a_b``, ``b``)."""
    parts = F.split(ident, "_")
    return F.filter(F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))),
                                lambda j: F.array_join(F.slice(parts, j, F.size(parts)), "_")),
                    lambda t: t != "")


def _marker(piece: Column) -> Column:
    """Identifier that a piece begins with; "" for text before the first marker."""
    return F.regexp_extract(piece, PROC_MARKER, 1)


def _marked(files: DataFrame, keep: list[str], asm: str) -> DataFrame:
    """``_pieces`` of each listing, and in text order ``_names`` (``h`` or ``e`` before the name that
    a header or end answers to) with ``_places``, the pieces they begin."""
    out = files.select(*keep, F.split(F.col(asm), PROC_SPLIT).alias("_pieces"))
    kind = lambda p: F.when(p.rlike(PROC_HEADER), F.lit("h")).otherwise(F.lit("e"))
    out = out.withColumn("_marks", F.flatten(F.transform("_pieces", lambda p, i: F.transform(
        _tails(F.lower(_marker(p))), lambda t: F.struct(F.concat(kind(p), t).alias("name"), i.alias("place"))))))
    return out.withColumn("_names", F.transform("_marks", lambda m: m["name"])) \
        .withColumn("_places", F.transform("_marks", lambda m: m["place"])).drop("_marks")


def _body(name: Column) -> Column:
    """Body of one (lower-case) name from the columns of ``_marked``; null when it has none."""
    first = F.array_position("_names", F.concat(F.lit("h"), name)).cast("int")
    # array(...) binds a value once where an expression uses it several times
    return F.get(F.flatten(F.transform(F.array(first), lambda h: F.transform(
        F.array(F.when(h > 0, F.array_position(F.slice(F.col("_names"), h + 1, F.size("_names")), F.concat(F.lit("e"), name)).cast("int"))),
        lambda n: F.when(n > 0, _between(F.get("_places", h - 1), F.get("_places", h + n - 1), name))))), F.lit(0))


def _between(a: Column, b: Column, name: Column) -> Column:
    end = _marker(F.get("_pieces", b))
    return F.concat(F.regexp_replace(F.get("_pieces", a), PROC_HEADER, ""),
                    F.array_join(F.slice(F.col("_pieces"), a + 2, b - a - 1), ""),
                    F.substring(end, F.lit(1), F.length(end) - F.length(name) - 1))


def proc_pattern(name: Column) -> Column:
    """Per-name procedure pattern (the original rule), name taken literally."""
    q = quote_regex(name)
    return F.concat(F.lit("(?isU)_"), q, F.lit(r"\s+proc\s+near(.*?)_"), q, F.lit(r"\s+endp"))


def _odd(name: Column) -> Column:
    return name.rlike(r"(?U)\W")


def split_procs(files: DataFrame, key: str = "file_key", asm: str = "assembly_code") -> DataFrame:
    """C2 (scan): every procedure of every listing under each name it answers to: ``key, lname, body``."""
    src = files.filter(F.col(asm).isNotNull() & (F.col(asm) != ""))
    names = F.array_distinct(F.transform(F.filter("_names", lambda n: n.startswith("h")), lambda n: F.substr(n, F.lit(2))))
    out = _marked(src, [key], asm).withColumn("_wanted", names)
    out = out.select(key, F.explode(F.transform("_wanted", lambda n: F.struct(n.alias("lname"), _body(n).alias("body")))).alias("p"))
    return out.select(key, "p.lname", "p.body").filter(F.col("body").isNotNull())


def function_bodies(files: DataFrame, key: str = "file_key", asm: str = "assembly_code", partitions: int | None = None):
    """Procedure bodies for the label functions.

    Returns ``(functions, bodies)``:

    * ``functions``: ``key, fn_ord, function_name, lname, fn`` for files with
      a listing;
    * ``bodies``: ``key, lname, body`` — one row per referenced procedure,
      hash-partitioned on ``(key, lname)`` so the per-procedure work that
      follows (lines, blocks, facts) needs no further exchange.

    Raw body as the labeler uses it (line 0 is the rest of the ``proc near``
    line).  Empty bodies count as not found.
    """
    src = files.filter(F.col(asm).isNotNull() & (F.col(asm) != ""))
    names = F.array_distinct(F.filter(F.transform("label.functions", lambda f: f["function_name"]), lambda n: n.isNotNull() & (n != "")))
    wanted = src.withColumn("_wanted", names)
    wanted = _marked(wanted, [key, asm, "_wanted"], asm)
    body = lambda n: F.when(_odd(n), _odd_body(F.col(asm), n)).otherwise(_body(F.lower(n)))
    found = wanted.select(key, F.explode_outer(F.transform("_wanted", lambda n: F.struct(F.lower(n).alias("lname"), body(n).alias("body")))).alias("p"))
    bodies = found.select(key, "p.lname", "p.body").filter(F.col("body") != "")
    if partitions:
        # Adaptive planning would merge these by their compressed size, many times less than that of the lines made of them.
        bodies = bodies.repartition(partitions, key, "lname")
    bodies = bodies.dropDuplicates([key, "lname"])

    functions = explode_functions(src, key).withColumn("lname", F.lower("function_name"))
    return functions, bodies


def _odd_body(asm: Column, name: Column) -> Column:
    """Body of a name that is no plain word, by its own pattern."""
    return F.nullif(F.call_function("regexp_extract", asm, proc_pattern(name), F.lit(1)), F.lit(""))


def listing_lines(bodies: DataFrame, key: str = "file_key") -> DataFrame:
    """C4: ``key, lname, line_no, line`` (0-based, raw text)."""
    return bodies.select(key, "lname", F.posexplode(F.split("body", "\n")).alias("line_no", "line")) \
        .withColumn("line_no", F.col("line_no").cast("bigint"))


def c_signature_pattern(name: Column) -> Column:
    head, tail = C_SIGNATURE_TEMPLATE.split("{name}")
    return F.concat(F.lit(head), quote_regex(name), F.lit(tail.replace("{{", "{")))


_PAIR = 1 << 32


def _brace_table(text: Column) -> Column:
    """``tokens, groups`` of a C text: its pieces, and for each signature its name, its first piece
    and the piece that ends with the partner of its brace (null when there is none).  Signatures are
    grouped by a hash of their names, in text order, so that a look-up reads few of them.

    The text is split where signatures begin, so only true signatures head a piece, then after each
    brace. One running sum gives the depth after each piece. A brace that raises the depth to d and
    the one that lowers it from d alternate at every d, so braces sorted by (d, place) stand beside
    their partners. No function is scanned on its own.
    """
    # A character before the text: then a signature heads every piece but the first.
    pieces = F.split(F.concat(F.lit("\n"), text), C_SIGNATURE_START)
    tokens = F.flatten(F.transform(pieces, lambda p, i: F.transform(F.split(p, C_BRACE_END), lambda t, j: F.struct(
        t.alias("t"), ((i > 0) & (j == 0)).alias("sig"),
        F.when(t.endswith("{"), 1).when(t.endswith("}"), -1).otherwise(0).alias("step")))))

    # Places and depths are sorted as one number each, the first of two in its upper 32 bits: numbers are sorted faster than structs.
    upper, lower = (lambda k: F.shiftright(k, 32)), (lambda k: k.bitwiseAND(F.lit(_PAIR - 1)))
    some = lambda xs: F.filter(xs, lambda x: x.isNotNull())

    def events(toks: Column, depth: Column) -> Column:
        """Braces by depth and place; an opening one has an odd number."""
        at = lambda t, i: (F.get(depth, i) + F.when(t["step"] < 0, 1).otherwise(0)) * F.lit(_PAIR) + i * F.lit(2).cast("bigint") + F.when(t["step"] > 0, 1).otherwise(0)
        return F.sort_array(some(F.transform(toks, lambda t, i: F.when(t["step"] != 0, at(t, i)))))

    def partners(toks: Column, sorted_events: Column) -> Column:
        """Of each piece that ends with an opening brace, the piece that ends with the closing one; null for all other pieces."""
        place = lambda e: F.shiftright(lower(e), 1)
        found = lambda e, n: place(e) * F.lit(_PAIR) + F.coalesce(F.when(upper(n) == upper(e), place(n) + 1), F.lit(0).cast("bigint"))
        pairs = F.transform(sorted_events, lambda e, i: F.when(e.bitwiseAND(F.lit(1).cast("bigint")) == 1, bind(F.get(sorted_events, i + 1), lambda n: found(e, n))))
        rest = F.transform(toks, lambda t, i: F.when(t["step"] <= 0, i * F.lit(_PAIR)))
        return F.transform(F.sort_array(F.concat(some(pairs), some(rest))), lambda k: F.when(lower(k) > 0, (lower(k) - 1).cast("int")))

    def signatures(toks: Column, to: Column) -> Column:
        # A signature's brace ends the first piece from its own on that has a ")", nearly always its own.
        later = lambda i: F.get(some(F.transform(toks, lambda t, j: F.when((j > i) & t["t"].contains(")"), j))), F.lit(0))
        brace = lambda t, i: F.when(t["t"].contains(")"), i).otherwise(later(i))
        return some(F.transform(toks, lambda t, i: F.when(t["sig"], F.struct(
            F.regexp_extract(t["t"], r"(?U)^\w+", 0).alias("name"), i.alias("from"), F.get(to, brace(t, i)).alias("to")))))

    def table(toks: Column) -> Column:
        depth = running_sum(F.transform(toks, lambda t: t["step"]))
        to = bind(bind(depth, lambda d: events(toks, d)), lambda e: partners(toks, e))
        sigs = bind(to, lambda to_: signatures(toks, to_))
        n = lambda s: F.least(F.lit(256), F.floor(F.size(s) / 16).cast("int") + 1)
        groups = lambda s: F.transform(F.sequence(F.lit(0), n(s) - 1), lambda k: F.filter(s, lambda x: _group(x["name"], n(s)) == k))
        return F.struct(F.transform(toks, lambda t: t["t"]).alias("tokens"), bind(sigs, groups).alias("groups"))

    return bind(tokens, table)


def _group(name: Column, groups: Column) -> Column:
    return F.pmod(F.hash(name), groups)


def _c_cut(name: Column) -> Column:
    """Text from the first signature of a plain word to its partner brace; null when there is none."""
    tokens, groups = F.col("_table")["tokens"], F.col("_table")["groups"]
    return bind(F.get(F.filter(F.get(groups, _group(name, F.size(groups))), lambda s: s["name"] == name), F.lit(0)),
                lambda x: F.when(x["to"].isNotNull(), F.array_join(F.slice(tokens, x["from"] + 1, x["to"] - x["from"] + 1), "")))


def _close(tokens: Column) -> Column:
    """How many ``tokens`` (the first begins with a signature) reach the brace that closes the
    signature's; -1 when none does.  Braces before the signature's ``)`` do not count."""
    def step(acc, t):
        inside = acc["o"] | t.contains(")")
        d = acc["d"] + F.when(~inside, 0).when(t.endswith("{"), 1).when(t.endswith("}"), -1).otherwise(0)
        return F.when(acc["e"] >= 0, acc).otherwise(F.struct(
            inside.alias("o"), d.alias("d"), (acc["n"] + 1).alias("n"),
            F.when(inside & (d == 0) & t.endswith("}"), acc["n"] + 1).otherwise(F.lit(-1)).alias("e")))

    init = F.struct(F.lit(False).alias("o"), F.lit(0).alias("d"), F.lit(0).alias("n"), F.lit(-1).alias("e"))
    return F.aggregate(tokens, init, step)["e"]


def _c_cut_odd(name: Column) -> Column:
    """The same for a name that is no plain word: the text from its own match on."""
    rest = F.split(F.substr(F.col("_c"), _match_start(name)), C_BRACE_END)
    return F.when(_match_start(name) > 0, bind(rest, lambda t: bind(_close(t), lambda e: F.when(e > 0, F.array_join(F.slice(t, F.lit(1), e), "")))))


def function_texts(files: DataFrame, key: str = "file_key", c: str = "source_code_c", asm: str = "assembly_code") -> DataFrame:
    """C2 + C3 for every label function: ``key, fn_ord, function_name, fn, c_function, asm_function``.

    ``c_function``: from the name of the first ``name(...) {`` to the ``}`` matching its brace (every
    brace counts); ``asm_function``: the procedure body.  Both are stripped, "" when absent or
    unmatched.  A file's texts are split once, and its functions look their parts up in its row: no
    join, no shuffle, and the texts do not travel with the functions."""
    names = {"_c": F.coalesce(F.col(c), F.lit("")), "_asm": F.coalesce(F.col(asm), F.lit("")), "_fns": F.col("label.functions")}
    src = _marked(files.select(key, *(v.alias(k) for k, v in names.items())), [key, *names], "_asm")
    # The tables are used by lambdas: an array keeps them from being written into these.
    split = F.struct(_brace_table(F.col("_c")).alias("_table"), "_pieces", "_names", "_places")
    src = src.select(key, *names, F.explode(F.array(split)).alias("_x")).select(key, *names, *(F.col(f"_x.{t}").alias(t) for t in ("_table", "_pieces", "_names", "_places")))
    cut = lambda n: F.when(_odd(n), _c_cut_odd(n)).otherwise(_c_cut(n))
    body = lambda n: F.when(_odd(n), _odd_body(F.col("_asm"), n)).otherwise(_body(F.lower(n)))
    text = lambda part: F.coalesce(py_strip(part), F.lit("")).alias
    out = src.select(key, F.posexplode(F.transform("_fns", lambda f: F.struct(f.alias("fn"), F.when(
        F.coalesce(f["function_name"], F.lit("")) != "", F.struct(text(cut(f["function_name"]))("c"), text(body(f["function_name"]))("asm"))).alias("x")))).alias("fn_ord", "p"))
    return out.filter(F.col("p.x").isNotNull()).select(key, F.col("fn_ord").cast("bigint").alias("fn_ord"), F.col("p.fn.function_name").alias("function_name"),
                                                       F.col("p.fn").alias("fn"), F.col("p.x.c").alias("c_function"), F.col("p.x.asm").alias("asm_function"))


def c_functions(files: DataFrame, key: str = "file_key", c: str = "source_code_c") -> DataFrame:
    """C3 for every label function: ``key, fn_ord, function_name, c_function`` (see ``function_texts``)."""
    some = files.select(key, F.col(c).alias("_text"), F.lit("").alias("_none"), "label")
    return function_texts(some, key, "_text", "_none").select(key, "fn_ord", "function_name", "c_function")


def _match_start(name: Column) -> Column:
    """1-based code point at which a name's signature begins; 0 when absent."""
    before = F.call_function("regexp_extract", F.col("_c"), F.concat(F.lit("(?s)^(.*?)(?:"), c_signature_pattern(name), F.lit(")")), F.lit(1))
    hit = F.call_function("regexp_like", F.col("_c"), c_signature_pattern(name))
    return F.when(hit, F.length(before) + 1).otherwise(0)
