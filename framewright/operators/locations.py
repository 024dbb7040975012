"""Variable locations (D4-D16): where each label variable lives.

Plan per procedure, inside the row that its body is cut into:

1. lines      ``split(body)``, strip, drop blanks, comment flag
2. blocks     a comment line after a code line opens a block
3. offsets    first write ``[ebp±N]`` of each block, else first any-``[ebp±N]``
4. registers  ``REG = &?var`` pairs in the joined comment text of each block;
              last pair (block order, then position) wins
5. mentions   a variable is mentioned by a block when its name is a substring
              of an active (non-declaration) comment line
6. resolve    first mentioning block that has an offset decides; else the
              register; ``ptr_`` names are pointers (null/null, found)

A procedure is one row with its blocks (``procedures``).  The label functions are
joined to it once, by ``(file_key, lname)``, with their variables as an array: names
are looked for in the blocks' comment text inside that row, so neither text nor
variables are shuffled again, and only real mentions leave a task.  The work of a
procedure is its variables times its comment text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.functions.patterns import (
    ANY_EBP,
    DECL_COMMENT,
    LIVE_MARKER,
    POINTER_PREFIX,
    REG_FACT,
    REGISTERS,
    WRITE_EBP,
)
from framewright.functions.arrays import bind
from framewright.functions.text import parse_offset, py_strip, quote_regex
from framewright.operators.extract import explode_variables, function_bodies
from framewright.session import cut_lineage
from framewright.operators.frames import frame_columns, frame_facts, frame_parts, frames_from_blocks


def format_reference(offset: Column) -> Column:
    """``ebp-4`` / ``ebp+8`` text of a signed offset."""
    return F.when(offset < 0, F.concat(F.lit("ebp"), offset.cast("string"))) \
        .when(offset.isNotNull(), F.concat(F.lit("ebp+"), offset.cast("string")))


def classified_lines(raws: Column) -> Column:
    """Of the lines of a body those that are not blank, ``(line_no, text, is_comment)`` in order; ``text`` is stripped."""
    comment = lambda t: t.startswith(";") | (t.startswith("?live") & t.rlike(LIVE_MARKER))
    return F.filter(F.transform(F.transform(raws, py_strip), lambda t, i: F.struct(i.cast("bigint").alias("line_no"), t.alias("text"), comment(t).alias("is_comment"))),
                    lambda x: x["text"] != "")


def first_offset(texts: Column, pattern: str) -> Column:
    """The first ``[ebp±N]`` of the pattern that is a number, in code lines; one a line is looked at."""
    plain = lambda raw: F.when(raw.rlike(r"^[+\-][0-9]{1,18}$"), raw.try_cast("bigint")).when(raw != "", parse_offset(raw))
    return F.get(F.filter(F.transform(texts, lambda t: bind(F.regexp_extract(t, pattern, 1), plain)), lambda o: o.isNotNull()), F.lit(0))


def register_facts(comments: Column) -> Column:
    """Register facts ``(var, reg)`` of comment lines in text order.  None goes on in the next line, which begins with
    its ``;`` or ``?live``, so only lines with a ``=`` are looked at."""
    def facts(text: Column) -> Column:
        both = F.arrays_zip(F.regexp_extract_all(text, F.lit(REG_FACT), 1).alias("reg"), F.regexp_extract_all(text, F.lit(REG_FACT), 2).alias("var"))
        return F.filter(F.transform(both, lambda p: F.struct(p["var"].alias("var"), F.lower(p["reg"]).alias("reg"))), lambda p: p["reg"].isin(REGISTERS))

    none = F.expr("array()").cast("array<struct<var:string,reg:string>>")
    return bind(F.array_join(F.filter(comments, lambda t: t.contains("=")), "\n"), lambda text: F.when(text != "", facts(text)).otherwise(none))


def block_facts(lines: Column) -> Column:
    """The blocks of ``classified_lines`` in order, at least one:

    * ``block_id``: a comment line after a code line opens a block
    * ``write_off`` / ``any_off``: first write offset / first any offset (D8/D9)
    * ``regs``: register facts of the comment lines (D6)
    * ``active``: non-declaration comment lines (mentions, D7/D10)
    * ``n_comment`` / ``n_code``: how many lines are of either kind
    """
    opens = F.filter(F.transform(lines, lambda x, j: F.when((j > 0) & x["is_comment"] & ~F.get(lines, j - 1)["is_comment"], j)), lambda j: j.isNotNull())

    def facts(own: Column, n: Column) -> Column:
        comments = F.transform(F.filter(own, lambda x: x["is_comment"]), lambda x: x["text"])
        # both patterns need the literal '[ebp'; other lines skip the regexes
        code = F.transform(F.filter(own, lambda x: ~x["is_comment"] & F.lower(x["text"]).contains("[ebp")), lambda x: x["text"])
        return bind(comments, lambda c: bind(code, lambda t: F.struct(
            n.cast("bigint").alias("block_id"), first_offset(t, WRITE_EBP).alias("write_off"), first_offset(t, ANY_EBP).alias("any_off"),
            register_facts(c).alias("regs"), F.filter(c, lambda x: ~x.rlike(DECL_COMMENT)).alias("active"),
            F.size(c).cast("bigint").alias("n_comment"), (F.size(own) - F.size(c)).cast("bigint").alias("n_code"))))

    return bind(F.concat(F.array(F.lit(0)), opens), lambda starts: F.transform(starts, lambda at, n: bind(
        F.slice(lines, at + 1, F.coalesce(F.get(starts, n + 1), F.size(lines)) - at), lambda own: facts(own, n))))


def procedure_facts(bodies: DataFrame, key: str = "file_key") -> DataFrame:
    """One row per body, made inside its row: ``key, lname``, its ``blocks`` (``block_facts``) and the parts of its frame
    (``frames.frame_facts``).  No line leaves its row: there is no window, no sort and no exchange of lines."""
    facts = lambda raws, lines: F.struct(block_facts(lines).alias("blocks"), frame_facts(raws, lines).alias("frame"))
    both = bind(F.split("body", "\n"), lambda raws: bind(classified_lines(raws), lambda lines: facts(raws, lines)))
    # exploded: else the optimizer writes the whole expression into each use of a part
    return bodies.select(key, "lname", F.explode(F.array(both)).alias("_p")).select(key, "lname", "_p.*")


def block_rows(facts: DataFrame, key: str = "file_key") -> DataFrame:
    """One row per block of ``procedure_facts``: ``key, lname``, the fields of ``block_facts``, and those of
    ``frames.frame_facts`` in the first block of each procedure."""
    rows = facts.select(key, "lname", "frame", F.explode("blocks").alias("b"))
    first = F.col("b.block_id") == 0
    # empty lists, not nulls: a null would make the list of the procedure null
    part = lambda n: F.when(first, F.col(f"frame.{n}")).otherwise(F.filter(f"frame.{n}", lambda _: F.lit(False))).alias(n)
    return rows.select(key, "lname", "b.*", part("allocs"), part("pushes"), F.when(first, F.col("frame.stop_line")).alias("stop_line"))


def _mentioned(text: Column, name: Column, match: str) -> Column:
    """Whether lines joined by line feeds hold ``name``; ``match="word"`` asks for a whole word."""
    if match == "word":
        whole_word = F.concat(F.lit(r"(?U)(?<!\w)"), quote_regex(name), F.lit(r"(?!\w)"))
        return text.contains(name) & name.rlike(r"(?U)^\w+$") & F.call_function("regexp_like", text, whole_word)
    return text.contains(name) & ~name.contains("\n")


def procedures(blocks: DataFrame, key: str = "file_key") -> DataFrame:
    """One row per procedure: ``key, lname, blocks, regs`` and its frame (``frame_columns``).

    ``blocks``: ``(block_id, off, text)`` of the blocks with active comment lines, in order, ``text`` being
    these lines; ``regs``: register facts ``(var, reg)`` in text order (D6).  Keeps the procedure partitioning.
    """
    off = F.coalesce("write_off", "any_off").alias("off")
    g = blocks.groupBy(key, "lname").agg(
        F.sort_array(F.collect_list(F.when(F.size("active") > 0, F.struct("block_id", off, F.array_join("active", "\n").alias("text"))))).alias("blocks"),
        F.sort_array(F.collect_list(F.when(F.size("regs") > 0, F.struct("block_id", "regs")))).alias("_facts"), *frame_parts())
    return g.select(key, "lname", "blocks", F.flatten(F.col("_facts")["regs"]).alias("regs"), *frame_columns())


def located(name: Column, blocks: Column, regs: Column, match: str = "substring") -> Column:
    """D11/D6 of one name: ``(offset, block_id, reg)`` from the columns of ``procedures``."""
    hit = F.get(F.filter(blocks, lambda b: b["off"].isNotNull() & _mentioned(b["text"], name, match)), F.lit(0))
    reg = bind(F.filter(regs, lambda r: r["var"] == name), lambda rs: F.get(rs, F.size(rs) - 1)["reg"])
    return bind(hit, lambda h: F.struct(h["off"].alias("offset"), h["block_id"].alias("block_id"), reg.alias("reg")))


class LabelRun:
    """Lazily built DataFrames of one labelling pass over a files DataFrame.

    ``files`` needs ``file_key, assembly_code, label`` (nested label schema).
    """

    def __init__(self, files: DataFrame, key: str = "file_key", match: str = "substring",
                 materialize: str | None = "checkpoint", partitions: int | None = None):
        """``materialize``: how the per-line table, read by three branches
        (frames, mentions, registers), is kept: ``"checkpoint"`` (written to
        the shared folder in ``spark.checkpoint.dir`` where that is set, cuts
        lineage) or ``None`` (recompute in every branch).  ``partitions``: how
        many the procedures are dealt over; adaptive planning decides by default.

        The line table is made at its first use: callers of ``functions`` and
        ``bodies`` alone do not pay for it."""
        self.key = key
        self.match = match
        self.materialize = materialize
        self._every = self._located = None
        self.functions, self.bodies = function_bodies(files, key, partitions=partitions)
        self.variables = explode_variables(self.functions, key)

    @property
    def every(self) -> DataFrame:
        """The block table, materialised once per run; a procedure without a line of text has a block, too."""
        if self._every is None:
            self._every = self._keep(block_rows(procedure_facts(self.bodies, self.key), self.key))
        return self._every

    @property
    def blocks(self) -> DataFrame:
        return self.every.filter(F.col("n_comment") + F.col("n_code") > 0)

    @property
    def found(self) -> DataFrame:
        return self.every.select(self.key, "lname").distinct()

    @property
    def procedures(self) -> DataFrame:
        return procedures(self.every, self.key)

    @property
    def frames(self) -> DataFrame:
        return frames_from_blocks(self.blocks, self.key)

    def close(self) -> None:
        for df in (self._every, self._located):
            if df is not None:
                df.unpersist()

    def _keep(self, df: DataFrame) -> DataFrame:
        if self.materialize == "checkpoint":
            return cut_lineage(df)
        return df

    # D6
    def registers(self) -> DataFrame:
        """``key, lname, var, reg`` — last register fact per variable."""
        facts = self.every.select(self.key, "lname", "block_id", F.posexplode("regs").alias("pos", "p"))
        return facts.groupBy(self.key, "lname", F.col("p.var").alias("var")).agg(F.max_by("p.reg", F.struct("block_id", "pos")).alias("reg"))

    # D10 (all mention pairs)
    def mentions(self) -> DataFrame:
        k = self.key
        names = F.filter(F.transform("fn.variable_mapping", lambda v: v["variable_name"]), lambda n: n.isNotNull())
        both = self.functions.select(k, "lname", F.array_distinct(names).alias("_names")).join(self.procedures, [k, "lname"])
        pairs = F.flatten(F.transform("_names", lambda n: F.transform(
            F.filter("blocks", lambda b: _mentioned(b["text"], n, self.match)), lambda b: F.struct(n.alias("variable_name"), b["block_id"].alias("block_id")))))
        return both.select(k, "lname", F.explode(pairs).alias("m")).select(k, "lname", "m.variable_name", "m.block_id").distinct()

    # D11
    def resolved_offsets(self) -> DataFrame:
        k = self.key
        v = self.located().select(k, "lname", F.explode_outer("locs").alias("l")).select(k, "lname", "l.variable_name", "l.offset", "l.block_id")
        return v.filter(F.col("offset").isNotNull()).dropDuplicates([k, "lname", "variable_name"])

    def located(self) -> DataFrame:
        """One row per label function: ``key, fn_ord, function_name, lname, fn, hit``, its frame, and ``locs``,
        the variables with what the procedure says of them (null when it was not found).  The one join of
        functions and procedures, materialised once per run."""
        if self._located is None:
            k = self.key
            facts = self.procedures.withColumn("hit", F.lit(True))
            both = self.functions.join(facts, [k, "lname"], "left")
            locs = F.transform("fn.variable_mapping", lambda v: bind(located(v["variable_name"], F.col("blocks"), F.col("regs"), self.match), lambda x: F.struct(
                v["variable_name"].alias("variable_name"), v["size_bytes"].alias("size_bytes"), v["assembly_reference"].alias("old_assembly_reference"),
                v["allocation_space_offset"].alias("old_allocation_space_offset"), x["offset"].alias("offset"), x["block_id"].alias("block_id"), x["reg"].alias("reg"))))
            self._located = self._keep(both.select(
                k, "fn_ord", "function_name", "lname", "fn", F.coalesce("hit", F.lit(False)).alias("hit"), "stack_allocation_instruction",
                "stack_allocation_size_bytes", "alloc_index", F.when(F.col("hit"), F.transform(locs, self._decided)).alias("locs")))
        return self._located

    @staticmethod
    def _decided(x: Column) -> Column:
        """A variable's facts with its new location and the kind of it."""
        is_ptr = x["variable_name"].startswith(POINTER_PREFIX)
        kind = F.when(is_ptr, "pointer").when(x["offset"].isNotNull(), "stack").when(x["reg"].isNotNull(), "register").otherwise("missing")
        ref = F.when(is_ptr, F.lit(None).cast("string")).when(x["offset"].isNotNull(), format_reference(x["offset"])) \
            .when(x["reg"].isNotNull(), F.concat(F.lit("register "), x["reg"]))
        return F.struct(*(x[c].alias(c) for c in ("variable_name", "size_bytes", "old_assembly_reference", "old_allocation_space_offset", "offset", "block_id")),
                        ref.alias("assembly_reference"), F.when(is_ptr, F.lit(None).cast("bigint")).otherwise(x["offset"]).alias("allocation_space_offset"),
                        kind.alias("location_kind"))

    # One row per label variable of a function whose procedure was found
    def locations(self) -> DataFrame:
        v = self.located().select(self.key, "fn_ord", "function_name", "lname", F.posexplode_outer("locs").alias("var_ord", "l")).filter(F.col("l").isNotNull())
        return v.select(self.key, "fn_ord", "function_name", "lname", F.col("var_ord").cast("bigint").alias("var_ord"),
                        *(F.col(f"l.{c}").alias(c) for c in ("variable_name", "size_bytes", "old_assembly_reference", "old_allocation_space_offset",
                                                              "assembly_reference", "allocation_space_offset", "location_kind")))

    # Label values after the update (not found -> old values kept)
    def applied(self) -> DataFrame:
        loc = self.locations()
        found = F.col("location_kind") != "missing"
        return loc.select(
            self.key, "fn_ord", "function_name", "lname", "var_ord", "variable_name", "size_bytes",
            F.when(found, F.col("assembly_reference")).otherwise(F.col("old_assembly_reference")).alias("assembly_reference"),
            F.when(found, F.col("allocation_space_offset")).otherwise(F.col("old_allocation_space_offset"))
            .alias("allocation_space_offset"),
            "location_kind", found.alias("found"))

    # D15
    def report(self) -> DataFrame:
        loc = self.locations()
        return loc.agg(
            F.count_if(F.col("location_kind") == "stack").cast("bigint").alias("stack_allocated"),
            F.count_if(F.col("location_kind").isin("register", "pointer")).cast("bigint").alias("register_only"),
            F.count_if(F.col("location_kind") == "missing").cast("bigint").alias("missing"))

    # function level: frames of the label functions whose procedure was found
    def function_frames(self) -> DataFrame:
        return self.located().filter("hit").select(self.key, "fn_ord", "function_name", "lname", "stack_allocation_instruction",
                                                   "stack_allocation_size_bytes", "alloc_index")

    # D16
    def region_offsets(self) -> DataFrame:
        k = self.key
        v = self.located().select(k, "function_name", "stack_allocation_size_bytes", F.explode_outer("locs").alias("l"))
        return v.filter(F.col("l.location_kind") == "stack").select(
            k, "function_name", "l.variable_name", "l.allocation_space_offset",
            F.when(F.col("l.allocation_space_offset") < 0,
                   F.col("stack_allocation_size_bytes") + F.col("l.allocation_space_offset")).alias("region_offset"))

    def updated_functions(self) -> DataFrame:
        """D14 per function: ``key, fn_ord, fn`` with the label struct after
        the update.  Functions whose procedure was not found keep every old
        value; found ones get the new frame and, per variable, the new
        location when found, else the old one."""
        new = lambda name: F.when(F.col("hit"), F.col(name)).otherwise(F.col(f"fn.{name}")).alias(name)
        of = lambda x, name: F.when(x["location_kind"] != "missing", x[name]).otherwise(x[f"old_{name}"]).alias(name)
        variables = F.transform("locs", lambda x: F.struct(x["variable_name"].alias("variable_name"), of(x, "assembly_reference"),
                                                           of(x, "allocation_space_offset"), x["size_bytes"].alias("size_bytes")))
        fn = F.struct(F.col("fn.function_name").alias("function_name"), new("stack_allocation_instruction"), new("stack_allocation_size_bytes"),
                      F.coalesce(variables, F.col("fn.variable_mapping")).alias("variable_mapping"))
        return self.located().select(self.key, "fn_ord", fn.alias("fn"))

    def updated_files(self, files: DataFrame) -> DataFrame:
        """D14 nested: ``files`` with label values replaced where found."""
        k = self.key
        upd = self.updated_functions()
        old = files.select(k, F.posexplode("label.functions").alias("fn_ord", "fn")).select(k, F.col("fn_ord").cast("bigint").alias("fn_ord"), "fn", F.lit(True).alias("old"))
        # Old and new labels are dealt by file once; functions and files are then grouped where they are.
        both = old.unionByName(upd.withColumn("old", F.lit(False))).repartition(k)
        fns = both.groupBy(k, "fn_ord").agg(F.collect_list(F.when(F.col("old"), F.struct("fn_ord", "fn"))).alias("_old"),
                                            F.collect_list(F.when(~F.col("old"), F.struct("fn_ord", "fn"))).alias("_new"))
        merged = fns.filter(F.size("_old") > 0).select(k, F.when(F.size("_new") > 0, F.flatten(F.transform("_old", lambda _: F.col("_new")))).otherwise(F.col("_old")).alias("fs"))
        nested = merged.groupBy(k).agg(F.array_sort(F.flatten(F.collect_list("fs"))).alias("fs"))
        nested = nested.select(k, F.struct(F.transform("fs", lambda x: x["fn"]).alias("functions")).alias("new_label"))
        return files.join(nested, k, "left").withColumn(
            "label", F.coalesce(F.col("new_label"), F.col("label"))).drop("new_label")
