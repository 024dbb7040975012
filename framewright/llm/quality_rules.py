"""Quality rules by distribution divergence, in DataFrame functions only.

Base rules count words, symbols, repeated lines and repeated word windows. A
document that passes them is compared with the references of its language: the
histogram of character classes and that of the language's most common words, both
over all other documents of the language, by Jensen-Shannon distance (base 2, so 0
to 1). Short texts have ragged histograms, so each comparison has a least length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.llm.storage import stage
from framewright.llm.text_expr import BLANK, WORD, whole, without, words

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
COMMON_WORDS = 32  # bins of the word histogram, besides that of all other words
MAX_CHAR_DISTANCE = 0.30
MAX_WORD_DISTANCE = 0.45
MIN_WORDS_FOR_WORD_RULE = 80  # of the judged text
MIN_CHARS_FOR_CHAR_RULE = 200  # besides blanks, of the judged text
MIN_REFERENCE_DOCS = 10  # other documents of a language, at least, for its texts to be judged by them
MIN_REFERENCE_WORDS = 2_000  # their words, at least, for the rule on words
MIN_REFERENCE_CHARS = 10_000  # their characters besides blanks, at least, for the rule on characters
LOOKED_UP = 24  # repeated windows that are looked up one by one
POOLED = "\0all"  # key of the reference of all texts
#: Character classes in the order in which they are taken out of a text; the rest is the last class.
CLASSES = (r"\p{Ll}+", BLANK + "+", r"\p{Lu}+", r"[.,;:?'\"()\-]+", r"\p{N}+", r"\p{L}+")
N_CLASSES = len(CLASSES) + 1
BLANK_CLASS = 1
SCRIPTLESS = (3, 4)  # punctuation and digits, which all scripts use alike
SYMBOLS = r"[^#*$%&|<>]+"
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def distance(mine: Column, m: Column, theirs: Column, t: Column) -> Column:
    """Jensen-Shannon distance of two arrays of counts with the totals m and t, bin by bin."""
    def part(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)

    def both(a: Column, b: Column) -> Column:
        p, q = a / F.greatest(m, F.lit(1)), b / F.greatest(t, F.lit(1))
        return part(p, q) + part(q, p)
    return F.sqrt(F.greatest(F.aggregate(F.zip_with(mine, theirs, both), F.lit(0.0), lambda s, x: s + x) / 2, F.lit(0.0)))


def _measured(docs: DataFrame, text: str) -> DataFrame:
    """The documents with the counts of the base rules and of the character classes."""
    out = _char_counts(docs.withColumn("_t", whole(text)).withColumn("_words", words(F.col("_t"))), "_t")
    last = N_CLASSES - 1
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = out.withColumn("_lines", lines).withColumn(
        "_tri", F.when(F.size("_words") >= 3, F.transform(
            F.expr("slice(_words, 1, size(_words) - 2)"),
            lambda w, i: F.xxhash64(w, F.get("_words", i + 1), F.get("_words", i + 2)))).otherwise(F.expr("array()").cast("array<bigint>")))
    # Windows that come twice. Few of them are looked up for each place; many, as in texts that repeat
    # themselves, are found by sorting the windows with their places.
    out = out.withColumn("_sorted", F.sort_array("_tri"))
    out = out.withColumn("_twice", F.array_distinct(F.filter("_sorted", lambda x, k: x == F.get(F.col("_sorted"), k - 1))))
    out = out.withColumn("_pairs", F.when(F.size("_twice") > LOOKED_UP, F.sort_array(F.transform("_tri", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))))
    many = F.transform(F.filter("_pairs", lambda e, k: F.coalesce(e["x"] == F.get("_pairs", k - 1)["x"], F.lit(False))
                                | F.coalesce(e["x"] == F.get("_pairs", k + 1)["x"], F.lit(False))), lambda e: e["i"])
    few = F.filter(F.transform("_tri", lambda x, i: F.when(F.array_contains("_twice", x), i)), lambda i: i.isNotNull())
    out = out.withColumn("_at", F.when(F.size("_twice") == 0, F.expr("array()").cast("array<int>")).when(F.col("_pairs").isNotNull(), many).otherwise(few))
    covered = F.size(F.array_distinct(F.flatten(F.transform("_at", lambda i: F.array(i, i + 1, i + 2)))))
    return (out.withColumn("n_words", F.size("_words").cast("long"))
            .withColumn("word_chars", (F.length("_t") - F.col("_c1")).cast("long"))
            .withColumn("n_symbols", F.length(without(F.col(f"_r{last - 1}"), SYMBOLS)).cast("long"))
            .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
            .withColumn("n_repeat_words", covered.cast("long"))
            .drop("_t", "_lines", "_tri", "_sorted", "_twice", "_pairs", "_at", *(f"_r{k}" for k in range(last))))


def _char_counts(df: DataFrame, text: str) -> DataFrame:
    """``df`` with the counts of the character classes, ``_c0`` and so on."""
    left = F.col(text)
    for k, pattern in enumerate(CLASSES):
        df = df.withColumn(f"_r{k}", without(left, pattern)).withColumn(f"_c{k}", F.length(left) - F.length(f"_r{k}"))
        left = F.col(f"_r{k}")
    return df.withColumn(f"_c{N_CLASSES - 1}", F.length(left))


def references(docs: DataFrame, text: str = "text", lang: str = "lang", common: int = COMMON_WORDS) -> DataFrame:
    """A row per language: its documents, words, common words and their counts, and the counts of the
    character classes, its own and those of all texts.

    Counts cover all documents of the language, whatever its share; the row of ``POOLED`` covers all
    texts and is for those without a language.
    """
    base = docs.select(F.coalesce(F.col(lang), F.lit(POOLED)).alias("_lang"), whole(text).alias("_t"))
    counts = base.select("_lang", F.explode(words(F.col("_t"))).alias("_w")).groupBy("_lang", "_w").agg(F.count("*").alias("_n"))
    chars = _char_counts(base, "_t").groupBy("_lang").agg(
        F.count("*").alias("_docs"), *(F.sum(f"_c{k}").cast("long").alias(f"_c{k}") for k in range(N_CLASSES)))
    counts, chars = stage(counts, "lang-words"), stage(chars, "lang-chars")

    own = counts.where(F.col("_lang") != POOLED)
    pooled = counts.groupBy("_w").agg(F.sum("_n").alias("_n")).select(F.lit(POOLED).alias("_lang"), "_w", "_n")
    both = own.select("_lang", "_w", "_n").unionByName(pooled)
    # The most common words by two steps, so that no language is sorted in one task.
    part = Window.partitionBy("_lang", F.pmod(F.xxhash64("_w"), F.lit(64))).orderBy(F.desc("_n"), "_w")
    # A word that comes once is not common.
    top = both.where("_n > 1").withColumn("_k", F.row_number().over(part)).where(F.col("_k") <= common) \
        .withColumn("_k", F.row_number().over(Window.partitionBy("_lang").orderBy(F.desc("_n"), "_w"))).where(F.col("_k") <= common)
    tops = top.groupBy("_lang").agg(F.sort_array(F.collect_list(F.struct("_k", "_w", "_n"))).alias("_top"))
    of_lang = stage(counts.groupBy("_lang").agg(F.sum("_n").alias("_all")), "lang-totals")
    totals = of_lang.where(F.col("_lang") != POOLED).unionByName(of_lang.agg(F.sum("_all").alias("_all")).select(F.lit(POOLED).alias("_lang"), "_all"))
    summed = ["_docs", *(f"_c{k}" for k in range(N_CLASSES))]
    every = chars.agg(*(F.sum(c).alias(c) for c in summed)).select(F.lit(POOLED).alias("_lang"), *summed)
    pool = every.select(F.array(*(F.col(f"_c{k}") for k in range(N_CLASSES)))).scalar()
    rows = chars.where(F.col("_lang") != POOLED).unionByName(every).withColumn("_pool", pool)
    rows = rows.join(totals, "_lang", "left").join(tops, "_lang", "left")
    top = F.coalesce("_top", F.array().cast(tops.schema["_top"].dataType))
    return rows.select("_lang", "_docs", F.coalesce("_all", F.lit(0)).alias("_all"), F.transform(top, lambda x: x["_w"]).alias("_common"),
                       F.coalesce(F.array_max(F.transform(top, lambda x: F.octet_length(x["_w"]))), F.lit(0)).alias("_longest"),
                       F.concat(F.transform(top, lambda x: x["_n"]), F.array_repeat(F.lit(0).cast("long"), F.lit(common) - F.size(top))).alias("_wn"),
                       F.array(*(F.col(f"_c{k}") for k in range(N_CLASSES))).alias("_cn"), "_pool")


def quality_rules(docs: DataFrame, text: str = "text", lang: str = "lang", common: int = COMMON_WORDS,
                  max_char_distance: float = MAX_CHAR_DISTANCE, max_word_distance: float = MAX_WORD_DISTANCE) -> DataFrame:
    """All rows of ``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, char_distance, word_distance and kept.

    Null and empty texts have no words and fail the base rules; an empty table gives no row. A text is
    compared with the other documents of its language, without itself; one without a language with all
    others. Fewer than ``MIN_REFERENCE_DOCS`` others, ``MIN_REFERENCE_WORDS`` words or ``MIN_REFERENCE_CHARS``
    characters are too few: then the text is not judged by its words, and its characters are compared
    with all other texts in the shares that are alike in all scripts: letters, marks of punctuation and digits.
    A text of fewer than ``MIN_WORDS_FOR_WORD_RULE`` words or ``MIN_CHARS_FOR_CHAR_RULE`` characters besides
    blanks is not judged by its words or characters. A distance that is not taken is 0. Repeated rows are
    judged alike and all returned; other columns, whatever their names, are left as they are, except that
    a column with the name of a new one is replaced.
    """
    new = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "char_distance", "word_distance", "kept"]
    keep = [c for c in docs.columns if c.lower() not in new]
    # The caller's columns by number: no name of theirs can meet one of these steps.
    name = {c: f"u{k}" for k, c in enumerate(keep)}
    docs = docs.select(*(F.col(f"`{c}`").alias(u) for c, u in name.items()))
    refs = stage(references(docs, name[text], name[lang], common), "references")
    m = _measured(docs, name[text]).withColumn("_lang", F.coalesce(F.col(name[lang]), F.lit(POOLED)))
    # Small tables are broadcast by their size; that of very many languages is not.
    m = m.join(refs, "_lang", "left")
    letters = F.array(*(F.lit(c) for c in ("", *_LETTERS[:common])))
    m = m.withColumn("_letters", letters).withColumn("_marks", F.array_join(
        F.transform(F.filter("_words", lambda w: F.octet_length(w) <= F.col("_longest")),
                    lambda w: F.get(F.col("_letters"), F.array_position("_common", w).cast("int"))), ""))
    own = [F.length("_marks") - F.length(F.replace("_marks", F.lit(c))) for c in _LETTERS[:common]]
    inside = F.aggregate("_wn", F.lit(0).cast("long"), lambda s, x: s + x)
    m = m.withColumn("_own", F.array(*own, F.col("n_words") - F.length("_marks")).cast("array<bigint>")) \
        .withColumn("_others", F.zip_with(F.concat("_wn", F.array(F.col("_all") - inside)), "_own", lambda a, b: a - b))
    m = m.withColumn("_mine", F.array(*(F.col(f"_c{k}").cast("long") for k in range(N_CLASSES)))) \
        .withColumn("_theirs", F.zip_with("_cn", "_mine", lambda a, b: a - b)).withColumn("_rest", F.zip_with("_pool", "_mine", lambda a, b: a - b))
    for c in ("_mine", "_theirs", "_rest"):
        m = m.withColumn(c + "_all", F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x)) \
            .withColumn(c + "_solid", F.col(c + "_all") - F.get(c, F.lit(BLANK_CLASS)))

    def alike(c: str) -> Column:
        some = [F.get(c, F.lit(k)) for k in SCRIPTLESS]
        return F.array(F.col(c + "_solid") - sum(some, F.lit(0)), *some)

    enough = F.col("_docs") - 1 >= MIN_REFERENCE_DOCS
    by_words = enough & (F.col("_all") - F.col("n_words") >= MIN_REFERENCE_WORDS) & (F.col("n_words") >= MIN_WORDS_FOR_WORD_RULE)
    char_distance = F.when(F.col("_mine_solid") < MIN_CHARS_FOR_CHAR_RULE, 0.0) \
        .when(enough & (F.col("_theirs_solid") >= MIN_REFERENCE_CHARS), distance(F.col("_mine"), F.col("_mine_all"), F.col("_theirs"), F.col("_theirs_all"))) \
        .when(F.col("_rest_solid") >= MIN_REFERENCE_CHARS, distance(alike("_mine"), F.col("_mine_solid"), alike("_rest"), F.col("_rest_solid"))).otherwise(0.0)
    m = m.withColumn("char_distance", char_distance) \
        .withColumn("word_distance", F.when(by_words, distance(F.col("_own"), F.col("n_words"), F.col("_others"), F.col("_all") - F.col("n_words"))).otherwise(0.0)) \
        .withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))) \
        .withColumn("kept", ~F.col("base_failed") & (F.col("char_distance") <= max_char_distance) & (F.col("word_distance") <= max_word_distance))
    return m.select(*(F.col(u).alias(c) for c, u in name.items()), *new)


def accepted(docs: DataFrame, text: str = "text", lang: str = "lang", **settings) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with its columns.

    The row number keeps the verdict one column: without it the planner would write the filter's
    expressions out at every use.
    """
    name = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    judged = quality_rules(docs.select(*(F.col(f"`{c}`").alias(x) for c, x in name.items())), name[text], name[lang], **settings)
    judged = judged.withColumn("row", F.monotonically_increasing_id())
    return judged.where(F.col("kept") & (F.col("row") >= 0)).select(*(F.col(x).alias(c) for c, x in name.items()))


def op9_quality_rules(docs: DataFrame) -> DataFrame:
    """Every document's counts and verdict. Edge cases as in ``quality_rules``."""
    return quality_rules(docs.select("doc_id", "text", "lang")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql_part(p: str, q: str) -> str:
    return f"CASE WHEN {p} > 0 THEN {p} * log2(2 * {p} / ({p} + {q})) ELSE 0 END + CASE WHEN {q} > 0 THEN {q} * log2(2 * {q} / ({p} + {q})) ELSE 0 END"


def _sql_distance(mine: list[str], theirs: list[str]) -> str:
    """Distance of two lists of counts."""
    pairs = [(f"(({a}) / greatest({' + '.join(mine)}, 1)::DOUBLE)", f"(({b}) / greatest({' + '.join(theirs)}, 1)::DOUBLE)") for a, b in zip(mine, theirs)]
    return "sqrt(greatest((" + " + ".join(_sql_part(p, q) for p, q in pairs) + ") / 2, 0))"


def _sql() -> str:
    n = N_CLASSES
    left = ["t", *(f"r{k}" for k in range(n - 1))]
    mine, theirs, all_texts = [f"c{k}" for k in range(n)], [f"(k{k} - c{k})" for k in range(n)], [f"(p{k} - c{k})" for k in range(n)]

    def solid(c):
        return "(" + " + ".join(x for k, x in enumerate(c) if k != BLANK_CLASS) + ")"

    def alike(c):
        return ["(" + " + ".join(x for k, x in enumerate(c) if k not in (BLANK_CLASS, *SCRIPTLESS)) + ")", *(c[k] for k in SCRIPTLESS)]

    steps = "".join(f",\n  regexp_replace({left[k]}, '{p.replace(chr(39), chr(39) * 2)}', '', 'g') AS r{k}, length({left[k]}) - length(r{k}) AS c{k}" for k, p in enumerate(CLASSES))
    sums = ", ".join(f"sum(c{k})::BIGINT AS k{k}" for k in range(n))
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce('l' || lang, 'p') AS key, coalesce(text, '') AS t, regexp_extract_all(t, '{WORD}') AS words{steps},
    length({left[n - 1]}) AS c{n - 1}, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines FROM documents),
w AS (SELECT r, key, unnest(words) AS w FROM d),
tri AS (SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS k FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM d)),
rep AS (SELECT r, i FROM tri QUALIFY count(*) OVER (PARTITION BY r, k) > 1),
cov AS (SELECT r, count(DISTINCT i) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS i FROM rep) GROUP BY r),
base AS (SELECT d.r, doc_id, key, len(words)::BIGINT AS n_words, (length(t) - c{BLANK_CLASS})::BIGINT AS word_chars,
    length(regexp_replace(t, '{SYMBOLS}', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(cov.n, 0)::BIGINT AS n_repeat_words, {', '.join(mine)} FROM d LEFT JOIN cov ON cov.r = d.r),
cnt AS (SELECT key, w, count(*) AS n FROM w GROUP BY key, w),
both_ AS (SELECT key, w, n FROM cnt WHERE key <> 'p' UNION ALL SELECT 'p', w, sum(n) FROM cnt GROUP BY w),
top AS (SELECT key, w, n FROM both_ WHERE n > 1 QUALIFY row_number() OVER (PARTITION BY key ORDER BY n DESC, w) <= {COMMON_WORDS}),
tot AS (SELECT key, sum(n) AS total FROM both_ GROUP BY key),
ref AS (SELECT key, count(*) AS docs, {sums} FROM base WHERE key <> 'p' GROUP BY key UNION ALL SELECT 'p', count(*), {sums} FROM base),
pool AS (SELECT {', '.join(f"k{k} AS p{k}" for k in range(n))} FROM ref WHERE key = 'p'),
own AS (SELECT r, key, w, count(*) AS n FROM w GROUP BY r, key, w),
bins AS (SELECT b.r, top.w, coalesce(own.n, 0) AS mine, top.n - mine AS theirs, b.n_words AS m, tot.total - b.n_words AS q
         FROM base b JOIN tot ON tot.key = b.key JOIN top ON top.key = b.key LEFT JOIN own ON own.r = b.r AND own.key = b.key AND own.w = top.w),
every AS (SELECT r, mine, theirs, m, q FROM bins UNION ALL SELECT r, m - sum(mine), q - sum(theirs), m, q FROM bins GROUP BY r, m, q),
js AS (SELECT r, sqrt(greatest(sum({_sql_part('(mine / greatest(m, 1)::DOUBLE)', '(theirs / greatest(q, 1)::DOUBLE)')}) / 2, 0)) AS x FROM every GROUP BY r),
judged AS (SELECT base.*, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
    CASE WHEN {solid(mine)} < {MIN_CHARS_FOR_CHAR_RULE} THEN 0
         WHEN docs - 1 >= {MIN_REFERENCE_DOCS} AND {solid(theirs)} >= {MIN_REFERENCE_CHARS} THEN {_sql_distance(mine, theirs)}
         WHEN {solid(all_texts)} >= {MIN_REFERENCE_CHARS} THEN {_sql_distance(alike(mine), alike(all_texts))} ELSE 0 END AS char_distance,
    CASE WHEN docs - 1 >= {MIN_REFERENCE_DOCS} AND total - n_words >= {MIN_REFERENCE_WORDS} AND n_words >= {MIN_WORDS_FOR_WORD_RULE} THEN coalesce(x, 0) ELSE 0 END AS word_distance
  FROM base JOIN ref ON ref.key = base.key CROSS JOIN pool LEFT JOIN tot ON tot.key = base.key LEFT JOIN js ON js.r = base.r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND char_distance <= {MAX_CHAR_DISTANCE} AND word_distance <= {MAX_WORD_DISTANCE} AS kept
FROM judged
"""


OP9_SQL = _sql()
