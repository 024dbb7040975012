"""Operators in DataFrame functions: quality rules, line dedup, mixing, fingerprints."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import pytest
import regex
from pyspark.sql import functions as F

from framewright.llm import fingerprints, line_dedup, mixing, quality_rules

DOCS = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(rng: random.Random, n: int) -> str:
    common = ["the", "of", "and", "to", "in", "is", "that", "it"]
    return " ".join(rng.choice(common) if rng.random() < 0.4 else "".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(3, 9)))
                    for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(5)
    rows = [(k, prose(rng, rng.randint(60, 200)), "en", f"s{k % 4}", 0) for k in range(60)]
    rows += [(60, None, None, None, None), (61, "", "en", "s0", 0), (62, " \n\t ", "xx", "s1", 1), (63, rows[0][1], "en", "s0", 0), (63, rows[0][1], "en", "s0", 0),
             (64, " ".join(["same words here"] * 60), "en", "s1", 0), (65, " ".join(w + "%%%" for w in rows[3][1].split()), "en", "s2", 0),
             (66, rows[4][1].upper().replace(" ", "!! "), "en", "s3", 0), (67, prose(rng, 4000), "en", "s0", 0), (68, "line one\nline one\n\n\nline one", "en", "s0", 0)]
    return spark.createDataFrame(rows, DOCS)


def base_rules(text):
    words = WORD.findall(text or "")
    n = len(words)
    windows = Counter(tuple(words[k:k + 3]) for k in range(n - 2))
    covered = {j for k in range(n - 2) if windows[tuple(words[k:k + 3])] > 1 for j in (k, k + 1, k + 2)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_base_rules_match_brute_force(corpus):
    out = quality_rules.quality_rules(corpus).collect()
    assert len(out) == corpus.count()
    for r in out:
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert got == base_rules(r.text)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed)


def test_rules_keep_prose_and_drop_junk(corpus):
    kept = {r.doc_id for r in quality_rules.accepted(corpus).collect()}
    assert set(range(60)) | {67} <= kept
    assert not kept & {60, 61, 62, 64, 65, 66, 68}


def test_rules_on_empty_table_and_clashing_columns(spark, corpus):
    assert quality_rules.quality_rules(spark.createDataFrame([], DOCS)).collect() == []
    odd = corpus.withColumn("n_words", F.lit("mine")).withColumn("kept", F.lit(3)).withColumn("_key", F.lit(1)).withColumn("_t2", F.lit(1))
    out = quality_rules.quality_rules(odd)
    assert out.columns.count("n_words") == 1 and dict(out.dtypes)["kept"] == "boolean"
    assert out.count() == corpus.count()


def test_rules_judge_each_language_by_itself(spark):
    """Clean texts of rare languages and scripts stay, junk in them goes, whatever else the corpus has."""
    rng = random.Random(15)

    def other(letters, n):
        common = ["".join(rng.choice(letters) for _ in range(2)) for _ in range(8)]
        return [" ".join(rng.choice(common) if rng.random() < 0.4 else "".join(rng.choice(letters) for _ in range(rng.randint(3, 9))) for _ in range(150)) for _ in range(n)]

    hangul = "".join(map(chr, range(0xAC00, 0xAC40)))
    rows = [(k, t, "ko") for k, t in enumerate(other(hangul, 30))] + [(50, t, "th") for t in other("กขคงจฉช", 1)] + [(51, t, "xx") for t in other("qwxyzkvj", 1)]
    rows += [(60, " ".join(f"{rng.randint(0, 10 ** 6)}%" for _ in range(150)), "ko")]
    small = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING")
    large = spark.createDataFrame([(100, prose(rng, 60 * 20_000), "en")], small.schema)
    for docs in (small, small.unionByName(large)):
        kept = {r.doc_id for r in quality_rules.accepted(docs).collect()}
        assert kept - {100} == set(range(30)) | {50, 51}


def test_a_text_is_not_its_own_reference(spark):
    """Digits and signs that are the only text of their language, or most of its words, are junk all the same;
    the texts of other languages are the reference then."""
    rng = random.Random(16)
    junk = [" ".join(f"{rng.randint(0, 10 ** 6)}%" for _ in range(3_000)) for _ in range(2)]
    rows = [(k, prose(rng, 150), "en") for k in range(300)] + [(1000, junk[0], "zz"), (1001, junk[1], "yy"), (1002, prose(rng, 150), "yy")]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING")
    assert {r.doc_id for r in quality_rules.accepted(docs).collect()} == set(range(300)) | {1002}


def js(a: list, b: list) -> float:
    p, q = ([x / max(sum(c), 1) for x in c] for c in (a, b))
    part = lambda x, y: x * math.log2(2 * x / (x + y)) if x else 0.0
    return math.sqrt(max(sum(part(x, y) + part(y, x) for x, y in zip(p, q)) / 2, 0.0))


def test_distances_match_brute_force(spark, corpus):
    rng = random.Random(17)
    mixed = [(500 + k, " ".join(rng.choice([f"{rng.randint(0, 99)}", "und", "der", "Ein", "Wort;", "ähnlich", "\u4e2d\u6587"]) for _ in range(rng.choice([20, 60, 300]))),
              rng.choice(["de", None, "de", "fr"])) for k in range(60)]
    rows = [(r.doc_id, r.text, r.lang) for r in corpus.select("doc_id", "text", "lang").collect()] + mixed
    classes = [r"\p{Ll}", r"[\x20\x09-\x0D]", r"\p{Lu}", r"[.,;:?'\"()\-]", r"\p{N}", r"\p{L}"]

    def counted(text):
        left, out = text or "", []
        for c in classes:
            less = regex.sub(c, "", left)
            out.append(len(left) - len(less))
            left = less
        return [*out, len(left)]

    chars, word_lists = [counted(t) for _, t, _ in rows], [WORD.findall(t or "") for _, t, _ in rows]
    solid = lambda c: sum(c) - c[1]
    alike = lambda c: [solid(c) - c[3] - c[4], c[3], c[4]]
    less = lambda a, b: [x - y for x, y in zip(a, b)]
    total = [sum(c) for c in zip(*chars)]
    got = {r.doc_id: r for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING")).collect()}
    kinds = Counter()
    for k, (i, text, lang) in enumerate(rows):
        members = [j for j, r in enumerate(rows) if lang is None or r[2] == lang]
        counts = Counter(w for j in members for w in word_lists[j])
        top = sorted((w for w in counts if counts[w] > 1), key=lambda w: (-counts[w], w.encode()))[:32]
        own, n = Counter(word_lists[k]), len(word_lists[k])
        theirs = less([sum(c) for c in zip(*(chars[j] for j in members))], chars[k])
        many = len(members) - 1 >= quality_rules.MIN_REFERENCE_DOCS
        x = y = 0.0
        if solid(chars[k]) >= quality_rules.MIN_CHARS_FOR_CHAR_RULE:
            if many and solid(theirs) >= quality_rules.MIN_REFERENCE_CHARS:
                x, kinds["own"] = js(chars[k], theirs), kinds["own"] + 1
            elif solid(less(total, chars[k])) >= quality_rules.MIN_REFERENCE_CHARS:
                x, kinds["all"] = js(alike(chars[k]), alike(less(total, chars[k]))), kinds["all"] + 1
        if many and sum(counts.values()) - n >= quality_rules.MIN_REFERENCE_WORDS and n >= quality_rules.MIN_WORDS_FOR_WORD_RULE:
            a = [own[w] for w in top]
            b = [counts[w] - own[w] for w in top]
            y, kinds["words"] = js([*a, n - sum(a)], [*b, sum(counts.values()) - n - sum(b)]), kinds["words"] + 1
        r = got[i]
        assert abs(r.char_distance - x) < 1e-9 and abs(r.word_distance - y) < 1e-9, (i, lang)
        assert r.kept == (not r.base_failed and x <= quality_rules.MAX_CHAR_DISTANCE and y <= quality_rules.MAX_WORD_DISTANCE)
    assert min(kinds[k] for k in ("own", "all", "words")) > 3


def test_rules_with_names_of_their_own_steps(spark, corpus):
    odd = corpus
    for name in ("_t", "_words", "_lang", "_c0", "_row", "row", "u0", "c1", "_key", "_common"):
        odd = odd.withColumn(name, F.lit("mine"))
    out = quality_rules.quality_rules(odd)
    assert out.columns[:len(odd.columns)] == odd.columns
    assert out.where(" AND ".join(f"{c} = 'mine'" for c in ("_t", "_words", "_lang", "_c0", "_row", "row", "u0", "c1", "_key", "_common"))).count() == corpus.count()
    kept = quality_rules.accepted(odd)
    assert kept.columns == odd.columns and {r._row for r in kept.collect()} == {"mine"}
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in quality_rules.accepted(corpus).collect()}


def test_line_dedup_by_site(spark):
    rows = [(k, f"menu\nown line {k}\nfooter", "a") for k in range(20)] + [(100 + k, f"rare {k}\nmenu", "small") for k in range(5)]
    rows += [(200 + k, "x\n" * (k % 2) + f"body {k}", "b") for k in range(12)] + [(300, None, "a"), (301, "", "a"), (302, "menu", None), (0, "menu\nsecond row", "a")]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, site STRING").withColumn("_bad", F.lit("clash")).withColumn("n_lines", F.lit("clash"))
    out = line_dedup.line_dedup(docs, "site")
    assert out.columns == ["doc_id", "text", "site", "_bad", "n_lines", "n_dropped"]
    got = sorted((r.doc_id, r.text, r.n_dropped) for r in out.where("doc_id <> 300").collect())
    assert (1, "own line 1", 2) in got and (0, "own line 0", 2) in got and (0, "second row", 1) in got
    assert (100, "rare 0\nmenu", 0) in got and (302, "menu", 0) in got and (301, "", 0) in got
    assert (201, "body 1", 1) in got and (202, "body 2", 0) in got
    assert out.where("doc_id = 300").first().text is None
    assert out.count() == len(rows)
    assert line_dedup.line_dedup(docs.limit(0), "site").collect() == []


def test_visible_lines_and_host(spark):
    page = "<html><script>var a='<p>';</script><P class=x>One <b>two</b></p><!-- no --><div> three\t four</div><br/></html>"
    r = spark.createDataFrame([(page, "HTTPS://User@Blog.Example.com:8080/a?b"), (None, None), ("", "nothing")], "h STRING, u STRING") \
        .select(line_dedup.visible_lines(F.col("h")).alias("t"), line_dedup.host_of(F.col("u")).alias("s")).collect()
    assert [tuple(x) for x in r] == [("One two\nthree four", "blog.example.com"), (None, None), ("", "")]


def level_targets(sizes: dict) -> dict:
    """Targets by sharing again and again."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(order)}
    capped: dict = {}
    while True:
        rest = sum(sizes.values()) - sum(capped.values())
        free = [s for s in order if s not in capped]
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return {**share, **capped}
        capped.update({s: 3 * sizes[s] for s in over})


@pytest.mark.parametrize("range_rows", [5, 10_000])
def test_mixing_targets_and_budgets(spark, corpus, range_rows):
    docs = corpus.unionByName(spark.createDataFrame([(500 + k, "word " * 30, "en", s, 0) for k in range(3) for s in ("tiny", "z")], DOCS))
    out = mixing.shares(docs, range_rows=range_rows).collect()
    assert len(out) == docs.count()
    sizes = Counter()
    for r in out:
        sizes[r.source] += r["size"]
    goal = level_targets(dict(sizes))
    taken = Counter()
    for r in out:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(goal[r.source])
        assert 0 <= r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - goal[s]) < 1
    again = sorted((str(r.i), r.taken) for r in mixing.shares(docs.repartition(5), range_rows=range_rows).collect())
    assert again == sorted((str(r.i), r.taken) for r in out)


def test_mixing_of_equal_keys_is_the_same_in_every_run(spark, monkeypatch):
    monkeypatch.setattr(mixing, "_KEY_DIGITS", 1)  # 16 keys for 300 documents
    rng = random.Random(18)
    docs = spark.createDataFrame([(k, prose(rng, rng.randint(1, 30)), rng.choice("ab")) for k in range(300)], "doc_id BIGINT, text STRING, source STRING")
    runs = [sorted((r.i, r.taken) for r in mixing.shares(docs.repartition(n, F.rand(n)), range_rows=100).collect()) for n in (1, 3, 7)]
    assert runs[0] == runs[1] == runs[2]


def test_mix_returns_whole_documents(corpus):
    out = mixing.mix(corpus)
    assert out.columns == corpus.columns
    texts = {(r.doc_id, r.text) for r in corpus.collect()}
    rows = out.collect()
    assert {(r.doc_id, r.text) for r in rows} <= texts
    assert max(Counter((r.doc_id, r.text) for r in rows if r.text).values()) <= 6  # three times each of two equal rows


def test_mixing_empty_and_wordless(spark):
    assert mixing.shares(spark.createDataFrame([], DOCS)).collect() == []
    out = mixing.shares(spark.createDataFrame([(1, None, None, "a", 0), (2, "  ", None, None, 0)], DOCS)).collect()
    assert [(r["size"], r.target, r.taken) for r in out] == [(0, 0.0, 0)] * 2


def test_fingerprints_follow_the_next_document(corpus):
    unique = corpus.dropDuplicates(["doc_id"])
    rows = sorted(fingerprints.op10_fingerprints(unique).collect())
    texts = dict((r.doc_id, r.text or "") for r in unique.collect())
    ids = sorted(texts)
    prints = {}
    for k, r in enumerate(rows):
        text, after = texts[r.doc_id], texts[ids[(k + 1) % len(ids)]]
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        assert (r.doc_id, r.n_chars) == (ids[k], len(text))
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert prints.setdefault(text, r.fingerprint) == r.fingerprint
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    long = [r for r in rows if r.doc_id < 60]
    assert sum(r.near_edited for r in long) > 5 * sum(r.near_next for r in long)


def test_fingerprints_with_repeated_and_null_ids(spark, corpus):
    docs = corpus.select("doc_id", "text", F.lit(1).alias("h"), F.lit(2).alias("next_id")).unionByName(
        spark.createDataFrame([(None, "alone in front", 1, 2), (63, "another text", 1, 2)], "doc_id BIGINT, text STRING, h INT, next_id INT"))
    rows = fingerprints.op10_fingerprints(docs).collect()
    assert len(rows) == docs.count()
    assert fingerprints.op10_fingerprints(docs.limit(0)).collect() == []
    one = fingerprints.op10_fingerprints(spark.createDataFrame([(7, "one two three")], "doc_id BIGINT, text STRING")).collect()
    assert one[0].edited_sha256 == hashlib.sha256(b"one two" + b"one tw").hexdigest()


def test_fingerprint_sees_order_and_occurrence(spark):
    rng = random.Random(2)
    words = [f"w{rng.randint(0, 400)}" for _ in range(300)]
    moved = words[150:] + words[:150]
    twice = " ".join(["a b c"] * 50)
    df = spark.createDataFrame([(" ".join(words), " ".join(moved), twice, "a b c", "x" * 500)], "a STRING, b STRING, c STRING, d STRING, e STRING")
    for c in "abcde":
        df = fingerprints.with_fingerprint(df, c, "f" + c)
    r = df.select(fingerprints.likeness(F.col("fa"), F.col("fb")).alias("moved"), F.col("fc") != F.col("fd"), F.col("fe")).first()
    assert 0.2 < r.moved < 1 and r[1] and r[2]


def test_fingerprint_counts_every_occurrence(spark):
    rng = random.Random(21)
    few, many = " ".join(["a b c"] * 3), " ".join(["a b c"] * 500)
    passages = [" ".join(f"w{rng.randint(0, 10 ** 6)}" for _ in range(20)) for _ in range(40)]
    other = passages[:]
    rng.shuffle(other)
    df = spark.createDataFrame([(few, many, " ".join(passages * 2), " ".join(other * 2), " ".join(p + " " + p for p in passages), " ".join(p + " " + p for p in other))],
                               "a STRING, b STRING, c STRING, d STRING, e STRING, f STRING")
    for c in "abcdef":
        df = fingerprints.with_fingerprint(df, c, "f" + c)
    r = df.select(fingerprints.likeness(F.col("fa"), F.col("fb")).alias("n"), fingerprints.likeness(F.col("fc"), F.col("fd")).alias("m"),
                  fingerprints.likeness(F.col("fe"), F.col("ff")).alias("d"), "fb").first()
    assert r.n < 0.5 and len(r.fb.split(",")) == 64
    assert r.m < 0.75 and r.d < 0.75


def edits(a: list, b: list) -> int:
    """Edit distance of two lists of words."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            above, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, above + (x != y))
    return row[-1]


@pytest.mark.parametrize("n", [20, 40, 80, 160])
def test_fingerprint_ranks_short_texts_as_the_edit_distance_does(spark, n):
    """Texts with ever more changed words, and one with its sentences in another order, whose words and pairs of
    words are nearly all the same: its likeness is low as its edit distance is high."""
    rng = random.Random(n)
    rows = []
    for case in range(30):
        words = [f"w{rng.randint(0, 10 ** 6)}" for _ in range(n)]
        sentences = [words[i:i + 5] for i in range(0, n, 5)]
        moved = sentences[:]
        while moved == sentences:
            rng.shuffle(moved)
        changed = [[f"x{k}" if k % every == 3 else w for k, w in enumerate(words)] for every in (n, 10, 5)]
        others = [*changed, sum(moved, [])]
        rows += [(case, k, " ".join(words), " ".join(o), edits(words, o)) for k, o in enumerate(others)]
    df = spark.createDataFrame(rows, "i INT, k INT, a STRING, b STRING, e INT")
    df = fingerprints.with_fingerprint(fingerprints.with_fingerprint(df, "a", "fa"), "b", "fb")
    got = df.groupBy("k").agg(F.avg(fingerprints.likeness(F.col("fa"), F.col("fb"))).alias("near"), F.avg("e").alias("e")).collect()
    near = {r.k: r.near for r in got}
    assert near[0] > near[1] > near[2]
    assert near[3] < 0.45 and near[3] < near[1]


def test_fingerprint_equals_a_plain_model(spark):
    """A bin's smallest hash of (k-mer, number) and the next one, in text order."""
    rng = random.Random(22)
    rows = [(k, " ".join(rng.choice("abcdefgh") for _ in range(rng.choice([0, 1, 2, 5, 60, 400])))) for k in range(12)]
    df = fingerprints.with_fingerprint(spark.createDataFrame(rows, "i INT, t STRING"), "t", "f")
    texts, got = dict(rows), {r.i: r.f for r in df.collect()}
    mers = [(i, tuple(w[j:j + 2])) for i, t in texts.items() for w in [t.split()] for j in range(len(w) - 1)]
    seen, keyed = Counter(), []
    for i, m in mers:
        keyed.append((i, *m, seen[i, m]))
        seen[i, m] += 1
    ranks = spark.createDataFrame([(p, *x) for p, x in enumerate(keyed)], "p INT, i INT, a STRING, b STRING, n INT") \
        .select("p", "i", F.xxhash64(F.xxhash64("a", "b"), "n").alias("h")).collect()
    of: dict = {}
    for r in ranks:
        of.setdefault(r.i, []).append((r.h, r.p))
    flat = []
    for i, e in of.items():
        e.sort()
        first = {}
        for j, (h, _) in enumerate(e):
            first.setdefault((h % 2 ** 64) >> 58, j)
        flat += [(i, b, [h for _, h in sorted({(p, h) for h, p in (e[j], e[(j + 1) % len(e)])})]) for b, j in first.items()]
    hashed = spark.createDataFrame(flat, "i INT, b INT, e ARRAY<BIGINT>").select("i", "b", F.concat(F.hex("b"), F.lit(":"), F.hex(F.xxhash64("e"))).alias("s"), F.col("e")[0].alias("h")).collect()
    for i, t in texts.items():
        if len(t.split()) >= 2:
            assert set(got[i].split(",")) == {r.s for r in hashed if r.i == i}
        else:
            assert (got[i] == "") == (t == "")
