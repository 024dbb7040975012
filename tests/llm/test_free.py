"""Operators with Python in their tasks, and the pipeline, against brute force."""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import random
import re
import string
import zlib
from array import array
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from framewright.llm import ngram_join, packing, storage, substring_dedup, token_store, tokens, toxicity, warc, wordhash
from framewright.llm.components import connected_components
from framewright.llm.queries import tokenizer_path

DOCS = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def prose(rng: random.Random, n: int) -> str:
    out = []
    for k in range(n):
        word = rng.choice(["the", "of", "and"]) if rng.random() < 0.3 else "".join(rng.choice("abcdefghilmnoprstué") for _ in range(rng.randint(3, 9)))
        out.append(word + rng.choice(["", "", "", ",", ".", ".\n"]))
    return " ".join(out)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(9)
    base = [prose(rng, rng.randint(60, 150)) for _ in range(30)]
    passage = prose(rng, 70)
    near = base[0].split(" ")
    near[20] = "changed"
    rows = list(enumerate(base))
    rows += [(30, base[1]), (31, " ".join(near)), (32, None), (33, ""), (34, " \n"), (35, "one two"), (36, "One  two"), (37, prose(rng, 3000)),
             (38, base[2] + " " + passage + " " + base[3]), (39, base[4] + " and then " + passage + " so " + base[5]), (40, base[1].translate(str.maketrans(string.ascii_lowercase, string.ascii_uppercase)))]
    return rows


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in texts], DOCS).repartition(5)


@pytest.fixture(scope="module")
def ids():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids + [0]


def test_encoder_equals_the_library(ids):
    rng = random.Random(3)
    signs = ["a", "b", " ", " ", "\n", ",", "'s", "　", "1", "é", ".", "\x1c", "\x85", "中", "\xa0", "᠎", "​", "\t", "!", "²", "\0", "<|endoftext|>"]
    some = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 25))) for _ in range(3000)] + ["x" * 200 + " y", None]
    got = tokens.Encoder(tokenizer_path()).encode(some)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [ids(t)[:-1] for t in some]


def test_wordhash_words_and_shingles():
    import pyarrow as pa

    some = ["A b\tc  d", None, "", "d c b a", "x" * 10]
    found = {row: [some[row].encode()[a:b] for a, b in zip(s, e)] for row, s, e, _ in wordhash.text_words(pa.array(some))}
    assert found == {0: [b"A", b"b", b"c", b"d"], 1: [], 2: [], 3: [b"d", b"c", b"b", b"a"], 4: [b"x" * 10]} or found[0] == [b"A", b"b", b"c", b"d"]
    h = {row: x for row, _, _, x in wordhash.text_words(pa.array(["a b c", "c b a", "A b c"]), lower=True)}
    assert wordhash.shingles(h[0], 3) == wordhash.shingles(h[2], 3) != wordhash.shingles(h[1], 3)
    assert len(wordhash.shingles(h[0], 5)) == 1


def test_components_of_paths_hubs_and_nothing(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 60)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src BIGINT, dst BIGINT")).collect()}
    assert got == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 160)}}
    assert connected_components(spark.createDataFrame([], "src BIGINT, dst BIGINT")).collect() == []


def brute_components(texts, width=4, percent=85):
    sets, parent = {}, {}
    for i, t in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets[i] = {tuple(words[k:k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()
        parent[i] = i

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_ngram_join_equals_all_pairs(docs, texts):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.op4_ngram_join(docs.withColumn("c", F.lit("clash"))).collect()}
    assert got == brute_components(texts)


def test_ngram_join_of_many_near_copies(spark):
    rng = random.Random(4)
    base = prose(rng, 90).split(" ")
    rows = []
    for i in range(120):
        words = list(base)
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = f"w{rng.randint(0, 10 ** 6)}"
        rows.append((i, " ".join(words)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id BIGINT, text STRING")).collect()}
    assert got == brute_components(rows)


def test_ngram_join_empty_and_null_ids(spark):
    empty = spark.createDataFrame([], DOCS)
    assert ngram_join.ngram_join(empty).collect() == []
    rows = [(None, "a b c d e"), (None, None), (5, "a b c d e"), (5, "other words here now"), (9, "a b c d e")]
    got = Counter((r.doc_id, r.component_id) for r in ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id BIGINT, text STRING")).collect())
    assert got == Counter([(None, 5), (None, None), (5, 5), (5, 5), (9, 5)])


def test_substring_dedup_finds_planted_copies(docs, texts):
    copies = substring_dedup.substring_dedup(docs)
    rows = copies.collect()
    flagged = {r.doc_id for r in rows}
    assert {1, 30, 40, 0, 31, 38, 39} <= flagged
    assert not flagged & ({6, 7, 8, 9, 37, 32, 33, 34, 35, 36} | set(range(10, 30)))
    kept = Counter((r.kind, r.class_id) for r in rows if r.kept)
    assert all(n == 1 for n in kept.values()) and set(kept) == {(r.kind, r.class_id) for r in rows}
    again = dict((r.doc_id, r.text) for r in substring_dedup.remove_copies(docs, copies).collect())
    assert len(again) == len(texts) and again[1] == dict(texts)[1] and len((again[30] or "").split()) < 15 and again[32] is None


def test_substring_dedup_near_lines_equal_brute_force(spark):
    rng = random.Random(8)
    lines = []
    for k in range(25):
        words = ["".join(rng.choice("abcdef") for _ in range(6)) for _ in range(60)]
        other = list(words)
        for j in range(k % 5):
            other[7 + 12 * j] = "zz"
        lines.append((" ".join(words), " ".join(other)))
    rows = [(2 * k + side, pair[side]) for k, pair in enumerate(lines) for side in (0, 1)]
    found = substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id BIGINT, text STRING")).where("kind = 'line'").collect()
    groups = defaultdict(set)
    for r in found:
        groups[r.class_id].add(r.doc_id)

    def grams(t):
        w = t.split()
        return {tuple(w[k:k + 5]) for k in range(len(w) - 4)}
    want = {frozenset((2 * k, 2 * k + 1)) for k, (a, b) in enumerate(lines) if len(grams(a) & grams(b)) >= 0.8 * len(grams(a) | grams(b))}
    assert {frozenset(g) for g in groups.values()} == want


def test_substring_dedup_edges(spark):
    assert substring_dedup.substring_dedup(spark.createDataFrame([], DOCS)).collect() == []
    text = " ".join(f"word{k}" for k in range(60))
    df = spark.createDataFrame([(1, text), (1, text), (None, text), (2, None)], "doc_id BIGINT, text STRING")
    assert substring_dedup.substring_dedup(df).collect() == []
    bands, rows = substring_dedup.tune(0.8, 0.98)
    assert 1 - (1 - 0.8 ** rows) ** bands >= 0.98


def test_substring_dedup_finds_wrapped_paragraphs(spark):
    def new(name, n):
        return [f"{name}{k}" for k in range(n)]

    def wrapped(words, width):
        return "\n".join(" ".join(words[k:k + width]) for k in range(0, len(words), width))

    par = new("par", 180)
    other = [f"{w}x" if k in (14, 74, 120) else w for k, w in enumerate(par)]
    long = new("long", 100)
    rows = [(1, f"{wrapped(new('a', 30), 10)}\n\n{wrapped(par, 9)}\n \n{wrapped(new('b', 30), 10)}"),
            (2, f"{wrapped(new('c', 30), 10)}\n\n{wrapped(other, 11)}\n\n{wrapped(new('d', 30), 10)}"),
            (3, f"{wrapped(new('head', 3), 3)}\n{wrapped(long, 100)}\nlast line"), (4, wrapped(long, 100))]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    copies = substring_dedup.substring_dedup(docs).where("kind = 'line'")
    got = sorted((r.doc_id, r.start_word, r.n_words, r.kept) for r in copies.collect())
    assert [g for g in got if g[0] < 3] == [(1, 30, 180, True), (2, 30, 180, False)]
    left = {r.doc_id: (r.text or "").split() for r in substring_dedup.remove_copies(docs, copies).collect()}
    assert left[1] == rows[0][1].split() and left[2] == new("c", 30) + new("d", 30)
    assert left[3] == rows[2][1].split() and left[4] == []


def test_substring_dedup_keeps_a_copy_of_every_word(spark):
    rng = random.Random(12)
    quote = [f"quoted{k}" for k in range(60)]
    long = [f"own{k}" for k in range(230)] + quote + [f"other{k}" for k in range(230)]
    some = [[f"z{k}x{rng.randint(0, 9 ** 9)}" for k in range(30)] for _ in range(3)]
    rows = [(1, " ".join(some[0] + quote + some[1])), (2, " ".join(long)), (5, " ".join(long)), (7, " ".join(some[2]))]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    copies = substring_dedup.substring_dedup(docs).where("kind = 'passage'")
    texts = {i: t.split() for i, t in rows}
    words = defaultdict(set)
    for r in copies.collect():
        words[r.class_id].add(" ".join(texts[r.doc_id][r.start_word:r.start_word + r.n_words]))
    assert words and all(len(w) == 1 for w in words.values())
    left = {r.doc_id: (r.text or "").split() for r in substring_dedup.remove_copies(docs, copies).collect()}
    assert set().union(*left.values()) == set().union(*texts.values())
    assert left[1] == texts[1] and left[5] == [] and len(left[2]) >= 460


def fresh(rng, n):
    return [f"{rng.choice('abcdefgh')}{rng.randint(0, 10 ** 6)}" for _ in range(n)]


def test_substring_dedup_passages_inside_lines(spark):
    """Passages copied into the middle of a line, as they are or with one word changed, are found to their ends."""
    rng = random.Random(77)
    kinds = {(51, False): 60, (51, True): 60, (70, True): 30, (30, False): 30}
    rows, place = [], {}
    for (n, changed), many in kinds.items():
        for _ in range(many):
            passage = fresh(rng, n)
            copy = list(passage)
            if changed:
                copy[rng.randrange(n)] = "changed"
            for words in (passage, copy):
                before = rng.randint(30, 60)
                place[len(rows)] = (n, changed, before)
                rows.append((len(rows), " ".join(fresh(rng, before) + words + fresh(rng, rng.randint(100, 140)))))
    found = defaultdict(list)
    for r in substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id BIGINT, text STRING")).where("kind = 'passage'").collect():
        found[r.doc_id].append(r)
    share, words = Counter(), Counter()
    for doc, (n, changed, before) in place.items():
        covered = {k for r in found[doc] for k in range(r.start_word, r.start_word + r.n_words)}
        assert all(before <= k < before + n for k in covered)
        classes = {r.class_id for r in found[doc]}
        share[n, changed] += bool(covered) and classes == {r.class_id for r in found[doc ^ 1]}
        words[n, changed] += len(covered) / n
    share, words = ({k: v[k] / (2 * m) for k, m in kinds.items()} for v in (share, words))
    assert min(share.values()) >= 0.9, (share, words)
    assert words[51, False] >= 0.95 and words[51, True] >= 0.85, (share, words)


def test_substring_dedup_passages_are_as_similar_as_asked():
    """Against the exact Jaccard similarity of the words' shingles, whatever stands on the two sides."""
    def grams(w):
        return {tuple(w[k:k + 5]) for k in range(len(w) - 4)}

    rng = random.Random(5)
    wide = 0
    for _ in range(400):
        core = [rng.random() for _ in range(16)]

        def sides():
            a = [rng.random() for _ in range(rng.randint(0, 40))]
            b = list(a)
            for _ in range(rng.randint(0, 4)):
                at = rng.randint(0, len(b))
                b[at:at + rng.randint(0, 2)] = [rng.random() for _ in range(rng.randint(0, 2))]
            return a, b

        (la, lb), (ra, rb) = sides(), sides()
        x0, y0, x1, y1 = substring_dedup._reach(substring_dedup._onward(la, lb), substring_dedup._onward(ra, rb), 16, 0.8)
        a, b = la[:x0][::-1] + core + ra[:x1], lb[:y0][::-1] + core + rb[:y1]
        assert len(grams(a) & grams(b)) >= 0.8 * len(grams(a) | grams(b))
        exact = [next((k for k, (p, q) in enumerate(zip(s, t)) if p != q), min(len(s), len(t))) for s, t in ((la, lb), (ra, rb))]
        assert x0 >= exact[0] and x1 >= exact[1]
        wide += a != b
    assert wide > 50


@pytest.mark.parametrize("fan_in", [2, 64])
def test_packing_covers_every_id_once(docs, texts, ids, fan_in):
    rows = packing.pack(docs.withColumn("offset", F.lit("clash")), tokenizer_path(), window=64, most_open=3, fan_in=fan_in).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, t in texts:
        own, at = ids(t), 0
        for r in sorted(pieces.pop(i), key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(own) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(np.array(own[at:at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(own)
    assert not pieces
    padding = 0
    for placed in sequences.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 64
        padding += 0 if at & (at - 1) == 0 else 64 - at
    assert padding == 0


def test_packing_empty_and_repeated_rows(spark, ids):
    assert packing.pack(spark.createDataFrame([], DOCS), tokenizer_path()).collect() == []
    rows = packing.pack(spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], "doc_id BIGINT, text STRING"), tokenizer_path()).collect()
    assert sum(r.length for r in rows) == 2 * len(ids("a b")) + 1
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([], DOCS), tokenizer_path(), window=100)


def test_token_store_round_trip(spark, docs, texts, ids, tmp_dir):
    index = token_store.write_tokens(docs.withColumn("shard", F.lit("clash")), tokenizer_path(), "file://" + tmp_dir + "/t", shard_tokens=500)
    at = 0
    got = {r.doc_id: r for r in token_store.read_tokens(index).collect()}
    for i, t in sorted(texts):
        assert (got[i].start, got[i].n_tokens, list(got[i].ids)) == (at, len(ids(t)), ids(t))
        at += len(ids(t))
    digests = {r.doc_id: r.ids_crc32 for r in token_store.token_digests(index).collect()}
    assert digests == {i: zlib.crc32(np.array(ids(t), "<u4").tobytes()) for i, t in texts}


def test_token_codes_are_directly_addressable(tmp_dir):
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.integers(0, 300, 3000), [0, 255, 256, 65535, 65536, 2 ** 24, 2 ** 32 - 1], rng.integers(0, 2 ** 32, 50)]).astype("<u4")
    shard = token_store.ShardWriter("file://" + tmp_dir + "/s/x.dac")
    shard.add(values.tobytes())
    shard.close()
    reader = token_store.ShardReader("file://" + tmp_dir + "/s/x.dac")
    for k in [0, 1, 511, 512, 513, 2999, 3000, 3004, 3006, len(values) - 1]:
        assert reader[k] == values[k]
    for a, n in [(0, len(values)), (500, 30), (2990, 60), (7, 0)]:
        assert reader.ids(a, n).tolist() == values[a:a + n].tolist()
    with pytest.raises(IndexError):
        reader.ids(0, len(values) + 1)


def test_token_store_of_an_empty_table(spark):
    assert token_store.op7_token_store(spark.createDataFrame([], DOCS), tokenizer_path()).collect() == []


def test_warc_round_trip(spark, tmp_dir):
    pages = [(k, f"http://h{k % 3}.org/{k}", f"<p>page {k % 7}</p>" * (1 + k % 7)) for k in range(40)] + [(40, None, None), (41, "u\r\nv", ""), (None, "x", "only"), (50, "y", "only")]
    df = spark.createDataFrame(pages, "page_id BIGINT, url STRING, html STRING").withColumn("digest", F.lit("clash")).repartition(3)
    index = warc.write_warc(df, "file://" + tmp_dir + "/w", max_file_bytes=2000)
    got = {r.page_id: r for r in warc.read_warc(index).collect()}
    first = {}
    for i, _, html in sorted((p for p in pages if p[0] is not None)):
        first.setdefault(html or "", i)
    for i, url, html in pages:
        payload, r = (html or "").encode(), got[i]
        original = first.get(html or "", i)
        revisit = i is not None and original != i
        assert (r.payload_bytes, r.payload_digest) == (len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode())
        assert (r.record_type, r.refers_to) == (("revisit", original) if revisit else ("response", None))
        assert r.payload == (None if revisit else payload)
    one = index.where("page_id = 5").first()
    with open(one.file.removeprefix("file://"), "rb") as f:
        f.seek(one.offset)
        assert gzip.decompress(f.read(one.length)).startswith(b"WARC/1.1\r\nWARC-Type: response\r\n")
    assert [r.page_id for r in warc.read_warc(warc.select_records(index, F.col("url").startswith("http://h1.org/4"))).collect()] == [4]
    assert warc.op6_warc(df.limit(0)).collect() == []


def test_ranges_are_coalesced():
    assert warc.coalesced([(0, 10), (10, 5), (40, 5), (500, 1)], gap=30, most=50) == [(0, 45, 3), (500, 501, 1)]
    assert warc.coalesced([(0, 100), (100, 100)], gap=0, most=50) == [(0, 100, 1), (100, 200, 1)]
    assert warc.coalesced([]) == []


def test_toxicity_learns_from_training_rows_only(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for k in range(700):
        words = prose(rng, rng.randint(40, 120)).split(" ")
        bad = k % 6 == 0
        for _ in range(rng.randint(2, 5) * bad):
            words.insert(rng.randrange(len(words)), rng.choice(["dolt", "nitwit", "you dolt", "lout"]))
        rows.append((k, " ".join(words)))
        labels.append((k, int(bad) if zlib.crc32(str(k).encode()) % 4 != 2 else 1 - int(bad), None))
    docs = spark.createDataFrame(rows + [(900, None), (901, ""), (None, "some words")], "doc_id BIGINT, text STRING").withColumn("label", F.lit("clash"))
    out = {r.doc_id: r for r in toxicity.score_toxicity(docs, spark.createDataFrame(labels + [(3, None, None)], "doc_id BIGINT, toxic INT, quality INT")).collect()}
    assert len(out) == 703
    held = [r for i, r in out.items() if i is not None and i < 700 and r.held_out]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in out.items() if i is not None)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out.values())
    assert sum(r.predicted == int(r.doc_id % 6 == 0) for r in held) >= 0.95 * len(held)


@pytest.mark.parametrize("word", ["i.d.i.o.t", "i_d_i_o_t", "i-d-i-o-t", "i.d_i-o.t", "id1ot", "idi0t"])
def test_toxicity_sees_every_hidden_spelling(word):
    at = {f: k for k, f in enumerate(toxicity.FEATURES)}
    found = toxicity.features(f"what an {word} you are.", {b"idiot": 4.0})
    assert (found[at["hidden"]], found[at["hidden_hits"]]) == (1 / len(f"what an {word} you are.".encode().translate(toxicity._SPLIT).split()), 1.0)
    plain = toxicity.features("what a day. so it is.", {b"idiot": 4.0})
    assert plain[at["hidden"]] == plain[at["hidden_hits"]] == 0


def test_toxicity_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id BIGINT, text STRING")
    none = spark.createDataFrame([], "doc_id BIGINT, toxic INT")
    assert sorted((r.doc_id, r.score, r.predicted) for r in toxicity.score_toxicity(docs, none).collect()) == [(1, 0.0, 0), (2, 0.0, 0)]
    assert toxicity.score_toxicity(docs.limit(0), none).collect() == []


def test_pipeline_links_at_five_words_and_four_fifths(spark):
    words = [f"w{k}" for k in range(200)]
    near, far = list(words), list(words)
    for k in range(20, 200, 50):
        near[k] = f"near{k}"
    for k in range(10, 200, 35):
        far[k] = f"far{k}"
    rows = [(1, " ".join(words), "en", "s", 0), (2, " ".join(near), "en", "s", 0), (3, " ".join(far), "en", "s", 0)]
    assert [c for _, c in brute_components([r[:2] for r in rows]).values()] == [1, 2, 3]
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, DOCS), "")
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3]


def test_pipeline_keeps_rows_not_ids(spark):
    """A copy goes though its id has another text, and that text stays; rows of one id that are near copies are one."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(100)) for x in "abc")
    rows = [(3, a, "en", "s", 0), (5, a, "en", "s", 0), (5, b, "en", "s", 0), (7, c, "en", "s", 0), (7, c + " end", "en", "s", 0), (9, None, "en", "s", 0),
            (9, "", "en", "s", 0), (9, "", "en", "s", 0), (None, b, "en", "s", 0), (None, "x y z", "en", "s", 0)]
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, DOCS).withColumn("digest", F.lit("mine")), "")
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert set(got) - {(7, c), (7, c + " end")} == {(3, a), (5, b), (9, None), (9, ""), (None, "x y z")}
    assert len(got) == len(set(got)) == 6 and kept.columns[-1] == "digest"


def test_pipeline_run_and_empty_tables(spark, docs, texts, ids, tmp_dir):
    """run() is its stages one after another, each over all that the one before kept; nothing comes of nothing."""
    docs.write.parquet(tmp_dir + "/documents.parquet")
    out = corpus_pipeline.run(spark, tmp_dir).collect()
    now = docs
    for _, function in corpus_pipeline.STAGES[:-1]:
        now = function(spark, now, "")
    now = now.collect()
    want = Counter()
    for r in now:
        want[r.doc_id] += len(ids(r.text))
    got = Counter()
    for r in out:
        got[r.doc_id] += r.length
    assert got == want and len(got) > 20
    for k, (_, function) in enumerate(corpus_pipeline.STAGES):
        none = function(spark, docs.limit(0), "")
        assert none.collect() == [] and (k == 4 or none.columns == docs.columns)


def test_shared_folder_is_required_on_a_cluster():
    class Conf:
        def get(self, name, default):
            return default

    class Session:
        conf = Conf()
        sparkContext = type("Context", (), {"master": "spark://somewhere:7077"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_dir(Session())


def test_copies_are_removed_beside_clashing_columns(spark, docs):
    odd = docs.withColumn("_doc", F.lit("mine")).withColumn("_spans", F.lit("mine"))
    out = substring_dedup.remove_copies(odd, substring_dedup.substring_dedup(docs))
    assert out.columns == odd.columns and out.count() == docs.count() and {(r._doc, r._spans) for r in out.collect()} == {("mine", "mine")}


def test_other_vocabularies_are_encoded_as_a_whole(tmp_path):
    """A file with a normalizer or another rule of words gives the library's ids, too."""
    spec = json.load(open(tokenizer_path()))
    made = {"lower": {**spec, "normalizer": {"type": "Lowercase"}}, "space": {**spec, "pre_tokenizer": {**spec["pre_tokenizer"], "add_prefix_space": True}},
            "plain": {**spec, "pre_tokenizer": {**spec["pre_tokenizer"], "use_regex": False}}}
    some = ["One Two  three", "", "a\nB, c.", None, "don't stop 12345"]
    for name, s in made.items():
        (tmp_path / name).write_text(json.dumps(s))
        library = Tokenizer.from_file(str(tmp_path / name))
        encoder = tokens.Encoder(str(tmp_path / name))
        assert not encoder.by_words
        assert [array("I", x).tolist() for x in encoder.encode(some)] == [library.encode(t or "", add_special_tokens=False).ids for t in some]
    assert tokens.Encoder(tokenizer_path()).by_words


def test_pipeline_equals_brute_force(spark, docs, texts, ids):
    """Each stage on its own input: what it keeps, in the columns of documents."""
    now = docs
    for name, function in corpus_pipeline.STAGES:
        out = function(spark, now, "")
        if name != "packing":
            assert out.columns == docs.columns
        rows = out.collect()
        before = now.collect()
        if name == "quality_rules":
            assert {r.doc_id for r in rows} >= set(range(30)) and not {r.doc_id for r in rows} & {32, 33, 34, 35, 36}
        elif name == "line_dedup":
            assert {r.doc_id for r in rows} == {r.doc_id for r in before} and all(r.n_chars == len(r.text) for r in rows)
        elif name == "ngram_join":
            of = brute_components([(r.doc_id, r.text) for r in before])
            assert sorted(r.doc_id for r in rows) == sorted(i for i, (_, c) in of.items() if i == c)
        elif name == "mixing":
            assert {tuple(r) for r in rows} <= {tuple(r) for r in before} and max(Counter(r.doc_id for r in rows).values()) <= 3
        else:
            want = Counter()
            for r in before:
                want[r.doc_id] += len(ids(r.text))
            got = Counter()
            for r in rows:
                got[r.doc_id] += r.length
            assert got == want
        now = spark.createDataFrame(before if not rows else rows, out.schema)
