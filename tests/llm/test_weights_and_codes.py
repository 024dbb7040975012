"""Personal data, importance resampling and vector codes against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from framewright.llm import importance, pii, vector_codes

DOCS = "doc_id BIGINT, text STRING, lang STRING, row BIGINT, `rank` STRING, `kind` STRING, copy STRING, `spans` STRING"


def rows(spark, texts):
    return spark.createDataFrame([(i, t, "en", -i if i is not None else None, "x", "y", "z", "s") for i, t in texts], DOCS).repartition(3)


# --- personal data -------------------------------------------------------------

RULES = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def doubled(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total


def strict(text):
    out = []
    for kind, rule in RULES.items():
        for m in re.finditer(rule, text):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")),
                  "card": 16 <= len(digits) <= 19 and doubled(digits) % 10 == 0, "phone": 8 <= len(digits) <= 15}[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_strict_spans_equal_the_rules():
    rng = random.Random(5)
    for _ in range(20_000):
        text = "".join(rng.choice(rng.choice(["a@.b", "0123456789", "12.3.+", "4 -()", "@ab.c-", "é \n"])) for _ in range(rng.randint(0, 60)))
        assert [f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in pii.strict_spans(text)] == strict(text), text


@pytest.mark.parametrize("piece", ["7", "1 ", "a@", "1.", "+1 ", "a.", "12 34 ", "x [at] "])
def test_spans_of_very_long_texts(piece):
    assert [f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in pii.strict_spans(piece * 300)] == strict(piece * 300)
    pii.strict_spans(piece * 150_000)
    pii.candidates(piece * 150_000)


def test_numbers_with_many_zeros():
    assert pii.strict_spans("0" * 5000 + ".0.0.0") == [(1, 0, 5006)]


def card(rng):
    head = "4" + "".join(rng.choice("0123456789") for _ in range(14))
    return next(head + c for c in "0123456789" if doubled(head + c) % 10 == 0)


@pytest.fixture(scope="module")
def private():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("aeinorst") for _ in range(rng.randint(3, 8)))
    out = []
    for i in range(400):
        words = [word() for _ in range(30)]
        some = [f"{word()}.{word()}@{word()}.example.com", ".".join(str(rng.randint(1, 254)) for _ in range(4)), card(rng),
                f"+{rng.randint(1, 99)} ({rng.randint(100, 999)}) 555-{rng.randint(1000, 9999)}", f"in {rng.randint(1900, 2030)}", f"no. {rng.randint(10, 99999)}"][i % 6]
        words.insert(10, some)
        out.append((i, " ".join(words)))
    out += [(1000, None), (1001, ""), (None, "mail a@b.org"), (7, out[7][1]), (7, out[7][1])]
    out += [(2000, "write to anna.stone [at] mail.example.org today"), (2001, "the host 10[.]1[.]22[.]3 failed"), (2002, f"cards {card(rng)} {card(rng)} given"),
            (2003, "We met at noon and again at four in 2021, see 4.0 and 3."), (2004, "call " + "x" * 50_000 + " me at a@b.example.com")]
    return out


def test_pii_strict_spans_stay_and_rewritten_ones_are_found(spark, private):
    got = pii.op11_pii(rows(spark, private)).collect()
    assert sorted(((r["doc_id"] is None, r["doc_id"] or 0) for r in got)) == sorted((i is None, i or 0) for i, _ in private)
    texts = dict(private)
    for r in got:
        base = strict(texts[r["doc_id"]] or "")
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in RULES] == [sum(s.startswith(k) for s in base) for k in RULES]
        assert set(base) <= set(r["spans"].split(",")) | set([] if base else [""])
    spans = {r["doc_id"]: r["spans"] for r in got}
    assert spans[2000] == "email:9:41" and spans[2001] == "ip:9:24"
    assert len(spans[2002].split(",")) == 2 and spans[2003] == "" and spans[1000] == "" and spans[1001] == ""
    plain = [i for i, t in private if i is not None and i < 400 and i % 6 > 3]
    assert not any(spans[i] for i in plain)


def test_redacted_texts_hold_no_strict_span(spark, private):
    docs = rows(spark, private)
    out = pii.redact(docs)
    assert out.columns == docs.columns and out.count() == len(private)
    for r in out.collect():
        assert (r["text"] is None) == (r["doc_id"] == 1000)
        assert not strict(r["text"] or "")
        assert (r["rank"], r["copy"], r["spans"]) == ("x", "z", "s")
    assert {r["doc_id"]: r["text"] for r in out.collect()}[2001] == "the host <IP> failed"


def test_pii_learns_from_every_document_and_every_span(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(pii, "fit", lambda texts: (seen.append(texts.count()), (None, {}))[1])
    docs = rows(spark, [(i, f"write to a{i}@b.org") for i in range(3050)] + [(0, "write to a0@b.org"), (-1, "nothing here")])
    assert pii.find_spans(docs).count() == 3052 and seen == [3050]
    strict_rows = [x for x, label in pii.training_rows(", ".join(f"a{i}@b.org" for i in range(90))) if label == 1]
    assert len(strict_rows) >= 90
    assert sum(label == 0 for _, label in pii.training_rows(", ".join(f"1.2.3.{i}" for i in range(300, 390)))) >= 90


def test_pii_without_rows_or_candidates(spark):
    assert pii.op11_pii(rows(spark, []).limit(0)).collect() == []
    got = pii.op11_pii(rows(spark, [(1, "nothing here"), (2, "a@b.org")])).collect()
    assert sorted((r["doc_id"], r["spans"]) for r in got) == [(1, ""), (2, "email:0:7")]


# --- importance ----------------------------------------------------------------

def plain_importance(docs, target, buckets=10_000):
    def found(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        return len(words), [zlib.crc32(" ".join(words[i:i + k]).encode()) % buckets for i in range(len(words)) for k in (1, 2, 3) if i + k <= len(words)]

    runs = [found(t) for _, t in docs]
    s, t = Counter(b for _, f in runs for b in f), Counter(b for x in target for b in found(x)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets))))
    out = []
    for (i, _), (n, f) in zip(docs, runs):
        h = int(hashlib.sha256(f"42:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, f))
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    eligible = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k in range(5 * len(eligible) // 100):
        eligible[k][4] = k + 1
    return [tuple(r[:5]) for r in out]


def prose(rng, n):
    return "".join(rng.choice(["the ", "of ", "Étoile ", "a1 ", "x-y\n", "und, ", "".join(rng.choice("abcdEFG") for _ in range(rng.randint(1, 6))) + " "]) for _ in range(n))


def test_runs_follow_from_prefixes():
    rng = random.Random(2)
    texts = [prose(rng, n) for n in (0, 1, 2, 3, 50)] + ["x" * 300 + " y " + "z" * 70_000 + " w"]
    for text in texts:
        crcs, ends = importance.prefixes(text)
        first = np.zeros(len(crcs), bool)
        first[:1] = True
        got, _ = importance.runs(np.array(crcs, np.uint32), np.array(ends, np.int64), first, 3)
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate({c: c + 32 for c in range(65, 91)}))
        assert got.tolist() == [zlib.crc32(" ".join(words[i:i + k]).encode()) for i in range(len(words)) for k in (1, 2, 3) if i + k <= len(words)]


def test_importance_equals_brute_force(spark):
    rng = random.Random(4)
    texts = [(i, prose(rng, rng.randint(0, 80))) for i in range(300)]
    texts += [(400, None), (401, ""), (402, " .,"), (None, prose(rng, 60)), (5, texts[5][1]), (403, "w" * 200_000 + " " + prose(rng, 3000))]
    aim = [prose(rng, 30) for _ in range(10)] + [None, ""]
    target = spark.createDataFrame([(k, t) for k, t in enumerate(aim)], "item_id BIGINT, text STRING")
    got = importance.op12_importance(rows(spark, texts), target)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    key = lambda r: (r[0] is None, r[0] or 0, r[4] or 0)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(plain_importance(texts, aim), key=key)
    drawn = importance.resample(rows(spark, texts), target)
    assert sorted(r["doc_id"] for r in drawn.collect()) == sorted(r[0] for r in plain_importance(texts, aim) if r[4])
    assert drawn.columns == rows(spark, texts).columns


def test_importance_of_empty_tables(spark):
    empty = spark.createDataFrame([], "item_id BIGINT, text STRING")
    assert importance.op12_importance(rows(spark, []).limit(0), empty).collect() == []
    got = importance.op12_importance(rows(spark, [(1, "a b c")]), empty).collect()
    assert [tuple(r) for r in got] == plain_importance([(1, "a b c")], [])


# --- vector codes --------------------------------------------------------------

def plain_codes(vectors, parts=16, entries=64, rounds=2):
    kept = [(i, v, label) for i, v, label in vectors if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    d = max(1, -(-max((len(v) for _, v, _ in kept), default=0) // parts))
    ints = [[math.floor(256 * x) for x in v] + [0] * (d * parts - len(v)) for _, v, _ in kept]
    x = np.array(ints, np.int64).reshape(len(kept), parts, d)
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0))[:entries]
    books = x[order].transpose(1, 0, 2).copy()
    near = lambda: ((x[:, :, None] - books[None]) ** 2).sum(3)
    for _ in range(rounds):
        found = near().argmin(2)
        for p in range(parts):
            for e in range(books.shape[1]):
                mine = x[found[:, p] == e, p]
                if len(mine):
                    books[p, e] = mine.sum(0) // len(mine)
    distance = near()
    error = distance.min(2).sum(1)
    by_label = Counter()
    for (_, _, label), e in zip(kept, error):
        by_label[label] += int(e)
    sha = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    return [(i, "".join(f"{c:02x}" for c in code), int(e), by_label[label], sha) for (i, _, label), code, e in zip(kept, distance.argmin(2), error)]


VECTORS = "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT, _salt STRING, error STRING"


def vectors(spark, some):
    return spark.createDataFrame([(i, v, label, "s", "e") for i, v, label in some], VECTORS).repartition(3)


def test_dual_tree_equals_full_search():
    rng = np.random.default_rng(1)
    for trial in range(30):
        n, k, d, s = int(rng.integers(1, 600)), int(rng.integers(1, 65)), int(rng.integers(1, 5)), int(rng.choice([2, 6, 100]))
        points, books = rng.integers(-s, s + 1, (3, n, d)), rng.integers(-s, s + 1, (3, k, d))
        if trial % 5 == 0:
            points[:] = points[:, :1]
        full = ((points[:, :, None] - books[:, None]) ** 2).sum(3)
        codes, errors = vector_codes.assign(points, books, vector_codes.entry_tree(books))
        assert (codes == full.argmin(2)).all() and (errors == full.min(2)).all()
        total, count = vector_codes.entry_sums(iter([points]), books)
        for p in range(3):
            assert (count[p] == np.bincount(codes[p], minlength=k)).all()
            assert all((total[p, e] == points[p][codes[p] == e].sum(0)).all() for e in range(k))


def test_whole_nodes_are_assigned_where_entries_are_far_apart():
    rng = np.random.default_rng(2)
    books = np.arange(8)[None, :, None] * 1000
    points = (rng.integers(0, 8, (1, 2000, 1)) * 1000 + rng.integers(-50, 50, (1, 2000, 1)))
    tree = vector_codes._point_tree(points)
    _, count = zip(*tree.sums())
    whole = sum(int(count[level][nodes].sum()) for kind, level, nodes, _ in vector_codes.dual_assign(tree, vector_codes.entry_tree(books)) if kind == "node")
    assert whole > 0.9 * 2000


@pytest.mark.parametrize("size", [64, 50])
def test_codes_equal_brute_force(spark, size):
    rng = np.random.default_rng(3)
    some = [(i, np.float32(rng.normal(0, .2, size)).tolist(), i % 3 if i % 7 else None) for i in range(500)]
    some += [(600, None, 1), (601, [0.1] * (size - 1) + [None], 1), (602, [float("nan")] + [0.0] * (size - 1), 1), (603, [float("inf")] * size, 2)]
    some += [(700 + k, some[3][1], 9) for k in range(120)]
    got = vector_codes.op13_vector_codes(vectors(spark, some))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.collect())) == sorted(plain_codes(some))
    codes, books = vector_codes.compress(vectors(spark, some))
    assert books.shape == (16, 64, 4)
    row = codes.where("vec_id = 5").first()
    off = np.array([math.floor(256 * x) for x in some[5][1]] + [0] * (64 - size)) - np.array(vector_codes.decoded(row["code"], books))
    assert (off * off).sum() == row["error"]


def test_codes_of_few_empty_and_repeated_rows(spark):
    assert vector_codes.op13_vector_codes(vectors(spark, [])).collect() == []
    assert vector_codes.op13_vector_codes(vectors(spark, [(1, None, 2)])).collect() == []
    some = [(1, [0.5] * 16, 1), (1, [0.5] * 16, 1), (None, [-0.5] * 16, None), (2, [], 1), (3, [1e30] * 16, 1)]
    got = vector_codes.op13_vector_codes(vectors(spark, some)).collect()
    assert len(got) == 5 and {r["error"] for r in got} == {0}
