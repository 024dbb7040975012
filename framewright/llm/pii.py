"""Personal data by candidate gradient boosting.

Generators propose spans, also loose and overlapping ones: addresses spelled with
"[at]" and "dot", IP numbers with bracketed dots, card numbers inside longer digit
runs or with unusual separators, phone numbers without their plus. Boosted trees
judge a candidate by format and context. They learn from every document with
candidates: the spans of strict rules, rewritten spellings of these in their own
context, spans broken on purpose, and the candidates that no reading makes valid.
A calibration part of these documents turns scores into probabilities and picks each
kind's threshold; spans of the strict rules always stay.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.llm.storage import stage
from framewright.llm.text_expr import free_name, whole

KINDS = ("email", "ip", "card", "phone")
TRAIN_BATCH = 10_000  # training rows a task holds at once
TREES = 20
DEPTH = 4
PRECISION = 0.98  # of a kind's accepted candidates in the calibration part, at least
LEAST = 0.9  # calibrated probability of an accepted candidate, at least
CONTEXT = 60  # characters on either side that features look at

# --- fixed values: strict rules -----------------------------------------------
EMAIL_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
EMAIL_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
# ------------------------------------------------------------------------------

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGIT = re.compile(r"[0-9]")
_AT = re.compile(r"@|[\[({<] ?[aA][tT] ?[\])}>]| [aA][tT] (?=[A-Za-z0-9-]{1,64} ?(?:[\[({<] ?[dD][oO][tT] ?[\])}>]|[dD][oO][tT] ))")
_DOT = r"(?:\.|(?: ?[\[({<] ?[dD][oO][tT] ?[\])}>] ?)| [dD][oO][tT] | ?\[\.\] ?)"
_LOOSE_LOCAL = re.compile(r"[A-Za-z0-9%+-][A-Za-z0-9._%+-]{0,63} ?\Z")
_LOOSE_HOST = re.compile(rf" ?[A-Za-z0-9-]{{1,64}}(?:{_DOT}[A-Za-z0-9-]{{1,64}}){{1,6}}")
_LOOSE_IP = re.compile(r"(?<![0-9])[0-9]{1,4}(?:(?: ?\[ ?\.? ?\] ?|[.,·]| \. | ?\( ?\.? ?\) ?)[0-9]{1,4}){3}(?![0-9])")
_RUN = re.compile(r"(?:\+ ?)?\(?[0-9](?:[ ()./_-]{0,3}[0-9])+")
_GROUP = re.compile(r"[0-9]+")
_WORD = re.compile(r"\w+")
_CUES = (frozenset("mail email e-mail courriel correo adresse contact kontakt contacto write schreib écrire".split()),
         frozenset("ip host server address adresse serveur servidor from von login".split()),
         frozenset("card karte carte tarjeta visa mastercard credit kredit number nummer numéro número".split()),
         frozenset("tel phone telefon téléphone teléfono call fax mobile handy portable móvil anruf rufen appelez llame".split()))
FEATURES = ("kind", "valid", "digits", "letters", "others", "other_kinds", "rewritten", "first", "groups", "longest", "shortest", "glued_before", "glued_after",
            "number_before", "number_after", "cue", "other_cue", "quoted", "luhn", "greatest", "last_label")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(c)] for c in digits[-2::-2])
    return total % 10 == 0


def _only_digits(s: str) -> str:
    return "".join(_GROUP.findall(s))


def _holds(kind: int, s: str) -> bool:
    """Whether a span that has the kind's form also meets its numeric test."""
    if kind == 1:
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in _GROUP.findall(s))
    digits = _only_digits(s)
    return 16 <= len(digits) <= 19 and luhn(digits) if kind == 2 else 8 <= len(digits) <= 15


def strict_spans(text: str) -> list[tuple[int, int, int]]:
    """``(kind, start, end)`` of the strict rules, by kind, then start: leftmost, not overlapping within a kind."""
    out = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        host = EMAIL_HOST.match(text, at + 1) if start < at else None
        if host:
            out.append((0, start, host.end()))
            done = host.end()
        at = text.find("@", max(at + 1, done))
    if _DIGIT.search(text):
        for kind, rule in ((1, IP), (2, CARD)):
            out += [(kind, m.start(), m.end()) for m in rule.finditer(text) if _holds(kind, m.group())]
        if "+" in text:
            out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if _holds(3, m.group())]
    return out


def candidates(text: str) -> list[tuple[int, int, int]]:
    """Distinct ``(kind, start, end)`` that the generators propose; they may overlap."""
    out = set()
    for m in _AT.finditer(text):
        local = _LOOSE_LOCAL.search(text, max(0, m.start() - 66), m.start())
        host = _LOOSE_HOST.match(text, m.end())
        if local and host:
            out.add((0, local.start(), host.end()))
    if not _DIGIT.search(text):
        return sorted(out)
    out.update((1, m.start(), m.end()) for m in _LOOSE_IP.finditer(text))
    for m in _RUN.finditer(text):
        if m.end() - m.start() < 7:
            continue
        lo = m.start()
        groups = [(g.start() + lo, g.end() + lo) for g in _GROUP.finditer(m.group())]
        for a in range(len(groups)):
            n = 0
            for b in range(a, len(groups)):
                n += groups[b][1] - groups[b][0]
                if n > 19:
                    break
                start, end = groups[a][0], groups[b][1]
                if 16 <= n and (b == a or min(y - x for x, y in groups[a:b + 1]) >= 3):
                    out.add((2, start, end))
                if 8 <= n <= 15 and b > a and (a == 0 or b == len(groups) - 1):
                    if start and text[start - 1] == "(":
                        start -= 1
                    if a == 0 and text[m.start()] == "+":
                        start = m.start()
                    out.add((3, start, end))
    return sorted(out)


def _normal(kind: int, s: str) -> str:
    """The span as its strict rule would spell it."""
    if kind == 0:
        s = re.sub(r"[\[({<] ?at ?[\])}>]| at ", "@", s, flags=re.I)
        return re.sub(_DOT, ".", s).replace(" ", "")
    if kind == 1:
        return ".".join(_GROUP.findall(s))
    digits = _only_digits(s)
    return digits if kind == 2 else "+" + digits.removeprefix("00")


def valid(kind: int, s: str) -> bool:
    """Whether some reading of the span meets its kind's strict rule."""
    n = _normal(kind, s)
    return _holds(kind, n) if kind >= 2 else (kind, 0, len(n)) in strict_spans(n)


def features(text: str, kind: int, start: int, end: int) -> list[float]:
    """Format and context of a candidate, in the order of ``FEATURES``."""
    s = text[start:end]
    groups = [len(g) for g in _GROUP.findall(s)]
    digits, letters = sum(groups), sum(c.isalpha() for c in s)
    others = [c for c in s if not c.isalnum()]
    before, after = text[max(0, start - CONTEXT):start], text[end:end + CONTEXT]
    near = {w.lower() for w in _WORD.findall(before)[-3:]} | {w.lower() for w in _WORD.findall(after)[:1]}
    numbers = [int(g[:6]) for g in _GROUP.findall(s)] if kind == 1 else []
    return [float(kind), float(valid(kind, s)), float(digits), float(letters), float(len(others)), float(len(set(others))),
            float(len(re.findall(r"\[|\(at|\(dot| at | dot |[/_,·]|  ", s, flags=re.I))), float("+(".find(s[0]) if s[0] in "+(" else 2 + s[0].isalpha()),
            float(len(groups)), float(max(groups, default=0)), float(min(groups, default=0)),
            float(before[-1:].isalpha()), float(after[:1].isalpha()),
            float(bool(re.search(r"[0-9][ ().-]?\Z", before))), float(bool(re.match(r"[ ().-]?[0-9]", after))),
            float(bool(near & _CUES[kind])), float(any(near & c for k, c in enumerate(_CUES) if k != kind)), float(before[-1:] in "\"'=" and before != ""),
            float(luhn(_only_digits(s)) if kind == 2 else 0), float(max(numbers, default=0)), float(len(s) - max(s.rfind("."), s.rfind(" "), s.rfind("]")) - 1 if kind == 0 else 0)]


class Held:
    """Spans that do not overlap, searched in logarithmic time."""

    def __init__(self, spans=()):
        self.starts, self.ends = [], []
        for s, e in sorted(spans):
            if self.ends and s < self.ends[-1]:
                self.ends[-1] = max(e, self.ends[-1])
            else:
                self.starts.append(s), self.ends.append(e)

    def meets(self, start: int, end: int) -> bool:
        at = bisect_right(self.ends, start)
        return at < len(self.starts) and self.starts[at] < end

    def add(self, start: int, end: int) -> bool:
        """Add a span where none is yet."""
        if self.meets(start, end):
            return False
        at = bisect_left(self.starts, start)
        self.starts.insert(at, start), self.ends.insert(at, end)
        return True


def _rewritten(kind: int, s: str, k: int) -> Iterator[tuple[str, int]]:
    """Other spellings of a strict span with label 1, and broken ones with label 0; ``k`` varies them."""
    pick = lambda *some: some[k % len(some)]
    if kind == 0:
        local, host = s.split("@", 1)
        yield local + pick(" [at] ", "[at]", " (at) ", "(at)", " at ", " {at} ") + host.replace(".", pick(" [dot] ", " dot ", " (dot) ", " dot ")), 1
        yield local + pick("[at]", "(at)", " (AT) ") + host, 1
        yield local + pick(" @ ", "@ ", " @") + host, 1
    elif kind == 1:
        yield s.replace(".", pick("[.]", " [.] ", "(.)", "[.]")), 1
        yield s.replace(".", pick(" . ", "·", "[.]")), 1
        parts = s.split(".")
        parts[k % 4] = str(256 + (k * 37) % 740)
        yield ".".join(parts), 0
        yield pick("[.]", " . ", ",").join(parts), 0
    else:
        digits = _only_digits(s)
        if kind == 2:
            spelled = [digits[a:a + 4] for a in range(0, len(digits), 4)]
            broken = digits[:-1] + str((int(digits[-1]) + 1 + k % 9) % 10)
            yield pick(".", "/", "_", "  ", " - ").join(spelled), 1
            yield digits + " " + str(10 ** 9 + k * 7919), 1
            yield broken, 0
            yield pick("-", " ", ".", "/").join(broken[a:a + 4] for a in range(0, len(broken), 4)), 0
            yield digits[:pick(13, 14, 15)], 0
        else:
            cut = len(digits) - 7
            yield "00" + digits[:cut] + pick(" ", "-", "/", ".") + digits[cut:cut + 3] + pick(" ", "-", ".") + digits[cut + 3:], 1
            yield pick("({}) ", "({})-", "{}-", "{}.").format(digits[max(0, cut - 3):cut]) + digits[cut:cut + 3] + pick("-", ".", " ") + digits[cut + 3:], 1
            yield f"{1980 + k % 50}-{1 + k % 12:02}-{1 + k % 28:02} {k % 24:02}", 0
            yield f"{k % 90 + 10} {k % 7 + 1} {k % 80 + 11} {k % 9}", 0
            yield f"{k % 9}.{k % 10}.{k % 900 + 100}", 0


def training_rows(text: str) -> Iterator[tuple[list[float], int]]:
    """Features and label of a document's strict spans, their rewritten and broken spellings, and
    its invalid candidates. A valid candidate outside the strict spans has no label."""
    strict = strict_spans(text)
    for kind, start, end in strict:
        yield features(text, kind, start, end), 1
        k = zlib.crc32(text[start:end].encode())
        before, after = text[max(0, start - CONTEXT):start], text[end:end + CONTEXT]
        for spelled, label in _rewritten(kind, text[start:end], k):
            other = before + spelled + after
            found = [c for c in candidates(other) if c[0] == kind and c[1] < len(before) + len(spelled) and len(before) < c[2]]
            for c in found:
                if c[1:] == (len(before), len(before) + len(spelled)) or (label == 0 and not valid(kind, other[c[1]:c[2]])):
                    yield features(other, *c), label
            if label and kind == 2 and spelled[:end - start].isdigit():
                n = len(_only_digits(text[start:end]))
                yield features(other, kind, len(before), len(before) + n), 1
    clear = Held((s, e) for _, s, e in strict)
    for c in candidates(text):
        if not clear.meets(*c[1:]) and not valid(c[0], text[c[1]:c[2]]):
            yield features(text, *c), 0


_SPAN = "STRUCT<kind: INT, start: BIGINT, end: BIGINT>"
_LOOSE = "STRUCT<kind: INT, start: BIGINT, end: BIGINT, x: ARRAY<DOUBLE>>"
_SPAN_ARROW = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])
_LOOSE_ARROW = pa.struct([*_SPAN_ARROW, ("x", pa.list_(pa.float64()))])


def _proposed(docs: DataFrame) -> DataFrame:
    """``row, doc_id, copy, base, more, text``: strict spans, and candidates clear of them with their features, of every whole text;
    the text itself only where it has one of these."""
    def run(batches):
        for batch in batches:
            base, more, texts = [], [], []
            for text in batch.column(3):
                text = text.as_py()
                strict = strict_spans(text)
                clear = Held((s, e) for _, s, e in strict)
                base.append([dict(zip(("kind", "start", "end"), c)) for c in strict])
                more.append([{"kind": c[0], "start": c[1], "end": c[2], "x": features(text, *c)} for c in candidates(text) if not clear.meets(*c[1:])])
                texts.append(text if base[-1] or more[-1] else None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(base, pa.list_(_SPAN_ARROW)), pa.array(more, pa.list_(_LOOSE_ARROW)), pa.array(texts, pa.string())],
                                             ["row", "doc_id", "copy", "base", "more", "text"])

    return docs.mapInArrow(run, f"row BIGINT, doc_id BIGINT, copy BIGINT, base ARRAY<{_SPAN}>, more ARRAY<{_LOOSE}>, text STRING")


def _training(texts: DataFrame) -> DataFrame:
    """``key, x, label`` from all of ``texts(key, text)``."""
    def made(key, x, y):
        return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(x, pa.list_(pa.float64())), pa.array(y, pa.int32())], ["key", "x", "label"])

    def run(batches):
        key, x, y = [], [], []
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                doc_id = doc_id.as_py()
                for row, label in training_rows(text.as_py()):
                    key.append(doc_id), x.append(row), y.append(label)
                    if len(key) == TRAIN_BATCH:
                        yield made(key, x, y)
                        key, x, y = [], [], []
        yield made(key, x, y)

    return texts.mapInArrow(run, "key BIGINT, x ARRAY<DOUBLE>, label INT")


def fit(texts: DataFrame):
    """A function that adds ``p``, the calibrated probability, to rows with ``x``, and the threshold of each kind; None where the texts
    lack one of the labels."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.regression import IsotonicRegression

    rows = stage(_training(texts).withColumn("v", array_to_vector("x")).withColumn("y", F.col("label").cast("double")), "pii-train")
    fitting = F.pmod(F.xxhash64("key", F.lit("part")), F.lit(3)) != 0
    n = rows.groupBy(fitting.alias("f"), "label").count().collect()
    if {r["label"] for r in n if r["f"]} != {0, 1}:
        return None, {}
    model = GBTClassifier(featuresCol="v", labelCol="y", maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, maxBins=64, minInstancesPerNode=3, seed=11).fit(rows.where(fitting))
    raw = vector_to_array("probability")[1]
    if len({r["label"] for r in n if not r["f"]}) < 2:
        return None, {}
    rest = stage(model.transform(rows.where(~fitting)).select("y", raw.alias("raw"), F.col("x")[0].cast("int").alias("kind")), "pii-calibration")
    iso = IsotonicRegression(featuresCol="raw", labelCol="y", predictionCol="p").fit(rest)

    def score(df: DataFrame) -> DataFrame:
        return iso.transform(model.transform(df.withColumn("v", array_to_vector("x"))).withColumn("raw", raw)).drop("v", "rawPrediction", "probability", "prediction", "raw")

    # Right and wrong candidates at each hundredth of the probability: 101 rows a kind at most.
    steps = iso.transform(rest).groupBy("kind", F.floor(F.col("p") * 100).cast("int").alias("step")).agg(F.sum("y").alias("right"), F.count("*").alias("n")).collect()
    thresholds = {}
    for kind in range(len(KINDS)):
        right = n = 0
        for r in sorted((r for r in steps if r["kind"] == kind), key=lambda r: -r["step"]):
            right, n = right + r["right"], n + r["n"]
            if right < PRECISION * n or r["step"] < 100 * LEAST:
                break
            thresholds[kind] = r["step"] / 100
    return score, thresholds


def _chosen(rows: DataFrame) -> DataFrame:
    """``row, spans`` from ``rows(row, base, found)``: the strict spans and, likeliest first, the found ones
    that overlap nothing taken earlier."""
    def run(batches):
        for batch in batches:
            out = []
            for base, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                held = Held((b["start"], b["end"]) for b in base)
                spans = [{**b, "strict": True} for b in base]
                for c in sorted(found, key=lambda c: (-c["p"], c["start"] - c["end"], c["start"], c["kind"])):
                    if held.add(c["start"], c["end"]):
                        spans.append({"kind": c["kind"], "start": c["start"], "end": c["end"], "strict": False})
                out.append(sorted(spans, key=lambda c: (c["kind"], c["start"])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.struct([*_SPAN_ARROW, ("strict", pa.bool_())])))], ["row", "spans"])

    return rows.select("row", "base", "found").mapInArrow(run, "row BIGINT, spans ARRAY<STRUCT<kind: INT, start: BIGINT, end: BIGINT, strict: BOOLEAN>>")


def find_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, copy, spans``, a row per row of ``docs``: spans holds (kind, start, end, strict), by kind and start.

    kind is a place in ``KINDS``, start and end count code points, copy is a hash of the text. Null and
    empty texts have no span, an empty table no row; repeated rows get equal spans; other columns are left
    out. Where no document has a strict span or another candidate to learn from, only strict spans are
    returned. The trees, the calibration and the thresholds learn from every document with candidates, once
    for each id and text.
    """
    t = whole(F.col(f"`{text}`").cast("string"))
    docs = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.xxhash64(t).alias("copy"), t.alias("text"))
    found = stage(_proposed(docs), "pii-candidates")
    score, thresholds = fit(found.where(F.col("text").isNotNull()).dropDuplicates(["doc_id", "copy"]).select("copy", "text"))
    strict = F.transform("base", lambda b: F.struct(b["kind"].alias("kind"), b["start"].alias("start"), b["end"].alias("end"), F.lit(True).alias("strict")))
    out = found.select("row", "doc_id", "copy", "base", strict.alias("strict"))
    if not thresholds:
        return out.select("doc_id", "copy", F.col("strict").alias("spans"))
    judged = score(found.select("row", F.explode("more").alias("m")).select("row", "m.*"))
    enough = F.lit(False)
    for kind, least in thresholds.items():
        enough = enough | ((F.col("kind") == kind) & (F.col("p") >= least))
    # Grouped by document row: its candidates are parts of one text.
    accepted = judged.where(enough).groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end", "p")).alias("found"))
    more = _chosen(found.select("row", "base").join(accepted, "row"))
    return out.join(more, "row", "left").select("doc_id", "copy", F.coalesce("spans", "strict").alias("spans"))


def redact(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with each found span replaced by its kind in angle brackets; spans that meet become one, of
    the first one's kind. Texts without a span, null ones too, stay as they are."""
    names = [free_name(docs.columns, x) for x in ("_i", "_copy", "_spans")]
    found = find_spans(docs, doc_id, text).where(F.size("spans") > 0).dropDuplicates(["doc_id", "copy"])
    found = found.select(F.col("doc_id").alias(names[0]), F.col("copy").alias(names[1]), F.col("spans").alias(names[2]))
    t = F.col(f"`{text}`").cast("string")
    wide = docs.join(found, F.col(f"`{doc_id}`").cast("long").eqNullSafe(F.col(names[0])) & (F.xxhash64(whole(t)) == F.col(names[1])), "left")
    wide = wide.select(*(F.col(f"`{c}`") for c in docs.columns), names[2])
    at = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            texts = []
            for whole_text, spans in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
                done, pieces = 0, []
                for s in sorted(spans or [], key=lambda s: (s["start"], s["end"])):
                    if s["start"] >= done:
                        pieces += [whole_text[done:s["start"]], f"<{KINDS[s['kind']].upper()}>"]
                    done = max(done, s["end"])
                texts.append("".join([*pieces, whole_text[done:]]) if pieces else whole_text)
            columns = list(batch.columns[:-1])
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-1])

    return wide.mapInArrow(run, docs.schema)


def _listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")


def _count(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def op11_pii(docs: DataFrame) -> DataFrame:
    """Strict counts, the digest of the strict spans and all spans of every document; edge cases as in ``find_spans``."""
    strict = F.filter("spans", lambda s: s["strict"])
    counts = [_count(strict, k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return find_spans(docs).select("doc_id", *counts, F.sha2(_listed(strict), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))
