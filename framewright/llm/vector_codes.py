"""Vector code compression: product codebooks by Lloyd rounds on two trees.

A vector is cut into parts, each with a codebook of integer entries. In a task,
the parts of a block of vectors at one position form a binary tree of boxes, and
so do the codebook's entries. Pairs of nodes are followed downwards together: an
entry node whose least distance from a box of parts is above the greatest
distance of another entry node is pruned for all parts of the box. A box with a
single entry left is assigned whole, with its cached sum and count; the parts of
boxes that stay uncertain down to the leaves are compared one by one. All bounds
and distances are exact integers, so the assignment is that of a full search, ties
to the lower index included.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.storage import stage

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
LARGEST = 1 << 24  # integer components are held to +- this, so that no distance leaves 64 bits
BLOCK = 4096  # vectors of a tree: bounds the arrays of a task
LEAF = 8  # parts of a leaf, about
SALTS = 16  # a label's rows are dealt to so many join keys


class Tree:
    """Binary trees of boxes over ``points[part, k]``, one a part, split at the median of the widest side.

    ``order`` has the points leaf by leaf, -1 for padding. ``low``, ``high`` and ``some`` (whether the
    node has a point) hold one array a level, the root's first.
    """

    def __init__(self, points: np.ndarray, valid: np.ndarray, depth: int):
        parts, n, d = points.shape
        leaves = 1 << depth
        size = -(-max(n, 1) // leaves)
        order = np.full((parts, leaves * size), -1, np.int64)
        order[:, :n] = np.where(valid, np.arange(n), -1)
        part = np.arange(parts)[:, None]
        empty = np.int64(4 * LARGEST)
        for level in range(depth):
            # Each node's points are sorted by its widest side, padding last, and halved.
            nodes = order.reshape(parts << level, -1)
            at = points[np.repeat(np.arange(parts), 1 << level)[:, None], nodes]
            real = nodes >= 0
            sides = np.where(real[..., None], at, -empty).max(1) - np.where(real[..., None], at, empty).min(1)
            widest = np.take_along_axis(at, sides.argmax(1)[:, None, None], 2)[..., 0]
            rank = np.argsort(np.where(real, widest, empty), 1, kind="stable")
            order = self._halved(np.take_along_axis(nodes, rank, 1), leaves * size >> level).reshape(parts, -1)
        self.order, self.depth, self.size, self.parts = order, depth, size, parts
        self.points = np.where((order >= 0)[..., None], points[part, order], 0).reshape(parts * leaves, size, d)
        self.real = (order >= 0).reshape(parts * leaves, size)
        low = np.where(self.real[..., None], self.points, empty).min(1)
        high = np.where(self.real[..., None], self.points, -empty).max(1)
        self.low, self.high = [low], [high]
        for _ in range(depth):
            low, high = np.minimum(low[::2], low[1::2]), np.maximum(high[::2], high[1::2])
            self.low.insert(0, low)
            self.high.insert(0, high)
        self.some = [(a <= b).all(1) for a, b in zip(self.low, self.high)]

    @staticmethod
    def _halved(nodes: np.ndarray, width: int) -> np.ndarray:
        """Nodes with their points spread evenly over both halves, in order: each half gets its padding last."""
        n = (nodes >= 0).sum(1)
        half = width // 2
        left = -(-n // 2)
        at = np.arange(width)[None, :]
        place = np.where(at < half, np.where(at < left[:, None], at, -1), np.where(at - half < (n - left)[:, None], at - half + left[:, None], -1))
        return np.where(place >= 0, np.take_along_axis(nodes, np.maximum(place, 0), 1), -1)

    def sums(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Sum and count of the points of every node, a pair a level, the root's first."""
        total, n = self.points.sum(1), self.real.sum(1)
        out = [(total, n)]
        for _ in range(self.depth):
            total, n = total[::2] + total[1::2], n[::2] + n[1::2]
            out.insert(0, (total, n))
        return out


def _depth(n: int, leaf: int) -> int:
    return max(0, (-(-n // leaf) - 1).bit_length())


def entry_tree(codebooks: np.ndarray) -> Tree:
    """Tree over ``codebooks[part, entry]``, an entry a leaf; of equal entries only the lowest index is held, the others never win."""
    valid = np.ones(codebooks.shape[:2], bool)
    for p, book in enumerate(codebooks):
        valid[p] = False
        valid[p, np.unique(book, axis=0, return_index=True)[1]] = True
    return Tree(codebooks, valid, _depth(codebooks.shape[1], 1))


def dual_assign(points: Tree, entries: Tree) -> Iterator[tuple[str, int, np.ndarray, np.ndarray]]:
    """Nearest entries of all points: ``("node", level, nodes, codes)`` for nodes assigned whole and
    ``("points", level, leaves, codes[leaf, k])`` for uncertain leaves."""
    code_of = entries.order.reshape(-1)  # an entry leaf holds one entry
    q = e = np.arange(points.parts, dtype=np.int64)
    ql = el = 0
    while len(q):
        qlow, qhigh, elow, ehigh = points.low[ql][q], points.high[ql][q], entries.low[el][e], entries.high[el][e]
        gap = np.maximum(np.maximum(qlow - ehigh, elow - qhigh), 0)
        least = np.einsum("ij,ij->i", gap, gap)
        far = np.maximum(qhigh - elow, ehigh - qlow)
        there = entries.some[el][e] & points.some[ql][q]
        most = np.where(there, np.einsum("ij,ij->i", far, far), np.iinfo(np.int64).max)
        first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        bound = np.minimum.reduceat(most, first)
        n = np.diff(np.r_[first, len(q)])
        keep = there & (least <= np.repeat(bound, n))
        q, e = q[keep], e[keep]
        if not len(q):
            return
        if el == entries.depth:
            first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
            n = np.diff(np.r_[first, len(q)])
            single = first[n == 1]
            if len(single):
                yield "node", ql, q[single], code_of[e[single]]
            left = np.repeat(n > 1, n)
            q, e = q[left], e[left]
            if ql == points.depth:
                if len(q):
                    yield "points", ql, *_compared(points, entries, q, e, code_of)
                return
        if ql < points.depth:
            q, e, ql = np.r_[2 * q, 2 * q + 1], np.r_[e, e], ql + 1
        if el < entries.depth:
            q, e, el = np.r_[q, q], np.r_[2 * e, 2 * e + 1], el + 1
        order = np.argsort(q, kind="stable")
        q, e = q[order], e[order]


def _compared(points: Tree, entries: Tree, q: np.ndarray, e: np.ndarray, code_of: np.ndarray):
    """Nearest of its leaf's entries for every point of the leaves in ``q``."""
    off = points.points[q] - entries.points[e]
    distance = np.einsum("ijk,ijk->ij", off, off)
    first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
    n = np.diff(np.r_[first, len(q)])
    least = np.minimum.reduceat(distance, first, axis=0)
    codes = np.where(distance == np.repeat(least, n, axis=0), code_of[e][:, None], np.iinfo(np.int64).max)
    return q[first], np.minimum.reduceat(codes, first, axis=0)


def _blocks(column: pa.Array, parts: int, d: int) -> Iterator[tuple[int, np.ndarray]]:
    """First row and ``points[part, row]`` of each block of vectors, zeros after a vector's end."""
    rows = column.to_pylist()
    for lo in range(0, len(rows), BLOCK):
        some = rows[lo:lo + BLOCK]
        whole = np.frombuffer(b"".join(r.ljust(4 * parts * d, b"\0") for r in some), "<i4").astype(np.int64)
        yield lo, np.ascontiguousarray(whole.reshape(len(some), parts, d).transpose(1, 0, 2))


def _point_tree(points: np.ndarray) -> Tree:
    return Tree(points, np.ones(points.shape[:2], bool), _depth(points.shape[1], LEAF))


def entry_sums(blocks: Iterator[np.ndarray], codebooks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum and count of the parts nearest to each entry: cached ones for whole nodes, single ones for the rest."""
    parts, k, d = codebooks.shape
    entries, total, count = entry_tree(codebooks), np.zeros((parts * k, d), np.int64), np.zeros(parts * k, np.int64)
    for block in blocks:
        tree = _point_tree(block)
        cached = tree.sums()
        for kind, level, nodes, codes in dual_assign(tree, entries):
            part = nodes >> level
            if kind == "node":
                np.add.at(total, part * k + codes, cached[level][0][nodes])
                np.add.at(count, part * k + codes, cached[level][1][nodes])
            else:
                real = tree.real[nodes]
                at = (part[:, None] * k + codes)[real]
                np.add.at(total, at, tree.points[nodes][real])
                np.add.at(count, at, 1)
    return total.reshape(parts, k, d), count.reshape(parts, k)


def assign(block: np.ndarray, codebooks: np.ndarray, entries: Tree) -> tuple[np.ndarray, np.ndarray]:
    """Codes and squared distances of every part, ``[part, row]`` each."""
    parts, n, _ = block.shape
    tree = _point_tree(block)
    out = np.zeros((parts << tree.depth, tree.size), np.int64)
    for kind, level, nodes, codes in dual_assign(tree, entries):
        if kind == "node":
            below = tree.depth - level
            out.reshape(-1, tree.size << below)[nodes] = codes[:, None]
        else:
            out[nodes] = codes
    flat, order = out.reshape(parts, -1), tree.order
    codes = np.zeros((parts, n), np.int64)
    part = np.broadcast_to(np.arange(parts)[:, None], order.shape)
    codes[part[order >= 0], order[order >= 0]] = flat[order >= 0]
    off = block - codebooks[np.arange(parts)[:, None], codes]
    return codes, np.einsum("ijk,ijk->ij", off, off)


def integers(vectors: DataFrame, vec_id: str, vector: str, label: str, scale: int = SCALE) -> DataFrame:
    """``vec_id, label, ints``: floor(scale * x) of every component in four bytes, rows with a null
    vector or a null or non-finite component left out."""
    def run(batches):
        for batch in batches:
            column = batch.column(2)
            sizes = np.array(column.value_lengths().fill_null(-1), np.int64)
            flat = column.flatten()  # null rows have no values
            x = np.asarray(flat.cast(pa.float64()).to_numpy(zero_copy_only=False), float)  # null components become NaN
            ends = np.cumsum(np.maximum(sizes, 0))
            odd = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
            starts = ends - np.maximum(sizes, 0)
            kept = (sizes >= 0) & (odd[ends] == odd[starts])
            x = np.where(np.isfinite(x), x, 0)
            ints = np.clip(np.floor(np.clip(x, -LARGEST, LARGEST) * scale), -LARGEST, LARGEST).astype("<i4")
            rows = [ints[starts[k]:ends[k]].tobytes() for k in np.flatnonzero(kept)]
            mask = pa.array(kept)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask), pa.array(rows, pa.binary())], ["vec_id", "label", "ints"])

    some = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{label}`").alias("label"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    kind = some.schema["label"].dataType.simpleString()
    return some.mapInArrow(run, f"vec_id BIGINT, label {kind}, ints BINARY")


def lloyd(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks ``[part, entry, position]`` after the rounds. ``rows(vec_id, ints)``.

    They start as the parts of the smallest ids (nulls last, ties by vector). Each task sends its sums
    by part and entry; the driver holds the codebooks, ``entries`` times a vector's length.
    """
    first = [r["ints"] for r in rows.orderBy(F.asc_nulls_last("vec_id"), "ints").limit(entries).select("ints").collect()]
    length = rows.agg(F.max(F.length("ints"))).first()[0] or 0
    d = max(1, -(-(length // 4) // parts))
    if not first:
        return np.zeros((parts, 0, d), np.int64)
    whole = np.frombuffer(b"".join(r.ljust(4 * parts * d, b"\0") for r in first), "<i4").astype(np.int64)
    books = np.ascontiguousarray(whole.reshape(len(first), parts, d).transpose(1, 0, 2))
    for _ in range(rounds):
        books = _round(rows, books)
    return books


def _round(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    parts, k, d = books.shape

    def run(batches):
        total, count = entry_sums((points for batch in batches for _, points in _blocks(batch.column(0), parts, d)), books)
        p, e = np.nonzero(count)
        at = np.arange(d)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(p, d)), pa.array(np.repeat(e, d)), pa.array(np.tile(at, len(p))),
                                          pa.array(total[p, e].reshape(-1)), pa.array(np.repeat(count[p, e], d))], ["part", "entry", "at", "total", "n"])

    sums = rows.select("ints").mapInArrow(run, "part BIGINT, entry BIGINT, at BIGINT, total BIGINT, n BIGINT") \
        .groupBy("part", "entry", "at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
    out = books.copy()
    for r in sums.collect():  # parts x entries x d rows
        out[r["part"], r["entry"], r["at"]] = int(r["total"]) // r["n"]
    return out


def coded(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """``vec_id, label, code, error`` of every row: code has two hex digits a part (more where entries need them)."""
    parts, k, d = books.shape
    digits = max(2, -(-max(k - 1, 1).bit_length() // 4))
    kind = rows.schema["label"].dataType.simpleString()

    def run(batches):
        tree = entry_tree(books) if k else None  # no entry: no row either
        names = np.array([f"{x:0{digits}x}" for x in range(k)])
        for batch in batches:
            codes, errors = [], []
            for _, points in _blocks(batch.column(2), parts, d):
                found, distance = assign(points, books, tree)
                codes += ["".join(row) for row in names[found.T].tolist()]
                errors += distance.sum(0).tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes, pa.string()), pa.array(errors, pa.int64())], ["vec_id", "label", "code", "error"])

    return rows.select("vec_id", "label", "ints").mapInArrow(run, f"vec_id BIGINT, label {kind}, code STRING, error BIGINT")


def decoded(code: str, books: np.ndarray) -> list[int]:
    """The integer vector that a code stands for."""
    digits = len(code) // books.shape[0]
    return [int(x) for p in range(books.shape[0]) for x in books[p, int(code[digits * p:digits * (p + 1)], 16)]]


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS,
             entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """Codes ``(vec_id, label, code, error)`` of all kept rows, and the codebooks.

    Rows with a null vector, or with a null or non-finite component, are left out. Vectors shorter than
    the longest, or than a multiple of ``parts``, end in zeros. Components beyond ``LARGEST`` after scaling
    count as ``LARGEST``. With fewer rows than ``entries`` the codebooks have an entry a row; an empty
    table gives no row. Repeated ids are rows of their own, a null id is the last; extra columns are left out.
    """
    rows = stage(integers(vectors, vec_id, vector, label, scale), "integers")
    books = lloyd(rows, parts, entries, rounds)
    return stage(coded(rows, books), "codes"), books


def label_sums(codes: DataFrame, salts: int = SALTS) -> DataFrame:
    """``codes`` with label_error, the error of all rows of the label; null labels are one label.

    The join back is salted: a label with many rows is spread over ``salts`` keys.
    """
    sums = codes.groupBy("label").agg(F.sum("error").alias("label_error")).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    sums = sums.withColumnRenamed("label", "_label")
    dealt = codes.withColumn("_salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(salts)).cast("int"))
    return dealt.join(sums, dealt["label"].eqNullSafe(sums["_label"]) & (dealt["_salt"] == sums["_salt"])).select(*(dealt[c] for c in codes.columns), "label_error")


def op13_vector_codes(vectors: DataFrame) -> DataFrame:
    """Code and error of every kept vector of the table; edge cases as in ``compress``."""
    codes, books = compress(vectors)
    return label_sums(codes).select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _assigned(name: str, books: str, more: str = "") -> str:
    return f"""{name} AS (SELECT p.vec_id, p.part, p.v, min(b.entry) AS entry, min(d) AS d FROM (
  SELECT p.vec_id, p.part, p.v, b.entry, b.e, list_sum(list_transform(range(1, len(v) + 1), lambda i: (v[i] - e[i]) * (v[i] - e[i]))) AS d,
    min(d) OVER (PARTITION BY p.vec_id, p.part) AS least
  FROM parts p JOIN {books} b ON p.part = b.part) p JOIN {books} b ON b.part = p.part AND b.entry = p.entry WHERE d = least GROUP BY p.vec_id, p.part, p.v)"""


def _updated(name: str, assigned: str, books: str) -> str:
    return f"""{name}_c AS (SELECT part, entry, i, floor(sum(v[i]) / count(*))::BIGINT AS x FROM {assigned}, (SELECT unnest(range(1, 1025)) AS i) WHERE i <= len(v) GROUP BY ALL),
{name} AS (SELECT b.part, b.entry, coalesce(c.e, b.e) AS e FROM {books} b LEFT JOIN (SELECT part, entry, list(x ORDER BY i) AS e FROM {name}_c GROUP BY ALL) c USING (part, entry))"""


# Full search of all entries, by part. It presumes distinct ids and vectors whose length is a multiple of the parts.
OP13_SQL = f"""
WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
              WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT vec_id, label, part, v[part * (len(v) // {PARTS}) + 1:(part + 1) * (len(v) // {PARTS})] AS v FROM kept, (SELECT unnest(range(0, {PARTS})) AS part)),
b0 AS (SELECT part, dense_rank() OVER (ORDER BY vec_id) - 1 AS entry, v AS e FROM parts WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {ENTRIES})),
""" + ",\n".join(x for r in range(ROUNDS) for x in (_assigned(f"a{r}", f"b{r}"), _updated(f"b{r + 1}", f"a{r}", f"b{r}"))) + ",\n" + _assigned("final", f"b{ROUNDS}") + f""",
books AS (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{ROUNDS}),
codes AS (SELECT vec_id, string_agg(lower(printf('%02x', entry::INT)), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM final GROUP BY vec_id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM codes JOIN kept USING (vec_id), books
"""
