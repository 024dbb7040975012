"""Bounded-space online packing of documents into fixed windows.

A task keeps ``OPEN`` windows. Whole windows of a long document are sequences at
once; what is left of it goes to the open window that it fits best. When it fits
none, the fullest window is filled up with its head and emitted, and the rest is
placed the same way. What the tasks have left open is merged in the same manner,
``FAN_IN`` tasks at a time, until one group is left; its last windows are joined
to whole windows and sequences whose length is a power of two, which need no
padding. A task holds only its open windows, and only these reach the merge.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm import tokens
from framewright.llm.storage import stage

WINDOW = 1024  # tokens of a sequence
OPEN = 32  # open windows of a task
FAN_IN = 64  # tasks whose open windows one task merges
STEP = 1 << 30  # sequences that one task can number
LEVEL = 1 << 56  # tasks of one level, each with that many

_SCHEMA = ("doc_id BIGINT, doc_key STRING, start BIGINT, length BIGINT, ids_crc32 BIGINT, doc_tokens BIGINT, "
           "sequence_id BIGINT, offset BIGINT, ids BINARY, grp BIGINT")
_ARROW = pa.schema([("doc_id", pa.int64()), ("doc_key", pa.string()), ("start", pa.int64()), ("length", pa.int64()),
                    ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()),
                    ("offset", pa.int64()), ("ids", pa.binary()), ("grp", pa.int64())])


class Packer:
    """The open windows of one task. A piece is ``(doc_id, doc_key, start, ids, doc_tokens)``."""

    def __init__(self, window: int, most: int, first_sequence: int):
        self.window, self.most, self.next = window, most, first_sequence
        self.open: list[list] = []  # [free tokens, pieces]
        self.done: list[tuple] = []

    def emit(self, pieces: list) -> None:
        at = 0
        for doc_id, key, start, ids, n in pieces:
            length = len(ids) // 4
            self.done.append((doc_id, key, start, length, zlib.crc32(ids), n, self.next, at, None, None))
            at += length
        self.next += 1

    def place(self, doc_id, key, start: int, ids: bytes, n: int) -> None:
        size = 4 * self.window
        at = 0
        while len(ids) - at >= size:
            self.emit([(doc_id, key, start + at // 4, ids[at:at + size], n)])
            at += size
        while at < len(ids):
            left = (len(ids) - at) // 4
            fits = [w for w in self.open if w[0] >= left]
            if fits:
                best = min(fits, key=lambda w: w[0])
                take = left
            elif len(self.open) < self.most:
                best, take = [self.window, []], left
                self.open.append(best)
            else:
                best = min(self.open, key=lambda w: w[0])
                take = best[0]
            best[1].append((doc_id, key, start + at // 4, ids[at:at + 4 * take], n))
            best[0] -= take
            at += 4 * take
            if not best[0]:
                self.emit(best[1])
                self.open = [w for w in self.open if w is not best]

    def finish(self) -> None:
        """Join what is open to whole windows, and the rest to sequences of a power of two."""
        pieces = [p for w in sorted(self.open, key=lambda w: w[0]) for p in w[1]]
        left = sum(len(p[3]) // 4 for p in pieces)
        self.open = []
        while left:
            room = self.window if left >= self.window else 1 << (left.bit_length() - 1)
            left -= room
            some = []
            while room:
                doc_id, key, start, ids, n = pieces.pop(0)
                take = min(room, len(ids) // 4)
                some.append((doc_id, key, start, ids[:4 * take], n))
                if 4 * take < len(ids):
                    pieces.insert(0, (doc_id, key, start + take, ids[4 * take:], n))
                room -= take
            self.emit(some)

    def kept(self, group: int) -> list[tuple]:
        return [(d, k, s, len(ids) // 4, zlib.crc32(ids), n, None, None, ids, group) for w in self.open for d, k, s, ids, n in w[1]]

    def batches(self, rows: list[tuple]):
        for at in range(0, len(rows), 4096):
            yield pa.RecordBatch.from_pydict({f.name: pa.array([r[k] for r in rows[at:at + 4096]], f.type)
                                              for k, f in enumerate(_ARROW)}, schema=_ARROW)


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, most_open: int = OPEN,
         fan_in: int = FAN_IN, end_id: int = 0) -> DataFrame:
    """Pack every document, each followed by ``end_id``, into sequences of at most ``window`` tokens.

    A row per piece: doc_id, doc_key (tells rows that share a doc_id apart), start (ids of the
    document before the piece), length, ids_crc32 (unsigned, of the ids as little-endian 32-bit
    numbers), doc_tokens, sequence_id and offset (in its sequence, gapless from 0). Null and empty
    texts are one ``end_id``; rows with a null or repeated doc_id are packed like others; an empty
    table gives no row. Columns other than doc_id and text are left out. ``window`` is a power of two.
    """
    if window < 1 or window & (window - 1):
        raise ValueError("the window must be a power of two")
    end = end_id.to_bytes(4, "little")

    def first(batches):
        from pyspark import TaskContext

        enc, part, row = tokens.encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        packer = Packer(window, most_open, part * STEP)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at, some in tokens.groups(texts):
                for k, found in enumerate(enc.encode(some)):
                    found += end
                    packer.place(ids[at + k], f"{part}-{row}", 0, found, len(found) // 4)
                    row += 1
                yield from packer.batches(packer.done)
                packer.done = []
        yield from packer.batches(packer.kept(part))

    def merged(last: bool, level: int):
        def merge(table: pa.Table) -> pa.Table:
            rows = sorted(table.to_pylist(), key=lambda r: (r["doc_key"], r["start"]))
            packer = Packer(window, most_open, level * LEVEL + rows[0]["grp"] * STEP)
            for r in rows:
                packer.place(r["doc_id"], r["doc_key"], r["start"], r["ids"], r["doc_tokens"])
            if last:
                packer.finish()
            return pa.Table.from_batches(packer.batches(packer.done + packer.kept(rows[0]["grp"])), _ARROW)
        return merge

    now = stage(docs.select("doc_id", "text").mapInArrow(first, _SCHEMA), "packed")
    done = [now.where("sequence_id IS NOT NULL")]
    level = 0
    while True:
        level += 1
        left = now.where("sequence_id IS NULL").withColumn("grp", F.floor(F.col("grp") / fan_in))
        top = left.agg(F.max("grp")).first()[0]
        if top is None:
            break
        now = stage(left.groupBy("grp").applyInArrow(merged(top == 0, level), _SCHEMA), "packed")
        done.append(now.where("sequence_id IS NOT NULL"))
        if top == 0:
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.drop("ids", "grp")


def op3_packing(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """All documents in sequences of at most 1024 tokens."""
    return pack(docs, tokenizer_path).drop("doc_key")
