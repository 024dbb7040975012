"""Token-ID files with directly addressable codes.

An id is cut into chunks of 8 bits, low chunk first. Level 0 holds the first chunk
of every token of a shard, level k the next chunk of those tokens whose id has more
than k chunks. Each level but the last has a bitmap that tells which of its chunks
continue, and a rank directory: the set bits before each block of ``BLOCK`` bits.
Token i is read from chunk i of level 0; while the bitmap says that it continues,
its place in the next level is the rank of its bit. So any token or range is read
from a few bytes of each level, without decoding a block.

Shard file: magic ``DACT``, version, count of levels, tokens; for each level the
offsets and lengths of its chunks, bitmap and directory; then these sections.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framewright.llm import files, tokens
from framewright.llm.storage import new_path, stage

MAGIC = b"DACT"
BLOCK = 512  # bits between two entries of a rank directory
SPAN = 1 << 22  # tokens decoded at once when a long range is read
READ_ROWS = 2048  # texts of one task that are read together, by one opening of their file
SHARD_TOKENS = 1 << 23  # a task starts a new shard file beyond this
_HEAD = struct.Struct("<4sIIQ")
_LEVEL = struct.Struct("<QQQQQQQ")  # chunks, and start and bytes of each section


def encode_levels(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Chunks, bitmap and rank directory of each level of ``ids``."""
    out = []
    rest = ids.astype(np.uint32)
    while True:
        chunks = (rest & np.uint32(255)).astype(np.uint8)
        more = rest > 255
        bits = np.packbits(more, bitorder="little")
        ones = np.add.reduceat(more, np.arange(0, len(more), BLOCK), dtype=np.uint64) if len(more) else np.empty(0, np.uint64)
        ranks = np.concatenate([np.zeros(1, np.uint64), np.cumsum(ones, dtype=np.uint64)])
        rest = rest[more] >> np.uint32(8)
        out.append((chunks, bits if len(rest) else bits[:0], ranks if len(rest) else ranks[:0]))
        if not len(rest):
            return out


class ShardWriter:
    """Gathers the texts of one shard and writes its file at the end."""

    def __init__(self, uri: str):
        self.uri, self.parts, self.tokens = uri, [], 0

    def add(self, ids: bytes) -> int:
        start = self.tokens
        self.parts.append(ids)
        self.tokens += len(ids) // 4
        return start

    def close(self) -> None:
        levels = encode_levels(np.frombuffer(b"".join(self.parts), "<u4"))
        self.parts = []
        at = _HEAD.size + _LEVEL.size * len(levels)
        heads, body = [], []
        for chunks, bits, ranks in levels:
            fields = [len(chunks)]
            for section in (chunks, bits, ranks.astype("<u8")):
                data = section.tobytes()
                fields += [at, len(data)]
                at += len(data)
                body.append(data)
            heads.append(_LEVEL.pack(*fields))
        out = files.Writer(self.uri)
        out.write(_HEAD.pack(MAGIC, 1, len(levels), self.tokens))
        for data in (*heads, *body):
            out.write(data)
        out.close()


class ShardReader:
    """Random access to the tokens of a shard file by ranged reads."""

    def __init__(self, uri: str):
        self.file = files.Reader(uri)
        magic, version, n, self.tokens = _HEAD.unpack(self.file.read(0, _HEAD.size))
        if magic != MAGIC or version != 1:
            raise ValueError(f"{uri} is no token shard")
        self.levels = [_LEVEL.unpack(self.file.read(_HEAD.size + k * _LEVEL.size, _LEVEL.size)) for k in range(n)]

    def _rank(self, level: tuple, at: int) -> int:
        """Set bits of the level before chunk ``at``."""
        block = at // BLOCK
        before = struct.unpack("<Q", self.file.read(level[5] + 8 * block, 8))[0]
        first = block * BLOCK // 8
        bits = np.frombuffer(self.file.read(level[3] + first, (at + 7) // 8 - first), np.uint8)
        return before + int(np.unpackbits(bits, count=at - block * BLOCK, bitorder="little").sum())

    def ids(self, start: int, length: int) -> np.ndarray:
        """Tokens ``start`` to ``start + length`` of the shard."""
        if start < 0 or length < 0 or start + length > self.tokens:
            raise IndexError("outside the shard")
        out = np.zeros(length, np.uint32)
        where = None  # places in out that the chunks of this level belong to
        for k, level in enumerate(self.levels):
            if not length:
                break
            chunks = np.frombuffer(self.file.read(level[1] + start, length), np.uint8).astype(np.uint32)
            if where is None:
                out |= chunks
            else:
                out[where] |= chunks << np.uint32(8 * k)
            if not level[4]:
                break
            first = start // 8
            bits = np.frombuffer(self.file.read(level[3] + first, (start + length + 7) // 8 - first), np.uint8)
            more = np.flatnonzero(np.unpackbits(bits, count=start + length - 8 * first, bitorder="little")[start - 8 * first:])
            where = more if where is None else where[more]
            start, length = self._rank(level, start), len(more)
        return out

    def __getitem__(self, at: int) -> int:
        return int(self.ids(at, 1)[0])

    def close(self) -> None:
        self.file.close()


def write_tokens(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = 0,
                 shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encode every text and write the ids, with ``end_id`` after each, in ascending doc_id order.

    Returns the index, a row per row of ``docs``: doc_id, shard (file), part and row (order of the
    files and of the texts in a task), shard_start (its place in the shard), start (ids of all texts
    before it) and n_tokens. Null texts count as empty, a null doc_id comes first, rows that share a
    doc_id follow by text; an empty table writes no file. Other columns are left out.
    """
    spark = docs.sparkSession
    end = np.array([end_id], "<u4").tobytes()

    def write(batches):
        from pyspark import TaskContext

        enc, part, row, shard = tokens.encoder(tokenizer_path), TaskContext.get().partitionId(), 0, None
        held = []

        def columns(x):
            return {"doc_id": [r[0] for r in x], "shard": [r[1] for r in x], "part": [part] * len(x), "row": [r[2] for r in x],
                    "shard_start": [r[3] for r in x], "n_tokens": [r[4] for r in x]}

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for first, some in tokens.groups(texts):
                for k, found in enumerate(enc.encode(some)):
                    if shard is None:
                        shard = ShardWriter(files.unique_name(folder, "dac"))
                    found += end
                    held.append((ids[first + k], shard.uri, row, shard.add(found), len(found) // 4))
                    row += 1
                    if shard.tokens >= shard_tokens:
                        shard.close()
                        yield from _arrow(columns(held))
                        shard, held = None, []
        if shard is not None:
            shard.close()
            yield from _arrow(columns(held))

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    index = stage(docs.select("doc_id", "text").repartitionByRange(parts, F.col("doc_id").asc_nulls_first())
                  .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
                  .mapInArrow(write, "doc_id BIGINT, shard STRING, part INT, row BIGINT, shard_start BIGINT, n_tokens BIGINT"),
                  "token-index")
    # One row a shard file: the ids of all files before it.
    shards = index.groupBy("shard").agg(F.min("part").alias("part"), F.min("row").alias("first"), F.sum("n_tokens").alias("n"))
    before = shards.select("shard", F.coalesce(F.sum("n").over(Window.orderBy("part", "first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return index.join(before, "shard").withColumn("start", F.col("_before") + F.col("shard_start")).drop("_before")


def _arrow(columns: dict):
    import pyarrow as pa

    types = {"doc_id": pa.int64(), "shard": pa.string(), "part": pa.int32(), "row": pa.int64(), "shard_start": pa.int64(), "n_tokens": pa.int64()}
    if columns["doc_id"]:
        yield pa.RecordBatch.from_pydict({k: pa.array(v, types[k]) for k, v in columns.items()})


def read_tokens(index: DataFrame) -> DataFrame:
    """Read every text of an index back from its files: the index with ids (array of BIGINT)."""
    return _read(index, "ids ARRAY<BIGINT>", lambda found: found.astype(np.int64).tolist())


def token_digests(index: DataFrame) -> DataFrame:
    """The index with ids_crc32, the unsigned CRC of the little-endian ids read from the files."""
    return _read(index, "ids_crc32 BIGINT", None)


def _read(index: DataFrame, field: str, shape) -> DataFrame:
    name = field.split()[0]

    def read(batches):
        import pyarrow as pa

        at, shard = None, None
        for batch in batches:
            out = []
            for uri, start, n in zip(*(batch.column(c).to_pylist() for c in ("shard", "shard_start", "n_tokens"))):
                if uri != at:
                    if shard:
                        shard.close()
                    at, shard = uri, ShardReader(uri)
                if shape:
                    out.append(shape(shard.ids(start, n)))
                    continue
                crc = 0
                for lo in range(start, start + n, SPAN):
                    crc = zlib.crc32(shard.ids(lo, min(SPAN, start + n - lo)).astype("<u4").tobytes(), crc)
                out.append(crc)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.int64()) if shape else pa.int64())],
                                             [*batch.schema.names, name])
        if shard:
            shard.close()

    parts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    index = index.repartition(parts, "part", F.floor(F.col("row") / READ_ROWS)).sortWithinPartitions("shard", "shard_start")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in index.schema.fields)
    return index.mapInArrow(read, f"{fields}, {field}")


def op7_token_store(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Write the table's ids, read the files back: doc_id, start, n_tokens, ids_crc32."""
    index = write_tokens(docs, tokenizer_path, new_path(docs.sparkSession, "tokens"))
    return token_digests(index).select("doc_id", "start", "n_tokens", "ids_crc32")
