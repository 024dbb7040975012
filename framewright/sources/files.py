"""Source trees (A2, A3): ``.c`` / ``.asm`` files read with the binary file
source, decoded as UTF-8 with bad bytes replaced (A3) or dropped (A2), and
line ends normalised as Python text mode does (``\\r\\n`` and ``\\r`` -> ``\\n``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REPLACEMENT_CHAR = "�"


# One character stands in for a genuine U+FFFD while bad bytes are looked for: a code point that no text may
# use for interchange, so it cannot be in a source file.
STAND_IN = "\U0010FFFF"


def decode_text(content: Column, errors: str = "replace") -> Column:
    text = content.cast("string")
    if errors == "ignore":
        kept = F.make_valid_utf8(F.replace(text, F.lit(REPLACEMENT_CHAR), F.lit(STAND_IN)))
        text = F.replace(F.replace(kept, F.lit(REPLACEMENT_CHAR), F.lit("")), F.lit(STAND_IN), F.lit(REPLACEMENT_CHAR))
    else:
        text = F.make_valid_utf8(text)
    return F.regexp_replace(text, "\r\n?", "\n")


def read_tree(spark: SparkSession, root: str, glob: str = "*.{c,asm}", errors: str = "ignore") -> DataFrame:
    """A2: every matching file under ``root``: ``path, content`` (text)."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true") \
        .option("pathGlobFilter", glob).load(root)
    return raw.select("path", decode_text(F.col("content"), errors).alias("content"))


def read_listings(spark: SparkSession, folder: str, glob: str = "*.asm") -> DataFrame:
    """A3: listing files of one folder: ``name, content`` (bad bytes replaced)."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    return raw.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"),
                      decode_text(F.col("content"), "replace").alias("content"))
