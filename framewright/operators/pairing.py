"""Pairing and stitching.

* ``pair_files``: source/listing files paired by file stem across a whole
  tree; incomplete pairs are dropped.
  When several files share a stem and extension, the one with the greatest
  path wins (the original walk order is file-system dependent).
* ``stitch_listings``: attach a listing to each record by the zero-padded
  id file name; records without a file keep their current listing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- fixed values: file naming ---------------------------------------------
SOURCE_EXT = "c"
LISTING_EXT = "asm"
LISTING_NAME_FORMAT = "sample_%05d.asm"


def path_parts(path: str = "path") -> dict:
    name = F.regexp_extract(F.col(path), r"([^/\\]+)$", 1)
    ext = F.regexp_extract(name, r"\.([^.]*)$", 1)
    stem = F.when(ext != "", F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)
    return {"name": name, "ext": ext, "stem": stem}


def pair_files(listing: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """B1: ``listing(path, content)`` -> ``file_id, source_code_c, assembly_code``.

    Winners are chosen on paths alone; their texts are fetched by path afterwards, so no text is in
    an aggregate and a stem with many files costs paths only."""
    p = path_parts(path)
    paths = listing.select(p["stem"].alias("stem"), p["ext"].alias("ext"), F.col(path).alias("_p"))
    won = lambda ext: F.max(F.when(F.col("ext") == ext, F.col("_p")))
    pairs = paths.filter(F.col("ext").isin(SOURCE_EXT, LISTING_EXT)).groupBy("stem").agg(won(SOURCE_EXT).alias("_cp"), won(LISTING_EXT).alias("_ap"))
    pairs = pairs.filter(F.col("_cp").isNotNull() & F.col("_ap").isNotNull())
    text = lambda at, name: listing.select(F.col(path).alias(at), F.col(content).alias(name))
    return pairs.join(text("_cp", "source_code_c"), "_cp").join(text("_ap", "assembly_code"), "_ap").select(
        F.col("stem").alias("file_id"), "source_code_c", "assembly_code")


def listing_name(file_no: str = "file_no"):
    return F.format_string(LISTING_NAME_FORMAT, F.col(file_no))


def stitch_listings(records: DataFrame, listings: DataFrame, file_no: str = "file_no",
                    asm: str = "assembly_code", name: str = "name", content: str = "content") -> DataFrame:
    """B2: left join on the listing file name; adds ``stitched`` (bool)."""
    lst = listings.select(F.col(name).alias("_name"), F.col(content).alias("_new"))
    r = records.withColumn("_name", F.when(F.col(file_no).isNotNull(), listing_name(file_no)))
    j = r.join(lst, "_name", "left")
    return j.withColumn("stitched", F.col("_new").isNotNull()) \
        .withColumn(asm, F.coalesce(F.col("_new"), F.col(asm))).drop("_name", "_new")


def stitch_report(stitched: DataFrame, file_no: str = "file_no") -> DataFrame:
    """Stitched / missing / no-id counts."""
    has_id = F.col(file_no).isNotNull()
    return stitched.agg(F.count_if(has_id & F.col("stitched")).cast("bigint").alias("stitched"),
                        F.count_if(has_id & ~F.col("stitched")).cast("bigint").alias("missing"),
                        F.count_if(~has_id).cast("bigint").alias("no_id"))
