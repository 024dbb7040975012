"""Line dedup by site-relative frequency, in DataFrame functions only.

For each site, the share of its pages that contain a line; lines above a ratio are
boilerplate of that site and go. Lines are counted as hashes with map-side
combine, so a hot line is one row a task, and the join back is salted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.llm.storage import stage
from framewright.llm.text_expr import free_name, whole

MAX_RATIO = 0.2  # a line on a larger share of a site's pages is boilerplate
MIN_SITE_PAGES = 10  # smaller sites have no boilerplate
SALTS = 16  # tasks over which the pages of one boilerplate line are dealt

HIDDEN = r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->"
BREAKS = r"(?i)</?(p|div|br|li|ul|ol|nav|h[1-6]|article|footer|header|section|main|aside|table|tr|td|th|title|body|html|head|form|pre|blockquote)\b[^>]*>"
TAGS = r"<[^>]*>"
HOST = r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def host_of(url: Column) -> Column:
    """Host in lower case; empty where the URL has none, null for a null URL."""
    return F.lower(F.regexp_extract(url, HOST, 1))


def visible_lines(html: Column) -> Column:
    """Text of a page, a line per block element, without blank lines."""
    text = F.regexp_replace(html, F.lit(HIDDEN), F.lit(""))
    text = F.regexp_replace(F.regexp_replace(text, F.lit(BREAKS), F.lit("\n")), F.lit(TAGS), F.lit(""))
    text = F.regexp_replace(text, F.lit(r"[\t\r\f ]+"), F.lit(" "))
    return F.array_join(F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != ""), "\n")


def _lines(text: Column) -> Column:
    """Hashes of the lines that count: those with a character other than white space."""
    return F.transform(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != ""), lambda x: F.xxhash64(x))


def line_dedup(docs: DataFrame, site: str, text: str = "text", doc_id: str = "doc_id", max_ratio: float = MAX_RATIO,
               min_site_pages: int = MIN_SITE_PAGES) -> DataFrame:
    """All rows of ``docs``, their boilerplate lines dropped from ``text``, with n_lines and n_dropped.

    A line counts once a page; blank lines are kept and never count. A null site is a site of its own;
    a null text stays null. Rows that share a doc_id count as pages each. A page may lose all its
    lines: its text is then empty, the row stays; an empty table gives no row. Columns n_lines and n_dropped of ``docs`` are replaced.
    """
    keep = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    docs = docs.select(*(F.col(f"`{c}`") for c in keep))
    bad_col, id_col, site_col = (free_name(keep, n) for n in ("_bad", "_id", "_site"))
    base = docs.select(F.col(f"`{doc_id}`").alias("i"), F.col(f"`{site}`").alias("s"), F.array_distinct(_lines(whole(F.col(f"`{text}`")))).alias("h"))
    per_site = base.groupBy("s").agg(F.count("*").alias("pages"))
    per_line = base.select("s", F.explode("h").alias("h")).groupBy("s", "h").agg(F.count("*").alias("n"))
    per_site = per_site.where(F.col("pages") >= min_site_pages)
    # A line of a site with enough pages needs this many pages at least, which leaves few lines for the join.
    often = per_line.where(F.col("n") > max_ratio * min_site_pages)
    boiler = stage(often.join(per_site, often["s"].eqNullSafe(per_site["s"])).where(F.col("n") > max_ratio * F.col("pages"))
                   .select(often["s"].alias("s"), "h"), "boilerplate")
    salt = F.pmod(F.xxhash64("i", "h"), F.lit(SALTS))
    dealt = boiler.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
    pages = base.select("i", "s", F.explode("h").alias("h")).withColumn("salt", salt)
    hits = pages.join(dealt, pages["s"].eqNullSafe(dealt["s"]) & (pages["h"] == dealt["h"]) & (pages["salt"] == dealt["salt"]), "left_semi")
    hits = hits.groupBy(F.col("i").alias(id_col), F.col("s").alias(site_col)).agg(F.collect_set("h").alias(bad_col))
    out = docs.join(hits, docs[f"`{doc_id}`"].eqNullSafe(hits[id_col]) & docs[f"`{site}`"].eqNullSafe(hits[site_col]), "left")
    lines = F.split(F.col(f"`{text}`"), "\n")
    kept = F.filter(lines, lambda x: ~F.array_contains(bad_col, F.xxhash64(x)))
    count = F.when(F.col(f"`{text}`").isNull(), 0).otherwise(F.size(lines)).cast("long")
    dropped = F.when(F.col(bad_col).isNull() | F.col(f"`{text}`").isNull(), 0).otherwise(F.size(lines) - F.size(kept)).cast("long")
    new_text = F.when(F.col(bad_col).isNull(), F.col(f"`{text}`")).otherwise(F.array_join(kept, "\n"))
    return out.select(*((new_text.alias(c) if c == text else F.col(f"`{c}`")) for c in keep), count.alias("n_lines"), dropped.alias("n_dropped"))


def op5_line_dedup(pages: DataFrame) -> DataFrame:
    """Boilerplate lines of the visible text of ``pages``, by host of the URL. Edge cases as in ``line_dedup``.

    The text is taken out of the markup once: counts, hits and output read it from a stage table.
    """
    text = stage(pages.select("page_id", host_of(F.col("url")).alias("host"), visible_lines(F.col("html")).alias("text")), "page-lines")
    return line_dedup(text, "host", "text", "page_id")


OP5_SQL = rf"""
WITH t AS (
  SELECT page_id, lower(regexp_extract(url, '{HOST}', 1)) AS host,
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '{HIDDEN}', '', 'g'), '{BREAKS}', chr(10), 'g'), '{TAGS}', '', 'g'), '[\t\r\f ]+', ' ', 'g') AS x
  FROM pages),
l AS (SELECT page_id, host, list_filter(list_transform(string_split(x, chr(10)), lambda y: trim(y)), lambda y: y <> '') AS lines FROM t),
n AS (SELECT host, count(*) AS pages FROM l GROUP BY host HAVING count(*) >= {MIN_SITE_PAGES}),
c AS (SELECT host, line, count(*) AS n FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM l) GROUP BY host, line),
b AS (SELECT c.host, list(c.line) AS bad FROM c JOIN n ON c.host IS NOT DISTINCT FROM n.host WHERE c.n > {MAX_RATIO}::DOUBLE * n.pages GROUP BY c.host),
k AS (SELECT page_id, l.host, lines, list_filter(lines, lambda y: NOT list_contains(coalesce(bad, []), y)) AS kept
      FROM l LEFT JOIN b ON l.host IS NOT DISTINCT FROM b.host)
SELECT page_id, host, CASE WHEN lines IS NULL THEN NULL ELSE array_to_string(kept, chr(10)) END AS text,
  CASE WHEN lines IS NULL THEN 0 ELSE greatest(len(lines), 1) END::BIGINT AS n_lines, coalesce(len(lines) - len(kept), 0)::BIGINT AS n_dropped
FROM k
"""
