"""Line dedup by site-relative frequency, in DataFrame operations only.

For every site (a host, or any column that names where a page is from) the
share of its pages that contain a line is the line's boilerplate ratio; lines
above ``ratio`` that occur on at least ``min_pages`` pages of the site are
dropped from all of its pages, every occurrence.

Lines are told apart by a 64-bit hash within their site.  Lines of white space
only are kept.  Only hashes are shuffled for the counts, summed on the map side
first; the texts move once, to meet the list of their own lines to drop.  That
list has at most (lines per page) / ``ratio`` entries, or with ``by_length`` as
many as the page has lines.

With ``by_length`` the ratio falls to a quarter with every word above
``SHORT`` words, as long lines are not shared by chance; ``min_pages`` holds
for all of them.  The lines that only this lower ratio finds stay on pages of
which they are more than half (by characters, after the other lines went): such
a page is a copy of others, and which copy stays is for a later stage to say.
There the last four bits of a line's hash are its class of length, so lines
are told apart by 60 bits.

Null texts stay null and count as pages without lines; a null site is a site
of its own; every row is a page, repeated rows too, but with ``copies_once``
the rows of one site with equal text (told by a 64-bit hash) are one page in
the counts; rows of equal id in one site share that site's verdict on each line.  Empty tables give empty results.
All columns of the input are kept, ``text`` replaced; a page whose lines are
all dropped has an empty text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RATIO = 0.08
MIN_PAGES = 5
#: Words up to which the ratio is the same for all lines with ``by_length``.
SHORT = 5


def _lines(text):
    return F.split(text, "\n", -1)


def _key(line, by_length: bool):
    """Hash of a line; with ``by_length`` its last four bits are the words above ``SHORT``, 15 at most."""
    if not by_length:
        return F.xxhash64(line)
    over = F.least(F.greatest(F.regexp_count(line, F.lit("\\S+")) - SHORT, F.lit(0)), F.lit(15))
    return F.xxhash64(line).bitwiseAND(F.lit(-16)).bitwiseOR(over.cast("long"))


def boilerplate(df: DataFrame, site_col: str = "source", text_col: str = "text", ratio: float = RATIO,
                min_pages: int = MIN_PAGES, by_length: bool = False, copies_once: bool = False) -> DataFrame:
    """(site, line, pages, site_pages) of the lines above the ratio; ``line`` is the hash."""
    pages = df.select(F.col(site_col).alias("site"), F.col(text_col).alias("text"))
    if copies_once:
        copy = F.when(F.col("text").isNotNull(), F.xxhash64("text")).alias("copy")
        lines = (pages.select("site", copy, _line_set(by_length).alias("lines"))
                 .groupBy("site", "copy").agg(F.first("lines").alias("lines"))
                 .select("site", F.explode("lines").alias("line")))
        pages = pages.select("site", copy).distinct()
    else:
        lines = _page_lines(pages, "site", by_length=by_length)
    counts = lines.groupBy("site", "line").agg(F.count("*").alias("pages")).where(F.col("pages") >= min_pages)
    totals = pages.groupBy(F.col("site").alias("its_site")).agg(F.count("*").alias("site_pages"))
    least = F.lit(float(ratio))
    if by_length:
        least = least * F.pow(F.lit(0.25), F.col("line").bitwiseAND(F.lit(15)))
    return (counts.join(totals, F.col("site").eqNullSafe(F.col("its_site")))
            .where(F.col("pages") > least * F.col("site_pages"))
            .select("site", "line", "pages", "site_pages"))


def _line_set(by_length: bool):
    """The distinct line hashes of a text."""
    lines = F.filter(_lines(F.col("text")), lambda x: x.rlike("\\S"))
    return F.array_distinct(F.transform(lines, lambda x: _key(x, by_length)))


def _page_lines(pages: DataFrame, *keep: str, by_length: bool = False) -> DataFrame:
    """Each page's distinct line hashes, with the named columns."""
    return pages.select(*keep, F.explode(_line_set(by_length)).alias("line"))


def drop_lines(df: DataFrame, id_col: str = "doc_id", site_col: str = "source", text_col: str = "text",
               ratio: float = RATIO, min_pages: int = MIN_PAGES, report: bool = False,
               by_length: bool = False, copies_once: bool = False) -> DataFrame:
    """``df`` without its sites' boilerplate lines; with ``report`` also
    ``n_lines`` and ``n_dropped`` (replacing columns of those names)."""
    common = boilerplate(df, site_col, text_col, ratio, min_pages, by_length, copies_once).select(
        F.col("site").alias("its_site"), F.col("line").alias("its_line"),
        (F.col("pages") > F.lit(float(ratio)) * F.col("site_pages")).alias("often"))
    pages = df.select(F.col(id_col).alias("page"), F.col(site_col).alias("site"), F.col(text_col).alias("text"))
    same = F.col("site").eqNullSafe(F.col("its_site")) & (F.col("line") == F.col("its_line"))
    lines = _page_lines(pages, "page", "site", by_length=by_length)
    if by_length:
        hits = (lines.join(common, same).groupBy("page", "site")
                .agg(F.collect_set(F.when(F.col("often"), F.col("line"))).alias("lines"),
                     F.collect_set(F.when(~F.col("often"), F.col("line"))).alias("long_lines")))
    else:
        hits = (lines.join(common, same, "left_semi")
                .groupBy("page", "site").agg(F.collect_set("line").alias("lines")))
    hits = hits.select(*(F.col(c).alias(c) for c in hits.columns))
    text, drop = df[text_col], hits["lines"]
    kept = F.filter(_lines(text), lambda x: ~F.array_contains(drop, _key(x, by_length)))
    if by_length:
        own = F.filter(kept, lambda x: ~F.array_contains(hits["long_lines"], _key(x, by_length)))
        copy = 2 * F.length(F.array_join(own, "\n")) < F.length(F.array_join(kept, "\n"))
        kept = F.when(copy, kept).otherwise(own)
    out = df.join(hits, df[id_col].eqNullSafe(hits["page"]) & df[site_col].eqNullSafe(hits["site"]), "left")
    columns = [F.when(drop.isNull(), text).otherwise(F.array_join(kept, "\n")).alias(c) if c == text_col
               else df[c] for c in df.columns if not (report and c in ("n_lines", "n_dropped"))]
    if report:
        n = F.when(text.isNull(), 0).otherwise(F.size(_lines(text)))
        columns += [n.cast("long").alias("n_lines"),
                    F.when(drop.isNull(), 0).otherwise(F.size(_lines(text)) - F.size(kept)).cast("long")
                    .alias("n_dropped")]
    return out.select(*columns)


#: The same in DuckDB, for the columns of ``op10_line_dedup`` (``by_length`` and ``copies_once``).
SQL = f"""
WITH once AS (SELECT DISTINCT source, text FROM documents),
pages AS (SELECT source, unnest(list_distinct(string_split(text, chr(10)))) AS line FROM once),
totals AS (SELECT source, count(*) AS n FROM once GROUP BY source),
counted AS (
  SELECT p.source, p.line, t.n AS total, count(*) AS n,
    least(greatest(len(regexp_extract_all(p.line, '[^\\x20\\x09-\\x0D]+')) - {SHORT}, 0), 15) AS longer
  FROM pages p JOIN totals t ON p.source IS NOT DISTINCT FROM t.source
  WHERE regexp_matches(p.line, '[^\\x20\\x09-\\x0D]') GROUP BY ALL),
common AS (
  SELECT source, coalesce(list(line) FILTER (n > {RATIO}::DOUBLE * total), []) AS often,
    coalesce(list(line) FILTER (NOT n > {RATIO}::DOUBLE * total), []) AS long_lines
  FROM counted WHERE n >= {MIN_PAGES} AND n > {RATIO}::DOUBLE * pow(0.25, longer) * total GROUP BY source),
kept AS (
  SELECT d.doc_id, d.source, string_split(d.text, chr(10)) AS lines, coalesce(c.long_lines, []) AS long_lines,
    list_filter(string_split(d.text, chr(10)), lambda x: NOT list_contains(coalesce(c.often, []), x)) AS kept
  FROM documents d LEFT JOIN common c ON d.source IS NOT DISTINCT FROM c.source),
own AS (SELECT *, list_filter(kept, lambda x: NOT list_contains(long_lines, x)) AS own FROM kept),
cut AS (
  SELECT doc_id, source, lines, CASE WHEN 2 * coalesce(length(array_to_string(own, chr(10))), 0) < coalesce(length(array_to_string(kept, chr(10))), 0)
    THEN kept ELSE own END AS kept FROM own)
SELECT doc_id, source, array_to_string(kept, chr(10)) AS text,
  coalesce(len(lines), 0) AS n_lines, coalesce(len(lines) - len(kept), 0) AS n_dropped FROM cut
"""
