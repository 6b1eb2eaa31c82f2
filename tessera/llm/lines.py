"""Removing boilerplate lines by how often a site repeats them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import BLANK, BROADCAST_ROWS, free, with_values, written

#: A line on more than this share of a site's pages is boilerplate ...
RATIO = 0.05
#: ... if at least so many of its pages have it: on a small site one repetition says little.
PAGES = 3


def url_host(url: Column) -> Column:
    """Host of an address in lower case, without user, port or a leading www."""
    host = F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.regexp_replace(host, r"^www\.", "")


def normal(line: Column) -> Column:
    """A line as it is compared: white space at the ends doesn't count."""
    return F.regexp_replace(line, rf"^{BLANK}|{BLANK}$", "")


def site_key(host: Column) -> Column:
    """Null hosts are one site, apart from any other."""
    return F.coalesce(F.concat(F.lit("="), host.cast("string")), F.lit(""))


def line_keys(text: Column) -> Column:
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.xxhash64(normal(x)))


def boilerplate(pages: DataFrame, ratio: float = RATIO, least_pages: int = PAGES) -> DataFrame:
    """(site, lines): keys of the lines on over `ratio` of a site's pages, `least_pages` at least.

    `pages` has columns site and text. A page counts a line once; lines without a word are never boilerplate. The
    lines of a site are at most its mean number of lines a page over `ratio`, so an array of them is small.
    """
    blank = F.xxhash64(F.lit(""))
    keys = pages.select("site", F.explode(F.array_distinct(line_keys(F.col("text")))).alias("line")).where(F.col("line") != blank)
    counts = keys.groupBy("site", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_pages)
    total = pages.groupBy("site").agg(F.count(F.lit(1)).alias("pages"))
    often = counts.join(total, "site").where(F.col("n") > ratio * F.col("pages"))
    return often.groupBy("site").agg(F.array_sort(F.collect_list("line")).alias("lines"))


def dedup_lines(docs: DataFrame, host: str = "source", ratio: float = RATIO, least_pages: int = PAGES) -> DataFrame:
    """`docs` with boilerplate lines taken out of `text`, and columns n_lines, n_dropped after the others.

    A row is a page of the site that column `host` names. A null text stays null (0 lines); a text loses lines, never
    its row: one of boilerplate alone becomes empty. Rows that repeat are pages of their own. Existing columns called
    n_lines or n_dropped are replaced; any other name may be there. The lines of a site go to its pages by a broadcast
    if they are few, else by a join in which no site is one task's.
    """
    kept = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    return counted_lines(docs, kept, host, ratio, least_pages, "n_lines", "n_dropped")


def counted_lines(docs: DataFrame, kept: list[str], host: str, ratio: float, least_pages: int, n_lines: str, n_dropped: str) -> DataFrame:
    sited = docs.select(site_key(F.col(host)).alias("site"), F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"))
    often = written(boilerplate(sited.select("site", F.col("row")["text"].alias("text")), ratio, least_pages), "boilerplate")
    size = often.agg(F.coalesce(F.sum(F.size("lines")), F.lit(0))).first()[0]
    joined = sited.join(F.broadcast(often), "site", "left") if size <= BROADCAST_ROWS else with_values(sited, often, ["site"])
    own = F.split(F.col("row")["text"], "\n")
    left = F.when(F.col("lines").isNull(), own).otherwise(F.filter(own, lambda x: ~F.array_contains(F.col("lines"), F.xxhash64(normal(x)))))
    out = joined.select("row", F.coalesce(F.size(own), F.lit(0)).alias("n"), left.alias("left"))
    number = lambda c: F.greatest(c, F.lit(0)).cast("bigint")
    columns = [F.array_join("left", "\n").alias(c) if c == "text" else F.col("row")[c].alias(c) for c in kept]
    return out.select(*columns, number(F.col("n")).alias(n_lines), number(F.col("n") - F.coalesce(F.size("left"), F.lit(0))).alias(n_dropped))


def without_boilerplate(docs: DataFrame, host: str = "source", ratio: float = RATIO, least_pages: int = PAGES) -> DataFrame:
    """`docs` with cleaned texts and, if there is a column n_chars, their new lengths; all other columns stay as they
    are, whatever they are called. Nulls stay null and count 0 characters; no rows give none."""
    names = list(docs.columns)
    lines = free(names, "n_lines")
    out = counted_lines(docs, names, host, ratio, least_pages, lines, free([*names, lines], "n_dropped"))
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("bigint"))
    return out.select(*(F.col(f"`{c}`") for c in names))
