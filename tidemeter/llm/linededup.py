"""Boilerplate lines by site-relative frequency, with DataFrame functions only.

A line's pages on a host, over all pages of the host, is its ratio; lines above the boilerplate ratio leave the texts
of that host. A page holds a bounded number of lines on average, so at most (lines a page) / ratio lines of a host can
be above it: one short array for each host is joined to its pages, and texts are neither cut into rows nor put together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemeter.llm.common import stored


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _key(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def boilerplate_lines(docs: DataFrame, host: str, text: str, ratio: float, least_pages: int, by_text: bool = False) -> DataFrame:
    """(host, lines): keys of the lines that stand on more than ``ratio`` of the host's pages, and on enough of them.

    With ``by_text`` equal texts of a host are one page; only their keys are sent to be compared, not the texts.
    """
    keys = F.array_distinct(F.transform(F.filter(lines_of(F.col(text)), lambda x: F.trim(x) != ""), _key))
    pages = docs.select(F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text"), keys.alias("lines"))
    if by_text:
        pages = pages.dropDuplicates(["host", "text"])
    totals = pages.groupBy("host").agg(F.count("*").alias("pages"))
    held = pages.select("host", F.explode("lines").alias("line")).groupBy("host", "line").agg(F.count("*").alias("holders"))
    held = held.where(F.col("holders") >= least_pages).join(totals, "host").where(F.col("holders") > F.col("pages") * ratio)
    return held.groupBy("host").agg(F.sort_array(F.collect_list("line")).alias("lines"))


def drop_boilerplate(
    docs: DataFrame, host: str = "source", text: str = "text", ratio: float = 0.1, least_pages: int = 3, by_text: bool = False
) -> DataFrame:
    """All rows and columns of ``docs``; boilerplate lines are gone from ``text`` (and ``n_lines``, ``n_dropped`` say how many).

    The result has one column ``row`` with the columns as they were, except for ``text``, and the two counts, so
    that no name can clash. Lines are compared without blanks at their ends; blank lines stay. A null host is
    the empty host; a null text stays null. A page counts once for a line that it repeats. A page may lose all its
    lines and then has an empty text. A host needs ``least_pages`` pages with a line, so small sites keep theirs.
    With ``by_text`` equal texts of a host count as one page, so a text copied whole is no boilerplate; it keeps its lines.
    """
    bad = stored(boilerplate_lines(docs, host, text, ratio, least_pages, by_text), "line-boilerplate")
    bad = bad.select(F.col("host").alias("__host"), F.col("lines").alias("__lines"))
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    of = F.coalesce(F.col("row")[host].cast("string"), F.lit(""))
    met = whole.withColumn("__host", of).join(bad, "__host", "left")
    lines = lines_of(F.col("row")[text])
    kept = F.when(F.col("__lines").isNull(), lines).otherwise(F.filter(lines, lambda x: ~F.array_contains("__lines", _key(x))))
    met = met.select("row", F.size(lines).alias("n_lines"), kept.alias("kept"))
    clean = F.when(F.col("row")[text].isNotNull(), F.array_join("kept", "\n"))
    return met.select(
        F.col("row").withField(text, clean).alias("row"), "n_lines", (F.col("n_lines") - F.size("kept")).alias("n_dropped")
    )
