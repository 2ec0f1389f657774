"""Operator 6: line dedup by site-relative frequency, in DataFrame functions only.

A line is boilerplate of a host if the pages of the host that contain it,
divided by all pages of the host, exceed a ratio. Lines are compared without
the ASCII white space around them, by their XXH64; lines without text never count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage

RATIO = 0.05
#: Pages that must have a line before it counts as repeated at all: more than one. The ratio decides beyond that, on hosts of any size.
LEAST_PAGES = 2
#: Boilerplate lines up to this number go out as a broadcast (a few MB); more are joined by host, whose pages are dealt to SALTS groups.
BROADCAST_LINES, SALTS = 100_000, 64
#: White space around a line.
SPACE = " \t\r\x0b\x0c"


def trimmed(line: Column) -> Column:
    return F.trim(line, F.lit(SPACE))


def line_keys(text: Column) -> Column:
    """A hash for each line of a text, in order; null for lines without text."""
    return F.transform(F.split(text, "\n"), lambda x: F.when(trimmed(x) != "", F.xxhash64(trimmed(x))))


def boilerplate(df: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, least_pages: int = LEAST_PAGES, copies: bool = True) -> DataFrame:
    """(host, key, pages, host_pages) of each host's boilerplate lines.

    Without ``copies`` the pages of a host with the same text count once, so
    that no group of copies makes its own lines boilerplate.

    Pages of a line add up inside each task before the shuffle, so a line of
    very many pages, or a host with a third of all pages, moves one row a
    task. A null host is a host of its own.
    """
    pages = df.select(F.col(f"`{host_col}`").alias("host"), F.col(f"`{text_col}`").alias("text"))
    pages = pages.select("host", F.xxhash64("text").alias("page"), line_keys(F.col("text")).alias("keys"))
    if not copies:
        pages = pages.groupBy("host", "page").agg(F.first("keys").alias("keys"))
    totals = pages.groupBy("host").agg(F.count("*").alias("host_pages"))
    keys = pages.select("host", F.explode(F.array_distinct(F.array_compact("keys"))).alias("key"))
    counts = keys.groupBy("host", "key").agg(F.count("*").alias("pages")).where(F.col("pages") >= least_pages)
    return counts.join(totals.toDF("host_", "host_pages"), F.col("host").eqNullSafe(F.col("host_"))).drop("host_").where(F.col("pages") > ratio * F.col("host_pages"))


def drop_boilerplate(df: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, least_pages: int = LEAST_PAGES, copies: bool = True) -> DataFrame:
    """All columns and rows, the text without its host's boilerplate lines, with n_lines and n_dropped.

    Null texts stay null with no lines; an empty text has one line, which
    stays. A document of boilerplate alone keeps an empty text. Repeated rows
    and texts count as pages each, or once without ``copies``. Columns named n_lines or n_dropped are replaced. An
    empty table gives an empty one.
    """
    found = cut_lineage(boilerplate(df, host_col, text_col, ratio, least_pages, copies).select("host", "key"))
    by_host = found.groupBy("host").agg(F.collect_set("key").alias("__drop")).withColumnRenamed("host", "__host")
    host, text = F.col(f"`{host_col}`"), F.col(f"`{text_col}`")
    if found.count() <= BROADCAST_LINES:
        joined = df.join(F.broadcast(by_host), host.eqNullSafe(F.col("__host")), "left")
    else:  # a host may hold a third of all pages
        lists = by_host.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = df.withColumn("__salt", F.pmod(F.xxhash64(text), F.lit(SALTS)).cast("int")).join(lists, host.eqNullSafe(F.col("__host")) & (F.col("__salt") == F.col("__part")), "left").drop("__salt", "__part")
    # a page's own bad lines are found in one pass over the host's list, then looked up among these few; keys go through a generator, so that they are made once
    own = joined.withColumn("__keys", F.explode_outer(F.array(F.when(F.col("__drop").isNotNull(), line_keys(text)))))
    own = own.withColumn("__bad", F.explode_outer(F.array(F.array_intersect(F.array_compact("__keys"), "__drop"))))
    own = own.withColumn("__pairs", F.when(F.size("__bad") > 0, F.arrays_zip(F.split(text, "\n").alias("line"), F.col("__keys").alias("key"))))
    kept = F.transform(F.filter("__pairs", lambda x: x["key"].isNull() | ~F.array_contains("__bad", x["key"])), lambda x: x["line"])
    out = own.withColumn("__kept", kept).withColumn("__lines", F.when(text.isNull(), 0).otherwise(F.size(F.split(text, "\n"))).cast("long"))
    return out.withColumns({
        text_col: F.when(F.col("__kept").isNotNull(), F.array_join("__kept", "\n")).otherwise(text),
        "n_lines": F.col("__lines"),
        "n_dropped": F.when(F.col("__kept").isNotNull(), F.col("__lines") - F.size("__kept")).otherwise(0).cast("long"),
    }).drop("__host", "__drop", "__keys", "__bad", "__pairs", "__kept", "__lines")
