"""Sinks: finished cut lists as JSON, and their report as Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import Plan
from ..functions.columns import clamp, duration_text, motion_name


def cut_list_json(slots: DataFrame, by: list[str], plan: Plan = Plan()) -> DataFrame:
    """(by, value): each list as one JSON document, a header and its entries by position.

    A list is as long as its film has slots, so its document is small. Slots
    have pos, item_id, chapter, beats and frame, their end.
    """
    w = Window.partitionBy(*by).orderBy("pos")
    start = F.coalesce(F.lag("frame").over(w), F.lit(0))
    timed = slots.withColumn("__s", start / F.lit(float(plan.fps))).withColumn("__d", (F.col("frame") - start) / F.lit(float(plan.fps)))
    entry = F.struct(F.col("pos").alias("index"), F.round("__s", 3).alias("start"), F.round("__d", 3).alias("duration"), "beats", F.col("item_id").alias("source"), "chapter")
    lists = timed.groupBy(*by).agg(F.array_sort(F.collect_list(entry)).alias("entries"), F.round(F.sum("__d"), 3).alias("duration"))
    music, render = F.struct(F.lit(plan.bpm).alias("bpm")), F.struct(F.lit(plan.fps).alias("fps"))
    return lists.select(*by, F.to_json(F.struct(F.lit(plan.target_seconds).alias("target"), "duration", music.alias("music"), render.alias("render"), "entries")).alias("value"))


def chapter_report(slots: DataFrame, by: list[str], plan: Plan = Plan()) -> DataFrame:
    """(by, chapter, line): a Markdown table row for each chapter: shots, seconds and a bar of its share of the longest."""
    w = Window.partitionBy(*by).orderBy("pos")
    frames = F.col("frame") - F.coalesce(F.lag("frame").over(w), F.lit(0))
    c = slots.withColumn("__f", frames).groupBy(*by, "chapter").agg(F.count("*").alias("n"), F.sum("__f").alias("__f"))
    share = F.bround(F.col("__f") / F.max("__f").over(Window.partitionBy(*by)) * 18).cast("int")
    bar = F.rpad(F.repeat(F.lit("#"), share), 18, ".")
    return c.select(*by, "chapter", F.format_string("| %d | %d | %.1f | %s |", "chapter", "n", F.col("__f") / F.lit(float(plan.fps)), bar).alias("line"))


def _table_row(*cells: Column) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def bar(value: Column, width: int = 18) -> Column:
    """A share as a row of signs."""
    return F.rpad(F.repeat(F.lit("#"), F.bround(clamp(value, 0.0, 1.0) * width).cast("int")), width, ".")


def timeline_report(slots: DataFrame, by: list[str], plan: Plan = Plan()) -> DataFrame:
    """(by, pos, line): a Markdown table row for each slot (pos, frame: its end, name, score): number, start, length, name, score and move."""
    w = Window.partitionBy(*by).orderBy("pos")
    start = F.coalesce(F.lag("frame").over(w), F.lit(0)) / F.lit(float(plan.fps))
    t = slots.withColumn("__s", start).withColumn("__d", F.col("frame") / F.lit(float(plan.fps)) - F.col("__s"))
    row = _table_row(F.col("pos").cast("string"), duration_text(F.col("__s")), F.format_string("%.2fs", "__d"), F.col("name"), F.format_string("%.3f", "score"), motion_name(F.col("pos") - 1))
    return t.select(*by, "pos", row.alias("line"))


def location_report(stops: DataFrame) -> DataFrame:
    """(device, stop, line): a Markdown table row for each stop (label, n, first_us, last_us): number, place, items and the times it spans."""
    at = lambda c: F.date_format(F.timestamp_micros(c), "yyyy-MM-dd HH:mm")
    row = _table_row((F.col("stop") + 1).cast("string"), F.col("label"), F.col("n").cast("string"), F.concat(at("first_us"), F.lit(" - "), at("last_us")))
    return stops.select("device", "stop", row.alias("line"))


def top_report(items: DataFrame, key: str) -> DataFrame:
    """(key, line): a Markdown table row for each item (name, score): its name, a bar of its score and the score."""
    return items.select(key, _table_row(F.col("name"), bar(F.col("score")), F.format_string("%.3f", "score")).alias("line"))


def write_lines(lines: DataFrame, path: str, by: list[str], column: str = "value") -> None:
    """Text files of a column below a folder for each value of ``by``; a folder that exists is replaced."""
    lines.select(*by, column).write.partitionBy(*by).mode("overwrite").text(path)
