"""Checks over a finished cut list, as a row of verdicts for each list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def timing(slots: DataFrame, by: list[str], bpm: float, fps: int, target: float) -> DataFrame:
    """(seconds, on_length, on_beat) of lists of slots (frame: a slot's end): within a beat of the target, and every cut within a frame of 1/30 s of the beat."""
    spb, t = 60.0 / bpm, F.col("frame") / fps
    off = F.abs(t - F.bround(t / spb) * spb)
    out = slots.groupBy(*by).agg(F.max(t).alias("seconds"), F.max(off).alias("__off"))
    return out.select(*by, "seconds", (F.abs(F.col("seconds") - target) <= spb).alias("on_length"), (F.col("__off") <= 1 / 30 + 1e-3).alias("on_beat"))


def pacing(slots: DataFrame, by: list[str]) -> DataFrame:
    """(short_rate, long_rate, spread, paced, varied): slots of 3 s or less move 1.2 times as fast as those of 4.5 s and more, and travel differs less than fourfold; both hold where there is nothing to compare."""
    moved = slots.where((F.col("seconds") > 0.4) & (F.col("zoom") > 0)).withColumn("rate", F.col("zoom") / F.col("seconds"))
    out = moved.groupBy(*by).agg(F.avg(F.when(F.col("seconds") <= 3.0, F.col("rate"))).alias("short_rate"), F.avg(F.when(F.col("seconds") >= 4.5, F.col("rate"))).alias("long_rate"), (F.max("zoom") / F.greatest(F.lit(1e-9), F.min("zoom"))).alias("spread"))
    return out.withColumn("paced", F.coalesce(F.col("short_rate") > F.col("long_rate") * 1.2, F.lit(True))).withColumn("varied", F.col("spread") < 4.0)


def fairness(chapters: DataFrame, by: list[str]) -> DataFrame:
    """(compared, worst, fair) of lists of chapters (seconds, shots): seconds a shot, against the upper median, differ sixfold at most; chapters under 2 % of the shots and lists of fewer than three are not judged."""
    total = chapters.groupBy(*by).agg(F.sum("shots").alias("__all"))
    rates = chapters.join(total, by).where("seconds > 0 AND shots > 0 AND shots >= __all * 0.02").groupBy(*by).agg(F.array_sort(F.collect_list(F.col("seconds") / F.col("shots"))).alias("r"))
    mid = F.get("r", F.floor(F.size("r") / 2).cast("int"))
    worst = F.greatest(F.element_at("r", -1) / mid, mid / F.greatest(F.lit(1e-9), F.get("r", F.lit(0))))
    out = rates.select(*by, F.size("r").cast("bigint").alias("compared"), F.when(F.size("r") >= 3, worst).alias("worst"))
    return out.withColumn("fair", F.coalesce(F.col("worst") <= 6.0, F.lit(True)))
