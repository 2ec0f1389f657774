"""Operators on sampled series: shots of a clip, envelopes, local means. A row holds one clip's samples; rows run in parallel."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FPS, LEAST_GAP, LONGEST, SHORTEST_S = 3, 2, 18, 0.8
TAPS = 15


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)``, with the value computed once a row however often it is used, in lambdas too."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def middle(values: Column) -> Column:
    """Median of an array."""
    at = lambda s, k: F.get(s, F.floor(k / 2).cast("int"))
    return once(F.array_sort(values), lambda s: (at(s, F.size(s) - 1) + at(s, F.size(s))) / 2)


def cuts(motion: Column) -> Column:
    """Indices where a shot begins: 0, and samples at or above median + 6 scaled deviations (24.99 at least) two or more after the last; empty below three samples.

    ``motion`` is an array without nulls.
    """
    def high(m: Column) -> Column:
        return once(middle(m), lambda med: F.greatest(F.lit(0.28 * 255.0 * 0.35), med + 6.0 * (1.4826 * middle(F.transform(m, lambda v: F.abs(v - med))))))

    def kept(m: Column) -> Column:
        loud = once(high(m), lambda t: F.filter(F.transform(m, lambda v, i: F.when((v >= t) & (i > 0), i)), lambda i: i.isNotNull()))
        return F.aggregate(loud, F.array(F.lit(0)), lambda acc, i: F.when(i - F.element_at(acc, -1) >= LEAST_GAP, F.concat(acc, F.array(i))).otherwise(acc))

    return F.when(F.size(motion) < 3, F.array().cast("array<int>")).otherwise(once(motion, kept))


def shots(clips: DataFrame, key: str) -> DataFrame:
    """(key, first, last, start_s, end_s) of a clip's shots (motion array, seconds): between cuts, those over 18 samples split evenly, those under 0.8 s left out.

    A clip without cuts is one shot; samples are three a second.
    """
    c = clips.withColumn("n", F.size("motion")).where("n > 0").withColumn("c", cuts(F.col("motion"))).withColumn("c", F.when(F.size("c") == 0, F.array(F.lit(0))).otherwise(F.col("c")))
    whole = c.select(key, "seconds", "n", "c", F.posexplode("c").alias("i", "a")).withColumn("b", F.coalesce(F.get("c", F.col("i") + 1), F.col("n")))
    pieces = F.ceil((F.col("b") - F.col("a")) / LONGEST).cast("int")
    part = whole.withColumn("p", pieces).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("p") - 1)))
    edge = lambda k: (F.col("a") + F.bround(k * ((F.col("b") - F.col("a")) / F.col("p")))).cast("int")
    x = part.select(key, "seconds", edge(F.col("k")).alias("first"), edge(F.col("k") + 1).alias("last"))
    return x.select(key, "first", "last", (F.col("first") / FPS).alias("start_s"), F.least(F.col("seconds"), F.col("last") / FPS).alias("end_s")).where(F.col("end_s") - F.col("start_s") >= SHORTEST_S)


def rms(values: Column, window: int) -> Column:
    """Array of the root mean square of each window; the last may be short."""
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / window).cast("int")), lambda w: F.slice(values, w * window + 1, window))
    rows = F.transform(parts, lambda p: F.sqrt(F.aggregate(p, F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double")) / F.size(p) + 1e-12))
    return F.when(F.size(values) > 0, rows).otherwise(F.array().cast("array<double>"))


def above_local_mean(values: Column) -> Column:
    """What exceeds the mean of 15 samples under a Hann window, edges repeated, else 0."""
    taps = [0.5 - 0.5 * math.cos(2 * math.pi * k / (TAPS - 1)) for k in range(TAPS)]
    at = lambda j: F.get(values, F.greatest(F.lit(0), F.least(F.size(values) - 1, j))).cast("double")
    mean = lambda i: sum(at(i + (k - TAPS // 2)) * (t / sum(taps)) for k, t in enumerate(taps))
    return F.transform(values, lambda v, i: F.greatest(F.lit(0.0), v.cast("double") - mean(i)))


def scaled(values: Column) -> Column:
    """The values over their population standard deviation; as they are without any."""
    mean = F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / F.size(values)
    spread = once(mean, lambda m: F.sqrt(F.aggregate(values, F.lit(0.0), lambda a, v: a + (v - m) * (v - m)) / F.size(values)))
    return once(spread, lambda s: F.transform(values, lambda v: F.when(s > 1e-9, v / s).otherwise(v)))


def trailing_silence(values: Column) -> Column:
    """How many zeros end the array."""
    last = F.aggregate(F.transform(values, lambda v, i: F.when(v != 0, i + 1).otherwise(0)), F.lit(0), lambda a, b: F.greatest(a, b))
    return F.size(values) - last
