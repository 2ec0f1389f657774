"""Arrangement: tempo, beat grids, sections of a piece and its energy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

OPEN_BARS, CLOSE_BARS = 2, 4
# Layer weights (drums, bass, arp, pad, brightness) of each section, and the middle sections by least bars.
LAYERS = {
    "open": (0.0, 0.55, 0.0, 1.15, 0.7),
    "groove": (1.0, 1.0, 0.85, 1.0, 1.0),
    "lift": (1.0, 1.0, 1.0, 1.2, 1.35),
    "drop": (0.0, 0.5, 0.0, 1.1, 0.6),
    "return": (1.0, 1.0, 1.0, 1.1, 1.2),
    "close": (0.55, 0.7, 0.5, 1.25, 0.8),
}
MIDDLES = {
    0: ("groove",),
    48: ("groove", "drop", "groove"),
    100: ("groove", "lift", "drop", "groove"),
    170: ("groove", "lift", "drop", "return", "drop", "lift", "groove"),
}
ENERGY = (0.45, 0.35, 0.12, 0.08)  # of drums, bass, arp, pad


def frame_tempo(bpm: Column, fps: int) -> Column:
    """The tempo nearest to ``bpm`` whose beats are whole frames; 120 if there is none."""
    return F.when(bpm <= 0, 120.0).otherwise(60.0 * fps / F.greatest(F.lit(1.0), F.bround(F.try_divide(F.lit(60.0), bpm) * fps)))


def beat_grid(tracks: DataFrame) -> DataFrame:
    """A row (beat, at_s) for each beat of a track (bpm, seconds, phase)."""
    spb = 60.0 / F.col("bpm")
    return tracks.withColumn("beat", F.explode(F.sequence(F.lit(0), F.floor(F.col("seconds") / spb).cast("int")))).withColumn("at_s", F.col("phase") + F.col("beat") * spb)


def section_plan(bars: Column, max_bars: int = 32) -> Column:
    """Array of (name, bars): an opening, repeated middle sections that differ by a bar at most, a close; empty for no bars."""
    spare = F.greatest(F.lit(1), bars - OPEN_BARS - CLOSE_BARS)
    names = F.array(*map(F.lit, MIDDLES[0]))
    for least, middle in list(MIDDLES.items())[1:]:
        names = F.when(bars >= least, F.array(*map(F.lit, middle))).otherwise(names)
    per = F.greatest(F.lit(1), F.least(F.lit(max_bars), F.floor(spare / F.size(names))))
    count = F.least(F.lit(96), F.ceil(spare / per)).cast("int")
    base = F.floor(spare / count)
    middle = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct(F.get(names, i % F.size(names)).alias("name"), (base + (i < spare - base * count).cast("int")).cast("int").alias("bars")))
    end = [F.array(F.struct(F.lit(n).alias("name"), F.lit(b).alias("bars"))) for n, b in (("open", OPEN_BARS), ("close", CLOSE_BARS))]
    return F.when(bars > 0, F.concat(end[0], middle, end[1])).otherwise(F.array().cast("array<struct<name:string,bars:int>>"))


def section_layers(name: Column) -> Column:
    """(drums, bass, arp, pad, brightness) of a section name."""
    out = F.lit(None)
    for key, weights in LAYERS.items():
        out = F.when(name == key, F.struct(*(F.lit(w).alias(n) for n, w in zip(("drums", "bass", "arp", "pad", "brightness"), weights)))).otherwise(out)
    return out


def energy_curve(films: DataFrame, key: str, max_bars: int = 32) -> DataFrame:
    """(key, bar, section, energy) of each bar of a film (key, bars): layer weights by audibility over the film's mean."""
    sections = films.select(key, F.col("bars").alias("__n"), F.posexplode(section_plan(F.col("bars"), max_bars)).alias("index", "s"))
    start = F.sum("s.bars").over(Window.partitionBy(key).orderBy("index")) - F.col("s.bars")
    each = sections.withColumn("__at", start).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("s.bars") - 1)))
    at = each.select(key, "__n", (F.col("__at") + F.col("k")).alias("bar"), F.col("s.name").alias("section")).where("bar < __n").withColumn("l", section_layers(F.col("section")))
    raw = sum(F.col(f"l.{n}") * w for n, w in zip(("drums", "bass", "arp", "pad"), ENERGY))
    return at.select(key, "bar", "section", (raw / F.avg(raw).over(Window.partitionBy(key))).alias("energy"))
