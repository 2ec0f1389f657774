"""Light of times and places, column by column in generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.media import season_latitude
from ..functions.solar import HORIZON, J2000, TILT, light_score

DAYS = (-1, 0, 1)


def with_sun(df: DataFrame, ts: str, lat: str, lon: str, days: tuple[int, ...] = DAYS) -> DataFrame:
    """Columns __rise_k and __set_k: ``sun_times`` of the day k days after ``ts``, both 0 where the sun doesn't cross the horizon.

    Each quantity is a column of its own, computed once a row, so the plan
    neither repeats an expression nor leaves generated code. Columns whose
    names begin with __sun are replaced and dropped.
    """
    r = F.radians
    c = lambda name, k: F.col(f"__sun_{name}_{k + 1}")
    stages = [
        {"j": lambda k: F.floor((F.col(ts) + k * 86400) / 86400 + 2440587.5 + 0.5) - J2000 + 0.0008 - F.col(lon) / 360},
        {"m": lambda k: F.pmod(357.5291 + 0.98560028 * c("j", k), F.lit(360.0))},
        {"e": lambda k: F.pmod(c("m", k) + (1.9148 * F.sin(r(c("m", k))) + 0.02 * F.sin(r(2 * c("m", k))) + 0.0003 * F.sin(r(3 * c("m", k)))) + 180 + 102.9372, F.lit(360.0))},
        {
            "noon": lambda k: J2000 + c("j", k) + 0.0053 * F.sin(r(c("m", k))) - 0.0069 * F.sin(r(2 * c("e", k))),
            "dec": lambda k: F.sin(r(c("e", k))) * math.sin(math.radians(TILT)),
        },
        {"cos": lambda k: (math.sin(math.radians(HORIZON)) - F.sin(r(F.col(lat))) * c("dec", k)) / (F.cos(r(F.col(lat))) * F.cos(F.asin(c("dec", k))))},
        {"half": lambda k: F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c("cos", k))))) * 240},
    ]
    for stage in stages:
        df = df.withColumns({f"__sun_{name}_{k + 1}": make(k) for name, make in stage.items() for k in days})
    at = lambda k, x: F.when(F.abs(c("cos", k)) > 1, 0.0).otherwise((c("noon", k) - 2440587.5) * 86400 + x * c("half", k))
    df = df.withColumns({f"__{name}_{k}": at(k, x) for k in days for name, x in (("rise", -1), ("set", 1))})
    return df.drop(*(f"__sun_{name}_{k + 1}" for stage in stages for name in stage for k in days))


def with_light(df: DataFrame, ts: Column, lat: Column, lon: Column, out: str = "light") -> DataFrame:
    """The frame with the light score of a time (epoch seconds) and place; a guess by season without a place, 0.6 without a time. The window of the day before, the same or the next that holds the time counts, else the longest, the earliest among equals."""
    north = F.when((F.coalesce(lat, F.lit(0.0)) == 0) & (F.coalesce(lon, F.lit(0.0)) == 0), season_latitude(ts)).otherwise(lat)
    df = with_sun(df.withColumns({"__ts": ts, "__lat": north, "__lon": F.coalesce(lon, F.lit(0.0))}), "__ts", "__lat", "__lon")
    rise, sets, t = (lambda k: F.col(f"__rise_{k}")), (lambda k: F.col(f"__set_{k}")), F.col("__ts")
    df = df.withColumns({f"__span_{k}": F.when((rise(k) != 0) & (sets(k) > rise(k)), sets(k) - rise(k)) for k in DAYS})
    longest = F.greatest(*(F.coalesce(f"__span_{k}", F.lit(-1.0)) for k in DAYS))
    day = F.coalesce(*(F.when(F.col(f"__span_{k}").isNotNull() & t.between(rise(k), sets(k)), k) for k in DAYS), *(F.when(F.col(f"__span_{k}") == longest, k) for k in DAYS))
    df = df.withColumn("__day", day)
    chosen = lambda of: F.coalesce(*(F.when(F.col("__day") == k, of(k)) for k in DAYS), F.lit(0.0))
    df = df.withColumns({"__rise": chosen(rise), "__set": chosen(sets)})
    light = F.when(t.isNull() | (t == 0), 0.6).otherwise(light_score(t, F.col("__rise"), F.col("__set")))
    helpers = ["__ts", "__lat", "__lon", "__day", "__rise", "__set", *(f"__{n}_{k}" for n in ("rise", "set", "span") for k in DAYS)]
    return df.withColumn(out, light).drop(*helpers)
