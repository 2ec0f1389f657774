"""Sunrise, sunset and light scores as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The sunrise equation's constants, and the light score's bands in seconds and shares.
J2000, TILT, HORIZON = 2451545, 23.4397, -0.833
GOLDEN, NIGHT_AFTER = 4500.0, 2700.0


def sun_times(ts: Column, lat: Column, lon: Column) -> Column:
    """struct(rise, set) in epoch seconds for the day of ts; both 0 where the sun doesn't cross the horizon."""
    d = lambda x: F.radians(x)
    jd = ts / 86400 + 2440587.5
    j = F.floor(jd + 0.5) - J2000 + 0.0008 - lon / 360
    m = F.pmod(357.5291 + 0.98560028 * j, F.lit(360.0))
    c = 1.9148 * F.sin(d(m)) + 0.02 * F.sin(d(2 * m)) + 0.0003 * F.sin(d(3 * m))
    e = F.pmod(m + c + 180 + 102.9372, F.lit(360.0))
    noon = J2000 + j + 0.0053 * F.sin(d(m)) - 0.0069 * F.sin(d(2 * e))
    sin_dec = F.sin(d(e)) * math.sin(math.radians(TILT))
    cos_w = (math.sin(math.radians(HORIZON)) - F.sin(d(lat)) * sin_dec) / (F.cos(d(lat)) * F.cos(F.asin(sin_dec)))
    w = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos_w))))
    at = lambda x: F.when(F.abs(cos_w) > 1, 0.0).otherwise((noon - 2440587.5) * 86400 + x * w * 240)
    return F.struct(at(-1).alias("rise"), at(1).alias("set"))


def daylight(ts: Column, lat: Column, lon: Column) -> Column:
    """The sun times of the day before, the same or the next UTC day that hold ts; else the longest day's, the earliest among equals; zeros without any."""
    days = F.filter(F.array(*(sun_times(ts + k * 86400, lat, lon) for k in (-1, 0, 1))), lambda x: (x.rise != 0) & (x["set"] > x.rise))
    holds = F.filter(days, lambda x: (ts >= x.rise) & (ts <= x["set"]))
    longest = F.array_max(F.transform(days, lambda x, i: F.struct((x["set"] - x.rise).alias("span"), (-i).alias("first"), x.alias("x"))))["x"]
    none = F.struct(F.lit(0.0).alias("rise"), F.lit(0.0).alias("set"))
    return F.coalesce(F.get(holds, F.lit(0)), longest, none)


def light_score(ts: Column, rise: Column, sets: Column) -> Column:
    """0.15 at night, 0.6 to 1 near sunrise (first) and sunset, else least at midday; without sun times (both 0) 0.25 or 0.6 by the UTC hour."""
    hour = F.floor(F.pmod(ts, F.lit(86400.0)) / 60) / 60
    golden = lambda x: F.greatest(F.lit(0.6), 1 - F.abs(x - 1500) / (2 * GOLDEN))
    mid = F.abs(ts - (rise + sets) / 2) / F.greatest(F.lit(1.0), (sets - rise) / 2)
    return (
        F.when(sets <= rise, F.when((hour < 5.5) | (hour > 20.5), 0.25).otherwise(0.6))
        .when((ts < rise - NIGHT_AFTER) | (ts > sets + NIGHT_AFTER), 0.15)
        .when(ts - rise <= GOLDEN, golden(ts - rise)).when(sets - ts <= GOLDEN, golden(sets - ts))
        .otherwise(F.greatest(F.lit(0.45), F.least(F.lit(1.0), 0.5 + 0.2 * mid)))
    )
