"""Scalar functions of the timeline domain, as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import AUDIO_SUFFIXES, EARTH_KM, PHOTO_SUFFIXES, VIDEO_SUFFIXES


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance; null if a coordinate is."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.when(a > 1, 1.0).otherwise(a)))  # least() would pass over a null


def file_kind(path: Column) -> Column:
    """photo, video or audio by suffix; null for others."""
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    return F.when(suffix.isin(*PHOTO_SUFFIXES), "photo").when(suffix.isin(*VIDEO_SUFFIXES), "video").when(suffix.isin(*AUDIO_SUFFIXES), "audio")


def frame_rate(text: Column) -> Column:
    """num/den or a number; 0 for anything else."""
    num, den = (F.get(F.split(text, "/"), F.lit(k)).try_cast("double") for k in (0, 1))
    return F.coalesce(F.when(text.contains("/"), F.try_divide(num, den)).otherwise(text.try_cast("double")), F.lit(0.0))


def utc_offset_seconds(text: Column) -> Column:
    """Seconds east of UTC from Z, UTC, GMT, +HH:MM, +HHMM or hours, whose fractions are dropped; 0 for anything else."""
    t = F.upper(F.trim(text))
    sign = F.when(t.startswith("-"), -1).otherwise(1)
    hm = F.regexp_extract(t, r"^[+-]?(\d{1,2}):?(\d{2})$", 1), F.regexp_extract(t, r"^[+-]?(\d{1,2}):?(\d{2})$", 2)
    pair = sign * (hm[0].try_cast("int") * 3600 + hm[1].try_cast("int") * 60)
    return F.coalesce(F.when(t.isin("", "Z", "UTC", "GMT"), 0).otherwise(F.coalesce(pair, (t.try_cast("double").cast("int") * 3600))), F.lit(0))


def duration_text(seconds: Column) -> Column:
    """M:SS, or H:MM:SS from an hour on."""
    s = F.bround(seconds).cast("bigint")
    h, m, r = F.floor(s / 3600), F.floor(s / 60) % 60, s % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, r)).otherwise(F.format_string("%d:%02d", m, r))


def norm_sharpness(v: Column) -> Column:
    return F.when(v <= 0, 0.0).otherwise(clamp(F.log1p(v) / math.log1p(2000.0), 0.0, 1.0))


def norm_motion(v: Column) -> Column:
    return F.when(v <= 0, 0.0).when(v <= 12, v / 12).otherwise(clamp(1 - (v - 12) / 33, 0.0, 1.0))


def norm_faces(faces: Column, eyes: Column) -> Column:
    return F.when(faces <= 0, 0.0).otherwise(clamp(0.60 + 0.12 * F.least(faces, F.lit(3)) + 0.28 * eyes, 0.0, 1.0))


def composite(kind: Column, sharp: Column, exposure: Column, faces: Column, colour: Column, contrast: Column, motion: Column, photo_bias: float = 1.0) -> Column:
    """Weighted mean of the normalised measures; motion counts for videos only, the bias for photos."""
    base = 0.30 * sharp + 0.20 * exposure + 0.20 * faces + 0.12 * colour + 0.10 * contrast
    return F.when(kind == "video", (base + 0.08 * motion) / 1.00).otherwise(base / 0.92 * photo_bias)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def signature(values: Column) -> Column:
    """Difference hash of an array: bit set where a value exceeds the one before, first difference highest; 63 bits of 64 values."""
    steps = F.transform(F.sequence(F.lit(1), F.size(values) - 1), lambda i: F.when(F.get(values, i) > F.get(values, i - 1), 1).otherwise(0))
    return F.aggregate(steps, F.lit(0).cast("bigint"), lambda acc, bit: F.shiftleft(acc, 1).bitwiseOR(bit.cast("bigint")))


def zoom(move: Column, seconds: Column, index: Column, energy: Column, base: float = 0.10) -> Column:
    """Zoom travel of a slot: less for long slots, varied by position, scaled by energy."""
    jitter = 0.90 + 0.20 * F.shiftright(index * F.lit(2654435761), 8).bitwiseAND(255) / 255
    return F.when(move == "still", 0.0).otherwise(clamp(base * F.sqrt(4 / F.greatest(F.lit(0.5), seconds)) * jitter * clamp(energy, 0.75, 1.35), 0.045, 0.30))


def motion_name(index: Column) -> Column:
    """Camera move of a slot: seven moves in a fixed cycle."""
    moves = F.array(*map(F.lit, ("in", "out", "left", "right", "up", "down", "still")))
    return F.get(moves, F.pmod(5 * index + F.floor(index / 7), F.lit(7)).cast("int"))


def capture_seconds(text: Column, offset: Column) -> Column:
    """UTC seconds of a camera's local date, YYYY:MM:DD or YYYY-MM-DD with HH:MM or HH:MM:SS or no time; 0 for anything else and before 1990."""
    part = lambda k: F.regexp_extract(F.trim(text), r"^(\d{4})([:-])(\d{1,2})\2(\d{1,2})(?: (\d{1,2}):(\d{1,2})(?::(\d{1,2}))?)?$", k).try_cast("int")
    year, month, day = part(1), part(3), part(4)
    h, m, s = (F.coalesce(part(k), F.lit(0)) for k in (5, 6, 7))
    first = F.make_date(F.when((year >= 1990) & month.between(1, 12), year), F.when(month.between(1, 12), month), F.lit(1))
    real = day.between(1, F.dayofmonth(F.last_day(first))) & (h < 24) & (m < 60) & (s < 60)
    at = (F.unix_date(first).cast("bigint") + day - 1) * 86400 + h * 3600 + m * 60 + s - F.coalesce(offset, F.lit(0))
    return F.coalesce(F.when(real, at), F.lit(0).cast("bigint"))


def two_places(x: Column) -> Column:
    """A number that is not negative with two decimals, rounded by its exact binary value, ties to even, as C prints it; ``format_string`` rounds the shortest decimal that names it.

    The error of x * 100 is known exactly from the halves of x (Dekker).
    """
    big = x * 134217729.0
    high = big - (big - x)
    p = x * 100.0
    error = (high * 100.0 - p) + (x - high) * 100.0
    whole = F.floor(p)
    part = p - whole
    up = (part > 0.5) | ((part == 0.5) & ((error > 0) | ((error == 0) & (whole % 2 == 1))))
    cents = whole + up.cast("bigint")
    return F.format_string("%d.%02d", F.floor(cents / 100), cents % 100)


def place_label(lat: Column, lon: Column, *names: Column) -> Column:
    """The first two distinct names that are not blank; without names the coordinates, "Unlocated" without those."""
    told = F.array_distinct(F.filter(F.transform(F.array(*names), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")))
    where = F.format_string("%s°%s %s°%s", two_places(F.abs(lat)), F.when(lat >= 0, "N").otherwise("S"), two_places(F.abs(lon)), F.when(lon >= 0, "E").otherwise("W"))
    return F.when(F.size(told) > 0, F.array_join(F.slice(told, 1, 2), ", ")).when((lat != 0) | (lon != 0), where).otherwise("Unlocated")
