"""Trip operators: steps, chapters, stops, interval joins."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import EARTH_KM, Trip
from ..functions.columns import haversine_km


def local_day(us: str = "us", off: str = "off_s"):
    """Local date of a time in microseconds and an offset in seconds (null: UTC)."""
    return F.to_date(F.timestamp_micros(F.col(us) + F.coalesce(F.col(off), F.lit(0)).cast("bigint") * 1_000_000))


def steps(items: DataFrame) -> DataFrame:
    """Each item's gap in seconds and distance in km from the device's item before."""
    w = Window.partitionBy("device").orderBy("us", "item_id")
    return items.withColumn("gap_s", (F.col("us") - F.lag("us").over(w)) / F.lit(1e6)).withColumn("km", haversine_km(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon")))


def chapters(items: DataFrame, on_move: bool = False, rules: Trip = Trip()) -> DataFrame:
    """Items with ``chapter`` (from 0, per device): a new one after five hours, on another local day, or, with on_move, after 2.5 km between located items."""
    w = Window.partitionBy("device").orderBy("us", "item_id")
    day = steps(items).withColumn("day", local_day())
    new = (F.col("gap_s") >= rules.chapter_gap_hours * 3600) | (F.col("day") != F.lag("day").over(w))
    if on_move:
        new = new | F.coalesce(F.col("km") * 1000 >= rules.chapter_move_metres, F.lit(False))
    return day.withColumn("chapter", F.sum(F.when(new, 1).otherwise(0)).over(w).cast("bigint"))


def chapter_summary(items: DataFrame, **kw) -> DataFrame:
    """(device, chapter, first_us, last_us, n) of each chapter."""
    return chapters(items, **kw).groupBy("device", "chapter").agg(F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.count("*").alias("n"))


def distance_km(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    """``haversine_km`` of plain numbers, for folds."""
    h = math.sin(math.radians(lat2 - lat1) / 2) ** 2 + math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_KM * math.asin(math.sqrt(min(1.0, h)))


def advance(stop: list | None, at: int, lat: float | None, lon: float | None, least_km: float) -> tuple[list | None, list | None]:
    """The open stop [number, lat, lon, first, last, n] after one more point, and the stop that the point closes, if any. Points without a place stay in the stop they fall in; before any stop they count nowhere."""
    if lat is None or lon is None:
        if stop:
            stop[4], stop[5] = at, stop[5] + 1
        return stop, None
    if stop:
        if distance_km(stop[1], stop[2], lat, lon) <= least_km:
            n = stop[5]
            stop[1:] = (stop[1] * n + lat) / (n + 1), (stop[2] * n + lon) / (n + 1), stop[3], at, n + 1
            return stop, None
    return [stop[0] + 1 if stop else 0, lat, lon, at, at, 1], stop


def folded(rows: DataFrame, order: list[str], name: str, step) -> DataFrame:
    """(device, name, lat, lon, first_us, last_us, n) of what ``step(open, *values)`` closes, over each device's rows (device, values ...) in their order.

    One open piece is carried from row to row, whatever their number; devices
    run in parallel. Rows without a device are one device.
    """
    names = ["device", name, "lat", "lon", "first_us", "last_us", "n"]
    types = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
    width = len(rows.columns)

    def run(batches):
        device, piece, begun = None, None, False

        def made(out):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

        for batch in batches:
            out = []
            for d, *values in zip(*(batch.column(k).to_pylist() for k in range(width))):
                if not begun or d != device:
                    if piece:
                        out.append((device, *piece))
                    device, piece, begun = d, None, True
                piece, closed = step(piece, *values)
                if closed:
                    out.append((device, *closed))
            if out:
                yield made(out)
        if piece:
            yield made([(device, *piece)])

    dealt = rows.repartition("device").sortWithinPartitions("device", *order)
    return dealt.mapInArrow(run, f"device long, {name} long, lat double, lon double, first_us long, last_us long, n long")


def stops(items: DataFrame, rules: Trip = Trip()) -> DataFrame:
    """(device, stop, lat, lon, first_us, last_us, n): runs of items within 400 m of the stop's running mean; items without a place join the stop they fall in.

    The mean depends on every earlier decision, so a device's items pass in
    time order. An empty table gives an empty one.
    """
    least = rules.stop_metres / 1000
    points = items.select(F.col("device").cast("long"), F.col("us").cast("long"), F.col("lat").cast("double"), F.col("lon").cast("double"), F.col("item_id").cast("long"))
    return folded(points, ["us", "item_id"], "stop", lambda stop, us, lat, lon, _: advance(stop, us, lat, lon, least))


def visits(found: DataFrame, rules: Trip = Trip()) -> DataFrame:
    """(device, visit, lat, lon, first_us, last_us, n): neighbouring stops within 3 km and eight hours folded into one, its centre weighted by items; an empty table gives an empty one."""
    gap = int(rules.visit_gap_hours * 3_600_000_000)

    def step(visit, _, lat, lon, first, last, n):
        if visit and first - visit[4] <= gap and distance_km(visit[1], visit[2], lat, lon) * 1000 <= rules.visit_metres:
            m = visit[5]
            return [visit[0], (visit[1] * m + lat * n) / (m + n), (visit[2] * m + lon * n) / (m + n), visit[3], max(visit[4], last), m + n], None
        return [visit[0] + 1 if visit else 0, lat, lon, first, last, n], visit

    return folded(found.select("device", "stop", "lat", "lon", "first_us", "last_us", "n"), ["stop"], "visit", step)


DAY_US = 86_400_000_000


def chapter_stop(told: DataFrame, found: DataFrame, slack_us: int = 1_000_000) -> DataFrame:
    """(device, chapter, stop, inside): the stop of a chapter's time that most of its items fall in, ties to the first; null if it has none.

    Times meet by device and day, an equi-join, before the exact condition.
    """
    day = lambda c: F.floor(F.col(c) / DAY_US)
    span = found.select(F.col("device").alias("d"), "stop", F.col("first_us").alias("a"), F.col("last_us").alias("b"))
    days = span.withColumn("day", F.explode(F.sequence(F.floor(F.col("a") / DAY_US), F.floor(F.col("b") / DAY_US))))
    items = told.select("device", "chapter", "us", day("us").alias("day"))
    hits = items.join(days.withColumnsRenamed({"day": "dd"}), (F.col("device") == F.col("d")) & (F.col("day") == F.col("dd")) & F.col("us").between(F.col("a"), F.col("b")))
    hits = hits.groupBy("device", "chapter", "stop").agg(F.count("*").alias("inside"))
    ends = told.groupBy("device", "chapter").agg(F.min("us").alias("f"), F.max("us").alias("l"))
    edge = F.floor((F.col("f") - slack_us) / DAY_US), F.floor((F.col("l") + slack_us) / DAY_US)
    close = ends.withColumn("day", F.explode(F.sequence(*edge))).join(days.withColumnsRenamed({"day": "dd"}), (F.col("device") == F.col("d")) & (F.col("day") == F.col("dd")) & (F.col("a") <= F.col("l") + slack_us) & (F.col("b") >= F.col("f") - slack_us))
    pairs = close.select("device", "chapter", "stop").distinct().join(hits, ["device", "chapter", "stop"], "left").fillna(0, ["inside"])
    best = pairs.groupBy("device", "chapter").agg(F.max(F.struct("inside", (-F.col("stop")).alias("s"))).alias("m"))
    return ends.select("device", "chapter").join(best, ["device", "chapter"], "left").select("device", "chapter", (-F.col("m.s")).alias("stop"), F.col("m.inside").alias("inside"))


def item_in_range(items: DataFrame, ranges: DataFrame, slack_us: int = 1_000_000, missing: int | None = None) -> DataFrame:
    """Each item's first range of its device, with slack at both ends, else ``missing``: an equi-join by device and day, then the exact condition and the least."""
    a, b = F.col("first_us") - slack_us, F.col("last_us") + slack_us
    days = ranges.select(F.col("device").alias("d"), "chapter", a.alias("a"), b.alias("b")).withColumn("day", F.explode(F.sequence(F.floor(F.col("a") / DAY_US), F.floor(F.col("b") / DAY_US))))
    near = (F.col("device") == F.col("d")) & (F.floor(F.col("us") / DAY_US) == F.col("day")) & F.col("us").between(F.col("a"), F.col("b"))
    return items.select("item_id", "device", "us").join(days, near, "left").groupBy("item_id").agg(F.coalesce(F.min("chapter"), F.lit(missing).cast("bigint")).alias("chapter"))


def trip_stats(items: DataFrame) -> DataFrame:
    """(device, span_s, days, has_gps)."""
    return items.groupBy("device").agg(((F.max("us") - F.min("us")) / F.lit(1e6)).alias("span_s"), F.count_distinct(local_day()).alias("days"), F.coalesce(F.bool_or(F.col("lat").isNotNull()), F.lit(False)).alias("has_gps"))
