"""Chapters, stops and the best of each minute of an unbounded stream of items."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Trip
from ..operators.trip import advance


def chapter_sessions(stream: DataFrame, late: str = "1 hour", rules: Trip = Trip()) -> DataFrame:
    """(device, start, last, n) of each chapter by gaps alone: a gap of five hours or more parts chapters.

    A session window keeps events together up to its gap inclusively, so the
    gap is a microsecond short. State is one window a device; items later than
    the watermark are dropped.
    """
    gap = f"{int(rules.chapter_gap_hours * 3600 * 1_000_000) - 1} microseconds"
    session = F.session_window("ts", gap)
    return stream.withWatermark("ts", late).groupBy("device", session).agg(F.min("ts").alias("start"), F.max("ts").alias("last"), F.count("*").alias("n")).select("device", "start", "last", "n")


def minute_bests(stream: DataFrame, late: str = "10 minutes") -> DataFrame:
    """(device, minute, n, best) of each minute of a device."""
    return stream.withWatermark("ts", late).groupBy("device", F.window("ts", "1 minute").alias("w")).agg(F.count("*").alias("n"), F.max("score").alias("best")).select("device", F.col("w.start").alias("minute"), "n", "best")


def minute_picks(stream: DataFrame, cap: int = 2, late: str = "10 minutes") -> DataFrame:
    """(device, minute, picks): the ids of a minute's best items (item_id, score), ``cap`` at most, ties to the least id; state is a minute's items."""
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "item_id"))), 1, cap)
    held = stream.withWatermark("ts", late).groupBy("device", F.window("ts", "1 minute").alias("w")).agg(best.alias("b"))
    return held.select("device", F.col("w.start").alias("minute"), F.transform("b", lambda x: x["item_id"]).alias("picks"))


def stop_stream(stream: DataFrame, rules: Trip = Trip()) -> DataFrame:
    """(device, stop, lat, lon, first, last, n) of each stop of a stream of points (device, ts, lat, lon), once the device has moved on.

    Points of a device are taken in order of time within a batch and in order
    of batches; its state is the open stop. A stop that no later point closes
    stays open.
    """

    def step(key, batches, state):
        stop = list(state.get) if state.exists else None
        points = pd.concat(list(batches)).sort_values("ts", kind="stable")
        closed = []
        for ts, lat, lon in zip(points["ts"], points["lat"], points["lon"]):
            stop, done = advance(stop, int(ts.value // 1000), None if pd.isna(lat) else lat, None if pd.isna(lon) else lon, rules.stop_metres / 1000)
            if done:
                closed.append(done)
        if stop:
            state.update(tuple(stop))
        if closed:
            n, lat, lon, first, last, size = zip(*closed)
            yield pd.DataFrame({"device": [key[0]] * len(closed), "stop": n, "lat": lat, "lon": lon, "first": pd.to_datetime(first, unit="us"), "last": pd.to_datetime(last, unit="us"), "n": size})

    shape = "device long, stop long, lat double, lon double, first timestamp, last timestamp, n long"
    return stream.select("device", "ts", "lat", "lon").groupBy("device").applyInPandasWithState(step, shape, "stop long, lat double, lon double, first long, last long, n long", "append", "NoTimeout")
