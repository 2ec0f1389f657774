"""Chapters and stops of unbounded streams, exact under disorder, closed by event-time timers."""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Trip
from ..operators.trip import advance, distance_km

EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
#: An item as the fold takes it: microseconds, id, place, offset from UTC in seconds.
Item = tuple[int, int, float | None, float | None, int | None]


def local_day(us: int, off_s: int | None) -> int:
    """Days since 1970 of a time at its place."""
    return (us + (off_s or 0) * 1_000_000) // 86_400_000_000


def chapter_fold(on_move: bool, rules: Trip) -> Callable[[list | None, Item], tuple[list, list | None]]:
    """A chapter [number, first, last, n, lat, lon, day] with one more item; the chapter that the item closes, if any: after a long gap, on another local day or, ``on_move``, after a real move between two located items."""
    gap = int(rules.chapter_gap_hours * 3_600_000_000)

    def step(held, item):
        us, _, lat, lon, off = item
        day, place = local_day(us, off), (lat, lon)
        if held is None:
            return [0, us, us, 1, *place, day], None
        moved = on_move and None not in (*place, held[4], held[5]) and distance_km(held[4], held[5], lat, lon) * 1000 >= rules.chapter_move_metres
        if us - held[2] >= gap or day != held[6] or moved:
            return [held[0] + 1, us, us, 1, *place, day], held
        return [held[0], held[1], us, held[3] + 1, *place, day], None

    return step


def stop_fold(rules: Trip) -> Callable[[list | None, Item], tuple[list | None, list | None]]:
    """A stop [number, lat, lon, first, last, n] with one more item; the stop that it closes, if any."""
    def step(held, item):
        us, _, lat, lon, _ = item
        return advance(held, us, lat, lon, rules.stop_metres / 1000)

    return step


def folded_stream(stream: DataFrame, step, silent: timedelta, late: str, shape: str, row, last_at: int) -> DataFrame:
    """What ``step`` closes over each device's items, taken in order of time and id however they arrive.

    A device's state is its open piece and the items that the watermark has not
    passed yet: only they can still be overtaken, so their number is bounded by
    the lateness allowed. A timer fires when the watermark passes the first of
    them, or the open piece's last item by ``silent``; then the piece is closed,
    and the next item that can begins another. Items later than the watermark
    are dropped.
    """
    wait = int(silent.total_seconds() * 1000)

    def run(key, batches, state):
        waiting, held, shut = json.loads(state.get[0]) if state.exists else ([], None, False)
        if not state.hasTimedOut:
            for b in batches:
                cols = [b[c].astype(object).where(b[c].notna(), None).tolist() for c in ("us", "item_id", "lat", "lon", "off_s")]
                waiting += map(list, zip(*cols))
        now = state.getCurrentWatermarkMs() * 1000
        waiting.sort(key=lambda x: (x[0], x[1]))
        ready = [x for x in waiting if x[0] < now]
        waiting = waiting[len(ready) :]
        out = []
        for item in ready:
            if shut:  # numbers go on
                fresh, _ = step(None, tuple(item))
                if fresh:
                    fresh[0] = held[0] + 1
                    held, shut = fresh, False
                continue
            held, done = step(held, tuple(item))
            if done:
                out.append(done)
        if held and not shut and now >= held[last_at] + wait * 1000:
            out.append(held)
            shut = True
        state.update((json.dumps([waiting, held, shut]),))
        soon = [x[0] // 1000 + 1 for x in waiting[:1]] + ([held[last_at] // 1000 + wait] if held and not shut else [])
        if soon:
            state.setTimeoutTimestamp(max(min(soon), now // 1000 + 1))
        if out:
            yield pd.DataFrame([row(key[0], x) for x in out])

    timed = stream.withWatermark("ts", late).select("device", F.unix_micros("ts").alias("us"), "ts", F.col("item_id").cast("long"), F.col("lat").cast("double"), F.col("lon").cast("double"), F.col("off_s").cast("long"))
    return timed.groupBy("device").applyInPandasWithState(run, shape, "held string", "append", "EventTimeTimeout")


def instant(us: int) -> datetime:
    """A time as the worker gives it to Spark."""
    return (EPOCH + timedelta(microseconds=us)).replace(tzinfo=None)


def chapter_stream(stream: DataFrame, on_move: bool = False, late: str = "1 hour", rules: Trip = Trip()) -> DataFrame:
    """(device, chapter, start, last, n) of each chapter of a stream of items (device, ts, item_id, lat, lon, off_s), once no item to come can belong to it.

    Equal to the chapters of the same items in batch: by gap, local day and,
    with ``on_move``, moves, whatever the order within ``late``. The last
    chapter comes out when the watermark is a chapter's gap past it.
    """
    silent = timedelta(hours=rules.chapter_gap_hours)
    shape = "device long, chapter long, start timestamp, last timestamp, n long"
    row = lambda device, x: {"device": device, "chapter": x[0], "start": instant(x[1]), "last": instant(x[2]), "n": x[3]}
    return folded_stream(stream, chapter_fold(on_move, rules), silent, late, shape, row, 2)


def stop_intervals(stream: DataFrame, late: str = "1 hour", silent: timedelta = timedelta(days=1), rules: Trip = Trip()) -> DataFrame:
    """(device, stop, lat, lon, first, last, n) of each stop of a stream of items as in ``chapter_stream``.

    Equal to the stops of the same items in batch, whatever the order within
    ``late``, unless a device is silent for ``silent``: its stop then comes
    out when the watermark has passed that, and the next located item begins
    a new stop even where the device has not moved; items without a place
    before that count nowhere.
    """
    shape = "device long, stop long, lat double, lon double, first timestamp, last timestamp, n long"
    row = lambda device, x: {"device": device, "stop": x[0], "lat": x[1], "lon": x[2], "first": instant(x[3]), "last": instant(x[4]), "n": x[5]}
    return folded_stream(stream, stop_fold(rules), silent, late, shape, row, 4)
