"""Editing operators against sequential models."""

import json
import math
import random
from statistics import median

from pyspark.sql import functions as F

from framesift.config import Plan
from framesift.functions import columns as C
from framesift.operators import arrange, checks, choose, fill, series, trip
from framesift.sources import sinks

ITEM = "device long, item_id long, us long, chapter long, kind string, seconds double, score double"


def model_fill(rows, plan):
    """One device's choice by walking over all its items, without any reduction before."""
    need = lambda r: plan.video_slot if r[4] == "video" else plan.photo_slot
    rows = sorted((r for r in rows if r[4] != "video" or r[5] >= plan.video_slot - 1e-6), key=lambda r: (-r[6], r[1]))
    total = sum(map(need, rows))
    chosen, used = [], 0.0

    def fits(r):
        return used + need(r) <= plan.target_seconds or len(chosen) < 4

    for r in [r for r in rows if r[4] == "video"][: max(1, round(plan.video_share * plan.target_seconds / plan.photo_slot))]:
        if fits(r):
            chosen.append(r)
            used += need(r)
    for c in sorted({r[3] for r in rows}):
        mine = [r for r in rows if r[3] == c]
        quota, spent = max(plan.photo_slot, sum(map(need, mine)) / total * plan.quota_share * plan.target_seconds), 0.0
        for r in mine:
            if used >= plan.target_seconds:
                break
            if r in chosen:
                continue
            if spent + need(r) > quota or not fits(r):
                break
            chosen.append(r)
            used, spent = used + need(r), spent + need(r)
    for r in rows:
        if r not in chosen and used < plan.target_seconds and fits(r):
            chosen.append(r)
            used += need(r)
    return [r[1] for r in chosen]


def some_items(seed, n=160, devices=6):
    rnd = random.Random(seed)
    return [(i % devices, i, rnd.randrange(40) * 20_000_000, rnd.randrange(1 + i % devices), rnd.choice(["photo", "video"]), rnd.choice([1.0, 2.0, 5.0]), rnd.randrange(12) / 10) for i in range(n)]


def test_greedy_fill_equals_walk(spark):
    rows = some_items(4)
    for target in (3.0, 20.0, 37.0, 500.0):
        plan = Plan(target_seconds=target)
        got = {}
        for r in fill.greedy_fill(spark.createDataFrame(rows, ITEM), ["device"], plan).orderBy("device", "pick").collect():
            got.setdefault(r.device, []).append(r.item_id)
        assert got == {d: model_fill([r for r in rows if r[0] == d], plan) for d in range(6)}


def test_ladder_takes_first_full_cap(spark):
    rows, plan = some_items(8), Plan(target_seconds=40.0, per_minute=1)
    want = {}
    for d in range(6):
        for cap in (1, 2, 4, 8):
            buckets = {}
            for r in sorted((r for r in rows if r[0] == d), key=lambda r: (-r[6], r[1])):
                buckets.setdefault(r[2] // 60_000_000, []).append(r)
            picks = model_fill([r for b in buckets.values() for r in b[:cap]], plan)
            want[d] = (cap, picks)
            if len(picks) * 2.0 >= 0.97 * 40:
                break
    got = {}
    for r in fill.fill_ladder(spark.createDataFrame(rows, ITEM), plan).orderBy("device", "pick").collect():
        got.setdefault(r.device, (r.cap, []))[1].append(r.item_id)
    assert got == want


def test_shots_equal_walk(spark):
    rnd = random.Random(2)
    clips = [(k, [rnd.choice([2.0, 3.0, 4.0, 60.0 if rnd.random() < 0.2 else 1.0]) for _ in range(rnd.choice([0, 1, 2, 5, 30, 90]))]) for k in range(30)]
    want = set()
    for k, m in clips:
        if not m:
            continue
        at = [0]
        if len(m) >= 3:
            mid = median(m)
            high = max(0.28 * 255 * 0.35, mid + 6 * (1.4826 * median(abs(v - mid) for v in m)))
            for i in range(1, len(m)):
                if m[i] >= high and i - at[-1] >= 2:
                    at.append(i)
        for a, b in zip(at, [*at[1:], len(m)]):
            p = math.ceil((b - a) / 18)
            for j in range(p):
                first, last = a + round(j * (b - a) / p), a + round((j + 1) * (b - a) / p)
                if min(len(m) / 3, last / 3) - first / 3 >= 0.8:
                    want.add((k, first, last))
    df = spark.createDataFrame(clips, "clip long, motion array<double>").withColumn("seconds", F.size("motion") / 3.0)
    assert {(r.clip, r.first, r.last) for r in series.shots(df, "clip").collect()} == want


def test_sections_fill_the_piece(spark):
    bars = [0, 1, 7, 47, 48, 99, 100, 169, 170, 400, 1500]
    got = spark.createDataFrame([(b,) for b in bars], "bars int").select("bars", arrange.section_plan(F.col("bars")).alias("p")).collect()
    for r in got:
        if r.bars == 0:
            assert r.p == []
            continue
        assert sum(s.bars for s in r.p) == max(7, r.bars)
        middle = [s.bars for s in r.p[1:-1]]
        assert max(middle) - min(middle) <= 1 and max(middle) <= 32 or r.bars < 48
        assert (r.p[0].name, r.p[0].bars, r.p[-1].name, r.p[-1].bars) == ("open", 2, "close", 4)
    tempo = spark.range(1).select(arrange.frame_tempo(F.lit(126.05), 60), arrange.frame_tempo(F.lit(0.0), 60)).first()
    assert abs(tempo[0] - 60 * 60 / 29) < 1e-9 and tempo[1] == 120.0


def test_visits_fold_walks_and_keep_days_apart(spark):
    h = 3_600_000_000
    stops = [(1, 0, 35.0, 135.0, 0, h, 2), (1, 1, 35.01, 135.0, 2 * h, 3 * h, 1), (1, 2, 35.01, 135.0, 12 * h, 13 * h, 1), (1, 3, 34.0, 135.0, 14 * h, 14 * h, 5)]
    got = trip.visits(spark.createDataFrame(stops, "device long, stop long, lat double, lon double, first_us long, last_us long, n long")).orderBy("visit").collect()
    assert [(r.n, round(r.lat, 4), r.first_us, r.last_us) for r in got] == [(3, 35.0033, 0, 3 * h), (1, 35.01, 12 * h, 13 * h), (5, 34.0, 14 * h, 14 * h)]


def test_labels_dates_and_silence(spark):
    one = spark.range(1)
    label = lambda la, lo, *n: one.select(C.place_label(F.lit(la), F.lit(lo), *map(F.lit, n)).alias("p")).first().p
    assert label(1.5, -2.25, " Kyoto ", "Kyoto", "Japan", "Asia") == "Kyoto, Japan"
    assert label(1.5, -2.25, "", None) == "1.50°N 2.25°W" and label(0.0, 0.0, None) == label(None, None, None) == "Unlocated"
    dates = ["2024:02:29 10:00:00", "2023:02:29 10:00:00", "2024-01-02", "2024:01-02", "1989:01:01", "0000:00:00 00:00:00", " 2024-01-02 03:04 ", "", None, "2024:13:01", "2024:01:01 24:00"]
    got = [r.s for r in spark.createDataFrame([(i, t) for i, t in enumerate(dates)], "i int, t string").orderBy("i").select(C.capture_seconds(F.col("t"), F.lit(3600)).alias("s")).collect()]
    assert got == [1709197200, 0, 1704150000, 0, 0, 0, 1704161040, 0, 0, 0, 0]
    tails = spark.createDataFrame([([1.0, 0.0, 0.0],), ([0.0],), ([],), ([0.0, 2.0],)], "v array<double>").select(series.trailing_silence(F.col("v")).alias("n")).collect()
    assert [r.n for r in tails] == [2, 1, 0, 0]


def test_empty_inputs(spark):
    none = spark.createDataFrame([], ITEM)
    assert fill.greedy_fill(none, ["device"]).count() == fill.fill_ladder(none).count() == choose.chapter_weights(none).count() == 0
    assert checks.fairness(spark.createDataFrame([], "device long, seconds double, shots long"), ["device"]).count() == 0
    assert series.shots(spark.createDataFrame([], "clip long, motion array<double>, seconds double"), "clip").count() == 0


def test_sinks_write_lists_and_report(spark, tmp_path):
    slots = spark.createDataFrame([(1, 1, 7, 0, 4, 60), (1, 2, 9, 0, 2, 90), (1, 3, 5, 1, 4, 150), (2, 1, 8, 0, 4, 60)], "device long, pos long, item_id long, chapter long, beats long, frame long")
    sinks.write_lines(sinks.cut_list_json(slots, ["device"]), str(tmp_path / "out"), ["device"])
    back = {r.device: json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()}
    assert back[1]["duration"] == 5.0 and back[2]["entries"][0]["source"] == 8
    assert [(e["index"], e["start"], e["duration"], e["source"]) for e in back[1]["entries"]] == [(1, 0.0, 2.0, 7), (2, 2.0, 1.0, 9), (3, 3.0, 2.0, 5)]
    lines = [r.line for r in sinks.chapter_report(slots, ["device"]).where("device = 1").orderBy("chapter").collect()]
    assert lines == ["| 0 | 2 | 3.0 | ################## |", "| 1 | 1 | 2.0 | ############...... |"]
    assert sinks.cut_list_json(slots.where("device = 5"), ["device"]).count() == 0
