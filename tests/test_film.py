"""The whole cut list against a walk over one device at a time."""

import math

import pytest
from pyspark.sql import functions as F

from framesift.config import Plan
from framesift.operators import choose
from framesift.plans import film as plan_film

DATA = "/root/testdata/sf0.001"
MOVES = ("in", "out", "left", "right", "up", "down", "still")


def fill(rows, plan, budget):
    need = lambda r: plan.video_slot if r.kind == "video" else plan.photo_slot
    rows = [r for r in rows if r.kind != "video" or r.seconds >= plan.video_slot - 1e-6]
    total, chosen, used = sum(map(need, rows)), [], 0.0

    def fits(r):
        return used + need(r) <= budget or len(chosen) < 4

    def take(r):
        nonlocal used
        chosen.append(r)
        used += need(r)

    for r in [r for r in rows if r.kind == "video"][: max(1, round(plan.video_share * budget / plan.photo_slot))]:
        if fits(r):
            take(r)
    for c in sorted({r.chapter for r in rows}):
        mine, spent = [r for r in rows if r.chapter == c], 0.0
        quota = max(plan.photo_slot, sum(map(need, mine)) / total * plan.quota_share * budget)
        for r in mine:
            if used >= budget:
                break
            if r in chosen:
                continue
            if spent + need(r) > quota or not fits(r):
                break
            spent += need(r)
            take(r)
    for r in rows:
        if r not in chosen and used < budget and fits(r):
            take(r)
    return chosen


def select(rows, plan):
    rows = sorted(rows, key=lambda r: (-r.score, r.item_id))
    budget = rows[0].budget
    for cap in [plan.per_minute * k for k in (1, 2, 4, 8)]:
        buckets, kept = {}, []
        for r in rows:
            n = buckets[r.us // 60_000_000] = buckets.get(r.us // 60_000_000, 0) + 1
            if n <= cap and r.hash and all((r.hash ^ k.hash).bit_count() > 10 for k in kept):
                kept.append(r)
        chosen = fill(kept, plan, budget)
        if len(chosen) * min(plan.photo_slot, plan.video_slot) >= 0.97 * budget:
            break
    return chosen


def timing(entries, plan):
    """Beats of entries (title or row), one list at a time."""
    spb = 60.0 / plan.bpm
    titles = [e for e in entries if e[0] is None]
    total = max(len(entries), round(plan.target_seconds / spb))
    each = max(2, min(round(plan.title_seconds / spb), int(total * plan.title_beats_share / len(titles))))
    rows = [r for r, _ in entries if r is not None]
    left = max(len(rows), total - each * len(titles))
    s = [max(0.02, r.score) for r in rows]
    raw = [0.78 + 0.44 * (x - min(s)) / (max(s) - min(s)) if max(s) > min(s) else 1.0 for x in s]
    mean = sum(raw) / len(raw)
    by = {}
    for r, w in zip(rows, raw):
        by.setdefault(r.chapter, []).append(w)
    weight = [max(0.02, w - sum(by[r.chapter]) / len(by[r.chapter]) + mean) for r, w in zip(rows, raw)]
    bounds = []
    for r in rows:
        least, most = plan.video_range if r.kind == "video" else plan.photo_range
        low = max(1, math.ceil(least / spb))
        high = max(low, math.floor(most / spb))
        if r.footage is not None:
            high = max(1, min(high, int(r.footage / spb)))
        bounds.append((low, max(low, high)))
    want = [w / sum(weight) * left for w in weight]
    out = [math.floor(x) for x in want]
    for i in sorted(range(len(out)), key=lambda i: (-(want[i] - out[i]), i))[: left - sum(out)]:
        out[i] += 1
    if sum(a for a, _ in bounds) > left:
        out = [a for a, _ in bounds]
    elif sum(b for _, b in bounds) <= left:
        out = [b for _, b in bounds]
    else:
        out = [max(a, min(b, x)) for x, (a, b) in zip(out, bounds)]
        while sum(out) != left:
            up = sum(out) < left
            can = [i for i, (a, b) in enumerate(bounds) if (out[i] < b if up else out[i] > a)]
            i = min(can, key=lambda i: (out[i] - want[i], i)) if up else max(can, key=lambda i: (out[i] - want[i], i))
            out[i] += 1 if up else -1
    out = iter(out)
    return [each if r is None else next(out) for r, _ in entries]


def model(rows, plan):
    spb, fps = 60.0 / plan.bpm, plan.fps
    chosen, entries = sorted(select(rows, plan), key=lambda r: (r.chapter, r.us, r.item_id)), []
    for r in chosen:
        if not entries or entries[-1][1] != r.chapter:
            entries.append((None, r.chapter))
        entries.append((r, r.chapter))
    dropped = 0
    while True:
        beats = timing(entries, plan)
        frames = [round(sum(beats[: i + 1]) * (spb * fps)) for i in range(len(beats))]
        if frames[-1] / fps <= plan.target_seconds * 1.02 + 0.05 or dropped >= 64 or sum(r is not None for r, _ in entries) <= 3:
            break
        at = min((i for i, (r, _) in enumerate(entries) if r is not None), key=lambda i: entries[i][0].score)
        del entries[at]
        dropped += 1
    slack = round(plan.target_seconds * fps) - frames[-1]
    if abs(slack) <= 0.5 * spb * fps + 1:
        frames[-1] += slack
    slots = []
    for i, ((r, chapter), b) in enumerate(zip(entries, beats)):
        start = frames[i - 1] if i else 0
        slots.append([i + 1, r, None, chapter, b, start, frames[i] - start, None if r is None else MOVES[(5 * i + i // 7) % 7]])
    out, i = [], 0
    tall = lambda r: r is not None and r.kind == "photo" and r.item_id % 3 != 0
    while i < len(slots):
        s = slots[i]
        if i + 1 < len(slots) and tall(s[1]) and tall(slots[i + 1][1]):
            s[2], s[4], s[6] = slots[i + 1][1].item_id, s[4] + slots[i + 1][4], s[6] + slots[i + 1][6]
            i += 1
        out.append((s[0], s[1].item_id if s[1] is not None else None, s[2], s[3], s[4], round(s[5] / fps, 6), round(s[6] / fps, 6), s[7]))
        i += 1
    return out


@pytest.mark.parametrize("plan", [Plan(), Plan(target_seconds=24.0), Plan(target_seconds=61.3, bpm=126.05, fps=60, per_minute=1)])
def test_film_equals_walk(spark, plan, monkeypatch):
    some = plan_film.items
    monkeypatch.setattr(plan_film, "items", lambda s, d: some(s, d).withColumn("device", F.col("device") % 5))  # longer lists
    rows = {}
    for r in plan_film.candidates(spark, DATA, plan).collect():
        rows.setdefault(r.device, []).append(r)
    got = {}
    for r in plan_film.film(spark, DATA, plan).orderBy("device", "pos").collect():
        got.setdefault(r.device, []).append((r.pos, r.item_id, r.pair, r.chapter, r.beats, r.start_s, r.seconds, r.motion))
    assert got == {d: model(rs, plan) for d, rs in rows.items()}


def test_shedding_keeps_three(spark):
    rows = [(1, p, False, p / 10.0, 6, 8) for p in range(1, 13)] + [(1, 0, True, None, None, None), (2, 1, False, 0.5, 6, 8), (2, 0, True, None, None, None)]
    df = spark.createDataFrame(rows, "device long, pos long, is_title boolean, score double, low long, high long")
    got = {}
    for r in choose.shed_weakest(df, ["device"], Plan(target_seconds=1.0)).collect():
        got.setdefault(r.device, []).append(r.pos)
    assert sorted(got[1]) == [0, 10, 11, 12] and sorted(got[2]) == [0, 1]
    assert choose.shed_weakest(df.limit(0), ["device"]).count() == 0
