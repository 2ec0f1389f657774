"""Tempo, beats, resampling, image measures and near pairs against numpy and plain loops."""

import math
import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from framesift.functions import grid as G
from framesift.operators import choose, signal
from framesift.operators.light import with_light
from framesift.functions.media import light_of

FPS = 86.1328125


def series(spark, rows):
    return spark.createDataFrame([(k, i, float(v)) for k, values in rows.items() for i, v in enumerate(values)], "k long, i long, v double").repartition(3)


def pulses(bpm, n, strong=1.0, weak=1.0):
    """A pulse on each beat, every second one weak, a little spread."""
    x, spb = np.zeros(n), 60.0 * FPS / bpm
    for b in range(int(n / spb)):
        at = round(b * spb)
        for d, share in ((-1, 0.5), (0, 1.0), (1, 0.5)):
            if 0 <= at + d < n:
                x[at + d] += share * (strong if b % 2 == 0 else weak)
    return x


def plain_tempo(env, fps):
    """The estimate by full correlation of one array."""
    n = len(env)
    if n < 8:
        return 120.0
    c = env - env.mean()
    ac = np.correlate(c, c, "full")[n - 1 :]
    ac = ac / (ac[0] + 1e-9)
    low, high = max(1, round(60 / 185 * fps)), min(n - 1, round(fps))
    if high <= low:
        return 120.0
    prior = lambda b: math.exp(-0.5 * (math.log2(b / 120) / 0.9) ** 2)
    lag = max(range(low, high), key=lambda x: (round(ac[x] * prior(60 * fps / x), 12), -x))
    clip = lambda b: min(max(b, 60.0), 185.0)

    def score(b):
        x = 60 * fps / b
        a, z = int(max(1, x - 1)), int(min(n - 1, x + 1)) + 1
        return max(ac[a:z]) * prior(b) if z > a else -1.0

    bpm = clip(60 * fps / lag)
    held = score(bpm)
    for factor in (0.5, 2.0):
        other = bpm * factor
        if 60 <= other <= 185 and score(other) > held * 1.06:
            bpm, held = other, score(other)
    return bpm


def test_tempo_equals_plain_correlation(spark):
    rnd = np.random.default_rng(4)
    rows = {1: pulses(126, 2000, 1.0, 0.7), 2: pulses(100, 2000), 3: pulses(70, 1500), 4: rnd.random(400), 5: np.ones(7), 6: np.ones(20), 7: pulses(174, 3000), 8: np.zeros(50)}
    got = {r.k: r.bpm for r in signal.tempo(series(spark, rows), "k", FPS).collect()}
    for k, x in rows.items():
        assert got[k] == pytest.approx(plain_tempo(x, FPS), rel=1e-9), k
    assert abs(got[1] - 126) < 4  # half time is not the tempo
    assert signal.tempo(series(spark, rows).limit(0), "k", FPS).count() == 0


def test_sparse_bins_cost_nothing_and_count_as_zero(spark):
    x = np.zeros(600)
    x[::25] = 3.0
    x[599] = 1.0
    whole = series(spark, {1: x})
    assert signal.tempo(whole.where("v <> 0"), "k", 40).first().bpm == pytest.approx(signal.tempo(whole, "k", 40).first().bpm)
    assert sorted(map(tuple, signal.filled(whole.where("v <> 0"), "k").collect())) == sorted(map(tuple, whole.collect()))


def plain_beats(env, bpm, fps):
    n, period = len(env), 60.0 * fps / bpm
    if period <= 1 or n < int(period * 2):
        return []
    reach = math.ceil(period * 2)
    cost = [sum(-100 * math.log((reach + 2 - d) / period) ** 2 * env[t + d] for d in range(reach + 2) if t + d < n) for t in range(n)]
    score, back = [cost[0]], [0]
    for t in range(1, n):
        window = score[max(0, t - reach) : t]
        k = window.index(max(window))
        score.append(window[k] + cost[t])
        back.append(max(0, t - reach) + k)
    t, out = n - 1, [n - 1]
    while t > 0:
        t = back[t]
        out.append(t)
    return sorted(out)


def test_beats_equal_the_plain_programme(spark):
    rnd = np.random.default_rng(5)
    rows = {1: pulses(120, 500), 2: rnd.random(333), 3: np.zeros(200), 4: rnd.random(30), 5: rnd.random(90)}
    tempos = spark.createDataFrame([(1, 120.0), (2, 90.0), (3, 150.0), (4, 60.0), (5, 6000.0)], "k long, bpm double")
    got = {}
    for r in signal.beats(series(spark, rows), tempos, "k", FPS).collect():
        got.setdefault(r.k, []).append(r.i)
    bpm = {r.k: r.bpm for r in tempos.collect()}
    assert {k: sorted(v) for k, v in got.items()} == {k: b for k, x in rows.items() if (b := plain_beats(list(map(float, x)), bpm[k], FPS))}
    assert 4 not in got and 5 not in got


def test_stretching_equals_interpolation(spark):
    rnd = np.random.default_rng(6)
    rows = {1: rnd.random(50), 2: rnd.random(2), 3: rnd.random(1)}
    for rate, to in ((3, 7), (7, 3), (5, 5)):
        got = {}
        for r in signal.stretched(series(spark, rows), "k", rate, to).collect():
            got.setdefault(r.k, {})[r.i] = r.v
        for k, x in rows.items():
            m = round(len(x) * to / rate)
            want = np.interp(np.linspace(0, len(x) - 1, m), np.arange(len(x)), x)
            assert sorted(got.get(k, {})) == list(range(m)) and np.allclose([got[k][i] for i in range(m)] if m else [], want)


def test_resampling_holds_the_ends_and_skips_nulls(spark):
    s = spark.createDataFrame([("a", 10, 1.0), ("a", 20, 3.0), ("a", 20, 5.0), ("a", 30, None), ("a", 40, 0.0)], "k string, at long, v double")
    grid = spark.createDataFrame([("a", t) for t in (0, 10, 15, 20, 30, 40, 99)] + [("b", 5)], "k string, at long")
    got = {(r.k, r.at): r.v for r in signal.resampled(s, grid, "k").collect()}
    assert got == {("a", 0): 1.0, ("a", 10): 1.0, ("a", 15): 2.5, ("a", 20): 4.0, ("a", 30): 2.0, ("a", 40): 0.0, ("a", 99): 0.0, ("b", 5): None}


def test_onsets_of_short_and_silent_series(spark):
    rnd = np.random.default_rng(7)
    x = rnd.random(200)
    rows = [(1, x.tolist()), (2, [0.0] * 64), (3, [1.0] * 31), (4, [])]
    got = {r.k: r.o for r in spark.createDataFrame(rows, "k long, x array<double>").select("k", signal.onsets(F.col("x")).alias("o")).collect()}
    frames = np.array([x[t : t + 16] * np.hanning(16) for t in range(0, 185, 4)])
    level = np.log1p(100 * np.abs(np.fft.rfft(frames, axis=1)))
    flux = np.concatenate([[0.0], np.maximum(np.diff(level, axis=0), 0).sum(1)])
    taps = np.hanning(15) / np.hanning(15).sum()
    env = np.maximum(flux - np.convolve(np.pad(flux, 7, "edge"), taps, "valid"), 0)
    assert np.allclose(got[1], env / env.std()) and set(got[2]) == {0.0} and got[3] == [0.0] and got[4] == [0.0]


def test_grid_measures_equal_numpy(spark):
    rnd = np.random.default_rng(8)
    images = {1: rnd.integers(0, 256, (5, 7)).astype(float), 2: np.full((3, 3), 128.0), 3: np.zeros((2, 4)), 4: np.full((1, 1), 255.0)}
    for k, x in images.items():
        df = spark.createDataFrame([(x.ravel().tolist(),)], "g array<double>")
        r = df.select(G.tones(F.col("g")).alias("t"), G.laplacian_variance(F.col("g"), x.shape[1]).alias("l"), G.gradient_mean(F.col("g"), x.shape[1]).alias("s")).first()
        p = np.pad(x, 1, mode="edge")
        lap = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * x
        gx = p[:-2, 2:] + 2 * p[1:-1, 2:] + p[2:, 2:] - p[:-2, :-2] - 2 * p[1:-1, :-2] - p[2:, :-2]
        gy = p[2:, :-2] + 2 * p[2:, 1:-1] + p[2:, 2:] - p[:-2, :-2] - 2 * p[:-2, 1:-1] - p[:-2, 2:]
        assert (r.l, r.s) == (pytest.approx(lap.var()), pytest.approx(np.sqrt(gx**2 + gy**2).mean()))
        exposure = 1 - (abs(x.mean() - 128) / 128) ** 1.7 - 1.6 * (x > 247).mean() - 0.8 * (x < 8).mean()
        assert tuple(r.t) == pytest.approx((x.mean(), (x > 247).mean(), (x < 8).mean(), min(1, x.std() / 70), min(1, max(0, exposure))))


def test_eight_orientations_of_a_marked_image(spark):
    x = np.arange(6).reshape(2, 3)
    shown = {1: x, 2: x[:, ::-1], 3: x[::-1, ::-1], 4: x[::-1], 5: x.T, 6: np.rot90(x, -1), 7: x[::-1, ::-1].T, 8: np.rot90(x), 0: x, 9: x, None: x}
    rows = [(o, x.ravel().tolist()) for o in shown]
    for r in spark.createDataFrame(rows, "o int, g array<int>").select("o", G.turned(F.col("g"), 3, F.col("o")).alias("t")).collect():
        assert r.t == shown[r.o].ravel().tolist(), r.o


def test_motion_between_frames(spark):
    rows = [("a", 1, [0.0, 0.0]), ("a", 2, [2.0, 4.0]), ("a", 3, [1.0]), ("a", 4, None), ("b", 1, [5.0, 5.0]), ("b", 2, [])]
    got = {(r.c, r.i): r.motion for r in G.frame_motion(spark.createDataFrame(rows, "c string, i int, g array<double>"), ["c"], ["i"], "g").collect()}
    assert got == {("a", 1): 0.0, ("a", 2): 3.0, ("a", 3): 0.0, ("a", 4): 0.0, ("b", 1): 0.0, ("b", 2): 0.0}


def test_near_pairs_at_any_number_of_blocks(spark):
    rnd = random.Random(9)
    hashes = [rnd.getrandbits(64) for _ in range(40)]
    hashes += [h ^ sum(1 << b for b in rnd.sample(range(64), rnd.randrange(0, 14))) for h in hashes for _ in range(3)]
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    df = spark.createDataFrame([(i, signed(h)) for i, h in enumerate(hashes)], "id long, hash long")
    want = sorted((i, j, (a ^ b).bit_count()) for (i, a), (j, b) in combinations(enumerate(hashes), 2) if (a ^ b).bit_count() <= 10)
    for rows in (10, 10**4, 10**6):
        assert sorted(map(tuple, choose.near_pairs(df, 10, rows=rows).collect())) == want, rows


def test_keys_of_near_pairs_stay_short():
    rnd = np.random.default_rng(10)
    hashes, most = rnd.integers(0, 1 << 63, 1_000_000, dtype=np.uint64), 10
    c = choose.key_blocks(len(hashes), most)
    cut = [64 * i // (most + c) for i in range(most + c + 1)]
    blocks = [(1 << cut[i + 1]) - (1 << cut[i]) for i in range(most + c)]
    for s in (blocks[:c], blocks[3 : 3 + c], blocks[-c - 1 : -1]):
        assert np.unique(hashes & np.uint64(sum(s)), return_counts=True)[1].max() < len(hashes) // 1000
    assert choose.key_blocks(100, 10) == 1 and choose.key_blocks(10**9, 10) >= c


def test_light_column_by_column_equals_the_expression(spark):
    rnd = random.Random(12)
    rows = [(float(rnd.randrange(1, 2_000_000_000)), rnd.uniform(-80, 80), rnd.uniform(-180, 180)) for _ in range(120)] + [(None, 1.0, 1.0), (0.0, 1.0, 1.0), (1.7e9, None, None), (1.7e9, 0.0, 0.0), (1.7e9, 50.0, None)]
    df = spark.createDataFrame(rows, "ts double, lat double, lon double")
    out = with_light(df, F.col("ts"), F.col("lat"), F.col("lon")).withColumn("want", light_of(F.col("ts"), F.col("lat"), F.col("lon"))).collect()
    assert len(out) == len(rows) and all(r.light == pytest.approx(r.want, abs=1e-9) for r in out)
