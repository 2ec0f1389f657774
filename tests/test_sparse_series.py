"""Series with places left out, against the same with zeros."""

import random

from framesift.operators import signal


def test_series_with_gaps_equal_filled_ones(spark):
    rnd = random.Random(8)
    rows = [(k, i, float(rnd.randrange(1, 4))) for k in (1, 2, 3) for i in sorted({0, 150 * k, *(rnd.randrange(150 * k) for _ in range(40 * k))})]
    bins = spark.createDataFrame(rows, "k long, i long, v double")
    dense = signal.filled(bins, "k")
    tempos = signal.tempo(bins, "k", 40)
    want = sorted(map(tuple, signal.beats(dense, tempos, "k", 40).collect()))
    assert len(want) > 6 and sorted(map(tuple, signal.beats(bins, tempos, "k", 40).collect())) == want


def test_products_across_blocks_of_a_series(spark, monkeypatch):
    rnd = random.Random(2)
    n, low, high = 300, 3, 40
    x = [float(rnd.randrange(3)) for _ in range(n - 1)] + [1.0]
    bins = spark.createDataFrame([(1, i, v) for i, v in enumerate(x) if v], "k long, i long, v double")
    mean = sum(x) / n
    c = [v - mean for v in x]
    want = {lag: sum(c[i] * c[i + lag] for i in range(n - lag)) / (sum(v * v for v in c) + 1e-9) for lag in range(low, high + 1)}
    for size in (4096, 64, 16):
        monkeypatch.setattr(signal, "BLOCK", size)
        got = {r.lag: r.r for r in signal.autocorrelation(bins, "k", (low, high)).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want), size
