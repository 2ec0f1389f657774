"""The cap ladder: steps that cannot differ are not filled again, and groups of any size are thinned alike."""

import random

from pyspark.sql import functions as F

from framesift.operators import choose, fill


def test_equal_steps_are_filled_once(spark):
    # device 1: no minute of more than 2; device 2: one of 3; device 3: one of 9; device 4: items without a time alone
    crowds = {1: [1, 2, 2], 2: [3, 1], 3: [9], 4: []}
    rows = [(d, d * 100 + 10 * m + k, (m * 60 + k) * 1_000_000, 0, "photo", 3.0, (7 * k % 10) / 10) for d, c in crowds.items() for m, n in enumerate(c) for k in range(n)]
    rows += [(4, 400 + k, None, 0, "photo", 3.0, 0.5) for k in range(5)]
    df = spark.createDataFrame(rows, "device long, item_id long, us long, chapter long, kind string, seconds double, score double")
    seen = {}

    def between(steps):
        seen["steps"] = {(r.device, r.cap) for r in steps.select("device", "cap").distinct().collect()}
        return steps

    got = fill.fill_ladder(df, between=between).collect()
    assert seen["steps"] == {(1, 2), (2, 2), (2, 4), (3, 2), (3, 4), (3, 8), (3, 16), (4, 2)}
    assert {r.cap for r in got} == {16} and len(got) == len(rows)


def test_groups_beyond_a_task_are_thinned_alike(spark, monkeypatch):
    rnd = random.Random(6)
    rows = [(g, i + 1000 * g, rnd.getrandbits(12) | 1 << 40 | rnd.getrandbits(1) << 62, float(rnd.randrange(20))) for g, n in ((0, 5), (1, 90), (2, 400)) for i in range(n)]
    df = spark.createDataFrame(rows, "g int, id long, hash long, score double").withColumn("g", F.when(F.col("g") > 0, F.col("g")))
    want = set()
    for g in (0, 1, 2):
        kept = []
        for _, i, h, _ in sorted((r for r in rows if r[0] == g), key=lambda r: (-r[3], r[1])):
            if all((h ^ x).bit_count() > 3 for x in kept):
                kept.append(h)
                want.add(i)
    for size in (4096, 50, 1):
        monkeypatch.setattr(choose, "GROUP", size)
        assert {r.id for r in choose.greedy_dedupe(df, 3, ("g",)).collect()} == want, size
