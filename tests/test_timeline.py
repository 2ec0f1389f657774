"""Queries against their SQL, and operators against sequential models."""

import random
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from framesift.catalog import ORACLE_SQL, QUERIES
from framesift.functions import columns as C
from framesift.operators import catalogue, choose, trip

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    want = duck.sql(ORACLE_SQL[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = sorted(map(str, (tuple(r[c] for c in cols) for r in got.collect())))
    at = [want.columns.index(c) for c in cols]
    assert rows == sorted(map(str, (tuple(r[i] for i in at) for r in want.fetchall())))


def test_greedy_dedupe_equals_sequential_pass(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.getrandbits(12) | 1 << 40, float(rnd.randrange(20))) for i in range(120)] + [(200, 0, 9.0)]
    kept = []
    for i, h, _ in sorted(rows[:-1], key=lambda r: (-r[2], r[0])):
        if all((h ^ x).bit_count() > 3 for _, x in kept):
            kept.append((i, h))
    got = choose.greedy_dedupe(spark.createDataFrame(rows, "id long, hash long, score double"), 3)
    assert {r.id for r in got.collect()} == {i for i, _ in kept}


def test_greedy_dedupe_settles_a_long_path(spark):
    # three bits a step: only neighbours on the path are near, and falling scores settle an item a round
    h, rows = (1 << 50) - 1, []
    rnd = random.Random(9)
    for i in range(150):
        while rows and (any((h ^ x).bit_count() <= 3 for _, x, _ in rows[:-1]) or (h ^ rows[-1][1]).bit_count() != 3):
            h = rows[-1][1] ^ sum(1 << b for b in rnd.sample(range(62), 3))
        rows.append((i, h, 150.0 - i))
    got = choose.greedy_dedupe(spark.createDataFrame(rows, "id long, hash long, score double"), 3)
    assert {r.id for r in got.collect()} == set(range(0, 150, 2))


def test_offset_borrow_equals_scan(spark):
    rnd = random.Random(5)
    rows = [(i, 1, rnd.randrange(40) * 1_800_000_000, rnd.choice([None, 3600, -7200])) for i in range(60)]
    donors = {}
    for i, _, us, off in rows:
        if off is not None:
            donors.setdefault(us, off)
    want = {}
    for i, _, us, off in rows:
        near = min(donors, key=lambda t: (abs(t - us), t), default=None)
        want[i] = None if off is not None or near is None or abs(near - us) > 6 * 3_600_000_000 else donors[near]
    got = catalogue.borrow_offsets(spark.createDataFrame(rows, "item_id long, device long, us long, off_s int"))
    assert {r.item_id: r.borrowed for r in got.collect()} == want


def test_stops_and_haversine(spark):
    points = [(0, 1, 0, 35.0116, 135.7681), (1, 1, 10, None, None), (2, 1, 20, 35.0118, 135.7683), (3, 1, 30, 34.6851, 135.8048)]
    got = trip.stops(spark.createDataFrame(points, "item_id long, device long, us long, lat double, lon double")).orderBy("stop").collect()
    assert [r.n for r in got] == [3, 1]
    km = spark.range(1).select(C.haversine_km(F.lit(35.0116), F.lit(135.7681), F.lit(34.6851), F.lit(135.8048)).alias("k")).first().k
    assert abs(km - 36.46) < 0.01


def test_scalars(spark):
    one = spark.range(1)
    rates = one.select(*[C.frame_rate(F.lit(x)) for x in ("30000/1001", "25", "0/0", "N/A", "x/y")]).first()
    assert [round(r, 2) for r in rates] == [29.97, 25.0, 0.0, 0.0, 0.0]
    offsets = one.select(*[C.utc_offset_seconds(F.lit(x)) for x in ("+09:00", "-0330", "Z", "5.5", "bad")]).first()
    assert list(offsets) == [32400, -12600, 0, 18000, 0]  # whole hours
    assert list(one.select(C.duration_text(F.lit(75.0)), C.duration_text(F.lit(3661.0))).first()) == ["1:15", "1:01:01"]


def test_bounded_units_equals_loop(spark):
    rnd = random.Random(9)
    rows, want = [], {}
    for g in range(40):
        n, total = rnd.randrange(1, 8), 50
        w = [rnd.randrange(1, 20) for _ in range(n)]
        low = [rnd.randrange(0, 8) for _ in range(n)]
        high = [x + rnd.randrange(0, 25) for x in low]
        share = [x / sum(w) * total for x in w]
        out = [int(x) for x in share]
        for i in sorted(range(n), key=lambda i: (-(share[i] - int(share[i])), i))[: total - sum(out)]:
            out[i] += 1
        if sum(low) > total:
            out = low
        elif sum(high) <= total:
            out = high
        else:
            out = [max(a, min(b, x)) for a, b, x in zip(low, high, out)]
            while sum(out) < total:
                out[min((i for i in range(n) if out[i] < high[i]), key=lambda i: (out[i] - share[i], i))] += 1
            while sum(out) > total:
                out[max((i for i in range(n) if out[i] > low[i]), key=lambda i: (out[i] - share[i], i))] -= 1
        for i in range(n):
            rows.append((g, i, w[i], low[i], high[i]))
            want[g, i] = out[i]
    got = choose.bounded_units(spark.createDataFrame(rows, "g long, key long, weight long, low long, high long"), 50, ["g"])
    assert {(r.g, r.key): r.units for r in got.collect()} == want


def test_sun_times_against_almanac(spark):
    from framesift.functions.solar import light_score, sun_times

    places = [(1718928000.0, 51.5074, -0.1278, 3 * 60 + 43, 20 * 60 + 21), (1734739200.0, 51.5074, -0.1278, 8 * 60 + 4, 15 * 60 + 53)]
    for ts, lat, lon, rise, sets in places:
        s = spark.range(1).select(sun_times(F.lit(ts), F.lit(lat), F.lit(lon)).alias("s")).first().s
        assert abs(s.rise % 86400 / 60 - rise) <= 6 and abs(s["set"] % 86400 / 60 - sets) <= 6
    polar = spark.range(1).select(sun_times(F.lit(1718928000.0), F.lit(69.6492), F.lit(18.9553)).alias("s")).first().s
    assert (polar.rise, polar["set"]) == (0.0, 0.0)
    at = lambda x: spark.range(1).select(light_score(F.lit(float(x)), F.lit(20000.0), F.lit(70000.0)).alias("l")).first().l
    assert at(21500) == 1.0 and at(45000) == 0.5 and at(0) == 0.15


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "item_id long, device long, us long, off_s int, lat double, lon double, score double, seconds double, reject string")
    assert trip.chapter_summary(empty).count() == trip.stops(empty).count() == choose.burst_cap(empty).count() == catalogue.borrow_offsets(empty).count() == 0
