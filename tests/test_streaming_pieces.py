"""Streams that arrive in disorder against the same operators in batch; a cache merged by a stream."""

import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from framesift.operators import intake, trip
from framesift.streaming.pieces import chapter_stream, stop_intervals

SHAPE = "device long, s long, item_id long, lat double, lon double, off_s long"
HOUR = 3600


def journeys():
    """Items of four devices over days, with gaps, midnights, moves, places unknown and equal times."""
    rnd, rows = random.Random(11), []
    for device in range(4):
        s, lat = 20 * HOUR + device * 5000, 35.0
        for i in range(60):
            s += rnd.choice([0, 60, 600, 1800, 1800, 3 * HOUR, 5 * HOUR, 5 * HOUR - 1, 9 * HOUR])
            lat += rnd.choice([0, 0, 0.0005, 0.03])
            place = (None, None) if rnd.random() < 0.15 else (lat, 135.0)
            rows.append((device, s, 1000 * device + i, *place, rnd.choice([None, 0, 9 * HOUR])))
    return rows


def ended(rows):
    """A last item far ahead, of a device of its own, that moves the watermark past all others."""
    return [*rows, (99, max(r[1] for r in rows) + 40 * 24 * HOUR, 0, None, None, None)]


def played(spark, tmp_path, made, name, rows, late_s):
    """The stream's result: rows in files by time, shuffled within stretches shorter than the lateness allowed."""
    rnd = random.Random(3)
    order = sorted(rows[:-1], key=lambda r: r[1] + rnd.uniform(0, late_s * 0.9))
    parts = [order[k : k + 61] for k in range(0, len(order), 61)]
    for part in (*parts, rows[-1:], [(98, rows[-1][1] + 1, 1, None, None, None)]):
        rnd.shuffle(part)
        spark.createDataFrame(part, SHAPE).select("device", F.timestamp_seconds("s").alias("ts"), "item_id", "lat", "lon", "off_s").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("device long, ts timestamp, item_id long, lat double, lon double, off_s long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = made(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return [r for r in spark.table(name).collect() if r.device < 90]


@pytest.mark.parametrize("on_move", [False, True])
def test_chapters_equal_batch_in_any_order(spark, tmp_path, on_move):
    rows = ended(journeys())
    got = sorted((r.device, r.chapter, r.start.timestamp(), r["last"].timestamp(), r.n) for r in played(spark, tmp_path, lambda s: chapter_stream(s, on_move, late="2 hours"), f"chapters{on_move}".lower(), rows, 2 * HOUR))
    whole = trip.chapter_summary(spark.createDataFrame(rows[:-1], SHAPE).withColumn("us", F.col("s") * 1_000_000), on_move=on_move)
    want = sorted((r.device, r.chapter, r.first_us / 1e6, r.last_us / 1e6, r.n) for r in whole.collect())
    assert got == want and len(want) > 60


def test_stops_equal_batch_and_the_last_comes_out(spark, tmp_path):
    rows = ended(journeys())
    got = sorted((r.device, r.stop, round(r.lat, 9), r.first.timestamp(), r["last"].timestamp(), r.n) for r in played(spark, tmp_path, lambda s: stop_intervals(s, "2 hours", timedelta(days=30)), "stop_pieces", rows, 2 * HOUR))
    whole = trip.stops(spark.createDataFrame(rows[:-1], SHAPE).withColumn("us", F.col("s") * 1_000_000))
    want = sorted((r.device, r.stop, round(r.lat, 9), r.first_us / 1e6, r.last_us / 1e6, r.n) for r in whole.collect())
    assert got == want and len(want) > 30


def test_a_silent_device_begins_a_new_stop(spark, tmp_path):
    day = 24 * HOUR
    rows = [(1, HOUR, 0, 35.0, 135.0, None), (1, HOUR + 60, 1, None, None, None), (1, 3 * day, 2, None, None, None), (1, 3 * day + 60, 3, 35.0, 135.0, None), (1, 3 * day + 90, 4, None, None, None)]
    got = sorted((r.stop, r.n) for r in played(spark, tmp_path, lambda s: stop_intervals(s, "1 hour"), "silent", ended(rows), 1))
    assert got == [(0, 2), (1, 2)]  # the third has no place, and no stop was open


def entries(spark, rows):
    return spark.createDataFrame(rows, "key string, items array<struct<score:double>>")


def held(spark, root, fingerprint="f1"):
    cache = intake.read_version(spark, root, fingerprint, "array<struct<score:double>>")
    return sorted((r.key, [x.score for x in r["items"]]) for r in cache.collect())


def test_cache_versions_merge(spark, tmp_path):
    root = str(tmp_path / "cache")
    assert held(spark, root) == []
    intake.merge_cache(entries(spark, [("a", [(1.0,)]), ("b", [(2.0,)]), (None, [(0.0,)])]), root, "f1")
    intake.merge_cache(entries(spark, [("b", [(3.0,), (4.0,)]), ("c", [])]), root, "f1")
    assert held(spark, root) == [("a", [1.0]), ("b", [3.0, 4.0]), ("c", [])]
    assert held(spark, root, "other") == []
    # a version that was not finished is not read, and is written again
    intake.merge_cache(entries(spark, [("d", [(5.0,)])]), root, "f1")
    unfinished = sorted((tmp_path / "cache").glob("v=*"))[-1]
    (unfinished / "_SUCCESS").unlink()
    assert [k for k, _ in held(spark, root)] == ["a", "b", "c"]
    intake.merge_cache(entries(spark, [("d", [(6.0,)])]), root, "f1")
    assert held(spark, root)[-1] == ("d", [6.0])
    # another configuration's entries go
    intake.merge_cache(entries(spark, [("a", [(9.0,)])]), root, "f2")
    assert held(spark, root, "f2") == [("a", [9.0])] and held(spark, root) == []
    assert len(list((tmp_path / "cache").glob("v=*"))) <= intake.KEPT_VERSIONS + 1


def test_cache_is_fed_by_a_stream_of_files(spark, tmp_path):
    root, made = str(tmp_path / "cache"), []

    def analyse(files):
        made.append(sorted(r.key for r in files.select("key").collect()))
        return files.select("key", F.array(F.struct((F.col("size") / 10).alias("score"))).alias("items"))

    def turn():
        stream = spark.readStream.schema("key string, size long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = intake.refresh_cache(stream, root, "f1", "array<struct<score:double>>", analyse, "scan").option("checkpointLocation", str(tmp_path / "c")).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()

    def come(rows):
        spark.createDataFrame(rows, "key string, size long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    come([("a", 10), ("b", 20), ("b", 20)])
    turn()
    come([("b", 20), ("c", 30)])
    turn()
    assert held(spark, root) == [("a", [1.0]), ("b", [2.0]), ("c", [3.0])]
    assert made == [["a", "b"], ["c"]]  # what is held already is not analysed again
    # a batch that is played again after its version was finished changes nothing
    last = sorted((tmp_path / "c" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))[-1]
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    turn()
    assert held(spark, root) == [("a", [1.0]), ("b", [2.0]), ("c", [3.0])] and len(made) == 2
