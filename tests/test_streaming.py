"""Streams of files against the same computation in batch."""

from pyspark.sql import functions as F

from framesift.operators import trip
from framesift.streaming.chapters import chapter_sessions, minute_bests, minute_picks, stop_stream


def run(spark, tmp_path, made, name):
    at = [0, 3600, 5 * 3600 + 3600, 5 * 3600 + 3600 + 17999, 200_000]  # the third is five hours after the second
    rows = spark.createDataFrame([(1, t, t / 10.0) for t in at] + [(2, 30, 1.0), (2, 40, 2.0)], "device long, s long, score double")
    rows.select("device", F.timestamp_seconds("s").alias("ts"), "score").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("device long, ts timestamp, score double").parquet(str(tmp_path / "in"))
    q = made(stream).writeStream.format("memory").queryName(name).outputMode("complete" if name in ("minutes", "picks") else "append").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.table(name).collect()


def test_chapters_part_at_five_hours(spark, tmp_path):
    got = {(r.device, r.start.timestamp(), r.n) for r in run(spark, tmp_path, chapter_sessions, "sessions")}
    assert got == {(1, 0.0, 2), (1, 21600.0, 2), (2, 30.0, 2)}  # the last session is still open


def test_minutes(spark, tmp_path):
    got = {(r.device, r.minute.timestamp()): (r.n, r.best) for r in run(spark, tmp_path, minute_bests, "minutes")}
    assert got[2, 0.0] == (2, 2.0) and len(got) == 6


def test_minute_picks(spark, tmp_path):
    got = {(r.device, r.minute.timestamp()): list(r.picks) for r in run(spark, tmp_path, lambda s: minute_picks(s.withColumn("item_id", F.unix_seconds("ts")), 1), "picks")}
    assert got[2, 0.0] == [40] and len(got) == 6


def test_stops_close_as_in_batch(spark, tmp_path):
    rows = [(d, i, 1000 * i + d, None if (i + d) % 7 == 0 else 35.0 + 0.003 * (i // 4) + 0.0001 * (i % 3), 135.0) for d in (1, 2, 3) for i in range(40)]
    points = spark.createDataFrame(rows, "device long, item_id long, s long, lat double, lon double")
    shape = "device long, ts timestamp, lat double, lon double"
    for k in range(4):  # ten points of each device a file
        points.where(F.col("item_id").between(10 * k, 10 * k + 9)).select("device", F.timestamp_seconds("s").alias("ts"), "lat", "lon").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stop_stream(stream).writeStream.format("memory").queryName("stops").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = sorted((r.device, r.stop, round(r.lat, 9), r.first.timestamp(), r["last"].timestamp(), r.n) for r in spark.table("stops").collect())
    whole = trip.stops(points.withColumn("us", F.col("s") * 1_000_000)).collect()
    last = {d: max(r.stop for r in whole if r.device == d) for d in (1, 2, 3)}
    want = sorted((r.device, r.stop, round(r.lat, 9), r.first_us / 1e6, r.last_us / 1e6, r.n) for r in whole if r.stop < last[r.device])
    assert got == want and len(got) > 10
