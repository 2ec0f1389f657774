"""Intake operators: the cache on disk, folder scans, and empty inputs."""

import pytest

from framesift.functions import media as M
from framesift.operators import intake
from framesift.sources.tables import scan_audio, scan_folder
from pyspark.sql import functions as F


def test_cache_keeps_what_was_written_under_the_same_settings(spark, tmp_path):
    path = str(tmp_path / "cache")
    entries = spark.createDataFrame([("a", [1.5, 2.0]), ("b", []), (None, [3.0])], "key string, items array<double>")
    intake.write_cache(entries, path, "v1")
    (tmp_path / "cache" / "broken.json").write_text('{"cfg":"v1","key":"c","items":[1.0]}\n{"cfg":"v1","key":\n{"cfg":"v0","key":"d","items":[1.0]}\n')
    got = {r.key: list(r["items"]) for r in intake.read_cache(spark, path, "v1", "array<double>").collect()}
    assert got == {"a": [1.5, 2.0], "b": [], "c": [1.0]}
    assert intake.read_cache(spark, path, "v2", "array<double>").count() == 0
    files = spark.createDataFrame([("x", 10, 5), ("y", None, 5)], "path string, length long, mtime long").withColumn("key", intake.cache_key("v1", "path", "length", "mtime"))
    keys = {r.path: r.key for r in files.collect()}
    assert keys["y"] is None and len(keys["x"]) == 16
    done, todo = intake.split_cached(files, files.where("path = 'x'").select("key", F.lit(1).alias("items")))
    assert [r.path for r in done.collect()] == ["x"] and [r.path for r in todo.collect()] == ["y"]


def test_scans(spark, tmp_path):
    for name, size in (("a.jpg", 5), (".hidden.jpg", 5), (".dir/b.jpg", 5), ("sub/c.mp4", 7), ("song.mp3", 2000), ("short.mp3", 1024), ("sub/deep.mp3", 3000)):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * size)
    found = {r.path.rsplit("/", 1)[1]: r.length for r in scan_folder(spark, str(tmp_path)).collect()}
    assert found == {"a.jpg": 5, "c.mp4": 7, "song.mp3": 2000, "short.mp3": 1024, "deep.mp3": 3000}
    assert [r.path.rsplit("/", 1)[1] for r in scan_audio(spark, str(tmp_path)).collect()] == ["song.mp3"]
    with pytest.raises(FileNotFoundError):
        scan_folder(spark, str(tmp_path / "absent"))
    (tmp_path / "empty").mkdir()
    with pytest.raises(ValueError):
        scan_folder(spark, str(tmp_path / "empty"))


def test_scalars_of_missing_values(spark):
    one = spark.range(1)
    null = F.lit(None).cast("double")
    got = one.select(M.capture_number(null).alias("a"), M.offset_minutes(null).alias("b"), M.signed_place(null, F.lit(1.0), F.lit(None).cast("string"), F.lit(None).cast("string")).alias("c"), M.light_of(null, null, null).alias("d"), M.duck_threshold(null).alias("e"), M.camera_label(F.lit(None).cast("string"), F.lit(None).cast("string")).alias("f"), M.hard_fail(F.lit(59.5), F.lit(0.0), F.lit(0.0)).alias("g")).first()
    assert (got.a, got.b, tuple(got.c), got.d, got.e, got.f, got.g) == (0.0, 0, (0.0, 0.0), 0.6, -40.0, "", "blur (sharpness 60)")


def test_empty_tables(spark):
    i = spark.createDataFrame([], "item_id long, device long, us long")
    s = spark.createDataFrame([], "device long, stop long, first_us long, last_us long")
    assert intake.item_stop(i, s).count() == intake.stop_counts(i, s).count() == 0
    assert intake.capture_span(i).first().days == 0
