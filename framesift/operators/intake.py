"""Intake operators: pools, the analysis cache, places, chapters' material, summaries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.window import Window

from ..functions import media as M
from ..functions.columns import place_label
from .catalogue import classify, pair_live
from .trip import DAY_US


def verdicts(files: DataFrame) -> DataFrame:
    """kind and reason of probed files (path, length, error, width, height, seconds): name, then size, then the reader's error, then sides and length; the first reason stays, null for kept files."""
    told = classify(files)
    suffix = F.regexp_extract("path", r"\.([^./]+)$", 1)
    late = F.coalesce(M.read_error(F.col("error"), suffix, F.col("length")), M.too_small(F.col("kind"), F.col("width"), F.col("height"), F.col("seconds")))
    return told.withColumn("reason", F.coalesce("reason", late))


def without_motion(media: DataFrame) -> DataFrame:
    """Photos and clips (see ``pair_live``) but for the clips that belong to a still."""
    return media.join(pair_live(media).select(F.col("clip").alias("path")).distinct(), "path", "left_anti")


def pool(photos: DataFrame, videos: DataFrame) -> DataFrame:
    """Both pools as one, photos first (pool_order 0)."""
    return photos.withColumn("pool_order", F.lit(0)).unionByName(videos.withColumn("pool_order", F.lit(1)))


def capture_span(items: DataFrame) -> DataFrame:
    """One row (first_us, last_us, days): the ends and distinct UTC days of all known capture times; nulls and 0 days without any."""
    return items.where("us IS NOT NULL").agg(F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.count_distinct(F.floor(F.col("us") / DAY_US)).alias("days"))


def cache_key(fingerprint: Column | str, *fields: str) -> Column:
    """Key of a file's analysis: 16 hexadecimal digits over its fields and the settings' fingerprint; null, which no entry has, if a field is."""
    mark = F.lit(fingerprint) if isinstance(fingerprint, str) else fingerprint
    whole = F.concat_ws("|", *(F.col(f).cast("string") for f in fields), mark)
    some = F.col(fields[0]).isNotNull()
    for f in fields[1:]:
        some = some & F.col(f).isNotNull()
    return F.when(some, F.substring(F.sha2(whole, 256), 1, 16))


def read_cache(spark: SparkSession, path: str, fingerprint: str, items: str) -> DataFrame:
    """(key, items) of the cache's lines that can be read and were written under this fingerprint; ``items`` is the type of an entry's items."""
    lines = spark.read.schema(f"cfg string, key string, items {items}").option("mode", "DROPMALFORMED").json(path)
    return lines.where((F.col("cfg") == fingerprint) & F.col("key").isNotNull()).select("key", "items").dropDuplicates(["key"])


def write_cache(entries: DataFrame, path: str, fingerprint: str) -> None:
    """Write (key, items) as JSON lines in a new folder; readers keep the old one until they are given this."""
    entries.where("key IS NOT NULL").select(F.lit(fingerprint).alias("cfg"), "key", "items").write.mode("errorifexists").json(path)


#: Versions of a cache that stay beside a new one, for readers that began before it.
KEPT_VERSIONS = 2


def versions(spark: SparkSession, root: str) -> dict[int, str]:
    """The finished versions below a cache's folder, by number: folders v=<number>-<mark> with a success file, in any store that Spark reads."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(root)
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(folder):
        return {}
    found = {}
    for status in store.listStatus(folder):
        name = status.getPath().getName()
        if name.startswith("v=") and store.exists(spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
            found[int(name[2:].split("-", 1)[0])] = name
    return found


def read_version(spark: SparkSession, root: str, fingerprint: str, items: str) -> DataFrame:
    """(key, items) of the newest finished version, of this fingerprint; nothing without one."""
    found = versions(spark, root)
    if not found:
        return spark.createDataFrame([], f"key string, items {items}")
    return read_cache(spark, f"{root}/{found[max(found)]}", fingerprint, items)


def merge_cache(entries: DataFrame, root: str, fingerprint: str, mark: str = "batch") -> None:
    """A new version of the cache: these (key, items) over those of the newest finished one that have their fingerprint; entries of others go, as do those without a key, and of equal keys one stays.

    Readers keep the version that they began with; a version counts once its
    success file is there, so one that broke off is as if it had not begun,
    and the next has its number. Old entries are joined by key, never
    gathered. Only the newest versions stay.
    """
    spark = entries.sparkSession
    found = versions(spark, root)
    number = max(found, default=0) + 1
    new = entries.where("key IS NOT NULL").select("key", "items").dropDuplicates(["key"])
    if found:
        old = read_version(spark, root, fingerprint, entries.schema["items"].dataType.simpleString())
        new = new.union(old.join(new.select("key"), "key", "left_anti").select("key", "items"))
    new.select(F.lit(fingerprint).alias("cfg"), "key", "items").write.mode("overwrite").json(f"{root}/v={number:09d}-{mark}")
    paths = spark._jvm.org.apache.hadoop.fs.Path
    store = paths(root).getFileSystem(spark._jsc.hadoopConfiguration())
    for k in sorted(found)[:-KEPT_VERSIONS]:
        store.delete(paths(f"{root}/{found[k]}"), True)


def refresh_cache(files: DataFrame, root: str, fingerprint: str, items: str, analyse: Callable[[DataFrame], DataFrame], name: str) -> DataStreamWriter:
    """The writer of a stream of files (key, ...) that keeps a cache up to date: ``analyse`` gives (key, items) of those that the cache lacks, and each batch is a version.

    A batch that is played again finds the version that bears its name and
    number and does nothing, or, where that was not finished, writes it. The
    name is the stream's own, the same from start to start.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark, mark = batch.sparkSession, f"{name}.{number}"
        if mark in {v.split("-", 1)[1] for v in versions(spark, root).values()}:
            return
        fresh = batch.where("key IS NOT NULL").dropDuplicates(["key"])
        todo = fresh.join(read_version(spark, root, fingerprint, items).select("key"), "key", "left_anti")
        merge_cache(analyse(todo), root, fingerprint, mark)

    return files.writeStream.foreachBatch(merge)


def split_cached(files: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files (key) with their cached items, and those still to be analysed; files of today, so no old metadata comes back."""
    return files.join(cache, "key"), files.join(cache.select("key"), "key", "left_anti")


def named_places(points: DataFrame, places: DataFrame) -> DataFrame:
    """Points (lat, lon) with ``place``: the label of their cell of 0.01 degrees in the table of places (lat, lon, names array), else of their coordinates; the least entry of a cell counts."""
    cell = lambda c: F.bround(F.col(c) * 100).cast("bigint")
    one = places.groupBy(cell("lat").alias("__a"), cell("lon").alias("__b")).agg(F.min("names").alias("__names"))
    told = points.join(one, (cell("lat") == F.col("__a")) & (cell("lon") == F.col("__b")), "left")
    label = place_label(F.col("lat"), F.col("lon"), *(F.get(F.col("__names"), F.lit(k)) for k in range(4)))
    return told.withColumn("place", label).drop("__a", "__b", "__names")


def item_stop(items: DataFrame, stops: DataFrame) -> DataFrame:
    """(item_id, stop): the first stop of the device that an item's time falls in, null without one; times meet by day."""
    days = stops.select(F.col("device").alias("d"), "stop", "first_us", "last_us").withColumn("day", F.explode(F.sequence(F.floor(F.col("first_us") / DAY_US), F.floor(F.col("last_us") / DAY_US))))
    hits = items.select("item_id", "device", "us").join(days, (F.col("device") == F.col("d")) & (F.floor(F.col("us") / DAY_US) == F.col("day")) & F.col("us").between(F.col("first_us"), F.col("last_us")), "left")
    return hits.groupBy("item_id").agg(F.min("stop").alias("stop"))


def stop_counts(items: DataFrame, stops: DataFrame) -> DataFrame:
    """(device, stop, n): items of each stop, 0 for stops without any."""
    n = item_stop(items, stops).where("stop IS NOT NULL").join(items.select("item_id", "device"), "item_id").groupBy("device", "stop").agg(F.count("*").alias("n"))
    return stops.select("device", "stop").join(n, ["device", "stop"], "left").fillna(0, ["n"])


def shot_metrics(frames: DataFrame, by: list[str]) -> DataFrame:
    """A row for each shot of frames (t, measures): means, but the most that is clipped or black, faces as a whole number, and the middle frame's hash (frames of equal times in order of their hashes)."""
    means = [F.avg(c).alias(c) for c in ("sharpness", "exposure", "contrast", "colour", "eyes", "motion", "luma")]
    most = [F.max(c).alias(c) for c in ("clipped", "black")]
    w = Window.partitionBy(*by)
    middle = F.row_number().over(w.orderBy("t", "hash")) == F.floor(F.count("*").over(w) / 2) + 1
    return frames.withColumn("__mid", F.when(middle, F.col("hash"))).groupBy(*by).agg(*means, *most, F.bround(F.avg("faces")).cast("bigint").alias("faces"), F.max("__mid").alias("hash"))


def downbeat_phase(beats: DataFrame, by: list[str]) -> DataFrame:
    """(by, phase): which of four beats carries most onset energy (beat from 0, energy), the first among equals."""
    sums = beats.groupBy(*by, (F.col("beat") % 4).alias("phase")).agg(F.sum("energy").alias("e"))
    return sums.groupBy(*by).agg(F.max(F.struct("e", (-F.col("phase")).alias("p"))).alias("m")).select(*by, (-F.col("m.p")).alias("phase"))


def chapter_seconds(weights: DataFrame, target: float, title: float) -> DataFrame:
    """Chapters (device, chapter, weight) with seconds: what titles leave of the target, five seconds at least, by weight."""
    content = F.greatest(F.lit(5.0), target - title * F.count("*").over(Window.partitionBy("device")))
    return weights.withColumn("seconds", content * F.col("weight"))


def list_summary(slots: DataFrame, by: list[str]) -> DataFrame:
    """(entries, photos, videos, titles, seconds) of lists of slots (kind, seconds)."""
    n = lambda kind: F.count_if(F.col("kind") == kind)
    return slots.groupBy(*by).agg(F.count("*").alias("entries"), n("photo").alias("photos"), n("video").alias("videos"), n("title").alias("titles"), F.sum("seconds").alias("seconds"))


def newest(folders: DataFrame, by: list[str]) -> DataFrame:
    """(by, folder): the folder changed last, the greater name among equals."""
    return folders.groupBy(*by).agg(F.max(F.struct("modified", "folder")).alias("m")).select(*by, F.col("m.folder").alias("folder"))


def in_asked_order(done: DataFrame, asked: DataFrame, key: str, ordinal: str) -> DataFrame:
    """Results in any order with the ordinal of what was asked for; rows without a result keep their place."""
    return asked.select(key, ordinal).join(done, key, "left")


def energy_at(slots: DataFrame, curve: DataFrame, by: list[str], bar_s: float) -> DataFrame:
    """Slots (start_s) with the energy of the bar they start in (curve: bar, energy); beyond the ends the end's, 1 without a curve."""
    last = curve.groupBy(*by).agg(F.max("bar").alias("__last"))
    at = F.least(F.greatest(F.lit(0), F.floor(F.col("start_s") / max(0.1, bar_s))), F.col("__last"))
    told = slots.join(last, by, "left").withColumn("bar", at).join(curve.select(*by, "bar", F.col("energy").alias("__e")), [*by, "bar"], "left")
    return told.withColumn("energy", F.coalesce("__e", F.lit(1.0))).drop("__e", "__last", "bar")
