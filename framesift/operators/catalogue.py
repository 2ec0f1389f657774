"""Catalogue operators: verdicts, pairing, offset repair, incremental work."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import JUNK_NAMES, Analysis, Trip
from ..functions.columns import file_kind


def classify(files: DataFrame, rules: Analysis = Analysis()) -> DataFrame:
    """kind and reason (null: kept) of files (path, length): the first rule that holds names the reason; unknown kinds go."""
    name = F.lower(F.regexp_extract("path", r"([^/]*)$", 1))
    reason = (
        F.when(name.isin(*JUNK_NAMES) | F.regexp_replace(name, r"\.[^.]*$", "").contains("screenshot"), "junk name")
        .when(F.col("length").isNull(), "unreadable").when(F.col("length") == 0, "empty").when(F.col("length") < rules.least_bytes, "truncated")
    )
    return files.withColumn("kind", file_kind(F.col("path"))).withColumn("reason", reason).where("kind IS NOT NULL")


def pair_live(media: DataFrame) -> DataFrame:
    """(photo, clip): stills with the motion clip of their folder and stem (any case); a clip of several stills goes to the best: format rank, then pixels, then path.

    Columns: path, folder, stem, ext, kind, size, pixels. Both sides shuffle on
    (folder, stem) once, then on the clip.
    """
    key = [F.lower("folder").alias("k1"), F.lower("stem").alias("k2")]
    first = Window.partitionBy("k1", "k2").orderBy("path")
    clips = media.where("kind = 'video' AND size > 20000").select(*key, F.col("path")).withColumn("n", F.row_number().over(first)).where("n = 1").select("k1", "k2", F.col("path").alias("clip"))
    ext = F.lower("ext")
    rank = F.when(ext.isin("heic", "heif"), 0).when(ext.isin("tif", "tiff"), 1).when(ext == "png", 2).when(ext.isin("jpg", "jpeg"), 3).when(ext == "webp", 4).otherwise(5)
    stills = media.where("kind = 'photo'").select(*key, F.col("path").alias("photo"), rank.alias("rank"), "pixels")
    best = Window.partitionBy("clip").orderBy("rank", F.col("pixels").desc(), "photo")
    return stills.join(clips, ["k1", "k2"]).withColumn("n", F.row_number().over(best)).where("n = 1").select("photo", "clip")


def borrow_offsets(items: DataFrame, rules: Trip = Trip()) -> DataFrame:
    """Items with off_s filled from the nearest row of the device in time that has one, at most six hours away; ties to the earlier; us moves by a borrowed offset.

    Donors of an equal time count once, that of the least item_id. One sort per
    device serves both directions; skewed devices spill, not collect.
    """
    donor = F.when(F.col("off_s").isNotNull(), F.struct("us", "off_s"))
    same = Window.partitionBy("device", "us").orderBy(F.col("off_s").isNull(), "item_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    one = items.withColumn("__d", F.first(donor, ignorenulls=True).over(same))
    w = Window.partitionBy("device").orderBy("us", "item_id")
    one = one.withColumn("__p", F.last("__d", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__n", F.first("__d", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    before, after, most = F.col("us") - F.col("__p.us"), F.col("__n.us") - F.col("us"), int(rules.borrow_hours * 3.6e9)
    near = F.when(before.isNotNull() & (after.isNull() | (before <= after)), F.when(before <= most, F.col("__p.off_s"))).otherwise(F.when(after <= most, F.col("__n.off_s")))
    borrowed = F.when(F.col("off_s").isNull(), near)
    return one.withColumn("borrowed", borrowed).withColumn("us", F.col("us") - F.coalesce(F.col("borrowed"), F.lit(0)).cast("bigint") * 1_000_000).withColumn("off_s", F.coalesce("off_s", "borrowed")).drop("__d", "__p", "__n")


def todo(wanted: DataFrame, cached: DataFrame, key: str) -> DataFrame:
    """Rows of wanted that the cache lacks."""
    return wanted.join(cached.select(key).distinct(), key, "left_anti")


def reason_histogram(items: DataFrame) -> DataFrame:
    """Rejected rows by the reason's part before its bracket."""
    return items.where("reject IS NOT NULL").groupBy(F.substring_index("reject", " (", 1).alias("reason")).agg(F.count("*").alias("n"))
