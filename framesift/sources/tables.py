"""Sources: folder scans, and items derived from the event table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import file_kind


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table of the data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _listed(spark: SparkSession, root: str, deep: bool) -> DataFrame:
    folder = spark._jvm.org.apache.hadoop.fs.Path(root)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        raise FileNotFoundError(root)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(deep).lower()).load(root)
    return files.select("path", "length", F.col("modificationTime").alias("modified"))


def scan_folder(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, modified) of all files below a folder but dot-files and those in dot-folders below it; contents are never read. A missing folder and one without such files raise an error."""
    inside = F.expr("substring(path, instr(path, '://') + 3)")
    files = _listed(spark, root, True).where(~inside.rlike(r"/\."))
    if not files.limit(1).count():
        raise ValueError(f"no files in {root}")
    return files


def scan_audio(spark: SparkSession, root: str, least_bytes: int = 1024) -> DataFrame:
    """(path, length, modified) of audio files in a folder, not below it, of more than ``least_bytes``."""
    return _listed(spark, root, False).where((F.col("length") > least_bytes) & (file_kind(F.col("path")) == "audio"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timeline items from events: every column is a fixed expression of the event, so SQL derives the same."""
    e = table(spark, sf_dir, "events").withColumn("cents", F.round(F.col("value") * 100).cast("bigint"))
    video = F.col("event_type").isin("view", "purchase")
    away = F.col("event_id") % 11 == 0
    return e.select(
        F.col("event_id").alias("item_id"),
        F.col("user_id").alias("device"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
        F.when(video, "video").otherwise("photo").alias("kind"),
        F.when(F.col("event_type") == "error", "blur (error)").alias("reject"),
        F.when(F.col("event_id") % 3 != 0, (F.col("user_id") % 5 - 2) * 3600).alias("off_s"),
        F.when(~away, F.expr("cast(35 as double) + cast(0.5 as double) * (user_id % 7) + cast(0.001 as double) * (event_id % 13) + case when event_id % 29 = 0 then cast(0.05 as double) else cast(0 as double) end")).alias("lat"),
        F.when(~away, F.expr("cast(135 as double) + cast(0.5 as double) * (user_id % 7) + cast(0.001 as double) * (event_id % 17)")).alias("lon"),
        F.round(F.least(F.lit(1.0), F.log(1 + F.col("value")) / F.log(F.lit(2001.0))), 6).alias("score"),
        F.when(video, 2 + (F.col("cents") % 800) / F.lit(100.0)).otherwise(F.lit(3.0)).alias("seconds"),
    )


#: The same items for SQL.
ITEMS_SQL = """items AS (SELECT event_id AS item_id, user_id AS device, epoch_us(ts) AS us,
  CASE WHEN event_type IN ('view', 'purchase') THEN 'video' ELSE 'photo' END AS kind,
  CASE WHEN event_type = 'error' THEN 'blur (error)' END AS reject,
  CASE WHEN event_id % 3 <> 0 THEN (user_id % 5 - 2) * 3600 END AS off_s,
  CASE WHEN event_id % 11 <> 0 THEN cast(35 as double) + cast(0.5 as double) * (user_id % 7) + cast(0.001 as double) * (event_id % 13) + CASE WHEN event_id % 29 = 0 THEN cast(0.05 as double) ELSE cast(0 as double) END END AS lat,
  CASE WHEN event_id % 11 <> 0 THEN cast(135 as double) + cast(0.5 as double) * (user_id % 7) + cast(0.001 as double) * (event_id % 17) END AS lon,
  round(least(cast(1 as double), ln(1 + value) / ln(cast(2001 as double))), 6) AS score,
  CASE WHEN event_type IN ('view', 'purchase') THEN 2 + (cast(round(value * 100) AS BIGINT) % 800) / cast(100 as double) ELSE cast(3 as double) END AS seconds
  FROM events)"""
