"""The cut list: items to chapters, a choice per chapter, and a timeline on the beat grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import Plan
from ..operators import choose, trip
from ..sources.tables import items

SLOTS = 60


def cut_list(spark: SparkSession, sf_dir: str, plan: Plan = Plan()) -> DataFrame:
    """(device, pos, item_id, chapter, beats, frame): per device, unrejected items capped per minute, seats dealt to chapters in proportion to their items (largest remainder), the best of each chapter in time order, four beats a slot."""
    pool = choose.burst_cap(items(spark, sf_dir).where("reject IS NULL"), plan.per_minute)
    told = trip.chapters(pool)
    size = told.groupBy("device", F.col("chapter").alias("key")).agg(F.count("*").alias("weight"))
    seats = choose.largest_remainder(size, SLOTS, ["device"]).select("device", F.col("key").alias("chapter"), "units")
    best = Window.partitionBy("device", "chapter").orderBy(F.col("score").desc(), "item_id")
    chosen = told.withColumn("__n", F.row_number().over(best)).join(seats, ["device", "chapter"]).where(F.col("__n") <= F.col("units"))
    order = Window.partitionBy("device").orderBy("us", "item_id")
    slots = chosen.select("device", "us", "item_id", "chapter", F.row_number().over(order).cast("bigint").alias("pos"), F.lit(4).cast("bigint").alias("beats"))
    return choose.snap_frames(slots, plan.bpm, plan.fps, ["device"], ["pos"]).select("device", "pos", "item_id", "chapter", "beats", "frame")


CUT_LIST_SQL = """WITH ic AS (SELECT * FROM (WITH {CHAPTERS} SELECT * FROM items WHERE reject IS NULL)),
  pool AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY device, us // 60000000 ORDER BY score DESC, item_id) AS b FROM ic) WHERE b <= 2),
  l2 AS (SELECT *, cast(to_timestamp((us + coalesce(off_s, 0) * 1000000) / 1000000) AT TIME ZONE 'UTC' AS DATE) AS day FROM pool),
  f2 AS (SELECT *, CASE WHEN (us - lag(us) OVER w) >= 18000000000 OR day <> lag(day) OVER w THEN 1 ELSE 0 END AS new FROM l2 WINDOW w AS (PARTITION BY device ORDER BY us, item_id)),
  t AS (SELECT *, cast(sum(new) OVER (PARTITION BY device ORDER BY us, item_id) AS BIGINT) AS chapter FROM f2),
  w AS (SELECT device, chapter, count(*) AS weight FROM t GROUP BY 1, 2), s AS (SELECT *, weight / cast(sum(weight) OVER (PARTITION BY device) as double) * 60 AS share FROM w),
  r AS (SELECT *, row_number() OVER (PARTITION BY device ORDER BY share - floor(share) DESC, chapter) AS n, 60 - sum(floor(share)) OVER (PARTITION BY device) AS short FROM s),
  seats AS (SELECT device, chapter, floor(share) + CASE WHEN n <= short THEN 1 ELSE 0 END AS units FROM r),
  c AS (SELECT t.*, row_number() OVER (PARTITION BY t.device, t.chapter ORDER BY score DESC, item_id) AS k FROM t),
  chosen AS (SELECT c.* FROM c JOIN seats USING (device, chapter) WHERE k <= units),
  p AS (SELECT device, item_id, chapter, row_number() OVER (PARTITION BY device ORDER BY us, item_id) AS pos FROM chosen)
  SELECT device, cast(pos AS BIGINT) AS pos, item_id, chapter, cast(4 AS BIGINT) AS beats, cast(round_even(pos * 4 * (cast(60 as double) / 120 * 30), 0) AS BIGINT) AS frame FROM p"""
