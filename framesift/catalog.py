"""Queries of the timeline operators by name, and the SQL each equals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import columns as C
from .operators import catalogue, choose, trip
from .operators.light import with_light, with_sun
from .plans.cut_list import CUT_LIST_SQL, cut_list
from .sources.tables import ITEMS_SQL, items, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

CHAPTERS_SQL = f"""{ITEMS_SQL},
  located AS (SELECT *, cast(to_timestamp((us + coalesce(off_s, 0) * 1000000) / 1000000) AT TIME ZONE 'UTC' AS DATE) AS day FROM items),
  flagged AS (SELECT *, CASE WHEN (us - lag(us) OVER w) >= 18000000000 OR day <> lag(day) OVER w THEN 1 ELSE 0 END AS new FROM located WINDOW w AS (PARTITION BY device ORDER BY us, item_id)),
  chaptered AS (SELECT *, cast(sum(new) OVER (PARTITION BY device ORDER BY us, item_id) AS BIGINT) AS chapter FROM flagged)"""


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query("""WITH f AS (SELECT page_id, 'photos/' || regexp_extract(url, '([^/?#]*)([?#].*)?$', 1) || CASE page_id % 4 WHEN 0 THEN '.JPG' WHEN 1 THEN '.mp4' WHEN 2 THEN '.wav' ELSE '.txt' END AS path, length(html) AS length FROM pages)
  SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'photo' WHEN 1 THEN 'video' ELSE 'audio' END AS kind,
  CASE WHEN lower(path) LIKE '%screenshot%' THEN 'junk name' WHEN length IS NULL THEN 'unreadable' WHEN length = 0 THEN 'empty' WHEN length < 1024 THEN 'truncated' END AS reason FROM f WHERE page_id % 4 <> 3""")
def classify_files(spark: SparkSession, d: str) -> DataFrame:
    suffix = F.when(F.col("page_id") % 4 == 0, ".JPG").when(F.col("page_id") % 4 == 1, ".mp4").when(F.col("page_id") % 4 == 2, ".wav").otherwise(".txt")
    files = table(spark, d, "pages").select("page_id", F.concat(F.lit("photos/"), F.regexp_extract("url", r"([^/?#]*)([?#].*)?$", 1), suffix).alias("path"), F.length("html").alias("length"))
    return catalogue.classify(files).select("page_id", "kind", "reason")


@query(f"WITH {ITEMS_SQL} SELECT split_part(reject, ' (', 1) AS reason, count(*) AS n FROM items WHERE reject IS NOT NULL GROUP BY 1")
def reject_histogram(spark: SparkSession, d: str) -> DataFrame:
    return catalogue.reason_histogram(items(spark, d))


@query(f"WITH {ITEMS_SQL} SELECT kind, count(*) AS n, count(*) FILTER (reject IS NOT NULL) AS rejected, count(*) FILTER (off_s IS NULL) AS no_offset FROM items GROUP BY kind")
def library_summary(spark: SparkSession, d: str) -> DataFrame:
    return items(spark, d).groupBy("kind").agg(F.count("*").alias("n"), F.count_if(F.col("reject").isNotNull()).alias("rejected"), F.count_if(F.col("off_s").isNull()).alias("no_offset"))


@query("SELECT d.doc_id, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def metadata_left_join(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left").select("doc_id", "quality", "toxic")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def cache_todo(spark: SparkSession, d: str) -> DataFrame:
    return catalogue.todo(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id")


MEDIA_SQL = """media AS (SELECT 'm/' || lpad(cast(event_id AS VARCHAR), 9, '0') AS path, 'F' || cast(user_id % 20 AS VARCHAR) AS folder, 'IMG_' || cast(event_id % 97 AS VARCHAR) AS stem,
  CASE event_id % 4 WHEN 0 THEN 'heic' WHEN 1 THEN 'JPG' WHEN 2 THEN 'png' ELSE 'mov' END AS ext, CASE WHEN event_id % 4 = 3 THEN 'video' ELSE 'photo' END AS kind,
  cast(round(value * 100) AS BIGINT) * 10 AS size, event_id % 1000 AS pixels FROM events)"""


def _media(spark: SparkSession, d: str) -> DataFrame:
    e, i = table(spark, d, "events"), F.col("event_id")
    ext = F.when(i % 4 == 0, "heic").when(i % 4 == 1, "JPG").when(i % 4 == 2, "png").otherwise("mov")
    return e.select(
        F.concat(F.lit("m/"), F.lpad(i.cast("string"), 9, "0")).alias("path"), F.concat(F.lit("F"), (F.col("user_id") % 20).cast("string")).alias("folder"), F.concat(F.lit("IMG_"), (i % 97).cast("string")).alias("stem"),
        ext.alias("ext"), F.when(i % 4 == 3, "video").otherwise("photo").alias("kind"), (F.round(F.col("value") * 100).cast("bigint") * 10).alias("size"), (i % 1000).alias("pixels"),
    )


@query(f"""WITH {MEDIA_SQL}, c AS (SELECT lower(folder) k1, lower(stem) k2, min(path) AS clip FROM media WHERE kind = 'video' AND size > 20000 GROUP BY 1, 2),
  s AS (SELECT path AS photo, clip, row_number() OVER (PARTITION BY clip ORDER BY CASE lower(ext) WHEN 'heic' THEN 0 WHEN 'png' THEN 2 ELSE 3 END, pixels DESC, path) AS n FROM media m JOIN c ON lower(folder) = k1 AND lower(stem) = k2 WHERE kind = 'photo')
  SELECT photo, clip FROM s WHERE n = 1""")
def live_pairing(spark: SparkSession, d: str) -> DataFrame:
    return catalogue.pair_live(_media(spark, d))


@query(f"""WITH {ITEMS_SQL}, donors AS (SELECT device, us, arg_min(off_s, item_id) AS off_s FROM items WHERE off_s IS NOT NULL GROUP BY device, us),
  b AS (SELECT i.item_id, i.us, (SELECT max(us) FROM donors x WHERE x.device = i.device AND x.us <= i.us) AS pu, (SELECT min(us) FROM donors x WHERE x.device = i.device AND x.us >= i.us) AS nu, i.device FROM items i WHERE off_s IS NULL),
  p AS (SELECT item_id, device, us, CASE WHEN pu IS NOT NULL AND (nu IS NULL OR us - pu <= nu - us) THEN CASE WHEN us - pu <= 21600000000 THEN pu END WHEN nu - us <= 21600000000 THEN nu END AS at FROM b)
  SELECT p.item_id, d.off_s AS borrowed, p.us - coalesce(d.off_s, 0) * 1000000 AS us FROM p LEFT JOIN donors d ON d.device = p.device AND d.us = p.at""")
def offset_borrow(spark: SparkSession, d: str) -> DataFrame:
    i = items(spark, d)
    return catalogue.borrow_offsets(i).join(i.where("off_s IS NULL").select("item_id"), "item_id", "left_semi").select("item_id", "borrowed", "us")


@query(f"""WITH {ITEMS_SQL}, s AS (SELECT item_id, us, lat, lon, lag(us) OVER w AS pu, lag(lat) OVER w AS pa, lag(lon) OVER w AS po FROM items WINDOW w AS (PARTITION BY device ORDER BY us, item_id))
  SELECT item_id, (us - pu) / cast(1000000 as double) AS gap_s,
  CASE WHEN lat IS NOT NULL AND pa IS NOT NULL THEN round(2 * cast(6371.0088 as double) * asin(sqrt(least(cast(1 as double), pow(sin(radians(lat - pa) / 2), 2) + cos(radians(pa)) * cos(radians(lat)) * pow(sin(radians(lon - po) / 2), 2)))), 4) END AS km FROM s""")
def haversine_steps(spark: SparkSession, d: str) -> DataFrame:
    return trip.steps(items(spark, d)).select("item_id", "gap_s", F.round("km", 4).alias("km"))


@query(f"WITH {CHAPTERS_SQL} SELECT device, chapter, min(us) AS first_us, max(us) AS last_us, count(*) AS n FROM chaptered GROUP BY device, chapter")
def chapter_summary(spark: SparkSession, d: str) -> DataFrame:
    return trip.chapter_summary(items(spark, d))


@query(f"""WITH {CHAPTERS_SQL}, c AS (SELECT device, chapter, min(us) AS a, max(us) AS b FROM chaptered GROUP BY device, chapter)
  SELECT item_id, min(c.chapter) AS chapter FROM items i LEFT JOIN c ON c.device = i.device AND i.us BETWEEN a - 1000000 AND b + 1000000 GROUP BY item_id""")
def item_chapter(spark: SparkSession, d: str) -> DataFrame:
    i = items(spark, d)
    return trip.item_in_range(i, trip.chapter_summary(i))


@query(f"""WITH RECURSIVE {ITEMS_SQL}, seq AS (SELECT *, row_number() OVER (PARTITION BY device ORDER BY us, item_id) AS rn FROM items),
  f AS (SELECT device, rn, us, cast(-1 as bigint) AS stop, cast(NULL as double) AS clat, cast(NULL as double) AS clon, us AS first_us, cast(0 as bigint) AS n FROM (SELECT device, cast(0 as bigint) AS rn, min(us) AS us FROM seq GROUP BY device)
    UNION ALL
    SELECT s.device, s.rn, s.us,
      CASE WHEN s.lat IS NULL THEN f.stop WHEN f.stop >= 0 AND near THEN f.stop ELSE f.stop + 1 END,
      CASE WHEN s.lat IS NULL THEN f.clat WHEN f.stop >= 0 AND near THEN (f.clat * f.n + s.lat) / (f.n + 1) ELSE s.lat END,
      CASE WHEN s.lat IS NULL THEN f.clon WHEN f.stop >= 0 AND near THEN (f.clon * f.n + s.lon) / (f.n + 1) ELSE s.lon END,
      CASE WHEN s.lat IS NULL OR (f.stop >= 0 AND near) THEN f.first_us ELSE s.us END,
      CASE WHEN s.lat IS NULL AND f.stop < 0 THEN 0 WHEN s.lat IS NULL OR (f.stop >= 0 AND near) THEN f.n + 1 ELSE 1 END
    FROM f JOIN seq s ON s.device = f.device AND s.rn = f.rn + 1,
    LATERAL (SELECT coalesce(2 * cast(6371.0088 as double) * asin(sqrt(least(cast(1 as double), pow(sin(radians(s.lat - f.clat) / 2), 2) + cos(radians(f.clat)) * cos(radians(s.lat)) * pow(sin(radians(s.lon - f.clon) / 2), 2)))) <= 0.4, false) AS near))
  SELECT device, stop, round(arg_max(clat, rn), 6) AS lat, round(arg_max(clon, rn), 6) AS lon, count(*) AS n FROM f WHERE stop >= 0 AND rn > 0 GROUP BY device, stop""")
def stops(spark: SparkSession, d: str) -> DataFrame:
    return trip.stops(items(spark, d)).select("device", "stop", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "n")


@query(f"""WITH {CHAPTERS_SQL} SELECT device, (max(us) - min(us)) / cast(1000000 as double) AS span_s, count(DISTINCT day) AS days, bool_or(lat IS NOT NULL) AS has_gps FROM chaptered GROUP BY device""")
def trip_stats(spark: SparkSession, d: str) -> DataFrame:
    return trip.trip_stats(items(spark, d))


@query(f"""WITH {ITEMS_SQL}, r AS (SELECT item_id, row_number() OVER (PARTITION BY us // 60000000 ORDER BY score DESC, item_id) AS n FROM items) SELECT item_id FROM r WHERE n <= 2""")
def burst_cap(spark: SparkSession, d: str) -> DataFrame:
    return choose.burst_cap(items(spark, d), by=()).select("item_id")


HASH_SQL = "h AS (SELECT vec_id AS id, list_reduce(list_transform(range(1, len(embedding)), lambda i: CASE WHEN embedding[i + 1] > embedding[i] THEN cast(1 as bigint) ELSE cast(0 as bigint) END), lambda a, b: a * 2 + b) AS hash, cast((vec_id * 7919) % 1000 as double) AS score FROM embeddings)"


def _hashes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), C.signature(F.col("embedding")).alias("hash"), ((F.col("vec_id") * 7919) % 1000).cast("double").alias("score"))


@query(f"WITH {HASH_SQL} SELECT id, hash FROM h")
def signatures(spark: SparkSession, d: str) -> DataFrame:
    return _hashes(spark, d).select("id", "hash")


@query(f"WITH {HASH_SQL} SELECT x.id AS a, y.id AS b, cast(bit_count(xor(x.hash, y.hash)) AS INTEGER) AS distance FROM h x JOIN h y ON x.id < y.id WHERE bit_count(xor(x.hash, y.hash)) <= 18")
def near_pairs(spark: SparkSession, d: str) -> DataFrame:
    return choose.near_pairs(_hashes(spark, d), 18)


@query(f"""WITH RECURSIVE {HASH_SQL}, o AS (SELECT id, hash, row_number() OVER (ORDER BY score DESC, id) AS rn FROM h WHERE hash <> 0),
  g AS (SELECT cast(0 as bigint) AS rn, cast([] as bigint[]) AS kept, cast([] as bigint[]) AS ids UNION ALL
    SELECT o.rn, CASE WHEN far THEN list_append(kept, o.hash) ELSE kept END, CASE WHEN far THEN list_append(ids, o.id) ELSE ids END
    FROM g JOIN o ON o.rn = g.rn + 1, LATERAL (SELECT len(list_filter(g.kept, lambda x: bit_count(xor(x, o.hash)) <= 18)) = 0 AS far))
  SELECT unnest(ids) AS id FROM g WHERE rn = (SELECT max(rn) FROM g)""")
def greedy_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return choose.greedy_dedupe(_hashes(spark, d), 18).select("id")


#: Hashes of a few flipped bits: of four neighbours the first as it is, the others with up to 4, 8 and 12 bits of it turned.
FLIPPED_SQL = f"""{HASH_SQL}, h2 AS (SELECT x.vec_id AS id, xor(b.hash, list_reduce(list_transform(range(0, 4 * (x.vec_id % 4) + 1), lambda j: CASE WHEN j = 0 THEN cast(0 as bigint) ELSE cast(1 as bigint) << cast((x.vec_id * 5 + j * 11) % 62 as integer) END), lambda p, q: xor(p, q))) AS hash, cast((x.vec_id * 7919) % 1000 as double) AS score
  FROM embeddings x JOIN h b ON b.id = x.vec_id - x.vec_id % 4)"""


def _flipped(spark: SparkSession, d: str) -> DataFrame:
    h = _hashes(spark, d)
    base = h.where("id % 4 = 0").select(F.col("id").alias("base"), F.col("hash").alias("of"))
    flip = F.aggregate(F.sequence(F.lit(0).cast("long"), 4 * (F.col("id") % 4)), F.lit(0).cast("long"), lambda p, j: p.bitwiseXOR(F.when(j == 0, 0).otherwise(F.pow(F.lit(2.0), (F.col("id") * 5 + j * 11) % 62).cast("long"))))
    return h.join(base, F.col("base") == F.col("id") - F.col("id") % 4).select("id", F.col("of").bitwiseXOR(flip).alias("hash"), "score")


@query(f"WITH {FLIPPED_SQL} SELECT x.id AS a, y.id AS b, cast(bit_count(xor(x.hash, y.hash)) AS INTEGER) AS distance FROM h2 x JOIN h2 y ON x.id < y.id WHERE bit_count(xor(x.hash, y.hash)) <= 10")
def near_pairs_ten(spark: SparkSession, d: str) -> DataFrame:
    return choose.near_pairs(_flipped(spark, d), 10)


@query(f"""WITH RECURSIVE {FLIPPED_SQL}, o AS (SELECT id, hash, row_number() OVER (ORDER BY score DESC, id) AS rn FROM h2 WHERE hash <> 0),
  g AS (SELECT cast(0 as bigint) AS rn, cast([] as bigint[]) AS kept, cast([] as bigint[]) AS ids UNION ALL
    SELECT o.rn, CASE WHEN far THEN list_append(kept, o.hash) ELSE kept END, CASE WHEN far THEN list_append(ids, o.id) ELSE ids END
    FROM g JOIN o ON o.rn = g.rn + 1, LATERAL (SELECT len(list_filter(g.kept, lambda x: bit_count(xor(x, o.hash)) <= 10)) = 0 AS far))
  SELECT unnest(ids) AS id FROM g WHERE rn = (SELECT max(rn) FROM g)""")
def greedy_dedupe_ten(spark: SparkSession, d: str) -> DataFrame:
    return choose.greedy_dedupe(_flipped(spark, d), 10).select("id")


@query(f"""WITH {CHAPTERS_SQL}, c AS (SELECT device, chapter, sum(cast(round(seconds * 100) AS BIGINT)) AS cs FROM chaptered GROUP BY device, chapter)
  SELECT device, chapter, round(greatest(cast(2 as double), cs / cast(sum(cs) OVER (PARTITION BY device) as double) * 0.7 * 180), 6) AS quota_s FROM c""")
def chapter_quotas(spark: SparkSession, d: str) -> DataFrame:
    return choose.chapter_quotas(trip.chapters(items(spark, d))).select("device", "chapter", F.round("quota_s", 6).alias("quota_s"))


@query(f"""WITH {CHAPTERS_SQL}, x AS (SELECT item_id, device, chapter, greatest(cast(0.02 as double), score) AS s FROM chaptered),
  y AS (SELECT *, min(s) OVER (PARTITION BY device) AS lo, max(s) OVER (PARTITION BY device) AS hi FROM x),
  z AS (SELECT *, CASE WHEN hi > lo THEN 0.78 + 0.44 * (s - lo) / (hi - lo) ELSE 1 END AS w FROM y)
  SELECT item_id, round(greatest(cast(0.02 as double), w - avg(w) OVER (PARTITION BY device, chapter) + avg(w) OVER (PARTITION BY device)), 6) AS weight FROM z""")
def slot_weights(spark: SparkSession, d: str) -> DataFrame:
    return choose.slot_weights(trip.chapters(items(spark, d))).select("item_id", F.round("weight", 6).alias("weight"))


@query("""WITH w AS (SELECT c_nationkey AS key, count(*) AS weight FROM customer GROUP BY 1), s AS (SELECT *, weight / cast(sum(weight) OVER () as double) * 1000 AS share FROM w),
  r AS (SELECT *, row_number() OVER (ORDER BY share - floor(share) DESC, key) AS n, 1000 - sum(floor(share)) OVER () AS short FROM s)
  SELECT key, cast(floor(share) + CASE WHEN n <= short THEN 1 ELSE 0 END AS BIGINT) AS units FROM r""")
def largest_remainder(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("key")).agg(F.count("*").alias("weight"))
    return choose.largest_remainder(w, 1000, by=[]).select("key", "units")


@query("""WITH s AS (SELECT o_custkey, o_orderkey, 1 + o_orderkey % 7 AS beats FROM orders), f AS (SELECT *, cast(round_even(sum(beats) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) * (cast(60 as double) / 126.05 * 60), 0) AS BIGINT) AS frame FROM s)
  SELECT o_orderkey, frame, frame - coalesce(lag(frame) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 0) AS frames FROM f""")
def frame_snap(spark: SparkSession, d: str) -> DataFrame:
    slots = table(spark, d, "orders").select("o_custkey", "o_orderkey", (1 + F.col("o_orderkey") % 7).alias("beats"))
    return choose.snap_frames(slots, 126.05, 60, ["o_custkey"], ["o_orderkey"]).select("o_orderkey", "frame", "frames")


@query("""WITH s AS (SELECT o_custkey, o_orderkey, o_orderkey % 3 <> 0 AS portrait FROM orders), r AS (SELECT *, sum(CASE WHEN portrait THEN 0 ELSE 1 END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS run FROM s),
  n AS (SELECT *, row_number() OVER q AS k, lag(o_orderkey) OVER q AS before FROM r WINDOW q AS (PARTITION BY o_custkey, run, portrait ORDER BY o_orderkey))
  SELECT o_orderkey, CASE WHEN portrait AND k % 2 = 0 THEN before ELSE o_orderkey END AS leader FROM n""")
def two_up_pairs(spark: SparkSession, d: str) -> DataFrame:
    slots = table(spark, d, "orders").select("o_custkey", F.col("o_orderkey"), (F.col("o_orderkey") % 3 != 0).alias("portrait"))
    return choose.two_up(slots, ["o_custkey"], "o_orderkey").select("o_orderkey", "leader")


@query("""WITH s AS (SELECT o_orderkey, o_orderkey % 500 AS i, 1 + (o_orderkey % 40) / cast(10 as double) AS secs FROM orders), m AS (SELECT *, ['in', 'out', 'left', 'right', 'up', 'down', 'still'][cast((5 * i + i // 7) % 7 + 1 AS INTEGER)] AS move FROM s)
  SELECT o_orderkey, move, round(CASE WHEN move = 'still' THEN 0 ELSE greatest(cast(0.045 as double), least(cast(0.3 as double), 0.1 * sqrt(4 / greatest(0.5, secs)) * (0.9 + 0.2 * (((i * 2654435761) >> 8) & 255) / cast(255 as double)))) END, 6) AS zoom FROM m""")
def motion_zoom(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 500).alias("i"), (1 + (F.col("o_orderkey") % 40) / F.lit(10.0)).alias("secs")).withColumn("move", C.motion_name(F.col("i")))
    return s.select("o_orderkey", "move", F.round(C.zoom(F.col("move"), F.col("secs"), F.col("i"), F.lit(1.0)), 6).alias("zoom"))


@query(f"""WITH {CHAPTERS_SQL}, r AS (SELECT device, chapter, item_id, row_number() OVER (PARTITION BY device, chapter ORDER BY score DESC, item_id) AS rank FROM chaptered) SELECT device, chapter, item_id, cast(rank AS INTEGER) AS rank FROM r WHERE rank <= 3""")
def top_picks(spark: SparkSession, d: str) -> DataFrame:
    return choose.top_per_chapter(trip.chapters(items(spark, d)), 3).select("device", "chapter", "item_id", "rank")


@query("""SELECT o_orderkey, round(CASE WHEN kind = 'video' THEN base + 0.08 * CASE WHEN v <= 12 THEN v / 12 ELSE greatest(0, least(1, 1 - (v - 12) / 33)) END ELSE base / 0.92 END, 6) AS score FROM (
  SELECT o_orderkey, v, kind, 0.30 * greatest(0, least(1, ln(1 + v * 50) / ln(cast(2001 as double)))) + 0.20 * 0.5 + 0.20 * CASE WHEN f = 0 THEN 0 ELSE least(1, 0.60 + 0.12 * least(f, 3) + 0.28 * 0.5) END + 0.12 * 0.25 + 0.10 * 0.75 AS base
  FROM (SELECT o_orderkey, cast(1 + o_orderkey % 60 as double) AS v, CASE WHEN o_orderkey % 2 = 0 THEN 'video' ELSE 'photo' END AS kind, o_custkey % 5 AS f FROM orders))""")
def composite_scores(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", (1 + F.col("o_orderkey") % 60).cast("double").alias("v"), F.when(F.col("o_orderkey") % 2 == 0, "video").otherwise("photo").alias("kind"), (F.col("o_custkey") % 5).alias("f"))
    score = C.composite(F.col("kind"), C.norm_sharpness(F.col("v") * 50), F.lit(0.5), C.norm_faces(F.col("f"), F.lit(0.5)), F.lit(0.25), F.lit(0.75), C.norm_motion(F.col("v")))
    return o.select("o_orderkey", F.round(score, 6).alias("score"))


@query("""WITH w AS (SELECT cast(c_nationkey as bigint) AS key, count(*) AS weight, cast(30 as bigint) AS low, 38 + c_nationkey % 9 AS high FROM customer GROUP BY c_nationkey),
  s AS (SELECT *, weight / cast(sum(weight) OVER () as double) * 1000 AS want FROM w), r AS (SELECT *, row_number() OVER (ORDER BY want - floor(want) DESC, key) AS n, 1000 - sum(floor(want)) OVER () AS short FROM s),
  c AS (SELECT *, cast(greatest(low, least(high, floor(want) + CASE WHEN n <= short THEN 1 ELSE 0 END)) as bigint) AS o FROM r), m AS (SELECT *, 1000 - cast(sum(o) OVER () as bigint) AS miss, sum(low) OVER () AS lows, sum(high) OVER () AS highs FROM c),
  u AS (SELECT key, want, miss, unnest(CASE WHEN miss > 0 THEN range(o, cast(high as bigint)) ELSE range(low + 1, o + 1) END) AS v FROM m WHERE miss <> 0),
  k AS (SELECT key, sign(miss) AS d, row_number() OVER (ORDER BY (v - want) * sign(miss), key * sign(miss)) AS n, abs(miss) AS most FROM u), d AS (SELECT key, cast(sum(d) as bigint) AS moved FROM k WHERE n <= most GROUP BY key)
  SELECT m.key, cast(CASE WHEN lows > 1000 THEN low WHEN highs <= 1000 THEN high ELSE o + coalesce(moved, 0) END as bigint) AS units FROM m LEFT JOIN d USING (key)""")
def bounded_units(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "customer").groupBy(F.col("c_nationkey").cast("bigint").alias("key")).agg(F.count("*").alias("weight"))
    return choose.bounded_units(w.withColumns({"low": F.lit(30).cast("bigint"), "high": 38 + F.col("key") % 9}), 1000, [])


def _sun_sql(source: str) -> str:
    """CTEs giving rise and sets for each row (item_id, k, t, lat, lon) of a CTE."""
    return f"""s1 AS (SELECT *, floor(t / 86400 + cast(2440587.5 as double) + 0.5) - 2451545 + cast(0.0008 as double) - lon / 360 AS j FROM {source}),
  s2 AS (SELECT *, (((cast(357.5291 as double) + cast(0.98560028 as double) * j) % 360) + 360) % 360 AS m FROM s1),
  s3 AS (SELECT *, (m + cast(1.9148 as double) * sin(radians(m)) + cast(0.02 as double) * sin(radians(2 * m)) + cast(0.0003 as double) * sin(radians(3 * m)) + 180 + cast(102.9372 as double)) % 360 AS e FROM s2),
  s4 AS (SELECT *, 2451545 + j + cast(0.0053 as double) * sin(radians(m)) - cast(0.0069 as double) * sin(radians(2 * e)) AS noon, sin(radians(e)) * sin(radians(cast(23.4397 as double))) AS sd FROM s3),
  s5 AS (SELECT *, (sin(radians(cast(-0.833 as double))) - sin(radians(lat)) * sd) / (cos(radians(lat)) * cos(asin(sd))) AS cw FROM s4),
  sun AS (SELECT *, CASE WHEN abs(cw) > 1 THEN 0 ELSE (noon - cast(2440587.5 as double)) * 86400 - degrees(acos(greatest(-1, least(1, cw)))) * 240 END AS rise,
    CASE WHEN abs(cw) > 1 THEN 0 ELSE (noon - cast(2440587.5 as double)) * 86400 + degrees(acos(greatest(-1, least(1, cw)))) * 240 END AS sets FROM s5)"""


@query(f"WITH {ITEMS_SQL}, p AS (SELECT item_id, us / cast(1000000 as double) AS t, lat, lon FROM items WHERE lat IS NOT NULL), {_sun_sql('p')} SELECT item_id, round(rise, 2) AS rise, round(sets, 2) AS sets FROM sun")
def sun_times(spark: SparkSession, d: str) -> DataFrame:
    i = with_sun(items(spark, d).where("lat IS NOT NULL").withColumn("ts", F.col("us") / F.lit(1e6)), "ts", "lat", "lon", (0,))
    return i.select("item_id", F.round("__rise_0", 2).alias("rise"), F.round("__set_0", 2).alias("sets"))


@query(f"""WITH {ITEMS_SQL}, p AS (SELECT item_id, k, us / cast(1000000 as double) AS ts, us / cast(1000000 as double) + k * 86400 AS t, lat, lon FROM items, (VALUES (-1), (0), (1)) v(k) WHERE lat IS NOT NULL), {_sun_sql('p')},
  o AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY CASE WHEN ts BETWEEN rise AND sets THEN 0 ELSE 1 END, CASE WHEN ts BETWEEN rise AND sets THEN k ELSE 0 END, rise - sets, k) AS n FROM sun)
  SELECT item_id, round(CASE WHEN ts < rise - 2700 OR ts > sets + 2700 THEN 0.15 WHEN ts - rise <= 4500 THEN greatest(0.6, 1 - abs(ts - rise - 1500) / 9000) WHEN sets - ts <= 4500 THEN greatest(0.6, 1 - abs(sets - ts - 1500) / 9000)
    ELSE greatest(0.45, least(1, 0.5 + 0.2 * (abs(ts - (rise + sets) / 2) / greatest(1, (sets - rise) / 2)))) END, 4) AS light FROM o WHERE n = 1""")
def light_scores(spark: SparkSession, d: str) -> DataFrame:
    i = items(spark, d).where("lat IS NOT NULL")
    return with_light(i, F.col("us") / F.lit(1e6), F.col("lat"), F.col("lon")).select("item_id", F.round("light", 4).alias("light"))


ORACLE_SQL["cut_list"] = CUT_LIST_SQL.replace("{CHAPTERS}", CHAPTERS_SQL)
QUERIES["cut_list"] = cut_list

from . import catalog_edit, catalog_media, catalog_signal  # noqa: E402, F401  register their queries
