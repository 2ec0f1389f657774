"""Queries of the editing operators: budget, arrangement, series, checks; the SQL each equals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .catalog import CHAPTERS_SQL, ORACLE_SQL, query
from .config import Plan
from .functions import columns as C
from .operators import arrange, checks, choose, fill, series, trip
from .plans.cut_list import CUT_LIST_SQL, cut_list
from .sources import sinks
from .sources.tables import items, table

STOPS_SQL = ORACLE_SQL["stops"].rsplit("\n  SELECT device, stop, round(", 1)[0] + """,
  st AS (SELECT device, stop, arg_max(clat, rn) AS lat, arg_max(clon, rn) AS lon, min(us) AS first_us, max(us) AS last_us, count(*) AS n FROM f WHERE stop >= 0 AND rn > 0 GROUP BY device, stop)"""
CUTS_SQL = CUT_LIST_SQL.replace("{CHAPTERS}", CHAPTERS_SQL)


@query(f"""{STOPS_SQL},
  v AS (SELECT device, stop, cast(0 as bigint) AS visit, lat, lon, first_us, last_us, n FROM st WHERE stop = 0
    UNION ALL
    SELECT s.device, s.stop, CASE WHEN near THEN v.visit ELSE v.visit + 1 END, CASE WHEN near THEN (v.lat * v.n + s.lat * s.n) / (v.n + s.n) ELSE s.lat END, CASE WHEN near THEN (v.lon * v.n + s.lon * s.n) / (v.n + s.n) ELSE s.lon END,
      CASE WHEN near THEN v.first_us ELSE s.first_us END, CASE WHEN near THEN greatest(v.last_us, s.last_us) ELSE s.last_us END, CASE WHEN near THEN v.n + s.n ELSE s.n END
    FROM v JOIN st s ON s.device = v.device AND s.stop = v.stop + 1,
    LATERAL (SELECT 2 * cast(6371.0088 as double) * asin(sqrt(least(cast(1 as double), pow(sin(radians(s.lat - v.lat) / 2), 2) + cos(radians(v.lat)) * cos(radians(s.lat)) * pow(sin(radians(s.lon - v.lon) / 2), 2)))) <= 3 AND s.first_us - v.last_us <= 28800000000 AS near))
  SELECT device, visit, round(arg_max(lat, stop), 6) AS lat, round(arg_max(lon, stop), 6) AS lon, arg_max(first_us, stop) AS first_us, arg_max(last_us, stop) AS last_us, arg_max(n, stop) AS n FROM v GROUP BY device, visit""")
def visits(spark: SparkSession, d: str) -> DataFrame:
    found = trip.visits(trip.stops(items(spark, d)))
    return found.select("device", "visit", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "first_us", "last_us", "n")


@query(f"""{STOPS_SQL}, ch AS (SELECT * FROM (WITH {CHAPTERS_SQL} SELECT device, chapter, us FROM chaptered)),
  e AS (SELECT device, chapter, min(us) AS f0, max(us) AS l0 FROM ch GROUP BY 1, 2),
  c AS (SELECT e.device, e.chapter, st.stop, (SELECT count(*) FROM ch x WHERE x.device = e.device AND x.chapter = e.chapter AND x.us BETWEEN st.first_us AND st.last_us) AS inside
    FROM e JOIN st ON st.device = e.device AND st.first_us <= l0 + 1000000 AND st.last_us >= f0 - 1000000),
  b AS (SELECT *, row_number() OVER (PARTITION BY device, chapter ORDER BY inside DESC, stop) AS k FROM c)
  SELECT e.device, e.chapter, b.stop, b.inside FROM e LEFT JOIN b ON b.device = e.device AND b.chapter = e.chapter AND k = 1""")
def chapter_stop(spark: SparkSession, d: str) -> DataFrame:
    i = items(spark, d)
    return trip.chapter_stop(trip.chapters(i), trip.stops(i))


@query(f"""WITH {CHAPTERS_SQL}, p AS (SELECT *, lag(lat) OVER w AS pa, lag(lon) OVER w AS po, lag(us) OVER w AS pu, lag(day) OVER w AS pd FROM located WINDOW w AS (PARTITION BY device ORDER BY us, item_id)),
  m AS (SELECT *, CASE WHEN us - pu >= 18000000000 OR day <> pd OR coalesce(lat IS NOT NULL AND pa IS NOT NULL AND 2 * cast(6371.0088 as double) * asin(sqrt(least(cast(1 as double), pow(sin(radians(lat - pa) / 2), 2) + cos(radians(pa)) * cos(radians(lat)) * pow(sin(radians(lon - po) / 2), 2)))) * 1000 >= 2500, false) THEN 1 ELSE 0 END AS brk FROM p),
  t AS (SELECT device, us, sum(brk) OVER (PARTITION BY device ORDER BY us, item_id) AS chapter FROM m)
  SELECT device, cast(chapter AS BIGINT) AS chapter, min(us) AS first_us, max(us) AS last_us, count(*) AS n FROM t GROUP BY device, chapter""")
def chapters_on_move(spark: SparkSession, d: str) -> DataFrame:
    return trip.chapter_summary(items(spark, d), on_move=True)


@query(f"""WITH {CHAPTERS_SQL}, n AS (SELECT device, chapter, count(*) AS n FROM chaptered GROUP BY 1, 2),
  b AS (SELECT *, n + CASE WHEN count(*) OVER g > 1 THEN cast(0.55 as double) ELSE cast(0 as double) END * sum(n) OVER g / count(*) OVER g AS boosted FROM n WINDOW g AS (PARTITION BY device))
  SELECT device, chapter, round(boosted / sum(boosted) OVER (PARTITION BY device), 8) AS weight FROM b""")
def chapter_weights(spark: SparkSession, d: str) -> DataFrame:
    return choose.chapter_weights(trip.chapters(items(spark, d))).select("device", "chapter", F.round("weight", 8).alias("weight"))


@query("""WITH t AS (SELECT o_orderkey, o_orderdate AS at, CASE o_orderkey % 8 WHEN 0 THEN strftime(o_orderdate, '%Y:%m:%d %H:%M:%S') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d 07:08:09') WHEN 2 THEN strftime(o_orderdate, '%Y:%m:%d 5:06')
    WHEN 3 THEN strftime(o_orderdate, '%Y-%m-%d 23:59') WHEN 4 THEN strftime(o_orderdate, '%Y:%m:%d') WHEN 5 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 6 THEN '2023:02:29 10:00:00' ELSE '1970:01:01 00:00:00' END AS text FROM orders),
  p AS (SELECT *, coalesce(try_strptime(text, '%Y:%m:%d %H:%M:%S'), try_strptime(text, '%Y-%m-%d %H:%M:%S'), try_strptime(text, '%Y:%m:%d %H:%M'), try_strptime(text, '%Y-%m-%d %H:%M'), try_strptime(text, '%Y:%m:%d'), try_strptime(text, '%Y-%m-%d')) AS local FROM t)
  SELECT o_orderkey, CASE WHEN local IS NULL OR year(local) < 1990 THEN 0 ELSE epoch_us(local) // 1000000 - (o_orderkey % 5 - 2) * 3600 END AS captured FROM p""")
def parse_dates(spark: SparkSession, d: str) -> DataFrame:
    k, at = F.col("o_orderkey") % 8, F.col("o_orderdate")
    shapes = ["yyyy:MM:dd HH:mm:ss", "yyyy-MM-dd '07:08:09'", "yyyy:MM:dd '5:06'", "yyyy-MM-dd '23:59'", "yyyy:MM:dd", "yyyy-MM-dd"]
    text = F.when(k == 6, "2023:02:29 10:00:00").otherwise("1970:01:01 00:00:00")
    for i, shape in enumerate(shapes):
        text = F.when(k == i, F.date_format(at, shape)).otherwise(text)
    return table(spark, d, "orders").select("o_orderkey", C.capture_seconds(text, (F.col("o_orderkey") % 5 - 2) * 3600).alias("captured"))


@query("""SELECT n_nationkey, CASE WHEN n_nationkey % 5 = 0 THEN CASE WHEN n_nationkey % 10 = 0 THEN '12.50°N 30.25°W' ELSE 'Unlocated' END WHEN n_nationkey % 5 = 1 THEN n_name ELSE n_name || ', ' || r_name END AS place FROM nation JOIN region ON r_regionkey = n_regionkey""")
def place_labels(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey")
    there = table(spark, d, "nation").join(table(spark, d, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    lat, lon = (F.when(k % 10 == 0, F.lit(v)).otherwise(0.0) for v in (12.5, -30.25))
    named = k % 5 != 0
    return there.select("n_nationkey", C.place_label(lat, lon, F.when(named, F.col("n_name")), F.when(named & (k % 5 != 1), F.concat(F.lit(" "), "r_name")), F.when(named, F.col("n_name"))).alias("place"))


def fill_sql(pool: str, by: str) -> str:
    """CTEs ending in ``picked`` (by, item_id, chapter, pick, budget): the three phases of the fill as one walk over each group of the CTE ``pool``, whose rows hold their group's budget."""
    same = " AND ".join(f"{{a}}.{c.strip()} = {{b}}.{c.strip()}" for c in by.split(","))
    return f"""able AS (SELECT *, CASE kind WHEN 'video' THEN cast(2 as double) ELSE cast(3 as double) END AS need FROM {pool} WHERE kind <> 'video' OR seconds >= 2 - 0.000001),
  qa AS (SELECT {by}, chapter, sum(need) AS a, max(budget) AS bud FROM able GROUP BY {by}, chapter), qq AS (SELECT {by}, chapter, greatest(cast(3 as double), a / sum(a) OVER (PARTITION BY {by}) * 0.7 * bud) AS quota FROM qa),
  rk AS (SELECT able.*, quota, row_number() OVER (PARTITION BY {by}, kind ORDER BY score DESC, item_id) AS vr FROM able JOIN qq USING ({by}, chapter)),
  steps AS (SELECT 1 AS phase, cast(0 as bigint) AS turn, * FROM rk WHERE kind = 'video' AND vr <= greatest(1, round_even(0.32 * budget / 3, 0)) UNION ALL SELECT 2, chapter, * FROM rk UNION ALL SELECT 3, 0, * FROM rk),
  walk AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY phase, turn, score DESC, item_id) AS rn FROM steps),
  st AS (SELECT DISTINCT {by}, cast(0 as bigint) AS rn, cast(0 as double) AS spent, cast([] as bigint[]) AS picks, cast(-1 as bigint) AS chap, cast(0 as double) AS used, false AS dead FROM walk
    UNION ALL SELECT {", ".join(f"w.{c.strip()}" for c in by.split(","))}, w.rn, CASE WHEN pick THEN st.spent + w.need ELSE st.spent END, CASE WHEN pick THEN list_append(st.picks, w.item_id) ELSE st.picks END, CASE WHEN w.phase = 2 THEN w.chapter ELSE -1 END,
      CASE WHEN w.phase = 2 THEN used0 + CASE WHEN pick THEN w.need ELSE 0 END ELSE 0 END, w.phase = 2 AND (dead0 OR (fresh AND NOT pick))
    FROM st JOIN walk w ON {same.format(a="w", b="st")} AND w.rn = st.rn + 1,
    LATERAL (SELECT CASE WHEN st.chap = w.chapter THEN st.used ELSE 0 END AS used0, CASE WHEN st.chap = w.chapter THEN st.dead ELSE st.spent >= w.budget END AS dead0, NOT list_contains(st.picks, w.item_id) AS fresh, st.spent + w.need <= w.budget OR len(st.picks) < 4 AS fits),
    LATERAL (SELECT fresh AND fits AND CASE w.phase WHEN 1 THEN true WHEN 2 THEN NOT dead0 AND used0 + w.need <= w.quota ELSE st.spent < w.budget END AS pick)),
  done AS (SELECT {by}, arg_max(picks, rn) AS picks FROM st GROUP BY {by}), picked AS (SELECT {by}, item_id, chapter, cast(list_position(picks, item_id) - 1 as bigint) AS pick, budget FROM rk JOIN done USING ({by}) WHERE list_contains(picks, item_id))"""


UNREJECTED_SQL = f"WITH RECURSIVE {CHAPTERS_SQL.replace('FROM items)', 'FROM items WHERE reject IS NULL)', 1)}"


@query(f"""{UNREJECTED_SQL}, b AS (SELECT *, row_number() OVER (PARTITION BY device, us // 60000000 ORDER BY score DESC, item_id) AS br FROM chaptered), pool AS (SELECT *, cast(180 as double) AS budget FROM b WHERE br <= 2), {fill_sql("pool", "device")}
  SELECT device, item_id, chapter, pick FROM picked""")
def greedy_fill(spark: SparkSession, d: str) -> DataFrame:
    pool = choose.burst_cap(trip.chapters(items(spark, d).where("reject IS NULL")), 2)
    return fill.greedy_fill(pool, ["device"]).select("device", "item_id", "chapter", "pick")


@query(f"""{UNREJECTED_SQL}, b AS (SELECT *, row_number() OVER (PARTITION BY device, us // 60000000 ORDER BY score DESC, item_id) AS br FROM chaptered), pool AS (SELECT b.*, cap, cast(180 as double) AS budget FROM b, (VALUES (2), (4), (8), (16)) v(cap) WHERE br <= cap), {fill_sql("pool", "device, cap")},
  f AS (SELECT *, count(*) OVER (PARTITION BY device, cap) * 2 >= 0.97 * 180 AS filled FROM picked), c AS (SELECT *, coalesce(min(CASE WHEN filled THEN cap END) OVER (PARTITION BY device), 16) AS best FROM f) SELECT device, cap, item_id, chapter, pick FROM c WHERE cap = best""")
def fill_ladder(spark: SparkSession, d: str) -> DataFrame:
    return fill.fill_ladder(trip.chapters(items(spark, d).where("reject IS NULL"))).select("device", "cap", "item_id", "chapter", "pick")


PLAN_SQL = """films AS (SELECT n_nationkey AS film, 12 * n_nationkey AS bars FROM nation),
  m AS (SELECT *, greatest(1, bars - 6) AS spare, CASE WHEN bars >= 170 THEN ['groove', 'lift', 'drop', 'return', 'drop', 'lift', 'groove'] WHEN bars >= 100 THEN ['groove', 'lift', 'drop', 'groove'] WHEN bars >= 48 THEN ['groove', 'drop', 'groove'] ELSE ['groove'] END AS names FROM films WHERE bars > 0),
  q AS (SELECT *, greatest(1, least(32, spare // len(names))) AS per FROM m), r AS (SELECT *, least(96, (spare + per - 1) // per) AS cnt FROM q),
  sections AS (SELECT film, 0 AS index, 'open' AS name, 2 AS bars, bars AS total FROM r UNION ALL SELECT film, cnt + 1, 'close', 4, bars FROM r
    UNION ALL SELECT film, i + 1, names[i % len(names) + 1], spare // cnt + CASE WHEN i < spare - spare // cnt * cnt THEN 1 ELSE 0 END, bars FROM (SELECT *, unnest(range(cnt)) AS i FROM r))"""


@query(f"WITH {PLAN_SQL} SELECT film, cast(index AS INTEGER) AS index, name, cast(bars AS INTEGER) AS bars FROM sections")
def section_plan(spark: SparkSession, d: str) -> DataFrame:
    return _films(spark, d).select("film", F.posexplode(arrange.section_plan(F.col("bars"))).alias("index", "s")).select("film", "index", "s.name", "s.bars")


@query(f"""WITH {PLAN_SQL}, w(section, e) AS (VALUES ('open', 0.35 * 0.55 + 0.08 * 1.15), ('groove', 0.45 + 0.35 + 0.12 * 0.85 + 0.08), ('lift', 0.45 + 0.35 + 0.12 + 0.08 * 1.2), ('drop', 0.35 * 0.5 + 0.08 * 1.1), ('return', 0.45 + 0.35 + 0.12 + 0.08 * 1.1), ('close', 0.45 * 0.55 + 0.35 * 0.7 + 0.12 * 0.5 + 0.08 * 1.25)),
  b AS (SELECT film, total, name AS section, unnest(range(cast(s0 as bigint), cast(s0 + bars as bigint))) AS bar FROM (SELECT *, sum(bars) OVER (PARTITION BY film ORDER BY index) - bars AS s0 FROM sections))
  SELECT film, bar, section, round(cast(e as double) / avg(cast(e as double)) OVER (PARTITION BY film), 6) AS energy FROM b JOIN w USING (section) WHERE bar < total""")
def energy_curve(spark: SparkSession, d: str) -> DataFrame:
    return arrange.energy_curve(_films(spark, d), "film").select("film", F.col("bar").cast("bigint").alias("bar"), "section", F.round("energy", 6).alias("energy"))


def _films(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("film"), (12 * F.col("n_nationkey")).alias("bars"))


@query("""WITH t AS (SELECT n_nationkey AS track, 60 * 30 / cast(greatest(1, round_even(cast(60 as double) / (40 + 6 * n_nationkey) * 30, 0)) as double) AS bpm FROM nation)
  SELECT track, cast(b AS INTEGER) AS beat, round(0.25 + b * (60 / bpm), 6) AS at_s FROM (SELECT *, unnest(range(cast(floor(30 / (60 / bpm)) as bigint) + 1)) AS b FROM t)""")
def beat_grid(spark: SparkSession, d: str) -> DataFrame:
    bpm = arrange.frame_tempo((40 + 6 * F.col("n_nationkey")).cast("double"), 30)
    tracks = table(spark, d, "nation").select(F.col("n_nationkey").alias("track"), bpm.alias("bpm"), F.lit(30.0).alias("seconds"), F.lit(0.25).alias("phase"))
    return arrange.beat_grid(tracks).select("track", "beat", F.round("at_s", 6).alias("at_s"))


@query("""WITH s AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p, o_orderkey % 5 = 0 AS title, o_totalprice AS score FROM orders),
  b AS (SELECT *, count(*) FILTER (NOT title) OVER g AS n, coalesce(min(p) FILTER (title) OVER g, 1) - 0.5 AS t, row_number() OVER (PARTITION BY o_custkey ORDER BY title, score DESC, p) AS k FROM s WINDOW g AS (PARTITION BY o_custkey))
  SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN k = 1 AND NOT title AND n >= 4 AND p > 2 THEN t ELSE p END) AS place FROM b""")
def hook_order(spark: SparkSession, d: str) -> DataFrame:
    slots = table(spark, d, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderkey") % 5 == 0).alias("is_title"), F.col("o_totalprice").alias("score"))
    return choose.hook_order(slots, ["o_custkey"], "o_orderkey").select("o_orderkey", "place")


@query("""WITH s AS (SELECT event_id, event_id % 40 / cast(10 as double) AS a, event_id % 40 / cast(10 as double) + 1 + event_id % 3 AS z, CASE WHEN event_id % 2 = 0 THEN 6 ELSE 0 END AS len, cast(1 + event_id % 4 as double) AS slot, event_type IN ('view', 'purchase') AS video FROM events),
  l AS (SELECT *, CASE WHEN len = 0 THEN z ELSE least(z, len) END AS lim FROM s)
  SELECT event_id, round(CASE WHEN video AND slot > lim - a + 0.000001 AND greatest(0, lim - slot) < a - 0.000001 THEN greatest(0, lim - slot) ELSE a END, 6) AS in_point FROM l""")
def in_point_slide(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    kind = F.when(F.col("event_type").isin("view", "purchase"), "video").otherwise("photo")
    start = k % 40 / F.lit(10.0)
    at = choose.in_point(kind, start, start + 1 + k % 3, F.when(k % 2 == 0, 6.0).otherwise(0.0), (1 + k % 4).cast("double"))
    return table(spark, d, "events").select("event_id", F.round(at, 6).alias("in_point"))


@query(f"""WITH cl AS ({CUTS_SQL}) SELECT device, chapter, count(*) AS n, cast(sum(frames) AS BIGINT) AS frames FROM (SELECT *, frame - coalesce(lag(frame) OVER (PARTITION BY device ORDER BY pos), 0) AS frames FROM cl) GROUP BY device, chapter""")
def screen_time(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("device").orderBy("pos")
    shown = cut_list(spark, d).withColumn("frames", F.col("frame") - F.coalesce(F.lag("frame").over(w), F.lit(0)))
    return shown.groupBy("device", "chapter").agg(F.count("*").alias("n"), F.sum("frames").alias("frames"))


@query(f"""WITH cl AS ({CUTS_SQL}) SELECT device, round(max(frame) / cast(30 as double), 6) AS seconds, abs(max(frame) / cast(30 as double) - 120) <= 0.5 AS on_length, max(abs(frame / cast(30 as double) - round_even(frame / cast(30 as double) / 0.5, 0) * 0.5)) <= 1 / cast(30 as double) + 0.001 AS on_beat FROM cl GROUP BY device""")
def check_timing(spark: SparkSession, d: str) -> DataFrame:
    plan = Plan()
    return checks.timing(cut_list(spark, d), ["device"], plan.bpm, plan.fps, 120.0).withColumn("seconds", F.round("seconds", 6))


@query(f"""WITH {CHAPTERS_SQL}, c AS (SELECT device, chapter, count(*) AS shots, sum(cast(round(seconds * 100) AS BIGINT)) / cast(100 as double) AS seconds FROM chaptered GROUP BY 1, 2), a AS (SELECT *, sum(shots) OVER (PARTITION BY device) AS total FROM c),
  r AS (SELECT device, list_sort(list(seconds / shots)) AS r FROM a WHERE seconds > 0 AND shots >= total * 0.02 GROUP BY device)
  SELECT device, len(r) AS compared, round(CASE WHEN len(r) >= 3 THEN greatest(r[-1] / r[len(r) // 2 + 1], r[len(r) // 2 + 1] / r[1]) END, 6) AS worst, coalesce(CASE WHEN len(r) >= 3 THEN greatest(r[-1] / r[len(r) // 2 + 1], r[len(r) // 2 + 1] / r[1]) END <= 6, true) AS fair FROM r""")
def check_fairness(spark: SparkSession, d: str) -> DataFrame:
    told = trip.chapters(items(spark, d)).groupBy("device", "chapter").agg(F.count("*").alias("shots"), (F.sum(F.round(F.col("seconds") * 100).cast("bigint")) / 100.0).alias("seconds"))
    return checks.fairness(told, ["device"]).withColumn("worst", F.round("worst", 6))


@query("""WITH s AS (SELECT o_custkey, 1 + (o_orderkey % 40) / cast(10 as double) AS secs, (o_orderkey % 7) / cast(50 as double) AS zoom FROM orders), m AS (SELECT *, zoom / secs AS rate FROM s WHERE zoom > 0),
  a AS (SELECT o_custkey, avg(rate) FILTER (secs <= 3) AS short_rate, avg(rate) FILTER (secs >= 4.5) AS long_rate, max(zoom) / min(zoom) AS spread FROM m GROUP BY 1)
  SELECT o_custkey, round(short_rate, 8) AS short_rate, round(long_rate, 8) AS long_rate, round(spread, 6) AS spread, coalesce(short_rate > long_rate * 1.2, true) AS paced, spread < 4 AS varied FROM a""")
def check_pacing(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "orders").select("o_custkey", (1 + (F.col("o_orderkey") % 40) / F.lit(10.0)).alias("seconds"), ((F.col("o_orderkey") % 7) / F.lit(50.0)).alias("zoom"))
    return checks.pacing(s, ["o_custkey"]).withColumns({"short_rate": F.round("short_rate", 8), "long_rate": F.round("long_rate", 8), "spread": F.round("spread", 6)})


@query("""WITH s AS (SELECT vec_id, list_transform(embedding, lambda x: cast(x as double)) AS x FROM embeddings) SELECT vec_id, w, round(sqrt(list_sum(list_transform(x[w * 10 + 1 : w * 10 + 10], lambda v: v * v)) / len(x[w * 10 + 1 : w * 10 + 10]) + 0.000000000001), 6) AS rms
  FROM (SELECT *, unnest(range(cast(ceil(len(x) / 10) as bigint))) AS w FROM s)""")
def rms_envelope(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select("vec_id", F.posexplode(series.rms(F.col("embedding"), 10)).alias("w", "rms"))
    return rows.select("vec_id", F.col("w").cast("bigint").alias("w"), F.round("rms", 6).alias("rms"))


@query("""WITH s AS (SELECT vec_id, list_transform(embedding, lambda x: cast(x as double)) AS x FROM embeddings), i AS (SELECT *, unnest(range(len(x))) AS i FROM s),
  k AS (SELECT vec_id, i, any_value(x[i + 1]) AS v, sum(x[greatest(0, least(len(x) - 1, i + k - 7)) + 1] * (0.5 - 0.5 * cos(2 * pi() * k / 14)) / 7) AS local FROM i, range(15) r(k) GROUP BY vec_id, i)
  SELECT vec_id, i, round(greatest(0, v - local), 6) AS above FROM k""")
def local_mean_flux(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select("vec_id", F.posexplode(series.above_local_mean(F.col("embedding"))).alias("i", "above"))
    return rows.select("vec_id", F.col("i").cast("bigint").alias("i"), F.round("above", 6).alias("above"))


@query("""WITH m AS (SELECT l_suppkey AS clip, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_quantity) - 1 AS i, CASE WHEN l_quantity >= 49 THEN 90 ELSE l_quantity / 5 END AS v FROM lineitem),
  a AS (SELECT *, count(*) OVER (PARTITION BY clip) AS n, median(v) OVER (PARTITION BY clip) AS mid FROM m), d AS (SELECT *, median(abs(v - mid)) OVER (PARTITION BY clip) AS mad FROM a),
  l AS (SELECT clip, i, n FROM d WHERE i = 0 OR (n >= 3 AND v >= greatest(0.28 * 255 * 0.35, mid + 6 * (1.4826 * mad)))),
  r AS (SELECT *, i - row_number() OVER (PARTITION BY clip ORDER BY i) AS run FROM l), k AS (SELECT *, row_number() OVER (PARTITION BY clip, run ORDER BY i) AS nth FROM r), c AS (SELECT clip, n, i AS a, coalesce(lead(i) OVER (PARTITION BY clip ORDER BY i), n) AS b FROM k WHERE nth % 2 = 1),
  p AS (SELECT *, cast(ceil((b - a) / cast(18 as double)) as bigint) AS p FROM c), e AS (SELECT *, unnest(range(p)) AS j FROM p),
  x AS (SELECT clip, n, cast(a + round_even(j * ((b - a) / cast(p as double)), 0) as integer) AS first, cast(a + round_even((j + 1) * ((b - a) / cast(p as double)), 0) as integer) AS last FROM e)
  SELECT clip, first, last, round(first / cast(3 as double), 6) AS start_s, round(least(n / cast(3 as double), last / cast(3 as double)), 6) AS end_s FROM x WHERE least(n / cast(3 as double), last / cast(3 as double)) - first / cast(3 as double) >= 0.8""")
def shot_cuts(spark: SparkSession, d: str) -> DataFrame:
    """Shots of clips whose motion is the quantities of a supplier, one sample each."""
    o = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("clip")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", "l_quantity"))), lambda x: F.when(x["l_quantity"] >= 49, 90.0).otherwise(x["l_quantity"] / 5)).alias("motion"))
    return series.shots(o.withColumn("seconds", F.size("motion") / 3.0), "clip").select("clip", "first", "last", F.round("start_s", 6).alias("start_s"), F.round("end_s", 6).alias("end_s"))


@query(f"""WITH cl AS ({CUTS_SQL}), t AS (SELECT device, chapter, count(*) AS n, sum(frames) AS f FROM (SELECT *, frame - coalesce(lag(frame) OVER (PARTITION BY device ORDER BY pos), 0) AS frames FROM cl) GROUP BY device, chapter)
  SELECT device, chapter, printf('| %d | %d | %.1f | %s |', chapter, n, f / cast(30 as double), rpad(repeat('#', cast(round_even(f / cast(max(f) OVER (PARTITION BY device) as double) * 18, 0) AS INTEGER)), 18, '.')) AS line FROM t""")
def chapter_report(spark: SparkSession, d: str) -> DataFrame:
    return sinks.chapter_report(cut_list(spark, d), ["device"])


@query(f"""WITH cl AS ({CUTS_SQL}), t AS (SELECT *, coalesce(lag(frame) OVER (PARTITION BY device ORDER BY pos), 0) AS s FROM cl),
  e AS (SELECT device, list(struct_pack(index := pos, start := round(s / cast(30 as double), 3), duration := round((frame - s) / cast(30 as double), 3), beats := beats, source := item_id, chapter := chapter) ORDER BY pos) AS entries, round(sum((frame - s) / cast(30 as double)), 3) AS duration FROM t GROUP BY device)
  SELECT device, cast(to_json(struct_pack(target := cast(180 as double), duration := duration, music := struct_pack(bpm := cast(120 as double)), render := struct_pack(fps := 30), entries := entries)) as varchar) AS value FROM e""")
def cut_list_json(spark: SparkSession, d: str) -> DataFrame:
    return sinks.cut_list_json(cut_list(spark, d), ["device"])
