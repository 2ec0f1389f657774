"""Queries of signals and images: tempo, beats, onsets, resampling, grid measures; the SQL each equals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import query
from .functions import grid as G
from .operators import series, signal
from .sources.tables import table

#: Samples a second that an hour of events stands for, so that tempi of 60 to 185 are periods of 13 to 40 hours.
FPS = 40


def _hours(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("user_id").alias("device"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return signal.binned(e, "device", F.col("us"), 3_600_000_000.0)


def _score(bpm: str) -> str:
    near = f"SELECT max(r.r) FROM r WHERE r.device = x.device AND r.lag BETWEEN floor(greatest(1, 2400 / {bpm} - 1)) AND floor(least(x.n - 1, 2400 / {bpm} + 1))"
    return f"(({near}) * exp(-0.5 * pow(log2({bpm} / 120) / cast(0.9 as double), 2)))"


def _octave(source: str, factor: str) -> str:
    other = f"(bpm * cast({factor} as double))"
    return f"(SELECT device, n, CASE WHEN {other} BETWEEN 60 AND 185 AND other > score * cast(1.06 as double) THEN {other} ELSE bpm END AS bpm, CASE WHEN {other} BETWEEN 60 AND 185 AND other > score * cast(1.06 as double) THEN other ELSE score END AS score FROM (SELECT *, {_score(other)} AS other FROM {source} x))"


TEMPO_SQL = f"""t AS (SELECT user_id AS device, epoch_us(ts) AS us FROM events), f AS (SELECT device, min(us) AS f FROM t GROUP BY 1),
  b AS (SELECT device, cast(floor((us - f) / cast(3600000000 as double)) as bigint) AS i, cast(count(*) as double) AS v FROM t JOIN f USING (device) GROUP BY ALL),
  n AS (SELECT device, max(i) + 1 AS n, sum(v) / (max(i) + 1) AS m FROM b GROUP BY 1), k AS (SELECT *, unnest(range(n)) AS i FROM n),
  g AS (SELECT device, n, i, coalesce(v, 0) AS v, coalesce(v, 0) - m AS c FROM k LEFT JOIN b USING (device, i)),
  a AS (SELECT x.device, y.i - x.i AS lag, sum(x.c * y.c) AS p FROM g x JOIN g y ON x.device = y.device AND y.i BETWEEN x.i AND x.i + 42 GROUP BY ALL),
  r AS (SELECT device, lag, p / (z + cast(1e-9 as double)) AS r FROM a JOIN (SELECT device, p AS z FROM a WHERE lag = 0) USING (device)),
  l AS (SELECT device, n, lag, row_number() OVER (PARTITION BY device ORDER BY round(r * exp(-0.5 * pow(log2(2400 / lag / 120) / cast(0.9 as double), 2)), 12) DESC, lag) AS nth FROM r JOIN n USING (device) WHERE lag >= 13 AND lag < least(n - 1, 40)),
  o AS (SELECT device, n, bpm, {_score('bpm')} AS score FROM (SELECT device, n, least(greatest(cast(2400 as double) / lag, 60), 185) AS bpm FROM l WHERE nth = 1) x),
  tempo AS (SELECT n.device, n.n, CASE WHEN n.n >= 8 THEN coalesce(z.bpm, 120) ELSE 120 END AS bpm FROM n LEFT JOIN {_octave(_octave('o', '0.5'), '2')} z USING (device))"""


@query(f"WITH {TEMPO_SQL} SELECT device, round(bpm, 6) AS bpm FROM tempo")
def tempo_estimate(spark: SparkSession, d: str) -> DataFrame:
    """The strongest period of each device's hourly events."""
    return signal.tempo(_hours(spark, d), "device", FPS).select("device", F.round("bpm", 6).alias("bpm"))


@query(f"""WITH RECURSIVE {TEMPO_SQL},
  p AS (SELECT device, n, 2400 / bpm AS period, cast(ceil(2 * (2400 / bpm)) as bigint) AS reach FROM tempo WHERE 2400 / bpm > 1 AND n >= floor(2 * (2400 / bpm))),
  c AS (SELECT p.device, x.i, sum(-100 * pow(ln((p.reach + 2 - (y.i - x.i)) / p.period), 2) * y.v) AS cost FROM p JOIN g x ON x.device = p.device JOIN g y ON y.device = p.device AND y.i BETWEEN x.i AND x.i + p.reach + 1 GROUP BY ALL),
  s AS (SELECT device, cast(0 as bigint) AS i, cast(0 as bigint) AS back, [cost] AS held, reach FROM c JOIN p USING (device) WHERE i = 0
    UNION ALL SELECT s.device, s.i + 1, s.i - len(held) + list_position(held, list_max(held)), list_append(held, list_max(held) + cost)[-s.reach:], s.reach FROM s JOIN c ON c.device = s.device AND c.i = s.i + 1),
  w AS (SELECT device, n - 1 AS i FROM p UNION ALL SELECT w.device, s.back FROM w JOIN s ON s.device = w.device AND s.i = w.i WHERE w.i > 0)
  SELECT device, i, round(i / cast(40 as double), 6) AS at_s FROM w""")
def beat_track(spark: SparkSession, d: str) -> DataFrame:
    """The hours that the best way through a device's events hits, at its tempo."""
    bins = _hours(spark, d)
    out = signal.beats(bins, signal.tempo(bins, "device", FPS), "device", FPS)
    return out.select("device", "i", F.round("at_s", 6).alias("at_s"))


@query("""WITH s AS (SELECT user_id AS device, epoch_us(ts) // 1000000 AS sec, avg(value) AS v FROM events GROUP BY ALL), e AS (SELECT device, min(sec) AS a, max(sec) AS b FROM s GROUP BY 1),
  g AS (SELECT device, unnest(range(a - 21600, b + 43200, 21600)) AS sec FROM e), l AS (SELECT g.device, g.sec, s.sec AS sec0, s.v AS v0 FROM g ASOF LEFT JOIN s ON g.device = s.device AND g.sec >= s.sec),
  r AS (SELECT l.*, s.sec AS sec1, s.v AS v1 FROM l ASOF LEFT JOIN s ON l.device = s.device AND l.sec < s.sec)
  SELECT device, sec, round(CASE WHEN v0 IS NULL THEN v1 WHEN v1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * ((sec - sec0) / cast(sec1 - sec0 as double)) END, 5) AS v FROM r""")
def resampled_values(spark: SparkSession, d: str) -> DataFrame:
    """Each device's values every six hours, from one step before its first event to beyond its last."""
    s = table(spark, d, "events").select(F.col("user_id").alias("device"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("at"), F.col("value").alias("v"))
    ends = s.groupBy("device").agg(F.min("at").alias("a"), F.max("at").alias("b"))
    grid = ends.select("device", F.explode(F.sequence(F.col("a") - 21600, F.col("b") + 43199, F.lit(21600).cast("long"))).alias("at"))
    return signal.resampled(s, grid, "device").select("device", F.col("at").alias("sec"), F.round("v", 5).alias("v"))


@query("""WITH s AS (SELECT vec_id, list_transform(embedding, lambda x: cast(x as double)) AS x, len(embedding) AS n FROM embeddings), m AS (SELECT *, cast(round_even(n * cast(7 as double) / 3, 0) as bigint) AS m FROM s),
  k AS (SELECT *, unnest(range(m)) AS i FROM m), p AS (SELECT *, i * ((n - 1) / cast(m - 1 as double)) AS p FROM k)
  SELECT vec_id, i, round(x[cast(floor(p) as bigint) + 1] + coalesce((x[cast(floor(p) as bigint) + 2] - x[cast(floor(p) as bigint) + 1]) * (p - floor(p)), 0), 6) AS v FROM p""")
def stretched_values(spark: SparkSession, d: str) -> DataFrame:
    """The components of vectors as samples, three a second made seven."""
    s = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v")).select("vec_id", F.col("i").cast("long").alias("i"), F.col("v").cast("double").alias("v"))
    return signal.stretched(s, "vec_id", 3, 7).select("vec_id", "i", F.round("v", 6).alias("v"))


@query("""WITH s AS (SELECT vec_id, list_transform(embedding, lambda x: cast(x as double)) AS x FROM embeddings), t AS (SELECT *, unnest(range((len(x) - 16) // 4 + 1)) AS t FROM s WHERE len(x) >= 32),
  j AS (SELECT vec_id, t, k, j, x[t * 4 + j + 1] * (0.5 - 0.5 * cos(2 * pi() * j / 15)) AS v FROM t, range(9) a(k), range(16) b(j)),
  m AS (SELECT vec_id, t, k, ln(1 + 100 * sqrt(pow(sum(v * cos(2 * pi() * k * j / 16)), 2) + pow(sum(v * sin(2 * pi() * k * j / 16)), 2))) AS m FROM j GROUP BY ALL),
  d AS (SELECT *, m - lag(m) OVER (PARTITION BY vec_id, k ORDER BY t) AS d FROM m), f AS (SELECT vec_id, list(f ORDER BY t) AS f FROM (SELECT vec_id, t, sum(greatest(0, coalesce(d, 0))) AS f FROM d GROUP BY ALL) GROUP BY 1),
  i AS (SELECT *, unnest(range(len(f))) AS i FROM f), l AS (SELECT vec_id, i, any_value(f[i + 1]) AS v, sum(f[greatest(0, least(len(f) - 1, i + k - 7)) + 1] * (0.5 - 0.5 * cos(2 * pi() * k / 14)) / 7) AS local FROM i, range(15) r(k) GROUP BY vec_id, i),
  e AS (SELECT vec_id, i, greatest(0, v - local) AS e FROM l), z AS (SELECT vec_id, stddev_pop(e) AS z FROM e GROUP BY 1)
  SELECT vec_id, i, round(CASE WHEN z > 0.000000001 THEN e / z ELSE e END, 5) AS onset FROM e JOIN z USING (vec_id) UNION ALL SELECT vec_id, 0, 0 FROM s WHERE len(x) < 32""")
def onset_strength(spark: SparkSession, d: str) -> DataFrame:
    """Onsets of vectors as short series."""
    rows = table(spark, d, "embeddings").select("vec_id", F.posexplode(signal.onsets(F.col("embedding"))).alias("i", "onset"))
    return rows.select("vec_id", F.col("i").cast("long").alias("i"), F.round("onset", 5).alias("onset"))


def _pixels(values: Column) -> Column:
    """Components as whole grey values from 0 to 255."""
    return F.transform(values, lambda x: F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.floor(128 + 400 * x.cast("double")).cast("double"))))


PIXELS_SQL = "list_transform(embedding, lambda x: greatest(0, least(255, floor(128 + 400 * cast(x as double)))))"
SHIFT_SQL = "g[greatest(0, least(h - 1, row + ({}))) * 8 + greatest(0, least(7, col + ({}))) + 1]".format


@query(f"""WITH v AS (SELECT vec_id, {PIXELS_SQL} AS a FROM embeddings), p AS (SELECT vec_id, list_transform(range(1, len(a) + 1), lambda k: cast(0.299 as double) * a[k] + cast(0.587 as double) * a[len(a) + 1 - k] + cast(0.114 as double) * a[(k + 6) % len(a) + 1]) AS g, len(a) // 8 AS h FROM v),
  c AS (SELECT *, k // 8 AS row, k % 8 AS col FROM (SELECT *, unnest(range(len(g))) AS k FROM p)),
  m AS (SELECT vec_id, g[k + 1] AS v, {SHIFT_SQL(-1, 0)} + {SHIFT_SQL(1, 0)} + {SHIFT_SQL(0, -1)} + {SHIFT_SQL(0, 1)} - 4 * g[k + 1] AS lap,
    {SHIFT_SQL(-1, 1)} + 2 * {SHIFT_SQL(0, 1)} + {SHIFT_SQL(1, 1)} - {SHIFT_SQL(-1, -1)} - 2 * {SHIFT_SQL(0, -1)} - {SHIFT_SQL(1, -1)} AS gx,
    {SHIFT_SQL(1, -1)} + 2 * {SHIFT_SQL(1, 0)} + {SHIFT_SQL(1, 1)} - {SHIFT_SQL(-1, -1)} - 2 * {SHIFT_SQL(-1, 0)} - {SHIFT_SQL(-1, 1)} AS gy FROM c),
  s AS (SELECT vec_id, avg(v) AS luma, avg(CASE WHEN v > 247 THEN 1 ELSE 0 END) AS clipped, avg(CASE WHEN v < 8 THEN 1 ELSE 0 END) AS black, least(1, stddev_pop(v) / 70) AS contrast, var_pop(lap) AS sharpness, avg(sqrt(gx * gx + gy * gy)) AS gradient FROM m GROUP BY vec_id)
  SELECT vec_id, round(luma, 5) AS luma, round(clipped, 6) AS clipped, round(black, 6) AS black, round(contrast, 6) AS contrast, round(least(1, greatest(0, 1 - pow(abs(luma - 128) / 128, cast(1.7 as double)) - (cast(1.6 as double) * clipped + cast(0.8 as double) * black))), 6) AS exposure,
    round(sharpness, 3) AS sharpness, round(gradient, 4) AS gradient FROM s""")
def grid_measures(spark: SparkSession, d: str) -> DataFrame:
    """Tones and sharpness of vectors as images of eight columns, red as they are, green from the end on, blue moved by seven."""
    a = _pixels(F.col("embedding"))
    turned = lambda x: F.transform(x, lambda _, k: F.get(x, (k + 7) % F.size(x)))
    v = table(spark, d, "embeddings").select("vec_id", series.once(a, lambda x: G.grey(x, F.reverse(x), turned(x))).alias("g"))
    out = v.select("vec_id", G.tones(F.col("g")).alias("t"), G.laplacian_variance(F.col("g"), 8).alias("sharpness"), G.gradient_mean(F.col("g"), 8).alias("gradient"))
    return out.select("vec_id", F.round("t.luma", 5).alias("luma"), *(F.round(f"t.{c}", 6).alias(c) for c in ("clipped", "black", "contrast", "exposure")), F.round("sharpness", 3).alias("sharpness"), F.round("gradient", 4).alias("gradient"))


@query("""WITH v AS (SELECT vec_id, embedding AS g, vec_id % 10 AS o, 16 AS w, len(embedding) // 16 AS h FROM embeddings), k AS (SELECT *, CASE WHEN o BETWEEN 5 AND 8 THEN h ELSE w END AS wide, unnest(range(len(g))) AS k FROM v), c AS (SELECT *, k // wide AS r, k % wide AS c FROM k),
  s AS (SELECT *, CASE o WHEN 2 THEN r * w + w - 1 - c WHEN 3 THEN (h - 1 - r) * w + w - 1 - c WHEN 4 THEN (h - 1 - r) * w + c WHEN 5 THEN c * w + r WHEN 6 THEN (h - 1 - c) * w + r WHEN 7 THEN (h - 1 - c) * w + w - 1 - r WHEN 8 THEN c * w + w - 1 - r ELSE k END AS src FROM c)
  SELECT vec_id, k, round(cast(g[src + 1] as double), 6) AS v FROM s""")
def turned_grids(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as images of sixteen columns, turned by an orientation each."""
    rows = table(spark, d, "embeddings").select("vec_id", F.posexplode(G.turned(F.col("embedding"), 16, F.col("vec_id") % 10)).alias("k", "v"))
    return rows.select("vec_id", F.col("k").cast("long").alias("k"), F.round(F.col("v").cast("double"), 6).alias("v"))


MOTION_SQL = f"""v AS (SELECT vec_id, label, {PIXELS_SQL} AS g FROM embeddings), b AS (SELECT *, lag(g) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM v),
  motion AS (SELECT vec_id, label, coalesce(list_avg(list_transform(range(1, len(g) + 1), lambda k: abs(g[k] - b[k]))), 0) AS motion FROM b)"""


@query(f"WITH {MOTION_SQL} SELECT vec_id, label, round(motion, 6) AS motion FROM motion")
def vector_motion(spark: SparkSession, d: str) -> DataFrame:
    """How far each vector, as a frame, is from the one before with its label."""
    frames = table(spark, d, "embeddings").select("vec_id", "label", _pixels(F.col("embedding")).alias("g"))
    return G.frame_motion(frames, ["label"], ["vec_id"], "g").select("vec_id", "label", F.round("motion", 6).alias("motion"))


@query(f"""WITH {MOTION_SQL}, m AS (SELECT label AS clip, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i, CASE WHEN vec_id % 13 = 0 THEN motion * 3 ELSE motion END AS v FROM motion),
  a AS (SELECT *, count(*) OVER (PARTITION BY clip) AS n, median(v) OVER (PARTITION BY clip) AS mid FROM m), d AS (SELECT *, median(abs(v - mid)) OVER (PARTITION BY clip) AS mad FROM a),
  l AS (SELECT clip, i, n FROM d WHERE i = 0 OR (n >= 3 AND v >= greatest(cast(0.28 as double) * 255 * cast(0.35 as double), mid + 6 * (cast(1.4826 as double) * mad)))),
  r AS (SELECT *, i - row_number() OVER (PARTITION BY clip ORDER BY i) AS run FROM l), k AS (SELECT *, row_number() OVER (PARTITION BY clip, run ORDER BY i) AS nth FROM r), c AS (SELECT clip, n, i AS a, coalesce(lead(i) OVER (PARTITION BY clip ORDER BY i), n) AS b FROM k WHERE nth % 2 = 1),
  p AS (SELECT *, cast(ceil((b - a) / cast(18 as double)) as bigint) AS p FROM c), e AS (SELECT *, unnest(range(p)) AS j FROM p),
  x AS (SELECT clip, n, cast(a + round_even(j * ((b - a) / cast(p as double)), 0) as integer) AS first, cast(a + round_even((j + 1) * ((b - a) / cast(p as double)), 0) as integer) AS last FROM e)
  SELECT clip, first, last, round(first / cast(3 as double), 6) AS start_s, round(least(n / cast(3 as double), last / cast(3 as double)), 6) AS end_s FROM x WHERE least(n / cast(3 as double), last / cast(3 as double)) - first / cast(3 as double) >= 0.8""")
def vector_shots(spark: SparkSession, d: str) -> DataFrame:
    """Shots of the clips that vectors of one label make, from the motion between them; every thirteenth frame moves thrice as much."""
    frames = table(spark, d, "embeddings").select("vec_id", "label", _pixels(F.col("embedding")).alias("g"))
    moved = G.frame_motion(frames, ["label"], ["vec_id"], "g").withColumn("motion", F.when(F.col("vec_id") % 13 == 0, F.col("motion") * 3).otherwise(F.col("motion")))
    clips = moved.groupBy(F.col("label").alias("clip")).agg(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "motion"))), lambda x: x["motion"]).alias("motion"))
    return series.shots(clips.withColumn("seconds", F.size("motion") / 3.0), "clip").select("clip", "first", "last", F.round("start_s", 6).alias("start_s"), F.round("end_s", 6).alias("end_s"))
