"""Values at the edges of scalar functions."""

import math
import random

from pyspark.sql import functions as F

from framesift.functions import columns as C
from framesift.functions import media as M


def test_tempo_prior_of_no_tempo(spark):
    rows = [(0, 0.0), (1, 120.0), (2, 60.0), (3, None)]
    got = {r.i: r.p for r in spark.createDataFrame(rows, "i int, bpm double").select("i", M.tempo_prior(F.col("bpm")).alias("p")).collect()}
    assert got[0] == 0.0 and got[1] == 1.0 and abs(got[2] - math.exp(-0.5 / 0.81)) < 1e-12 and got[3] is None


def test_two_places_round_the_binary_value(spark):
    rnd = random.Random(4)
    ties = [k / 1000 for k in range(5, 180_000, 970)] + [0.125, 0.375, 2.675, 1.005, 135.015, 0.0, 179.995, 179.999]
    values = ties + [math.nextafter(x, y) for x in ties for y in (0.0, 1e9)] + [rnd.uniform(0, 180) for _ in range(500)]
    for r in spark.createDataFrame([(x,) for x in values], "x double").select("x", C.two_places(F.col("x")).alias("t")).collect():
        assert r.t == f"{r.x:.2f}", r.x
    label = C.place_label(F.lit(-35.005), F.lit(135.015), F.lit(None).cast("string"))
    assert spark.range(1).select(label).first()[0] == f"{35.005:.2f}°S {135.015:.2f}°E"


def test_location_report_rounds_the_binary_value(spark):
    from framesift.sources import sinks

    stops = spark.createDataFrame([(1, 0, 35.005, 135.015, 5, 0, 60_000_000)], "device long, stop long, lat double, lon double, n long, first_us long, last_us long")
    line = sinks.location_report(stops.withColumn("label", C.place_label(F.col("lat"), F.col("lon"), F.lit(None).cast("string")))).first().line
    assert line == f"| 1 | {35.005:.2f}°N {135.015:.2f}°E | 5 | 1970-01-01 00:00 - 1970-01-01 00:01 |"
