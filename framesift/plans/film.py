"""The whole cut list: choice, titles, timing on the beat, camera moves, in-points and pairs."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import Plan
from ..functions import columns as C
from ..functions import media as M
from ..operators import arrange, choose, fill, intake, trip
from ..operators.light import with_light
from ..sources.shared import cut_lineage
from ..sources.tables import items, table


def candidates(spark: SparkSession, sf_dir: str, plan: Plan) -> DataFrame:
    """Items that are not rejected, with chapter, lit score, hash, footage and the time that titles leave of their device's film."""
    told = trip.chapters(with_light(items(spark, sf_dir), F.col("us") / F.lit(1e6), F.col("lat"), F.col("lon")))
    told = told.withColumn("score", F.round(M.lit_score(F.col("score"), F.col("light"), F.col("us")), 4)).drop("light")
    chapters = F.max("chapter").over(Window.partitionBy("device")) + 1
    budget = F.greatest(F.lit(5.0), plan.target_seconds - M.title_seconds(chapters, F.lit(plan.target_seconds), plan))
    vectors = table(spark, sf_dir, "embeddings")
    hashes = vectors.select(F.col("vec_id").alias("__v"), C.signature(F.col("embedding")).alias("hash"))
    told = told.withColumn("budget", budget).where("reject IS NULL").join(hashes, F.col("item_id") % max(1, vectors.count()) == F.col("__v")).drop("__v")
    return told.withColumn("footage", M.available(F.col("kind"), F.lit(0.0), F.col("seconds"), F.lit(0.0)))


def distinct_shots(steps: DataFrame) -> DataFrame:
    """Candidates of each (device, cap) without near copies of better ones."""
    named = steps.withColumn("id", F.col("item_id") * 1024 + F.col("cap"))
    return choose.greedy_dedupe(named, by=("device", "cap")).drop("id")


def distinct_hashes(steps: DataFrame) -> DataFrame:
    """Candidates of each (device, cap), of one hash the best alone; those without a hash go."""
    best = F.row_number().over(Window.partitionBy("device", "cap", "hash").orderBy(F.col("score").desc(), "item_id"))
    return steps.where("hash <> 0").withColumn("__n", best).where("__n = 1").drop("__n")


def choice(spark: SparkSession, sf_dir: str, plan: Plan = Plan(), between: Callable[[DataFrame], DataFrame] = distinct_shots) -> DataFrame:
    """(device, cap, item_id, chapter, kind, need, pick) of what each device's film shows; ``between`` thins the candidates, as the film does unless told otherwise."""
    return fill.fill_ladder(cut_lineage(candidates(spark, sf_dir, plan)), plan, "budget", between)


def with_titles(chosen: DataFrame) -> DataFrame:
    """Chosen items in order of their chapters and times, each chapter's title before them, with ``pos`` from 1; items without a chapter come last."""
    cols = ["device", "chapter", "item_id", "us", "kind", "score", "seconds", "footage"]
    shots = chosen.select(*cols, F.lit(False).alias("is_title"))
    titles = chosen.where("chapter IS NOT NULL").select("device", "chapter").distinct().withColumns({"is_title": F.lit(True), "kind": F.lit("title")})
    order = Window.partitionBy("device").orderBy(F.col("chapter").asc_nulls_last(), F.col("is_title").desc(), "us", "item_id")
    return shots.unionByName(titles, allowMissingColumns=True).withColumn("pos", F.row_number().over(order).cast("bigint"))


def timed(slots: DataFrame, plan: Plan) -> DataFrame:
    """Slots with beats, frame (their end), frames and start_s, numbered anew."""
    kept = choose.shed_weakest(choose.slot_bounds(slots, plan), ["device"], plan)
    g = Window.partitionBy("device")
    kept = kept.withColumn("pos", F.row_number().over(g.orderBy("pos")).cast("bigint"))
    beats = choose.title_plan(kept, ["device"], plan, F.count("*").over(g), F.count_if("is_title").over(g))
    kept = cut_lineage(kept.withColumns({"per_title": beats["per_title"], "content": beats["content"].cast("bigint")}))
    plain = choose.slot_weights(kept.where("NOT is_title")).withColumn("key", F.col("pos"))
    units = choose.bounded_units(plain, F.col("content"), ["device"]).select("device", F.col("key").alias("pos"), "units")
    told = kept.join(units, ["device", "pos"], "left").withColumn("beats", F.coalesce("units", "per_title").cast("bigint"))
    snapped = choose.snap_frames(told, plan.bpm, plan.fps, ["device"], ["pos"])
    done = choose.last_residue(snapped, F.lit(plan.target_seconds), plan.bpm, plan.fps, ["device"])
    return done.withColumn("start_s", (F.col("frame") - F.col("frames")) / F.lit(float(plan.fps))).withColumn("slot_s", F.col("frames") / F.lit(float(plan.fps)))


def film(spark: SparkSession, sf_dir: str, plan: Plan = Plan()) -> DataFrame:
    """(device, pos, kind, item_id, pair, chapter, beats, start_s, seconds, motion, zoom, in_point) of each device's film.

    Items capped per minute, without near copies, fill the time that titles
    leave; the cap is relaxed until it is full. Slots last whole beats by their
    scores within their bounds, the weakest go where the list runs over, cuts
    fall on frames, the last takes up the rest. Moves follow the place in the
    list, the slot's length and the music's energy; clips start earlier where
    their footage would end; portrait neighbours (here: item_id not divisible
    by 3) share a slot. Window and group keys are the device; a device's list
    is as long as its film has slots.
    """
    pool = cut_lineage(candidates(spark, sf_dir, plan))
    picked = fill.fill_ladder(pool, plan, "budget", distinct_shots).select("device", "item_id")
    slots = timed(with_titles(pool.join(picked, ["device", "item_id"])), plan)
    bar = 4 * 60.0 / plan.bpm
    length = slots.groupBy("device").agg(F.greatest(F.lit(1), F.ceil(F.max("frame") / F.lit(float(plan.fps)) / bar)).cast("int").alias("bars"))
    curve = arrange.energy_curve(length, "device", max(2, math.floor(90 / bar)))
    shown = intake.energy_at(slots, curve, ["device"], bar)
    move = C.motion_name(F.col("pos") - 1)
    shown = shown.withColumn("motion", F.when(F.col("is_title"), None).otherwise(move))
    shown = shown.withColumn("zoom", F.when(~F.col("is_title") & (F.col("slot_s") > 0), C.zoom(F.col("motion"), F.col("slot_s"), F.col("pos") - 1, F.col("energy"))))
    shown = shown.withColumn("in_point", F.when(F.col("kind") == "video", choose.in_point(F.col("kind"), F.lit(0.0), F.col("seconds"), F.lit(0.0), F.col("slot_s"))))
    shown = shown.withColumn("portrait", F.coalesce((F.col("kind") == "photo") & (F.col("item_id") % 3 != 0), F.lit(False)))
    led = choose.two_up(shown, ["device"], "pos")
    second = led.where("pos <> leader").select("device", F.col("leader").alias("pos"), F.col("item_id").alias("pair"), F.col("beats").alias("__b"), F.col("slot_s").alias("__s"))
    merged = led.where("pos = leader").join(second, ["device", "pos"], "left")
    together = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    return merged.select("device", "pos", "kind", "item_id", "pair", "chapter", together("beats", "__b").alias("beats"), F.round("start_s", 6).alias("start_s"), F.round(together("slot_s", "__s"), 6).alias("seconds"), "motion", F.round("zoom", 6).alias("zoom"), F.round("in_point", 6).alias("in_point"))
