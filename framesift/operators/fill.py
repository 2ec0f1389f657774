"""Filling a time budget: the three-phase choice, and the ladder that relaxes the per-minute cap."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import Plan
from .choose import burst_cap
from .runs import whole_runs


def greedy_fill(items: DataFrame, by: list[str], plan: Plan = Plan(), budget: str | None = None) -> DataFrame:
    """Items (item_id, chapter, kind, seconds, score) chosen for each group's budget (the plan's target, or a column's value), with ``pick``, their place in the choice.

    Best score first, ties to the least id: videos up to their floor; then each
    chapter in turn until its quota would be passed; then whatever still fits.
    The first four are taken even beyond the budget. Videos shorter than their
    slot never take part.

    All items of a kind need the same time, so of a chapter's items of one kind
    only the best ``4 + budget / need`` can be taken: others go before the one
    ordered pass over a group, whose size is thus bounded by its chapters.
    """
    photo, video = plan.photo_slot, plan.video_slot
    seconds = F.col(budget) if budget else F.lit(plan.target_seconds)
    need = F.when(F.col("kind") == "video", F.lit(video)).otherwise(F.lit(photo))
    able = items.where((F.col("kind") != "video") | (F.col("seconds") >= video - 1e-6)).where(reduce(and_, (F.col(c).isNotNull() for c in [*by, "chapter"])))
    # one shuffle and one sort: all windows are of the group or of parts of it
    dealt = able.select(*by, "item_id", "chapter", "kind", "score", need.alias("need"), seconds.cast("double").alias("__budget")).repartition(*by)
    chapter, group = Window.partitionBy(*by, "chapter"), Window.partitionBy(*by)
    rank = F.row_number().over(Window.partitionBy(*by, "chapter", "kind").orderBy(F.col("score").desc(), "item_id"))
    share = F.sum("need").over(chapter) / F.sum("need").over(group)
    told = dealt.withColumn("__r", rank).withColumn("quota", F.greatest(F.lit(photo), share * plan.quota_share * F.max("__budget").over(chapter)))
    best = told.where(F.col("__r") <= 4 + F.ceil(F.col("__budget") / F.col("need"))).sortWithinPartitions(*by, F.col("score").desc(), "item_id")
    keys = len(by)

    def walk(kinds, needs, chapters, quotas, budget) -> list[int]:
        """Places of one group's items, best first, in the order in which they are taken."""
        floor = max(1, round(plan.video_share * budget / photo))
        picks: dict[int, None] = {}
        spent = 0.0

        def take(i: int) -> bool:
            nonlocal spent
            if spent + needs[i] > budget and len(picks) >= 4:
                return False
            picks[i] = None
            spent += needs[i]
            return True

        def chapter_turn(places: list[int], quota: float) -> None:
            used = 0.0
            for i in places:
                if i not in picks:
                    if used + needs[i] > quota or not take(i):
                        return
                    used += needs[i]

        for i in [i for i, k in enumerate(kinds) if k == "video"][:floor]:
            take(i)
        turns: dict[int, list[int]] = {}
        for i, c in enumerate(chapters):
            turns.setdefault(c, []).append(i)
        for c in sorted(turns):
            if spent >= budget:
                break
            chapter_turn(turns[c], quotas[turns[c][0]])
        for i in range(len(needs)):
            if spent >= budget:
                break
            if i not in picks:
                take(i)
        return list(picks)

    def choose(batches):
        for table, starts in whole_runs(batches, keys):
            kinds, needs, chapters, quotas, budgets = (table.column(c).to_pylist() for c in ("kind", "need", "chapter", "quota", "__budget"))
            at, pick = [], []
            for i, j in zip(starts.tolist(), starts[1:].tolist()):
                taken = walk(kinds[i:j], needs[i:j], chapters[i:j], quotas[i:j], budgets[i])
                at += [i + k for k in taken]
                pick += range(len(taken))
            out = table.take(pa.array(at, pa.int64())).select([*by, "item_id", "chapter", "kind", "need"])
            yield from out.append_column("pick", pa.array(pick, pa.int64())).combine_chunks().to_batches()

    types = dict(items.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in [*by, "item_id", "chapter", "kind"]) + ", need double, pick long"
    return best.select(*by, "item_id", "chapter", "kind", "need", "quota", "__budget").mapInArrow(choose, schema)


def fill_ladder(items: DataFrame, plan: Plan = Plan(), budget: str | None = None, between: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Each device's choice under the tightest per-minute cap (1, 2, 4 or 8 times the plan's) that fills 0.97 of the budget, else the loosest.

    All steps are filled in one job, as groups (device, cap) of their own;
    ``between`` may thin each step's candidates first. A cap that admits no
    item of a device more than the one below has the same candidates, so the
    same choice: such steps, always the last ones, are not filled again, and
    the last that is stands for them.
    """
    caps = [plan.per_minute * k for k in (1, 2, 4, 8)]
    ranked = burst_cap(items, caps[-1], rank="minute_rank")
    crowd = F.max(F.when(F.col("us").isNotNull(), F.col("minute_rank"))).over(Window.partitionBy("device"))
    differ = F.array_compact(F.array(F.lit(caps[0]), *(F.when(F.col("__crowd") > less, cap) for less, cap in zip(caps, caps[1:]))))
    told = ranked.withColumn("__crowd", crowd).withColumn("__caps", differ).withColumn("__last", F.array_max("__caps"))
    steps = told.withColumn("cap", F.explode("__caps")).drop("__crowd", "__caps").where(F.col("us").isNull() | (F.col("minute_rank") <= F.col("cap")))
    if budget:
        steps = steps.withColumn("__target", F.col(budget))
    steps = between(steps) if between else steps
    group = ["device", "cap", "__last", *(["__target"] if budget else [])]
    chosen = greedy_fill(steps, group, plan, budget)
    least, target = min(plan.photo_slot, plan.video_slot), F.col("__target") if budget else F.lit(plan.target_seconds)
    full = F.count("*").over(Window.partitionBy("device", "cap")) * least >= 0.97 * target
    named = chosen.withColumn("__full", full).withColumn("cap", F.when(~F.col("__full") & (F.col("cap") == F.col("__last")), caps[-1]).otherwise(F.col("cap")))
    best = named.withColumn("__cap", F.coalesce(F.min(F.when(F.col("__full"), F.col("cap"))).over(Window.partitionBy("device")), F.lit(caps[-1])))
    return best.where("cap = __cap").drop("__full", "__cap", "__last", "__target")
