"""Selection operators: caps, quotas, weights, apportionment, near-duplicates."""

from __future__ import annotations

import math
from itertools import combinations, count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import Analysis, Plan
from ..functions.columns import hamming
from .runs import whole_runs


#: Rounds of greedy_dedupe before few open items, of so many arcs, are settled in one task (tens of MB).
ROUNDS, TAIL = 12, 200_000


def burst_cap(items: DataFrame, cap: int = 2, bucket_s: int = 60, by: tuple[str, ...] = ("device",), rank: str | None = None) -> DataFrame:
    """At most ``cap`` items of a time bucket, best score first, ties to the least id; items without a time pass. ``rank`` names a column to keep the place in."""
    w = Window.partitionBy(*by, F.floor(F.col("us") / (bucket_s * 1_000_000))).orderBy(F.col("score").desc(), "item_id")
    kept = items.withColumn("__n", F.row_number().over(w)).where(F.col("us").isNull() | (F.col("__n") <= cap))
    return kept.withColumnRenamed("__n", rank) if rank else kept.drop("__n")


#: Rows that a key of near_pairs is to hold on average, at most; most keys a row.
KEY_ROWS, ROW_KEYS = 64, 3003
#: What a key of a row and a candidate pair of the join cost, in pairs compared in blocks; least and most rows of such a block.
KEY_COST, JOIN_COST, BLOCK = 500, 50, (1024, 16384)


def key_blocks(rows: int, most: int) -> int:
    """How many blocks of 64 bits cut into most + c a key of near_pairs joins: the least c whose keys hold KEY_ROWS rows on average, as far as ROW_KEYS keys a row allow."""
    c = 1
    while rows >> (64 * c // (most + c)) > KEY_ROWS and most + c < 64 and math.comb(most + c + 1, c + 1) <= ROW_KEYS:
        c += 1
    return c


def keys_pay(rows: int, most: int) -> bool:
    """Whether looking a row up by its keys costs less than comparing it with all rows: not for few rows, nor where ``most`` is so large that keys hold too few bits."""
    c = key_blocks(rows, most)
    return math.comb(most + c, c) * (KEY_COST + JOIN_COST * (rows >> (64 * c // (most + c)))) < rows


def near_pairs(hashes: DataFrame, most: int, by: tuple[str, ...] = (), rows: int | None = None) -> DataFrame:
    """(a, b, distance) of rows (id, hash) of one group within ``most`` of 64 bits, a < b; ``rows``, those of the largest group, are counted if not given.

    By keys where that pays (``keys_pay``), else all rows of a group against all, block by block.
    """
    rows = (hashes.groupBy(*by).count().agg(F.max("count")).first()[0] or 0) if rows is None else rows
    return keyed_pairs(hashes, most, by, rows) if keys_pay(rows, most) else compared_pairs(hashes, most, by, rows)


def compared_pairs(hashes: DataFrame, most: int, by: tuple[str, ...], rows: int) -> DataFrame:
    """``near_pairs`` by comparison: rows are dealt into blocks by their ids, a cell compares two blocks, so a task holds two blocks of at most some BLOCK rows and every pair meets once."""
    side = max(1, -(-rows // min(max(rows // 16, BLOCK[0]), BLOCK[1])))
    at = F.pmod(F.xxhash64("id"), F.lit(side)).cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.lit(side - 1)), lambda j: F.least("at", j).cast("long") * side + F.greatest("at", j))
    dealt = hashes.select(*by, "id", "hash", at.alias("at")).where("id IS NOT NULL AND hash IS NOT NULL").select(*by, F.explode(cells).alias("cell"), "at", "id", "hash")
    keys = len(by) + 1

    def compare(batches):
        for table, starts in whole_runs(batches, keys):
            cell, at, ids, values = (table.column(k).to_numpy() for k in range(keys - 1, keys + 3))
            values = np.ascontiguousarray(values).view(np.uint64)  # bits of negative numbers would be those of their absolute value
            for i, j in zip(starts, starts[1:]):
                first = at[i:j] == cell[i] // side
                second = ~first if cell[i] // side != cell[i] % side else first
                (x, y), (u, v) = ((z[i:j][first], z[i:j][second]) for z in (ids, values))
                for k in range(0, len(x), 256):  # a strip of 256 rows against the other block
                    bits = np.bitwise_count(u[k : k + 256, None] ^ v)
                    near = bits <= most
                    if second is first:
                        near &= x[k : k + 256, None] < y
                    p, q = np.nonzero(near)
                    if len(p):
                        a, b = x[p + k], y[q]
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(bits[p, q].astype(np.int32))], names=["a", "b", "distance"])

    kind = hashes.schema["id"].dataType.simpleString()
    return dealt.repartition(*by, "cell").sortWithinPartitions(*by, "cell").mapInArrow(compare, f"a {kind}, b {kind}, distance int")


def keyed_pairs(hashes: DataFrame, most: int, by: tuple[str, ...], rows: int) -> DataFrame:
    """``near_pairs`` by keys.

    Of most + c blocks a near pair has c equal at least. Each set of c blocks
    is a key, an equi-join; c grows with the number of rows, so that keys stay
    short lists of rows. A pair counts at the first c blocks that it has equal
    and at no other key, so nothing is made distinct. A row has many keys, of
    which Spark's estimate of its size knows nothing: the join always merges.
    """
    c = key_blocks(rows, most)
    n = most + c
    cut = [64 * i // n for i in range(n + 1)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    blocks = [(1 << cut[i + 1]) - (1 << cut[i]) for i in range(n)]
    masks = F.array(*(F.lit(signed(sum(s))).cast("long") for s in combinations(blocks, c)))
    x = hashes.select(F.explode(masks).alias("mask"), *by, "id", "hash").select(F.struct("mask", F.col("hash").bitwiseAND(F.col("mask")).alias("v"), *by).alias("k"), "id", "hash")
    a, b = x.toDF("k", "a", "ha"), x.toDF("k", "b", "hb")
    near = a.hint("merge").join(b.hint("merge"), "k").where("a < b").withColumn("distance", hamming(F.col("ha"), F.col("hb"))).where(F.col("distance") <= most)
    apart, none = F.col("ha").bitwiseXOR(F.col("hb")), F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("mask"))
    first = F.aggregate(
        F.array(*(F.lit(signed(m)).cast("long") for m in blocks)), none,
        lambda acc, m: F.when((acc["n"] < c) & (apart.bitwiseAND(m) == 0), F.struct((acc["n"] + 1).alias("n"), acc["mask"].bitwiseOR(m).alias("mask"))).otherwise(acc),
    )
    return near.where(first["mask"] == F.col("k.mask")).select("a", "b", "distance")


def settle(frames):
    """(id, kept) of open items from their arcs (id, before, k): k says whether the item before stays, if that is settled."""
    after, left, kept = {}, {}, {}
    for frame in frames:
        for i, before, k in zip(frame["id"].tolist(), frame["before"].tolist(), frame["k"].tolist()):
            after.setdefault(before, []).append(i)
            left[i] = left.get(i, 0) + 1
            if k is not None:
                kept[before] = bool(k)
    hit, ready = set(), list(kept)
    while ready:
        before = ready.pop()
        for i in after.get(before, ()):
            left[i] -= 1
            if kept[before]:
                hit.add(i)
            if not left[i]:
                kept[i] = i not in hit
                ready.append(i)
    yield pd.DataFrame({"id": list(left), "kept": [kept[i] for i in left]})


#: Items of a group that pass in order in one task; larger groups are settled by rounds.
GROUP = 4096


def apart(hashes: np.ndarray, most: int) -> np.ndarray:
    """Which of the hashes stay, the first first: those beyond ``most`` bits from all that stay before."""
    n, stay = len(hashes), np.ones(len(hashes), bool)
    if n <= 256 and (np.bitwise_count(hashes[:, None] ^ hashes) <= most).sum() == n:  # each is near to itself alone
        return stay
    for i in range(n):
        if stay[i]:
            stay[i + 1 :] &= np.bitwise_count(hashes[i + 1 :] ^ hashes[i]) > most
    return stay


def dedupe_in_order(items: DataFrame, most: int, by: tuple[str, ...]) -> DataFrame:
    """``greedy_dedupe`` of groups that a task can hold: each passes by falling score."""
    keys = len(by)
    dealt = items.select(*by, *(c for c in items.columns if c not in by)).where("hash <> 0").repartition(*by).sortWithinPartitions(*by, F.col("score").desc(), "id")

    def keep(batches):
        for table, starts in whole_runs(batches, keys):
            hashes = np.ascontiguousarray(table.column("hash").to_numpy()).view(np.uint64)
            stay = np.concatenate([apart(hashes[i:j], most) for i, j in zip(starts, starts[1:])])
            yield from table.filter(pa.array(stay)).combine_chunks().to_batches()

    return dealt.mapInArrow(keep, dealt.schema).select(*items.columns)


def greedy_dedupe(items: DataFrame, most: int = Analysis().hamming, by: tuple[str, ...] = ()) -> DataFrame:
    """Items (id, hash, score) kept when, by falling score, none of their group kept earlier is within ``most`` bits; ids are of one item each.

    Of equal hashes only the first can stay, so each counts once in the search.

    Rounds settle the items whose earlier neighbours are all settled: one with
    a kept neighbour goes, one whose neighbours are all gone stays; equal to
    the sequential pass. A chain of near items would take a round an item, so
    after ROUNDS rounds open items of at most TAIL arcs are settled in one
    task; of more, the rounds go on until all are settled. Each round's state is checkpointed.

    Groups of up to GROUP items need no rounds (``dedupe_in_order``).
    """
    if by:
        largest = items.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
        if largest <= GROUP:
            return dedupe_in_order(items, most, by)
        sized = items.withColumn("__size", F.count("*").over(Window.partitionBy(*by)))
        small, large = (sized.where(x).drop("__size") for x in (F.col("__size") <= GROUP, F.col("__size") > GROUP))
        return dedupe_in_order(small, most, by).unionByName(dedupe_in_rounds(large, most, by))
    return dedupe_in_rounds(items, most, by)


def dedupe_in_rounds(items: DataFrame, most: int, by: tuple[str, ...]) -> DataFrame:
    """``greedy_dedupe`` of groups of any size."""
    from ..sources.shared import cut_lineage

    first = F.row_number().over(Window.partitionBy(*by, "hash").orderBy(F.col("score").desc(), "id"))
    order = cut_lineage(items.select(*by, "id", "hash", "score").where("hash <> 0").withColumn("__n", first).where("__n = 1").drop("__n"))
    edges = near_pairs(order, most, by).select("a", "b")
    s = order.select("id", "score")
    both = edges.join(s.toDF("a", "sa").hint("merge"), "a").join(s.toDF("b", "sb").hint("merge"), "b")  # arcs may be many more than their estimate: never broadcast
    a_first = (F.col("sa") > F.col("sb")) | ((F.col("sa") == F.col("sb")) & (F.col("a") < F.col("b")))
    arcs = cut_lineage(both.select(F.when(a_first, F.col("a")).otherwise(F.col("b")).alias("before"), F.when(a_first, F.col("b")).otherwise(F.col("a")).alias("id")))
    state = cut_lineage(order.select("id", F.lit(None).cast("boolean").alias("kept")))
    for turn in count(1):
        seen = arcs.join(state.toDF("before", "k").hint("merge"), "before").groupBy("id").agg(F.max(F.coalesce(F.col("k"), F.lit(False)).cast("int")).alias("hit"), F.max(F.col("k").isNull().cast("int")).alias("open"))
        new = state.join(seen.hint("merge"), "id", "left").select("id", F.when(F.col("kept").isNotNull(), F.col("kept")).when(F.col("hit") == 1, False).when(F.coalesce("open", F.lit(0)) == 0, True).alias("kept"))
        state = cut_lineage(new)
        rest = state.where("kept IS NULL").select("id")
        if not rest.limit(1).count():
            break
        if turn >= ROUNDS:
            tail = arcs.join(rest.hint("merge"), "id").join(state.toDF("before", "k").hint("merge"), "before").select("id", "before", "k")
            if tail.count() <= TAIL:
                settled = tail.coalesce(1).mapInPandas(settle, rest.withColumn("kept", F.lit(True)).schema)
                state = cut_lineage(state.where("kept IS NOT NULL").union(settled))
                break
    return items.join(state.where("kept").select("id"), "id", "left_semi")


def largest_remainder(rows: DataFrame, total: int | Column, by: list[str], weight: str = "weight", key: str = "key") -> DataFrame:
    """Whole units in proportion to weights, summing to ``total`` (a number or a column, one value a group): floors, then one more for the largest fractions, ties to the least key."""
    g, total = Window.partitionBy(*by), F.lit(total) if isinstance(total, int) else total
    share = F.col(weight) / F.sum(weight).over(g) * total
    x = rows.withColumn("__s", F.when(F.sum(weight).over(g) > 0, share).otherwise(total.cast("double") / F.count("*").over(g)))
    x = x.withColumn("units", F.floor("__s")).withColumn("__r", F.row_number().over(g.orderBy((F.col("__s") - F.floor("__s")).desc(), key)))
    return x.withColumn("units", F.col("units") + (F.col("__r") <= total - F.sum("units").over(g)).cast("bigint")).drop("__s", "__r")


def bounded_units(rows: DataFrame, total: int | Column, by: list[str], key: str = "key") -> DataFrame:
    """Whole units (want, low, high given) that sum to ``total`` per group where the bounds allow: the clamped remainder shares, then single units moved by need.

    Lows over the total stay low, highs under it stay high. Missing units go to
    the rows furthest below their want, spare ones come from those furthest
    above: each possible unit is a row, ranked once per group, so no loop.
    """
    g, total = Window.partitionBy(*by), F.lit(total) if isinstance(total, int) else total
    x = largest_remainder(rows, total, by).withColumn("high", F.greatest("low", "high"))
    x = x.withColumn("want", F.col("weight") / F.sum("weight").over(g) * total).withColumn("out", F.greatest("low", F.least("high", "units")))
    x = x.withColumn("miss", total - F.sum("out").over(g)).withColumn("most", F.least(F.abs("miss"), 4 * F.count("*").over(g) + 64))
    rise, fall = (F.col("miss") > 0) & (F.col("high") > F.col("out")), (F.col("miss") < 0) & (F.col("out") > F.col("low"))
    steps = F.when(rise, F.sequence(F.col("out"), F.least(F.col("high"), F.col("out") + F.col("most")) - 1)).when(fall, F.sequence(F.greatest(F.col("low"), F.col("out") - F.col("most")) + 1, F.col("out")))
    unit = x.select(*by, key, "want", "most", F.signum("miss").cast("bigint").alias("sign"), F.explode(steps).alias("v"))
    rank = Window.partitionBy(*by).orderBy((F.col("v") - F.col("want")) * F.col("sign"), F.col(key) * F.col("sign"))
    moved = unit.withColumn("__r", F.row_number().over(rank)).where(F.col("__r") <= F.col("most")).groupBy(*by, key).agg(F.sum("sign").alias("moved"))
    lows, highs = F.sum("low").over(g), F.sum("high").over(g)
    y = x.withColumns({"__l": lows, "__h": highs}).join(moved, [*by, key], "left")
    out = F.when(F.col("__l") > total, F.col("low")).when(F.col("__h") <= total, F.col("high")).otherwise(F.col("out") + F.coalesce("moved", F.lit(0)))
    return y.select(*by, key, out.alias("units"))


def chapter_quotas(items: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """(device, chapter, available_s, quota_s): a chapter's share of its device's footage, of 0.7 of the target, one photo's time at least."""
    c = items.groupBy("device", "chapter").agg(F.sum("seconds").alias("available_s"))
    share = F.col("available_s") / F.sum("available_s").over(Window.partitionBy("device"))
    return c.withColumn("quota_s", F.greatest(F.lit(plan.least_photo_seconds), share * plan.quota_share * plan.target_seconds))


def slot_weights(items: DataFrame) -> DataFrame:
    """weight of each item: 0.78 to 1.22 by score within the device, centred on its chapter's mean; 0.02 at least."""
    d, c = Window.partitionBy("device"), Window.partitionBy("device", "chapter")
    s = F.greatest(F.lit(0.02), F.col("score"))
    low, high = F.min(s).over(d), F.max(s).over(d)
    x = items.withColumn("__w", F.when(high > low, 0.78 + 0.44 * (s - low) / (high - low)).otherwise(F.lit(1.0)))
    return x.withColumn("weight", F.greatest(F.lit(0.02), F.col("__w") - F.avg("__w").over(c) + F.avg("__w").over(d))).drop("__w")


def snap_frames(slots: DataFrame, bpm: float, fps: int, by: list[str], order: list[str]) -> DataFrame:
    """frame (end, from the beats so far) and frames of each slot (beats): cumulative snapping, half to even, so no error adds up."""
    w = Window.partitionBy(*by).orderBy(*order)
    x = slots.withColumn("frame", F.bround(F.sum("beats").over(w) * F.lit(60.0 / bpm * fps)).cast("bigint"))
    return x.withColumn("frames", F.col("frame") - F.coalesce(F.lag("frame").over(w), F.lit(0)))


def title_plan(slots: DataFrame, by: list[str], plan: Plan, n: Column, titles: Column) -> dict[str, Column]:
    """Beats of a list of ``n`` slots with so many titles: of a title (per_title) and of all others together (content)."""
    spb = 60.0 / plan.bpm
    total = F.greatest(n, F.lit(round(plan.target_seconds / spb)))
    share = F.floor(total * plan.title_beats_share / F.greatest(titles, F.lit(1)))
    each = F.greatest(F.lit(2), F.least(F.lit(round(plan.title_seconds / spb)), share))
    return {"per_title": each, "content": F.greatest(n - titles, total - each * titles)}


def slot_bounds(slots: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """Slots (kind, footage: null for photos) with low and high, the beats each may last: by its kind, and by a clip's footage."""
    spb, video = 60.0 / plan.bpm, F.col("kind") == "video"
    low = F.when(video, max(1, math.ceil(plan.video_range[0] / spb))).otherwise(max(1, math.ceil(plan.photo_range[0] / spb)))
    most = F.greatest(low, F.when(video, math.floor(plan.video_range[1] / spb)).otherwise(math.floor(plan.photo_range[1] / spb)))
    seen = F.when(F.col("footage").isNotNull(), F.greatest(F.lit(1), F.least(most, F.floor(F.col("footage") / spb)))).otherwise(most)
    return slots.withColumn("low", low.cast("bigint")).withColumn("high", F.greatest("low", seen.cast("bigint")))


def shed_weakest(slots: DataFrame, by: list[str], plan: Plan = Plan(), most: int = 64) -> DataFrame:
    """Slots (pos, is_title, score, low, high) without the fewest weakest whose going lets a list end by 1.02 of its target: at most ``most``, and three that are no titles stay.

    Dropping one at a time and timing again comes to this: after k drops the
    list lasts as long as its titles and the least its other slots need, or as
    the beats there are, so all k are judged at once from running sums.
    """
    spb, g = 60.0 / plan.bpm, Window.partitionBy(*by)
    plain = ~F.col("is_title")
    rank = F.row_number().over(g.orderBy("is_title", "score", "pos"))
    x = slots.withColumn("__k", F.when(plain, rank)).withColumns({"__n": F.count_if(plain).over(g), "__t": F.count_if("is_title").over(g)})
    stays = g.orderBy(F.col("__k").asc_nulls_last()).rowsBetween(0, Window.unboundedFollowing)
    content = lambda c: F.coalesce(F.sum(F.when(plain, F.col(c))).over(stays), F.lit(0))  # noqa: E731  of this one and all stronger ones
    x = x.withColumns({"__low": content("low"), "__high": content("high")})
    gone = F.col("__k") - 1
    left = F.col("__n") - gone
    beats = title_plan(x, by, plan, left + F.col("__t"), F.col("__t"))
    lasts = F.col("__t") * beats["per_title"] + F.greatest("__low", F.least(beats["content"], "__high"))
    fits = F.bround(lasts * (spb * plan.fps)) / plan.fps <= plan.target_seconds * 1.02 + 0.05
    stop = fits | (gone >= most) | (left <= 3)
    drops = F.min(F.when(F.col("__k").isNotNull() & stop, gone)).over(g)
    return x.withColumn("__drop", drops).where(F.col("__k").isNull() | (F.col("__k") > F.col("__drop"))).drop("__k", "__n", "__t", "__low", "__high", "__drop")


def last_residue(slots: DataFrame, target: Column, bpm: float, fps: int, by: list[str]) -> DataFrame:
    """Snapped slots (frame, frames) whose last takes up what is missing to the target in seconds, or is over, if that is half a beat and a frame at most."""
    last = F.max("frame").over(Window.partitionBy(*by))
    slack = F.bround(target * fps).cast("bigint") - last
    more = F.when((F.col("frame") == last) & (F.abs(slack) <= 0.5 * (60.0 / bpm) * fps + 1), slack).otherwise(0)
    return slots.withColumn("__m", more).withColumn("frame", F.col("frame") + F.col("__m")).withColumn("frames", F.col("frames") + F.col("__m")).drop("__m")


def merge_pairs(slots: DataFrame, by: list[str], order: str = "pos") -> DataFrame:
    """A row for each leader of ``two_up``: its partner (pair, else null), and their beats and seconds together."""
    pair = F.max(F.when(F.col(order) != F.col("leader"), F.col(order))).alias("pair")
    return slots.groupBy(*by, "leader").agg(pair, F.sum("beats").alias("beats"), F.sum("seconds").alias("seconds"))


def need_quotas(items: DataFrame, by: list[str], plan: Plan = Plan(), budget: str | None = None) -> DataFrame:
    """(by, chapter, quota): a chapter's share of its group's material, by the time its items need, of 0.7 of the target, or of the group's ``budget``; one photo's time at least."""
    need = F.when(F.col("kind") == "video", F.lit(plan.video_slot)).otherwise(F.lit(plan.photo_slot))
    target = F.max(F.col(budget) if budget else F.lit(plan.target_seconds))
    size = items.groupBy(*by, "chapter").agg(F.sum(need).alias("__a"), target.alias("__t"))
    share = F.col("__a") / F.sum("__a").over(Window.partitionBy(*by))
    return size.select(*by, "chapter", F.greatest(F.lit(plan.photo_slot), share * plan.quota_share * F.col("__t")).alias("quota"))


def two_up(slots: DataFrame, by: list[str], order: str = "pos") -> DataFrame:
    """pair of consecutive portrait photos, from the left: the slot's pair leader; others lead themselves."""
    w = Window.partitionBy(*by).orderBy(order)
    x = slots.withColumn("__run", F.sum(F.when(F.col("portrait"), 0).otherwise(1)).over(w))
    r = Window.partitionBy(*by, "__run", "portrait").orderBy(order)
    x = x.withColumn("__n", F.row_number().over(r))
    lead = F.when(F.col("portrait") & (F.col("__n") % 2 == 0), F.lag(order).over(r)).otherwise(F.col(order))
    return x.withColumn("leader", lead).drop("__run", "__n")


def top_per_chapter(items: DataFrame, k: int) -> DataFrame:
    """The k best items of each chapter, ties to the least id."""
    w = Window.partitionBy("device", "chapter").orderBy(F.col("score").desc(), "item_id")
    return items.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def chapter_weights(items: DataFrame) -> DataFrame:
    """(device, chapter, weight): a chapter's items plus 0.55 of the device's mean, over the sum; one chapter alone weighs 1."""
    g = Window.partitionBy("device")
    n = items.groupBy("device", "chapter").agg(F.count("*").alias("n"))
    boosted = F.col("n") + F.when(F.count("*").over(g) > 1, 0.55).otherwise(0.0) * F.sum("n").over(g) / F.count("*").over(g)
    return n.withColumn("__b", boosted).select("device", "chapter", (F.col("__b") / F.sum("__b").over(g)).alias("weight"))


def hook_order(slots: DataFrame, by: list[str], order: str = "pos") -> DataFrame:
    """place (from 1): the best-scoring slot that is no title comes before the first title, or first without one; as before if fewer than four such slots or it is among the first two."""
    g = Window.partitionBy(*by)
    plain = ~F.col("is_title")
    best = F.row_number().over(g.orderBy(F.col("is_title"), F.col("score").desc(), order)) == 1
    x = slots.withColumn("__p", F.row_number().over(g.orderBy(order))).withColumn("__best", best & plain)
    at = F.coalesce(F.min(F.when(~plain, F.col("__p"))).over(g), F.lit(1)) - 0.5
    moves = F.col("__best") & (F.sum(plain.cast("int")).over(g) >= 4) & (F.col("__p") > 2)
    x = x.withColumn("__k", F.when(moves, at).otherwise(F.col("__p").cast("double")))
    return x.withColumn("place", F.row_number().over(g.orderBy("__k")).cast("bigint")).drop("__p", "__best", "__k")


def in_point(kind: Column, start: Column, end: Column, length: Column, slot: Column) -> Column:
    """Where a clip starts: earlier than ``start`` where its footage would end before the slot does."""
    limit = F.least(end, F.coalesce(F.nullif(length, F.lit(0.0)), end))
    earlier = F.greatest(F.lit(0.0), limit - slot)
    return F.when((kind == "video") & (slot > limit - start + 1e-6) & (earlier < start - 1e-6), earlier).otherwise(start)
