"""Operators on long series, a row a sample: tempo by autocorrelation, beats by dynamic programming, resampling; and onsets of short ones."""

from __future__ import annotations

import math
from collections import deque

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .series import above_local_mean, once, scaled

#: Slowest and fastest tempo; the tempo that the prior favours and its width in octaves; how much better another octave must be.
RANGE, FAVOURED, WIDTH, BETTER = (60.0, 185.0), 120.0, 0.9, 1.06
#: Least samples that tell a tempo, and what stands without them.
LEAST_SAMPLES, UNTOLD = 8, 120.0
TIGHTNESS = 100.0
#: Places of a series whose products are made in one window.
BLOCK = 4096


def binned(events: DataFrame, key: str, at: Column, width: float) -> DataFrame:
    """(key, i, v): events counted in bins of ``width`` from each key's first one on; empty bins have no row, events without a time count nowhere."""
    timed = events.select(key, at.alias("__at")).where("__at IS NOT NULL")
    first = timed.groupBy(key).agg(F.min("__at").alias("__first"))
    return timed.join(first, key).groupBy(key, F.floor((F.col("__at") - F.col("__first")) / width).cast("long").alias("i")).agg(F.count("*").cast("double").alias("v"))


def filled(bins: DataFrame, key: str) -> DataFrame:
    """(key, i, v) with a row of 0 for every bin up to the key's last that has none."""
    spine = bins.groupBy(key).agg(F.max("i").alias("__n")).select(key, F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n"))).alias("i"))
    return spine.join(bins, [key, "i"], "left").fillna(0.0, ["v"])


def prior(bpm: Column) -> Column:
    """How likely a tempo is: log-normal, in octaves from the favoured one."""
    octaves = F.log2(bpm / FAVOURED) / WIDTH
    return F.exp(-0.5 * octaves * octaves)


def autocorrelation(bins: DataFrame, key: str, lags: tuple[int, int]) -> DataFrame:
    """(key, lag, n, r) for each lag of the closed range below a key's number n of bins: the centred series times itself shifted, over its own square; n is the last bin's place, plus one.

    Bins without a row are 0 and cost nothing: what two bins give is their
    product, found in a window over a block of a series and the bins up to the
    greatest lag beyond it, so a long series spreads over the cluster and a
    bin is shuffled once, not once a lag; the mean's share follows from the
    sums of all bins and of those within a lag of either end.
    """
    low, high = lags
    whole = bins.groupBy(key).agg((F.max("i") + 1).alias("n"), F.sum("v").alias("total"), F.sum(F.col("v") * F.col("v")).alias("square"))
    every = F.explode(F.sequence(F.lit(low).cast("long"), F.lit(high).cast("long"))).alias("lag")
    block = lambda i: F.floor(i / BLOCK)
    dealt = bins.select(key, "i", "v", F.explode(F.sequence(F.greatest(F.lit(0).cast("long"), block(F.col("i") - high)), block(F.col("i")))).alias("block"))
    ahead = F.collect_list(F.struct("i", "v")).over(Window.partitionBy(key, "block").orderBy("i").rangeBetween(low, high))
    met = dealt.withColumn("ahead", ahead).where(F.col("block") == block(F.col("i"))).select(key, "i", "v", F.explode("ahead").alias("u"))
    products = met.groupBy(key, (F.col("u.i") - F.col("i")).alias("lag")).agg(F.sum(F.col("u.v") * F.col("v")).alias("product"))
    edge = bins.join(whole.select(key, "n"), key).withColumns({"near": F.col("i"), "far": F.col("n") - 1 - F.col("i")}).where((F.col("near") < high) | (F.col("far") < high))
    missed = edge.select(key, "near", "far", "v", every).groupBy(key, "lag").agg(F.sum(F.when(F.col("near") < F.col("lag"), F.col("v")).otherwise(0.0) + F.when(F.col("far") < F.col("lag"), F.col("v")).otherwise(0.0)).alias("missed"))
    out = whole.select("*", every).where("lag < n").join(products, [key, "lag"], "left").join(missed, [key, "lag"], "left").fillna(0.0, ["product", "missed"])
    mean = F.col("total") / F.col("n")
    centred = F.col("product") - mean * (2 * F.col("total") - F.col("missed")) + (F.col("n") - F.col("lag")) * mean * mean
    return out.select(key, "lag", "n", (centred / (F.col("square") - F.col("total") * mean + 1e-9)).alias("r"))


def tempo(bins: DataFrame, key: str, fps: float, bpm_range: tuple[float, float] = RANGE) -> DataFrame:
    """(key, bpm) of series (key, i, v) of ``fps`` samples a second: the lag of the best autocorrelation under the prior, the least among equals; then half and twice the tempo where those are better by the margin. 120 for under eight samples or too few for any lag.

    A row a key and lag is all that is gathered of a series. Null values are
    no samples; an empty table gives an empty one.
    """
    least = max(1, round(60.0 / bpm_range[1] * fps))
    most = round(60.0 / bpm_range[0] * fps)
    known = bins.where("v IS NOT NULL")
    r = autocorrelation(known, key, (max(1, least - 2), most + 2))
    of_key = r.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("lag", "r"))).alias("r"))
    n = known.groupBy(key).agg((F.max("i") + 1).alias("n"))
    last = F.least(F.col("n") - 1, F.lit(most))
    weighted = F.transform(F.filter("r", lambda x: (x["lag"] >= least) & (x["lag"] < last)), lambda x: F.struct((x["r"] * prior(60.0 * fps / x["lag"])).alias("s"), (-x["lag"]).alias("lag")))
    clipped = lambda bpm: F.least(F.greatest(bpm, F.lit(bpm_range[0])), F.lit(bpm_range[1]))

    def score(bpm: Column) -> Column:
        """The best autocorrelation within a sample of the tempo's lag, under the prior."""
        lag = 60.0 * fps / bpm
        low, high = F.floor(F.greatest(F.lit(1.0), lag - 1)), F.floor(F.least(F.col("n") - 1, lag + 1))
        near = F.array_max(F.transform(F.filter("r", lambda x: (x["lag"] >= low) & (x["lag"] <= high)), lambda x: x["r"]))
        return F.when(high < low, -1.0).otherwise(near * prior(bpm))

    def octave(held: Column, factor: float) -> Column:
        other = held["bpm"] * factor
        fair = (other >= bpm_range[0]) & (other <= bpm_range[1])
        return once(F.struct(other.alias("bpm"), F.when(fair, score(other)).alias("score")), lambda x: F.when(x["score"] > held["score"] * BETTER, x).otherwise(held))

    first = clipped(60.0 * fps / -F.array_max(weighted)["lag"])
    best = once(once(once(first, lambda b: F.struct(b.alias("bpm"), score(b).alias("score"))), lambda h: octave(h, 0.5)), lambda h: octave(h, 2.0))["bpm"]
    told = (F.col("n") >= LEAST_SAMPLES) & (last > least) & F.col("r").isNotNull()
    return n.join(of_key, key, "left").select(key, F.when(told, best).otherwise(UNTOLD).alias("bpm"))


class Beats:
    """The programme over one series: a sample scores the best score of the two periods before it and what follows it, weighed by how far from a period later it lies. Holds the samples of two periods."""

    def __init__(self, bpm: float, fps: float):
        self.period = 60.0 * fps / bpm
        self.reach = math.ceil(self.period * 2)
        self.weights = [-TIGHTNESS * math.log((self.reach + 2 - d) / self.period) ** 2 for d in range(self.reach + 2)]
        self.ahead: deque[float] = deque()
        self.best: deque[tuple[int, float]] = deque()  # scores within reach, falling; of equal ones the first
        self.t = 0

    def step(self) -> tuple[int, int]:
        """The next sample and the one before it on its best way."""
        t, cost = self.t, sum(w * v for w, v in zip(self.weights, self.ahead))
        while self.best and self.best[0][0] < t - self.reach:
            self.best.popleft()
        back, score = self.best[0] if t else (0, 0.0)
        score += cost
        while self.best and self.best[-1][1] < score:
            self.best.pop()
        self.best.append((t, score))
        self.ahead.popleft()
        self.t += 1
        return t, back

    def push(self, value: float):
        self.ahead.append(value)
        if len(self.ahead) == len(self.weights):
            yield self.step()

    def close(self):
        while self.ahead:
            yield self.step()


def beats(series: DataFrame, tempos: DataFrame, key: str, fps: float) -> DataFrame:
    """(key, i, at_s): the samples of series (key, i from 0, v; places without a row are 0) that the best way through ends to its last one hits, given (key, bpm); none for a series under two periods or a period of a sample.

    Each sample looks back over two periods, so a series passes in its order,
    with two periods held; its way is then followed from the end, over the
    samples in falling order, one place held: they lie in the task that made
    them, so they are sorted there and not shuffled. Null values are 0; an
    empty table gives an empty one.
    """
    n = series.groupBy(key).agg((F.max("i") + 1).alias("n")).join(tempos.select(key, "bpm"), key)
    period = 60.0 * fps / F.col("bpm")
    fair = n.where((period > 1) & (F.col("n") >= F.floor(period * 2)))
    # keys are dealt by their hash; the key's own value is kept beside it
    rows = series.join(fair, key).select(F.col(key), F.col("i").cast("long"), F.coalesce(F.col("v"), F.lit(0.0)).cast("double").alias("v"), F.col("bpm").cast("double"))
    shape = f"{key} {rows.schema[key].dataType.simpleString()}, i long, back long, last boolean"

    def ways(batches):
        held, on, at = None, None, 0
        out: list[tuple] = []

        def made(last):
            ends = [False] * len(out)
            if last and out:
                ends[-1] = True
            cols = list(zip(*out)) if out else ((), (), ())
            batch = pa.RecordBatch.from_arrays([pa.array(cols[0], kind), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(ends, pa.bool_())], names=[key, "i", "back", "last"])
            out.clear()
            return batch

        for batch in batches:
            kind = batch.schema.field(0).type
            for k, i, v, bpm in zip(*(c.to_pylist() for c in batch.columns)):
                if on is None or k != held:
                    if on is not None:
                        out += [(held, *x) for x in on.close()]
                        yield made(True)
                    held, on, at = k, Beats(bpm, fps), 0
                while at <= i:
                    out += [(held, *x) for x in on.push(v if at == i else 0.0)]
                    at += 1
                    if len(out) > 8192:
                        yield made(False)
        if on is not None:
            out += [(held, *x) for x in on.close()]
            yield made(True)

    def hits(batches):
        held, at = None, None
        for batch in batches:
            k, i, back, last = (c.to_pylist() for c in batch.columns)
            take = []
            for j in range(batch.num_rows):
                if last[j]:
                    held, at = k[j], i[j]
                if k[j] == held and i[j] == at:
                    take.append(j)
                    at = back[j] if i[j] else -1
            if take:
                yield batch.take(pa.array(take)).select([0, 1])

    told = rows.repartition(key).sortWithinPartitions(key, "i").mapInArrow(ways, shape)
    way = told.sortWithinPartitions(key, F.col("i").desc()).mapInArrow(hits, f"{key} {rows.schema[key].dataType.simpleString()}, i long")
    return way.withColumn("at_s", F.col("i") / fps)


def resampled(series: DataFrame, grid: DataFrame, key: str) -> DataFrame:
    """(key, at, v) for each place of the grid (key, at): the straight line between the samples (key, at, v) before and after it, the end samples beyond the ends; null for keys without samples. Samples of one place count as their mean, null ones not at all.

    One sort by key and place: each sample brings the next along, and a place
    takes the last sample up to it.
    """
    samples = series.where("v IS NOT NULL AND at IS NOT NULL").groupBy(key, "at").agg(F.avg("v").alias("v"))
    w = Window.partitionBy(key).orderBy("at")
    after = samples.select(key, "at", F.struct("at", "v", F.lead("at").over(w).alias("next"), F.lead("v").over(w).alias("then")).alias("s"), F.lit(False).alias("asked"))
    both = after.unionByName(grid.select(key, "at", F.lit(None).cast(after.schema["s"].dataType).alias("s"), F.lit(True).alias("asked")))
    order = w.orderBy("at", "asked")
    last = F.last("s", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    first = F.min_by(F.col("s.v"), F.when(F.col("s").isNotNull(), F.col("at"))).over(Window.partitionBy(key))
    told = both.withColumns({"x": last, "first": first}).where("asked")
    line = F.col("x.v") + (F.col("x.then") - F.col("x.v")) * ((F.col("at") - F.col("x.at")) / (F.col("x.next") - F.col("x.at")))
    return told.select(key, "at", F.coalesce(F.when(F.col("x").isNull(), F.col("first")).otherwise(line), F.col("x.v")).alias("v"))


def stretched(series: DataFrame, key: str, rate: float, to: float) -> DataFrame:
    """(key, i, v): dense series (key, i from 0, v) of one rate at another: round(n * to / rate) samples from the first to the last, on straight lines between neighbours.

    Every sample makes the new ones up to the next, so nothing is joined but
    a key's length.
    """
    n = series.groupBy(key).agg((F.max("i") + 1).alias("n"))
    m = F.bround(F.col("n") * to / rate).cast("long")
    step = F.when(F.col("m") > 1, (F.col("n") - 1) / (F.col("m") - 1)).otherwise(0.0)
    w = Window.partitionBy(key).orderBy("i")
    pairs = series.withColumn("then", F.lead("v").over(w)).join(n.withColumn("m", m).withColumn("step", step), key)
    place = lambda k: k * F.col("step")
    near = F.when(F.col("step") > 0, F.sequence(F.greatest(F.lit(0).cast("long"), F.floor(F.col("i") / F.col("step")) - 1), F.least(F.col("m") - 1, F.floor((F.col("i") + 1) / F.col("step")) + 1))).otherwise(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.col("m") - 1)))
    mine = pairs.where("m > 0").select(key, F.col("i").alias("from"), "v", "then", "step", F.explode(near).alias("i"))
    mine = mine.where(F.floor(place(F.col("i"))) == F.col("from"))
    return mine.select(key, "i", (F.col("v") + F.coalesce((F.col("then") - F.col("v")) * (place(F.col("i")) - F.col("from")), F.lit(0.0))).alias("v"))


def hann(size: int) -> list[float]:
    """The window of ``size`` samples."""
    return [0.5 - 0.5 * math.cos(2 * math.pi * j / (size - 1)) for j in range(size)]


def onsets(values: Column, size: int = 16, hop: int = 4) -> Column:
    """Array of a short series' onset strength, a value a frame: how much the logarithms of the spectrum rise from frame to frame, above the local mean, over the standard deviation; a single 0 below two windows.

    The spectrum is sums of products with cosine and sine tables of the
    window, for windows of some dozen samples.
    """
    window, bins = hann(size), range(size // 2 + 1)
    tables = [[F.array(*(F.lit(window[j] * f(2 * math.pi * k * j / size)) for j in range(size))) for f in (math.cos, math.sin)] for k in bins]
    part = lambda frame, t: F.aggregate(F.zip_with(frame, t, lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)

    def spectrum(frame: Column) -> Column:
        return F.array(*(F.log1p(100.0 * F.hypot(part(frame, c), part(frame, s))) for c, s in tables))

    def flux(spectra: Column) -> Column:
        rise = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: F.greatest(F.lit(0.0), y - x)), F.lit(0.0), lambda s, x: s + x)
        return F.transform(spectra, lambda now, i: F.when(i == 0, F.lit(0.0)).otherwise(rise(F.get(spectra, i - 1), now)))

    def strength(x: Column) -> Column:
        frames = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - size) / hop).cast("int")), lambda t: spectrum(F.slice(x, t * hop + 1, size)))
        return once(once(once(frames, flux), above_local_mean), scaled)

    return F.when(F.size(values) < 2 * size, F.array(F.lit(0.0))).otherwise(once(F.transform(values, lambda v: v.cast("double")), strength))
