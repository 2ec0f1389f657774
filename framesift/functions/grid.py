"""Measures of images held as arrays of rows one after another, and their orientation; Column functions throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.series import once

# Weights of red, green and blue in grey; the ends beyond which a pixel is clipped or black; the spread of full contrast.
LUMA = (0.299, 0.587, 0.114)
CLIPPED, BLACK, SPREAD = 247, 8, 70.0


def grey(red: Column, green: Column, blue: Column) -> Column:
    """Array of the pixels' grey."""
    r, g, b = LUMA
    return F.transform(F.arrays_zip(red.alias("r"), green.alias("g"), blue.alias("b")), lambda p: r * p["r"] + g * p["g"] + b * p["b"])


def mean(values: Column) -> Column:
    """Mean of an array without nulls; null if empty."""
    return F.try_divide(F.aggregate(values, F.lit(0.0), lambda a, v: a + v.cast("double")), F.size(values))


def variance(values: Column) -> Column:
    """Population variance of an array."""
    return once(values, lambda x: once(mean(x), lambda m: mean(F.transform(x, lambda v: (v - m) * (v - m)))))


def around(grid: Column, width: int, cell) -> Column:
    """Array of ``cell(at)`` for each cell, at(dy, dx) being its neighbour; the edges are repeated outward."""
    def whole(g: Column) -> Column:
        last = F.floor(F.size(g) / width).cast("int") - 1
        clamp = lambda x, top: F.least(F.greatest(x, F.lit(0)), top)

        def one(_, k: Column) -> Column:
            row, col = F.floor(k / width).cast("int"), k % width
            return cell(lambda dy, dx: F.get(g, clamp(row + dy, last) * width + clamp(col + dx, F.lit(width - 1))).cast("double"))

        return F.transform(g, one)

    return once(grid, whole)


def laplacian_variance(grid: Column, width: int) -> Column:
    """Sharpness: the population variance of each cell's four neighbours less four times itself."""
    return variance(around(grid, width, lambda at: at(-1, 0) + at(1, 0) + at(0, -1) + at(0, 1) - 4.0 * at(0, 0)))


def gradient_mean(grid: Column, width: int) -> Column:
    """Sharpness: the mean length of the Sobel gradient."""
    def length(at) -> Column:
        gx = at(-1, 1) + 2.0 * at(0, 1) + at(1, 1) - at(-1, -1) - 2.0 * at(0, -1) - at(1, -1)
        gy = at(1, -1) + 2.0 * at(1, 0) + at(1, 1) - at(-1, -1) - 2.0 * at(-1, 0) - at(-1, 1)
        return F.sqrt(gx * gx + gy * gy)

    return mean(around(grid, width, length))


def tones(grid: Column) -> Column:
    """(luma, clipped, black, contrast, exposure) of a grey image: mean, shares beyond either end, spread up to 1, and how near to mid grey, less for what is lost at the ends."""
    share = lambda g, test: mean(F.transform(g, lambda v: test(v).cast("int")))

    def told(g: Column) -> Column:
        plain = F.struct(mean(g).alias("luma"), share(g, lambda v: v > CLIPPED).alias("clipped"), share(g, lambda v: v < BLACK).alias("black"), F.least(F.lit(1.0), F.sqrt(variance(g)) / SPREAD).alias("contrast"))
        exposure = lambda t: F.least(F.greatest(1.0 - F.pow(F.abs(t["luma"] - 128.0) / 128.0, 1.7) - (1.6 * t["clipped"] + 0.8 * t["black"]), F.lit(0.0)), F.lit(1.0))
        return once(plain, lambda t: F.struct(*(t[c].alias(c) for c in ("luma", "clipped", "black", "contrast")), exposure(t).alias("exposure")))

    return once(grid, told)


def turned(grid: Column, width: int, orientation: Column) -> Column:
    """The cells as the orientation (1 to 8, else as they are) says to show them: from 5 on rows and columns change places, so the width becomes the height."""
    def whole(g: Column) -> Column:
        height = F.floor(F.size(g) / width).cast("int")
        wide = F.when(orientation.between(5, 8), height).otherwise(width)

        def one(_, k: Column) -> Column:
            row, col = F.floor(k / wide).cast("int"), (k % wide).cast("int")
            mirror, flip = width - 1 - col, height - 1 - row
            place = lambda r, c: r * width + c
            at = F.when(orientation == 2, place(row, mirror)).when(orientation == 3, place(flip, mirror)).when(orientation == 4, place(flip, col))
            at = at.when(orientation == 5, place(col, row)).when(orientation == 6, place(height - 1 - col, row)).when(orientation == 7, place(height - 1 - col, width - 1 - row)).when(orientation == 8, place(col, width - 1 - row))
            return F.get(g, at.otherwise(k))

        return F.transform(g, one)

    return once(grid, whole)


def frame_motion(frames: DataFrame, by: list[str], order: list[str], grid: str, out: str = "motion") -> DataFrame:
    """Frames with the mean difference of their cells from the frame before in the same group; 0 for the first, and where the sizes differ or either has no cells."""
    before = F.lag(grid).over(Window.partitionBy(*by).orderBy(*order))
    told = frames.withColumn("__before", before)
    apart = mean(F.zip_with(F.col(grid), F.col("__before"), lambda a, b: F.abs(a.cast("double") - b.cast("double"))))
    return told.withColumn(out, F.when(F.size(grid) == F.size("__before"), F.coalesce(apart, F.lit(0.0))).otherwise(0.0)).drop("__before")
