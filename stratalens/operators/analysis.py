"""Aggregates of activity, features and results."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def histogram_features(cells: DataFrame, bins: int, low: float = 0.0, high: float = 0.2) -> DataFrame:
    """Counts by image, band and bin over all scales and places; the last bin is closed, empty bins are 0."""
    if bins < 1:
        raise ValueError("a number of bins is needed")
    inside = (F.col("v") >= low) & (F.col("v") <= high)
    at = F.when(inside, F.least(F.floor((F.col("v") - low) / (high - low) * bins), F.lit(bins - 1)).cast("int"))
    counts = cells.withColumn("_at", at).groupBy("image_id", "band").agg(*(F.count(F.when(F.col("_at") == k, 1)).alias(f"_{k}") for k in range(bins)))
    return counts.select("image_id", "band", F.posexplode(F.array(*(f"_{k}" for k in range(bins)))).alias("bin", "n"))


def histogram_vectors(cells: DataFrame, bins: int, low: float = 0.0, high: float = 0.2) -> DataFrame:
    """(image_id, features): the counts of histogram_features() in order of band and bin, as a feature vector."""
    counts = histogram_features(cells, bins, low, high)
    ordered = F.array_sort(F.collect_list(F.struct("band", "bin", "n")))
    return counts.groupBy("image_id").agg(F.transform(ordered, lambda c: c["n"].cast("double")).alias("features"))


ALPHA = 0.4  # of plotting positions


def _place(n: Column, p: float) -> tuple[Column, Column]:
    """The order statistic below a quantile (from 1), and the share of the one after it."""
    place = n * p + ALPHA + p * (1 - 2 * ALPHA)
    k = F.floor(F.greatest(F.lit(1.0), F.least(place, n - 1.0))).cast("int")
    return k, F.greatest(F.lit(0.0), F.least(place - k, F.lit(1.0)))


def quantile(values: Column, p: float) -> Column:
    """A quantile of an unsorted array, by plotting positions."""
    ordered, n = F.array_sort(values), F.size(values)
    k, share = _place(n, p)
    return F.when(n == 1, F.element_at(ordered, 1)).otherwise((1 - share) * F.element_at(ordered, k) + share * F.element_at(ordered, F.least(k + 1, n)))


def meta_features(values: DataFrame, by: str, v: str) -> DataFrame:
    """Mean, population deviation, extremes and the 0.3 and 0.7 quantiles of each group, exactly.

    The values that quantiles lie between are found by counts of ranges of values; only rows of the ranges that hold them are ranked."""
    stats = values.groupBy(by).agg(F.count("*").alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("low"), F.max(v).alias("high"))
    ranged = values.select(by, F.col(v).cast("double").alias("_v"))
    ranged = ranged.withColumn("_range", ranges(ranged, "_v"))
    group = Window.partitionBy(by)
    counts = ranged.groupBy(by, "_range").agg(F.count("*").alias("_n"))
    counts = counts.withColumn("n", F.sum("_n").over(group)).withColumn("_upto", F.sum("_n").over(group.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)))
    places = [(p, *_place(F.col("n"), p)) for p in (0.3, 0.7)]
    inside = lambda k: (k > F.col("_upto") - F.col("_n")) & (k <= F.col("_upto"))
    wanted = F.lit(False)
    for _, k, _share in places:
        wanted = wanted | inside(k) | inside(F.least(k + 1, F.col("n")))
    rows = ranged.join(counts.where(wanted), [by, "_range"])
    rank = F.row_number().over(Window.partitionBy(by, "_range").orderBy("_v")) + F.col("_upto") - F.col("_n")
    rows = rows.withColumn("_rank", rank)
    at = lambda k: F.max(F.when(F.col("_rank") == k, F.col("_v")))
    found = [e for p, k, share in places for e in (at(k).alias(f"_a{p}"), at(F.least(k + 1, F.col("n"))).alias(f"_b{p}"), F.max(share).alias(f"_s{p}"))]
    found = rows.groupBy(by).agg(*found)
    mixed = [((1 - F.col(f"`_s{p}`")) * F.col(f"`_a{p}`") + F.col(f"`_s{p}`") * F.col(f"`_b{p}`")).alias(name) for p, name in ((0.3, "q30"), (0.7, "q70"))]
    return stats.join(found, by).select(by, "mean", "std", "low", "high", *mixed)


def grouped_stats(rows: DataFrame, x: str, y: str) -> DataFrame:
    """n, mean, population deviation and standard error of y for each x."""
    return rows.groupBy(x).agg(F.count("*").alias("n"), F.avg(y).alias("y_mean"), F.stddev_pop(y).alias("y_std"), (F.stddev_pop(y) / F.sqrt(F.count("*"))).alias("y_stderr"))


def histogram2d(rows: DataFrame, x: str, y: str, x_bins: int, y_bins: int, x_range: tuple[float, float], y_range: tuple[float, float], weight: str | None = None) -> DataFrame:
    """Counts, or sums of weights, on a grid; upper edges belong to the last bins."""

    def at(c: str, bins: int, r: tuple[float, float]) -> Column:
        return F.least(F.floor((F.col(c) - r[0]) / (r[1] - r[0]) * bins), F.lit(bins - 1)).cast("int")

    inside = F.col(x).between(*x_range) & F.col(y).between(*y_range)
    total = F.count("*") if weight is None else F.sum(weight)
    return rows.where(inside).groupBy(at(x, x_bins, x_range).alias("x_bin"), at(y, y_bins, y_range).alias("y_bin")).agg(total.alias("n"))


def balance_entropy(rows: DataFrame, by: str) -> DataFrame:
    """One row: the entropy of the groups' shares over that of even shares."""
    n = rows.groupBy(by).agg(F.count("*").alias("n"))
    p = F.col("n") / F.col("total")
    return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("total")))).agg((-F.sum(p * F.log(p)) / F.log(F.count("*"))).alias("balance"), F.count("*").alias("groups"))


def arg_max(cells: DataFrame) -> DataFrame:
    """Every cell that attains its image's maximum."""
    return cells.withColumn("_top", F.max("v").over(Window.partitionBy("image_id"))).where("v = _top").drop("_top")


def arg_min(cells: DataFrame) -> DataFrame:
    """Every cell that attains its image's minimum."""
    return cells.withColumn("_low", F.min("v").over(Window.partitionBy("image_id"))).where("v = _low").drop("_low")


def first_of(cells: DataFrame, n: int = 64) -> DataFrame:
    """The first n cells of each image, by scale, band, y and x."""
    turn = F.row_number().over(Window.partitionBy("image_id").orderBy("scale", "band", "y", "x"))
    return cells.withColumn("_turn", turn).where(F.col("_turn") <= n).drop("_turn")


def bars(series: list[DataFrame]) -> DataFrame:
    """(series, name, place, y_mean, y_stderr) of tables (name, value, at): names stand in the order in which they come first
    in the first table; all tables must have the same names."""
    rows = [s.select(F.lit(k).alias("series"), "name", "value", "at") for k, s in enumerate(series)]
    names = {k: {r["name"] for r in s.select("name").distinct().collect()} for k, s in enumerate(series)}  # one bar each
    if any(n != names[0] for n in names.values()):
        raise ValueError("the series have different names")
    order = [r["name"] for r in rows[0].groupBy("name").agg(F.min("at").alias("at")).orderBy("at", "name").collect()]
    every = rows[0]
    for r in rows[1:]:
        every = every.unionByName(r)
    place = F.array_position(F.array(*map(F.lit, order)), F.col("name")).cast("int") - 1
    stats = every.groupBy("series", "name").agg(F.avg("value").alias("y_mean"), (F.stddev_pop("value") / F.sqrt(F.count("*"))).alias("y_stderr"))
    return stats.withColumn("place", place)


def best_match(cells: DataFrame) -> DataFrame:
    """Of each image and band the strongest cell, the first by scale, y and x among equals."""
    key = F.struct((-F.col("v")).alias("a"), "scale", "y", "x")
    best = cells.groupBy("image_id", "band").agg(F.min(key).alias("k"))
    return best.select("image_id", "band", F.col("k.scale").alias("scale"), F.col("k.y").alias("y"), F.col("k.x").alias("x"), (-F.col("k.a")).alias("v"))


def accuracy(rows: DataFrame, label: str, prediction: str) -> DataFrame:
    return rows.agg(F.avg((F.col(label) == F.col(prediction)).cast("double")).alias("accuracy"), F.count("*").alias("n"))


def confusion(rows: DataFrame, label: str, prediction: str) -> DataFrame:
    return rows.groupBy(label, prediction).agg(F.count("*").alias("n"))


#: Ranges of values at least, and rows of a range, about.
RANGES, RANGE_ROWS = 64, 1 << 20


def ranges(rows: DataFrame, column: str, most: int = RANGES) -> Column:
    """A number for ranges of a numeric column's values, in order, of about even counts, RANGES of them or up to `most` where the table
    is large: bounded windows over it can then be taken range by range, after the counts of the ranges before."""
    count = RANGES if most <= RANGES else min(most, max(RANGES, rows.count() // RANGE_ROWS))
    at = F.percentile_approx(column, [k / count for k in range(1, count)], max(1000, 20 * count))
    bounds = np.array(sorted(set(rows.agg(at.alias("at")).first()["at"] or [])), float)

    def below(values: pa.Array) -> pa.Array:
        there = values.is_valid().to_numpy(zero_copy_only=False)
        return pa.array(np.where(there, np.searchsorted(bounds, values.fill_null(0.0).to_numpy(zero_copy_only=False)), 0), pa.int32())

    return F.arrow_udf(below, "int")(F.col(column).cast("double"))


def auc(rows: DataFrame, label: str, score: str) -> DataFrame:
    """Area under the curve by rank sums over the distinct scores; ties count half. Sums run within ranges of scores."""
    by = rows.groupBy(F.col(score).cast("double").alias("s")).agg(F.sum((F.col(label) == 1).cast("long")).alias("pos"), F.sum((F.col(label) != 1).cast("long")).alias("neg"))
    by = by.withColumn("range", ranges(rows.select(F.col(score).cast("double").alias("s")), "s"))
    totals = sorted((r["range"], r["neg"]) for r in by.groupBy("range").agg(F.sum("neg").alias("neg")).collect())  # at most RANGES rows
    before, upto = {}, 0
    for k, neg in totals:
        before[k], upto = upto, upto + neg
    offset = F.create_map(*(F.lit(x) for k, n in (before or {0: 0}).items() for x in (k, n)))[F.col("range")]
    below = offset + F.coalesce(F.sum("neg").over(Window.partitionBy("range").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return by.withColumn("wins", F.col("pos") * (below + F.col("neg") / 2)).agg((F.sum("wins") / (F.sum("pos") * F.sum("neg"))).alias("auc"))


def mask_arrays(cells: DataFrame) -> DataFrame:
    """(image_id, height, width, data) of mask cells (image_id, y, x, m), row by row; a cell that isn't there is background."""
    sized = cells.groupBy("image_id").agg((F.max("y") + 1).cast("int").alias("height"), (F.max("x") + 1).cast("int").alias("width"), F.map_from_entries(F.collect_list(F.struct(F.struct(F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x")).alias("at"), F.col("m").cast("double").alias("m")))).alias("held"))
    i = F.sequence(F.lit(0), F.col("height") * F.col("width") - 1)
    at = lambda k: F.struct(F.floor(k / F.col("width")).cast("int").alias("y"), (k % F.col("width")).cast("int").alias("x"))
    return sized.select("image_id", "height", "width", F.transform(i, lambda k: F.coalesce(F.try_element_at("held", at(k)), F.lit(1.0))).alias("data"))


def integral(masks: DataFrame) -> DataFrame:
    """(image_id, height, width, sums) of masks (image_id, height, width, data): the foreground, 1 less the mask's value, above and
    to the left of each corner, (height + 1) x (width + 1) numbers."""

    def one(height: pa.Array, width: pa.Array, data: pa.Array) -> pa.Array:
        out, cells, at = [], data.flatten().to_numpy(zero_copy_only=False), 0
        for h, w in zip(height.to_pylist(), width.to_pylist()):
            table = np.zeros((h + 1, w + 1))
            table[1:, 1:] = (1 - cells[at : at + h * w].astype(np.float64).reshape(h, w)).cumsum(axis=0).cumsum(axis=1)
            at += h * w
            out.append(table.ravel())
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(np.concatenate(out) if out else np.zeros(0)))

    sums = F.arrow_udf(one, "array<double>")(F.col("height").cast("int"), F.col("width").cast("int"), F.col("data").cast("array<double>"))
    return masks.select("image_id", F.col("height").cast("int").alias("height"), F.col("width").cast("int").alias("width"), sums.alias("sums"))


def foreground_ratio(boxes: DataFrame, masks: DataFrame) -> DataFrame:
    """(box_id, ratio): of each box (box_id, image_id, top, bottom, left, right) the share of foreground in the part of it that lies
    in its image's mask (image_id, height, width, data; 0 is foreground, 1 background). No mask, or no such part, gives 0.

    A box takes four values of its mask's integral image, which it meets on image_id."""
    both = boxes.select("box_id", "image_id", *(F.col(c).cast("int").alias(c) for c in ("top", "bottom", "left", "right"))).join(integral(masks), "image_id", "left")
    inside = lambda c, most: F.least(F.greatest(F.col(c), F.lit(0)), F.col(most))
    top, bottom, left, right = inside("top", "height"), inside("bottom", "height"), inside("left", "width"), inside("right", "width")
    at = lambda y, x: F.get("sums", y * (F.col("width") + 1) + x)
    cells = (bottom - top) * (right - left)
    some = F.col("sums").isNotNull() & (bottom > top) & (right > left)
    return both.select("box_id", F.when(some, (at(bottom, right) - at(top, right) - at(bottom, left) + at(top, left)) / cells).otherwise(F.lit(0.0)).alias("ratio"))


def power_spectrum(images: DataFrame, data: str, height: int, width: int) -> DataFrame:
    """(image_id, ky, kx, power): the squared modulus of the discrete Fourier transform of each row's map, within the row."""

    def power(columns: pa.Array) -> pa.Array:
        x = columns.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, height, width)
        p = np.abs(np.fft.fft2(x)).reshape(len(x), -1) ** 2
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * height * width, pa.int32()), pa.array(p.ravel()))

    rows = images.select("image_id", F.posexplode(F.arrow_udf(power, "array<double>")(F.col(data))).alias("i", "power"))
    return rows.select("image_id", F.floor(F.col("i") / width).cast("int").alias("ky"), (F.col("i") % width).cast("int").alias("kx"), "power")


def radial_spectrum(spectrum: DataFrame, side: int) -> DataFrame:
    """(image_id, freq, power, n): power and coefficients by whole radius about the middle of the shifted spectrum, the first and the
    last radius left out, up to half the side; frequencies in cycles per pixel, from 0."""
    shifted = lambda c: (F.col(c) + side // 2) % side - (side - 1) / 2
    r = F.floor(F.sqrt(shifted("ky") * shifted("ky") + shifted("kx") * shifted("kx"))).cast("int")
    last = int(np.hypot((side - 1) / 2, (side - 1) / 2))
    rows = spectrum.withColumn("r", r).where((F.col("r") > 0) & (F.col("r") < last) & (F.col("r") <= side // 2))
    return rows.groupBy("image_id", "r").agg(F.sum("power").alias("power"), F.count("*").alias("n")).select("image_id", ((F.col("r") - 1) / side).alias("freq"), "power", "n")
