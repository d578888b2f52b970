"""Local filters over cells, as joins and aggregates.

Cells are rows (image_id, scale, band, y, x, v). unpack() deals whole images out once, by
image_id, before it makes cells of them; every later aggregate groups by image_id and more, so
no filter shuffles again. Windows are valid (no border), kernels aren't flipped, and with stride s an output cell
stands at (y div s, x div s) of its window's corner, below floor((side - k + 1) / s)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IMAGE = ("image_id", "scale")


def unpack(maps: DataFrame, data: Column, bands: int, height: int, width: int, image_id: Column, scale: Column | None = None) -> DataFrame:
    """Cells of row-major arrays of bands x height x width."""
    rows = maps.select(image_id.alias("image_id"), (F.lit(0) if scale is None else scale).cast("int").alias("scale"), data.alias("_data")).repartition("image_id")
    cells = rows.select(*IMAGE, F.posexplode("_data").alias("i", "v"))
    at = F.col("i")
    return cells.select(*IMAGE, F.expr(f"cast(i div {height * width} as int)").alias("band"), F.expr(f"cast(i div {width} % {height} as int)").alias("y"), (at % width).cast("int").alias("x"), F.col("v").cast("double").alias("v")).where(F.col("band") < bands)


def pack(cells: DataFrame) -> DataFrame:
    """(image_id, scale, data): each image's values in order of band, y, x."""
    ordered = F.array_sort(F.collect_list(F.struct("band", "y", "x", "v")))
    return cells.groupBy(*IMAGE).agg(F.transform(ordered, lambda c: c["v"]).alias("data"))


def _placed(cells: DataFrame, kwidth: int, stride: int, height: int, width: int) -> DataFrame:
    """A row for each cell and tap (ky, kx) whose window is valid, at the output cell (oy, ox)."""
    taps = F.explode(F.sequence(F.lit(0), F.lit(kwidth - 1)))
    out = cells.withColumn("ky", taps).withColumn("cy", F.col("y") - F.col("ky"))
    out = out.where((F.col("cy") >= 0) & (F.col("cy") % stride == 0) & (F.col("cy") < (height - kwidth + 1) // stride * stride))
    out = out.withColumn("kx", taps).withColumn("cx", F.col("x") - F.col("kx"))
    out = out.where((F.col("cx") >= 0) & (F.col("cx") % stride == 0) & (F.col("cx") < (width - kwidth + 1) // stride * stride))
    return out.withColumn("oy", F.expr(f"cast(cy div {stride} as int)")).withColumn("ox", F.expr(f"cast(cx div {stride} as int)"))


def _responses(cells: DataFrame, kernels: DataFrame, kwidth: int, stride: int, height: int, width: int, value: Column) -> DataFrame:
    taps = _placed(cells, kwidth, stride, height, width).join(F.broadcast(kernels), ["band", "ky", "kx"])
    out = taps.groupBy(*IMAGE, "kernel", "oy", "ox").agg(value.alias("v"))
    return out.select(*IMAGE, F.col("kernel").alias("band"), F.col("oy").alias("y"), F.col("ox").alias("x"), "v")


def dot(cells: DataFrame, kernels: DataFrame, kwidth: int, height: int, width: int, stride: int = 1) -> DataFrame:
    """Sum of products."""
    return _responses(cells, kernels, kwidth, stride, height, width, F.sum(F.col("w") * F.col("v")))


def norm_dot(cells: DataFrame, kernels: DataFrame, kwidth: int, height: int, width: int, stride: int = 1, bias: float = 0.01) -> DataFrame:
    """Sum of products over the window's norm, its square at least bias; kernels have norm 1."""
    return _responses(cells, kernels, kwidth, stride, height, width, F.sum(F.col("w") * F.col("v")) / F.sqrt(F.greatest(F.sum(F.col("v") * F.col("v")), F.lit(bias))))


def correlate(cells: DataFrame, kernels: DataFrame, kwidth: int, height: int, width: int) -> DataFrame:
    """Sum of products over all bands, of the map's own size: beyond the border it is mirrored, its edge repeated."""
    h = kwidth // 2

    def mirrored(c: str, side: int) -> Column:
        at = F.array(F.col(c), F.when(F.col(c) < h, -1 - F.col(c)), F.when(F.col(c) >= side - h, 2 * side - 1 - F.col(c)))
        return F.explode(F.transform(F.array_compact(at), lambda v: v + h))

    wide = cells.withColumn("y", mirrored("y", height)).withColumn("x", mirrored("x", width))
    return dot(wide, kernels, kwidth, height + 2 * h, width + 2 * h)


def rbf(cells: DataFrame, kernels: DataFrame, kwidth: int, height: int, width: int, stride: int = 1, beta: float = 5.0) -> DataFrame:
    """Gaussian of the distance of window and kernel."""
    gap = F.col("w") - F.col("v")
    return _responses(cells, kernels, kwidth, stride, height, width, F.exp(-beta * F.sum(gap * gap)))


def norm_rbf(cells: DataFrame, kernels: DataFrame, kwidth: int, height: int, width: int, stride: int = 1, bias: float = 0.1, beta: float = 5.0) -> DataFrame:
    """Gaussian of the distance of normed window and kernel, by their normed dot product."""
    return norm_dot(cells, kernels, kwidth, height, width, stride, bias).withColumn("v", F.exp(-2 * beta * (1 - F.col("v"))))


def contrast_enhance(cells: DataFrame, kwidth: int, height: int, width: int, bias: float = 1.0) -> DataFrame:
    """Each window's centre less its mean, over sqrt(sample variance + bias)."""
    centre = F.max(F.when((F.col("ky") == kwidth // 2) & (F.col("kx") == kwidth // 2), F.col("v")))
    taps = _placed(cells, kwidth, 1, height, width)
    out = taps.groupBy(*IMAGE, "band", "oy", "ox").agg(((centre - F.avg("v")) / F.sqrt(F.var_samp("v") + bias)).alias("v"))
    return out.select(*IMAGE, "band", F.col("oy").alias("y"), F.col("ox").alias("x"), "v")


def local_max(cells: DataFrame, kwidth: int, height: int, width: int, stride: int = 1) -> DataFrame:
    """The maximum of each window of a band."""
    out = _placed(cells, kwidth, stride, height, width).groupBy(*IMAGE, "band", "oy", "ox").agg(F.max("v").alias("v"))
    return out.select(*IMAGE, "band", F.col("oy").alias("y"), F.col("ox").alias("x"), "v")


def global_max(cells: DataFrame) -> DataFrame:
    return cells.groupBy(*IMAGE, "band").agg(F.max("v").alias("v"))


def prune(cells: DataFrame, kwidth: int, height: int, width: int, stride: int = 1) -> DataFrame:
    """Cells at the centres of valid windows, by stride."""
    h = kwidth // 2
    y, x = F.col("y") - h, F.col("x") - h
    inside = (y >= 0) & (y <= height - kwidth) & (y % stride == 0) & (x >= 0) & (x <= width - kwidth) & (x % stride == 0)
    return cells.where(inside).select(*IMAGE, "band", F.expr(f"cast((y - {h}) div {stride} as int)").alias("y"), F.expr(f"cast((x - {h}) div {stride} as int)").alias("x"), "v")


def pad(cells: DataFrame, height: int, width: int, new_height: int, new_width: int, value: float = 0.0) -> DataFrame:
    """Centred in a larger map that is filled with a value."""
    if new_height < height or new_width < width:
        raise ValueError("a map can't be padded to a smaller one")
    top, left = (new_height - height) // 2, (new_width - width) // 2
    held = cells.groupBy(*IMAGE, "band").agg(F.map_from_entries(F.collect_list(F.struct((F.col("y") + top) * new_width + F.col("x") + left, "v"))).alias("held"))
    grid = held.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(new_height * new_width - 1))))
    return grid.select(*IMAGE, "band", F.expr(f"cast(i div {new_width} as int)").alias("y"), (F.col("i") % new_width).cast("int").alias("x"), F.coalesce(F.try_element_at("held", F.col("i")), F.lit(value)).alias("v"))


def crop(cells: DataFrame, height: int, width: int, new_height: int, new_width: int) -> DataFrame:
    """The central part."""
    top, left = (height - new_height) // 2, (width - new_width) // 2
    y, x = F.col("y") - top, F.col("x") - left
    return cells.where((y >= 0) & (y < new_height) & (x >= 0) & (x < new_width)).select(*IMAGE, "band", y.alias("y"), x.alias("x"), "v")


def tile(cells: DataFrame, side: int, height: int, width: int) -> DataFrame:
    """Non-overlapping tiles; those that the border cuts are left out."""
    inside = (F.col("y") < height // side * side) & (F.col("x") < width // side * side)
    div = lambda c: F.expr(f"cast({c} div {side} as int)")
    return cells.where(inside).select(*IMAGE, "band", div("y").alias("ty"), div("x").alias("tx"), (F.col("y") % side).alias("y"), (F.col("x") % side).alias("x"), "v")


def untile(tiles: DataFrame, side: int) -> DataFrame:
    return tiles.select(*IMAGE, "band", (F.col("ty") * side + F.col("y")).alias("y"), (F.col("tx") * side + F.col("x")).alias("x"), "v")


def flatten(cells: DataFrame) -> DataFrame:
    """(image_id, features): values in order of scale, band, y, x."""
    ordered = F.array_sort(F.collect_list(F.struct("scale", "band", "y", "x", "v")))
    return cells.groupBy("image_id").agg(F.transform(ordered, lambda c: c["v"]).alias("features"))
