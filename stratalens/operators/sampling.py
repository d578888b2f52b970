"""Patches of maps at given or drawn places."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..params import Params
from . import packed
from .filters import IMAGE


def patches_at(cells: DataFrame, y0: Column, x0: Column, side: int) -> DataFrame:
    """(image_id, scale, band, y0, x0, y, x, v): of each map the side x side patch at a place of its own."""
    rows = cells.withColumn("y0", y0).withColumn("x0", x0)
    y, x = F.col("y") - F.col("y0"), F.col("x") - F.col("x0")
    return rows.where((y >= 0) & (y < side) & (x >= 0) & (x < side)).select(*IMAGE, "band", "y0", "x0", y.alias("y"), x.alias("x"), "v")


def patches_of(grey: DataFrame, images: DataFrame, n: int, p: Params, s1_bank: np.ndarray, seed: int) -> DataFrame:
    """(patch_id, kwidth, image_id, scale, y0, x0, data): n patches of each width of p.s2_kwidth from the C1 maps of images.

    With fewer patches than images, n images give one each; otherwise each image gives ceil(n / images), of which n
    stay, the same for all widths. Which images give patches is settled first, and only those are computed. A patch's scale is
    drawn evenly among its own image's maps that hold every width, its place as a fraction of the map."""
    count = images.count()
    if n < 1 or not count:
        raise ValueError("patches need a number and images")
    each = max(1, -(-n // count))
    key = F.xxhash64(F.lit(seed), F.col("image_id"), F.col("_copy"))
    rows = images.select("image_id", F.explode(F.sequence(F.lit(1), F.lit(each))).alias("_copy")).select("image_id", key.alias("key"))
    rows = rows.orderBy("key", "image_id").limit(n).groupBy("image_id").agg(F.array_sort(F.collect_list("key")).alias("keys"))
    widths, largest = list(p.s2_kwidth), max(p.s2_kwidth)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            named = batch.drop_columns(["data"]).to_pylist()  # the maps' values stay in Arrow's buffers
            cells, at = batch.column("data").flatten().to_numpy(zero_copy_only=False), 0
            for r in named:
                image = cells[at : at + r["height"] * r["width"]].astype(np.float32).reshape(r["height"], r["width"])
                at += image.size
                maps = [(s, x) for s, _, x in packed.layers_of(image, p, s1_bank, None, {"c1"})["c1"] if min(x.shape[1:]) >= largest]
                if not maps:
                    raise packed.LayerError(f"image {r['image_id']}: no C1 map holds a patch of {largest}")
                out = []
                for k in r["keys"]:
                    draw = np.random.default_rng([k % (1 << 63), seed % (1 << 63)])
                    scale, c1 = maps[draw.integers(len(maps))]
                    share = draw.random(2)
                    for w in widths:
                        y, x = (int(u * (side - w + 1)) for u, side in zip(share, c1.shape[1:]))
                        out.append((k, w, r["image_id"], scale, y, x, c1[:, y : y + w, x : x + w].ravel().astype(np.float32)))
                ids, kw, image_id, scale, y, x, data = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(kw, pa.int32()), pa.array(image_id, pa.int64()), pa.array(scale, pa.int32()), pa.array(y, pa.int32()), pa.array(x, pa.int32()), pa.array(data, pa.list_(pa.float32()))], names=["patch_id", "kwidth", "image_id", "scale", "y0", "x0", "data"])

    drawn = grey.select("image_id", "height", "width", "data").join(rows, "image_id")
    return drawn.mapInArrow(run, "patch_id long, kwidth int, image_id long, scale int, y0 int, x0 int, data array<float>")


def draw(images: DataFrame, key: str, n: int, sides: dict[int, tuple[int, int]], kwidth: int, seed: int) -> DataFrame:
    """(patch_id, key, scale, y0, x0): n places for patches, drawn by hashes before any layer is computed.

    With fewer patches than images, n images get one each; otherwise each image gets
    ceil(n / images), of which n stay. Scales are drawn evenly among those that fit, then places; bounds are inclusive."""
    fitting = {s: (h, w) for s, (h, w) in sides.items() if h >= kwidth and w >= kwidth}
    if not fitting:
        raise ValueError("no scale is as large as a patch")
    count = images.count()
    each = max(1, -(-n // max(count, 1)))
    h = lambda salt, of: F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), F.col(key), F.col("_copy")), of)
    rows = images.select(key).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(each))))
    spots = F.array(*(F.struct(F.lit(s).alias("scale"), F.lit(a - kwidth + 1).alias("h"), F.lit(b - kwidth + 1).alias("w")) for s, (a, b) in sorted(fitting.items())))
    rows = rows.withColumn("_s", F.element_at(spots, h(1, F.lit(len(fitting))).cast("int") + 1))
    rows = rows.orderBy(F.xxhash64(F.lit(seed), F.lit(0), F.col(key), F.col("_copy")), key, "_copy").limit(n)
    return rows.select(F.xxhash64(F.col(key), "_copy").alias("patch_id"), key, F.col("_s.scale").alias("scale"), h(2, F.col("_s.h")).cast("int").alias("y0"), h(3, F.col("_s.w")).cast("int").alias("x0"))
