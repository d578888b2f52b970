"""The packed engine: whole maps as arrays in numpy, inside Arrow functions.

The long engine (filters, layers) expands windows into rows, which is right for small maps and for
SQL parity; this one keeps a map in one row (image_id, scale, shape, data) and is for real images.
Both compute the same values. From image to C2 nothing is shuffled: the fused stage maps each
image's row to its feature vector."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import images
from ..params import Params, Response
from ..plans.dag import Graph

ORDER = ("image", "retina", "s1", "c1", "s2", "c2")
MAPS = "image_id long, layer string, scale int, kwidth int, shape array<int>, data array<float>"


class InputSizeError(ValueError):
    """A map is smaller than a filter's window."""


def windows(x: np.ndarray, k: int, stride: int) -> np.ndarray:
    """(oy, ox, bands, k, k) views of a (bands, y, x) map."""
    oh, ow = (x.shape[1] - k + 1) // stride, (x.shape[2] - k + 1) // stride
    if oh < 1 or ow < 1:
        raise InputSizeError(f"a map of {x.shape[1]} x {x.shape[2]} is too small for a window of {k} by steps of {stride}")
    v = np.lib.stride_tricks.sliding_window_view(x, (k, k), axis=(1, 2))[:, ::stride, ::stride][:, :oh, :ow]
    return v.transpose(1, 2, 0, 3, 4)


def respond(x: np.ndarray, bank: np.ndarray, op: Response, stride: int = 1, bias: float = 0.01, beta: float = 1.0) -> np.ndarray:
    """(kernel, oy, ox); squared distances by |a|^2 + |b|^2 - 2ab, one matrix product for all windows."""
    w = windows(x, bank.shape[-1], stride)
    oh, ow = w.shape[:2]
    flat = np.ascontiguousarray(w).reshape(oh * ow, -1).astype(np.float64)
    taps = bank.reshape(len(bank), -1).astype(np.float64)
    product, energy = flat @ taps.T, (flat * flat).sum(axis=1, keepdims=True)
    if op is Response.RBF:
        product = np.exp(-beta * np.maximum(energy + (taps * taps).sum(axis=1) - 2 * product, 0))
    elif op is not Response.DOT:
        product = product / np.sqrt(np.maximum(energy, bias))
        if op is Response.NORM_RBF:
            product = np.exp(-2 * beta * (1 - product))
    if np.isnan(product).any():
        raise ValueError("a filter's response is not a number")
    return product.T.reshape(len(bank), oh, ow)


def contrast(x: np.ndarray, k: int, bias: float) -> np.ndarray:
    w = windows(x[None], k, 1).reshape(x.shape[0] - k + 1, x.shape[1] - k + 1, -1).astype(np.float64)
    return (w[..., (k // 2) * k + k // 2] - w.mean(axis=2)) / np.sqrt(w.var(axis=2, ddof=1) + bias)


def pool(x: np.ndarray, k: int, stride: int) -> np.ndarray:
    return windows(x, k, stride).max(axis=(3, 4)).transpose(2, 0, 1)


def whiten(x: np.ndarray) -> np.ndarray:
    x = x - x.mean(axis=0)
    return x / np.maximum(1, np.sqrt((x * x).sum(axis=0)))


def s1_of(image: np.ndarray, bank: np.ndarray, p: Params) -> np.ndarray:
    """bank: (orientation, phase, k, k). The normed dot product needs only the first phase, as its sign is dropped."""
    n, phases, k, _ = bank.shape
    if p.s1_operation is Response.NORM_DOT:
        return np.abs(respond(image[None], bank[:, :1], p.s1_operation, p.s1_sampling, p.s1_bias, p.s1_beta))
    out = respond(image[None], bank.reshape(n * phases, 1, k, k), p.s1_operation, p.s1_sampling, p.s1_bias, p.s1_beta)
    return out.reshape(n, phases, *out.shape[1:]).max(axis=1)


def layers_of(image: np.ndarray, p: Params, s1_bank: np.ndarray, s2_banks: list[np.ndarray] | None, wanted: set[str]) -> dict[str, list]:
    """The wanted layers of one grey image in [0, 1]; nothing above the highest of them is computed."""
    top = max(ORDER.index(w) for w in wanted)
    out: dict[str, list] = {"image": [(0, 0, image[None])]}
    retina = contrast(image, p.retina_kwidth, p.retina_bias) if p.retina_enabled else image
    out["retina"] = [(0, 0, retina[None])]
    if top >= 2:
        from ..functions.geometry import scales_supported

        scales = p.num_scales or scales_supported(p, min(retina.shape))
        levels = images.pyramid(retina, scales, 1 / p.scale_factor)
        out["s1"] = [(s, 0, s1_of(x, s1_bank, p)) for s, x in enumerate(levels)]
    if top >= 3:
        out["c1"] = [(s, 0, whiten(c) if p.c1_whiten else c) for s, _, x in out["s1"] for c in [pool(x, p.c1_kwidth, p.c1_sampling)]]
    if top >= 4:
        if not s2_banks:
            raise ValueError("S2 needs prototypes")
        out["s2"] = [(s, i, respond(x, b, p.s2_operation, p.s2_sampling, p.s2_bias, p.s2_beta)) for s, _, x in out["c1"] for i, b in enumerate(s2_banks)]
    if top >= 5:
        out["c2"] = [(0, i, np.max([x.max(axis=(1, 2)) for _, j, x in out["s2"] if i == j], axis=0)[:, None, None]) for i in range(len(s2_banks))]
    return out


def layers_above(x: np.ndarray, layer: str, scale: int, kwidth: int, p: Params, s2_banks: list[np.ndarray] | None, top: str) -> dict[str, list]:
    """What a map of S1, C1 or S2 of one scale gives by itself, up to a layer; of C2 the maxima of this scale."""
    out: dict[str, list] = {layer: [(scale, kwidth, x)]}
    upto = ORDER.index(top)
    if "s1" in out and upto >= 3:
        c = pool(x, p.c1_kwidth, p.c1_sampling)
        out["c1"] = [(scale, 0, whiten(c) if p.c1_whiten else c)]
    if "c1" in out and upto >= 4:
        if not s2_banks:
            raise ValueError("S2 needs prototypes")
        out["s2"] = [(scale, i, respond(out["c1"][0][2], b, p.s2_operation, p.s2_sampling, p.s2_bias, p.s2_beta)) for i, b in enumerate(s2_banks)]
    if "s2" in out and upto >= 5:
        out["c2"] = [(scale, i, m.max(axis=(1, 2))[:, None, None]) for _, i, m in out["s2"]]
    return out


class LayerError(RuntimeError):
    """A layer could not be computed; the message names the image, and the layer and scale it was made from."""


def _rows(owner: list[int], made: list[tuple], number: type, kind: pa.DataType) -> pa.RecordBatch:
    """Rows of MAPS of (layer, scale, kwidth, map)."""
    flat = [m[3].ravel().astype(number) for m in made]
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in flat])]), pa.int32()), pa.array(np.concatenate(flat), kind))
    return pa.RecordBatch.from_arrays(
        [pa.array(owner, pa.int64()), pa.array([m[0] for m in made]), pa.array([m[1] for m in made], pa.int32()), pa.array([m[2] for m in made], pa.int32()), pa.array([list(m[3].shape) for m in made], pa.list_(pa.int32())), lists],
        names=["image_id", "layer", "scale", "kwidth", "shape", "data"],
    )


def build(grey: DataFrame, p: Params, s1_bank: np.ndarray, s2_banks: list[np.ndarray] | None = None, wanted: tuple[str, ...] = ("c2",), precision: str = "float") -> DataFrame:
    """Rows of MAPS for the wanted layers of grey (image_id, height, width, data array<float>); precision is float or double."""
    keep = set(wanted)
    number, kind = (np.float64, pa.float64()) if precision == "double" else (np.float32, pa.float32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, height, width = (batch.column(k).to_pylist() for k in range(3))
            cells, ends = batch.column(3).flatten().to_numpy(zero_copy_only=False), np.cumsum(np.multiply(height, width))
            made, owner = [], []
            for k, (h, w) in enumerate(zip(height, width)):
                image = cells[ends[k] - h * w : ends[k]].astype(np.float32).reshape(h, w)
                try:
                    found = layers_of(image, p, s1_bank, s2_banks, keep)
                except ValueError as e:
                    raise LayerError(f"image {ids[k]}: {e}") from e
                some = [(name, *x) for name, layer in found.items() if name in keep for x in layer]
                made += some
                owner += [ids[k]] * len(some)
            if made:
                yield _rows(owner, made, number, kind)

    return grey.select("image_id", "height", "width", "data").mapInArrow(run, MAPS.replace("array<float>", f"array<{precision}>"))


def climb(maps: DataFrame, p: Params, s1_bank: np.ndarray | None = None, s2_banks: list[np.ndarray] | None = None, wanted: tuple[str, ...] = ("c2",), precision: str = "float") -> DataFrame:
    """Rows of MAPS for the wanted layers, from rows of MAPS of one stored layer that lies at or below them.

    From an image or retina on this is build(). S1, C1 and S2 are stored by scale, and each scale is worked on where its row is;
    only C2's maxima, a number for each prototype, meet by image."""
    if any(w not in ORDER for w in wanted):
        raise LookupError(f"no layer among {', '.join(ORDER)}: {', '.join(w for w in wanted if w not in ORDER)}")
    held = sorted((r["layer"] for r in maps.select("layer").distinct().collect()), key=ORDER.index)  # at most len(ORDER)
    if not held:
        return maps
    layer, top = held[-1], max(wanted, key=ORDER.index)
    if min(ORDER.index(w) for w in wanted) < ORDER.index(layer):
        raise LookupError(f"a layer below {layer} can't be made from it")
    maps = maps.where(F.col("layer") == layer)
    if layer in ("image", "retina"):
        grey = maps.select("image_id", F.col("shape")[1].alias("height"), F.col("shape")[2].alias("width"), "data")
        if layer == "retina":
            p = Params.from_dict(p.to_dict() | {"retina_enabled": False})
        made = build(grey, p, s1_bank, s2_banks, tuple("image" if w == layer else w for w in wanted), precision)
        return made.withColumn("layer", F.when(F.col("layer") == "image", F.lit(layer)).otherwise(F.col("layer")))
    number, kind = (np.float64, pa.float64()) if precision == "double" else (np.float32, pa.float32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, scale, kwidth = (batch.column(k).to_numpy(zero_copy_only=False).tolist() for k in range(3))
            shapes, cells = batch.column(3).to_pylist(), batch.column(4).flatten().to_numpy(zero_copy_only=False)
            ends, made, owner = np.cumsum([np.prod(x) for x in shapes]), [], []
            for k, shape in enumerate(shapes):
                x = cells[int(ends[k]) - int(np.prod(shape)) : int(ends[k])].reshape(shape).astype(np.float64 if precision == "double" else np.float32)
                try:
                    found = layers_above(x, layer, scale[k], kwidth[k], p, s2_banks, top)
                except ValueError as e:
                    raise LayerError(f"image {ids[k]}, {layer}, scale {scale[k]}: {e}") from e
                some = [(name, *y) for name in wanted for y in found.get(name, [])]
                made += some
                owner += [ids[k]] * len(some)
            if made:
                yield _rows(owner, made, number, kind)

    schema = MAPS.replace("array<float>", f"array<{precision}>")
    made = maps.select("image_id", "scale", "kwidth", "shape", "data").mapInArrow(run, schema)
    if "c2" not in wanted or layer == "c2":
        return made
    whole = made.where("layer = 'c2'").select("image_id", "kwidth", "shape", F.posexplode("data").alias("i", "v")).groupBy("image_id", "kwidth", "shape", "i").agg(F.max("v").alias("v"))
    whole = whole.groupBy("image_id", "kwidth", "shape").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda t: t["v"]).alias("data"))
    whole = whole.select("image_id", F.lit("c2").alias("layer"), F.lit(0).alias("scale"), "kwidth", "shape", "data")
    return whole if wanted == ("c2",) else made.where("layer <> 'c2'").unionByName(whole)


def graph(p: Params, s1_bank: np.ndarray, s2_banks: list[np.ndarray] | None = None, precision: str = "float") -> Graph:
    """The layers as a graph of tables of MAPS: a request starts from whatever layer its state holds."""
    out = Graph()

    def builder(name: str) -> Callable[[DataFrame], DataFrame]:
        return lambda maps: climb(maps, p, s1_bank, s2_banks, (name,), precision)

    for above, below in (("r", "i"), ("s1", "r"), ("c1", "s1"), ("s2", "c1"), ("c2", "s2")):
        out.register(above, (below,), builder({"r": "retina"}.get(above, above)))
    return out


def features(maps: DataFrame, layers: tuple[str, ...]) -> DataFrame:
    """(image_id, features array<double>): the layers' values in the order given, then scale and kernel width."""
    rank = F.array_position(F.array(*map(F.lit, layers)), F.col("layer"))
    rows = maps.where(F.col("layer").isin(*layers)).select("image_id", F.struct(rank.alias("rank"), "scale", "kwidth", "data").alias("part"))
    parts = F.array_sort(F.collect_list("part"))
    return rows.groupBy("image_id").agg(F.flatten(F.transform(parts, lambda x: x["data"])).cast("array<double>").alias("features"))
