"""Shapes of maps, receptive fields and scales, as numbers and as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import Params


def output_side(side: Column, kwidth: Column | int, stride: Column | int) -> Column:
    """Side of a valid convolution's output: floor((side - kwidth + 1) / stride)."""
    return F.floor((side - kwidth + 1) / stride).cast("int")


def input_side(side: Column, kwidth: Column | int, stride: Column | int) -> Column:
    """The least input side that gives an output side."""
    return (side * stride + kwidth - 1).cast("int")


def receptive_field(p: Params, scale: Column, y: Column, x: Column, kwidth: int) -> dict[str, Column]:
    """The image box, in pixels, that an S2 unit sees: top, bottom, left and right, truncated to int."""
    step, reach = p.c1_sampling * p.s1_sampling, F.pow(F.lit(p.scale_factor), scale)
    low = lambda at: (at * step * reach).cast("int")
    high = lambda at: ((((at + kwidth) * p.c1_sampling + p.c1_kwidth - 1) * p.s1_sampling + p.s1_kwidth - 1) * reach).cast("int")
    return {"top": low(y), "bottom": high(y), "left": low(x), "right": high(x)}


def minimum_side(p: Params) -> int:
    """The least image side that gives one S2 unit at the coarsest kernel."""
    side = 1
    for kwidth, stride in ((max(p.s2_kwidth), p.s2_sampling), (p.c1_kwidth, p.c1_sampling), (p.s1_kwidth, p.s1_sampling)):
        side = side * stride + kwidth - 1
    return side + (p.retina_kwidth - 1 if p.retina_enabled else 0)


def scales_supported(p: Params, side: int) -> int:
    """How many scales fit an image side: while the least side, grown by the factor, is below it."""
    least, n = float(minimum_side(p)), 0
    while least < side:
        least, n = least * p.scale_factor, n + 1
        if p.scale_factor == 1:
            break
    return n


def scales_of(p: Params, side: Column, most: int = 64) -> Column:
    """scales_supported() of a column of sides, up to a number of scales."""
    if p.scale_factor == 1:
        return (side > minimum_side(p)).cast("int")
    grown = F.array(*(F.lit(minimum_side(p) * p.scale_factor**i) for i in range(most)))
    return F.size(F.filter(grown, lambda least: least < side))
