"""Model layers over cells: retina, S1, C1, S2 and C2."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..params import Params, Response
from . import filters as K


def retina(cells: DataFrame, p: Params, height: int, width: int) -> DataFrame:
    return K.contrast_enhance(cells, p.retina_kwidth, height, width, p.retina_bias) if p.retina_enabled else cells


def respond(cells: DataFrame, kernels: DataFrame, op: Response, kwidth: int, height: int, width: int, stride: int, bias: float, beta: float) -> DataFrame:
    if op is Response.DOT:
        return K.dot(cells, kernels, kwidth, height, width, stride)
    if op is Response.NORM_DOT:
        return K.norm_dot(cells, kernels, kwidth, height, width, stride, bias)
    if op is Response.RBF:
        return K.rbf(cells, kernels, kwidth, height, width, stride, beta)
    return K.norm_rbf(cells, kernels, kwidth, height, width, stride, bias, beta)


def pool_phases(cells: DataFrame, phases: int) -> DataFrame:
    """The maximum over the phases of an orientation; bands are orientation * phases + phase."""
    by = [*K.IMAGE, F.expr(f"cast(band div {phases} as int)").alias("band"), "y", "x"]
    return cells.groupBy(*by).agg(F.max("v").alias("v"))


def s1(cells: DataFrame, kernels: DataFrame, p: Params, height: int, width: int) -> DataFrame:
    """Kernels of all phases, or for the normed dot product those of the first phase, whose sign is dropped."""
    out = respond(cells, kernels, p.s1_operation, p.s1_kwidth, height, width, p.s1_sampling, p.s1_bias, p.s1_beta)
    if p.s1_operation is Response.NORM_DOT:
        return out.withColumn("v", F.abs("v"))
    return pool_phases(out, p.s1_num_phases)


def whiten(cells: DataFrame) -> DataFrame:
    """At each place, bands less their mean, over their norm where that is above 1."""
    place = Window.partitionBy(*K.IMAGE, "y", "x")
    out = cells.withColumn("v", F.col("v") - F.avg("v").over(place))
    return out.withColumn("v", F.col("v") / F.greatest(F.lit(1.0), F.sqrt(F.sum(F.col("v") * F.col("v")).over(place))))


def c1(cells: DataFrame, p: Params, height: int, width: int) -> DataFrame:
    out = K.local_max(cells, p.c1_kwidth, height, width, p.c1_sampling)
    return whiten(out) if p.c1_whiten else out


def s2(cells: DataFrame, kernels: DataFrame | None, p: Params, height: int, width: int, kwidth: int) -> DataFrame:
    if kernels is None:
        raise ValueError("S2 needs prototypes")
    return respond(cells, kernels, p.s2_operation, kwidth, height, width, p.s2_sampling, p.s2_bias, p.s2_beta)


def c2(cells: DataFrame) -> DataFrame:
    """The maximum of each prototype over place and scale."""
    return cells.groupBy("image_id", "band").agg(F.max("v").alias("v"))
