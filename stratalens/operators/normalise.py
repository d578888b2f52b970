"""Normalisers of patches: rows (patch_id, pos, v)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _patch():
    return Window.partitionBy("patch_id")



def unit_norm(patches: DataFrame) -> DataFrame:
    """Each patch over its norm; one of zeros becomes 1 / sqrt(n) throughout."""
    rows = patches.withColumn("_n", F.sqrt(F.sum(F.col("v") * F.col("v")).over(_patch()))).withColumn("_c", F.count("*").over(_patch()))
    return rows.select("patch_id", "pos", F.when(F.col("_n") == 0, 1 / F.sqrt("_c")).otherwise(F.col("v") / F.col("_n")).alias("v"))


def length(patches: DataFrame, epsilon: float = 0.0) -> DataFrame:
    return patches.withColumn("v", F.col("v") / (F.sqrt(F.sum(F.col("v") * F.col("v")).over(_patch())) + epsilon))


def local_contrast(patches: DataFrame, epsilon: float = 10.0) -> DataFrame:
    """Each patch less its mean, over sqrt(its population variance + epsilon)."""
    return patches.withColumn("v", (F.col("v") - F.avg("v").over(_patch())) / F.sqrt(F.var_pop("v").over(_patch()) + epsilon))


def global_contrast(patches: DataFrame, fitted: DataFrame | None = None, epsilon: float = 0.0) -> DataFrame:
    """Each position less its mean over all patches, over its population deviation; fitted has (pos, mean, std)."""
    fitted = contrast_fit(patches) if fitted is None else fitted
    return patches.join(fitted, "pos").select("patch_id", "pos", ((F.col("v") - F.col("mean")) / (F.col("std") + epsilon)).alias("v"))


def contrast_fit(patches: DataFrame) -> DataFrame:
    return patches.groupBy("pos").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))


def global_contrast_inverse(patches: DataFrame, fitted: DataFrame, epsilon: float = 0.0) -> DataFrame:
    return patches.join(fitted, "pos").select("patch_id", "pos", (F.col("v") * (F.col("std") + epsilon) + F.col("mean")).alias("v"))
