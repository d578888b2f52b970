"""Object masks beside images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..params import Params
from . import images


def match_masks(files: DataFrame, masks: DataFrame) -> DataFrame:
    """(image_id, mask_path) of each image, null without a mask. files: image_id, class_name, path; masks: path.

    A mask has its image's stem, in a folder of the class's name or beside the classes. Of several, one in the
    class's folder wins, then the first path."""
    stem = lambda c: F.regexp_replace(F.element_at(F.split(c, "/"), -1), r"\.[^.]*$", "")
    found = masks.select(F.col("path").alias("mask_path"), stem(F.col("path")).alias("stem"), F.element_at(F.split("path", "/"), -2).alias("folder"))
    rows = files.select("image_id", "class_name", stem(F.col("path")).alias("stem")).join(found, "stem", "left")
    rank = F.struct(F.coalesce((F.col("folder") != F.col("class_name")).cast("int"), F.lit(2)), "mask_path")
    return rows.groupBy("image_id").agg(F.min_by("mask_path", rank).alias("mask_path"))


def candidate_names(path: Column) -> Column:
    """The names that the mask of an image file may have, the first choice first: its own, stem_mask with its extension, stem_mask.png and stem.png."""
    name = F.element_at(F.split(path, "/"), -1)
    stem, extension = F.regexp_replace(name, r"\.[^.]*$", ""), F.regexp_extract(name, r"\.[^.]*$", 0)
    return F.array(name, F.concat(stem, F.lit("_mask"), extension), F.concat(stem, F.lit("_mask.png")), F.concat(stem, F.lit(".png")))


def load_masks(spark: SparkSession, files: DataFrame, root: str, p: Params) -> DataFrame:
    """(image_id, path, height, width, data) of the images (image_id, class_name, path) that have a mask root/class/name: decoded, grey in
    [0, 1] (0 is foreground) and resized as images are. Of several names the first choice is taken."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "[!.]*").load(f"{root}/*").select(F.col("path").alias("mask_path"))
    found = found.select("mask_path", F.element_at(F.split("mask_path", "/"), -2).alias("class_name"), F.element_at(F.split("mask_path", "/"), -1).alias("name"))
    named = files.select("image_id", "class_name", F.posexplode(candidate_names(F.col("path"))).alias("turn", "name"))
    first = named.join(found, ["class_name", "name"]).groupBy("image_id").agg(F.min_by("mask_path", "turn").alias("path"))
    return images.load_grey(spark, first, root, p)
