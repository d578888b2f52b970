"""Image corpora in directories, and sinks of features, reports and stores."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import images
from ..operators import corpus
from ..params import Params

#: Characters of a path that tell the parts of a class apart.
PART = 3
GREY = "image_id long, path string, height int, width int, data array<float>"


class InputLoadError(OSError):
    """A file isn't an image that can be read."""


def read_corpus(spark: SparkSession, root: str, classes: list[str] | None = None) -> DataFrame:
    """(image_id, path, class_name, label) of root/class/file; classes are sorted, or given in order. Hidden files are left out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "[!._]*").load(f"{root}/*").select("path")
    files = files.withColumn("class_name", F.element_at(F.split("path", "/"), -2))
    found = corpus.scan(files, "class_name", "path") if classes is None else corpus.scan_given(files, classes, "class_name", "path")
    # paths of a class differ after what its first and last have in common; a class is numbered part by part of the next characters
    ends = {r["label"]: os.path.commonprefix([r["a"], r["b"]]) for r in found.groupBy("label").agg(F.min("path").alias("a"), F.max("path").alias("b")).collect()}  # the classes
    common = F.create_map(*(F.lit(x) for k, p in (ends or {0: ""}).items() for x in (k, len(p))))[F.col("label")]
    found = found.withColumn("_part", F.substr("path", common + 1, F.lit(PART)))
    counts = found.groupBy("label", "_part").agg(F.count("*").alias("_n"))
    within = F.sum("_n").over(Window.partitionBy("label").orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    counts = counts.withColumn("_before", within)
    sizes = {r["label"]: r["n"] for r in counts.groupBy("label").agg(F.sum("_n").alias("n")).collect()}  # the classes
    before = {k: sum(n for j, n in sizes.items() if j < k) for k in sizes} or {0: 0}
    first = F.create_map(*(F.lit(x) for k, n in before.items() for x in (k, n)))[F.col("label")]
    turn = F.row_number().over(Window.partitionBy("label", "_part").orderBy("path"))
    both = found.join(counts.drop("_n"), ["label", "_part"])
    return both.withColumn("image_id", (first + F.col("_before") + turn - 1).cast("long")).select("image_id", "path", "class_name", "label")


def load_grey(spark: SparkSession, files: DataFrame, root: str, p: Params) -> DataFrame:
    """Rows of GREY: the corpus's images, grey, resized by the parameters."""
    found = spark.read.format("image").option("dropInvalid", False).load(f"{root}/*").select("image.*").withColumnRenamed("origin", "path")
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    rows = files.select("image_id", plain(F.col("path")).alias("path")).join(found.withColumn("path", plain(F.col("path"))), "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                if r["nChannels"] < 1 or not r["data"]:
                    raise InputLoadError(f"can't read {r['path']}")
                x = images.prepare(images.grey(r["data"], r["height"], r["width"], r["nChannels"]), p)
                yield pa.RecordBatch.from_arrays([pa.array([r["image_id"]], pa.int64()), pa.array([r["path"]]), pa.array([x.shape[0]], pa.int32()), pa.array([x.shape[1]], pa.int32()), pa.array([x.ravel().astype(np.float32)], pa.list_(pa.float32()))], names=["image_id", "path", "height", "width", "data"])

    return rows.select("image_id", "path", "height", "width", "nChannels", "data").mapInArrow(run, GREY)


def write_svmlight(features: DataFrame, path: str, label: str = "label") -> None:
    """Labels from 1 and 1-based indices, in Spark's libsvm format."""
    from pyspark.ml.functions import array_to_vector

    rows = features.select((F.col(label) + 1).cast("double").alias("label"), array_to_vector("features").alias("features"))
    size = features.select(F.size("features")).first()
    rows.write.format("libsvm").option("numFeatures", size[0] if size else 0).mode("overwrite").save(path)


def svmlight_split(features: DataFrame, train: str, test: str, label: str = "label") -> list[tuple[int, str]]:
    """Training and test rows (is_train) in files of their own; returns the legend, (number, class_name) as written."""
    write_svmlight(features.where("is_train"), train, label)
    write_svmlight(features.where("not is_train"), test, label)
    return sorted((r[label] + 1, r["class_name"]) for r in features.select(label, "class_name").distinct().collect())  # the classes


def store_experiment(path: str, params: Params, more: str = "{}", **tables: DataFrame) -> None:
    """An experiment as a folder of Parquet tables and a row of JSON parameters."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    spark.createDataFrame([(json.dumps(params.to_dict()), ",".join(tables), more)], "params string, tables string, more string").write.mode("overwrite").json(f"{path}/_experiment")


def load_experiment(spark: SparkSession, path: str) -> tuple[Params, dict[str, DataFrame], str | None]:
    """Parameters, tables and what else was stored, as JSON."""
    row = spark.read.schema("params string, tables string, more string").json(f"{path}/_experiment").first()
    return Params.from_dict(json.loads(row["params"])), {t: spark.read.parquet(f"{path}/{t}") for t in row["tables"].split(",")}, row["more"]
