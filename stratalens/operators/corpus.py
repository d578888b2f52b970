"""Corpora as DataFrames: labels, balance, splits and folds.

Choices within a class go by a key's digest rather than by a random draw, so that they are
repeatable on any partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import analysis


#: Classes whose table of labels is broadcast, and rows a class that Spark limits within each task before it deals them by class.
FEW_CLASSES, FEW_ROWS = 10_000, 1000


def scan(files: DataFrame, class_name: str, path: str) -> DataFrame:
    """(path, class_name, label): labels are 0-based ranks of class names, joined from the small table of classes."""
    names = [r[0] for r in files.groupBy(class_name).agg(F.lit(1)).collect()]  # the classes
    if None in names:
        raise ValueError("files without a class")
    labels = files.sparkSession.createDataFrame([(n, k) for k, n in enumerate(sorted(names))], "class_name string, label int")
    labels = F.broadcast(labels) if len(names) <= FEW_CLASSES else labels
    return files.select(F.col(path).alias("path"), F.col(class_name).alias("class_name")).join(labels, "class_name").select("path", "class_name", "label")


def scan_given(files: DataFrame, order: list[str], class_name: str, path: str) -> DataFrame:
    """As scan(), with classes and their order given; files of other classes are left out, a class without files is an error."""
    spark = files.sparkSession
    labels = spark.createDataFrame(list(enumerate(order)), "label int, class_name string")
    found = files.select(F.col(path).alias("path"), F.col(class_name).alias("class_name")).join(labels, "class_name")
    if empty := [r[0] for r in labels.join(found, "class_name", "left_anti").select("class_name").collect()]:
        raise ValueError(f"classes without files: {empty}")
    return found.select("path", "class_name", "label")


def join_split(train: DataFrame, test: DataFrame) -> DataFrame:
    """Train rows and test rows of corpora with the same classes, with is_train."""
    a, b = (x.select("class_name").distinct() for x in (train, test))
    if not a.exceptAll(b).isEmpty() or not b.exceptAll(a).isEmpty():
        raise ValueError("train and test have different classes")
    return train.withColumn("is_train", F.lit(True)).unionByName(test.withColumn("is_train", F.lit(False)))


_PARTS = 3


def _ranked(rows: DataFrame, label: str, key: str, digest: bool) -> DataFrame:
    """rows with _rank (from 1) and _count within their class, in order of the key or of its digest.

    Ranks are taken within a part of a class, a range of keys or digests, after the counts of the parts before; so a
    window holds such a part, not a class."""
    if digest:
        order, part = [F.md5(F.col(key).cast("string")), F.col(key)], F.substring(F.md5(F.col(key).cast("string")), 1, _PARTS)
    else:
        numeric = dict(rows.dtypes)[key] != "string"
        order, part = [F.col(key)], analysis.ranges(rows, key) if numeric else F.substring(F.col(key), 1, _PARTS)
    rows = rows.withColumn("_part", part)
    counts = rows.groupBy(label, "_part").agg(F.count("*").alias("_n"))
    by = Window.partitionBy(label)
    counts = counts.withColumn("_count", F.sum("_n").over(by)).withColumn("_before", F.sum("_n").over(by.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n"))
    turn = F.row_number().over(Window.partitionBy(label, "_part").orderBy(*order))
    return rows.join(counts.drop("_n"), [label, "_part"]).withColumn("_rank", turn + F.col("_before")).drop("_part", "_before")


def balance(rows: DataFrame, label: str, key: str, shuffle: bool = False) -> DataFrame:
    """The first rows of each class, or its first by digest, as many as the smallest class has."""
    least = rows.groupBy(label).count().agg(F.min("count")).first()[0] or 0
    if least <= FEW_ROWS:
        order = [F.md5(F.col(key).cast("string")), F.col(key)] if shuffle else [F.col(key)]
        turn = F.row_number().over(Window.partitionBy(label).orderBy(*order))
        return rows.withColumn("_rank", turn).where(F.col("_rank") <= least).select(rows.columns)
    return _ranked(rows, label, key, shuffle).where(F.col("_rank") <= least).select(rows.columns)


def choose_training(rows: DataFrame, label: str, key: str, size: float) -> DataFrame:
    """Adds is_train: by class floor(size * count) rows for a size below 1, else size rows at most. With a share, each class
    needs two rows, so that it has rows of both kinds."""
    if size < 0:
        raise ValueError("size must not be negative")
    if size < 1 and (r := rows.groupBy(label).count().where("count < 2").first()) is not None:
        raise ValueError(f"class {r[0]} has one row only")
    n = F.floor(F.lit(float(size)) * F.col("_count") + 1e-9) if size < 1 else F.lit(int(size))
    return _ranked(rows, label, key, True).select(*rows.columns, (F.col("_rank") <= n).alias("is_train"))


def folds(rows: DataFrame, label: str, key: str, k: int = 10) -> DataFrame:
    """Adds fold: stratified, dealt in turn within each class."""
    return _ranked(rows, label, key, True).select(*rows.columns, ((F.col("_rank") - 1) % k).cast("int").alias("fold"))


def relabel_binary(rows: DataFrame, label: str) -> DataFrame:
    """With just two labels other than 0 and 1, the smaller becomes 0 and the other 1."""
    seen = sorted(r[0] for r in rows.select(label).distinct().limit(3).collect())
    if len(seen) != 2 or seen == [0, 1]:
        return rows
    return rows.withColumn(label, F.when(F.col(label) == seen[0], 0).otherwise(1))


def label_names(rows: DataFrame, names: list[str], label: str = "label") -> DataFrame:
    return rows.withColumn("class_name", F.element_at(F.array(*map(F.lit, names)), F.col(label) + 1))
