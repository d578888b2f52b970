"""Tables and map sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.filters import unpack


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def vector_maps(vectors: DataFrame, bands: int, height: int, width: int, key: str = "vec_id", data: str = "embedding") -> DataFrame:
    """Cells of vectors that are read as bands x height x width maps."""
    return unpack(vectors, F.col(data), bands, height, width, F.col(key))


def mixed_text(spark: SparkSession, path: str, separator: str = " ") -> DataFrame:
    """(fields): the fields of each line, as struct of number (null if a field isn't one) and text."""
    field = lambda x: F.struct(x.try_cast("double").alias("number"), x.alias("text"))
    return spark.read.text(path).select(F.transform(F.split(F.trim("value"), F.lit(f"\\Q{separator}\\E")), field).alias("fields"))


def bar_data(spark: SparkSession, path: str) -> DataFrame:
    """(name, value, at) of lines of a name and a number; at is the line's place within its file."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("at", "line")).where(F.trim("line") != "")
    parts = F.split(F.trim("line"), r"\s+")
    return rows.select(parts[0].alias("name"), parts[1].cast("double").alias("value"), "at")


def store_as(df: DataFrame, path: str, encoding: str = "parquet") -> None:
    """A table as Parquet, as lines of fields separated by blanks, or as text of one JSON object a line."""
    if encoding == "parquet":
        df.write.parquet(path)
    elif encoding == "csv":
        df.select(F.concat_ws(" ", *(F.col(c).cast("string") for c in df.columns))).write.text(path)
    elif encoding == "text":
        df.select(F.to_json(F.struct(*df.columns))).write.text(path)
    else:
        raise ValueError(f"no encoding {encoding}")


def numeric_text(spark: SparkSession, path: str, columns: int) -> DataFrame:
    """White-space separated numbers, one row for each line, as doubles c0, c1 and so on; other lines are an error."""
    parts = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("p")).where("p[0] <> ''")
    fits = F.assert_true(F.size("p") == columns, F.lit(f"a line hasn't {columns} columns"))
    return parts.where(F.isnull(fits)).select(*(F.col("p")[i].cast("double").alias(f"c{i}") for i in range(columns)))
