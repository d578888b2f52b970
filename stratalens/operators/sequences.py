"""Ordered rows: differences, running averages, groups of equal length, comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from . import analysis


#: Ranges of an ordered column at most, in which windows are taken.
RANGES = 4096


def _ranged(rows: DataFrame, by: str, order: str, part: Column) -> tuple[DataFrame, DataFrame, WindowSpec]:
    """(by, _range, part) of each range of a group, the rows with their _range, and the window of a group's rows within a range.

    Groups are worked on range by range of the order's values, so that no task takes a whole group; what a range needs
    of those before it comes from windows over the parts, of which a group has RANGES at most. The order is numeric."""
    rows = rows.withColumn("_range", analysis.ranges(rows, order, RANGES))
    parts = rows.groupBy(by, "_range").agg(part)
    return parts, rows, Window.partitionBy(by, "_range").orderBy(order)


def differences(rows: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """Each row's value less the one before it in its group; the first row of a group goes."""
    parts, rows, inside = _ranged(rows, by, order, F.max_by(value, order).alias("_last"))
    parts = parts.withColumn("_last", F.lag("_last").over(Window.partitionBy(by).orderBy("_range")))
    both = rows.join(parts, [by, "_range"])
    before = F.coalesce(F.lag(value).over(inside), F.col("_last"))
    return both.withColumn("difference", F.col(value) - before).where("difference is not null").drop("_range", "_last")


def running_total(rows: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """The sum of a group's values up to each row."""
    parts, rows, inside = _ranged(rows, by, order, F.sum(value).alias("_sum"))
    parts = parts.withColumn("_sum", F.sum("_sum").over(Window.partitionBy(by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)))
    here = F.sum(value).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    return rows.join(parts, [by, "_range"]).withColumn("total", here + F.coalesce("_sum", F.lit(0))).drop("_range", "_sum")


def moving_average(values: Column, alpha: float) -> Column:
    """Exponentially weighted averages of an array, the first of which is its first value."""
    start = F.struct(F.get(values, F.lit(0)).alias("now"), F.slice(values, 1, 1).alias("all"))

    def step(s: Column, v: Column) -> Column:
        now = s["now"] * (1 - alpha) + v * alpha
        return F.struct(now.alias("now"), F.concat(s["all"], F.array(now)).alias("all"))

    rest = F.slice(values, F.lit(2), F.greatest(F.size(values) - 1, F.lit(0)))
    return F.when(F.size(values) > 0, F.aggregate(rest, start, step)["all"]).otherwise(values)


def groups(rows: DataFrame, by: str, order: str, value: str, size: int) -> DataFrame:
    """(by, part, values): values in order, `size` to a group; the last of a group may have fewer."""
    if size < 1:
        raise ValueError("a group has one row at least")
    parts, rows, inside = _ranged(rows, by, order, F.count("*").alias("_n"))
    parts = parts.withColumn("_n", F.sum("_n").over(Window.partitionBy(by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)))
    turn = F.row_number().over(inside) - 1 + F.coalesce("_n", F.lit(0))
    dealt = rows.join(parts, [by, "_range"]).withColumn("part", F.floor(turn / size).cast("int"))
    return dealt.groupBy(by, "part").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.col(value).alias("v")))), lambda s: s["v"]).alias("values"))


def ungrouped(rows: DataFrame, by: str) -> DataFrame:
    """(by, part, pos, value): the elements of each group."""
    return rows.select(by, "part", F.posexplode("values").alias("pos", "value"))


def split(values: Column, sizes: list[int]) -> Column:
    """An array in parts of given sizes; what is left over is a further part."""
    if any(s < 0 for s in sizes):
        raise ValueError("sizes must not be negative")
    ends = [sum(sizes[: k + 1]) for k in range(len(sizes))]
    parts = F.array(*(F.slice(values, F.lit(e - s + 1), F.lit(s)) for s, e in zip(sizes, ends)))
    left = F.slice(values, F.lit(sum(sizes) + 1), F.greatest(F.size(values) - sum(sizes), F.lit(0)))
    return F.when(F.size(left) > 0, F.concat(parts, F.array(left))).otherwise(parts)


def unlike(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one of two tables has more often than the other, as often, with the table they are in; none if the tables are equal."""
    return a.exceptAll(b).withColumn("only_in", F.lit("a")).unionByName(b.exceptAll(a).withColumn("only_in", F.lit("b")))
