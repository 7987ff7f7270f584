"""Ordered operators: runs, running offsets, numbering, chapter texts. All windows have a partition key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_runs(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Adds ``run``, 0, 1, ...: a new run starts where the value changes; a null differs from everything."""
    w = Window.partitionBy(*by).orderBy(*order)
    same = F.col(value) == F.lag(value).over(w)
    started = F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)
    return df.withColumn("_new", started).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("_new")


def run_bounds(df: DataFrame, by: list[str], order: list[str], value: str, begin: Column, end: Column) -> DataFrame:
    """One row a run: its value, number of rows, begin of its first row, end of its last row."""
    rows = with_runs(df, by, order, value)
    place = F.struct(*order)
    return rows.groupBy(*by, "run").agg(F.first(value).alias(value), F.count("*").alias("n_rows"), F.min_by(begin, place).alias("begin"), F.max_by(end, place).alias("end"))


def running_offset(df: DataFrame, by: list[str], order: list[str], size: Column) -> Column:
    """The sum of ``size`` over the rows before, 0 for the first."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(size).over(w), F.lit(0)).cast("long")


def counts_from_one(df: DataFrame, by: str, value: str, order: str) -> DataFrame:
    """Per group whether its values, in order, rise strictly from 1. Null values fail."""
    w = Window.partitionBy(by).orderBy(order)
    ok = F.when(F.lag(value).over(w).isNull(), F.col(value) == 1).otherwise(F.col(value) > F.lag(value).over(w))
    return df.withColumn("_ok", F.coalesce(ok, F.lit(False))).groupBy(by).agg(F.bool_and("_ok").alias("increasing"))


def texts_in_order(df: DataFrame, by: list[str], order: str, text: str, separator: str = "\n") -> DataFrame:
    """The texts of a group joined in order, with a trailing separator."""
    rows = F.array_sort(F.collect_list(F.struct(order, text)))
    return df.groupBy(*by).agg(F.concat(F.array_join(F.transform(rows, lambda r: r[text]), separator), F.lit(separator)).alias("text"))


def groups_by_first(df: DataFrame, by: list[str], order: str) -> DataFrame:
    """The groups with the place of their first row, for order of first appearance."""
    return df.groupBy(*by).agg(F.min(order).alias("first_place"), F.count("*").alias("n_rows"))
