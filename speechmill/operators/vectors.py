"""Vector operators on array columns: scaling, centroids, distances, importance weighting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def centroids(df: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, centroid): the elementwise mean. Sums are combined before the shuffle; a row for each
    dimension travels, not the vectors of a group together."""
    cells = df.select(group, F.posexplode(vector).alias("pos", "x")).groupBy(group, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return cells.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda c: c["m"]).alias("centroid"))


def moments(df: DataFrame, vector: str) -> DataFrame:
    """(pos, mean, std) of every dimension, the population deviation."""
    return df.select(F.posexplode(vector).alias("pos", "x")).groupBy("pos").agg(F.avg(F.col("x").cast("double")).alias("mean"), F.stddev_pop(F.col("x").cast("double")).alias("std"))


def standardize(df: DataFrame, vector: str, fitted: DataFrame, out_col: str = "scaled") -> DataFrame:
    """(x - mean) / std by the moments of ``fitted``; a constant dimension is divided by 1."""
    # one row that holds one pair of numbers for each dimension
    table = fitted.agg(F.array_sort(F.collect_list(F.struct("pos", "mean", "std"))).alias("_m"))
    scaled = F.zip_with(vector, "_m", lambda x, m: (x.cast("double") - m["mean"]) / F.when(m["std"] == 0, 1.0).otherwise(m["std"]))
    return df.join(F.broadcast(table)).withColumn(out_col, scaled).drop("_m")


def distance(a: Column | str, b: Column | str) -> Column:
    """Euclidean distance of two array columns."""
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def nearest(df: DataFrame, vector: str, centres: DataFrame, group: str) -> DataFrame:
    """Adds ``nearest`` and ``distance``: the closest centroid of every row, ties to the smallest group.

    The centroids are one row, an array of (group, centroid); their number is that of the clusters."""
    table = centres.agg(F.array_sort(F.collect_list(F.struct(F.col(group).alias("g"), F.col("centroid").alias("c")))).alias("_c"))
    ranked = F.transform("_c", lambda c: F.struct(distance(F.col(vector), c["c"]).alias("d"), c["g"].alias("g")))
    best = F.array_min(ranked)
    return df.join(F.broadcast(table)).withColumn("_b", best).withColumn("nearest", F.col("_b.g")).withColumn("distance", F.col("_b.d")).drop("_b", "_c")


def weigh(vector: Column | str, importance: Column, share: float) -> Column:
    """x * (1 - share) + x * importance * share, elementwise."""
    return F.zip_with(vector, importance, lambda x, i: x.cast("double") * (1 - share) + x.cast("double") * i * share)


def min_max(df: DataFrame, column: str, out_col: str) -> DataFrame:
    """(x - min) / (max - min) over all rows, 0 for a constant column."""
    bounds = df.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))  # one row
    return df.join(F.broadcast(bounds)).withColumn(out_col, F.when(F.col("_hi") == F.col("_lo"), 0.0).otherwise((F.col(column) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))).drop("_lo", "_hi")


def encode_labels(df: DataFrame, column: str, out_col: str) -> DataFrame:
    """0, 1, ... in the alphabetical order of the distinct labels, whose number is that of the classes."""
    codes = df.select(column).where(F.col(column).isNotNull()).distinct().agg(F.array_sort(F.collect_list(column)).alias("_l"))
    return df.join(F.broadcast(codes)).withColumn(out_col, (F.array_position("_l", F.col(column)) - 1).cast("long")).drop("_l")
