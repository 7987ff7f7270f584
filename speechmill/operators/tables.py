"""Relational operators: lookups, set filters, deterministic dedupe, dense numbering, split rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_listed(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in ``ids``; the join strategy is left to the optimizer."""
    return df.join(ids.select(key), key, "left_semi")


def drop_listed(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key), key, "left_anti")


def lookup(df: DataFrame, dimension: DataFrame, key: str, strict: bool = False) -> DataFrame:
    """Left join with a dimension; strict: a key that is missing there raises when the row is read."""
    out = df.join(dimension.withColumn("_found", F.lit(True)), key, "left")
    if strict:
        out = out.where(F.assert_true(F.col("_found").isNotNull(), F.concat(F.lit(f"no entry for {key} "), F.col(key).cast("string"))).isNull())
    return out.drop("_found")


def first_by_key(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """One row of each key, the first in the given order."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def pending(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Work that has no output yet."""
    return todo.join(done.select(key).distinct(), key, "left_anti")


def dense_numbers(df: DataFrame, key: str, out_col: str, start: int = 1, parts: int | None = None) -> DataFrame:
    """``start``, start + 1, ... in the order of an integer column without a window over all rows.

    Ranges of the key are counted first (one number for each range on the driver), then rows are
    numbered within their range. Ties go by all other columns; null keys come first."""
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.select(key).where(F.col(key).isNotNull()).repartitionByRange(parts, key).select(key, F.spark_partition_id().alias("p"))
    first = sorted(r["lo"] for r in ranged.groupBy("p").agg(F.min(key).alias("lo")).collect())
    bucket = F.coalesce(F.size(F.filter(F.lit(first), lambda x: x <= F.col(key))), F.lit(0)) if first else F.lit(0)
    bucket = F.when(F.col(key).isNull(), 0).otherwise(bucket)
    numbered = df.withColumn("_b", bucket)
    counts = {r["_b"]: r["n"] for r in numbered.groupBy("_b").agg(F.count("*").alias("n")).collect()}
    before, offsets = start, []
    for b in range(len(first) + 1):
        offsets.append(before)
        before += counts.get(b, 0)
    ties = [F.col(c) for c in df.columns if c != key and not c.startswith("_")]
    w = Window.partitionBy("_b").orderBy(key, *ties)
    return numbered.withColumn(out_col, F.element_at(F.lit(offsets), F.col("_b") + 1) + F.row_number().over(w) - 1).withColumn(out_col, F.col(out_col).cast("long")).drop("_b")


def scripture_id(book: Column, chapter: Column, verse: Column, utterance: Column) -> Column:
    """1BBCCVVUU; every part is padded to two digits and never cut."""
    return F.format_string("1%02d%02d%02d%02d", book.cast("int"), chapter.cast("int"), verse.cast("int"), utterance.cast("int")).cast("long")


def duration_ms(n_samples: Column, rate: int = 16000) -> Column:
    return n_samples / rate * 1000


def principal_speaker(verse: Column, by_book: Column, intro_speaker: str) -> Column:
    """Null without metadata; introductions have a narrator of their own, else the book decides."""
    return F.when(verse.isNull(), F.lit(None).cast("string")).when(verse == 0, intro_speaker).otherwise(by_book)


def known_speaker(known: Column, principal: Column) -> Column:
    return F.coalesce(F.nullif(known, F.lit("")), principal)


def split_of(is_test: Column, cluster: Column, dev_cluster: int) -> Column:
    """test wins over dev, the rest (null clusters too) trains."""
    return F.when(F.coalesce(is_test, F.lit(False)), "test").when(cluster == dev_cluster, "dev").otherwise("train")


def label_with_floor(df: DataFrame, labels: DataFrame, key: str, floor: int = 5, other: str = "_other_", unknown: str = "_rest_") -> DataFrame:
    """``label`` by key: labels with fewer than ``floor`` keys become ``other``, keys without one ``unknown``."""
    sizes = labels.groupBy("label").agg(F.count("*").alias("_n"))
    recoded = labels.join(sizes, "label").select(key, F.when(F.col("_n") >= floor, F.col("label")).otherwise(other).alias("label"))
    return df.join(recoded, key, "left").withColumn("label", F.coalesce("label", F.lit(unknown)))


def author(speaker: Column) -> Column:
    """The second part of an underscored name with a capital, other names as they are."""
    return F.when(speaker.contains("_"), F.initcap(F.split_part(speaker, F.lit("_"), F.lit(2)))).otherwise(speaker)
