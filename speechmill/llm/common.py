"""Shared plumbing of the training-data operators: table access, staging, column clashes."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most bits of a filter of join keys.
FILTER_BITS = 1 << 24
_STAGED: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the corpus tables; the path is left to Spark's readers."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where all tasks run on this machine, as in tests, a temporary one is made and set if none is named."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="speechmill-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts the lineage for
    good, so an executor that is lost later costs no recomputation of what came before."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _STAGED.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete what ``staged`` wrote for this session (done at exit as well)."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for item in [x for x in _STAGED if x[0] is spark]:
        _STAGED.remove(item)
        path = jvm.org.apache.hadoop.fs.Path(item[1])
        path.getFileSystem(conf).delete(path, True)


@atexit.register
def _release_all() -> None:
    for spark, _ in list(_STAGED):
        with contextlib.suppress(Exception):
            release(spark)


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without the columns that an operator is about to add (compared as Spark does,
    without case), so that extra columns of the same name never clash."""
    low = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in low])


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def seen_in(df: DataFrame, column: str, bits_of_key: int = 16) -> Callable[[Column], Column]:
    """A Bloom filter of a column, as a predicate that is true for all its values and for few others.

    Rows without a partner are left out by it before a join shuffles them; the join itself decides. The
    bits are built by aggregates, are at most FILTER_BITS / 8 bytes, and reach the tasks as the value of
    a scalar subquery. Beyond that size the filter lets more rows pass, never fewer."""
    bits = 1 << min(max((bits_of_key * df.count()).bit_length(), 12), FILTER_BITS.bit_length() - 1)
    in_block = min(64, bits >> 6)
    b = F.pmod(F.xxhash64(column), F.lit(bits))
    words = df.select(b.alias("b")).groupBy(F.shiftright("b", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("set"))
    cells = F.map_from_entries(F.collect_list(F.struct((F.col("word") % in_block).cast("int").alias("k"), F.col("set").alias("v"))))
    filled = F.transform(F.sequence(F.lit(0), F.lit(in_block - 1)), lambda i: F.coalesce(F.col("m")[i], F.lit(0).cast("long")))
    blocks = words.groupBy(F.floor(F.col("word") / in_block).alias("block")).agg(cells.alias("m")).select("block", filled.alias("row"))
    every = df.sparkSession.range((bits >> 6) // in_block).withColumnRenamed("id", "block").join(blocks, "block", "left")
    rows = every.select("block", F.coalesce("row", F.array_repeat(F.lit(0).cast("long"), in_block)).alias("row"))
    table = staged(rows.agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("block", "row"))), lambda r: r["row"])).alias("t")), "filter")

    def predicate(c: Column) -> Column:
        slot = F.pmod(F.xxhash64(c), F.lit(bits))
        return F.getbit(F.get(table.scalar(), F.shiftright(slot, 6).cast("int")), slot.bitwiseAND(F.lit(63)).cast("int")) == 1

    return predicate
