"""Document fingerprints: a bottom-k sketch of the hashes of five-word shingles.

A sketch holds the k smallest distinct 32-bit shingle hashes in order, and whether it has been
cut off at k. Sketches of parts merge into the sketch of the whole (the k smallest of both), and
estimate resemblance, containment and the number of distinct shingles; while nothing was cut off
these are exact up to collisions of the 32-bit hash.

Defined cases: a null text is an empty one; a text of fewer than five words has its whole sequence
as one shingle, a text without words an empty sketch. Two empty sketches resemble each other by 1,
an empty one and any other by 0. Rows follow in the order of doc_id, null first, rows of one doc_id
in the order of their text (null as empty), so ties and repeated rows have a fixed next document.
Very long texts are sketched whole; an empty table gives an empty one. ``fingerprint`` replaces a column
that has the name of its output, ``with_next`` reads no column but doc_id and text.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from speechmill.llm.common import shuffle_width, table
from speechmill.llm.shingles import shingle_sets

K = 256
SHINGLE_WORDS = 5


def sketch_of(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of 64-bit shingle hashes: their upper halves, distinct, the k smallest (one more
    value would tell nothing: a sketch of k values counts as cut off)."""
    return np.unique((hashes >> np.uint64(32)).astype("<u4"))[:k]


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """|A and B| / |A or B| by the share of the merged sketch that both hold."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = merge(a, b, k)
    common = np.intersect1d(a, b, assume_unique=True)
    return int(np.searchsorted(common, both[-1], side="right")) / len(both)


def distinct_shingles(a: np.ndarray, k: int = K) -> float:
    """The number of distinct shingles: exact below k, else (k - 1) / (k-th smallest of 0 to 1)."""
    return float(len(a)) if len(a) < k else (k - 1) / ((int(a[k - 1]) + 1) / 2**32)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """|A and B| / |A|, from the resemblance and the sizes of both and of their union."""
    if not len(a):
        return 1.0
    union = distinct_shingles(merge(a, b, k), k)
    return min(1.0, resemblance(a, b, k) * union / distinct_shingles(a, k))


def to_text(a: np.ndarray) -> str:
    return base64.b64encode(a.astype("<u4").tobytes()).decode()


def from_text(s: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(s), dtype="<u4")


def sketches(column: pa.Array, k: int = K, words: int = SHINGLE_WORDS) -> list[np.ndarray]:
    return [sketch_of(h, k) for _, h in shingle_sets(column, words)]


def fingerprint(df: DataFrame, text_col: str = "text", out_col: str = "fingerprint", k: int = K, words: int = SHINGLE_WORDS) -> DataFrame:
    """``df`` with the fingerprint of ``text_col``, of every whole text on its own."""
    from pyspark.sql import types as T

    from speechmill.llm.common import without

    df = without(df, out_col)
    schema = T.StructType([*df.schema.fields, T.StructField(out_col, T.StringType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = pa.array([to_text(s) for s in sketches(b.column(text_col), k, words)], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, prints], names=schema.names)

    return df.mapInArrow(run, schema)


def _ranges(docs: DataFrame, parts: int) -> list[int]:
    """The first doc_id of each of at most ``parts`` ranges of about as many rows; reads ids only."""
    ids = docs.select("doc_id").where("doc_id is not null").repartitionByRange(parts, "doc_id")
    rows = ids.select("doc_id", F.spark_partition_id().alias("p")).groupBy("p").agg(F.min("doc_id").alias("lo")).collect()
    return sorted({r["lo"] for r in rows})


def _range_of(first: list[int]) -> Column:
    """The number of the range of a doc_id by two short scans of literal arrays; null goes first."""
    step = max(1, int(len(first) ** 0.5))
    blocks = [first[i : i + step] for i in range(0, len(first), step)]
    coarse = F.lit([b[0] for b in blocks])
    block = F.greatest(F.size(F.filter(coarse, lambda x: x <= F.col("doc_id"))) - 1, F.lit(0))
    fine = F.array(*[F.lit(b) for b in blocks])
    within = F.size(F.filter(F.element_at(fine, (block + 1).cast("int")), lambda x: x <= F.col("doc_id"))) - 1
    return F.when(F.col("doc_id").isNull(), 0).otherwise(F.greatest(block * step + within, F.lit(0))).cast("int")


PAIR_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def with_next(docs: DataFrame, k: int = K, words: int = SHINGLE_WORDS) -> DataFrame:
    """Fingerprints of every text and of the text whose last half is replaced from the next one.

    The texts are shuffled once, by ranges of doc_id. The first document of a range also goes to the
    range before it (the very first to the last range), so each range is a stream that a task reads
    with one text in hand; no window over all rows, nothing but the ranges' first ids on the driver.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    parts = shuffle_width(spark)
    first = _ranges(docs, parts) or [0]
    parts = len(first)
    has_null = bool(docs.where("doc_id is null").select("doc_id").take(1))
    leads = F.col("doc_id") == F.element_at(F.lit(first), F.col("part") + 1)
    if has_null:
        leads = F.when(F.col("part") == 0, F.col("doc_id").isNull()).otherwise(leads)
    placed = (
        docs.withColumn("part", _range_of(first))
        .withColumn("to", F.when(F.coalesce(leads, F.lit(False)), F.array(F.struct(F.col("part").alias("part"), F.lit(False).alias("guest")), F.struct(F.pmod(F.col("part") - 1, F.lit(parts)).alias("part"), F.lit(True).alias("guest")))).otherwise(F.array(F.struct(F.col("part").alias("part"), F.lit(False).alias("guest")))))
        .select("doc_id", "text", F.explode("to").alias("to"))
        .select("to.part", "to.guest", "doc_id", "text")
        .repartitionById(parts, F.col("part"))
        .sortWithinPartitions("part", "guest", "doc_id", "text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the last row read: part, doc_id, text, sketch

        def rows(b: pa.RecordBatch) -> Iterator[tuple]:
            texts = b.column("text")
            yield from zip(b.column("part").to_pylist(), b.column("guest").to_pylist(), b.column("doc_id").to_pylist(), texts.to_pylist(), sketches(texts, k, words))

        for big in batches:
            for at in range(0, big.num_rows, 256):
                b = big.slice(at, 256)
                out, edited = [], []
                for part, guest, doc_id, text, sketch in rows(b):
                    if held and held[0] == part and not held[4]:
                        half = len(held[2]) // 2
                        edited.append(held[2][: len(held[2]) - half] + text[:half])
                        out.append((held[1], len(held[2]), held[3], resemblance(held[3], sketch, k)))
                    held = (part, doc_id, text, sketch, guest)
                if not out:
                    continue
                new = sketches(pa.array(edited, pa.string()), k, words)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r[0] for r in out], pa.int64()),
                        pa.array([r[1] for r in out], pa.int64()),
                        pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
                        pa.array([to_text(r[2]) for r in out], pa.string()),
                        pa.array([to_text(s) for s in new], pa.string()),
                        pa.array([resemblance(r[2], s, k) for r, s in zip(out, new)], pa.float64()),
                        pa.array([r[3] for r in out], pa.float64()),
                    ],
                    names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
                )

    return placed.mapInArrow(run, PAIR_SCHEMA)


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_next(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op10_fingerprints": op10_fingerprints}
ORACLE: dict[str, str] = {}
