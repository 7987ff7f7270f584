"""The corpus pipeline: quality, line dedup, near duplicates, decontamination, tokens.

``STAGES`` are (name, function) pairs; each function takes (spark, docs, sf_dir) and returns a DataFrame,
which is written as Parquet and read again as the next one's ``docs``. All but the last return the
columns of their input, rows that a stage rejects are gone for good.

Ids that a stage rejects are broadcast only if they are counted to be few; else they are joined.

Defined cases: an empty table stays one through all stages. Null and empty texts go in the first stage; given
to a later one, they stay, and have no tokens. Rows of a null doc_id are scored, deduplicated by line and encoded
like others, and are never dropped as copies or leaks, which are named by doc_id. Repeated rows share their fate
in every stage. Of near copies the lowest doc_id stays. Other columns and nulls in them pass through; columns of
the names that the last stage adds are replaced. Texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speechmill.llm import bpe, decontam, lines, ngram_join, quality
from speechmill.llm.common import staged, table

#: Ids of this many rows may be broadcast (8 bytes each).
BROADCAST_IDS = 500_000


def _without_ids(docs: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """The rows of ``docs`` whose doc_id isn't among ``ids``; null ids stay."""
    gone = staged(ids.select("doc_id").distinct(), name)
    return docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, "doc_id", "left_anti").select(*docs.columns)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose probability of good quality is below the threshold. A null text is no
    document any more: it counts as empty and is dropped."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs.where("text is not null and text <> ''"), model, out_col="quality_probability_")
    return scored.where(F.col("quality_probability_") >= quality.THRESHOLD).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes lines that came earlier in the corpus; documents that lose all their text go."""
    out = lines.dedup_lines(docs).where("n_removed = 0 or trim(text) <> ''")
    columns = [F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns]
    return out.select(*columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of lowest doc_id, of each class of five-word-shingle similarity 0.8."""
    classes = ngram_join.link_classes(docs, words=5, num=8, den=10)
    return _without_ids(docs, classes.where("doc_id <> component_id"), "copies")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return _without_ids(docs, decontam.find_leaks(docs, table(spark, sf_dir, "benchmark")), "leaks")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every document, little-endian in ``ids``, in place of its text, and digests of them
    and of the bytes that they decode to."""
    coded = bpe.round_trip(docs)
    own = [c for c in docs.columns if c.lower() not in ("text", "n_tokens", "ids", "decoded")]
    return coded.select(*own, "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality", quality_filter),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("tokens", tokens),
]

#: The classifier and the latent space can't be told in SQL; the tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, name)
    return docs
