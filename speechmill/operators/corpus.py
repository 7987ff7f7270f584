"""The corpus table from utterances: ids, durations, speakers and their attributes, splits."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechmill.operators import tables

OTHER_IDS_FROM = 200_000_000


def build_corpus(utterances: DataFrame, speakers: DataFrame, books: DataFrame, intro_speaker: str, strict: bool = True) -> DataFrame:
    """The corpus of utterances(slug, book, verse, chapter, utterance_num, known_speaker, n_samples,
    punctuated_text, unpunctuated_text, speaker_embedding, place).

    books(book, principal); speakers(speaker, comment, environment, licence, is_male). Rows with a book get
    ids of scripture, the others a running number in the order of ``place``. strict: an unknown speaker raises."""
    by_book = utterances.join(books.select("book", "principal"), "book", "left")
    principal = tables.principal_speaker(F.col("verse"), F.col("principal"), intro_speaker)
    named = by_book.withColumn("principle_speaker_partition", principal).withColumn("speaker", tables.known_speaker(F.col("known_speaker"), principal))
    told = named.where("book is not null").withColumn("utterance_id", tables.scripture_id(F.col("book"), F.col("chapter"), F.col("verse"), F.col("utterance_num")))
    other = tables.dense_numbers(named.where("book is null"), "place", "utterance_id", start=OTHER_IDS_FROM)
    both = tables.lookup(told.unionByName(other), speakers, "speaker", strict)
    return both.select(
        "utterance_id",
        F.concat(F.col("utterance_id").cast("string"), F.lit(".wav")).alias("file_name"),
        F.lit(None).cast("string").alias("train_dev_test_split"),
        tables.duration_ms(F.col("n_samples")).alias("duration_ms"),
        "unpunctuated_text",
        "punctuated_text",
        "principle_speaker_partition",
        "speaker_embedding",
        "speaker",
        F.coalesce(F.col("speaker") == "", F.lit(True)).alias("speaker_was_inferred"),
        F.col("is_male").alias("speaker_is_male"),
        F.col("comment").alias("speaker_comment"),
        F.col("environment").alias("recording_environment_comment"),
        F.col("licence").alias("audio_license"),
    )


def assign_splits(corpus: DataFrame, split_by_speaker: DataFrame) -> DataFrame:
    """The split of the speaker; null where the speaker is in none."""
    return corpus.drop("train_dev_test_split").join(split_by_speaker.select("speaker", F.col("split").alias("train_dev_test_split")), "speaker", "left")


def embed(utterances: DataFrame, encode, key: str = "utterance_id", audio: str = "samples", out_col: str = "speaker_embedding") -> DataFrame:
    """Adds the vector of ``encode(bytes) -> list of floats``; rows it fails on stay, with null."""
    import pyarrow as pa
    from pyspark.sql import types as T

    schema = T.StructType([f for f in utterances.schema.fields if f.name != out_col] + [T.StructField(out_col, T.ArrayType(T.FloatType()))])
    names = schema.names

    def run(batches):
        for b in batches:
            out = []
            for content in b.column(audio).to_pylist():
                try:
                    out.append([float(x) for x in encode(content)])
                except Exception as e:  # noqa: BLE001  one bad recording must not end the job
                    logging.getLogger(__name__).warning("no vector: %s", e)
                    out.append(None)
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names[:-1]], pa.array(out, pa.list_(pa.float32()))], names=names)

    return utterances.mapInArrow(run, schema)
