"""Sinks: CSV with vectors as text, one WAV per utterance, a split-wise export."""

from __future__ import annotations

import io
import wave
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechmill.functions.text import format_vector

SPLITS = ("train", "dev", "test")


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; array columns as '[a b c]'. A path that is being read can't be the target."""
    vectors = [c for c, t in df.dtypes if t.startswith("array")]
    df.withColumns({c: format_vector(F.col(c)) for c in vectors}).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def wav_bytes(samples: bytes, rate: int = 16000) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(samples)
    return out.getvalue()


def write_wavs(df: DataFrame, put: Callable[[str, bytes], None], key: str = "utterance_id", samples: str = "samples") -> None:
    """One <id>.wav a row; ``put`` stores a file under a name and is called on the executors."""

    def run(rows):
        for r in rows:
            put(f"{r[key]}.wav", wav_bytes(bytes(r[samples])))

    df.select(key, samples).foreachPartition(run)


def export_table(corpus: DataFrame, prefix: str = "corpus_audio/") -> DataFrame:
    """(audio, transcript, split) of the rows in one of the three splits."""
    return corpus.where(F.col("train_dev_test_split").isin(*SPLITS)).select(F.concat(F.lit(prefix), "file_name").alias("audio"), F.col("unpunctuated_text").alias("transcript"), F.col("train_dev_test_split").alias("split"))


def write_export(corpus: DataFrame, path: str) -> None:
    export_table(corpus).write.mode("overwrite").partitionBy("split").parquet(path)
