"""Readers with explicit schemas; paths go to Spark's readers, so any store works."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VERSES = "book_id string, book_name string, book_name_short string, testament string, chapter int, verse int, verse_text string"
ALIGNMENT = "BEGIN long, DURATION long, TOKEN int, ORT string"
CORPUS = (
    "utterance_id long, file_name string, train_dev_test_split string, duration_ms double, unpunctuated_text string, punctuated_text string, "
    "principle_speaker_partition string, speaker_embedding string, speaker string, speaker_was_inferred boolean, speaker_is_male boolean, "
    "speaker_comment string, recording_environment_comment string, audio_license string"
)
BOOKS = "data struct<books:array<struct<book_id:string,name:string,name_short:string,testament:string,chapters:array<int>>>>"


def read_csv(spark: SparkSession, path: str, schema: str, separator: str = ",") -> DataFrame:
    """A CSV with a header. Only the empty string is null: 'nan' and 'NA' are words."""
    reader = spark.read.schema(schema).option("header", True).option("sep", separator).option("nullValue", "").option("quote", '"').option("escape", '"')
    return reader.option("multiLine", True).csv(path)


def read_alignment(spark: SparkSession, path: str) -> DataFrame:
    """Semicolon-separated alignments, one file a slug: (slug, row_idx, begin, duration, token, ort).

    Rows keep their order within a file: files are read line by line as whole texts, so row_idx is the
    line. Columns are found by the header; other columns are ignored."""
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.csv)?$", 1).alias("slug"), F.split("value", "\r?\n").alias("lines"))
    rows = files.select("slug", F.split(F.element_at("lines", 1), ";").alias("head"), F.posexplode(F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0)))).alias("row_idx", "line")).where("line <> ''")

    def cell(name: str) -> Column:
        return F.nullif(F.try_element_at(F.split("line", ";"), F.array_position("head", name).cast("int")), F.lit(""))

    return rows.select("slug", "row_idx", cell("BEGIN").cast("long").alias("begin"), cell("DURATION").cast("long").alias("duration"), cell("TOKEN").cast("int").alias("token"), cell("ORT").alias("ort"))


def read_books(spark: SparkSession, path: str, testaments: tuple[str, ...] = ("NT",)) -> DataFrame:
    """One row a chapter of a book list in JSON."""
    books = spark.read.schema(BOOKS).option("multiLine", True).json(path).select(F.explode("data.books").alias("b")).select("b.*").where(F.col("testament").isin(*testaments))
    return books.select("book_id", F.col("name").alias("book_name"), F.col("name_short").alias("book_name_short"), "testament", F.explode("chapters").alias("chapter"))


def read_excerpt(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as one excerpt each: (slug, excerpt, verse, text)."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.txt)?$", 1).alias("slug"), F.lit(0).alias("excerpt"), F.lit(None).cast("int").alias("verse"), F.col("value").alias("text"))


def numbered_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, utterance_num, line): one row a line that isn't empty; empty lines count in the numbers."""
    lines = df.select(key, F.posexplode(F.split(text, "\n", -1)).alias("at", "line"))
    return lines.where(F.trim("line") != "").select(key, (F.col("at") + 1).alias("utterance_num"), F.trim("line").alias("line"))


def read_audio(spark: SparkSession, path: str) -> DataFrame:
    """(uri, n_samples, rate, channels) of WAV files from their headers; samples stay where they are."""
    import io
    import wave

    import pyarrow as pa

    def run(batches):
        for b in batches:
            out = []
            for uri, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                try:
                    with wave.open(io.BytesIO(content)) as w:
                        out.append((uri, w.getnframes(), w.getframerate(), w.getnchannels()))
                except (wave.Error, EOFError):
                    out.append((uri, None, None, None))
            cols = list(zip(*out)) if out else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32())], names=["uri", "n_samples", "rate", "channels"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "uri string, n_samples long, rate int, channels int")


def complete_pages(pages: DataFrame, least_bytes: int = 10_000) -> DataFrame:
    """Pages whose body has at least that many bytes; smaller ones need another fetch."""
    return pages.where(F.octet_length("html") >= least_bytes)


def slug_paths(slugs: DataFrame, books: DataFrame) -> DataFrame:
    """(slug, path): <book>_<chapter> by the file pattern of the book, '{ch:02d}' being the chapter."""
    parts = slugs.select("slug", F.split("slug", "_").alias("s")).where("size(s) = 2").select("slug", F.col("s")[0].alias("book"), F.col("s")[1].cast("int").alias("chapter"))
    return parts.join(books.select("book", "pattern"), "book", "left").select("slug", F.replace("pattern", F.lit("{ch:02d}"), F.format_string("%02d", "chapter")).alias("path"))
