"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Main path: ``encode`` adds the token ids of every whole text, ``decode`` turns ids back into raw
bytes. Long texts are cut at safe boundaries first, so the library never sees one huge string;
a cut lies before a space or line feed that follows a character that isn't white space, where the
splitting pattern always ends a match, hence the ids are those of the uncut text.

Defined cases: a null text counts as empty (no ids, empty bytes); null ids decode to empty bytes; other
null columns pass through; special tokens are ordinary text; very long texts, and runs of one kind of character
of any length, have the ids of the uncut text; repeated rows are encoded alike, there are no ties; an empty table gives an empty
table; columns of the input that have the name of an output column are replaced.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from speechmill.llm.common import table, without

RANKS = "byte_bpe_50k.tiktoken"
#: Characters given to the library at once.
PIECE_CHARS = 1 << 16
#: White space from this many characters on doesn't go through the library's regex.
LONG_RUN = 1 << 14
#: A space or line feed after a character that isn't white space.
_CUT = re.compile(r"(?<=\S)[ \n]")
# The characters of the Unicode property White_Space.
_WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LONG_SPACE = re.compile(f"[{_WHITE}]{{{LONG_RUN},}}")
#: Rows of a batch whose results are held at once.
SLICE_ROWS = 256


@functools.lru_cache(maxsize=4)
def encoder(rank_file: str):
    """The encoder of a rank file; loaded once in each Python worker."""
    import tiktoken

    with open(rank_file, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("local", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def safe_pieces(text: str, most: int = PIECE_CHARS) -> Iterator[str]:
    """``text`` in pieces of about ``most`` characters, cut only where a match of the pattern ends."""
    begin = 0
    while len(text) - begin > most:
        cut = _CUT.search(text, begin + most)
        if cut is None:
            break
        yield text[begin : cut.start()]
        begin = cut.start()
    if begin < len(text):
        yield text[begin:]


def encode_text(text: str | None, rank_file: str) -> np.ndarray:
    """The ids of a text. A run of white space is one match, up to its last character if text follows; a
    long one is given to the library as that match, since its regex engine overflows on some hundred thousand."""
    if not text:
        return np.zeros(0, dtype="<u4")
    enc = encoder(rank_file)
    if len(text) <= LONG_RUN:
        return np.asarray(enc.encode_ordinary(text), dtype="<u4")
    ids, begin = [], 0
    for run in _LONG_SPACE.finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        ids += [enc.encode_ordinary(p) for p in safe_pieces(text[begin : run.start()])]
        ids.append(enc._encode_single_piece(text[run.start() : end]))
        begin = end
    ids += [enc.encode_ordinary(p) for p in safe_pieces(text[begin:])]
    return np.concatenate([np.asarray(x, dtype="<u4") for x in ids] or [np.zeros(0, "<u4")])


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, SLICE_ROWS):
            yield b.slice(at, SLICE_ROWS)


def encode(df: DataFrame, text_col: str = "text", rank_file: str | None = None) -> DataFrame:
    """Adds ``n_tokens`` long and ``ids`` binary: the ids as little-endian unsigned 32-bit integers."""
    path = rank_file or public_tokenizers.path(RANKS)
    df = without(df, "n_tokens", "ids")
    schema = T.StructType([*df.schema.fields, T.StructField("n_tokens", T.LongType(), False), T.StructField("ids", T.BinaryType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            ids = [encode_text(t, path) for t in b.column(text_col).to_pylist()]
            added = [pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())]
            yield pa.RecordBatch.from_arrays([*b.columns, *added], names=schema.names)

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, ids_col: str = "ids", rank_file: str | None = None) -> DataFrame:
    """Adds ``decoded`` binary: the raw bytes of the ids, which need not be valid UTF-8."""
    path = rank_file or public_tokenizers.path(RANKS)
    df = without(df, "decoded")
    schema = T.StructType([*df.schema.fields, T.StructField("decoded", T.BinaryType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in _slices(batches):
            out = [enc.decode_bytes(np.frombuffer(x, dtype="<u4").tolist()) if x else b"" for x in b.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], names=schema.names)

    return df.mapInArrow(run, schema)


def round_trip(df: DataFrame, text_col: str = "text", rank_file: str | None = None) -> DataFrame:
    """``encode`` and ``decode`` in one pass: one Python worker a core and no second transfer of the ids.
    The text itself isn't returned."""
    path = rank_file or public_tokenizers.path(RANKS)
    rest = without(df, "n_tokens", "ids", "decoded").drop(text_col)
    kept = list(rest.columns)
    schema = T.StructType([*rest.schema.fields, T.StructField("n_tokens", T.LongType(), False), T.StructField("ids", T.BinaryType(), False), T.StructField("decoded", T.BinaryType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in _slices(batches):
            ids = [encode_text(t, path) for t in b.column(text_col).to_pylist()]
            added = [pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array([enc.decode_bytes(x.tolist()) for x in ids], pa.binary())]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], *added], names=[*kept, "n_tokens", "ids", "decoded"])

    return df.mapInArrow(run, schema)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` encoded and decoded again, as digests."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = round_trip(docs)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {"op7_bpe": op7_bpe}
ORACLE: dict[str, str] = {}
