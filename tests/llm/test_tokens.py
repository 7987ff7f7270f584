from __future__ import annotations

import hashlib

import numpy as np
import public_tokenizers

from speechmill.llm import bpe
from tests.llm.fixtures import frame, rows

PATH = public_tokenizers.path(bpe.RANKS)


def test_round_trip_and_ids_equal_the_library(spark):
    out = bpe.decode(bpe.encode(frame(spark))).select("doc_id", "text", "ids", "n_tokens", "decoded").collect()
    assert len(out) == len(rows())
    for r in out:
        text = r["text"] or ""
        ids = np.frombuffer(bytes(r["ids"]), "<u4").tolist()
        assert ids == bpe.encoder(PATH).encode_ordinary(text) and r["n_tokens"] == len(ids)
        assert bytes(r["decoded"]).decode() == text


def test_safe_pieces_keep_the_ids():
    texts = ["word's  end \n\n next " * 40, "a b\n c" * 60, "   lead" + " x" * 200 + "   ", "  　é' 's" * 50, "x" * 500]
    for t in texts:
        for most in (1, 7, 50):
            pieces = list(bpe.safe_pieces(t, most))
            assert "".join(pieces) == t
            assert [i for p in pieces for i in bpe.encoder(PATH).encode_ordinary(p)] == bpe.encoder(PATH).encode_ordinary(t)


def test_long_runs_of_white_space():
    enc = bpe.encoder(PATH)
    for run in (" " * 100_000, " \n" * 50_000, "\u3000\t \n\r\n" * 20_000, "\xa0" * 60_000, "\n" * 100_000):
        for t in (run, "a" + run, run + "b", "x" + run + "y z" + run + ", " + run[:20_000] + "é", run + "\x1c" + run):
            assert bpe.encode_text(t, PATH).tolist() == enc.encode_ordinary(t)  # the library still can
    for run in (" " * 5_000_000, " \n" * 500_000):
        ids = bpe.encode_text("one" + run + "two", PATH)
        assert enc.decode_bytes(ids.tolist()).decode() == "one" + run + "two"
        tail = enc.encode_ordinary("one" + run[:100_000] + "two")
        assert ids[-2:].tolist() == tail[-2:] and ids[:2].tolist() == tail[:2]


def test_long_runs_of_other_characters():
    for t in ("a" * 200_000, "!" * 200_000 + " 7" * 90_000, "é7" * 100_000):
        assert bpe.encode_text(t, PATH).tolist() == bpe.encoder(PATH).encode_ordinary(t)


def test_special_tokens_are_text_and_clashing_columns_go(spark):
    df = spark.createDataFrame([(1, "<|endoftext|>", 5, "z")], "doc_id long, text string, n_tokens int, IDS string")
    r = bpe.decode(bpe.encode(df)).first()
    assert bytes(r["decoded"]) == b"<|endoftext|>" and r["n_tokens"] > 1


def test_one_pass_equals_both(spark):
    both = bpe.decode(bpe.encode(frame(spark))).drop("text").collect()
    assert sorted(map(str, bpe.round_trip(frame(spark)).collect())) == sorted(map(str, both))


def test_empty_table(spark):
    assert bpe.round_trip(frame(spark).where("false")).count() == 0
    assert bpe.decode(bpe.encode(frame(spark).where("false"))).count() == 0


def test_query(spark, sf_dir):
    out = {r["doc_id"]: r for r in bpe.op7_bpe(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert len(out) == len(docs)
    for d in docs:
        ids = bpe.encoder(PATH).encode_ordinary(d["text"])
        r = out[d["doc_id"]]
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(d["text"].encode()).hexdigest()
