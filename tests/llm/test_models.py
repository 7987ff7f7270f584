from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from speechmill.llm import langid, quality
from tests.llm.fixtures import frame, rows

PATH = public_tokenizers.path(langid.VOCABULARY)


@pytest.fixture(scope="module")
def labelled(spark, request):
    import os

    sf = os.environ.get("TEST_MODEL_DIR", "/root/testdata/sf0.01")
    return sf


def test_quality_held_out_accuracy(spark, labelled):
    out = {r["doc_id"]: r for r in quality.op5_quality(spark, labelled).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{labelled}/labels.parquet").collect()}
    docs = spark.read.parquet(f"{labelled}/documents.parquet").select("doc_id").collect()
    assert len(out) == len(docs)
    for d, r in out.items():
        assert r["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    held = [(out[d]["predicted"], y) for d, y in labels.items() if out[d]["held_out"]]
    assert np.mean([p == y for p, y in held]) > 0.85
    assert np.mean([p for p, y in held if y == 1]) > 0.9


def test_quality_scores_do_not_depend_on_neighbours_or_batches():
    texts = [r[1] for r in rows()]
    y = np.array([i % 2 for i in range(len(texts))], np.float32)
    model = quality.train(quality.sampled(pa.array(texts, pa.string())), y, np.ones(len(texts), np.float32), epochs=1)
    whole = quality.predict(model, pa.array(texts, pa.string()))
    single = [quality.predict(model, pa.array([t], pa.string()))[0] for t in texts]
    assert np.allclose(whole, single, atol=1e-6)
    long = "ab cd " * 120_000
    assert abs(quality.predict(model, pa.array([long]))[0] - quality._predict_long(model, np.frombuffer(long.encode(), np.uint8))) < 1e-6
    tail = "x" * 5000
    assert quality.predict(model, pa.array([tail + "!!%%$$###" * 20]))[0] != quality.predict(model, pa.array([tail]))[0]


def test_quality_scores_equal_a_plain_convolution():
    texts = [r[1] or "" for r in rows() if len(r[1] or "") < 3000]
    y = np.array([i % 2 for i in range(len(texts))], np.float32)
    model = quality.train(quality.sampled(pa.array(texts, pa.string())), y, np.ones(len(texts), np.float32), epochs=1)
    got = quality.predict(model, pa.array(texts, pa.string()))
    for text, p in zip(texts, got):
        data = text.encode()
        n = -(-(len(data) + quality.WIDTH + quality.SPARE * quality.STRIDE) // quality.CHUNK_BYTES)
        data += bytes(n * quality.CHUNK_BYTES + quality.WIDTH - len(data))
        pooled = []
        for c in range(n):
            windows = quality.CHUNK - (quality.SPARE if c == n - 1 else 0)
            begins = [(c * quality.CHUNK + w) * quality.STRIDE for w in range(windows)]
            pooled.append(np.max([sum(model["taps"][j, data[b + j]] for j in range(quality.WIDTH)) for b in begins], axis=0))
        act = np.tanh(np.array(pooled) + model["bias"])
        z = act.mean(axis=0) @ model["of_mean"] + act.max(axis=0) @ model["of_max"] + model["offset"][0]
        assert abs(p - 1 / (1 + np.exp(-z))) < 1e-5


def test_quality_edges(spark):
    labels = spark.createDataFrame([(0, 1, 0), (0, 0, 0), (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(frame(spark), labels)
    assert "constant" in model and float(model["constant"]) == 0.0
    assert float(quality.fit(frame(spark), labels.where("false"))["constant"]) == 0.5
    out = quality.score(frame(spark).withColumnRenamed("source", "SCORE"), model).collect()
    assert len(out) == len(rows()) and all(r["score"] == 0.0 for r in out)
    assert quality.score(frame(spark).where("false"), model).count() == 0


def test_forward_sums_equal_all_segmentations():
    vocab = langid.vocabulary(PATH)
    rng = np.random.default_rng(1)
    prob = rng.random((len(vocab.pieces) + 1, 2))
    prob /= prob.sum(axis=0)

    def sums(s):
        if not s:
            return np.ones(2)
        total = np.zeros(2)
        for k in range(1, min(len(s), vocab.longest) + 1):
            piece = vocab.index.get(s[:k], vocab.unknown if k == 1 else None)
            if piece is not None:
                total = total + prob[piece] * sums(s[k:])
        return total

    words = ["the", "éauou", "x", "日本", "token", "İ", "a-b", "aaaaaa"]
    got = langid.log_likelihoods(vocab, prob, words)
    assert np.allclose(got, [np.log(sums("▁" + w)) for w in words])
    long = ["z" * 41, "tokenization" * 10, "é" * 300, "x" * 20_000, "a"]
    got = langid.log_likelihoods(vocab, prob, long)
    assert np.isfinite(got).all()
    for w, ll in zip(long[:3], got):
        scale, sums_at = np.zeros(2), [np.ones(2)]
        for end in range(1, len(w) + 2):
            s = ("▁" + w)[:end]
            total = sum(sums_at[-k] * prob[vocab.index.get(s[end - k :], vocab.unknown if k == 1 else 0)] for k in range(1, min(end, vocab.longest) + 1) if k == 1 or s[end - k :] in vocab.index)
            sums_at = [x / total for x in sums_at[-40:]] + [np.ones(2)]
            scale += np.log(total)
        assert np.allclose(ll, scale)


def test_rescaled_sums_equal_plain_ones(monkeypatch):
    vocab = langid.vocabulary(PATH)
    rng = np.random.default_rng(2)
    prob = rng.random(len(vocab.pieces) + 1)
    prob /= prob.sum()
    words = ["the", "éauou", "x", "日本", "token", "İ", "a-b", "aaaaaa", "segmentations", "nochwörter", "zzzzzzzzzzzzzzzz"]
    weight = rng.random(len(words))
    plain = langid.log_likelihoods(vocab, prob[:, None], words), langid.expected_counts(vocab, prob, words, weight)
    monkeypatch.setattr(langid, "LONG", 0)
    for most in (1, 3, 512):
        monkeypatch.setattr(langid, "LONG_WORDS", most)
        assert np.allclose(langid.log_likelihoods(vocab, prob[:, None], words), plain[0])
        assert np.allclose(langid.expected_counts(vocab, prob, words, weight), plain[1])


def test_language_written_without_spaces(spark):
    rng = np.random.default_rng(5)
    kana, latin = "あいうえおかきくけこさしすせそたちつてと", "abdeghiklmnoprstu"
    say = lambda letters, n: "".join(rng.choice(list(letters), n))
    data = [(i, say(kana, 300), "ja", "s", 0) for i in range(30)] + [(100 + i, " ".join(say(latin, 5) for _ in range(50)), "xx", "s", 0) for i in range(30)]
    data += [(200 + i, say(latin, 300), "xy", "s", 0) for i in range(30)]
    model = langid.fit(frame(spark, data[:20] + data[30:50] + data[60:80]))
    assert model[1] == ["ja", "xx", "xy"]
    out = langid.identify(frame(spark, data), model).collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in out]) > 0.95


def test_expectation_maximisation_raises_the_likelihood():
    vocab = langid.vocabulary(PATH)
    words = Counter({"und": 5, "nicht": 3, "schön": 2, "der": 9})
    scores = []
    for rounds in (1, 2, 4):
        p = langid.fit_language(vocab, words, rounds)
        assert abs(p.sum() - 1) < 1e-9
        ll = langid.log_likelihoods(vocab, p[:, None], list(words))
        scores.append(float((ll[:, 0] * list(words.values())).sum()))
    assert scores[0] <= scores[1] + 1 and scores[1] <= scores[2] + 1


def test_language_held_out_accuracy(spark, labelled):
    out = {r["doc_id"]: r for r in langid.op8_langid(spark, labelled).collect()}
    docs = spark.read.parquet(f"{labelled}/documents.parquet").select("doc_id", "lang").collect()
    assert len(out) == len(docs)
    held = [(out[d["doc_id"]]["lang_pred"], d["lang"]) for d in docs if out[d["doc_id"]]["held_out"]]
    assert all(out[d["doc_id"]]["held_out"] == (zlib.crc32(str(d["doc_id"]).encode()) % 3 == 1) for d in docs)
    assert np.mean([a == b for a, b in held]) > 0.97


def test_language_edges(spark):
    model = langid.fit(frame(spark))
    out = langid.identify(frame(spark).withColumnRenamed("source", "Score"), model).collect()
    assert len(out) == len(rows())
    for r in out:
        none = not r["text"] or not any(c.isalpha() for c in r["text"])
        assert (r["lang_pred"] == "und") == none and 0 <= r["score"] <= 1
    empty = langid.fit(frame(spark).where("lang = 'nothing'"))
    assert {r["lang_pred"] for r in langid.identify(frame(spark), empty).collect()} == {"und"}
    assert langid.identify(frame(spark).where("false"), model).count() == 0
