from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from speechmill.operators import align, clusters, corpus, ordered, tables, vectors


def test_dense_numbers_with_ties_and_nulls(spark):
    rows = [(5, "b"), (5, "a"), (None, "z"), (-3, "q"), (90, "x")] + [(i, "r") for i in range(100, 160)]
    got = tables.dense_numbers(spark.createDataFrame(rows, "k long, v string").repartition(3), "k", "n", start=200).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert [(r["k"], r["v"]) for r in sorted(got, key=lambda r: r["n"])] == order
    assert sorted(r["n"] for r in got) == list(range(200, 200 + len(rows)))
    assert tables.dense_numbers(spark.createDataFrame([], "k long, v string"), "k", "n").count() == 0


def test_strict_lookup_raises(spark):
    df, dim = spark.createDataFrame([("a",), ("b",)], "k string"), spark.createDataFrame([("a", 1)], "k string, v int")
    assert tables.lookup(df, dim, "k").count() == 2
    with pytest.raises(Exception, match="no entry for k b"):
        tables.lookup(df, dim, "k", strict=True).collect()


def test_split_precedence_and_ids(spark):
    df = spark.createDataFrame([(True, 3), (False, 3), (False, None), (None, 1)], "t boolean, c int")
    assert [r[0] for r in df.select(tables.split_of(F.col("t"), F.col("c"), 3)).collect()] == ["test", "dev", "train", "train"]
    one = spark.range(1).select(tables.scripture_id(F.lit(4), F.lit(123), F.lit(0), F.lit(7))).first()[0]
    assert one == 1041230007


def test_label_floor(spark):
    labels = spark.createDataFrame([(i, "big" if i < 5 else "small") for i in range(9)], "id long, label string")
    got = {r["id"]: r["label"] for r in tables.label_with_floor(spark.range(11).toDF("id"), labels, "id").collect()}
    assert got == {i: "big" if i < 5 else "_other_" if i < 9 else "_rest_" for i in range(11)}


def test_runs_reproduce_the_rows(spark):
    values = [1, 1, None, None, 2, 1, 1, 1]
    df = spark.createDataFrame([("s", i, v) for i, v in enumerate(values)], "g string, o int, v int")
    runs = ordered.run_bounds(df, ["g"], ["o"], "v", F.col("o"), F.col("o") + 1).orderBy("run").collect()
    assert [(r["v"], r["n_rows"], r["begin"], r["end"]) for r in runs] == [(1, 2, 0, 2), (None, 1, 2, 3), (None, 1, 3, 4), (2, 1, 4, 5), (1, 3, 5, 8)]


def test_cluster_scores(spark):
    rows = [("a", 1)] * 4 + [("a", -1)] * 6 + [("b", 2)] * 3 + [("b", 1)] * 3 + [("_other_", 1)] * 2
    got = {r["label"]: r for r in clusters.cluster_f1(spark.createDataFrame(rows, "label string, cluster int"), "label", "cluster").collect()}
    assert (got["a"]["tp"], got["a"]["fp"], got["a"]["fn"]) == (4, 6, 5) and got["b"]["mode_cluster"] == 1
    assert set(got) == {"a", "b"}
    with pytest.raises(ValueError):
        clusters.best_run([{}], lambda p: (0.0, None))
    assert clusters.best_run([{"k": 1}, {"k": 2}, {"k": 3}], lambda p: ([0.2, 0.9, 0.9][p["k"] - 1], None))[0] == {"k": 2}


def test_scaling_of_a_constant_dimension(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 2.0]), (3, None)], "id long, v array<double>")
    got = {r["id"]: r["scaled"] for r in vectors.standardize(df, "v", vectors.moments(df, "v")).collect()}
    assert got[1] == [-1.0, 0.0] and got[2] == [1.0, 0.0] and got[3] is None


def test_spectral_clusters_separate_groups():
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(4, 16)) * 4
    x = np.concatenate([c + rng.normal(size=(25, 16)) * 0.2 for c in centres])
    found = clusters.spectral_labels(x, low=2, high=8)
    groups = [set(found[i * 25 : (i + 1) * 25].tolist()) for i in range(4)]
    assert all(len(g) == 1 for g in groups) and len(set.union(*groups)) == 4


def test_importances(spark):
    rng = np.random.default_rng(1)
    rows = [(float(y), [float(y) + rng.normal() * 0.1, float(rng.normal())]) for y in (0, 1) for _ in range(40)]
    imp = clusters.importances(spark.createDataFrame(rows, "y double, v array<double>"), "v", "y")
    assert imp.tolist() == [1.0, 0.0]


EXCERPTS = "slug string, excerpt int, verse int, text string"
ALIGNMENT = "slug string, row_idx int, begin long, duration long, token int, ort string"


def one_chapter():
    excerpts = [("b_1", 0, 0, "Buki 2"), ("b_1", 1, 1, "“Si, bon!” –"), ("b_1", 2, 2, "Nan ta. Hopi")]
    said = [("buki", 10), ("dos", 5), (None, 7), ("si", 4), ("bon", 6), (None, 9), ("nan", 3), ("ta", 2), ("ta", 2), (None, 5), ("hopi", 8), (None, 3)]
    rows, at, token = [], 0, -1
    for i, (ort, n) in enumerate(said):
        token += not (i and ort == said[i - 1][0] and ort)
        rows.append(("b_1", i, at, n, token if ort else -1 - i, ort))
        at += n
    return excerpts, rows


def test_alignment_to_spans_and_utterances(spark):
    excerpts, rows = one_chapter()
    spans, errors = align.align(spark.createDataFrame(excerpts, EXCERPTS), spark.createDataFrame(rows, ALIGNMENT))
    assert errors.count() == 0
    got = {r["verse"]: [(t["kind"], t["cased"], t["begin"], t["len"]) for t in r["tokens"]] for r in spans.collect()}
    # a silence of 7 at a change of verse: 3 close the old span, 4 open the new one
    assert got[0] == [("word", "Buki", 0, 10), ("word", "2", 10, 5), ("silence", None, 15, 3)]
    assert got[1] == [("silence", None, 18, 4), ("punct", "“", None, None), ("word", "Si", 22, 4), ("punct", ",", None, None), ("word", "bon", 26, 6), ("punct", "!”", None, None), ("punct", "–", None, None), ("silence", None, 32, 4)]
    assert got[2] == [("silence", None, 36, 5), ("word", "Nan", 41, 3), ("word", "ta", 44, 4), ("punct", ".", None, None), ("silence", None, 48, 5), ("word", "Hopi", 53, 8)]
    spoken = {(t["uncased"]) for r in spans.collect() for t in r["tokens"] if t["kind"] == "word"}
    assert "dos" in spoken
    out = {(r["verse"], r["utterance_num"]): r for r in align.utterances(spans).collect()}
    assert out[2, 1]["punctuated_text"] == "Nan ta." and out[2, 2]["punctuated_text"] == "Hopi"
    assert out[2, 1]["n_samples"] == 5 + 3 + 4 + 2 and out[2, 2]["n_samples"] == 3 + 8
    assert out[1, 1]["punctuated_text"] == "“Si, bon!” –" and out[1, 1]["unpunctuated_text"] == "si bon"


def test_misfits_are_set_aside(spark):
    excerpts, rows = one_chapter()
    bad = [r if r[1] != 3 else (*r[:5], "zzz") for r in rows]
    spans, errors = align.align(spark.createDataFrame(excerpts, EXCERPTS), spark.createDataFrame(bad, ALIGNMENT))
    assert spans.count() == 0 and [(r["word"], r["problem"]) for r in errors.collect()] == [("“Si,", "word and token differ")]
    with pytest.raises(ValueError, match="differ"):
        align.align(spark.createDataFrame(excerpts, EXCERPTS), spark.createDataFrame(bad, ALIGNMENT), strict=True)
    quiet = [*rows[:3], ("b_1", 3, 22, 1, -50, None), *[(s, i + 1, b, d, t, o) for s, i, b, d, t, o in rows[3:]]]
    _, errors = align.align(spark.createDataFrame(excerpts, EXCERPTS), spark.createDataFrame(quiet, ALIGNMENT))
    assert "two silences in a row" in {r["problem"] for r in errors.collect()}
    _, errors = align.align(spark.createDataFrame(excerpts, EXCERPTS), spark.createDataFrame(rows[:-2], ALIGNMENT))
    assert {r["problem"] for r in errors.collect()} == {"word without token"}


def test_bisect_parts_make_the_whole(spark):
    a, b = align.bisect(F.col("id"), F.col("id") * 7)
    for r in spark.range(20).select("id", a.alias("a"), b.alias("b")).collect():
        assert r["a"]["begin"] == r["id"] and r["a"]["begin"] + r["a"]["len"] == r["b"]["begin"] and r["a"]["len"] + r["b"]["len"] == r["id"] * 7 and 0 <= r["b"]["len"] - r["a"]["len"] <= 1


def test_corpus_table(spark):
    columns = "place long, book int, chapter int, verse int, utterance_num int, known_speaker string, n_samples long, punctuated_text string, unpunctuated_text string, speaker_embedding array<float>"
    rows = [(0, 1, 2, 0, 1, None, 16000, "A.", "a", [1.0]), (1, 1, 2, 3, 1, None, 8000, "B", "b", None), (2, None, None, None, 1, "guest", 1600, "C", "c", None), (3, None, None, None, 2, "guest", 1, "D", "d", None)]
    speakers = spark.createDataFrame([(s, "c", "e", "l", True) for s in ("intro", "reader", "guest")], "speaker string, comment string, environment string, licence string, is_male boolean")
    books = spark.createDataFrame([(1, "reader")], "book int, principal string")
    out = corpus.build_corpus(spark.createDataFrame(rows, columns), speakers, books, "intro")
    got = {r["utterance_id"]: r for r in out.collect()}
    assert {k: r["speaker"] for k, r in got.items()} == {101020001: "intro", 101020301: "reader", 200000000: "guest", 200000001: "guest"}
    assert got[101020001]["duration_ms"] == 1000.0 and got[200000000]["file_name"] == "200000000.wav"
    split = corpus.assign_splits(out, spark.createDataFrame([("guest", "test")], "speaker string, split string"))
    assert {r["utterance_id"]: r["train_dev_test_split"] for r in split.collect()}[200000000] == "test"
    with pytest.raises(Exception, match="no entry for speaker"):
        corpus.build_corpus(spark.createDataFrame(rows, columns), speakers.where("speaker <> 'guest'"), books, "intro").collect()


def test_embed_keeps_rows_that_fail(spark):
    df = spark.createDataFrame([(1, bytearray(b"ab")), (2, bytearray(b""))], "utterance_id long, samples binary")
    got = {r["utterance_id"]: r["speaker_embedding"] for r in corpus.embed(df, lambda c: [c[0], c[1]]).collect()}
    assert got == {1: [97.0, 98.0], 2: None}


def test_discriminant_axes_separate_labels(spark):
    rng = np.random.default_rng(2)
    rows = [(f"c{y}", (rng.normal(size=5) + np.eye(5)[y] * 6).tolist()) for y in range(3) for _ in range(40)]
    df = spark.createDataFrame(rows, "y string, v array<double>")
    axes = clusters.discriminant_axes(df, "v", "y", 2)
    x = np.array([r[1] for r in rows]) @ axes
    centres = np.stack([x[i * 40 : (i + 1) * 40].mean(axis=0) for i in range(3)])
    found = ((x[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert (found == np.repeat(range(3), 40)).mean() > 0.97
    assert clusters.shuffled_take(df, 7, 1).count() == 7
