from __future__ import annotations

import io
import wave

import pytest

from speechmill.sources import connectors, readers, sinks, verse_html
from speechmill.streaming import assign


def test_csv_keeps_words_that_look_missing(spark, tmp_path):
    (tmp_path / "v.csv").write_text('book_id,book_name,book_name_short,testament,chapter,verse,verse_text\nB1,"Long, name",Short,NT,1,1,nan\nB1,x,y,NT,1,2,\nB1,x,y,NT,1,3,"say ""a""\nb"\n')
    got = [r["verse_text"] for r in readers.read_csv(spark, f"{tmp_path}/v.csv", readers.VERSES).orderBy("verse").collect()]
    assert got == ["nan", None, 'say "a"\nb']


def test_alignment_files(spark, tmp_path):
    (tmp_path / "b_1.csv").write_text("X;BEGIN;DURATION;TOKEN;ORT\n9;0;5;0;nan\n9;5;2;-1;\n9;7;1;1;si\n")
    got = readers.read_alignment(spark, str(tmp_path)).orderBy("row_idx").collect()
    assert [(r["slug"], r["row_idx"], r["begin"], r["duration"], r["token"], r["ort"]) for r in got] == [("b_1", 0, 0, 5, 0, "nan"), ("b_1", 1, 5, 2, -1, None), ("b_1", 2, 7, 1, 1, "si")]


def test_books_excerpts_and_lines(spark, tmp_path):
    (tmp_path / "books.json").write_text('{"data": {"books": [{"book_id": "A", "name": "Long", "name_short": "L", "testament": "NT", "chapters": [1, 2]}, {"book_id": "B", "name": "O", "name_short": "O", "testament": "OT", "chapters": [1]}]}}')
    assert [(r["book_id"], r["chapter"]) for r in readers.read_books(spark, f"{tmp_path}/books.json").orderBy("chapter").collect()] == [("A", 1), ("A", 2)]
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "talk.txt").write_text("one\n\n two \n")
    e = readers.read_excerpt(spark, f"{tmp_path}/t")
    assert e.first()["slug"] == "talk"
    assert [(r["utterance_num"], r["line"]) for r in readers.numbered_lines(e, "slug", "text").collect()] == [(1, "one"), (3, "two")]


def test_audio_headers_and_wavs(spark, tmp_path):
    (tmp_path / "a.wav").write_bytes(sinks.wav_bytes(b"\0\0" * 800))
    (tmp_path / "b.wav").write_bytes(b"junk")
    got = {r["uri"].rsplit("/", 1)[1]: r["n_samples"] for r in readers.read_audio(spark, str(tmp_path)).collect()}
    assert got == {"a.wav": 800, "b.wav": None}
    folder = str(tmp_path)

    def put(name, content):
        with open(f"{folder}/out-{name}", "wb") as f:
            f.write(content)

    sinks.write_wavs(spark.createDataFrame([(7, bytearray(b"\1\0" * 5))], "utterance_id long, samples binary"), put)
    with wave.open(io.BytesIO((tmp_path / "out-7.wav").read_bytes())) as w:
        assert (w.getnframes(), w.getframerate(), w.getnchannels()) == (5, 16000, 1)


def test_csv_and_export_sinks(spark, tmp_path):
    df = spark.createDataFrame([("1.wav", "train", "a", [1.0, 2.5]), ("2.wav", "x", "b", None), ("3.wav", "dev", "c", [])], "file_name string, train_dev_test_split string, unpunctuated_text string, v array<double>")
    sinks.write_csv(df, f"{tmp_path}/c")
    assert {r["v"] for r in spark.read.option("header", True).csv(f"{tmp_path}/c").collect()} == {"[1.0 2.5]", None, "[]"}
    sinks.write_export(df, f"{tmp_path}/e")
    assert sorted((r["split"], r["audio"], r["transcript"]) for r in spark.read.parquet(f"{tmp_path}/e").collect()) == [("dev", "corpus_audio/3.wav", "c"), ("train", "corpus_audio/1.wav", "a")]


def test_retries():
    answers = iter([(503, b""), (200, b"small"), (200, b"x" * 10_000)])
    assert len(connectors.fetch_complete(lambda u: next(answers), "u")) == 10_000
    with pytest.raises(ValueError, match="status 404"):
        connectors.fetch_with_retry(lambda u: (404, b""), "u")
    with pytest.raises(ValueError, match="after 5 tries"):
        connectors.fetch_with_retry(lambda u: (500, b""), "u")
    with pytest.raises(ValueError, match="bytes after"):
        connectors.fetch_complete(lambda u: (200, b"x" * 9999), "u")
    assert connectors.alignment_link("<r><success>true</success><downloadLink>http://x</downloadLink></r>") == "http://x"
    with pytest.raises(ValueError, match="broken"):
        connectors.alignment_link("<r><success>false</success><output>broken</output></r>")


PAGE = '<body><span>menu</span><div class="a justify"><span>3</span><div>{}</div></div><div class="justify"><span>9</span></div></body>'


def test_verses(spark):
    good = PAGE.format("<sup>1-2</sup><span>One  text</span><span>3a</span><span> Two</span>")
    assert verse_html.parse_verses(good) == [(1, "One  text"), (3, "Two")]
    for body, problem in [("<sup>1</sup><span>a</span><sup>2</sup>", "2 numbers, 1 texts"), ("<sup>1</sup><span>a</span><sup>1b</sup><span>b</span>", "rise"), ("<sup>2</sup><span>a</span>", "rise")]:
        with pytest.raises(ValueError, match=problem):
            verse_html.parse_verses(PAGE.format(body))
    rows = verse_html.verses(spark.createDataFrame([(1, good), (2, "<p>x</p>"), (3, None)], "page_id long, html string")).orderBy("page_id", "verse").collect()
    assert [(r["page_id"], r["verse"], r["problem"]) for r in rows] == [(1, 1, None), (1, 3, None), (2, None, "no text block"), (3, None, "no text block")]


def test_streams(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    q = assign.windowed_counts(stream, late="1000 days").writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = {(r[0], r[1]): r[2] for r in assign.windowed_counts(events).collect()}
    assert {(r[0], r[1]): r[2] for r in spark.table("counts").collect()} == batch


def test_stream_assignment(spark, sf_dir, tmp_path):
    from speechmill.operators.vectors import centroids

    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    e.repartition(2).write.parquet(f"{tmp_path}/in")
    q = assign.assign_clusters(spark.readStream.schema(e.schema).parquet(f"{tmp_path}/in"), centroids(e, "label", "embedding"), f"{tmp_path}/out", f"{tmp_path}/check")
    q.awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out").count() == e.count()
