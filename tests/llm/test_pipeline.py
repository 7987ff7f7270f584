from __future__ import annotations

import pytest

import corpus_pipeline
from speechmill.llm import bpe, common
from tests.llm.fixtures import frame, rows, save


def test_stages_keep_the_columns_and_shrink(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        if name != "tokens":
            assert out.columns == columns
            docs = corpus_pipeline.staged(out, f"test-{name}")
        m = out.count()
        assert 0 < m <= n
        n = m


def test_stages_on_awkward_rows(spark, sf_dir):
    for _, stage in corpus_pipeline.STAGES[1:]:
        out = stage(spark, frame(spark), sf_dir)
        assert out.count() <= len(rows())
        assert stage(spark, frame(spark).where("false"), sf_dir).count() == 0


def test_one_of_each_class_stays(spark, sf_dir):
    out = [r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, frame(spark), sf_dir).collect()]
    assert 0 in out and 8 not in out and 16 not in out


def test_leaks_of_a_lopsided_benchmark_go(spark, tmp_path):
    """Most items are alike; copies of the others, in other text, are dropped all the same."""
    same = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu"
    odd = [" ".join(f"o{k}x{j}" for j in range(16)) for k in range(5)]
    save(spark.createDataFrame([*enumerate([same] * 2000 + odd)], "item_id long, text string"), tmp_path, "benchmark")
    docs = [(k, f"{'host ' * k}{text} {same[:16]}", "en", "s", 0) for k, text in enumerate([*odd, same])]
    clean = [(10 + k, r[1], "en", "s", 0) for k, r in enumerate(rows()[:7])]
    out = corpus_pipeline.decontaminate(spark, frame(spark, docs + clean), str(tmp_path))
    assert sorted(r["doc_id"] for r in out.collect()) == [r[0] for r in clean]


@pytest.mark.parametrize("text", ["a b c", None])
def test_tokens_stage(spark, sf_dir, text):
    r = corpus_pipeline.tokens(spark, frame(spark, [(1, text, "a", "b", 1)]), sf_dir).first()
    assert len(r["ids"]) == 4 * r["n_tokens"] and r["n_tokens"] == len(bpe.encode_text(text, bpe.public_tokenizers.path(bpe.RANKS)))


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0


def test_no_machine_local_folder_on_a_cluster():
    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)  # noqa: N815

    class Session:
        sparkContext = Context  # noqa: N815
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session)
