from __future__ import annotations

import random

from speechmill import registry
from speechmill.operators import align
from tests.oracle import differences

TOKENS = "slug string, excerpt int, verse int, tokens array<struct<ordinal:int,place:int,kind:string,uncased:string,cased:string,begin:bigint,len:bigint>>"


def planned(df, mode="formatted"):
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)


def test_align_deals_each_side_once(spark, sf_dir):
    plan = planned(registry.queries()["aligned_spans"](spark, sf_dir), "simple")
    assert plan.count("Exchange ") <= 3 and plan.count("FileScan") == 2 and "Join" not in plan


def test_chapters_without_name_and_repeated_texts(spark, tmp_path):
    rows = [(None, 0, "user", "Bon dia. Ta un ora!"), (None, 1, "user", "Si"), (1, 0, "user", "a  b. c"), (1, 1, "user", ""), (1, 2, "user", "Si. Si."), (2, 0, "user", None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert differences(registry.queries()["aligned_spans"](spark, str(tmp_path)), registry.oracle_sql()["aligned_spans"], str(tmp_path)) == ""
    assert differences(registry.queries()["span_utterances"](spark, str(tmp_path)), registry.oracle_sql()["span_utterances"], str(tmp_path)) == ""


def cut(tokens):
    """Sentences one token after another."""
    out, current, prev, quiet = [], [], None, []
    for t in tokens:
        if t[2] == "silence":
            quiet.append(t)
            continue
        if prev and t[2] == "word" and prev[2] == "punct" and set(prev[4]) & set(".!?…"):
            out.append(current + [(*q[:6], q[6] // 2) for q in quiet])
            current = [(q[0], 2, *q[2:5], q[5] + q[6] // 2, q[6] - q[6] // 2) for q in quiet]
        else:
            current = current + quiet
        current, quiet, prev = [*current, t], [], t
    return out + [current + quiet] if tokens else []


def test_utterances_equal_a_plain_loop(spark):
    rng, spans = random.Random(3), [("s", 0, 0, []), ("s", 1, 1, [(1, 1, "silence", "<p:>", None, 4, 7)])]
    for k in range(2, 60):
        tokens = []
        for i in range(rng.choice((1, 3, 40))):
            kind = rng.choice(("word", "word", "punct", "silence"))
            cased = None if kind == "silence" else "bo" if kind == "word" else rng.choice((".", ",", "!”", "…", "“"))
            tokens.append((i, 4, kind, "bo", cased, *((None, None) if kind == "punct" else (10 * i, rng.randrange(10)))))
        spans.append(("s", k, k, tokens))
    df = spark.createDataFrame(spans, TOKENS)
    got = {(r["excerpt"], r["utterance_num"]): [tuple(t) for t in r["tokens"]] for r in align.utterances(df).collect()}
    assert got == {(k, n): part for _, k, _, tokens in spans for n, part in enumerate(cut(tokens), 1)}


def test_utterances_are_cut_where_the_span_lies(spark):
    plan = planned(align.utterances(spark.createDataFrame([("s", 1, 1, [])], TOKENS)), "simple")
    assert "Exchange" not in plan and "Window" not in plan
