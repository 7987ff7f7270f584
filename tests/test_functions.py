from __future__ import annotations

import random
import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from speechmill.functions import numbers, text


def apply(spark, f, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i long, s {kind}")
    return [r["o"] for r in df.select("i", f(F.col("s")).alias("o")).orderBy("i").collect()]


def normalized(s: str) -> str:
    s = f" {s} "
    letters = set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
    kept = [c for i, c in enumerate(s) if re.match(r"[\w\s']", c) or (s[i - 1] in letters and i + 1 < len(s) and s[i + 1] in letters)]
    return re.sub(r"\s+", " ", "".join(kept)).strip().lower()


@pytest.fixture(scope="module")
def strings():
    rng = random.Random(1)
    alphabet = "abzéñüÉ '’\"-–.,;!?½²_ 　\u0085 日9٣\t\n"
    return ["", " ", "nan", "it's Co-op a-é", "½ cup", "_x_"] + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(25))) for _ in range(600)]


def test_normalize_text(spark, strings):
    assert apply(spark, text.normalize_text, strings) == [normalized(s) for s in strings]


def test_punctuation_predicates_and_edges(spark, strings):
    def mark(c):
        return not (c.isalnum() or unicodedata.category(c).startswith("M"))

    assert apply(spark, text.is_punctuation, strings) == [len(s) <= 4 and all(map(mark, s)) for s in strings]
    assert apply(spark, text.strip_nonletters, strings) == ["".join(c for c in s if unicodedata.category(c)[0] in "LM" or c in "0123456789") for s in strings]
    lead, trail = apply(spark, text.leading_punctuation, strings), apply(spark, text.trailing_punctuation, strings)
    core = apply(spark, text.without_edges, strings)
    for s, a, b, c in zip(strings, lead, trail, core):
        assert (a or "") + c + (b or "") == s
        assert a != "" and b != ""


def fold(given):
    """The fold, a character at a time."""
    out, closing, skip = [], False, False
    for at, mark in enumerate(given):
        if skip:
            skip = False
            continue
        follows = given[at + 1 : at + 2] == " "
        if mark in text.ALTERNATE:
            if closing and given[at - 1] == " ":
                out.pop()
            skip, closing = follows and not closing, not closing
        elif mark in text.CLING_LEFT and out and out[-1] == " ":
            out.pop()
        elif mark in text.CLING_RIGHT:
            skip = follows
        out.append(mark)
    return "".join(out)


def test_fold_spaces(spark):
    cases = [
        ("Hola , mundo !", "Hola, mundo!"), ("( a )", "(a)"), ("a ' b ' c", "a 'b' c"), ('say " yes " now', 'say "yes" now'), ("' '", "'"), ("a  ,b", "a ,b"), ("", ""), (" , x", ", x"), ("“ q ”", "“q”"), ("end (", "end ("), (None, None),
    ]
    assert apply(spark, text.collapse_whitespace, [c for c, _ in cases]) == [w for _, w in cases]
    rng = random.Random(3)
    texts = ["".join(rng.choice("  a'\".,([)]é“”") for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    assert apply(spark, text.collapse_whitespace, texts) == [fold(x) for x in texts]


def test_words_part_at_any_white_space(spark):
    texts = ["a\xa0b c　d\te\x1cf\n", "  ", "", "x", " a", "a b"]
    assert apply(spark, text.words, texts) == [x.split() for x in texts]


def test_sentences_of_marks_alone_join_others(spark):
    texts = ["One. Two! ... Three? \" Four", "! One. Two", "... !! a", "?", "", "One . . . . . Two."]
    want = [["One.", 'Two! ...', 'Three?', '" Four'], ["! One.", "Two"], ["... !!", "a"], ["?"], [""], ["One . . . .", ". Two."]]
    got = apply(spark, text.sentences, texts)
    assert got[:5] == want[:5]
    assert [" ".join(x) for x in got] == texts


def test_join_tokens(spark):
    df = spark.createDataFrame([(["Si", ",", "nan", "?"],), ([],), (None,)], "t array<string>")
    assert [r[0] for r in df.select(text.join_tokens(F.col("t"))).collect()] == ["Si, nan?", "", None]
    assert df.select(text.join_tokens(F.col("t"), compat=True)).first()[0] == "Si ,  nan ?"


ES = {0: "cero", 1: "uno", 20: "veinte", 21: "veintiuno", 29: "veintinueve", 30: "treinta", 31: "treinta y uno", 99: "noventa y nueve", 100: "cien", 101: "ciento uno", 200: "doscientos", 500: "quinientos", 999: "novecientos noventa y nueve", 1000: "uno mil", 2000: "dos mil", 123456: "ciento veintitrés mil cuatrocientos cincuenta y seis", 1_000_000: "Número demasiado grande", -1: None, None: None}
PAP = {0: "sero", 1: "un", 20: "binti", 21: "binti", 29: "binti", 30: "trinta", 31: "trinta i un", 99: "nobenta i nuebe", 100: "shen", 101: "shen un", 200: "dosshen", 999: "nuebeshen nobenta i nuebe", 1000: "mil", 1100: "mil shen", 2000: "dos mil", 123456: "shen binti mil kuatershen sinkuenta i seis", 1_000_000: "Number ta hopi grandi", -5: None, None: None}


def test_number_words(spark):
    assert apply(spark, numbers.int_to_spanish, list(ES), "long") == list(ES.values())
    assert apply(spark, numbers.int_to_papiamentu, list(PAP), "long") == list(PAP.values())


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@settings(max_examples=1, deadline=None)
@given(st.lists(st.tuples(st.text("aábñ ", max_size=8), st.text("aábñ ", max_size=8)), min_size=100, max_size=100))
def test_levenshtein_similarity(spark_session, pairs):
    df = spark_session.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i long, a string, b string")
    got = [r["o"] for r in df.select("i", text.levenshtein_similarity(F.col("a"), F.col("b")).alias("o")).orderBy("i").collect()]
    for (a, b), o in zip(pairs, got):
        n = max(len(a), len(b))
        assert o is None if n == 0 else abs(o - (n - distance(a, b)) / n) < 1e-9


def test_vectors_as_text(spark):
    assert apply(spark, text.parse_vector, ["[1.0  2.5 -3e-2]", "[]", None]) == [[1.0, 2.5, -0.03], [], None]


def test_sentences_and_digits(spark):
    assert apply(spark, text.sentences, ["Habai. Bo ta bon? Si! a.b"]) == [["Habai.", "Bo ta bon?", "Si!", "a.b"]]
    assert apply(spark, text.is_digits, ["12", "٣", "1a", "", "²"]) == [True, True, False, False, False]
    assert apply(spark, text.starts_with_punctuation, ["-a", "a-", " -", ""]) == [True, False, False, False]
