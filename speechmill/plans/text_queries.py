"""Text and number scalars on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from speechmill.functions import numbers, text
from speechmill.operators import tables
from speechmill.plans.base import query
from speechmill.plans.table_queries import _SPLIT_SQL, _WORDS_SQL, splits

_NORMAL_SQL = r"""lower(trim(regexp_replace(array_to_string(list_transform(l, lambda ch, i:
  CASE WHEN regexp_matches(ch, '[\p{L}\p{N}_\s'']') THEN ch
       WHEN regexp_matches(l[i-1], '[a-zA-Z]') AND regexp_matches(l[i+1], '[a-zA-Z]') THEN ch ELSE '' END), ''), '\s+', ' ', 'g'), ' '))"""


@query(f"SELECT doc_id, {_NORMAL_SQL} AS normalized FROM (SELECT doc_id, string_split(' ' || text || ' ', '') AS l FROM documents)")
def normalize_text(spark, t):
    return t("documents").select("doc_id", text.normalize_text(F.col("text")).alias("normalized"))


def _exploded(t):
    return t("documents").select("doc_id", F.explode(text.words(F.col("text"))).alias("w"))


_W = f"(SELECT doc_id, unnest({_WORDS_SQL}) AS w FROM documents)"


@query(rf"SELECT doc_id, count(*) FILTER (length(w) <= 4 AND NOT regexp_matches(w, '[\p{{L}}\p{{N}}\p{{M}}]')) AS n_punct FROM {_W} GROUP BY 1")
def is_punct(spark, t):
    return _exploded(t).groupBy("doc_id").agg(F.count_if(text.is_punctuation(F.col("w"))).alias("n_punct"))


@query(rf"""
SELECT lead, trail, count(*) AS n FROM (
  SELECT nullif(regexp_extract(w, '^[^\p{{L}}\p{{N}}]+'), '') AS lead, nullif(regexp_extract(regexp_replace(w, '^[^\p{{L}}\p{{N}}]+', ''), '[^\p{{L}}\p{{N}}]+$'), '') AS trail FROM {_W}) GROUP BY ALL""")
def edge_punct(spark, t):
    return _exploded(t).groupBy(text.leading_punctuation(F.col("w")).alias("lead"), text.trailing_punctuation(F.col("w")).alias("trail")).agg(F.count("*").alias("n"))


_PLAIN = "regexp_replace(regexp_replace(coalesce(text, ''), '[\"'']', '', 'g'), '[.,]', ' . ', 'g') || ' ( '"


@query(rf"""
SELECT conv_id, turn, regexp_replace(regexp_replace({_PLAIN}, ' ([.,;:!?)\]}}’”])', '\1', 'g'), '([(\[{{‘“]) ', '\1', 'g') || '"' || role || '"; [x] ' || chr(39) || role || chr(39) || ' "' || role AS folded FROM conversations""")
def fold_spaces(spark, t):
    """Turns with marks and quotes set apart, folded together again."""
    plain = F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), "[\"']", ""), "[.,]", " . ")
    apart = F.concat(plain, F.lit(' ( " '), F.col("role"), F.lit(' " ; [ x ] \''), F.col("role"), F.lit(" ' \" "), F.col("role"))
    return t("conversations").select("conv_id", "turn", text.collapse_whitespace(apart).alias("folded"))


@query(f"SELECT p_partkey, p_brand || ' ' || p_type || ', ' || p_size || '!' AS joined FROM part")
def join_tokens(spark, t):
    tokens = F.array(F.col("p_brand"), F.col("p_type"), F.lit(","), F.col("p_size").cast("string"), F.lit("!"))
    return t("part").select("p_partkey", text.join_tokens(tokens).alias("joined"))


@query(rf"SELECT doc_id, regexp_replace(text, '[^\p{{L}}\p{{M}}0-9]', '', 'g') AS letters FROM documents")
def strip_nonletters(spark, t):
    return t("documents").select("doc_id", text.strip_nonletters(F.col("text")).alias("letters"))


@query(rf"SELECT doc_id, count(*) FILTER (regexp_matches(w, '^[^\p{{L}}\p{{N}}_\s]')) AS n_starts FROM {_W} GROUP BY 1")
def starts_punct(spark, t):
    return _exploded(t).groupBy("doc_id").agg(F.count_if(text.starts_with_punctuation(F.col("w"))).alias("n_starts"))


@query(rf"SELECT doc_id, count(*) FILTER (regexp_matches(w, '^\p{{Nd}}+$')) AS n_digits FROM {_W} GROUP BY 1")
def digit_tokens(spark, t):
    return _exploded(t).groupBy("doc_id").agg(F.count_if(text.is_digits(F.col("w"))).alias("n_digits"))


@query(f"SELECT doc_id, CAST(len({_WORDS_SQL}) AS BIGINT) AS n_words FROM documents")
def word_count(spark, t):
    return t("documents").select("doc_id", F.size(text.words(F.col("text"))).cast("long").alias("n_words"))


@query("SELECT p_partkey, CASE WHEN p_size = 1 THEN p_type || ', ' ELSE '' END || p_brand || ' ' || p_size AS intro FROM part")
def intro_lines(spark, t):
    lines = text.intro_lines(F.col("p_brand"), F.col("p_type"), F.col("p_size"), normalized=False)
    return t("part").select("p_partkey", F.array_join(lines, ", ").alias("intro"))


@query("SELECT p_partkey, CAST(levenshtein(p_name, p_type) AS BIGINT) AS distance FROM part")
def lev_distance(spark, t):
    return t("part").select("p_partkey", F.levenshtein("p_name", "p_type").cast("long").alias("distance"))


_SIM = "((greatest(length({a}), length({b})) - levenshtein({a}, {b})) / greatest(length({a}), length({b})))"


@query(f"SELECT p_partkey, round({_SIM.format(a='p_name', b='p_brand')}, 6) AS similarity FROM part")
def lev_similarity(spark, t):
    return t("part").select("p_partkey", F.round(text.levenshtein_similarity(F.col("p_name"), F.col("p_brand")), 6).alias("similarity"))


def _sql_list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _es(x: str) -> str:
    tens = f"{_sql_list(numbers.ES_TENS)}[{x} % 100 // 10 - 2]"
    two = f"CASE WHEN {x} % 100 < 30 THEN {_sql_list(numbers.ES_UNITS)}[{x} % 100 + 1] WHEN {x} % 10 = 0 THEN {tens} ELSE {tens} || ' y ' || {_sql_list(numbers.ES_UNITS)}[{x} % 10 + 1] END"
    hundreds = f"{_sql_list(numbers.ES_HUNDREDS)}[{x} // 100]"
    return f"CASE WHEN {x} < 100 THEN {two} WHEN {x} % 100 = 0 THEN {hundreds} ELSE CASE WHEN {x} // 100 = 1 THEN 'ciento' ELSE {hundreds} END || ' ' || {two} END"


def _pap(x: str) -> str:
    tens = f"{_sql_list(numbers.PAP_TENS)}[{x} % 100 // 10 - 2]"
    two = f"CASE WHEN {x} % 100 <= 20 THEN {_sql_list(numbers.PAP_UNITS)}[{x} % 100 + 1] WHEN {x} % 100 < 30 THEN 'binti' WHEN {x} % 10 = 0 THEN {tens} ELSE {tens} || ' i ' || {_sql_list(numbers.PAP_UNITS)}[{x} % 10 + 1] END"
    hundreds = f"CASE WHEN {x} // 100 = 1 THEN 'shen' ELSE {_sql_list(numbers.PAP_UNITS)}[{x} // 100 + 1] || 'shen' END"
    return f"CASE WHEN {x} < 100 THEN {two} WHEN {x} % 100 = 0 THEN {hundreds} ELSE {hundreds} || ' ' || {two} END"


_INTS = "(SELECT o_orderkey, CAST(o_orderkey * 37 % 1000100 AS BIGINT) AS n FROM orders)"


@query(f"""SELECT o_orderkey, n, CASE WHEN n >= 1000000 THEN '{numbers.ES_TOO_LARGE}' WHEN n < 1000 THEN {_es('n')}
  ELSE {_es('(n // 1000)')} || ' mil' || CASE WHEN n % 1000 = 0 THEN '' ELSE ' ' || {_es('(n % 1000)')} END END AS spoken FROM {_INTS}""")
def num_words_es(spark, t):
    return t("orders").select("o_orderkey", (F.col("o_orderkey") * 37 % 1000100).alias("n")).withColumn("spoken", numbers.int_to_spanish(F.col("n")))


@query(f"""SELECT o_orderkey, n, CASE WHEN n >= 1000000 THEN '{numbers.PAP_TOO_LARGE}' WHEN n < 1000 THEN {_pap('n')}
  ELSE CASE WHEN n // 1000 = 1 THEN 'mil' ELSE {_pap('(n // 1000)')} || ' mil' END || CASE WHEN n % 1000 = 0 THEN '' ELSE ' ' || {_pap('(n % 1000)')} END END AS spoken FROM {_INTS}""")
def num_words_pap(spark, t):
    return t("orders").select("o_orderkey", (F.col("o_orderkey") * 37 % 1000100).alias("n")).withColumn("spoken", numbers.int_to_papiamentu(F.col("n")))


_BRAND = "regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g')"


@query(f"""
SELECT p_partkey, coalesce(lower(p_name) = {_BRAND} OR lower(p_name) = lower(p_brand) OR {_SIM.format(a='p_brand', b='lower(p_name)')} > 0.4, false) AS matches FROM part""")
def token_match(spark, t):
    brand = F.lower("p_brand")
    number = F.lit(None).cast("string")
    return t("part").select("p_partkey", text.token_matches(F.col("p_brand"), brand, F.lower("p_name"), number, number).alias("matches"))


_SPOKEN = f"(SELECT o_orderkey, o_orderpriority, n, {_es('n')} AS es, {_pap('n')} AS pap FROM (SELECT o_orderkey, o_orderpriority, CAST(o_orderkey * 37 % 1000 AS BIGINT) AS n FROM orders))"
_HEARD = "CASE o_orderkey % 4 WHEN 0 THEN es WHEN 1 THEN pap WHEN 2 THEN substring(es, 3) ELSE lower(o_orderpriority) END"


@query(f"""
SELECT o_orderkey, coalesce({_SIM.format(a='es', b='heard')} > 0.55 OR {_SIM.format(a='pap', b='heard')} > 0.55, false) AS matches
FROM (SELECT *, {_HEARD} AS heard FROM {_SPOKEN})""")
def digit_match(spark, t):
    """Digits against the token that was heard for them, by their words in two languages."""
    n = (F.col("o_orderkey") * 37 % 1000).cast("long")
    said = t("orders").select("o_orderkey", "o_orderpriority", n.cast("string").alias("word"), numbers.int_to_spanish(n).alias("es"), numbers.int_to_papiamentu(n).alias("pap"))
    heard = F.when(F.col("o_orderkey") % 4 == 0, F.col("es")).when(F.col("o_orderkey") % 4 == 1, F.col("pap")).when(F.col("o_orderkey") % 4 == 2, F.col("es").substr(F.lit(3), F.length("es"))).otherwise(F.lower("o_orderpriority"))
    return said.select("o_orderkey", text.token_matches(F.col("word"), F.col("word"), heard, F.col("es"), F.col("pap")).alias("matches"))


def _mark(c: str) -> str:
    return rf"(length({c}) <= 4 AND NOT regexp_matches({c}, '[\p{{L}}\p{{N}}\p{{M}}]'))"


_CUT_SQL = rf"""string_split(list_reduce(string_split(regexp_replace(text, '([.!?…])\s+', '\1' || chr(1), 'g'), chr(1)), lambda acc, p:
  acc || CASE WHEN {_mark('p')} OR {_mark("regexp_extract(acc, '[^' || chr(1) || ']*$')")} THEN ' ' ELSE chr(1) END || p), chr(1))"""


@query(f"""
SELECT doc_id, CAST(k AS BIGINT) AS sentence_num, s[k] AS sentence FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS k FROM (
  SELECT doc_id, {_CUT_SQL} AS s FROM documents))""")
def sentence_split(spark, t):
    return t("documents").select("doc_id", F.posexplode(text.sentences(F.col("text"))).alias("at", "sentence")).select("doc_id", (F.col("at") + 1).cast("long").alias("sentence_num"), "sentence")


_SENTENCES = f"""(SELECT doc_id, source, k, s[k] AS sentence FROM (SELECT doc_id, source, s, unnest(range(1, len(s) + 1)) AS k FROM (
  SELECT doc_id, source, {_CUT_SQL} AS s FROM documents)))"""


@query(f"""
SELECT doc_id, CAST(k AS BIGINT) AS utterance_num, sentence AS punctuated_text, {_NORMAL_SQL} AS unpunctuated_text, CAST(length(sentence) AS BIGINT) AS n_samples, round(length(sentence) / 16000 * 1000, 6) AS duration_ms
FROM (SELECT doc_id, k, sentence, string_split(' ' || sentence || ' ', '') AS l FROM {_SENTENCES})""")
def utterances(spark, t):
    cut = t("documents").select("doc_id", F.posexplode(text.sentences(F.col("text"))).alias("at", "sentence"))
    size = F.length("sentence").cast("long")
    return cut.select(
        "doc_id", (F.col("at") + 1).cast("long").alias("utterance_num"), F.col("sentence").alias("punctuated_text"), text.normalize_text(F.col("sentence")).alias("unpunctuated_text"),
        size.alias("n_samples"), F.round(tables.duration_ms(size), 6).alias("duration_ms"),
    )


@query(f"""
SELECT {_SPLIT_SQL} AS split, count(*) AS n_utterances, count(DISTINCT source) AS n_speakers, round(avg(length(unpunctuated)), 6) AS mean_length, round(sum(length(sentence)) / 16000 * 1000, 6) AS total_ms
FROM (SELECT source, sentence, {_NORMAL_SQL} AS unpunctuated FROM (SELECT source, sentence, string_split(' ' || sentence || ' ', '') AS l FROM {_SENTENCES})) GROUP BY 1""")
def split_summary(spark, t):
    """Documents to normalised utterances with speakers and splits, summed up by split."""
    cut = t("documents").select("source", F.explode(text.sentences(F.col("text"))).alias("sentence"))
    spoken = cut.select("source", text.normalize_text(F.col("sentence")).alias("unpunctuated"), F.length("sentence").alias("n_samples"))
    assigned = spoken.join(splits(spark), "source", "left")
    return assigned.groupBy("split").agg(
        F.count("*").alias("n_utterances"), F.count_distinct("source").alias("n_speakers"), F.round(F.avg(F.length("unpunctuated")), 6).alias("mean_length"), F.round(tables.duration_ms(F.sum("n_samples")), 6).alias("total_ms"),
    )


_VERSE_SQL = r"list_filter(string_split(regexp_replace(text, '([.!?…])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_matches(x, '[a-z]'))"


@query(rf"""
SELECT doc_id, CAST(k AS INTEGER) AS verse, array_to_string(list_filter(string_split_regex(s[k], '\s+'), lambda w: w <> ''), ' ') AS verse_text
FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS k FROM (SELECT doc_id, {_VERSE_SQL} AS s FROM documents))""")
def page_verses(spark, t):
    """Sentences set as chapter pages, as numbered elements and texts, and read from them again."""
    from speechmill.sources.verse_html import verses

    def escaped(c):
        return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))

    said = F.filter(F.split("text", r"(?<=[.!?…])\s+"), lambda x: x.rlike("[a-z]"))
    verse = F.transform(said, lambda x, i: F.concat(F.lit("<p><sup>"), (i + 1).cast("string"), F.lit("</sup><span> "), escaped(F.array_join(text.words(x), " ")), F.lit("</span></p>")))
    html = F.concat(F.lit("<html><body><div class='justify x'><span>7</span>"), F.array_join(verse, ""), F.lit("</div><div class='justify'><span>1</span></div></body></html>"))
    pages = t("documents").where(F.size(said) > 0).select("doc_id", html.alias("html"))
    return verses(pages, "doc_id").where("problem is null").select("doc_id", "verse", "verse_text")
