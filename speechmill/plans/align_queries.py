"""Alignment, spans and utterances on conversations standing in for chapters."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from speechmill.functions import text
from speechmill.operators import align
from speechmill.plans.base import query
from speechmill.plans.table_queries import _WORDS_SQL


def _chapters(t):
    """Turns as excerpts, and an alignment in which every word takes 8 samples, 10 after the last."""
    turns = t("conversations").where("text is not null")
    excerpts = turns.select(F.col("conv_id").cast("string").alias("slug"), F.col("turn").alias("excerpt"), F.col("turn").alias("verse"), "text")
    w = Window.partitionBy("slug").orderBy("excerpt", "text").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.size(text.words(F.col("text")))).over(w), F.lit(0))
    rows = excerpts.select("slug", "text", before.alias("before")).select("slug", "before", F.posexplode(text.words(F.col("text"))).alias("at", "word")).select("slug", "word", (F.col("before") + F.col("at")).alias("row_idx"))
    return excerpts, rows.select("slug", "row_idx", (F.col("row_idx") * 10).cast("long").alias("begin"), F.lit(8).cast("long").alias("duration"), F.col("row_idx").alias("token"), text.strip_nonletters(text.normalize_text(F.col("word"))).alias("ort"))


_SPANS = f"""
SELECT CAST(conv_id AS VARCHAR) AS slug, turn AS verse, len(w) AS n_words,
  10 * CAST(coalesce(sum(len(w)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_begin, 8 * len(w) AS n_samples
FROM (SELECT conv_id, turn, {_WORDS_SQL} AS w FROM conversations WHERE text IS NOT NULL) WHERE len(w) > 0"""


@query(_SPANS)
def aligned_spans(spark, t):
    spans, _ = align.align(*_chapters(t))
    said = F.filter("tokens", lambda x: x["kind"] == "word")
    return spans.select("slug", "verse", F.size(said).cast("long").alias("n_words"), said[0]["begin"].alias("first_begin"), F.aggregate(said, F.lit(0).cast("long"), lambda s, x: s + x["len"]).alias("n_samples"))


@query(r"""
SELECT slug, verse, count(*) AS n_utterances, CAST(sum(n) AS BIGINT) AS n_samples FROM (
  SELECT CAST(conv_id AS VARCHAR) AS slug, turn AS verse, 8 * len(list_filter(string_split_regex(trim(u, ' '), '\s+'), lambda w: w <> '')) AS n FROM (
    SELECT conv_id, turn, unnest(string_split(regexp_replace(text, '([.!?…])\s+', '\1' || chr(1), 'g'), chr(1))) AS u FROM conversations WHERE text IS NOT NULL) WHERE trim(u, ' ') <> '')
GROUP BY ALL""")
def span_utterances(spark, t):
    spans, _ = align.align(*_chapters(t))
    return align.utterances(spans).groupBy("slug", "verse").agg(F.count("*").alias("n_utterances"), F.sum("n_samples").alias("n_samples"))
