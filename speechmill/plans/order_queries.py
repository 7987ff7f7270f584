"""Runs, offsets, numbering and ordered texts on the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from speechmill.functions import text
from speechmill.operators import ordered
from speechmill.plans.base import query
from speechmill.plans.table_queries import _WORDS_SQL
from speechmill.streaming.assign import windowed_counts


@query("SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) || chr(10) AS text FROM conversations WHERE role <> 'system' GROUP BY 1")
def chapter_text(spark, t):
    return ordered.texts_in_order(t("conversations").where("role <> 'system'"), ["conv_id"], "turn", "text")


@query("SELECT conv_id, role, min(turn) AS first_place, count(*) AS n_rows FROM conversations GROUP BY ALL")
def chapter_slugs(spark, t):
    return ordered.groups_by_first(t("conversations"), ["conv_id", "role"], "turn")


@query("""
WITH f AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER w THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) - 1 AS run FROM f)
SELECT user_id, CAST(run AS BIGINT) AS run, min(event_type) AS event_type, count(*) AS n_rows, arg_min(event_id, (ts, event_id)) AS first_event, arg_max(event_id, (ts, event_id)) AS last_event FROM r GROUP BY user_id, run""")
def token_runs(spark, t):
    runs = ordered.run_bounds(t("events"), ["user_id"], ["ts", "event_id"], "event_type", F.col("event_id"), F.col("event_id"))
    return runs.select("user_id", F.col("run").cast("long").alias("run"), "event_type", "n_rows", F.col("begin").alias("first_event"), F.col("end").alias("last_event"))


@query(f"""
SELECT conv_id, turn, CAST(coalesce(sum(len({_WORDS_SQL})) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_word FROM conversations""")
def verse_offsets(spark, t):
    size = F.size(text.words(F.col("text")))
    return t("conversations").select("conv_id", "turn", ordered.running_offset(None, ["conv_id"], ["turn"], size).alias("start_word"))


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS utterance_num FROM conversations WHERE role <> 'system'")
def utterance_numbering(spark, t):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return t("conversations").where("role <> 'system'").select("conv_id", "turn", F.row_number().over(w).cast("long").alias("utterance_num"))


@query("""
SELECT conv_id, bool_and(ok) AS increasing FROM (
  SELECT conv_id, CASE WHEN p IS NULL THEN turn = 1 ELSE turn > p END AS ok FROM (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations WHERE role <> 'system'))
GROUP BY 1""")
def strictly_increasing(spark, t):
    return ordered.counts_from_one(t("conversations").where("role <> 'system'"), "conv_id", "turn", "turn")


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def window_counts(spark, t):
    """The streaming aggregate on a table; the tests run it on a stream."""
    return windowed_counts(t("events")).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))
