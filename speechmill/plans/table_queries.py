"""Scans, filters, joins, lookups, ids, splits and set operations on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from speechmill.functions import text
from speechmill.operators import tables
from speechmill.plans.base import query
from speechmill.sources import readers, sinks

#: split by source; src19 is in none
SPLIT_OF = {f"src{i}": "train" if i < 12 else "dev" if i < 16 else "test" for i in range(19)}
_SPLIT_SQL = "CASE WHEN source = 'src19' OR source IS NULL THEN NULL WHEN CAST(substr(source, 4) AS INT) < 12 THEN 'train' WHEN CAST(substr(source, 4) AS INT) < 16 THEN 'dev' ELSE 'test' END"


def splits(spark):
    return spark.createDataFrame(list(SPLIT_OF.items()), "source string, split string")


@query("SELECT count(*) AS n_rows, CAST(sum(n_chars) AS BIGINT) AS n_chars, count(DISTINCT source) AS n_sources FROM documents")
def scan_count(spark, t):
    return t("documents").agg(F.count("*").alias("n_rows"), F.sum("n_chars").alias("n_chars"), F.count_distinct("source").alias("n_sources"))


@query(f"SELECT 'corpus_audio/' || doc_id || '.wav' AS audio, text AS transcript, {_SPLIT_SQL} AS split FROM documents WHERE {_SPLIT_SQL} IS NOT NULL")
def export_split(spark, t):
    corpus = t("documents").join(splits(spark), "source", "left").select(F.concat(F.col("doc_id").cast("string"), F.lit(".wav")).alias("file_name"), F.col("text").alias("unpunctuated_text"), F.col("split").alias("train_dev_test_split"))
    return sinks.export_table(corpus)


@query("""
SELECT doc_id, CAST(k AS BIGINT) AS utterance_num, trim(lines[k], ' ') AS line FROM (
  SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS k FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents))
WHERE trim(lines[k], ' ') <> ''""")
def ready_lines(spark, t):
    return readers.numbered_lines(t("documents"), "doc_id", "text").withColumn("utterance_num", F.col("utterance_num").cast("long"))


@query("SELECT page_id, CAST(strlen(html) AS BIGINT) AS n_bytes FROM pages WHERE strlen(html) >= 10000")
def page_gate(spark, t):
    return readers.complete_pages(t("pages")).select("page_id", F.octet_length("html").cast("long").alias("n_bytes"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def pending_work(spark, t):
    return tables.pending(t("documents").select("doc_id"), t("labels"), "doc_id")


@query("""
SELECT book || '_' || (c_custkey % 120) AS slug, 'B' || printf('%02d', n_nationkey) || '___' || printf('%02d', c_custkey % 120) || '_' || book || '.mp3' AS path
FROM customer JOIN (SELECT n_nationkey, replace(n_name, '_', '-') AS book FROM nation) ON c_nationkey = n_nationkey""")
def slug_paths(spark, t):
    nation = t("nation").withColumn("book", F.replace("n_name", F.lit("_"), F.lit("-")))
    books = nation.select("book", F.concat(F.format_string("B%02d___{ch:02d}_", "n_nationkey"), "book", F.lit(".mp3")).alias("pattern"))
    slugs = t("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat_ws("_", "book", (F.col("c_custkey") % 120).cast("string")).alias("slug"))
    return readers.slug_paths(slugs, books)


@query("SELECT doc_id, lang FROM documents WHERE doc_id < 500 AND lang = 'en'")
def id_range(spark, t):
    return t("documents").where((F.col("doc_id") < 500) & (F.col("lang") == "en")).select("doc_id", "lang")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def anti_bad_ids(spark, t):
    return tables.drop_listed(t("documents").select("doc_id"), t("labels").where("toxic = 1"), "doc_id")


@query("SELECT doc_id, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def semi_known_ids(spark, t):
    return tables.keep_listed(t("documents").select("doc_id", "n_chars"), t("labels").where("quality = 1"), "doc_id")


@query("SELECT doc_id, contains(source, '1') AS has_one FROM documents")
def contains_flag(spark, t):
    return t("documents").select("doc_id", F.contains("source", F.lit("1")).alias("has_one"))


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def isin_filter(spark, t):
    return t("customer").where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select("c_custkey", "c_mktsegment")


@query(f"SELECT doc_id, source AS speaker, {_SPLIT_SQL} AS split FROM documents")
def split_assignment(spark, t):
    return t("documents").join(splits(spark), "source", "left").select("doc_id", F.col("source").alias("speaker"), "split")


@query("SELECT c_custkey, n_name AS speaker, n_regionkey % 2 = 0 AS speaker_is_male FROM customer JOIN nation ON c_nationkey = n_nationkey")
def speaker_enrich(spark, t):
    speakers = t("nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("speaker"), (F.col("n_regionkey") % 2 == 0).alias("speaker_is_male"))
    return tables.lookup(t("customer").select("c_custkey", F.col("c_nationkey").alias("key")), speakers, "key", strict=True).select("c_custkey", "speaker", "speaker_is_male")


@query("""
SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN source ELSE lang END AS speaker, (CASE WHEN doc_id % 3 = 2 THEN source ELSE lang END) = '' AS speaker_was_inferred FROM documents""")
def speaker_coalesce(spark, t):
    known = F.when(F.col("doc_id") % 3 == 0, "").when(F.col("doc_id") % 3 == 1, F.lit(None)).otherwise(F.col("source"))
    speaker = tables.known_speaker(known, F.col("lang"))
    return t("documents").select("doc_id", speaker.alias("speaker"), (speaker == "").alias("speaker_was_inferred"))


@query("SELECT doc_id, CASE WHEN source = 'src1' THEN 'test' WHEN quality = 0 THEN 'dev' ELSE 'train' END AS split FROM documents LEFT JOIN labels USING (doc_id)")
def diarized_split(spark, t):
    rows = t("documents").select("doc_id", "source").join(t("labels"), "doc_id", "left")
    return rows.select("doc_id", tables.split_of(F.col("source") == "src1", F.col("quality"), 0).alias("split"))


@query("""
SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'Guest Reader' ELSE 'author: ' || upper(lang[1]) || lower(lang[2:]) END AS author FROM documents""")
def author_label(spark, t):
    speaker = F.when(F.col("doc_id") % 4 == 0, "Guest Reader").otherwise(F.concat(F.lit("male_"), "lang", F.lit("_main")))
    label = tables.author(speaker)
    return t("documents").select("doc_id", F.when(speaker == "Guest Reader", label).otherwise(F.concat(F.lit("author: "), label)).alias("author"))


@query("""
SELECT conv_id, turn, CASE WHEN conv_id % 7 = 0 THEN NULL WHEN turn = 0 THEN 'narrator' ELSE role || '_main' END AS speaker FROM conversations""")
def principal_speaker(spark, t):
    verse = F.when(F.col("conv_id") % 7 == 0, F.lit(None).cast("long")).otherwise(F.col("turn"))
    return t("conversations").select("conv_id", "turn", tables.principal_speaker(verse, F.concat("role", F.lit("_main")), "narrator").alias("speaker"))


@query("""
WITH l AS (SELECT doc_id, 'q' || quality || 't' || toxic AS label FROM labels),
s AS (SELECT label, count(*) AS n FROM l GROUP BY 1)
SELECT d.doc_id, coalesce(CASE WHEN n >= 30 THEN label ELSE '_other_' END, '_rest_') AS label
FROM documents d LEFT JOIN (SELECT doc_id, label, n FROM l JOIN s USING (label)) x ON d.doc_id = x.doc_id""".replace("coalesce(CASE WHEN n >= 30 THEN label ELSE '_other_' END, '_rest_')", "CASE WHEN x.label IS NULL THEN '_rest_' WHEN n >= 30 THEN label ELSE '_other_' END"))
def label_recode(spark, t):
    labels = t("labels").select("doc_id", F.format_string("q%dt%d", "quality", "toxic").alias("label"))
    return tables.label_with_floor(t("documents").select("doc_id"), labels, "doc_id", floor=30)


@query("SELECT l_orderkey, l_linenumber, CAST('1' || printf('%02d', l_suppkey % 27 + 1) || printf('%02d', l_linenumber) || printf('%02d', CAST(l_quantity AS INT)) || printf('%02d', l_partkey % 130) AS BIGINT) AS utterance_id FROM lineitem")
def utterance_id(spark, t):
    ids = tables.scripture_id(F.col("l_suppkey") % 27 + 1, F.col("l_linenumber"), F.col("l_quantity"), F.col("l_partkey") % 130)
    return t("lineitem").select("l_orderkey", "l_linenumber", ids.alias("utterance_id"))


@query("SELECT doc_id, 199999999 + row_number() OVER (ORDER BY doc_id) AS utterance_id FROM documents")
def running_id(spark, t):
    return tables.dense_numbers(t("documents").select("doc_id"), "doc_id", "utterance_id", start=200_000_000)


@query("SELECT doc_id, round(n_chars / 16000 * 1000, 6) AS duration_ms FROM documents")
def duration_ms(spark, t):
    return t("documents").select("doc_id", F.round(tables.duration_ms(F.col("n_chars")), 6).alias("duration_ms"))


@query("SELECT d.doc_id, CAST(quality AS BIGINT) AS diarized_speaker FROM documents d LEFT JOIN labels USING (doc_id)")
def left_join_cluster(spark, t):
    one = tables.first_by_key(t("labels"), "doc_id", F.col("quality"), F.col("toxic"))
    return t("documents").select("doc_id").join(one, "doc_id", "left").select("doc_id", F.col("quality").cast("long").alias("diarized_speaker"))


_WORDS_SQL = "list_filter(string_split_regex(trim(text, ' '), '\\s+'), lambda w: w <> '')"


@query(f"""
WITH a AS (SELECT doc_id AS id, {_WORDS_SQL} AS w FROM documents), b AS (SELECT item_id AS id, {_WORDS_SQL} AS w FROM benchmark),
x AS (SELECT id, w, unnest(range(1, len(w) + 1)) AS at FROM a), y AS (SELECT id, w, unnest(range(1, len(w) + 1)) AS at FROM b)
SELECT x.id, CAST(x.at - 1 AS BIGINT) AS place, x.w[x.at] AS word, y.w[y.at] AS token FROM x JOIN y ON x.id = y.id AND x.at = y.at""")
def zip_join(spark, t):
    # the word lists meet by id; only then, and only of ids on both sides, are they taken apart
    a = t("documents").select(F.col("doc_id").alias("id"), text.words(F.col("text")).alias("word"))
    b = t("benchmark").select(F.col("item_id").alias("id"), text.words(F.col("text")).alias("token"))
    n = F.least(F.size("word"), F.size("token"))
    both = a.join(b, "id").select("id", F.posexplode(F.arrays_zip(F.slice("word", F.lit(1), n).alias("word"), F.slice("token", F.lit(1), n).alias("token"))).alias("place", "x"))
    return both.select("id", F.col("place").cast("long").alias("place"), "x.word", "x.token")


@query("""
WITH u AS (SELECT doc_id, 1 AS part, lang FROM documents WHERE doc_id < 600 UNION ALL SELECT doc_id, 2, source FROM documents WHERE doc_id >= 400)
SELECT doc_id, label FROM (SELECT doc_id, lang AS label, row_number() OVER (PARTITION BY doc_id ORDER BY part, lang) AS k FROM u) WHERE k = 1""")
def union_dedup(spark, t):
    docs = t("documents")
    both = docs.where("doc_id < 600").select("doc_id", F.lit(1).alias("part"), F.col("lang").alias("label")).unionByName(docs.where("doc_id >= 400").select("doc_id", F.lit(2).alias("part"), F.col("source").alias("label")))
    return tables.first_by_key(both, "doc_id", F.col("part"), F.col("label")).select("doc_id", "label")


@query("SELECT user_id, event_type FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k = 1")
def last_wins(spark, t):
    # max_by is combined before the shuffle, unlike a window
    return t("events").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("event_type"))


@query("SELECT doc_id, CAST(doc_id AS BIGINT) AS begin_1, CAST(n_chars // 2 AS BIGINT) AS len_1, CAST(doc_id + n_chars // 2 AS BIGINT) AS begin_2, CAST(n_chars - n_chars // 2 AS BIGINT) AS len_2 FROM documents")
def bisect_interval(spark, t):
    from speechmill.operators.align import bisect

    a, b = bisect(F.col("doc_id"), F.col("n_chars"))
    return t("documents").select("doc_id", a["begin"].alias("begin_1"), a["len"].alias("len_1"), b["begin"].alias("begin_2"), b["len"].alias("len_2"))


@query("SELECT page_id, CAST(len(p) AS BIGINT) AS n_paragraphs, array_to_string(p, chr(10)) AS paragraphs FROM (SELECT page_id, regexp_extract_all(html, '<p>([^<]*)</p>', 1) AS p FROM pages)")
def page_paragraphs(spark, t):
    p = F.regexp_extract_all("html", F.lit("<p>([^<]*)</p>"), F.lit(1))
    return t("pages").select("page_id", F.size(p).cast("long").alias("n_paragraphs"), F.array_join(p, "\n").alias("paragraphs"))
