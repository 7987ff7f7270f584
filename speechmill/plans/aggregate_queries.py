"""Aggregates, labels against clusters and vectors on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from speechmill.operators import clusters, vectors
from speechmill.plans.base import query


@query("""
SELECT count(n_chars) AS n, round(avg(n_chars), 6) AS mean, round(stddev_samp(n_chars), 6) AS std, min(n_chars) AS least, round(quantile_cont(n_chars, 0.25), 6) AS q25,
  round(quantile_cont(n_chars, 0.5), 6) AS q50, round(quantile_cont(n_chars, 0.75), 6) AS q75, max(n_chars) AS most, CAST(sum(n_chars) AS BIGINT) AS total FROM documents""")
def duration_describe(spark, t):
    q = F.percentile("n_chars", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = t("documents").agg(F.count("n_chars").alias("n"), F.avg("n_chars").alias("mean"), F.stddev_samp("n_chars").alias("std"), F.min("n_chars").alias("least"), q.alias("q"), F.max("n_chars").alias("most"), F.sum("n_chars").alias("total"))
    return out.select("n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "least", *[F.round(F.col("q")[i], 6).alias(n) for i, n in enumerate(("q25", "q50", "q75"))], "most", "total")


@query("""
SELECT CAST(quality AS BIGINT) AS cluster, lang AS author, count(*) AS num_utterances, round(avg(n_chars), 6) AS mean_uncertainty
FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND lang IS NOT NULL GROUP BY ALL""")
def cluster_author_agg(spark, t):
    rows = t("documents").join(t("labels"), "doc_id", "left").where("quality is not null and lang is not null")
    return rows.groupBy(F.col("quality").cast("long").alias("cluster"), F.col("lang").alias("author")).agg(F.count("*").alias("num_utterances"), F.round(F.avg("n_chars"), 6).alias("mean_uncertainty"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, event_type")
def value_counts(spark, t):
    return t("events").groupBy("event_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "event_type")


@query("SELECT source, count(*) AS n FROM documents GROUP BY 1")
def speaker_counts(spark, t):
    return t("documents").groupBy("source").agg(F.count("*").alias("n"))


_CLUSTERED = "(SELECT source AS label, CAST(n_chars % 7 - 1 AS INT) AS cluster FROM documents)"


def _clustered(t):
    return t("documents").select(F.col("source").alias("label"), (F.col("n_chars") % 7 - 1).cast("int").alias("cluster"))


_MODES = f"SELECT label, cluster AS mode_cluster FROM (SELECT label, cluster, row_number() OVER (PARTITION BY label ORDER BY n DESC, cluster) AS k FROM (SELECT label, cluster, count(*) AS n FROM {_CLUSTERED} WHERE cluster <> -1 GROUP BY 1, 2)) WHERE k = 1"
_F1 = f"""
WITH c AS (SELECT * FROM {_CLUSTERED}), m AS ({_MODES})
SELECT label, mode_cluster, tp, ol - tp AS fp, oc - tp AS fn, tp / (tp + 0.5 * (ol - tp + oc - tp)) AS f1 FROM (
  SELECT m.label, m.mode_cluster, (SELECT count(*) FROM c WHERE c.label = m.label AND c.cluster = m.mode_cluster) AS tp,
    (SELECT count(*) FROM c WHERE c.label = m.label) AS ol, (SELECT count(*) FROM c WHERE c.cluster = m.mode_cluster) AS oc FROM m WHERE m.label <> 'src0')"""


@query(_MODES)
def group_mode(spark, t):
    return clusters.mode_clusters(_clustered(t), "label", "cluster")


@query(f"SELECT label, mode_cluster, tp, fp, fn, round(f1, 6) AS f1 FROM ({_F1})")
def cluster_f1(spark, t):
    return clusters.cluster_f1(_clustered(t), "label", "cluster", other="src0").withColumn("f1", F.round("f1", 6))


@query(f"SELECT round(avg(f1), 6) AS macro_f1, count(*) AS n_labels FROM ({_F1})")
def macro_f1(spark, t):
    return clusters.cluster_f1(_clustered(t), "label", "cluster", other="src0").agg(F.round(F.avg("f1"), 6).alias("macro_f1"), F.count("*").alias("n_labels"))


@query("""
SELECT tp, tn, fp, fn, round(tp / (tp + 0.5 * (fp + fn)), 6) AS f1 FROM (
  SELECT count(*) FILTER (q AND p) AS tp, count(*) FILTER (NOT q AND NOT p) AS tn, count(*) FILTER (NOT q AND p) AS fp, count(*) FILTER (q AND NOT p) AS fn
  FROM (SELECT quality = 1 AS q, n_chars > 1000 AS p FROM documents JOIN labels USING (doc_id)))""")
def confusion(spark, t):
    rows = t("documents").join(t("labels"), "doc_id")
    return clusters.confusion(rows, F.col("quality") == 1, F.col("n_chars") > 1000).withColumn("f1", F.round("f1", 6))


@query("SELECT cluster, CAST(cluster AS VARCHAR) || chr(10) || string_agg(label, chr(10) ORDER BY label) AS labels FROM (SELECT DISTINCT cluster, label FROM %s) GROUP BY 1" % _CLUSTERED)
def cluster_labels(spark, t):
    named = F.concat_ws("\n", F.col("cluster").cast("string"), F.array_sort(F.collect_set("label")))
    return _clustered(t).groupBy("cluster").agg(named.alias("labels"))


@query("SELECT lang AS label, count(*) AS n, round((SELECT count(*) FROM documents) / ((SELECT count(DISTINCT lang) FROM documents) * count(*)), 6) AS weight FROM documents GROUP BY 1")
def class_weights(spark, t):
    return clusters.class_weights(t("documents").select(F.col("lang").alias("label")), "label").withColumn("weight", F.round("weight", 6))


@query("""
SELECT source, n, round(CASE WHEN hi = lo THEN NULL ELSE 0.45 + 2.55 * (n - lo) / (hi - lo) END, 6) AS height, round(CASE WHEN hi = lo THEN NULL ELSE 1 - 0.2 * (n - lo) / (hi - lo) END, 6) AS alpha,
  round(CASE WHEN hi = lo THEN NULL ELSE 55 - 15.0 * (n - lo) / (hi - lo) END, 6) AS size
FROM (SELECT source, count(*) AS n FROM documents GROUP BY 1), (SELECT min(n) AS lo, max(n) AS hi FROM (SELECT count(*) AS n FROM documents GROUP BY source))""")
def count_scaling(spark, t):
    """Heights, alphas and sizes of figures, from the smallest and the largest group."""
    counts = t("documents").groupBy("source").agg(F.count("*").alias("n"))
    bounds = counts.agg(F.min("n").alias("lo"), F.max("n").alias("hi"))  # one row
    at = F.try_divide((F.col("n") - F.col("lo")).cast("double"), F.col("hi") - F.col("lo"))
    rows = counts.join(F.broadcast(bounds))
    return rows.select("source", "n", F.round(0.45 + 2.55 * at, 6).alias("height"), F.round(1 - 0.2 * at, 6).alias("alpha"), F.round(55 - 15.0 * at, 6).alias("size"))


_CELLS = "(SELECT vec_id, label, unnest(range(0, 64)) AS pos, unnest(embedding) AS x FROM embeddings)"
_CENTRES = f"(SELECT label, pos, avg(CAST(x AS DOUBLE)) AS m FROM {_CELLS} GROUP BY ALL)"
_NEAREST = f"""(SELECT vec_id, min(d) AS distance, arg_min(label, (d, label)) AS nearest FROM (
  SELECT a.vec_id, c.label, sqrt(sum((a.x - c.m) * (a.x - c.m))) AS d FROM {_CELLS} a JOIN {_CENTRES} c ON a.pos = c.pos GROUP BY a.vec_id, c.label) GROUP BY 1)"""


@query(f"SELECT label, CAST(pos AS BIGINT) AS pos, round(m, 6) AS mean FROM {_CENTRES}")
def centroids(spark, t):
    return vectors.centroids(t("embeddings"), "label", "embedding").select("label", F.posexplode("centroid").alias("pos", "m")).select("label", F.col("pos").cast("long").alias("pos"), F.round("m", 6).alias("mean"))


def _near(t):
    e = t("embeddings")
    return vectors.nearest(e, "embedding", vectors.centroids(e, "label", "embedding"), "label")


@query(f"SELECT vec_id, CAST(nearest AS BIGINT) AS nearest, round(distance, 5) AS distance FROM {_NEAREST}")
def nearest_centroid(spark, t):
    return _near(t).select("vec_id", F.col("nearest").cast("long").alias("nearest"), F.round("distance", 5).alias("distance"))


@query(f"""
SELECT vec_id, round(u, 5) AS uncertainty FROM (SELECT vec_id, (distance - lo) / (hi - lo) AS u FROM {_NEAREST}, (SELECT min(distance) AS lo, max(distance) AS hi FROM {_NEAREST}))
WHERE u > 0.5 ORDER BY uncertainty DESC, vec_id""")
def uncertain_queue(spark, t):
    scaled = vectors.min_max(_near(t), "distance", "u")
    return scaled.where("u > 0.5").select("vec_id", F.round("u", 5).alias("uncertainty")).orderBy(F.desc("uncertainty"), "vec_id")


@query(f"""
SELECT vec_id, CAST(a.pos AS BIGINT) AS pos, round((x - m) / CASE WHEN s = 0 THEN 1 ELSE s END, 5) AS scaled
FROM {_CELLS} a JOIN (SELECT pos, avg(CAST(x AS DOUBLE)) AS m, stddev_pop(CAST(x AS DOUBLE)) AS s FROM {_CELLS} GROUP BY 1) b ON a.pos = b.pos""")
def standardize(spark, t):
    e = t("embeddings")
    out = vectors.standardize(e, "embedding", vectors.moments(e, "embedding"))
    return out.select("vec_id", F.posexplode("scaled").alias("pos", "x")).select("vec_id", F.col("pos").cast("long").alias("pos"), F.round("x", 5).alias("scaled"))


@query("SELECT s_suppkey, round((s_acctbal - lo) / (hi - lo), 6) AS scaled FROM supplier, (SELECT min(s_acctbal) AS lo, max(s_acctbal) AS hi FROM supplier)")
def minmax(spark, t):
    return vectors.min_max(t("supplier"), "s_acctbal", "scaled").select("s_suppkey", F.round("scaled", 6).alias("scaled"))


@query(f"SELECT vec_id, round(sum(x * 0.5 + x * (pos % 4 / 3) * 0.5), 5) AS weighted FROM {_CELLS} GROUP BY 1")
def importance_weight(spark, t):
    importance = F.lit([(p % 4) / 3 for p in range(64)])
    w = vectors.weigh("embedding", importance, 0.5)
    return t("embeddings").select("vec_id", F.round(F.aggregate(w, F.lit(0.0), lambda s, x: s + x), 5).alias("weighted"))


@query("SELECT doc_id, dense_rank() OVER (ORDER BY lang) - 1 AS code FROM documents")
def label_encode(spark, t):
    return vectors.encode_labels(t("documents").select("doc_id", "lang"), "lang", "code").select("doc_id", "code")


@query("SELECT vec_id, CAST(len(embedding) AS BIGINT) AS n, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 4) AS total FROM embeddings")
def vector_parse(spark, t):
    from speechmill.functions.text import format_vector, parse_vector

    parsed = parse_vector(format_vector(F.col("embedding")))
    return t("embeddings").select("vec_id", F.size(parsed).cast("long").alias("n"), F.round(F.aggregate(parsed, F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


@query()
def kmeans_clusters(spark, t):
    return clusters.kmeans(t("embeddings"), "embedding", 10).groupBy("cluster").agg(F.count("*").alias("n"))


@query()
def pca_projection(spark, t):
    out = clusters.project(t("embeddings"), "embedding", 2)
    return out.select("vec_id", F.round(F.abs(F.col("projected")[0]), 5).alias("x"), F.round(F.abs(F.col("projected")[1]), 5).alias("y"))


@query()
def seeded_sample(spark, t):
    """500 documents by a seeded hash: the limit is the feature."""
    return t("documents").select("doc_id").orderBy(F.xxhash64("doc_id", F.lit(50)), "doc_id").limit(500)
