"""Clusters against labels: modes, F1, confusion, clustering itself, choice of the best run."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mode_clusters(df: DataFrame, label: str, cluster: str, noise: int = -1) -> DataFrame:
    """(label, mode_cluster): the most frequent cluster of a label other than noise, ties to the smallest."""
    sizes = df.where(F.col(cluster) != noise).groupBy(label, cluster).agg(F.count("*").alias("n"))
    w = Window.partitionBy(label).orderBy(F.desc("n"), cluster)
    return sizes.withColumn("_k", F.row_number().over(w)).where("_k = 1").select(label, F.col(cluster).alias("mode_cluster"))


def cluster_f1(df: DataFrame, label: str, cluster: str, other: str = "_other_") -> DataFrame:
    """(label, tp, fp, fn, f1) of each label against its mode cluster, over rows with a label."""
    df = df.where(F.col(label).isNotNull())
    cells = df.groupBy(label, cluster).agg(F.count("*").alias("n"))
    per_label, per_cluster = cells.groupBy(label).agg(F.sum("n").alias("of_label")), cells.groupBy(cluster).agg(F.sum("n").alias("of_cluster"))
    modes = mode_clusters(df, label, cluster).where(F.col(label) != other)
    hit = cells.withColumnRenamed(cluster, "mode_cluster").withColumnRenamed("n", "tp")
    out = modes.join(hit, [label, "mode_cluster"]).join(per_label, label).join(per_cluster.withColumnRenamed(cluster, "mode_cluster"), "mode_cluster")
    fp, fn = F.col("of_label") - F.col("tp"), F.col("of_cluster") - F.col("tp")
    return out.select(label, "mode_cluster", F.col("tp").cast("long").alias("tp"), fp.cast("long").alias("fp"), fn.cast("long").alias("fn"), (F.col("tp") / (F.col("tp") + 0.5 * (fp + fn))).alias("f1"))


def confusion(df: DataFrame, truth: Column, found: Column) -> DataFrame:
    """One row: tp, tn, fp, fn and f1 of two flags (null counts as false)."""
    t, p = F.coalesce(truth, F.lit(False)), F.coalesce(found, F.lit(False))
    counts = df.agg(*[F.count_if(c).alias(n) for n, c in (("tp", t & p), ("tn", ~t & ~p), ("fp", ~t & p), ("fn", t & ~p))])
    return counts.withColumn("f1", F.try_divide(F.col("tp").cast("double"), F.col("tp") + 0.5 * (F.col("fp") + F.col("fn"))))


def best_run(runs: Iterable[dict], run: Callable[[dict], tuple[float, DataFrame]]) -> tuple[dict, float, DataFrame]:
    """The parameters, score and result of the first run with the highest score; raises if none is above 0."""
    best = None
    for parameters in runs:
        score, result = run(parameters)
        if score > (best[1] if best else 0.0):
            best = (parameters, score, result)
    if best is None:
        raise ValueError("no run scored above 0")
    return best


def kmeans(df: DataFrame, vector: str, k: int, seed: int = 50, rounds: int = 20) -> DataFrame:
    """Adds ``cluster`` by k-means of Spark's ML library, whose work is spread over tasks."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    data = df.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    model = KMeans(k=k, seed=seed, maxIter=rounds, featuresCol="_v", predictionCol="cluster").fit(data)
    return model.transform(data).drop("_v")


def project(df: DataFrame, vector: str, dimensions: int, out_col: str = "projected") -> DataFrame:
    """Principal components, standing in for manifold projections."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    data = df.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    return PCA(k=dimensions, inputCol="_v", outputCol="_p").fit(data).transform(data).withColumn(out_col, vector_to_array("_p")).drop("_v", "_p")


def importances(df: DataFrame, vector: str, label: str, weight: str | None = None, rounds: int = 100, penalty: float = 0.01) -> np.ndarray:
    """Mean absolute coefficient of each dimension in a multinomial logistic regression, scaled to 0..1."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StringIndexer
    from pyspark.ml.functions import array_to_vector

    data = df.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    data = StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc").fit(data).transform(data)
    lr = LogisticRegression(featuresCol="_v", labelCol="_y", family="multinomial", maxIter=rounds, regParam=penalty)
    model = (lr.setWeightCol(weight) if weight else lr).fit(data)
    size = np.abs(model.coefficientMatrix.toArray()).mean(axis=0)
    return (size - size.min()) / max(size.max() - size.min(), 1e-12)


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, weight): total / (number of classes * size of the class)."""
    sizes = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n").alias("_t"), F.count("*").alias("_c"))
    return sizes.join(F.broadcast(total)).select(label, "n", (F.col("_t") / (F.col("_c") * F.col("n"))).alias("weight"))


MAX_SPECTRAL_POINTS = 8000


def _refined(affinity: np.ndarray, percentile: float, blur: float, multiplier: float) -> np.ndarray:
    """An affinity matrix after blurring, row-wise thresholding, symmetrisation, diffusion and scaling."""
    n = len(affinity)
    a = affinity.copy()
    np.fill_diagonal(a, 0)
    np.fill_diagonal(a, a.max(axis=1))
    radius = max(1, int(4 * blur + 0.5))
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / blur) ** 2)
    kernel /= kernel.sum()
    for axis in (0, 1):
        a = np.apply_along_axis(lambda r: np.convolve(np.pad(r, radius, mode="symmetric" if n > radius else "edge"), kernel, "valid"), axis, a)
    keep = a >= percentile * a.max(axis=1, keepdims=True)
    a = np.where(keep, a, a * multiplier)
    a = np.maximum(a, a.T)
    a = a @ a.T
    return a / np.maximum(a.max(axis=1, keepdims=True), 1e-12)


def spectral_labels(x: np.ndarray, low: int = 14, high: int = 50, percentile: float = 0.89, blur: float = 0.218, multiplier: float = 0.12, seed: int = 50) -> np.ndarray:
    """Spectral clusters of at most MAX_SPECTRAL_POINTS points; their number is where the gap between
    neighbouring eigenvalues is widest, between ``low`` and ``high``."""
    if len(x) > MAX_SPECTRAL_POINTS:
        raise ValueError(f"{len(x)} points; spectral clustering takes {MAX_SPECTRAL_POINTS}, use kmeans beyond")
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    a = _refined((unit @ unit.T + 1) / 2, percentile, blur, multiplier)
    values, vectors = np.linalg.eigh((a + a.T) / 2)
    order = np.argsort(values)[::-1]
    values, vectors = values[order], vectors[:, order]
    high = min(high, len(x) - 1)
    low = min(low, high)
    ratios = values[low - 1 : high] / np.maximum(values[low : high + 1], 1e-12)
    k = low + int(np.argmax(ratios))
    points = vectors[:, :k]
    rng = np.random.default_rng(seed)
    centres = points[[rng.integers(len(points))]]
    while len(centres) < k:
        gap = ((points[:, None] - centres[None]) ** 2).sum(axis=2).min(axis=1)
        centres = np.vstack([centres, points[int(gap.argmax())]])
    for _ in range(100):
        label = ((points[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        new = np.stack([points[label == c].mean(axis=0) if (label == c).any() else centres[c] for c in range(k)])
        if np.allclose(new, centres):
            break
        centres = new
    return label


def spectral(df: DataFrame, key: str, vector: str, **parameters) -> DataFrame:
    """Adds ``cluster``; the points are counted before they are brought to the driver."""
    n = df.count()
    if n > MAX_SPECTRAL_POINTS:
        raise ValueError(f"{n} points; spectral clustering takes {MAX_SPECTRAL_POINTS}, use kmeans beyond")
    rows = sorted(df.select(key, vector).collect(), key=lambda r: r[0])
    found = spectral_labels(np.array([r[1] for r in rows], dtype=float), **parameters)
    table = df.sparkSession.createDataFrame([(r[0], int(c)) for r, c in zip(rows, found)], f"{key} long, cluster int")
    return df.join(table, key)


def discriminant_axes(df: DataFrame, vector: str, label: str, dimensions: int, ridge: float = 1e-3) -> np.ndarray:
    """[input, output]: the linear discriminant axes of labelled vectors. Sums, counts and products are
    summed in tasks, each of which returns one row a label and one of products; the matrices have the size of the vectors."""
    cells = df.where(F.col(label).isNotNull()).select(F.col(label).cast("string").alias("label"), F.col(vector).cast("array<double>").alias("v"))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products, by = None, {}
        for b in batches:
            if not b.num_rows:
                continue
            x = np.asarray(b.column("v").flatten()).reshape(b.num_rows, -1)
            products = x.T @ x if products is None else products + x.T @ x
            labels = np.array(b.column("label").to_pylist())
            for name in np.unique(labels):
                some = x[labels == name]
                s, n = by.get(name, (0.0, 0))
                by[name] = (s + some.sum(axis=0), n + len(some))
        if products is not None:
            rows = [(None, 0, products.tobytes()), *((str(k), n, s.tobytes()) for k, (s, n) in by.items())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.binary()))], names=["label", "n", "part"])

    total, sums_by = 0.0, {}
    for r in cells.mapInArrow(sums, "label string, n long, part binary").toLocalIterator():
        part = np.frombuffer(bytes(r["part"]))
        if r["label"] is None:
            size = int(len(part) ** 0.5)
            total = total + part.reshape(size, size)
        else:
            s, n = sums_by.get(r["label"], (0.0, 0))
            sums_by[r["label"]] = (s + part, n + r["n"])
    by = {k: (s / n, n) for k, (s, n) in sums_by.items()}
    n = sum(c for _, c in by.values())
    grand = sum(m * c for m, c in by.values()) / n
    between = sum(c * np.outer(m - grand, m - grand) for m, c in by.values())
    within = total - sum(c * np.outer(m, m) for m, c in by.values())
    low = np.linalg.cholesky(within + ridge * np.trace(within) / size * np.eye(size))
    inverse = np.linalg.inv(low)
    values, vectors = np.linalg.eigh(inverse @ between @ inverse.T)
    return inverse.T @ vectors[:, np.argsort(values)[::-1][:dimensions]]


def shuffled_take(df: DataFrame, n: int, seed: int) -> DataFrame:
    """``n`` rows in random order; the limit is the feature."""
    return df.orderBy(F.rand(seed)).limit(n)
