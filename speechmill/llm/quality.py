"""Quality classifier: a byte-level convolutional network in numpy.

Learned filters of ``WIDTH`` bytes slide with stride ``STRIDE`` (so neighbouring windows overlap)
over the UTF-8 bytes of the whole document. Each filter is a table of one weight per tap and byte
value, which is a convolution over one-hot bytes done as look-ups. The responses are max-pooled in
chunks of ``CHUNK`` windows, which share the windows across their borders; the squashed chunk maxima are combined, as their mean and their
maximum over all chunks, into one probability. The padding after the end of a document is a byte value
with learned weights like any other: filters that answer to it tell how much of a document its last
chunk is, so short texts need no terms of their own. Training is Adam on the weighted log loss with the
gradient through the windows that won their chunk.

Training rows are a bounded sample: at most ``TRAIN_PER_CLASS`` labelled rows of each class, those of
lowest hash of doc_id; of a training document at most ``KEPT_CHUNKS`` random chunks leave the tasks, and at most ``TRAIN_CHUNKS`` of them are used in an
epoch. Scoring reads every byte of every document, a very long one in runs of chunks. Only the text is an input.

Defined cases: a null text counts as empty; an empty text is one chunk of padding and gets that
score; repeated texts get equal scores. Without labelled rows, or with one class only, every score
is the share of class 1 (0.5 without any). Of contradicting labels of a document the lower stands, of several texts of a labelled doc_id
the first in order is learned from; rows with a null doc_id or quality aren't learned from, and a null doc_id isn't held out. Equal hashes
of the sample are ordered by doc_id. An empty table gives an empty one; a column of the input that has the name of the output is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from speechmill.llm.common import table, without
from speechmill.llm.shingles import string_buffer

WIDTH, STRIDE, FILTERS, CHUNK = 8, 2, 32, 128
CHUNK_BYTES = CHUNK * STRIDE
#: Windows at the end of a document that would reach beyond it.
SPARE = (WIDTH - 1) // STRIDE
TRAIN_PER_CLASS = 1500
KEPT_CHUNKS, TRAIN_CHUNKS = 24, 12
EPOCHS = 14
THRESHOLD = 0.7
FOLDS, HELD_OUT = 4, 2
#: Bytes scored at once, so that the responses stay in the cache.
SLICE_BYTES = 1 << 16

Model = dict[str, np.ndarray]


def _chunks_of(lengths: np.ndarray) -> np.ndarray:
    """Chunks of each document: no window that counts reaches into the next document, and one at least is padding alone."""
    return -(-(lengths + WIDTH + SPARE * STRIDE) // CHUNK_BYTES)


def _lay_out(data: np.ndarray, off: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents first..last-1 padded to whole chunks, and the chunk at which each begins."""
    n = _chunks_of(np.diff(off[first : last + 1]))
    at = np.concatenate([[0], np.cumsum(n)])
    buf = np.zeros(at[-1] * CHUNK_BYTES + WIDTH, dtype=np.uint8)
    for k in range(first, last):
        begin = at[k - first] * CHUNK_BYTES
        buf[begin : begin + off[k + 1] - off[k]] = data[off[k] : off[k + 1]]
    return buf, at


def _responses(model: Model, buf: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """[chunk, window, filter]; ``ends``: the chunks that are the last of their document."""
    n = (len(buf) - WIDTH) // STRIDE
    out = np.take(model["taps"][0], buf[0 : n * STRIDE : STRIDE], axis=0)
    for j in range(1, WIDTH):
        out += np.take(model["taps"][j], buf[j : j + n * STRIDE : STRIDE][:n], axis=0)
    out = out.reshape(-1, CHUNK, FILTERS)
    out[ends, CHUNK - SPARE :] = -np.inf
    return out


def _combine(model: Model, pooled: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    act = np.tanh(pooled + model["bias"])
    mean = np.add.reduceat(act, at[:-1], axis=0) / np.diff(at)[:, None]
    most = np.maximum.reduceat(act, at[:-1], axis=0)
    return act, mean, most


def _probability(model: Model, mean: np.ndarray, most: np.ndarray) -> np.ndarray:
    return _sigmoid(mean @ model["of_mean"] + most @ model["of_max"] + model["offset"][0])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def predict(model: Model, column: pa.Array) -> np.ndarray:
    """The probability of class 1 for each whole text of a string column."""
    data, off = string_buffer(column)
    n = len(off) - 1
    if "constant" in model:
        return np.full(n, float(model["constant"]))
    scores = np.zeros(n)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(off, off[first] + SLICE_BYTES, side="right")) - 1)
        last = min(last, n, first + 4096)
        if off[last] - off[first] > 4 * SLICE_BYTES:  # one very long document, in runs of whole chunks
            scores[first] = _predict_long(model, data[off[first] : off[last]])
        else:
            buf, at = _lay_out(data, off, first, last)
            pooled = _responses(model, buf, at[1:] - 1).max(axis=1)
            _, mean, most = _combine(model, pooled, at)
            scores[first:last] = _probability(model, mean, most)
        first = last
    return scores


def _predict_long(model: Model, doc: np.ndarray) -> float:
    n = int(_chunks_of(np.array([len(doc)]))[0])
    buf = np.zeros(n * CHUNK_BYTES + WIDTH, dtype=np.uint8)
    buf[: len(doc)] = doc
    pooled, step = [], SLICE_BYTES // CHUNK_BYTES
    for c in range(0, n, step):
        d = min(n, c + step)
        ends = np.array([d - c - 1] if d == n else [], dtype=np.int64)
        pooled.append(_responses(model, buf[c * CHUNK_BYTES : d * CHUNK_BYTES + WIDTH], ends).max(axis=1))
    _, mean, most = _combine(model, np.concatenate(pooled), np.array([0, n]))
    return float(_probability(model, mean, most)[0])


Sample = tuple[np.ndarray, np.ndarray]


def sampled(column: pa.Array, most: int = KEPT_CHUNKS) -> list[Sample]:
    """Of each text at most ``most`` chunks with the bytes that their windows reach, and which is its last."""
    data, off = string_buffer(column)
    out = []
    for begin, end in zip(off[:-1], off[1:]):
        doc = data[begin:end]
        n = int(_chunks_of(np.array([len(doc)]))[0])
        take = np.arange(n) if n <= most else np.sort(np.random.default_rng(n).choice(n, most, replace=False))
        chunks = np.zeros((len(take), CHUNK_BYTES + WIDTH), np.uint8)
        for k, c in enumerate(take):
            part = doc[c * CHUNK_BYTES : (c + 1) * CHUNK_BYTES + WIDTH - STRIDE]
            chunks[k, : len(part)] = part
        out.append((chunks, take == n - 1))
    return out


def train(samples: list[Sample], y: np.ndarray, weight: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Model:
    """Fits the network to 0/1 labels of sampled texts; ``weight`` is the weight of each row in the loss."""
    if len(set(y.tolist())) < 2:
        return {"constant": np.array(float(y[0]) if len(y) else 0.5)}
    rng = np.random.default_rng(seed)
    model: Model = {
        "taps": rng.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32),
        "bias": np.full(FILTERS, -1.5, np.float32),
        "of_mean": rng.normal(0, 0.3, FILTERS).astype(np.float32),
        "of_max": rng.normal(0, 0.3, FILTERS).astype(np.float32),
        "offset": np.zeros(1, np.float32),
    }
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.items()}
    step = 0
    for epoch in range(epochs):
        rate = 0.02 * (1 - epoch / epochs) + 0.001
        order = rng.permutation(len(samples))
        for begin in range(0, len(order), 64):
            rows = order[begin : begin + 64]
            pieces, owner, ends = [], [], []
            for k, r in enumerate(rows):
                chunks, last = samples[r]
                take = slice(None) if len(chunks) <= TRAIN_CHUNKS else np.sort(rng.choice(len(chunks), TRAIN_CHUNKS, replace=False))
                pieces.append(chunks[take])
                ends.append(last[take])
                owner += [k] * len(ends[-1])
            block, owner, ends = np.concatenate(pieces), np.array(owner), np.concatenate(ends)
            z = np.take(model["taps"][0], block[:, 0 : CHUNK * STRIDE : STRIDE], axis=0)
            for j in range(1, WIDTH):
                z += np.take(model["taps"][j], block[:, j : j + CHUNK * STRIDE : STRIDE], axis=0)
            z[ends, CHUNK - SPARE :] = -np.inf
            win = z.argmax(axis=1)
            pooled = np.take_along_axis(z, win[:, None, :], axis=1)[:, 0]
            at = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(rows)))])
            act, mean, most = _combine(model, pooled, at)
            p = _probability(model, mean, most)
            g = ((p - y[rows]) * weight[rows] / weight[rows].sum()).astype(np.float32)
            top = act >= most[owner]
            d_act = g[owner, None] * (model["of_mean"] / np.diff(at)[owner, None] + model["of_max"] * top)
            d_z = d_act * (1 - act * act)
            grads = {"of_mean": mean.T @ g, "of_max": most.T @ g, "offset": np.array([g.sum()]), "bias": d_z.sum(axis=0), "taps": np.empty_like(model["taps"])}
            chunk = np.arange(len(block))[:, None]
            for j in range(WIDTH):
                cell = block[chunk, win * STRIDE + j].astype(np.int64) * FILTERS + np.arange(FILTERS)
                grads["taps"][j] = np.bincount(cell.ravel(), weights=d_z.ravel(), minlength=256 * FILTERS).reshape(256, FILTERS)
            grads["taps"] += 1e-6 * model["taps"]
            step += 1
            for k, v in model.items():
                m, s = moment[k]
                m += 0.1 * (grads[k] - m)
                s += 0.001 * (grads[k] ** 2 - s)
                v -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def remainder(folds: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None, label_col: str = "quality", per_class: int = TRAIN_PER_CLASS) -> Model:
    """Trains on a bounded sample of the labelled rows of ``docs`` for which ``learn`` holds."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label_col).isin(0, 1))
    if learn is not None:
        known = known.where(learn)
    known = known.groupBy("doc_id").agg(F.min(label_col).alias("y"))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return train([], np.zeros(0), np.zeros(0))
    picked = [known.where(F.col("y") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for c in sorted(counts)]
    chosen = picked[0] if len(picked) == 1 else picked[0].unionByName(picked[1])
    # at most 2 * per_class ids, hence safe to broadcast
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            some = sampled(b.column("text"))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("y"), pa.array([c.tobytes() for c, _ in some], pa.binary()), pa.array([e.tobytes() for _, e in some], pa.binary())], names=["doc_id", "y", "chunks", "ends"]
            )

    kinds = dict(texts.dtypes)
    rows = texts.mapInArrow(pick, f"doc_id {kinds['doc_id']}, y {kinds['y']}, chunks binary, ends binary").collect()  # KEPT_CHUNKS a row at most
    rows.sort(key=lambda r: r["doc_id"])
    y = np.array([r["y"] for r in rows], dtype=np.float32)
    per = {c: max(1, int((y == c).sum())) for c in counts}
    weight = np.array([counts[int(c)] / per[int(c)] for c in y], dtype=np.float32)
    samples = [(np.frombuffer(bytes(r["chunks"]), np.uint8).reshape(-1, CHUNK_BYTES + WIDTH), np.frombuffer(bytes(r["ends"]), bool)) for r in rows]
    return train(samples, y, weight)


def score(df: DataFrame, model: Model, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``df`` with the probability of class 1 of every whole text."""
    df = without(df, out_col)
    schema = T.StructType([*df.schema.fields, T.StructField(out_col, T.DoubleType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = np.round(predict(model, b.column(text_col)), 6)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p, pa.float64())], names=schema.names)

    return df.mapInArrow(run, schema)


def held_out_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Model:
    return fit(docs, table(spark, sf_dir, "labels"), remainder(FOLDS) != HELD_OUT)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = held_out_model(spark, docs, sf_dir)
    scored = score(docs, model).select("doc_id", "score")
    held = F.coalesce(remainder(FOLDS) == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op5_quality": op5_quality}
ORACLE: dict[str, str] = {}
