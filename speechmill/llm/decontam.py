"""Benchmark decontamination by latent semantic retrieval.

1. The words of all benchmark items are the vocabulary; their document frequencies are counted over the
   whole corpus, which gives the idf weights. There is one vocabulary, one set of weights and one latent
   space for all items, so what is found of an item doesn't depend on the others it is searched with.
2. All items are cut into overlapping passages in tasks; a randomised SVD of the TF-IDF matrix of all
   passages is computed over Spark (products with the matrix and its transpose are summed in tasks, only
   vocabulary x rank numbers of each reach the driver, one after the other) and gives the latent space. Its rank follows the
   spectrum and every passage: the least that keeps ``ENERGY`` of the matrix and ``KEPT`` of each of its rows,
   within ``MAX_RANK`` and ``SPACE_NUMBERS``.
3. All documents are cut into passages alike, all whole texts. Both sides are projected and normalised in
   the latent space, so an equal passage has cosine 1 at any rank: where the rank is bounded there are
   more candidates, not fewer finds. A pair is a candidate from ``COSINE`` on, if the words that both
   have also hold ``LEAST`` of the item passage's own weight. Of an item passage that the bounded rank keeps
   less than ``KEPT`` of, the cosine tells little (words around a copy outweigh it): all passages that hold
   ``LEAST`` of its weight are candidates, found by lists of its words. Words of no item have no part in either, so
   the text around a copy, however rare its words and however large the corpus, doesn't lower it.
4. All candidates of a document and item are checked on the words themselves, by the longest common
   subsequence with the text around: of the whole item (from ``LCS_SURE`` of its words on a leak, from
   ``LCS_PARAPHRASE`` on if the item's answer is there too, taken as its last words and its rarest ones),
   of the passage alone (from ``LCS_PASSAGE`` on, so a copied part of an item counts), and by the words
   of the item that verbatim runs of ``RUN_WORDS`` words hold (a leak if they weigh ``RUN_WEIGHT`` of the item,
   or of ``RUN_OF_WORDS`` of its words if it has more).

Words are runs of letters and digits (any byte outside ASCII counts as a letter), without case. Items are
read in the order of item_id in blocks of about ``BLOCK_PASSAGES`` passages, which bounds what is broadcast;
every block is compared with all documents.

Defined cases: null or empty texts and items have no words and match nothing; items with equal words are
all reported, and so are repeated items; repeated rows give repeated results, rows of a null doc_id one with
a null; without documents or without items the result is empty; of a very long text every passage is
compared, a slice of ``CHUNK`` passages at a time; passages of equal cosine are all checked; other columns of
the tables are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speechmill.llm.common import table
from speechmill.llm.shingles import slices, string_buffer, word_hashes

WINDOW, STRIDE = 16, 8
ENERGY, KEPT, MAX_RANK, OVERSAMPLE, POWER_ROUNDS = 0.9, 0.1, 192, 16, 2
#: Most numbers of the latent space (vocabulary x rank) that are held and broadcast.
SPACE_NUMBERS = 1 << 24
#: Most tasks that sum a product, each of which sends SPACE_NUMBERS at most.
FIT_TASKS = 32
COSINE, LEAST = 0.45, 0.3
LCS_SURE, LCS_PARAPHRASE, ANSWER_SHARE, ANSWER_WORDS = 0.6, 0.45, 0.6, 5
LCS_PASSAGE, PASSAGE_WORDS = 0.75, 12
RUN_WORDS, RUN_WEIGHT, RUN_OF_WORDS = 8, 0.125, 64
BLOCK_PASSAGES = 20_000
#: Passages projected at once, and cosines held at once.
CHUNK, CHUNK_COSINES = 4096, 1 << 22

_APART = np.array([not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128) for b in range(256)])
_STEPS = np.multiply.accumulate(np.full(RUN_WORDS, 0x9E3779B97F4A7C15, np.uint64))


def words(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row of the first, word hashes, first word of each row) of consecutive rows of a column."""
    data, off = string_buffer(column)
    for i, j in slices(off):
        part = data[off[i] : off[j]].copy()
        second = np.flatnonzero(part[:-1] == 0xC3) + 1  # À to Þ are one bit from à to þ
        upper = second[(part[second] >= 0x80) & (part[second] <= 0x9E) & (part[second] != 0x97)]
        part[upper] += 0x20
        w, first = word_hashes(part, off[i : j + 1] - off[i], _APART)
        yield i, w, first


def passages(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, begin, end) of the passages of rows whose words begin at ``first``."""
    n = np.diff(first)
    per = np.where(n > 0, 1 + np.maximum(0, -(-(n - WINDOW) // STRIDE)), 0)
    row = np.repeat(np.arange(len(n)), per)
    k = np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)
    begin = first[row] + k * STRIDE
    return row, begin, np.minimum(begin + WINDOW, first[row + 1])


def item_passages(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same of items; the last passage of one ends with it but is no shorter than the others."""
    row, begin, end = passages(first)
    begin = np.maximum(np.minimum(begin, end - WINDOW), first[row])
    return row, begin, end


def grams(w: np.ndarray) -> np.ndarray:
    """A hash of every run of RUN_WORDS words."""
    n = len(w) - RUN_WORDS + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    return sum(w[t : t + n] * _STEPS[t] for t in range(RUN_WORDS))


class Vocabulary:
    """The distinct words of the items, found by hash."""

    def __init__(self, hashes: np.ndarray):
        self.sorted = np.unique(hashes)
        self.may = np.zeros(1 << 16, bool)
        self.may[(self.sorted >> np.uint64(48)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> np.ndarray:
        """Word numbers, -1 where a word is in no item."""
        out = np.full(len(h), -1, np.int32)
        if len(self.sorted):
            near = np.flatnonzero(self.may[(h >> np.uint64(48)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.sorted, h[near]), len(self.sorted) - 1)
            hit = self.sorted[at] == h[near]
            out[near[hit]] = at[hit]
        return out


def document_frequencies(docs: DataFrame, vocab: Vocabulary) -> tuple[np.ndarray, int]:
    """In how many of all documents each word of the vocabulary is, and how many documents there are."""
    size = len(vocab.sorted)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size + 1, np.int64)
        for b in batches:
            total[size] += b.num_rows
            for _, w, first in words(b.column("text")):
                known = vocab.find(w)
                row = np.repeat(np.arange(len(first) - 1), np.diff(first))
                inside = known >= 0
                met = np.unique(row[inside] * size + known[inside]) % size if size else np.zeros(0, np.int64)
                total[:size] += np.bincount(met, minlength=size)
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array(total[full], pa.int64())], names=["word", "n"])

    out = np.zeros(size + 1, np.int64)
    counted = docs.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    for r in counted.toLocalIterator():  # one row for each word of the benchmark
        out[r["word"]] = r["n"]
    return out[:size], int(out[size])


def passage_words(benchmark: DataFrame, vocab: Vocabulary) -> DataFrame:
    """(words) of every passage of every item, as word numbers."""
    shared = benchmark.sparkSession.sparkContext.broadcast(vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, w, first in words(b.column("text")):
                known = shared.value.find(w)
                _, begin, end = item_passages(first)
                off = np.concatenate([[0], np.cumsum(end - begin)])
                cell = np.arange(off[-1]) + np.repeat(begin - off[:-1], end - begin)
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(known[cell], pa.int32()))], names=["words"])

    return benchmark.select("text").mapInArrow(run, "words array<int>")


def weighted(batch: pa.RecordBatch, weight: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(distinct words, TF-IDF weights of length 1) of each passage."""
    for r in batch.column("words").to_pylist():
        word, times = np.unique(np.asarray(r, dtype=np.int64), return_counts=True)
        v = weight[word] * times
        yield word, v / max(1e-9, np.sqrt((v**2).sum()))


def latent_space(
    spark: SparkSession, rows: DataFrame | list[list[int]], idf: np.ndarray, energy: float = ENERGY, most: int = MAX_RANK, seed: int = 11
) -> tuple[np.ndarray, float]:
    """[word, dimension]: the right singular vectors of the TF-IDF matrix of all ``rows`` (the words of
    each passage), as many as keep ``energy`` of it and KEPT of every row, ``most`` at most, and the share
    they keep. By a randomised range finder with power rounds; the rows are spread over tasks."""
    size = len(idf)
    most = max(1, min(most, SPACE_NUMBERS // max(1, size)))
    rows = (rows if isinstance(rows, DataFrame) else spark.createDataFrame([(r,) for r in rows], "words array<int>")).persist()
    n_rows = rows.count()
    k = min(most + OVERSAMPLE, size, max(1, n_rows))
    spread = rows.repartition(max(1, min(FIT_TASKS, n_rows // 200)))

    def gram_times(m: np.ndarray) -> np.ndarray:
        shared = spark.sparkContext.broadcast((idf.astype(np.float32), m.astype(np.float32)))  # at most SPACE_NUMBERS

        def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            weight, factor = shared.value
            total = np.zeros((size, factor.shape[1]), np.float32)
            for b in batches:
                for word, v in weighted(b, weight):
                    total[word] += v[:, None] * (v @ factor[word])
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

        out = np.zeros((size, m.shape[1]), np.float32)
        parts = spread.mapInArrow(multiply, "part binary").persist()
        parts.count()  # all tasks at once; the iterator alone would run one after the other
        for r in parts.toLocalIterator():
            out += np.frombuffer(bytes(r["part"]), np.float32).reshape(out.shape)
        parts.unpersist()
        shared.unpersist()
        return out

    def rank_of_all(m: np.ndarray) -> int:
        """The least rank that keeps KEPT of every row, that of ``m`` if none does."""
        shared = spark.sparkContext.broadcast((idf.astype(np.float32), m))

        def need(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            weight, factor = shared.value
            least = 1
            for b in batches:
                for word, v in weighted(b, weight):
                    least = max(least, 1 + int(np.searchsorted(np.cumsum((v @ factor[word]) ** 2), KEPT)))
            yield pa.RecordBatch.from_arrays([pa.array([min(least, factor.shape[1])], pa.int32())], names=["rank"])

        out = spread.mapInArrow(need, "rank int").agg(F.max("rank")).first()[0]
        shared.unpersist()
        return out

    q = np.linalg.qr(gram_times(np.random.default_rng(seed).normal(size=(size, k))))[0]
    for _ in range(POWER_ROUNDS - 1):
        q = np.linalg.qr(gram_times(q))[0]
    values, vectors = np.linalg.eigh((q.T @ gram_times(q)).astype(np.float64))
    best = np.argsort(values)[::-1]
    kept = np.cumsum(np.maximum(values[best], 0)) / max(1, n_rows)  # the rows have length 1
    most = min(most, len(best))
    rank = min(int(np.searchsorted(kept, energy)) + 1, most)
    space = (q @ vectors[:, best[:most]]).astype(np.float32)
    if rank < most and n_rows:
        rank = max(rank, rank_of_all(space))
    rows.unpersist()
    return space[:, :rank].copy(), float(kept[rank - 1])


def lcs_length(a: np.ndarray, b: np.ndarray) -> int:
    """The length of the longest common subsequence, by rows of bits."""
    at: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for x in b.tolist():
        m = row & at.get(x, 0)
        if m:
            row = (row + m | row & ~m) & full
    return len(a) - row.bit_count()


class Space:
    """What all blocks of items share: vocabulary, weights and latent space."""

    def __init__(self, vocab: Vocabulary, df: np.ndarray, n_docs: int):
        self.vocab = vocab
        self.idf = np.log1p(max(1, n_docs) / np.maximum(df, 1)).astype(np.float32)
        self.heavy = np.append(self.idf.astype(np.float64) ** 2, 0.0)

    def span(self, vectors: np.ndarray) -> None:
        self.vectors = np.concatenate([vectors * self.idf[:, None], np.zeros((1, vectors.shape[1]), np.float32)])

    def project(self, words_in: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The projections of passages, given as word numbers (-1: none) of WINDOW columns, and their lengths."""
        out = np.zeros((len(words_in), self.vectors.shape[1]), np.float32)
        for c in range(words_in.shape[1]):
            out += self.vectors[words_in[:, c]]
        return out, np.sqrt((out**2).sum(axis=1))

    def rows(self, words_in: np.ndarray) -> np.ndarray:
        """The normalised projections."""
        out, length = self.project(words_in)
        return out / np.maximum(1e-9, length)[:, None]

    def kept(self, words_in: np.ndarray) -> np.ndarray:
        """The shares of passages that the space keeps."""
        times = (words_in[:, :, None] == words_in[:, None, :]).sum(axis=2)
        return self.project(words_in)[1] ** 2 / np.maximum(1e-9, (self.heavy[words_in] * times).sum(axis=1))


def cut(known: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The word numbers of passages, in WINDOW columns."""
    cell = begin[:, None] + np.arange(WINDOW)
    return np.where(cell < end[:, None], known[np.minimum(cell, len(known) - 1)], -1)


class Index:
    """One block of items, ready to be compared with passages."""

    def __init__(self, space: Space, ids: list[int], items: list[np.ndarray]):
        self.space, self.ids, self.items = space, ids, items
        first = np.concatenate([[0], np.cumsum([len(w) for w in items])])
        known = space.vocab.find(np.concatenate(items))
        self.owner, self.begin, end = item_passages(first)
        self.parts = cut(known, self.begin, end)
        self.size = end - self.begin
        self.begin = self.begin - first[self.owner]
        self.whole = space.heavy[self.parts].sum(axis=1)
        self.query = space.rows(self.parts)
        # the passages that the space keeps too little of, listed by their words
        self.spanned = space.kept(self.parts) >= KEPT
        self.weak = np.flatnonzero(~self.spanned)
        part, column = np.nonzero(self.parts[self.weak] >= 0)
        word = self.parts[self.weak][part, column]
        order = np.argsort(word, kind="stable")
        self.listed = np.concatenate([[0], np.cumsum(np.bincount(word, minlength=len(space.idf)))])
        self.list_part, self.list_weight = part[order], space.heavy[word[order]]
        # of each item its last words and its rarest ones, whose presence confirms a paraphrase
        self.answers, self.grams, self.weight, self.enough = [], [], [], []
        for k, w in enumerate(items):
            weight = space.heavy[known[first[k] : first[k + 1]]]
            self.answers.append((w[-ANSWER_WORDS:], w[np.argsort(-weight, kind="stable")[:ANSWER_WORDS]]))
            self.grams.append(grams(w))
            self.weight.append(weight)
            self.enough.append(RUN_WEIGHT * weight.mean() * min(len(w), RUN_OF_WORDS))

    def sharing(self, words_in: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(passage, item passage) of the pairs whose common words hold LEAST, of the item passages listed by words."""
        word = np.sort(words_in, axis=1)
        new = word >= 0
        new[:, 1:] &= word[:, 1:] != word[:, :-1]
        n = np.where(new, self.listed[word + 1] - self.listed[word], 0)
        ends = np.cumsum(n.sum(axis=1))
        for some in np.split(np.arange(len(word)), np.flatnonzero(np.diff(ends // CHUNK_COSINES)) + 1):
            each = n[some].ravel()
            at = np.arange(each.sum()) + np.repeat(self.listed[word[some]].ravel() - (np.cumsum(each) - each), each)
            row = np.repeat(np.arange(len(some)), n[some].sum(axis=1))
            common = np.bincount(row * len(self.weak) + self.list_part[at], self.list_weight[at], len(some) * len(self.weak))
            x, y = np.nonzero(common.reshape(len(some), -1) >= LEAST * self.whole[self.weak])
            yield some[x], self.weak[y]

    def candidates(self, known: np.ndarray, begin: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(passage, item passage, cosine) of the pairs from COSINE on that LEAST allows, and of all that it
        allows where the space keeps too little of the item passage."""
        heavy = self.space.heavy
        inside = np.concatenate([[0.0], np.cumsum(heavy[known])])
        inside = inside[end] - inside[begin]
        near = np.flatnonzero(inside >= 0.999 * LEAST * self.whole.min())
        step = max(1, min(CHUNK, CHUNK_COSINES // len(self.parts)))
        for at in range(0, len(near), step):
            p = near[at : at + step]
            words_in = cut(known, begin[p], end[p])
            cosine = self.space.rows(words_in) @ self.query.T
            i, k = np.nonzero(cosine >= COSINE)
            may = self.spanned[k] & (inside[p[i]] >= 0.999 * LEAST * self.whole[k])
            i, k = i[may], k[may]
            for x, y in self.sharing(words_in) if len(self.weak) else ():
                yield p[x], y, cosine[x, y]
            for some in range(0, len(i), 2048):
                x, y = i[some : some + 2048], k[some : some + 2048]
                both = (self.parts[y][:, :, None] == words_in[x][:, None, :]).any(axis=2)
                good = np.where(both, heavy[self.parts[y]], 0.0).sum(axis=1) >= LEAST * self.whole[y]
                yield p[x[good]], y[good], cosine[x[good], y[good]]

    def share_of_item(self, k: int, around: np.ndarray) -> float:
        """The share of an item's words in common with a text in order, 0 if that is no leak."""
        share = lcs_length(self.items[k], around) / len(self.items[k])
        if share >= LCS_SURE or (share >= LCS_PARAPHRASE and all(np.isin(a, around).mean() >= ANSWER_SHARE for a in self.answers[k])):
            return share
        return 0.0

    def share_of_passage(self, q: int, around: np.ndarray) -> float:
        """The same of one item passage."""
        n = int(self.size[q])
        if n < PASSAGE_WORDS:
            return 0.0
        begin = int(self.begin[q])
        share = lcs_length(self.items[self.owner[q]][begin : begin + n], around) / n
        return share if share >= LCS_PASSAGE else 0.0

    def verbatim(self, k: int, around: np.ndarray) -> int:
        """How many words of an item are in runs of RUN_WORDS that the text has too, 0 if that is no leak."""
        at = np.flatnonzero(np.isin(self.grams[k], grams(around)))
        if not len(at):
            return 0
        held = np.unique(at[:, None] + np.arange(RUN_WORDS))
        return len(held) if self.weight[k][held].sum() >= self.enough[k] else 0

    def leaks(self, w: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, float, float, float, int]]:
        """(row, item, cosine, share of the item, share of a passage, words in verbatim runs) of the leaks in rows of words."""
        known = self.space.vocab.find(w)
        row, begin, end = passages(first)
        met: dict[tuple[int, int], list[tuple[int, int, float]]] = {}  # of each row and item its candidates
        for p, q, cosine in self.candidates(known, begin, end):
            for r, k, start, part, c in zip(row[p].tolist(), self.owner[q].tolist(), begin[p].tolist(), q.tolist(), cosine.tolist()):
                met.setdefault((r, k), []).append((start, part, c))
        for (r, k), found in sorted(met.items()):
            reach = len(self.items[k])

            def around(lo: int, hi: int, more: int) -> np.ndarray:
                return w[max(first[r], lo - more) : min(first[r + 1], hi + WINDOW + more)]

            share, part_share, held = 0.0, 0.0, 0
            starts = np.unique([f[0] for f in found])
            for run in np.split(starts, np.flatnonzero(np.diff(starts) > WINDOW) + 1):
                text = around(run[0], run[-1], reach)
                held = max(held, self.verbatim(k, text))
                if lcs_length(self.items[k], text) < max(share, LCS_PARAPHRASE) * reach:
                    continue  # no part of the run has more in common than the run
                share = max(share, *(self.share_of_item(k, around(s, s, reach)) for s in run))
            for start, q, _ in found:
                part_share = max(part_share, self.share_of_passage(q, around(start, start, STRIDE)))
            if share or part_share or held:
                yield r, k, min(1.0, max(f[2] for f in found)), share, part_share, held


LEAKS = "doc_id long, item_id long, cosine double, share double, passage_share double, verbatim int"


def _blocks(benchmark: DataFrame) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Ids and words of the items in order, in blocks of BLOCK_PASSAGES or one item more."""
    ids, items, n = [], [], 0
    for r in benchmark.orderBy("item_id", "text").toLocalIterator():
        w = np.concatenate([np.zeros(0, np.uint64), *(part for _, part, _ in words(pa.array([r["text"]], pa.string())))])
        if not len(w):
            continue
        ids.append(r["item_id"])
        items.append(w)
        n += 1 + len(w) // STRIDE
        if n >= BLOCK_PASSAGES:
            yield ids, items
            ids, items, n = [], [], 0
    if items:
        yield ids, items


def fit(docs: DataFrame, benchmark: DataFrame) -> Space | None:
    """The one space of all items; None without any word."""
    distinct = [np.unique(np.concatenate(items)) for _, items in _blocks(benchmark)]
    if not distinct:
        return None
    vocab = Vocabulary(np.concatenate(distinct))  # the words of the benchmark, whatever the corpus
    space = Space(vocab, *document_frequencies(docs, vocab))
    space.span(latent_space(docs.sparkSession, passage_words(benchmark, vocab), space.idf)[0])
    return space


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, cosine, share, passage_share, verbatim) of the documents that hold a benchmark item
    or a part of one, verbatim or paraphrased. The shares are longest common subsequences over the words of the item
    and of a passage of it, verbatim its words in common runs; each is 0 where it is no leak by itself."""
    spark = docs.sparkSession
    docs, benchmark = docs.select("doc_id", "text"), benchmark.select("item_id", "text")
    out = spark.createDataFrame([], LEAKS)
    space = fit(docs, benchmark)
    if space is None:
        return out

    def search(ids: list[int], items: list[np.ndarray]) -> DataFrame:
        shared = spark.sparkContext.broadcast(Index(space, ids, items))  # BLOCK_PASSAGES and the space

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            mine = shared.value
            for b in batches:
                found = [(i + r, *leak) for i, w, first in words(b.column("text")) for r, *leak in mine.leaks(w, first)]
                if found:
                    at, item, cosine, share, part, held = zip(*found)
                    yield pa.RecordBatch.from_arrays(
                        [
                            b.column("doc_id").take(pa.array(at, pa.int64())),
                            pa.array([mine.ids[k] for k in item], pa.int64()),
                            *(pa.array(np.round(x, 6), pa.float64()) for x in (cosine, share, part)),
                            pa.array(held, pa.int32()),
                        ],
                        names=["doc_id", "item_id", "cosine", "share", "passage_share", "verbatim"],
                    )

        return docs.mapInArrow(run, LEAKS)

    for block in _blocks(benchmark):
        out = out.union(search(*block))
    return out


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op4_decontaminate": op4_decontaminate}
ORACLE: dict[str, str] = {}
