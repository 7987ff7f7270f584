"""Language identification by segmentation-marginalised unigrams.

The pieces are those of a fixed public vocabulary; every language has a probability for each piece.
A text is lower-cased and cut at white space, each word gets the vocabulary's word-begin mark, and
its likelihood in a language is the sum over all ways to segment it into pieces, by the forward
algorithm. Pieces don't span words, so a text's log likelihood is the sum over its words, and each
distinct word is run through the forward algorithm once and then looked up. The probabilities are
fitted by expectation maximisation (expected piece counts from forward and backward sums).

The training rows are a bounded sample: about ``TRAIN_PER_LANG`` documents of each language, chosen by
a hash of doc_id, whole. Languages are fitted in tasks of their own. Words of any length are learned from and
scored, long ones (a language written without spaces has few others) by rescaled sums, many words at a time.
Prediction reads every whole text.

Defined cases: language ``und`` and score 0 for a null text and for one without a letter; ties go to the
language first in the alphabet; equal texts, and so repeated rows, get equal results. Without any training row,
as of an empty table, all is ``und``; rows with a null lang, text or doc_id aren't learned from, and a null doc_id isn't held out.
Columns of the input that have the name of an output column are replaced.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from speechmill.llm.common import table, without

VOCABULARY = "piece_bpe_32k.model"
TRAIN_PER_LANG = 300
ROUNDS = 4
SMOOTHING = 0.05
FOLDS, HELD_OUT = 3, 1
#: Longest word for the algorithm that takes words of one length at once; longer ones go by the rescaled one,
#: in groups of about so many characters and words.
LONG, LONG_CHARS, LONG_WORDS = 40, 1 << 17, 512
#: Each character's factor that keeps sums of short words within range (undone in the logarithm).
LIFT = 3.0
CACHE_WORDS = 300_000
LETTER = re.compile(r"[^\W\d_]")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


class Vocabulary:
    """The pieces that text can hold, findable by hash in batches and by string one by one."""

    def __init__(self, model_file: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        keep = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.pieces = sorted({sp.id_to_piece(i) for i in keep})
        self.index = {p: i for i, p in enumerate(self.pieces)}
        self.longest = max(map(len, self.pieces), default=1)
        #: stands for a single character that is no piece, and for a longer string that is none
        self.unknown = len(self.pieces)
        self.none = len(self.pieces) + 1
        h = np.array([self.hash(p) for p in self.pieces], dtype=np.uint64)
        self._tables = []
        left = np.arange(len(h))
        while len(left):  # open hash tables; what doesn't get a place goes to the next, smaller one
            bits = max(10, int(len(left) * 8).bit_length())
            slot = self._slot(h[left], len(self._tables), bits)
            place, first = np.unique(slot, return_index=True)
            keys, values = np.zeros(1 << bits, np.uint64), np.full(1 << bits, self.none, np.int32)
            keys[place], values[place] = h[left[first]], left[first]
            self._tables.append((bits, keys, values))
            left = np.delete(left, first)

    @staticmethod
    def hash(piece: str) -> int:
        h, p = 0, 1
        for c in piece:
            h = (h + (ord(c) + 1) * p) & 0xFFFFFFFFFFFFFFFF
            p = p * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF
        return h

    @staticmethod
    def _slot(h: np.ndarray, level: int, bits: int) -> np.ndarray:
        return ((h ^ (h >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93 + 2 * level)) >> np.uint64(64 - bits)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece numbers of hashes, ``none`` where there is none."""
        out = np.full(len(h), self.none, np.int32)
        for level, (bits, keys, values) in enumerate(self._tables):
            slot = self._slot(h, level, bits)
            out = np.where(keys[slot] == h, values[slot], out)
        return out


@functools.lru_cache(maxsize=2)
def vocabulary(model_file: str) -> Vocabulary:
    return Vocabulary(model_file)


def words_of(text: str) -> list[str]:
    return text.lower().split()


def _edges(vocab: Vocabulary, words: list[str]) -> tuple[int, list[tuple[int, int, np.ndarray]]]:
    """Of words of one length: that length with the mark, and (begin, end, the piece of each word
    there) of all places where any piece fits, by end."""
    marked = ["▁" + w for w in words]
    n = len(marked[0])
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(len(words), n).T.astype(np.uint64)
    up = np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(n, _BASE))])
    down = np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(n, _INV))])
    total = np.zeros((n + 1, len(words)), dtype=np.uint64)
    np.cumsum((codes + np.uint64(1)) * up[:n, None], axis=0, out=total[1:])
    out = []
    for end in range(1, n + 1):
        for begin in range(max(0, end - vocab.longest), end):
            piece = vocab.find((total[end] - total[begin]) * down[begin])
            if end - begin == 1:
                piece = np.where(piece == vocab.none, vocab.unknown, piece)
            elif (piece == vocab.none).all():
                continue
            out.append((begin, end, piece))
    return n, out


def _by_length(words: list[str], most: int = 8192) -> Iterator[list[int]]:
    groups: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        groups.setdefault(len(w), []).append(i)
    for n in sorted(groups):
        for at in range(0, len(groups[n]), most):
            yield groups[n][at : at + most]


def log_likelihoods(vocab: Vocabulary, prob: np.ndarray, words: list[str]) -> np.ndarray:
    """[word, language] log of the sum over all segmentations. prob: [piece and unknown, language]."""
    out = np.zeros((len(words), prob.shape[1]))
    short = [i for i, w in enumerate(words) if len(w) <= LONG]
    lifts = np.exp(LIFT * np.arange(vocab.longest + 1))
    padded = np.concatenate([prob, np.zeros((1, prob.shape[1]))])  # no piece: no probability
    for group in _by_length([words[i] for i in short]):
        rows_of = [short[k] for k in group]
        n, edges = _edges(vocab, [words[i] for i in rows_of])
        alpha = np.zeros((n + 1, len(rows_of), prob.shape[1]))
        alpha[0] = 1
        for begin, end, piece in edges:
            alpha[end] += (alpha[begin] * lifts[end - begin]) * padded[piece]
        out[rows_of] = np.log(alpha[n]) - LIFT * n
    rest = [i for i, w in enumerate(words) if len(w) > LONG]
    for group in _long_groups([words[i] for i in rest]):
        rows_of = [rest[k] for k in group]
        batch = LongWords(vocab, [words[i] for i in rows_of])
        out[rows_of] = np.add.reduceat(batch.forward(padded), batch.at[:-1], axis=0)
    return out


class LongWords:
    """Words of any lengths for the rescaled algorithms, which go through all of them at once, by position.

    words are sorted with the longest first, so those that reach a position are always the first ones."""

    def __init__(self, vocab: Vocabulary, words: list[str]):
        marked = ["▁" + w for w in words]
        self.n = np.array([len(w) for w in marked])
        self.at = np.concatenate([[0], np.cumsum(self.n)])
        self.widest = vocab.longest
        size = int(self.at[-1])
        codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        up = np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(size, _BASE))])
        down = np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(size, _INV))])
        total = np.concatenate([[np.uint64(0)], np.cumsum((codes + np.uint64(1)) * up[:size])])
        end = np.arange(1, size + 1)
        begin_of_word = np.repeat(self.at[:-1], self.n)
        #: [character, length - 1]: the piece of that length which ends with the character
        self.pieces = np.full((size, self.widest), vocab.none, np.int32)
        for k in range(1, self.widest + 1):
            fits = np.flatnonzero(end - k >= begin_of_word)
            found = vocab.find((total[end[fits]] - total[end[fits] - k]) * down[end[fits] - k])
            self.pieces[fits, k - 1] = np.where(found == vocab.none, vocab.unknown, found) if k == 1 else found

    def reaching(self, position: int) -> int:
        """How many words have more than ``position`` characters."""
        return int(np.searchsorted(-self.n, -position, side="left"))

    def forward(self, padded: np.ndarray) -> np.ndarray:
        """[character, language]: the logarithm of the sum of all segmentations up to a character over that up
        to the one before. padded: [piece, language], 0 where there is none."""
        steps = np.zeros((len(self.pieces), padded.shape[1]))
        recent = np.zeros((len(self.n), self.widest, padded.shape[1]))  # sums up to the characters before, in one scale
        recent[:, 0] = 1
        for t in range(int(self.n.max(initial=0))):
            a = self.reaching(t)
            rows = self.at[:a] + t
            total = (recent[:a] * padded[self.pieces[rows]]).sum(axis=1)
            steps[rows] = np.log(total)
            recent[:a, 1:] = recent[:a, :-1] / total[:, None]
            recent[:a, 0] = 1
        return steps

    def expected(self, padded: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """The expected uses of each piece of one language; padded: [piece]."""
        upto = np.concatenate([[0.0], np.cumsum(self.forward(padded[:, None])[:, 0])])
        end = np.arange(len(self.pieces))[:, None]
        length = np.arange(1, self.widest + 1)
        with np.errstate(divide="ignore"):
            use = np.exp(np.minimum(0.0, np.log(padded[self.pieces]) + upto[np.maximum(end + 1 - length, 0)] - upto[end + 1]))
        after = np.zeros(len(self.pieces))  # at a word's end 1; else what the rest of the word adds, in scale
        rest = np.zeros((len(self.n), self.widest))  # the like at the next places of each word
        for t in range(int(self.n.max(initial=0)) - 1, -1, -1):
            a = self.reaching(t)
            rows = self.at[:a] + t
            ends = self.n[:a] == t + 1
            here = np.where(ends, 1.0, 0.0)
            inner = np.flatnonzero(~ends)
            if len(inner):  # pieces that begin after this character
                k = np.arange(self.widest)
                cell = rows[inner][:, None] + 1 + k
                inside = cell < self.at[inner + 1][:, None]
                here[inner] = (np.where(inside, use[np.where(inside, cell, 0), k], 0.0) * rest[inner]).sum(axis=1)
            after[rows] = here
            rest[:a, 1:] = rest[:a, :-1]
            rest[:a, 0] = here
        uses = use * (after * np.repeat(weight, self.n))[:, None]
        return np.bincount(self.pieces.ravel(), weights=uses.ravel(), minlength=len(padded))


def _long_groups(words: list[str]) -> Iterator[list[int]]:
    """Indices of words, longest first, in groups of a bounded number of characters."""
    order = sorted(range(len(words)), key=lambda i: (-len(words[i]), words[i]))
    group, size = [], 0
    for i in order:
        group.append(i)
        size += len(words[i]) + 1
        if size >= LONG_CHARS or len(group) >= LONG_WORDS:
            yield group
            group, size = [], 0
    if group:
        yield group


def expected_counts(vocab: Vocabulary, prob: np.ndarray, words: list[str], weight: np.ndarray) -> np.ndarray:
    """The expected number of uses of each piece over all segmentations; prob: [piece and unknown]."""
    counts = np.zeros(len(prob) + 1)
    padded = np.append(prob, 0.0)  # no piece: no probability
    lifts = np.exp(LIFT * np.arange(vocab.longest + 1))
    rest = [i for i, w in enumerate(words) if len(w) > LONG]
    for group in _long_groups([words[i] for i in rest]):
        rows_of = [rest[k] for k in group]
        counts += LongWords(vocab, [words[i] for i in rows_of]).expected(padded, weight[rows_of])
    short = [i for i, w in enumerate(words) if len(w) <= LONG]
    for group in _by_length([words[i] for i in short]):
        group = [short[k] for k in group]
        n, edges = _edges(vocab, [words[i] for i in group])
        alpha, beta = np.zeros((n + 1, len(group))), np.zeros((n + 1, len(group)))
        alpha[0] = beta[n] = 1
        for begin, end, piece in edges:
            alpha[end] += alpha[begin] * padded[piece] * lifts[end - begin]
        for begin, end, piece in reversed(edges):
            beta[begin] += beta[end] * padded[piece] * lifts[end - begin]
        share = weight[group] / alpha[n]
        for begin, end, piece in edges:
            uses = alpha[begin] * padded[piece] * lifts[end - begin] * beta[end] * share
            counts += np.bincount(piece, weights=uses, minlength=len(counts))
    return counts[:-1]


def fit_language(vocab: Vocabulary, words: Counter, rounds: int = ROUNDS) -> np.ndarray:
    """The probabilities of the pieces, with the one of unknown characters last."""
    kept = sorted(words)
    weight = np.array([words[w] for w in kept], dtype=float)
    prob = np.full(len(vocab.pieces) + 1, 1 / (len(vocab.pieces) + 1))
    for _ in range(rounds):
        counts = expected_counts(vocab, prob, kept, weight) + SMOOTHING
        prob = counts / counts.sum()
    return prob


Model = tuple[str, list[str], np.ndarray]


def fit(docs: DataFrame, per_lang: int = TRAIN_PER_LANG, model_file: str | None = None) -> Model:
    """Learns from docs(doc_id, text, lang): about ``per_lang`` rows of each language."""
    path = model_file or public_tokenizers.path(VOCABULARY)
    vocab = vocabulary(path)
    known = docs.where("lang is not null and text is not null and doc_id is not null")
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return path, [], np.zeros((len(vocab.pieces) + 1, 0))
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, min(1.0, per_lang / n)).otherwise(share)
    picked = known.where(F.pmod(F.xxhash64(F.lit("langid"), "doc_id"), F.lit(1 << 20)) < share * (1 << 20)).select("lang", "text")

    def learn(key: tuple, sample: pd.DataFrame) -> pd.DataFrame:  # about per_lang rows
        words: Counter = Counter()
        for text in sample["text"]:
            words.update(words_of(text))
        fitted = fit_language(vocabulary(path), words).astype(np.float64).tobytes() if words else None
        return pd.DataFrame({"lang": [key[0]], "prob": [fitted]})

    fitted = {r["lang"]: np.frombuffer(bytes(r["prob"])) for r in picked.groupBy("lang").applyInPandas(learn, "lang string, prob binary").where("prob is not null").collect()}
    langs = sorted(fitted)
    return path, langs, np.stack([fitted[lang] for lang in langs], axis=1) if langs else np.zeros((len(vocab.pieces) + 1, 0))


class Scorer:
    """Log likelihoods of texts; keeps those of the words it has met, up to a bound."""

    def __init__(self, model: Model):
        path, self.langs, self.prob = model
        self.vocab = vocabulary(path)
        self.rows: dict[str, int] = {}
        self.table = np.zeros((0, len(self.langs)))

    def _learn(self, texts: list[list[str]]) -> None:
        if len(self.rows) > CACHE_WORDS:
            self.rows, self.table = {}, np.zeros((0, len(self.langs)))
        new = sorted({w for t in texts for w in t if w not in self.rows})
        if new:
            base = len(self.rows)
            self.rows.update((w, base + i) for i, w in enumerate(new))
            self.table = np.concatenate([self.table[:base], log_likelihoods(self.vocab, self.prob, new)])

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = [], []
        split = [words_of(t) if t and LETTER.search(t) else [] for t in texts]
        self._learn(split)
        for words in split:
            if not words or not self.langs:
                langs.append("und")
                scores.append(0.0)
                continue
            ll = self.table[np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))].sum(axis=0)
            best = int(ll.argmax())
            langs.append(self.langs[best])
            scores.append(round(float(1 / np.exp(np.minimum(ll - ll[best], 0)).sum()), 6))
        return langs, scores


def identify(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``df`` with ``lang_pred`` and ``score``, the posterior of that language at equal priors."""
    df = without(df, "lang_pred", "score")
    schema = T.StructType([*df.schema.fields, T.StructField("lang_pred", T.StringType(), False), T.StructField("score", T.DoubleType(), False)])
    path, langs, prob = model
    shared = df.sparkSession.sparkContext.broadcast(prob)  # pieces times languages: a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer((path, langs, shared.value))
        for big in batches:
            for at in range(0, big.num_rows, 1024):
                b = big.slice(at, 1024)
                found, scores = scorer.predict(b.column(text_col).to_pylist())
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.string()), pa.array(scores, pa.float64())], names=schema.names)

    return df.mapInArrow(run, schema)


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS
    model = fit(docs.where(fold != HELD_OUT))
    found = identify(docs.select("doc_id", "text"), model).select("doc_id", "lang_pred", "score")
    return found.select("doc_id", F.coalesce(fold == HELD_OUT, F.lit(False)).alias("held_out"), "lang_pred", "score")


QUERIES = {"op8_langid": op8_langid}
ORACLE: dict[str, str] = {}
