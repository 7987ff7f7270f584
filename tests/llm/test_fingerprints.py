from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest

from speechmill.llm import fingerprint as fp
from speechmill.llm.shingles import shingle_sets
from tests.llm.fixtures import frame, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text: str | None, k: int) -> set:
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


@pytest.mark.parametrize("k", [1, 3, 5])
def test_shingle_sets_have_the_brute_force_sizes_and_overlaps(k):
    texts = [r[1] for r in rows()]
    got = {i: set(h.tolist()) for i, h in shingle_sets(pa.array(texts, pa.string()), k)}
    want = [shingles(t, k) for t in texts]
    assert len(got) == len(texts)
    for i in range(len(texts)):
        assert len(got[i]) == len(want[i])
        for j in range(0, i, 5):
            assert len(got[i] & got[j]) == len(want[i] & want[j])


def test_sketches_estimate_and_merge():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 2**64, 5000, dtype=np.uint64), rng.integers(0, 2**64, 5000, dtype=np.uint64)
    both = np.concatenate([a[:2500], b])
    sa, sb, sc = fp.sketch_of(a), fp.sketch_of(b), fp.sketch_of(both)
    assert (fp.merge(sb, fp.sketch_of(a[:2500])) == sc).all()
    assert abs(fp.resemblance(sa, sc) - 2500 / 10000) < 0.1
    assert abs(fp.distinct_shingles(sa) / 5000 - 1) < 0.25
    assert fp.containment(sb, sc) > 0.8
    assert fp.resemblance(sa, sa) == 1.0
    empty = fp.sketch_of(np.zeros(0, np.uint64))
    assert fp.resemblance(empty, empty) == 1.0 and fp.resemblance(empty, sa) == 0.0
    assert (fp.from_text(fp.to_text(sa)) == sa).all()


def expected(data):
    order = sorted(data, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    out = []
    for i, r in enumerate(order):
        t, nxt = r[1] or "", order[(i + 1) % len(order)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        a, b, c = shingles(t, 5), shingles(edited, 5), shingles(nxt, 5)
        out.append((r[0], len(t), hashlib.sha256(edited.encode()).hexdigest(), len(a & b) / len(a | b) if a | b else 1.0, len(a & c) / len(a | c) if a | c else 1.0))
    return out


@pytest.mark.parametrize("data", [rows(), rows()[:1], [(None, None, None, None, None)], [(5, "a b", "x", "y", 3)] * 3])
def test_next_and_edited_texts(spark, data):
    out = fp.with_next(frame(spark, data)).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[2])
    got = sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"], r["near_edited"], r["near_next"]) for r in out), key=key)
    want = sorted(expected(data), key=key)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    for g, w in zip(got, want):
        assert abs(g[3] - w[3]) < 0.15 and abs(g[4] - w[4]) < 0.15
    prints = {}
    for r in out:
        prints.setdefault(r["fingerprint"], set()).add(r["doc_id"])
    assert fp.with_next(frame(spark, data).where("false")).count() == 0


def test_equal_texts_have_equal_fingerprints(spark):
    got = fp.fingerprint(frame(spark)).select("text", "fingerprint").collect()
    by = {}
    for r in got:
        by.setdefault(r["text"] or "", set()).add(r["fingerprint"])
    assert all(len(v) == 1 for v in by.values())
