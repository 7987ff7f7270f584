from __future__ import annotations

import random

import numpy as np
import pytest

from speechmill.llm import lines, ngram_join
from speechmill.llm.components import connected_components
from tests.llm.fixtures import frame, rows, save
from tests.llm.test_fingerprints import shingles


def classes(data, k, num, den):
    """doc rows -> (n, smallest doc_id reachable), by all pairs."""
    sets = [shingles(r[1], k) for r in data]
    parent = list(range(len(data)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(data)):
        for j in range(i):
            both, one = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if one and den * both >= num * one:
                parent[find(i)] = find(j)
    low = {}
    for i, r in enumerate(data):
        if r[0] is not None:
            low[find(i)] = min(low.get(find(i), r[0]), r[0])
    return sorted(((r[0], len(sets[i]), low.get(find(i)) if sets[i] else r[0]) for i, r in enumerate(data)), key=str)


def near_copies(n=120, seed=5):
    """One group of near copies, some further from the base than a link reaches, among others."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10_000)}" for _ in range(90)]
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randrange(6)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(400)}"
        out.append((i, " ".join(w if i % 4 else w[: 60 + i % 30]), "en", "s", 0))
    return out


@pytest.mark.parametrize("k,num,den", [(3, 90, 100), (5, 8, 10), (1, 1, 2)])
def test_classes_equal_all_pairs(spark, k, num, den):
    for data in (rows(), near_copies()):
        got = ngram_join.link_classes(frame(spark, data), k, num, den).collect()
        assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == classes(data, k, num, den)


@pytest.mark.parametrize("k,num,den", [(3, 90, 100), (5, 8, 10)])
def test_classes_equal_all_pairs_when_all_lists_are_long(spark, monkeypatch, k, num, den):
    monkeypatch.setattr(ngram_join, "SHORT_LIST", 1)
    data = [*near_copies(), *[(500 + i, t, "en", "s", 0) for i, (_, t, *_) in enumerate(near_copies(60, 8))]]
    got = ngram_join.link_classes(frame(spark, data), k, num, den).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == classes(data, k, num, den)


def test_parity_filter_keeps_links(spark):
    rng = np.random.default_rng(4)
    shapes, pairs, sets = [], [], []
    for k in range(600):
        x = np.unique(rng.integers(0, 1 << 60, rng.integers(1, 1500)).astype(np.uint64))
        keep = x[rng.random(len(x)) > rng.random() * 0.6]
        y = np.unique(np.concatenate([keep, rng.integers(0, 1 << 60, rng.integers(0, 300)).astype(np.uint64)]))
        for node, z in ((2 * k, x), (2 * k + 1, y)):
            shapes.append((node, len(z), ngram_join.parity_of(z).tolist()))
            sets.append(z)
        pairs.append((2 * k, 2 * k + 1))
    frames = spark.createDataFrame(pairs, "u long, v long"), spark.createDataFrame(shapes, "node long, n long, parity array<long>")
    for num, den in ((9, 10), (1, 2)):
        kept = {r["u"] for r in ngram_join._near_enough(*frames, num, den).collect()}
        linked = {u for u, v in pairs if len(sets[v]) and ngram_join.similar(sets[u], sets[v], num, den)}
        assert linked <= kept and len(kept) < 1.5 * len(linked) + 20


def test_linked_sets_have_a_part_in_common():
    rng = np.random.default_rng(3)
    for _ in range(3000):
        num, den = ((9, 10), (8, 10), (1, 2))[rng.integers(3)]
        x = np.unique(rng.integers(0, 1 << 60, rng.integers(1, 120)).astype(np.uint64))
        keep = x[rng.random(len(x)) > rng.random() * 0.3]
        y = np.unique(np.concatenate([keep, rng.integers(0, 1 << 60, rng.integers(0, 12)).astype(np.uint64)]))
        if len(y) and ngram_join.similar(x, y, num, den):
            assert set(ngram_join.part_keys(x, num, den)) & set(ngram_join.part_keys(y, num, den))


def test_unlike_documents_of_stock_sentences_do_not_meet_in_pairs(spark, monkeypatch):
    """Two thousand documents of 20 out of 60 sentences, and counters that tell next to nothing."""
    monkeypatch.setattr(ngram_join, "COUNTER_BITS", 4)
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    rng = random.Random(7)
    stock = [" ".join(f"w{rng.randrange(3000)}" for _ in range(12)) for _ in range(60)]
    data = [(i, " ".join(rng.sample(stock, 20)), "en", "s", 0) for i in range(2000)]
    data += [(3000 + i, data[i][1] + " more", "en", "s", 0) for i in range(40)]
    seen = []
    plain = ngram_join._near_enough

    def counted(pairs, *rest):
        seen.append(pairs.count())
        return plain(pairs, *rest)

    monkeypatch.setattr(ngram_join, "_near_enough", counted)
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.link_classes(frame(spark, data), 3, 90, 100).collect()}
    assert all(got[i] == i for i in range(2000)) and all(got[3000 + i] == i for i in range(40))
    print(seen)
    assert sum(seen) < 0.05 * 2000 * 1999 / 2


def test_empty_and_wordless_tables(spark):
    assert ngram_join.link_classes(frame(spark).where("false"), 3, 9, 10).count() == 0
    got = ngram_join.link_classes(frame(spark, [(1, None, "a", "b", 0), (2, " ", "a", "b", 1)]), 3, 9, 10).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == [(1, 0, 1), (2, 0, 2)]


def test_suffix_filter_is_a_lower_bound():
    rng = np.random.default_rng(2)
    for _ in range(300):
        x, y = (np.unique(rng.integers(0, 80, rng.integers(0, 40)).astype(np.uint64)) for _ in range(2))
        assert ngram_join.suffix_bound(x, y, 3) <= len(np.setxor1d(x, y))
        assert ngram_join.similar(x, y, 8, 10) == (10 * len(np.intersect1d(x, y)) >= 8 * len(np.union1d(x, y)))


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7), (200, 150)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    want = {i: 1 for i in range(1, 41)} | {100 + k: 100 for k in range(30)} | {200: 150, 150: 150}
    assert got == want


# --- lines


def one_edit(x, y):
    if x == y:
        return True
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y)) == 1
    if len(x) > len(y):
        x, y = y, x
    return len(y) - len(x) == 1 and any(y[:i] + y[i + 1 :] == x for i in range(len(y)))


def line_brute(data):
    """doc_id -> positions that go, by all pairs of lines."""
    first = {}
    places = []
    for d, t in sorted({(r[0], r[1]) for r in data if r[0] is not None}):
        for p, line in enumerate((t or "").split("\n")):
            line = line.strip(" ")
            if line:
                places.append((d, p, line))
                first.setdefault(line, (d, p))
    long = [(f, s.split(" ")) for s, f in first.items() if s.count(" ") + 1 >= lines.MIN_NEAR]
    near = {f for f, w in long if any(g < f and one_edit(v, w) for g, v in long)}
    gone = {}
    for d, p, s in places:
        if first[s] != (d, p) or first[s] in near:
            gone.setdefault(d, set()).add(p)
    return gone


def line_rows():
    extra = ["p q r s t u v w", "p q r s t u v", "p q r s t X v w", "p q X s t u v w", "q r s t u v w", "a a a a a a", "a a a a a", "a a b a a a", "k l m n o", "k l m n o q r", "  k l m n o  "]
    return [r for r in rows() if r[0] is not None] + [(1000 + i, "head line number\n" + t + "\n" + f"only {i} here now yes", "en", "s", 0) for i, t in enumerate(extra)]


def test_lines_equal_all_pairs(spark):
    data = line_rows()
    want = line_brute(data)
    got = lines.dedup_lines(frame(spark, data)).collect()
    assert len(got) == len(data)
    for r, text in ((r, {d[0]: d[1] for d in data}[r["doc_id"]]) for r in got):
        gone = want.get(r["doc_id"], set())
        assert r["n_removed"] == len(gone), (r["doc_id"], gone)
        kept = None if text is None else "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)
        assert r["text"] == kept


def test_half_rule_loses_no_pair():
    rng = random.Random(4)
    for _ in range(3000):
        n = rng.randint(5, 9)
        x = [rng.choice("ab") for _ in range(n)]
        y = list(x)
        kind, at = rng.randrange(3), rng.randrange(n)
        if kind == 0:
            y[at] = "c"
        elif kind == 1:
            y.insert(at, "c")
        elif n > 5:
            del y[at]
        halves = [{(m, side, tuple(w[:m] if side else w[-m:])) for m in (len(w) // 2, (len(w) - 1) // 2) for side in (0, 1)} for w in (x, y)]
        assert halves[0] & halves[1]


def test_lines_edges(spark, tmp_path):
    assert lines.dedup_lines(frame(spark).where("false")).count() == 0
    clash = frame(spark, [(1, "a b c\na b c", "x", "y", 0)]).selectExpr("doc_id", "text", "1 as n_lines", "'q' as gone")
    r = lines.dedup_lines(clash).first()
    assert (r["text"], r["n_lines"], r["n_removed"], r["gone"]) == ("a b c", 2, 1, "q")
    folder = save(frame(spark), tmp_path, "documents")
    assert lines.op9_line_dedup(spark, folder).count() == len(rows())


def test_rows_of_one_doc_id_or_of_none_keep_what_is_their_own(spark):
    data = [(1, "alpha beta gamma delta\nz", "a", "b", 0), (2, "alpha beta gamma delta\nx", "a", "b", 0), (2, "this unique line is here\ny", "a", "b", 0), (2, "this unique line is here\ny", "a", "b", 0)]
    got = sorted((r["doc_id"], r["text"]) for r in lines.dedup_lines(frame(spark, data)).collect())
    assert got == [(1, data[0][1]), (2, "this unique line is here\ny"), (2, "this unique line is here\ny"), (2, "x")]
    data = [(None, "one two three four five six", "a", "b", 0), (None, "one two three four five nine", "a", "b", 0), (5, "one two three four five ten\nq", "a", "b", 0)]
    got = lines.dedup_lines(frame(spark, data)).collect()
    assert sorted((r["doc_id"] is None, r["text"]) for r in got) in ([(False, "q"), (True, ""), (True, data[k][1])] for k in (0, 1))


def test_variants_equal_those_of_the_words(spark):
    rng = random.Random(1)
    data = [([rng.choice(["a", "b", "c"]) for _ in range(n)],) for n in (1, 2, 5, 6, 9, 61, 62, 130, 200) for _ in range(3)]
    df = spark.createDataFrame([(k, w) for k, (w,) in enumerate(data)], "first int, words array<string>")
    made = {(r["first"], r["gap"]): r["v"] for r in lines.variants(df).collect()}
    by_words = {}
    for k, (w,) in enumerate(data):
        assert (k, len(w)) in made and (k, len(w) + 1) not in made
        for gap in range(len(w) + 1):
            by_words.setdefault(tuple(w[: gap - 1] + w[gap:] if gap else w), set()).add(made[k, gap])
    assert all(len(v) == 1 for v in by_words.values())
    assert len({v for s in by_words.values() for v in s}) == len(by_words)


def test_very_long_lines(spark):
    words = [f"w{k}" for k in range(200_000)]
    data = [(1, " ".join(words), "a", "b", 0), (2, " ".join([*words[:150_000], "other", *words[150_001:]]) + "\nrest", "a", "b", 0), (3, " ".join(words[:-1]) + "\nx", "a", "b", 0)]
    got = {r["doc_id"]: (len(r["text"]), r["n_removed"]) for r in lines.dedup_lines(frame(spark, data, 3)).collect()}
    assert got == {1: (len(data[0][1]), 0), 2: (4, 1), 3: (1, 1)}


def test_equal_lines_of_any_length_go(spark):
    data = [(1, "Les.\n\n没有空格的一行\nx\ty\tz", "a", "b", 0), (2, "Les.\n\n没有空格的一行\nx\ty\tz\nnew", "a", "b", 0), (3, "Les. Les.\n Les. ", "a", "b", 0)]
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in lines.dedup_lines(frame(spark, data)).collect()}
    assert got == {1: (data[0][1], 0), 2: ("\nnew", 3), 3: ("Les. Les.", 1)}
