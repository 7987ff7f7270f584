"""N-gram Jaccard self join: rare-first prefix filtering with length, positional and suffix filters.

Documents are sets of word shingles. Two sets of n and m shingles with a Jaccard similarity of t or
more share a shingle among the first n - ceil(t n) + 1 of one and the like of the other, in any common
order; rare shingles go first. The steps:

1. corpus frequencies of all shingles, in a table of fixed size of hashed counters (its size bounds
   what is broadcast; any order is correct, the table only decides how rare-first it is);
2. per document the size, a 64-bit digest of its set (equal sets are one node from here on) and the
   prefix; node and prefix shingles go to Parquet;
3. every shingle that several nodes have in their prefix has a pivot, the node that has it earliest;
   all others are candidates of the pivot, under the length and the positional filter;
4. candidates are verified once per pair: suffix filter (a lower bound of the symmetric difference, first
   from parity bitmaps of the sets, then from cutting both at middle tokens), then the exact
   intersection of both sets, which are rebuilt for the nodes concerned only;
5. nodes that a shingle has in common and that are not in one component after that are looked at once more:
   in short lists all pairs across components, under the same filters; longer lists are dealt anew by
   parts of the sets. Sets of similar sizes are cut by a hash of the shingles into more parts than a linked pair
   can differ in, so any linked pair has a part in common, and only nodes of one list, range of sizes and
   equal part meet, under the same filters. What is left is verified as well, so no link that joins components is lost, while neither the
   members of a large group of near copies nor many unlike documents with a frequent shingle meet pair by pair.

The counters tell shingles less apart the larger the corpus; that makes lists longer, and longer lists are
dealt by parts. The frequent shingle of a large group is handled by aggregates and joins whose skewed keys Spark
splits, never by one task. Links within a component that is already joined aren't looked for.

Defined cases: a null or empty text has no shingles and is linked with nothing; fewer words than a
shingle has count as one shingle; repeated rows are one node, and so are texts of equal sets; rows of a null doc_id get the smallest
doc_id of their component, or null; equal frequencies are ordered by the hash; very long texts are whole sets; an empty table gives
an empty one; other columns of the input are not read, whatever their names. Nodes are 64-bit digests: below 6e9 different texts no two are
expected to meet.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from speechmill.llm.common import seen_in, shuffle_width, staged, table
from speechmill.llm.components import connected_components
from speechmill.llm.shingles import mix, shingle_hashes, shingle_sets, slices, string_buffer, word_hashes

#: Counters of shingle frequencies (as a power of two), and how many travel in one block.
COUNTER_BITS, BLOCK = 20, 1 << 12
#: Nodes of a list whose pairs are made at once; longer lists are dealt by parts of the sets.
SHORT_LIST = 128
#: Bits for each wanted document in the filter that picks them: what passes besides carries a whole set.
BITS_OF_WANTED = 256
#: Least and most bits of the parity bitmaps of sets, which have two bits a shingle in between.
PARITY_BITS, MOST_PARITY_BITS = 512, 1 << 17


def counter_of(h: np.ndarray, size: int) -> np.ndarray:
    return (h >> np.uint64(65 - size.bit_length())).astype(np.int64)


def frequencies(docs: DataFrame, words: int) -> np.ndarray:
    """Hashed corpus counts of all shingles: 2 ** COUNTER_BITS numbers, whatever the corpus."""
    size = 1 << COUNTER_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.uint32)
        for b in batches:
            data, off = string_buffer(b.column("text"))
            for i, j in slices(off):
                w, first = word_hashes(data[off[i] : off[j]], off[i : j + 1] - off[i])
                h, _ = shingle_hashes(w, first, words)
                np.add.at(counts, counter_of(h, size), np.uint32(1))
        blocks = counts.reshape(-1, BLOCK)
        full = np.flatnonzero(blocks.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([blocks[k].tobytes() for k in full], pa.binary())], names=["block", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, c in zip(b.column("block").to_pylist(), b.column("counts").to_pylist()):
                part = np.frombuffer(c, np.uint32).astype(np.uint64)
                total[k] = total[k] + part if k in total else part
        out = sorted(total)
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.int32()), pa.array([np.minimum(total[k], 2**32 - 1).astype(np.uint32).tobytes() for k in out], pa.binary())], names=["block", "counts"])

    schema = "block int, counts binary"
    parts = docs.select("text").mapInArrow(count, schema).repartition(shuffle_width(docs.sparkSession), "block")
    out = np.zeros((size // BLOCK, BLOCK), np.uint32)
    for r in parts.mapInArrow(add, schema).collect():  # 4 bytes a counter
        out[r["block"]] = np.frombuffer(bytes(r["counts"]), np.uint32)
    return out.ravel()


def digest(shingles: np.ndarray) -> int:
    """Of a set of shingle hashes, as a signed 64-bit integer."""
    h = int(mix(shingles ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)) ^ (len(shingles) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    return h - (1 << 64) if h >= 1 << 63 else h


def parity_of(shingles: np.ndarray) -> np.ndarray:
    """Whether the number of shingles with each hash is odd, in 64-bit words; a bitmap of half the bits is that of
    both halves combined by exclusive or."""
    bits = min(max(PARITY_BITS, 1 << max(0, 2 * len(shingles) - 1).bit_length()), MOST_PARITY_BITS)
    odd = np.bincount((mix(shingles) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def prefixes(docs: DataFrame, counts: np.ndarray, words: int, num: int, den: int) -> DataFrame:
    """(doc_id, n, node, prefix, parity); node is null and the prefix empty for texts without words.
    parity: as of parity_of."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)  # 4 bytes a counter

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freq = shared.value
        for b in batches:
            n, node, prefix, parity = [], [], [], []
            for _, h in shingle_sets(b.column("text"), words):
                size = len(h)
                n.append(size)
                node.append(digest(h) if size else None)
                order = np.argsort(freq[counter_of(h, len(freq))], kind="stable")[: size - (-(-num * size // den)) + 1] if size else []
                parity.append(parity_of(h))
                prefix.append(h[order].view(np.int64) if size else np.zeros(0, np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(p) for p in prefix])]), pa.int32()), pa.array(np.concatenate(prefix) if prefix else np.zeros(0, np.int64), pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(node, pa.int64()), lists, pa.array(parity, pa.list_(pa.int64()))], names=["doc_id", "n", "node", "prefix", "parity"])

    return docs.mapInArrow(run, "doc_id long, n long, node long, prefix array<long>, parity array<long>")


def sets_of(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(node, shingles) of the documents that wanted(doc_id) names, and perhaps of a few more: a
    filter of at most a fixed size picks them where they are read, so no text is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                sets = [h for _, h in shingle_sets(b.column("text").slice(at, 1000), words) if len(h)]
                yield pa.RecordBatch.from_arrays([pa.array([digest(h) for h in sets], pa.int64()), pa.array([h.tobytes() for h in sets], pa.binary())], names=["node", "shingles"])

    return docs.where(seen_in(wanted, "doc_id", BITS_OF_WANTED)(F.col("doc_id"))).mapInArrow(run, "node long, shingles binary")


def bands(n: int, num: int, den: int) -> list[tuple[int, int]]:
    """(band, largest size) of the two overlapping ranges of sizes that a set of n shingles is in. Two sets
    that can be linked by their sizes have one of them in common."""
    begins, at = [1], 1
    while at <= n:
        at = at * den // num + 1
        begins.append(at)
    own = len(begins) - 2
    begins.append(at * den // num + 1)
    return [(k, begins[k + 2] - 1) for k in (own - 1, own) if k >= 0]


def part_keys(shingles: np.ndarray, num: int, den: int) -> list[int]:
    """Hashes of the parts of a set, for each of its ranges of sizes. Linked sets of a range differ in at most
    ``apart`` shingles, hence of more parts than that some are equal; as there are some more still, one of
    those isn't empty, unless the set has so many empty ones that they are listed too."""
    out: list[int] = []
    mixed = mix(shingles ^ np.uint64(0x5851F42D4C957F2D))
    for band, most in bands(len(shingles), num, den):
        apart = 2 * most * (den - num) // (num + den)
        parts = apart + 1 + -(-apart // 4)
        of = (mix(shingles ^ np.uint64(band + 1)) % np.uint64(parts)).astype(np.int64)
        sums = np.zeros(parts, np.uint64)
        np.add.at(sums, of, mixed)
        full = np.bincount(of, minlength=parts) > 0
        if (~full).sum() >= parts - apart:
            full[:] = True
        at = np.flatnonzero(full)
        out += mix(mix(sums[at]) + (at + (band << 32)).astype(np.uint64)).view(np.int64).tolist()
    return out


def dealt(docs: DataFrame, wanted: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """(node, keys) of the documents that wanted(doc_id) names, and perhaps of a few more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 200):
                sets = [h for _, h in shingle_sets(b.column("text").slice(at, 200), words) if len(h)]
                keys = pa.array([part_keys(h, num, den) for h in sets], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([digest(h) for h in sets], pa.int64()), keys], names=["node", "keys"])

    return docs.where(seen_in(wanted, "doc_id", BITS_OF_WANTED)(F.col("doc_id"))).mapInArrow(run, "node long, keys array<long>")


def suffix_bound(x: np.ndarray, y: np.ndarray, depth: int = 2) -> int:
    """A lower bound of the size of the symmetric difference of two sorted sets: both are cut at the
    middle token of one, parts on either side can't match across, and so on within the parts."""
    if depth == 0 or not len(x) or not len(y):
        return abs(len(x) - len(y))
    mid = y[len(y) // 2]
    i, j = np.searchsorted(x, mid), len(y) // 2
    return suffix_bound(x[:i], y[:j], depth - 1) + suffix_bound(x[i:], y[j:], depth - 1)


def similar(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    """Whether den * |x and y| >= num * |x or y|, for sorted distinct hashes."""
    both = len(x) + len(y)
    need = -(-num * both // (num + den))
    if suffix_bound(x, y) > both - 2 * need:
        return False
    return len(np.intersect1d(x, y, assume_unique=True)) >= need


def _near_enough(pairs: DataFrame, shapes: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs that the parity bitmaps allow: bits that differ are at most the size of the symmetric
    difference, and that is at most n + m - 2 * (the intersection that a link needs)."""
    either = pairs.select(F.col("u").alias("node")).union(pairs.select(F.col("v").alias("node")))
    shapes = shapes.where(seen_in(either, "node")(F.col("node")))
    left = shapes.select(F.col("node").alias("u"), F.col("n").alias("n"), F.col("parity").alias("x"))
    right = shapes.select(F.col("node").alias("v"), F.col("n").alias("m"), F.col("parity").alias("y"))

    def folded(x: Column, y: Column) -> Column:
        """x, in half its bits if y has no more than those; sizes that differ more can't be linked, or have all bits."""
        half = F.size(x) / 2
        halves = F.zip_with(F.slice(x, 1, half.cast("int")), F.slice(x, half.cast("int") + 1, half.cast("int")), lambda a, b: a.bitwiseXOR(b))
        return F.when(F.size(x) > F.size(y), halves).otherwise(x)

    x, y = folded(F.col("x"), F.col("y")), folded(F.col("y"), F.col("x"))
    bits = F.aggregate(F.zip_with(x, y, lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, c: s + F.coalesce(c, F.lit(0)))
    differ = F.when(F.size("x") * 2 < F.size("y"), 0).when(F.size("y") * 2 < F.size("x"), 0).otherwise(bits)
    both = F.col("n") + F.col("m")
    need = F.floor((num * both + (num + den - 1)) / (num + den))
    return pairs.join(left, "u").join(right, "v").where(differ <= both - 2 * need).select("u", "v")


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The links (u, v) among pairs(u, v)."""
    left = sets.select(F.col("node").alias("u"), F.col("shingles").alias("x"))
    right = sets.select(F.col("node").alias("v"), F.col("shingles").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), num, den) for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("u").filter(pa.array(keep, pa.bool_())), b.column("v").filter(pa.array(keep, pa.bool_()))], names=["u", "v"])

    return pairs.join(left, "u").join(right, "v").select("u", "v", "x", "y").mapInArrow(run, "u long, v long")



def _may_link(n: Column, pos: Column, m: Column, pos_m: Column, num: int, den: int) -> Column:
    """Length filter, and positional filter: what follows a common shingle must still suffice."""
    need = F.floor((num * (n + m) + (num + den - 1)) / (num + den))
    return (F.least(n, m) * den >= F.greatest(n, m) * num) & (F.least(n - pos, m - pos_m) >= need)


def link_classes(docs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs(doc_id, text): classes of documents
    that are connected by links of a Jaccard similarity of num / den or more."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = staged(prefixes(docs, frequencies(docs, words), words, num, den), "prefixes")

    nodes = rows.where("node is not null").groupBy("node").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("parity").alias("parity"))
    nodes = staged(nodes, "nodes")
    shared = staged(nodes.select(F.explode("prefix").alias("h")).groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h"), "shared")
    posts = nodes.select("node", "n", F.posexplode("prefix").alias("pos", "h")).where(seen_in(shared, "h")(F.col("h"))).select("h", "node", F.col("n").cast("int").alias("n"), F.col("pos").cast("int").alias("pos"))
    pivots = posts.groupBy("h").agg(F.min(F.struct("pos", "n", "node")).alias("p"), F.count("*").alias("c"), F.min("n").alias("least_n")).where("c > 1").select("h", F.col("p.pos").alias("p_pos"), F.col("p.n").alias("p_n"), F.col("p.node").alias("p_node"), "least_n")
    lists = staged(posts.join(pivots, "h"), "lists")

    first = lists.where("node <> p_node").where(_may_link(F.col("n"), F.col("pos"), F.col("p_n"), F.col("p_pos"), num, den))
    pairs = staged(first.select(F.least("node", "p_node").alias("u"), F.greatest("node", "p_node").alias("v")).distinct(), "pairs")
    shapes = nodes.select("node", "n", "parity")
    members = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"))

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = staged(_near_enough(pairs, shapes, num, den), "near")
        concerned = pairs.select(F.col("u").alias("node")).union(pairs.select(F.col("v").alias("node"))).distinct()
        sets = staged(sets_of(docs, concerned.join(members, "node"), words), "sets")
        count = sets.agg(F.count("node").alias("n"), F.count_distinct("node").alias("d")).first()
        if count["n"] > count["d"]:  # repeated rows
            sets = staged(sets.groupBy("node").agg(F.first("shingles").alias("shingles")), "sets")
        return staged(_verified(pairs, sets, num, den), "verified")

    links = verified(pairs)
    roots = connected_components(links)

    # rows of lists that hold several components, and that a partner of the list could still suit
    least = F.greatest(F.col("least_n"), F.floor((num * F.col("n") + den - 1) / den))
    room = F.col("n") - F.col("pos") >= F.floor((num * (F.col("n") + least) + (num + den - 1)) / (num + den))
    roots = staged(roots, "roots")
    linked = seen_in(roots, "node")(F.col("node"))
    rest = lists.where(room).select("h", "node", "n", "pos")
    known = rest.where(linked).join(roots, "node", "left").select("h", "node", "n", "pos", F.coalesce("root", "node").alias("root"))
    rest = known.union(rest.where(~linked).withColumn("root", F.col("node")))
    several = rest.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("c")).where("lo <> hi").select("h", "c")
    rest = staged(rest.join(several, "h"), "rest")

    def across(rows: DataFrame, key: str, may: Callable[..., Column]) -> DataFrame:
        """The pairs of nodes of one key that are of different components."""
        a = rows.select(key, *[F.col(c).alias(f"a_{c}") for c in rows.columns if c != key])
        b = rows.select(key, *[F.col(c).alias(f"b_{c}") for c in rows.columns if c != key])
        apart = (F.col("a_root") != F.col("b_root")) & (F.col("a_node") < F.col("b_node"))
        return a.join(b, key).where(apart & may()).select(F.col("a_node").alias("u"), F.col("b_node").alias("v"))

    short = rest.where(F.col("c") <= SHORT_LIST).select("h", "node", "n", "pos", "root")
    more = across(short, "h", lambda: _may_link(F.col("a_n"), F.col("a_pos"), F.col("b_n"), F.col("b_pos"), num, den))
    long = rest.where(F.col("c") > SHORT_LIST).select("h", "node", "n", "pos", "root")
    if long.take(1):
        long = staged(long, "long")
        keys = dealt(docs, long.select("node").distinct().join(members, "node"), words, num, den)
        # a list and a part of the set together
        keyed = long.join(keys.dropDuplicates(["node"]), "node").select("node", "n", "pos", "root", "h", F.explode("keys").alias("key")).withColumn("key", F.xxhash64("h", "key")).drop("h")
        keyed = staged(keyed, "parts")
        shared_parts = staged(keyed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key"), "shared")
        keyed = keyed.where(seen_in(shared_parts, "key")(F.col("key"))).join(shared_parts, "key")
        more = more.union(across(keyed, "key", lambda: _may_link(F.col("a_n"), F.col("a_pos"), F.col("b_n"), F.col("b_pos"), num, den)))
    more = staged(more.distinct().join(pairs, ["u", "v"], "left_anti"), "pairs")
    if more.take(1):
        new = verified(more)
        if new.take(1):
            roots = connected_components(links.union(new))

    rooted = staged(members.join(roots, "node", "left").select("node", "doc_id", F.coalesce("root", "node").alias("root")), "rooted")
    lowest = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = rooted.select("node", "root").join(lowest, "root").select("node", "component_id")
    return (
        rows.select("doc_id", "n", "node")
        .join(named, "node", "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
    )


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_classes(table(spark, sf_dir, "documents"), words=3, num=90, den=100)


QUERIES = {"op2_ngram_join": op2_ngram_join}
ORACLE = {
    "op2_ngram_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS s FROM s),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.s = b.s AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(reach.b) AS component_id FROM s JOIN reach ON s.doc_id = reach.a GROUP BY ALL
"""
}
