"""Line dedup over the whole corpus by a deletion-neighbourhood join, in DataFrame functions only.

A line (of its text trimmed of spaces) goes if the same line, or one within one word edit
(insertion, deletion or replacement), comes earlier in the corpus, in the order of doc_id and then
of position. Equal lines that aren't empty count at any length, near ones from ``MIN_NEAR`` words on, so that
one edit leaves a similarity of 0.8 or more. Words are what single spaces separate.

1. equal lines are aggregated by hash to their earliest occurrence;
2. two lines within one word edit have all words before or all words after their middle in common:
   only lines that share such a half with another line go on (no pair within the bound is lost);
3. these emit the hash of the line itself and of the line without each of its words; equal variants
   meet. Lines that lack the same place are one replacement apart, so the earliest of such a group
   stands for all; a line that equals another's variant is one insertion away. Both give one
   candidate per line and variant, never all pairs of a group. All variants of a line come from running sums of
   its word hashes, each turned by its place: their cost doesn't grow with the square of the line;
4. the candidates are verified on the words themselves.

Texts are joined by row with shuffles at every size: what they meet grows with the corpus, so it is
never broadcast. Keys are aggregated before they are shuffled, and joins on them hold one row per key on one side, so
a line that fills a third of the corpus is split as any skewed join.

Defined cases: a null text stays null and has no lines; empty lines stay, and so does the text of a document that
has no other; a document may be left with an empty text. A row is known by its doc_id and its text: different
texts of one doc_id are different documents, in the order of a hash of them, repeated rows count as one document and keep the same lines.
Null doc_ids come before all others, and are no less compared. Lines of any length are compared whole. An empty table gives an
empty one; columns of the input that have the name of an output column are replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from speechmill.llm.common import seen_in, staged, table, without

MIN_NEAR = 5
#: A Mersenne prime: doubling modulo it turns the bits of a number.
BITS = 61
PRIME = (1 << BITS) - 1


def _word_count(line: Column) -> Column:
    return F.when(line == "", 0).otherwise(F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1)


def rows_of(docs: DataFrame) -> DataFrame:
    """(doc_id, key, text): the key tells rows of different texts apart, whatever their doc_id."""
    return docs.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), "text")


def lines_of(rows: DataFrame) -> DataFrame:
    """(doc_id, key, pos, line, n) of all lines that can be removed."""
    lines = rows.select("doc_id", "key", F.posexplode(F.split("text", "\n", -1)).alias("pos", "raw")).select("doc_id", "key", "pos", F.trim("raw").alias("line"))
    return lines.withColumn("n", _word_count(F.col("line"))).where("n > 0")


def _half_keys() -> Column:
    """The hashes of the words before and after the middle, for both middles a partner may have."""

    def half(m: str, tag: str, sign: str) -> Column:
        return F.expr(f"xxhash64('{tag}', {m}, substring_index(line, ' ', {sign}({m})))")

    upper, lower = "cast(floor(n / 2) as int)", "cast(floor((n - 1) / 2) as int)"
    both = F.array(half(upper, "first", ""), half(upper, "last", "-"), half(lower, "first", ""), half(lower, "last", "-"))
    one = F.array(half(upper, "first", ""), half(upper, "last", "-"))
    return F.when(F.col("n") < MIN_NEAR, F.expr("cast(array() as array<bigint>)")).when(F.col("n") % 2 == 0, both).otherwise(one)


def one_word_edit(x: Column, y: Column) -> Column:
    """Whether two arrays of words are at most one insertion, deletion or replacement apart."""
    short, long = F.when(F.size(x) <= F.size(y), x).otherwise(y), F.when(F.size(x) <= F.size(y), y).otherwise(x)
    differs = F.array_position(F.zip_with(short, long, lambda a, b: a.eqNullSafe(b)), False)
    rest = F.size(long)
    same = F.slice(short, differs + 1, rest) == F.slice(long, differs + 1, rest)
    grown = F.slice(short, differs, rest) == F.slice(long, differs + 1, rest)
    return F.when(F.size(long) - F.size(short) > 1, False).when(differs == 0, True).when(F.size(x) == F.size(y), same).otherwise(grown)


def _turn(h: Column, places: Column) -> Column:
    """``h`` times two to the power of ``places`` modulo PRIME."""
    left = (places % BITS).cast("int")
    return F.call_function("shiftleft", h, left).bitwiseAND(F.lit(PRIME)).bitwiseOR(F.call_function("shiftrightunsigned", h, F.lit(BITS) - left))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _running_sums(terms: Column, n: Column) -> Column:
    """The sums modulo PRIME of the first 1 to n of ``terms``, by blocks of about the root of n."""
    none = F.expr("cast(array() as array<bigint>)")
    zero = F.lit(0).cast("long")

    def sums(x: Column) -> Column:
        def step(acc: Column, t: Column) -> Column:
            at = (acc["at"] + t) % PRIME
            return F.struct(at.alias("at"), F.array_append(acc["out"], at).alias("out"))

        return F.aggregate(x, F.struct(zero.alias("at"), none.alias("out")), step, lambda acc: acc["out"])

    size = F.ceil(F.sqrt(n)).cast("int")
    blocks = _let(terms, lambda t: F.transform(F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int")), lambda b: sums(F.slice(t, b * size + 1, size))))
    before = lambda bs: F.concat(F.array(zero), sums(F.transform(bs, lambda b: F.element_at(b, -1))))
    return _let(blocks, lambda bs: _let(before(bs), lambda sofar: F.flatten(F.transform(bs, lambda b, i: _let(F.get(sofar, i), lambda more: F.transform(b, lambda x: (x + more) % PRIME))))))


def variants(lines: DataFrame) -> DataFrame:
    """(first, gap, v): of lines(first, words) the hash of the line (gap 0) and of the line without each of its words."""
    n = F.size("words")
    terms = F.transform("words", lambda w, j: _turn(F.xxhash64(w).bitwiseAND(F.lit(PRIME)) % PRIME, j))

    def every(upto: Column, whole: Column) -> Column:
        # words after the gap move up by one place: half their weight
        def without_word(i: Column) -> Column:
            after = _turn((whole - F.element_at(upto, i) + PRIME) % PRIME, F.lit(BITS - 1))
            return F.struct(i.alias("gap"), ((F.coalesce(F.get(upto, i - 2), F.lit(0).cast("long")) + after) % PRIME).alias("v"))

        return F.concat(F.array(F.struct(F.lit(0).alias("gap"), whole.alias("v"))), F.transform(F.sequence(F.lit(1), n), without_word))

    made = _let(_running_sums(terms, n), lambda upto: _let(F.element_at(upto, -1), lambda whole: every(upto, whole)))
    return lines.select("first", F.explode(made).alias("x")).select("first", "x.gap", "x.v")


def near_lines(rows: DataFrame, distinct: DataFrame) -> DataFrame:
    """(first) of each line that an earlier line is one edit away from.

    distinct: first struct<doc_id, key, pos> of each distinct line, with its half keys."""
    keys = distinct.select("first", F.explode("halves").alias("half"))
    shared = staged(keys.groupBy("half").agg(F.count("*").alias("c")).where("c > 1").select("half"), "halves")
    places = keys.where(seen_in(shared, "half")(F.col("half"))).join(shared, "half").select("first").distinct()
    per_row = staged(places.groupBy(F.col("first.doc_id").alias("of_id"), F.col("first.key").alias("of_key")).agg(F.collect_list("first.pos").alias("at")), "places")
    met = rows.where(seen_in(per_row, "of_key")(F.col("key"))).select("doc_id", "key", F.split("text", "\n", -1).alias("all"))
    split = met.join(per_row.hint("merge"), (F.col("key") == F.col("of_key")) & F.col("doc_id").eqNullSafe(F.col("of_id"))).select("doc_id", "key", "all", F.explode("at").alias("pos"))
    words = F.split(F.trim(F.element_at("all", F.col("pos") + 1)), " ", -1)
    chosen = staged(split.select(F.struct("doc_id", "key", "pos").alias("first"), words.alias("words")).dropDuplicates(["first"]), "chosen")

    made = staged(variants(chosen), "variants")
    cut = made.where("gap > 0")
    earliest = staged(cut.groupBy("v", "gap").agg(F.min("first").alias("early"), F.count("*").alias("c")).where("c > 1").select("v", "gap", "early"), "earliest")
    replaced = cut.where(seen_in(earliest, "v")(F.col("v"))).join(earliest, ["v", "gap"]).where("first > early").select("early", F.col("first").alias("late"))
    whole = made.where("gap = 0").select("v", F.col("first").alias("other"))
    inserted = cut.where(seen_in(whole, "v")(F.col("v"))).join(whole, "v").where("not (first <=> other)").select(F.least("first", "other").alias("early"), F.greatest("first", "other").alias("late"))
    pairs = replaced.union(inserted).distinct()
    checked = (
        pairs.join(chosen.select(F.col("first").alias("early"), F.col("words").alias("x")), "early")
        .join(chosen.select(F.col("first").alias("late"), F.col("words").alias("y")), "late")
        .where(one_word_edit(F.col("x"), F.col("y")))
    )
    return checked.select(F.col("late").alias("first")).distinct()


def removed_lines(docs: DataFrame) -> DataFrame:
    """(of_id, of_key, gone): the positions that go, for rows that lose any."""
    rows = rows_of(docs)
    place = F.struct("doc_id", "key", "pos")
    hashes = (F.xxhash64("line").alias("h1"), F.hash("line").alias("h2"))
    lines = lines_of(rows).select(place.alias("first"), *hashes, _half_keys().alias("halves"))
    distinct = staged(lines.groupBy("h1", "h2").agg(F.min("first").alias("first"), F.count("*").alias("c"), F.first("halves").alias("halves")), "lines")
    near = near_lines(rows, distinct.select("first", "halves")).withColumn("near", F.lit(True))
    marked = staged(distinct.select("h1", "h2", "first", "c").join(near, "first", "left").where("c > 1 or near").select("h1", "h2", "first", F.coalesce("near", F.lit(False)).alias("near")), "marked")
    every = lines_of(rows).select("doc_id", "key", "pos", *hashes)
    gone = every.where(seen_in(marked, "h1")(F.col("h1"))).join(marked, ["h1", "h2"]).where(F.col("near") | ~F.col("first").eqNullSafe(place)).select("doc_id", "key", "pos")
    return gone.groupBy(F.col("doc_id").alias("of_id"), F.col("key").alias("of_key")).agg(F.collect_set("pos").alias("gone_at"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with ``text`` of the lines that stay, and ``n_lines``, ``n_removed`` long."""
    docs = without(docs, "n_lines", "n_removed")
    gone = staged(removed_lines(docs), "gone").select(*[F.col(c).alias(f"_{c}_") for c in ("of_id", "of_key", "gone_at")])
    joined = docs.join(gone.hint("merge"), (F.xxhash64("doc_id", "text") == F.col("_of_key_")) & F.col("doc_id").eqNullSafe(F.col("_of_id_")), "left")
    lines = F.split("text", "\n", -1)
    places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "_gone_at_")
    kept = _let(lines, lambda x: F.transform(places, lambda i: F.get(x, i)))
    text = F.when(F.col("_gone_at_").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return joined.select(
        *[F.col(f"`{c}`") if c.lower() != "text" else text.alias(c) for c in docs.columns],
        F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("_gone_at_"), F.lit(0)).cast("long").alias("n_removed"),
    )


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


QUERIES = {"op9_line_dedup": op9_line_dedup}
ORACLE = {
    "op9_line_dedup": r"""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
p AS (SELECT doc_id, pos, trim(ls[pos], ' ') AS line FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS pos FROM l)),
c AS (SELECT doc_id, pos, line, string_split(line, ' ') AS w FROM p WHERE line <> ''),
d AS (SELECT line, any_value(w) AS w, min((doc_id, pos)) AS f FROM c GROUP BY line),
v AS (SELECT f, gap, array_to_string(list_concat(w[1:gap - 1], w[gap + 1:]), ' ') AS v FROM (SELECT f, w, unnest(range(1, len(w) + 1)) AS gap FROM d WHERE len(w) >= 5)),
late AS (
  SELECT a.f FROM v a JOIN (SELECT v, gap, min(f) AS e FROM v GROUP BY ALL HAVING count(*) > 1) b ON a.v = b.v AND a.gap = b.gap WHERE a.f > b.e
  UNION
  SELECT greatest(a.f, d.f) FROM v a JOIN d ON a.v = d.line WHERE a.f <> d.f AND len(d.w) >= 5),
gone AS (
  SELECT DISTINCT c.doc_id, c.pos FROM c JOIN d ON c.line = d.line LEFT JOIN late ON late.f = d.f WHERE late.f IS NOT NULL OR d.f <> (c.doc_id, c.pos)),
g AS (SELECT doc_id, list(pos) AS gp FROM gone GROUP BY 1)
SELECT l.doc_id, CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(gp), 0) AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string(list_filter(ls, lambda x, i: NOT list_contains(coalesce(gp, []), i)), chr(10)), '')) AS kept_sha256
FROM l LEFT JOIN g ON l.doc_id = g.doc_id
"""
}
