"""Text and audio: a token time alignment joined with the words of a text, spans and utterances.

Words and aligned tokens are numbered on their own and meet by (slug, ordinal). What doesn't fit
is set aside with its reason rather than stopping the run (strict=True raises).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from speechmill.functions import numbers, text
from speechmill.operators.ordered import with_runs


def text_words(excerpts: DataFrame) -> DataFrame:
    """Words of excerpts(slug, excerpt, verse, text) with their ordinal, and the standalone punctuation
    before each (``marks``, the last two of them). Punctuation before the first word of an excerpt closes
    the one before. Texts are dealt by slug before they are cut, words don't move any more; to a fixed number
    of tasks, as the size of the texts says little of the work."""
    parts = int(excerpts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = excerpts.select("slug", "excerpt", "verse", "text").repartition(parts, "slug").select("slug", "excerpt", "verse", F.posexplode(text.words(F.col("text"))).alias("at", "word"))
    w = Window.partitionBy("slug").orderBy("excerpt", "at")
    marked = pieces.withColumn("mark", F.when(text.is_punctuation(F.col("word")), F.col("word")))
    ordinal = F.count(F.when(F.col("mark").isNull(), 1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    numbered = marked.select("*", ordinal.alias("ordinal"), F.lag("mark", 1).over(w).alias("last"), F.lag("mark", 2).over(w).alias("last_but_one"))
    marks = F.when(F.col("last").isNotNull(), F.array_compact(F.array("last_but_one", "last")))
    return numbered.where("mark is null").select("slug", "excerpt", "verse", "ordinal", "word", marks.alias("marks"))


def aligned_tokens(alignment: DataFrame) -> DataFrame:
    """Runs of one token of alignment(slug, row_idx, begin, duration, token, ort), numbered, with the
    silence before each (``silences``: how many rows it had in its last two runs)."""
    rows = with_runs(alignment, ["slug"], ["row_idx"], "token").groupBy("slug", "run").agg(
        F.first("ort", ignorenulls=True).alias("ort"),
        F.min_by("begin", "row_idx").alias("begin"),
        F.max_by(F.col("begin") + F.col("duration"), "row_idx").alias("end"),
        F.count("*").alias("n_rows"),
    )
    w = Window.partitionBy("slug").orderBy("run")
    silence = F.when(F.col("ort").isNull(), F.struct("n_rows", "begin", "end"))
    ordinal = F.count("ort").over(w.rowsBetween(Window.unboundedPreceding, 0))
    numbered = rows.select("*", ordinal.alias("ordinal"), F.lag(silence, 1).over(w).alias("last"), F.lag(silence, 2).over(w).alias("last_but_one"))
    before = F.when(F.col("last").isNotNull(), F.struct(
        (F.col("last.n_rows") + F.coalesce("last_but_one.n_rows", F.lit(0))).alias("silences"),
        F.least("last_but_one.begin", "last.begin").alias("s_begin"),
        F.greatest("last_but_one.end", "last.end").alias("s_end"),
    ))
    return numbered.where("ort is not null").select("slug", "ordinal", "ort", "begin", "end", before.alias("before")).select("slug", "ordinal", "ort", "begin", "end", "before.*")


def align(excerpts: DataFrame, alignment: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(spans, errors). spans(slug, verse, tokens): one a verse, tokens in order; at a change of verse the
    silence is halved, the first half closes the old span and the second opens the new one.

    Both sides are dealt by slug once; all that follows needs the rows of a slug in order. A null slug is
    one like others."""
    words, found = text_words(excerpts), aligned_tokens(alignment)
    w = Window.partitionBy("slug").orderBy("ordinal")
    plain, spoken = F.col("plain"), F.col("number.spoken")
    # only for digits, and in a lambda: the long expressions don't become part of the code of every word
    number = F.transform(F.filter(F.array(plain), text.is_digits), lambda p: F.struct(numbers.int_to_papiamentu(p.try_cast("long")).alias("spoken"), numbers.int_to_spanish(p.try_cast("long")).alias("foreign")))
    sides = words.unionByName(found, allowMissingColumns=True)
    joined = (
        # an ordinal is there once on each side at most
        sides.groupBy("slug", "ordinal").agg(*[F.first(c, ignorenulls=True).alias(c) for c in sides.columns if c not in ("slug", "ordinal")])
        .withColumn("plain", text.normalize_text(F.col("word")))
        .withColumn("number", F.get(number, F.lit(0)))
        .withColumn(
            "problem",
            F.when(F.col("word").isNull(), "token without word")
            .when(F.col("ort").isNull(), "word without token")
            .when(F.size("marks") > 1, "two marks in a row")
            .when(F.col("silences") > 1, "two silences in a row")
            .when(~text.token_matches(F.col("word"), plain, F.col("ort"), spoken, F.col("number.foreign")), "word and token differ"),
        )
    )
    errors = joined.where("problem is not null").select("slug", "ordinal", "word", "ort", "problem")
    if strict:
        first = errors.orderBy("slug", "ordinal").first()
        if first:
            raise ValueError(f"{first['slug']} at {first['ordinal']}: {first['problem']} ({first['word']}, {first['ort']})")
    # what is told of a word by itself goes before the windows: more in one step would be more code than the JVM compiles
    told = joined.select(
        "slug", "excerpt", "verse", "ordinal", F.get("marks", F.lit(0)).alias("mark"), "begin", "end", "s_begin", "s_end", "problem",
        text.leading_punctuation(F.col("word")).alias("leading"), text.trailing_punctuation(F.col("word")).alias("trailing"),
        text.without_edges(F.col("word")).alias("cased"), F.when(text.is_digits(plain), spoken).otherwise(plain).alias("uncased"),
    )
    following = F.lead(F.struct("excerpt", "mark", "s_begin", "s_end")).over(w).alias("next")
    placed = told.select("*", F.lag("excerpt").over(w).alias("last_excerpt"), following, F.max("problem").over(Window.partitionBy("slug")).alias("any_problem"))
    turn = F.col("last_excerpt").isNotNull() & (F.col("last_excerpt") != F.col("excerpt"))
    turns = F.col("excerpt").isNotNull() & (F.col("excerpt") != F.col("next.excerpt"))
    good = placed.where("any_problem is null").withColumns({"turn": F.coalesce(turn, F.lit(False)), "turns": F.coalesce(turns, F.lit(False))})

    def token(place: int | Column, kind: str, uncased: Column, cased: Column, begin: Column, size: Column, ordinal: Column = F.col("ordinal")) -> Column:
        at = F.lit(place) if isinstance(place, int) else place
        return F.struct(ordinal.cast("int").alias("ordinal"), at.alias("place"), F.lit(kind).alias("kind"), uncased.alias("uncased"), cased.alias("cased"), begin.cast("long").alias("begin"), size.cast("long").alias("len"))

    nothing, none, after = F.lit(None).cast("string"), F.lit(None).cast("long"), F.col("ordinal") + 1
    here, there = (F.col(f"{at}s_end") - F.col(f"{at}s_begin") for at in ("", "next."))
    # at a change of verse the mark and half the silence before the next word close the old span
    past = F.when(F.col("turn"), F.floor(here / 2)).otherwise(0)

    tokens = F.array_compact(F.array(
        F.when(~F.col("turn") & F.col("mark").isNotNull(), token(0, "punct", F.col("mark"), F.col("mark"), none, none)),
        F.when(F.col("s_begin").isNotNull(), token(F.when(F.col("turn"), 2).otherwise(1), "silence", F.lit("<p:>"), nothing, F.col("s_begin") + past, here - past)),
        F.when(F.col("leading").isNotNull(), token(3, "punct", F.col("leading"), F.col("leading"), none, none)),
        token(4, "word", F.col("uncased"), F.col("cased"), F.col("begin"), F.col("end") - F.col("begin")),
        F.when(F.col("trailing").isNotNull(), token(5, "punct", F.col("trailing"), F.col("trailing"), none, none)),
        F.when(F.col("turns") & F.col("next.mark").isNotNull(), token(0, "punct", F.col("next.mark"), F.col("next.mark"), none, none, after)),
        F.when(F.col("turns") & F.col("next.s_begin").isNotNull(), token(1, "silence", F.lit("<p:>"), nothing, F.col("next.s_begin"), F.floor(there / 2), after)),
    ))
    spans = good.select("slug", "excerpt", "verse", tokens.alias("tokens")).groupBy("slug", "excerpt").agg(F.first("verse").alias("verse"), F.array_sort(F.flatten(F.collect_list("tokens"))).alias("tokens"))
    return spans, errors


def span_text(tokens: Column) -> Column:
    """The running text of a span, single-spaced, marks clinging to their words."""
    said = F.filter(tokens, lambda t: t["kind"] != "silence")
    return text.join_tokens(F.transform(said, lambda t: t["cased"]))


def sentences(tokens: Column) -> Column:
    """The tokens of each sentence of a span, null for none; see ``utterances``."""

    def bounds(said: Column) -> Column:
        """(last, start) of every cut: the place of the last word or mark before it and of the word after it."""
        n = F.greatest(F.size(said) - 1, F.lit(0))
        pairs = F.zip_with(F.slice(said, 1, n), F.slice(said, 2, n), lambda prev, own: F.when(prev["stop"] & own["word"], F.struct(prev["at"].alias("last"), own["at"].alias("start"))))
        return F.filter(pairs, lambda b: b.isNotNull())

    def parts(x: Column) -> Column:
        stop = lambda t: F.coalesce((t["kind"] == "punct") & t["cased"].rlike("[.!?…]"), F.lit(False))
        said = F.filter(F.transform(x, lambda t, i: F.struct(i.alias("at"), (t["kind"] == "word").alias("word"), stop(t).alias("stop"), t["kind"].alias("kind"))), lambda t: t["kind"] != "silence")
        begin, end = F.struct(F.lit(-1).alias("last"), F.lit(0).alias("start")), F.struct((F.size(x) - 1).alias("last"), F.size(x).alias("start"))
        return F.flatten(F.transform(F.array(said), lambda s: F.flatten(F.transform(F.array(bounds(s)), lambda b: pieces(x, F.concat(F.array(begin), b), F.concat(b, F.array(end)))))))

    def half(t: Column) -> Column:
        return F.floor(t["len"] / 2).cast("long")

    def pieces(x: Column, begins: Column, ends: Column) -> Column:
        """Of a silence between two sentences the first gets one half and the second the other."""

        def between(b: Column) -> Column:
            return F.slice(x, b["last"] + 2, b["start"] - b["last"] - 1)

        def piece(b: Column, e: Column) -> Column:
            opening = F.transform(between(b), lambda t: t.withField("begin", t["begin"] + half(t)).withField("len", t["len"] - half(t)).withField("place", F.lit(2)))
            closing = F.transform(between(e), lambda t: t.withField("len", half(t)))
            return F.concat(opening, F.slice(x, b["start"] + 1, e["last"] - b["start"] + 1), closing)

        return F.zip_with(begins, ends, piece)

    # arrays of one element bind what is used several times
    return F.flatten(F.transform(F.filter(F.array(tokens), lambda x: F.size(x) > 0), parts))


def utterances(spans: DataFrame) -> DataFrame:
    """Spans cut into sentences, numbered from 1, each with its tokens; a sentence ends with the run of
    marks that holds . ! ? or …. A silence between two sentences is halved between them. A span is cut
    where it lies, in steps that grow with its length."""
    cut = spans.select("slug", "excerpt", "verse", F.posexplode(sentences(F.col("tokens"))).alias("at", "tokens"))
    out = cut.select("slug", "excerpt", (F.col("at") + 1).alias("utterance_num"), "verse", "tokens")
    n_samples = F.aggregate("tokens", F.lit(0).cast("long"), lambda s, t: s + F.coalesce(t["len"], F.lit(0)))
    punctuated = span_text(F.col("tokens"))
    return out.withColumn("n_samples", n_samples).withColumn("punctuated_text", punctuated).withColumn("unpunctuated_text", text.normalize_text(F.col("punctuated_text")))


def bisect(begin: Column, size: Column) -> tuple[Column, Column]:
    """An interval as two (begin, len) structs; the second takes the odd sample."""
    half = F.floor(size / 2).cast("long")
    return F.struct(begin.alias("begin"), half.alias("len")), F.struct((begin + half).alias("begin"), (size - half).alias("len"))
