"""Text scalars as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Java's \w and \s are ASCII or differ from the Unicode notion meant here, hence spelt out.
# The common letters come first: most characters are told by them.
_WORDISH = r"a-zA-Z0-9 \p{L}\p{N}_\p{IsWhite_Space}\x1c-\x1f'"
_JUNK = rf"[^{_WORDISH}](?:(?<![a-zA-Z].)|(?![a-zA-Z]))"
_SPACES = r"[\p{IsWhite_Space}\x1c-\x1f]+"
_NOT_ALNUM = r"[^\p{IsAlphabetic}\p{N}]"


def normalize_text(s: Column) -> Column:
    """Lower-cased words: punctuation goes unless it stands between ASCII letters, apostrophes stay,
    runs of white space become one space."""
    padded = F.concat(F.lit(" "), s, F.lit(" "))
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(padded, _JUNK, ""), _SPACES, " ")))


def is_punctuation(s: Column) -> Column:
    """Up to four characters, none of them a letter, digit or mark (so '' counts)."""
    return (F.length(s) <= 4) & ~s.rlike(r"[\p{L}\p{N}\p{M}]")


def leading_punctuation(s: Column) -> Column:
    """The run of non-alphanumerics at the start, null if there is none."""
    return F.nullif(F.regexp_extract(s, f"^{_NOT_ALNUM}+", 0), F.lit(""))


def trailing_punctuation(s: Column) -> Column:
    """The run of non-alphanumerics at the end of what follows the leading run, null if there is none."""
    rest = F.regexp_replace(s, f"^{_NOT_ALNUM}+", "")
    return F.nullif(F.regexp_extract(rest, rf"{_NOT_ALNUM}+\z", 0), F.lit(""))


def without_edges(s: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(s, f"^{_NOT_ALNUM}+", ""), rf"{_NOT_ALNUM}+\z", "")


def strip_nonletters(s: Column) -> Column:
    return F.regexp_replace(s, r"[^\p{L}\p{M}0-9]", "")


def starts_with_punctuation(s: Column) -> Column:
    """Whether the first character is neither a word character nor white space."""
    return s.rlike(r"^[^\p{L}\p{N}_\p{IsWhite_Space}]")


def is_digits(s: Column) -> Column:
    return s.rlike(r"^\p{Nd}+$")


def words(s: Column) -> Column:
    """White-space separated words, none of them empty."""
    return F.filter(F.split(s, _SPACES), lambda w: w != "")


def merge_marks(pieces: Column) -> Column:
    """Sentences of which those of punctuation alone join the one before (the first one the next)."""

    def step(acc: Column, p: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        joins = (F.size(acc) > 0) & (is_punctuation(p) | is_punctuation(last))
        return F.when(joins, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat_ws(" ", last, p)))).otherwise(F.array_append(acc, p))

    def merged(x: Column) -> Column:
        return F.when(F.exists(x, is_punctuation), F.aggregate(x, F.expr("cast(array() as array<string>)"), step)).otherwise(x)

    return F.element_at(F.transform(F.array(pieces), merged), 1)


def sentences(s: Column) -> Column:
    """Sentences by rule: a cut after . ! ? or … that white space follows; what is punctuation alone is no
    sentence of its own."""
    return merge_marks(F.split(s, r"(?<=[.!?…])\s+"))


def levenshtein_similarity(a: Column, b: Column) -> Column:
    """1 - distance / longer length, null for two empty strings."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.try_divide(longest - F.levenshtein(a, b), longest)


def token_matches(word: Column, normalized: Column, token: Column, number_words: Column, foreign_number_words: Column) -> Column:
    """Whether an aligned token is the word: by spelling, or for digits by their spoken form."""
    spoken = (levenshtein_similarity(number_words, token) > 0.55) | (levenshtein_similarity(foreign_number_words, token) > 0.55)
    written = (token == strip_nonletters(normalized)) | (token == normalized) | (levenshtein_similarity(word, token) > 0.4)
    return F.coalesce(F.when(is_digits(normalized), spoken).otherwise(written), F.lit(False))


def intro_lines(short_name: Column, long_name: Column, chapter: Column, normalized: bool = True) -> Column:
    """What is read at the start of a chapter: the long name in chapter 1, then short name and number."""
    announce = F.concat_ws(" ", short_name, chapter.cast("string"))
    lines = F.when(chapter == 1, F.array(long_name, announce)).otherwise(F.array(announce))
    return F.transform(lines, normalize_text) if normalized else lines


def parse_vector(s: Column) -> Column:
    """'[a b c]' as an array of doubles; null stays null."""
    inner = s.substr(F.lit(2), F.length(s) - 2)
    return F.transform(F.filter(F.split(F.trim(inner), r"\s+"), lambda x: x != ""), lambda x: x.cast("double"))


def format_vector(v: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(v, lambda x: x.cast("string")), " "), F.lit("]"))


# Which marks cling to the text before them, which to the text after, which alternate.
CLING_LEFT = ".,;:!?)]}’”"
CLING_RIGHT = "([{‘“"
ALTERNATE = "'\""
_BEFORE_LEFT = " (?=[" + CLING_LEFT.replace("]", "\\]") + "])"
_AFTER_RIGHT = "(?<=[" + CLING_RIGHT.replace("[", "\\[") + "]) "


def collapse_whitespace(s: Column) -> Column:
    """Drops one space before a mark that clings left and one after a mark that clings right; plain
    quotes open and close in turn. A space alone between two quotes belongs to the opening one, and the
    closing one then takes that quote for it.

    The text is cut at the plain quotes: what follows an opening one loses a space at its start, what
    comes before a closing one what stands for a space at its end."""
    raw = F.split(s, f"[{ALTERNATE}]", -1)
    marks = F.regexp_extract_all(s, F.lit(f"[{ALTERNATE}]"), F.lit(0))

    def part(x: Column, i: Column) -> Column:
        clung = F.regexp_replace(F.regexp_replace(x["raw"], _BEFORE_LEFT, ""), _AFTER_RIGHT, "")
        opened = F.when((i % 2 == 1) & clung.startswith(" "), clung.substr(F.lit(2), F.length(clung))).otherwise(clung)
        closes = (i % 2 == 1) & x["mark"].isNotNull() & x["raw"].endswith(" ")
        body = F.when(closes, opened.substr(F.lit(1), F.greatest(F.length(opened) - 1, F.lit(0)))).otherwise(opened)
        return F.struct(body.alias("body"), x["mark"].alias("mark"), (closes & (opened == "")).alias("takes"))

    def glued(parts: Column) -> Column:
        def piece(x: Column, i: Column) -> Column:
            taken = F.coalesce(F.get(parts, i + 1)["takes"], F.lit(False))
            return F.concat(x["body"], F.when(taken, F.lit("")).otherwise(F.coalesce(x["mark"], F.lit(""))))

        return F.array_join(F.transform(parts, piece), "")

    parts = F.transform(F.arrays_zip(raw.alias("raw"), marks.alias("mark")), part)
    return F.element_at(F.transform(F.array(parts), glued), 1)


def join_tokens(tokens: Column, compat: bool = False) -> Column:
    """Tokens as running text. compat: two spaces between words, as the older tables have it."""
    return collapse_whitespace(F.trim(F.array_join(tokens, "  " if compat else " ")))
