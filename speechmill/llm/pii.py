"""Personal data spans by DataFrame functions only.

Regular expressions propose spans, validators (part ranges, digit counts, Luhn, mod 97, edges) confirm
them, and context words near a span raise its score; a span counts from ``MIN_SCORE`` on.
Email, ip, card and phone are confirmed by their validators alone. Three further kinds are added:
``iban`` (of its country's length, mod 97), ``ssn``, which has no check digits and so needs a context word, and
``secret`` (access keys by their prefix; passwords and tokens by the name before them, with letters and digits).
As of the base kinds, matches are leftmost and without overlap within a kind, failing ones are dropped without a retry.

Positions come without Python: the texts between the matches (``split`` by the same expression) and
the matches themselves have lengths in code points whose running sum gives every start. The
expressions are possessive and start only where a run starts, so they stay linear on long runs.

Defined cases: a null text is an empty one and has no spans, empty texts and empty tables have none either; ties between
kinds are all reported, ordered by kind as listed and then by start; repeated rows give repeated results;
very long texts are searched whole; a column of the input named pii is replaced, other columns and nulls in them pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from speechmill.llm.common import table, without

_LOCAL = "[A-Za-z0-9._%+-]"
_LABEL = "[A-Za-z0-9-]"
# The lengths of international account numbers by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_IBAN = "|".join(rf"(?:{'|'.join(c.split())})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items())
_SSN = "[0-9]{3}-[0-9]{2}-[0-9]{4}"
_SECRET = "(?:AKIA|ASIA)[0-9A-Z]{16}|(?i:password|passwd|secret|token|api[_-]?key)[\"']?\\x20{0,3}[=:]\\x20{0,3}[\"']?[A-Za-z0-9_+/=.-]{12,}"
#: kind, expression, what a text needs for a match, score, context words
KINDS = [
    ("email", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++", "@", 0.9, "mail|contact|write to"),
    ("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)", ".", 0.6, r"\bip\b|address|host|server"),
    ("card", r"[0-9](?:[\x20-]?[0-9])++", None, 0.8, "card|visa|payment|credit"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", 0.7, r"\btel|phone|call|mobile|fax"),
    ("iban", rf"(?=[A-Z]{{2}}[0-9]{{2}})(?:{_IBAN})", None, 0.9, "iban|bank|account"),
    ("ssn", _SSN, "-", 0.3, "(^|[^a-z0-9])ssn([^a-z0-9]|$)|social security|tax id"),
    ("secret", _SECRET, None, 0.6, "key|secret|login|access"),
]
#: What may stand neither before nor after a span of a kind.
EDGES = {"iban": "[A-Za-z0-9]", "ssn": "[0-9-]"}
BASE_KINDS = 4
MIN_SCORE = 0.5
CONTEXT_CHARS = 40
CONTEXT_BONUS = 0.2


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn_ok(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    parts = F.transform(
        F.split(F.reverse(digits), ""),
        lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)),
    )
    return F.aggregate(parts, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def mod97_ok(iban: Column) -> Column:
    """Whether an IBAN (spaces allowed, 15 to 34 characters) leaves 1 modulo 97."""
    s = F.regexp_replace(iban, " ", "")
    moved = F.concat(F.substring(s, 5, 64), F.substring(s, 1, 4))
    rest = F.aggregate(
        F.split(moved, ""),
        F.lit(0),
        lambda a, c: F.when(c == "", a).when(c.between("0", "9"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97),
    )
    return F.length(s).between(15, 34) & (rest == 1)


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        # a part of more than three significant digits is above 255 whatever it is
        return F.forall(F.split(m, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.coalesce(F.regexp_replace(p, "^0+(?=[0-9])", "").substr(1, 3).cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.length(_digits(m)).between(13, 19) & luhn_ok(_digits(m))
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    if kind == "iban":
        return mod97_ok(m)
    if kind == "secret":
        value = F.regexp_extract(m, "[A-Za-z0-9_+/=.-]+$", 0)
        return value.rlike("[0-9]") & value.rlike("[A-Za-z]")
    return F.lit(True)


def _spans(text: Column, kind: str, pattern: str, needs: str | None, score: float, context: str) -> Column:
    none = F.expr("cast(array() as array<struct<kind:string,start:int,end:int,score:double>>)")
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    # running sums over (text before the match, match)
    start = F.expr("cast(array() as array<struct<m:string,start:int>>)")
    placed = F.aggregate(
        F.arrays_zip(between.alias("gap"), found.alias("m")),
        F.struct(F.lit(0).alias("at"), start.alias("out")),
        lambda acc, x: F.when(x["m"].isNull(), acc).otherwise(
            F.struct(
                (acc["at"] + F.length(x["gap"]) + F.length(x["m"])).alias("at"),
                F.array_append(acc["out"], F.struct(x["m"].alias("m"), (acc["at"] + F.length(x["gap"])).alias("start"))).alias("out"),
            )
        ),
        lambda acc: acc["out"],
    )

    def confirmed(x: Column) -> Column:
        if kind not in EDGES:
            return _valid(kind, x["m"])
        before = F.when(x["start"] > 0, text.substr(x["start"], F.lit(1))).otherwise("")
        after = text.substr(x["start"] + F.length(x["m"]) + 1, F.lit(1))
        return ~F.concat(before, after).rlike(EDGES[kind]) & _valid(kind, x["m"])

    kept = F.filter(placed, confirmed)

    def scored(x: Column) -> Column:
        begin = F.greatest(x["start"] - CONTEXT_CHARS, F.lit(0))
        around = F.lower(text.substr(begin + 1, x["start"] + F.length(x["m"]) + CONTEXT_CHARS - begin))
        bonus = F.when(around.rlike(context), CONTEXT_BONUS).otherwise(0.0)
        return F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), (x["start"] + F.length(x["m"])).alias("end"), F.least(F.lit(1.0), F.lit(score) + bonus).alias("score"))

    spans = F.filter(F.transform(kept, scored), lambda x: x["score"] >= MIN_SCORE)
    can = text.rlike(pattern) if needs is None else (F.instr(text, needs) > 0) & text.rlike(pattern)
    return F.when(can, spans).otherwise(none)


def find_personal_data(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``pii``: array<struct<kind, start, end, score>> in code points, the end exclusive."""
    df = without(df, "pii")
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.withColumn("pii", F.concat(*[_spans(text, *k) for k in KINDS]))


def redact(df: DataFrame, text_col: str = "text", spans_col: str = "pii") -> DataFrame:
    """Replaces every span of ``find_personal_data`` by its kind in angle brackets; of spans that
    overlap, the one that starts first (ties: the longest, then by kind) is replaced."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    ordered = F.array_sort(F.transform(spans_col, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("neg"), s["kind"].alias("kind"))))
    out = F.aggregate(
        ordered,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.when(s["start"] < acc["at"], acc).otherwise(
            F.struct((-s["neg"]).alias("at"), F.concat(acc["out"], text.substr(acc["at"] + 1, s["start"] - acc["at"]), F.lit("<"), s["kind"], F.lit(">")).alias("out"))
        ),
        lambda acc: F.concat(acc["out"], text.substr(acc["at"] + 1, F.length(text))),
    )
    return df.withColumn(text_col, F.when(F.size(spans_col) > 0, out).otherwise(F.col(text_col)))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "pii")
    names = [k[0] for k in KINDS]
    base = F.filter("pii", lambda s: s["kind"].isin(names[:BASE_KINDS]))

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    first, more = [count(n) for n in names[:BASE_KINDS]], [count(n) for n in names[BASE_KINDS:]]
    return found.select("doc_id", *first, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("pii")).alias("spans"), *more, F.size("pii").cast("long").alias("n_spans"))


QUERIES = {"op3_pii": op3_pii}
#: The expressions as the other engine takes them: greedy ones match the same where nothing follows them.
_PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]", "iban": _IBAN, "ssn": _SSN, "secret": _SECRET.replace("'", "''"),
}
_MATCHES = " UNION ALL ".join(f"SELECT doc_id, text, {no} AS no, '{kind}' AS kind, regexp_extract_all(text, '{p}') AS m, string_split_regex(text, '{p}') AS g FROM documents" for no, (kind, p) in enumerate(_PLAIN.items(), 1))
_COUNTS = ", ".join(f"count(*) FILTER (kind = '{kind}') AS n_{kind}" for kind in _PLAIN)
_OUT = ", ".join(f"coalesce(n_{kind}, 0) AS n_{kind}" for kind in _PLAIN)
ORACLE = {
    "op3_pii": rf"""
WITH m AS ({_MATCHES}),
x AS (SELECT doc_id, text, no, kind, m, g, unnest(range(1, len(m) + 1)) AS i FROM m),
s AS (
  SELECT doc_id, text, no, kind, m[i] AS t, regexp_replace(m[i], '[^0-9]', '', 'g') AS d, replace(m[i], ' ', '') AS a,
    CAST(list_sum(list_transform(g[1:i], lambda z: length(z))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda z: length(z))), 0) AS BIGINT) AS b FROM x),
e AS (SELECT *, CASE WHEN b > 0 THEN substring(text, b, 1) ELSE '' END || substring(text, b + length(t) + 1, 1) AS edge FROM s),
ok AS (
  SELECT doc_id, no, kind, b, kind || ':' || b || ':' || (b + length(t)) AS span FROM e WHERE CASE kind
    WHEN 'ip' THEN list_bool_and(list_transform(string_split(t, '.'), lambda z: coalesce(TRY_CAST(z AS HUGEINT), 999) <= 255))
    WHEN 'card' THEN length(d) BETWEEN 13 AND 19 AND list_sum(list_transform(string_split(reverse(d), ''), lambda c, j: CASE WHEN j % 2 = 1 THEN CAST(c AS INT) ELSE CAST(c AS INT) * 2 - CASE WHEN CAST(c AS INT) > 4 THEN 9 ELSE 0 END END)) % 10 = 0
    WHEN 'phone' THEN length(d) BETWEEN 9 AND 15
    WHEN 'iban' THEN NOT regexp_matches(edge, '[A-Za-z0-9]') AND list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(substring(a, 5) || substring(a, 1, 4), ''), lambda c: CAST(CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END AS BIGINT))), lambda p, c: (p * CASE WHEN c > 9 THEN 100 ELSE 10 END + c) % 97) = 1
    WHEN 'ssn' THEN NOT regexp_matches(edge, '[0-9-]') AND regexp_matches(lower(substring(text, greatest(b - {CONTEXT_CHARS}, 0) + 1, b + length(t) + {CONTEXT_CHARS} - greatest(b - {CONTEXT_CHARS}, 0))), '{KINDS[5][4]}')
    WHEN 'secret' THEN regexp_matches(regexp_extract(t, '[A-Za-z0-9_+/=.-]+$'), '[0-9]') AND regexp_matches(regexp_extract(t, '[A-Za-z0-9_+/=.-]+$'), '[A-Za-z]')
    ELSE true END),
o AS (SELECT doc_id, string_agg(span, ',' ORDER BY no, b) AS spans, string_agg(span, ',' ORDER BY no, b) FILTER (no <= {BASE_KINDS}) AS base, count(*) AS n, {_COUNTS} FROM ok GROUP BY 1)
SELECT d.doc_id, {_OUT}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n, 0) AS n_spans
FROM documents d LEFT JOIN o USING (doc_id)
"""
}
