"""Personal data: patterns propose spans, checksums confirm them, context words move their score.

DataFrame functions only. Java's possessive quantifiers are used where a run can't be given back with success, so
that very long runs neither recurse nor retry; `\\G` keeps a match that starts where the last one ended.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "local_phone")

PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+(?![A-Za-z0-9])",
    "local_phone": r"(?<![0-9+().-])(?<![+0-9()]\x20)\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-]?[0-9]{4}(?![0-9-])",
}
#: A text without this can't hold the kind.
HINTS = {"email": "@", "ip": ".", "card": None, "phone": "+", "iban": None, "local_phone": None}
#: What a confirmed span scores without context; a span of an added kind counts from ACCEPT on.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.8, "local_phone": 0.3}
CONTEXT = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|kontakt|correo|courriel)\b",
    "ip": r"(?i)\b(?:ip|host|server|address|adresse)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|karte|carte|tarjeta)\b",
    "phone": r"(?i)\b(?:phone|tel|call|mobile|fax|telefon|handy|portable|movil)\b",
    "iban": r"(?i)\b(?:iban|account|bank|konto|compte|cuenta)\b",
    "local_phone": r"(?i)\b(?:phone|tel|call|mobile|fax|telefon|handy|portable|movil)\b",
}
BOOST, ACCEPT, NEAR = 0.2, 0.5, 40
#: Matches whose offsets are added up at once.
PART = 128


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    d = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(F.filter(d, lambda x: x.isNotNull()), F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an IBAN without blanks leaves 1 when its digits, country and checksum last, are divided by 97."""
    turned = F.concat(F.substring(account, 5, 64), F.substring(account, 1, 4))
    step = lambda a, c: F.when(c.rlike("^[0-9]$"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step) == 1


def _valid(kind: str, m: Column) -> Column:
    n = F.length(_digits(m))
    if kind == "ip":
        part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
        return m.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return F.when(n.between(13, 19), luhn(_digits(m))).otherwise(F.lit(False))
    if kind == "phone":
        return n.between(9, 15)
    if kind == "iban":
        return mod97(F.regexp_replace(m, " ", ""))
    return F.lit(True)


_FOUND = "array<struct<s: int, e: int, m: string, b: string>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def proposals(text: Column, kind: str) -> Column:
    """Leftmost non-overlapping matches: s, e in code points, end exclusive, m the match, b what stands before it.

    The pieces between the matches and the matches themselves give the offsets. They are added up in parts of PART
    matches, and the parts' lengths after that, so a text's cost isn't the square of its matches.
    """
    pattern = PATTERNS[kind]
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))
    none = F.expr(f"cast(array() as {_FOUND})")

    def step(acc: Column, pair: Column) -> Column:
        s = acc["at"] + F.length(pair["p"])
        b = F.right(F.concat(acc["tail"], pair["p"]), F.lit(NEAR))
        e = s + F.coalesce(F.length(pair["m"]), F.lit(0))
        one = F.array(F.struct(s.alias("s"), e.alias("e"), pair["m"].alias("m"), b.alias("b")))
        tail = F.right(F.concat(b, F.coalesce(pair["m"], F.lit(""))), F.lit(NEAR))
        return F.struct(e.alias("at"), tail.alias("tail"), F.when(pair["m"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], one)).alias("out"))

    def part(pairs: Column, k: Column) -> Column:
        # a match has a character at least, so NEAR pairs hold all that can stand near
        first = F.greatest(k * PART - NEAR, F.lit(0))
        near = F.array_join(F.transform(F.slice(pairs, first + 1, k * PART - first), lambda x: F.concat(x["p"], x["m"])), "")
        start = F.struct(F.lit(0).alias("at"), F.right(near, F.lit(NEAR)).alias("tail"), none.alias("out"))
        return F.aggregate(F.slice(pairs, k * PART + 1, F.lit(PART)), start, step)

    def joined(parts: Column) -> Column:
        ends = F.aggregate(parts, F.expr("array(0)"), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x["at"])))
        moved = lambda x, by: F.transform(x["out"], lambda y: F.struct((y["s"] + by).alias("s"), (y["e"] + by).alias("e"), y["m"].alias("m"), y["b"].alias("b")))
        return F.flatten(F.zip_with(parts, F.slice(ends, F.lit(1), F.size(parts)), moved))

    found = _let(pairs, lambda ps: _let(F.transform(F.sequence(F.lit(0), F.floor((F.size(ps) - 1) / PART).cast("int")), lambda k: part(ps, k)), joined))
    likely = text.contains(HINTS[kind]) if HINTS[kind] else text.rlike(pattern)
    return F.when(likely, found).otherwise(none)


def confirmed(found: Column, kind: str) -> Column:
    """array<struct<kind, start, end, score>> of the proposals that pass their check."""

    def scored(x: Column) -> Column:
        score = F.least(F.lit(1.0), F.lit(SCORES[kind]) + F.when(x["b"].rlike(CONTEXT[kind]), BOOST).otherwise(0.0))
        return F.struct(F.lit(kind).alias("kind"), x["s"].alias("start"), x["e"].alias("end"), score.alias("score"))

    spans = F.transform(F.filter(found, lambda x: _valid(kind, x["m"])), scored)
    return spans if kind in BASE else F.filter(spans, lambda x: x["score"] >= ACCEPT)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of every document: id and `pii`, array<struct<kind, start, end, score>> by kind, then start.

    Base kinds (email, ip, card, phone) stay whatever their context; added kinds (iban, local_phone) need a score of
    ACCEPT, local phone numbers therefore a context word within NEAR characters before them. Kinds don't exclude one
    another. Null and empty texts have no spans; repeated rows and null ids are kept as they are; a column of the
    input other than these two is left out. No shuffle.
    """
    df = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    for kind in KINDS:
        df = df.withColumn(f"_found_{kind}", proposals(F.col("_text"), kind))
    for kind in KINDS:
        df = df.withColumn(f"_{kind}", confirmed(F.col(f"_found_{kind}"), kind))
    return df.select(id_col, F.concat(*(F.col(f"_{k}") for k in KINDS)).alias("pii"))


def pii_digest(spans: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of each base kind, the hash of the base spans, all spans and their scores as text."""
    joined = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter(F.col("pii"), lambda x: x["kind"].isin(*BASE))
    of_kind = lambda k: F.size(F.filter(F.col("pii"), lambda x: x["kind"] == k)).cast("long")
    return spans.select(
        id_col,
        *(of_kind(k).alias(f"n_{k}") for k in BASE),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("pii")).alias("spans"),
        F.array_join(F.transform(F.col("pii"), lambda x: F.format_number(x["score"], 2)), ",").alias("scores"),
    )

