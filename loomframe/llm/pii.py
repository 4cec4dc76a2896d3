"""Personal data: regular expressions propose spans, checksums confirm them, nearby words adjust the score.

DataFrame functions only. A pattern's matches are put between two marker characters by one regexp_replace and read off by
splitting at the markers, which gives their places as well as their text. Positions are code points, ends are exclusive.

Base kinds (leftmost matches that do not overlap; a match that fails its test is dropped): email; ip, no part over 255; card, 16 to
19 digits that pass the Luhn test; phone, with a plus and 8 to 15 digits. They stay whatever their score. Other proposals are
added if their score reaches `THRESHOLD`: iban (mod-97), card_short (13 to 15 digits, Luhn), phone_local (a leading 0 and 8 to 15 digits
without a plus), secret (a run of 20 or more letters, digits and -_+/ with both letters and digits; random if it is 32, 40 or 64
hexadecimal digits or has at least 5 digits). A score is the kind's own (`SCORES`), plus what its passed test gives, plus what a word of the
kind in the `CONTEXT` characters before the span gives.

The patterns are written without repeated groups that could grow with the text, as the regex engine would recurse for each
turn. The email pattern ends its domain at the first place where neither a domain character nor a dot and one follow; a card is
a whole run of digits with single separators, so a run that is too long cannot start in its middle.

Nulls count as empty texts; texts of any length are searched whole. Spans of different kinds may overlap; all are reported, and the
first one's name replaces the text. Repeated rows give repeated rows; empty tables none. Columns whose names begin with _p_ are ours.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.7
CONTEXT = 40
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "card_short", "phone_local", "secret")
#: kind: (score of its own, what a passed test adds, what a word nearby adds)
SCORES = {
    "email": (0.7, 0.0, 0.2), "ip": (0.5, 0.0, 0.3), "card": (0.4, 0.3, 0.3), "phone": (0.5, 0.0, 0.3),
    "iban": (0.4, 0.5, 0.1), "card_short": (0.2, 0.2, 0.4), "phone_local": (0.3, 0.0, 0.4), "secret": (0.3, 0.2, 0.4),
}

_LOCAL, _NAME = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
PATTERNS = {
    # The local part begins where its run of characters does, or at the end of the match before.
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_NAME}++\.(?={_NAME})[A-Za-z0-9.-]+?(?!{_NAME})(?!\.{_NAME})",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+(?![A-Za-z0-9])",
    "card_short": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,14}+(?![\x20-]?[0-9])",
    "phone_local": r"(?<![0-9+])(?<![0-9][\x20./-])0[0-9](?:[\x20./-]?[0-9]){6,13}+(?![\x20./-]?[0-9])",
    "secret": r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{20,}+",
}
#: Cheap tests that a text must pass before the pattern is tried; every match implies its test.
_NEEDS = {"email": "@", "phone": "+", "ip": "[0-9]\\.[0-9]++\\.", "card": "[0-9](?:[\\x20-]?[0-9]){15}", "iban": "[A-Z]{2}[0-9]{2}", "card_short": "[0-9](?:[\\x20-]?[0-9]){12}", "phone_local": "(?<![0-9])0[0-9]", "secret": "[A-Za-z0-9_+/-]{20}"}
_WORDS = {
    "email": "mail|contact|kontakt|correo|courriel",
    "ip": "\\bip\\b|host|server|addr|client|login",
    "card": "card|visa|amex|credit|debit|karte|carte|tarjeta",
    "phone": "phone|tel|call|mobile|fax|telefon|téléphone|teléfono",
    "iban": "iban|konto|account|compte|cuenta|bank",
    "secret": "token|secret|passw|key|credential|bearer",
    "card_short": "card|visa|amex|credit|debit|karte|carte|tarjeta",
    "phone_local": "phone|tel|call|mobile|fax|telefon|téléphone|teléfono",
}
_OPEN, _CLOSE = "\u0001", "\u0002"


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    numbers = F.transform(F.split(F.reverse(digits), ""), lambda d: d.cast("int"))
    weighed = F.transform(numbers, lambda d, i: F.when(i % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0)))
    return F.aggregate(weighed, F.lit(0), lambda a, d: a + d) % 10 == 0


def mod97(text: Column) -> Column:
    """Whether an IBAN without spaces passes the mod-97 test: its first four characters go last, letters count from 10."""
    turned = F.concat(F.substring(text, 5, 1000), F.substring(text, 1, 4))
    value = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: (a * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c)) % 97)
    return rest == 1


_SPAN = "array<struct<s:int,e:int,v:string>>"


def matches(text: Column, pattern: str) -> Column:
    """All matches as structs of start, end and text. `text` must not hold the two marker characters."""
    parts = F.split(F.regexp_replace(text, f"({pattern})", f"{_OPEN}$1{_CLOSE}"), _OPEN)

    def read(parts):
        begin = F.struct(F.length(F.get(parts, F.lit(0))).alias("at"), F.array().cast(_SPAN).alias("found"))

        def add(acc, part):
            value = F.substring_index(part, _CLOSE, 1)
            end = acc["at"] + F.length(value)
            span = F.struct(acc["at"].alias("s"), end.alias("e"), value.alias("v"))
            return F.struct((acc["at"] + F.length(part) - 1).alias("at"), F.array_append(acc["found"], span).cast(_SPAN).alias("found"))

        return F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), begin, add, lambda a: a["found"])

    return F.get(F.transform(F.array(parts), lambda p: F.when(F.size(p) > 1, read(p)).otherwise(F.array().cast(_SPAN))), F.lit(0))


def _good(kind: str, v: Column) -> Column:
    if kind == "ip":
        return ~F.exists(F.split(v, "\\."), lambda x: ~x.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "phone" or kind == "phone_local":
        return F.length(_digits(v)).between(8, 15)
    if kind == "card":
        return luhn(_digits(v))
    if kind == "secret":
        return v.rlike("[0-9]") & v.rlike("[A-Za-z]")
    return F.lit(True)


def _tested(kind: str, v: Column) -> Column:
    """Whether a span passes its kind's test; base spans that do not are dropped before."""
    if kind == "iban":
        return mod97(F.replace(v, F.lit(" "), F.lit("")))
    if kind == "card_short":
        return luhn(_digits(v))
    if kind == "secret":
        return v.rlike("^(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{64})\\z") | (F.length(_digits(v)) >= 5)
    return F.lit(True)


def _score(kind: str, text: Column, span: Column) -> Column:
    before = F.lower(F.substring(text, F.greatest(span["s"] - CONTEXT, F.lit(0)) + 1, F.least(span["s"], F.lit(CONTEXT))))
    own, tested, near = SCORES[kind]
    return F.lit(own) + F.when(_tested(kind, span["v"]), tested).otherwise(0.0) + F.when(before.rlike(_WORDS[kind]), near).otherwise(0.0)


def _accepted(kind: str, span: Column) -> Column:
    good = _good(kind, span["v"])
    return good if kind in BASE_KINDS else good & (_score(kind, F.col("_p_text"), span) >= THRESHOLD - 1e-9)


def _named(kind: str, span: Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), span["s"].cast("string"), F.lit(":"), span["e"].cast("string"))


def _scored(kind: str, span: Column) -> Column:
    return F.format_string("%.1f", _score(kind, F.col("_p_text"), span))


def _tagged(kind: str, span: Column) -> Column:
    return F.struct(span["s"].alias("s"), span["e"].alias("e"), F.lit(f"<{kind.upper()}>").alias("tag"))


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows with _p_text (markers replaced by another control character) and, for each kind, its spans in _p_<kind>."""
    value = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    clean = F.when(value.rlike(f"[{_OPEN}{_CLOSE}]"), F.translate(value, _OPEN + _CLOSE, "\u0003\u0003")).otherwise(value)
    read = docs.withColumn("_p_text", clean).withColumn("_p_some", F.col("_p_text").rlike("[0-9@]"))
    t, none = F.col("_p_text"), F.array().cast(_SPAN)
    columns = []
    for kind in KINDS:
        needs = t.contains(_NEEDS[kind]) if kind in ("email", "phone") else t.rlike(_NEEDS[kind])
        found = F.filter(matches(t, PATTERNS[kind]), partial(_accepted, kind))
        columns.append(F.when(F.col("_p_some") & needs, found).otherwise(none).alias(f"_p_{kind}"))
    return read.select("*", *columns)


def _joined(kinds) -> Column:
    return F.array_join(F.concat(*[F.transform(f"_p_{k}", partial(_named, k)) for k in kinds]), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, how many spans of each base kind, their digest, all spans, and their scores in the same order."""
    found = find(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    return found.select("doc_id", *[F.size(f"_p_{k}").cast("long").alias(f"n_{k}") for k in BASE_KINDS], F.sha2(_joined(BASE_KINDS).cast("binary"), 256).alias("base_sha256"), _joined(KINDS).alias("spans"), F.array_join(F.concat(*[F.transform(f"_p_{k}", partial(_scored, k)) for k in KINDS]), ",").alias("scores"))


def redact(docs: DataFrame) -> DataFrame:
    """All rows and columns; in texts every span is replaced by its kind in angle brackets (overlapping spans by the first one's). Texts without spans, and nulls, stay as they are."""
    names = docs.columns
    carried = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_p_row"), F.col("text").cast("string").alias("_p_source"))
    found = find(carried, "_p_source")
    spans = F.array_sort(F.concat(*[F.transform(f"_p_{k}", partial(_tagged, k)) for k in KINDS]))
    kind = "array<struct<s:int,e:int,tag:string>>"

    def merge(acc, x):
        last = F.element_at(acc, -1)
        grown = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last["s"].alias("s"), F.greatest(last["e"], x["e"]).alias("e"), last["tag"].alias("tag"))))
        return F.when((F.size(acc) > 0) & (F.coalesce(F.get(acc, F.size(acc) - 1)["e"], F.lit(0)) > x["s"]), grown).otherwise(F.array_append(acc, x)).cast(kind)

    merged = found.select("_p_row", "_p_source", spans.cast(kind).alias("_p_all")).withColumn("_p_all", F.when(F.size("_p_all") > 1, F.aggregate("_p_all", F.array().cast(kind), merge)).otherwise(F.col("_p_all")))

    def piece(x, i):
        begin = F.when(i == 0, F.lit(0)).otherwise(F.get("_p_all", i - 1)["e"])
        return F.concat(F.substring(F.col("_p_source"), begin + 1, x["s"] - begin), x["tag"])

    end = F.get("_p_all", F.size("_p_all") - 1)["e"]
    text = F.when(F.size("_p_all") == 0, F.col("_p_source")).otherwise(F.concat(F.array_join(F.transform("_p_all", piece), ""), F.substring(F.col("_p_source"), end + 1, F.length("_p_source"))))
    ready = merged.select("_p_row", F.when(F.size("_p_all") == 0, F.col("_p_source")).otherwise(text).alias("_p_new"))
    now = {"text": F.col("_p_new"), "n_chars": F.when(F.col("_p_new").isNull(), F.col("_p_row.n_chars")).otherwise(F.length("_p_new").cast("long")) if "n_chars" in names else None}
    return ready.select(*[now[c].alias(c) if now.get(c) is not None else F.col(f"_p_row.`{c}`").alias(c) for c in names])
