"""Readers, masks and escapes for text cells, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that count as a missing cell.
MISSING = ("", "null", "nan", "n/a", "na", "#n/a", "undefined", "nil")
NUMBER = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"
_GROUPED = r"^[+-]?[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)?$"
#: Currency prefixes and symbols of amounts.
MONEY_PREFIXES = r"^(rs\.?|pkr|usd|eur|gbp|inr|cad|aud)\s*"
MONEY_SYMBOLS = "[$€£¥₹]"
EMAIL = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"
UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
_ARABIC, _PERSIAN = "٠١٢٣٤٥٦٧٨٩", "۰۱۲۳۴۵۶۷۸۹"


def cell(c: Column) -> Column:
    """Trimmed text, or null for a missing token."""
    text = F.trim(c.cast("string"))
    return F.when(~F.lower(text).isin(*MISSING), text)


def number(c: Column) -> Column:
    """The number in a literal with an optional currency mark and thousands groups; null for anything else."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), MONEY_PREFIXES, ""), MONEY_SYMBOLS, ""))
    plain = F.when(bare.rlike(_GROUPED), F.replace(bare, F.lit(","), F.lit(""))).otherwise(bare)
    return F.when(plain.rlike(NUMBER), plain.try_cast("double"))


def has_currency(c: Column) -> Column:
    """Whether a text begins with a currency prefix or holds a currency symbol."""
    return F.lower(c).rlike(MONEY_PREFIXES) | c.rlike(MONEY_SYMBOLS)


def decimals(c: Column) -> Column:
    """Decimal places of a literal, at most 6; 6 with an exponent."""
    return F.when(F.lower(c).rlike("[0-9]e[+-]?[0-9]"), 6).otherwise(F.least(F.length(F.regexp_extract(c, r"\.([0-9]+)", 1)), F.lit(6)))


def mask_text(c: Column) -> Column:
    return F.when(F.length(c) == 0, c).otherwise(F.concat(F.substring(c, 1, 1), F.repeat(F.lit("*"), F.least(F.length(c) - 1, F.lit(12)))))


def mask_email(c: Column) -> Column:
    """First character, four stars, and what begins at the last @; plain masking where there is no @ after the first character."""
    return F.when(c.rlike("^[^@].*@|^@.*@"), F.concat(F.substring(c, 1, 1), F.lit("****"), F.regexp_extract(c, "(@[^@]*)$", 1))).otherwise(mask_text(c))


def mask_last4(c: Column) -> Column:
    """Stars for all digits but the last four, and for letters if there are at least four digits; separators stay."""
    stars = F.regexp_replace(c, r"[0-9](?=(?:[^0-9]*[0-9]){4})", "*")
    count = F.length(F.regexp_replace(c, "[^0-9]", ""))
    return F.when(count == 0, mask_text(c)).when(count >= 4, F.regexp_replace(stars, "[A-Za-z]", "*")).otherwise(c)


def mask_name(c: Column) -> Column:
    """The first letter of each word and stars."""
    return F.regexp_replace(c, r"(?<=\S)\S", "*")


def hash16(c: Column) -> Column:
    return F.substring(F.sha2(c.cast("string").cast("binary"), 256), 1, 16)


def ascii_digits(c: Column) -> Column:
    return F.translate(c, _ARABIC + _PERSIAN, "0123456789" * 2)


def csv_guard(c: Column) -> Column:
    """An apostrophe before texts that a spreadsheet would run as a formula; numbers stay as they are."""
    return F.when(c.rlike(r"^[=+\-@\t\r]") & ~c.rlike(NUMBER), F.concat(F.lit("'"), c)).otherwise(c)


def csv_field(c: Column) -> Column:
    """A guarded CSV field, quoted if it holds a separator, quote, line end, or white space at an end; null gives nothing."""
    safe = csv_guard(c.cast("string"))
    quoted = F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.coalesce(F.when(safe.rlike(r'[",\r\n]|^\s|\s$'), quoted).otherwise(safe), F.lit(""))


def sql_text(c: Column) -> Column:
    return F.coalesce(F.concat(F.lit("'"), F.replace(c.cast("string"), F.lit("'"), F.lit("''")), F.lit("'")), F.lit("NULL"))


def sql_literal(c: Column, kind: str) -> Column:
    if kind in ("integer", "float"):
        return F.coalesce(c.cast("string"), F.lit("NULL"))
    if kind == "boolean":
        return F.when(c.isNull(), "NULL").when(F.lower(c.cast("string")).isin("true", "yes", "y", "t", "1"), "TRUE").otherwise("FALSE")
    return sql_text(F.date_format(c, "yyyy-MM-dd")) if kind == "date" else sql_text(F.date_format(c, "yyyy-MM-dd HH:mm:ss")) if kind == "datetime" else sql_text(c)
