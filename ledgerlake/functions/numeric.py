"""Numbers as companies print them, and guarded arithmetic. Column in, Column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AMOUNT = "decimal(18,4)"
#: Note markers, loss marks and words that stand beside printed amounts.
LOSS_MARKS = "△▲"
WORDS = r"(?i)(HK\$|US\$|RMB|CNY|USD|HKD|EUR|JPY|KRW|¥|€|₩|\$|百万円|千円|円|억원|백만원|원|亿元|万元|千元|元|million|billion|thousand|mn|bn)"


def amount(c: Column, scale: int = 4) -> Column:
    return c.cast(f"decimal(18,{scale})")


def parse_accounting(text: Column) -> Column:
    """'(1,234)' is -1234; ASCII and full-width commas and spaces go; anything else that is no number is null."""
    bare = F.regexp_replace(text, r"[,，\s　]", "")
    signed = F.regexp_replace(F.regexp_replace(bare, r"^[(（](.*)[)）]$", "-$1"), "^--", "")
    return F.when(signed.rlike(r"^-?\d+(\.\d+)?$"), signed.try_cast("decimal(38,6)"))


def parse_printed(text: Column) -> Column:
    """Printed amounts with currency and scale words, note markers ('*5 273,951') and loss marks."""
    plain = F.translate(text, "０１２３４５６７８９．，－（）", "0123456789.,-()")
    negative = plain.rlike(rf"[{LOSS_MARKS}]") | plain.rlike(r"^\s*\(.*\)\s*[^\d]*$") | plain.rlike(r"^\s*-\s*\d")
    body = F.regexp_replace(F.regexp_replace(plain, WORDS, ""), r"^\s*[*※]\s*\d+(?:[,、]\s*\d+)*\s+", "")
    digits = F.regexp_replace(body, rf"[{LOSS_MARKS}(),\s\-]", "")
    value = F.when(digits.rlike(r"^\d+(\.\d+)?$"), digits.try_cast("decimal(38,6)"))
    return F.when(negative, -value).otherwise(value)


def first_number(text: Column) -> Column:
    """The first number found anywhere; in brackets it is negative."""
    found = F.regexp_extract(text, r"\(?-?\d[\d,]*(?:\.\d+)?\)?", 0)
    value = F.regexp_replace(found, r"[(),]", "").try_cast("decimal(38,6)")
    return F.when(found.startswith("(") & found.endswith(")"), -value).otherwise(value)


_DECIMAL = r"^[-+]?(\d+(\.\d*)?|\.\d+)$"
#: Texts that stand for no value, by the importer and by the verifier.
IMPORTER_EMPTY = ("", "-", "—", "–", "N/A", "n/a")
VERIFIER_EMPTY = ("", "-", "--", "---", "n/a", "na", "null", "none")


def _strict(text: Column) -> Column:
    return F.when(text.rlike(_DECIMAL), F.regexp_replace(text, r"\.$", "").try_cast("decimal(38,6)"))


def calculator_number(text: Column) -> Column:
    """For calculations: the number in brackets anywhere, made negative, else the first number; signs in print count."""
    plain = F.translate(F.trim(text), "−–", "--")
    inside = F.regexp_extract(plain, r"[（(]\s*([-+]?\d[\d,，]*(?:\.\d+)?)\s*[）)]", 1)
    source = F.regexp_replace(F.when(inside != "", inside).otherwise(plain), "[,， ]", "")
    value = F.regexp_extract(source, r"[-+]?\d+(?:\.\d+)?", 0).try_cast("decimal(38,6)")
    return F.when(inside != "", -F.abs(value)).otherwise(value)


def importer_number(text: Column) -> Column:
    """For imports: the whole text is one number, in brackets if negative, with commas, percent signs and spaces; else null."""
    plain = F.trim(text)
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, r"^[()]+|[()]+$", ""), "[,，%]", ""), r"\s+", "")
    value = _strict(bare)
    return F.when(plain.isin(*IMPORTER_EMPTY), None).when(plain.startswith("(") & plain.endswith(")"), -value).otherwise(value)


def verifier_number(text: Column) -> Column:
    """For evidence: currency and scale words and signs beside the number go; other letters make it none. Only a positive
    number in brackets is negative."""
    plain = F.trim(text)
    negative = plain.rlike(r"^\(.+\)$")
    inner = F.translate(F.when(negative, F.regexp_replace(plain, r"^\((.*)\)$", "$1")).otherwise(plain), "−–—", "---")
    bare = F.regexp_replace(F.regexp_replace(inner, r"(?i)(hk\$|us\$|rmb|cny|hkd|usd|eur|gbp|jpy|krw|\$)", ""), r"(?i)(million|billion|thousand|mn|bn|m|k)", "")
    value = _strict(F.regexp_replace(bare, r"[^0-9.\-+]", ""))
    return F.when(F.lower(plain).isin(*VERIFIER_EMPTY) | bare.rlike("[A-Za-z]"), None).when(negative & (value > 0), -value).otherwise(value)


def lookup_number(text: Column) -> Column:
    """For look-ups: a float, with ASCII commas, in brackets if negative."""
    plain = F.trim(F.regexp_replace(text, ",", ""))
    bare = F.regexp_replace(plain, r"^[()]+|[()]+$", "")
    value = F.when(bare.rlike(r"^[-+]?(\d+(\.\d*)?|\.\d+)([eE][-+]?\d+)?$"), bare.try_cast("double"))
    return F.when(plain.startswith("(") & plain.endswith(")"), -value).otherwise(value)


def tolerance(a: Column, b: Column, share: float = 0.005, least: float = 2.0) -> Column:
    """A difference within this counts as equal: a share of the larger amount, `least` at least."""
    return F.greatest(F.greatest(F.abs(a), F.abs(b)) * F.lit(share), F.lit(least))


def ratio(a: Column, b: Column, places: int = 4) -> Column:
    return F.round(F.try_divide(a.cast("decimal(38,12)"), b.cast("decimal(38,12)")), places)


def yoy(now: Column, before: Column, negative_base: bool = False) -> Column:
    """Change over the year before: null on a zero base; a negative base only where it is allowed, by its size."""
    change = F.try_divide((now - before).cast("double"), F.abs(before).cast("double"))
    return F.when((before < 0) & F.lit(not negative_base), None).otherwise(change)


def cagr(first: Column, last: Column, years: Column) -> Column:
    """Compound growth; only for positive ends and a positive number of years."""
    return F.when((first > 0) & (last > 0) & (years > 0), F.pow(last.cast("double") / first.cast("double"), 1 / years.cast("double")) - 1)


def close(a: Column, b: Column, relative: float = 1e-6) -> Column:
    return F.abs(a - b) <= F.greatest(F.abs(a), F.abs(b)) * F.lit(relative)
