"""Labels, tokens, addresses. Column in, Column out."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))


def normal_label(c: Column) -> Column:
    """Lower case; runs of anything but letters and digits become one space."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def compact(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def tokens(c: Column, pattern: str = "[a-z0-9]+") -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(pattern), 0)


def cjk_bigrams(c: Column) -> Column:
    """ASCII words and overlapping pairs of CJK characters; a single one stands for itself."""
    runs = F.regexp_extract_all(c, F.lit("[\\u4e00-\\u9fff]+"), 0)
    pairs = F.flatten(F.transform(runs, lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: F.substring(r, i, F.lit(2))))))
    return F.concat(tokens(c), pairs)


def ngrams(words: Column, n: int) -> Column:
    """Space-joined runs of n words."""
    count = F.size(words) - (n - 1)
    return F.when(count > 0, F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))


def nfkc_casefold(c: Column) -> Column:
    """Unicode compatibility form and case folding have no built-in expression."""

    @F.pandas_udf("string")
    def fold(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).casefold())

    return fold(c)


def question_key(c: Column, unicode_form: bool = True) -> Column:
    """One spelling for a question: compatibility form, folded case, single spaces, no punctuation at the edges."""
    folded = nfkc_casefold(c) if unicode_form else F.lower(c)
    squeezed = F.trim(F.regexp_replace(folded, r"\s+", " "))
    return F.regexp_replace(squeezed, r"^[\s.,;:!?。，；：！？、'\"()]+|[\s.,;:!?。，；：！？、'\"()]+$", "")


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://([^/?#:]+)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]+([^?#]*)", 1)


def redacted(c: Column) -> Column:
    """Credentials in addresses and the values of sensitive keys."""
    urls = F.regexp_replace(c, r"://[^/@\s:]+:[^/@\s]+@", "://***@")
    return F.regexp_replace(urls, r"(?i)(token|secret|password|api_key)=[^&\s]+", "$1=***")


def stable_id(*parts: Column, sep: str = "|", size: int = 16) -> Column:
    return F.substring(F.sha2(F.concat_ws(sep, *parts), 256), 1, size)


def html_text(c: Column) -> Column:
    """Text of a page: no scripts, styles or comments; blocks end lines; tags go; common entities; squeezed."""
    bare = F.regexp_replace(c, r"(?is)<(script|style)\b.*?</(script|style)>|<!--.*?-->", " ")
    lines = F.regexp_replace(bare, r"(?i)<br\s*/?>|</(p|div|tr|li|h[1-6]|table)>", "\n")
    plain = F.regexp_replace(lines, r"<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(entity), F.lit(char))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, r"[ \t]+", " "), r"\s*\n\s*", "\n"), r"^\s+|\s+$", "")


#: A literal of SQL, a comment to the end of the line, or one in marks.
_LITERAL, _COMMENT = "'(?:[^']|'')*'", r"--[^\n]*|/\*[^*]*\*+(?:[^/*][^*]*\*+)*/"


def without_comments(sql: Column) -> Column:
    """SQL text whose comments have become a space; what looks like one within a literal stays."""
    marked = F.regexp_replace(sql, f"({_LITERAL})|({_COMMENT})", "$1\x01")  # after a literal, or for a comment
    return F.replace(F.replace(marked, F.lit("'\x01"), F.lit("'")), F.lit("\x01"), F.lit(" "))


def without_literals(sql: Column) -> Column:
    """SQL text without comments, whose literals are empty ones."""
    return F.regexp_replace(without_comments(sql), _LITERAL, "''")


def statements(sql: Column) -> Column:
    """The statements of a text, in order: parts at semicolons outside literals and comments, blank ones left out."""
    parts = F.regexp_extract_all(without_comments(sql), F.lit(f"(?:[^;']|{_LITERAL})+"), 0)
    return F.filter(F.transform(parts, lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")
