"""Scalar functions on texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bullets, and the shape of a number in running text.
BULLET = r"^\s*(?:[-*•]|\d+[.)])\s"
NUMBER = r"(?<![A-Za-z0-9_.])[-+]?\d+(?:[.,]\d+)*(?:[eE][-+]?\d+)?%?"


def word_count(text: Column) -> Column:
    """Parts between single spaces."""
    return (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) + 1).cast("bigint")


def block_type(text: Column) -> Column:
    """li with a bullet, sec up to three words, else p."""
    return F.when(text.rlike(BULLET), "li").when(word_count(text) <= 3, "sec").otherwise("p")


def numbers(text: Column) -> Column:
    """Number tokens with U+2212 read as a minus."""
    return F.regexp_extract_all(F.translate(text, "−", "-"), F.lit(NUMBER), F.lit(0))


def stable_id(*parts: Column, size: int = 20) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256), 1, size)


def token_estimate(text: Column) -> Column:
    """One token for 3.6 narrow or 1.3 wide characters (above U+02FF), rounded."""
    wide = F.length(F.regexp_replace(text, "[\\u0000-\\u02FF]", ""))
    return F.round((F.length(text) - wide) / 3.6 + wide / 1.3, 4)


def normal(text: Column) -> Column:
    """White space as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(text, r"[ \t\n\r]+", " "))


def compact(text: Column, limit: int) -> Column:
    """At most `limit` characters, cut at the last space and marked."""
    cut = F.substring(text, 1, limit)
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.regexp_replace(cut, r" [^ ]*$", ""), F.lit(" …")))


def markdown_escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\`*_\[\]#|<>])", r"\\$1")


def redact(text: Column, secrets: list[str]) -> Column:
    for s in secrets:
        text = F.replace(text, F.lit(s), F.lit("[REDACTED]"))
    return text


def utf16_slice(text: Column, start: int, end: int) -> Column:
    """Characters by UTF-16 units, as browsers count them."""
    return F.decode(F.substring(F.encode(text, "UTF-16LE"), 2 * start + 1, 2 * (end - start)), "UTF-16LE")
