"""Scalar functions on text, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text_or_empty(c: Column | str) -> Column:
    return F.coalesce(col(c).cast("string"), F.lit(""))


def collapse(c: Column | str) -> Column:
    """White space runs as one blank, none at the ends; null as empty."""
    return F.trim(F.regexp_replace(text_or_empty(c), r"(?U)\s+", " "))


def fold(c: Column | str) -> Column:
    """Lower case with sharp s as ss, which full case folding does too."""
    return F.replace(F.lower(col(c)), F.lit("ß"), F.lit("ss"))


def text_norm(c: Column | str) -> Column:
    """The form in which two values are compared: collapsed and folded."""
    return fold(collapse(c))


def number_norm(c: Column | str, tolerance: float) -> Column:
    """The number of the bucket of width ``tolerance`` that a number falls into, as text; else ``text_norm``.

    A tolerance of zero or less compares numbers themselves.
    """
    number = F.expr(f"try_cast({_sql(c)} as double)")
    if tolerance <= 0:
        return F.coalesce(number.cast("string"), text_norm(c))
    bucket = F.round((number - F.pmod(number, F.lit(float(tolerance)))) / F.lit(float(tolerance))).cast("long")
    return F.coalesce(bucket.cast("string"), text_norm(c))


def _sql(c: Column | str) -> str:
    if not isinstance(c, str):
        raise TypeError("a column name is needed here")
    return f"`{c}`"


def tokens(c: Column | str) -> Column:
    """The set of folded words of at least four Latin or Cyrillic letters."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text_or_empty(c), F.lit(K.TOKEN), F.lit(0)), fold))


def overlap(a: Column | str, b: Column | str) -> Column:
    """Shared tokens over the size of the smaller set; 0 if either set is empty."""
    a, b = col(a), col(b)
    smaller = F.least(F.size(a), F.size(b))
    return F.coalesce(F.size(F.array_intersect(a, b)) / F.nullif(smaller, F.lit(0)), F.lit(0.0))


def non_letter_ratio(c: Column | str) -> Column:
    """The share of characters that are no letters; null for an empty text."""
    c = col(c)
    return 1 - F.length(F.regexp_replace(c, r"[^\p{L}]", "")) / F.nullif(F.length(c), F.lit(0))


def has_headless(c: Column | str) -> Column:
    return F.contains(F.lower(text_or_empty(c)), F.lit("headless"))


def is_empty(c: Column | str) -> Column:
    """Null, the empty text, or a dash or n/a; white space alone is not empty."""
    c = col(c)
    return c.isNull() | (c == "") | F.lower(F.trim(c)).isin("-", "n/a")


def is_empty_list(c: Column | str) -> Column:
    return F.coalesce(F.size(col(c)) <= 0, F.lit(True))


def is_present(c: Column | str) -> Column:
    """Not null and not the empty text; a dash is present."""
    c = col(c)
    return F.coalesce(c != "", F.lit(False))


def reasons(*pairs: tuple[Column, Column | str]) -> Column:
    """The texts whose condition holds, in order."""
    found = F.array(*(F.when(when, what if isinstance(what, Column) else F.lit(what)) for when, what in pairs))
    return F.filter(found, lambda x: x.isNotNull())


def echo_reasons(c: Column | str, kind: str = "title") -> Column:
    """Why a value looks like an echo of its address instead of content.

    A URL or a percent escape is enough by itself and hides the weaker signs.
    """
    c = text_or_empty(c)
    ratio = F.coalesce(non_letter_ratio(c), F.lit(0.0))
    weak = reasons(
        (~c.rlike(r"(?U)\s") & (F.length(c) > 25), f"{kind} has no whitespace and is longer than 25 chars"),
        (_ends_with(F.lower(c), K.PAGE_EXTENSIONS), f"{kind} ends in a file extension"),
        (ratio > 0.6, F.concat(F.lit(f"{kind} is "), F.round(ratio * 100, 0).cast("int").cast("string"), F.lit("% non-letter characters"))),
    )
    return (
        F.when(c.rlike(K.URL_SCHEME), F.array(F.lit(f"{kind} contains a URL")))
        .when(c.rlike(K.PERCENT_ESCAPE), F.array(F.lit(f"{kind} contains a percent-escape")))
        .otherwise(weak)
    )


def _ends_with(c: Column, ends: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for end in ends:
        found = found | F.endswith(c, F.lit(end))
    return found


def is_echo(c: Column | str, kind: str = "title") -> Column:
    conclusive = text_or_empty(c).rlike(f"{K.URL_SCHEME}|{K.PERCENT_ESCAPE}")
    return conclusive | (F.size(echo_reasons(c, kind)) >= 2)


def first_marker(c: Column | str, words: list[str]) -> Column:
    """The first of ``words`` that the text holds, in the order of the list; else null."""
    c = text_or_empty(c)
    return F.coalesce(*(F.when(F.contains(c, F.lit(w)), F.lit(w)) for w in words))


def holds_any(c: Column | str, words: list[str]) -> Column:
    return first_marker(c, words).isNotNull()


def is_challenge_body(body: Column | str, locales: tuple[str, ...] = ("en",)) -> Column:
    return holds_any(F.lower(F.substring(text_or_empty(body), 1, K.CHALLENGE_PREFIX)), K.markers("challenge_markers", locales))


def is_challenge_title(title: Column | str) -> Column:
    return F.contains(F.lower(text_or_empty(title)), F.lit(K.CHALLENGE_TITLE))


def consent_match(labels: Column | str, wanted: list[str]) -> Column:
    """The first label, in page order, that starts with a wanted one; at most 40 characters."""
    wanted = [w.lower() for w in wanted]

    def hit(label: Column) -> Column:
        low = F.lower(F.trim(label))
        found = F.lit(False)
        for w in wanted:
            found = found | F.startswith(low, F.lit(w))
        return found

    return F.substring(F.trim(F.try_element_at(F.filter(col(labels), hit), F.lit(1))), 1, 40)
