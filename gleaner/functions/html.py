"""Scalar functions on HTML text, as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K
from .text import col, text_or_empty

LD_JSON = r"(?is)<script[^>]+type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"
#: The named character references, and white space as it is trimmed from lines (a character class).
NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " "}
SPACE = r"[\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
REFERENCE = "(?i)&(?:#x?[0-9a-f]+|[a-z]+);"


def visible_text(html: Column | str) -> Column:
    """What stays without scripts, styles and tags, with white space collapsed."""
    bare = F.regexp_replace(text_or_empty(html), r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, "<[^>]+>", " "), r"(?U)\s+", " "))


def title(html: Column | str) -> Column:
    """The first title, trimmed; null without one."""
    html = text_or_empty(html)
    return F.when(html.rlike(K.TITLE), F.regexp_replace(F.regexp_extract(html, K.TITLE, 1), r"(?U)^\s+|\s+$", ""))


def _character(reference: Column) -> Column:
    """The character of one reference, or the reference itself if there is none."""
    name = F.lower(F.regexp_extract(reference, "&(.*);", 1))
    digits = F.regexp_extract(name, "^#([0-9]+)", 1)
    code = F.when(F.startswith(name, F.lit("#x")), F.conv(F.substr(name, F.lit(3)), 16, 10)).otherwise(digits)
    number = F.when(F.length(F.regexp_replace(name, "^#x?0*", "")) <= 7, code.try_cast("long"))
    number = F.when(number.between(0xD800, 0xDFFF), F.lit(0xFFFD)).otherwise(number)  # half a pair stands for nothing
    numeric = F.when(number <= 0x10FFFF, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32"))
    named = F.coalesce(*(F.when(name == n, F.lit(c)) for n, c in NAMED.items()))
    return F.coalesce(F.when(F.startswith(name, F.lit("#")), numeric).otherwise(named), reference)


def decode_entities(c: Column | str) -> Column:
    """Named and numeric character references as characters, in one pass; unknown ones stay."""
    c = col(c)
    between = F.split(c, REFERENCE, -1)
    found = F.transform(F.regexp_extract_all(c, F.lit(REFERENCE), F.lit(0)), _character)
    pieces = F.zip_with(F.concat(F.array(F.lit("")), found), between, lambda x, y: F.concat(x, y))
    return F.when(F.contains(c, F.lit("&")), F.array_join(pieces, "")).otherwise(c)


def title_decoded(html: Column | str) -> Column:
    return decode_entities(title(html))


def ld_json(html: Column | str) -> Column:
    """The embedded JSON-LD blocks that parse, as an array of text."""
    found = F.transform(F.regexp_extract_all(text_or_empty(html), F.lit(LD_JSON), F.lit(1)), lambda x: F.trim(x))
    return F.filter(found, lambda x: F.try_parse_json(x).isNotNull())


def text_lines(html: Column | str) -> Column:
    """Lines of visible text: breaks and block ends are line ends, references decoded, blank lines left out."""
    bare = F.regexp_replace(F.regexp_replace(text_or_empty(html), "(?is)<script.*?</script>", " "), "(?is)<style.*?</style>", " ")
    bare = F.regexp_replace(bare, r"(?i)<br\s*/?>|</(p|div|li|tr|h[1-6])>", "\n")
    lines = F.split(F.regexp_replace(bare, "<[^>]+>", " "), "\n")
    trimmed = rf"^{SPACE}+|{SPACE}+$"
    clean = F.transform(lines, lambda x: F.regexp_replace(F.regexp_replace(decode_entities(x), "[ \\t\u00A0]+", " "), trimmed, ""))
    return F.filter(clean, lambda x: x != "")


def regex_quote(c: Column | str) -> Column:
    """A text as a regular expression that matches just it."""
    return F.regexp_replace(col(c), r"([.*+?^${}()|\[\]\\])", r"\\$1")


def slice_between(html: Column | str, start: str, end: str | None = None, pattern: bool = False) -> Column:
    """From the first ``start`` up to the next ``end``, or to the text's end; null without ``start``.

    Both are taken literally without regard to case, or as regular expressions if ``pattern``.  An ``end``
    at the very beginning does not count.
    """

    def bound(x: str) -> Column:
        return F.lit(x) if pattern else F.concat(F.lit("(?i)"), regex_quote(F.lit(x)))

    html = text_or_empty(html)
    at = F.regexp_instr(html, bound(start))
    rest = F.substr(html, at)
    stop = F.regexp_instr(rest, bound(end)) if end else F.lit(0)
    return F.when(at > 0, F.when(stop > 1, F.substr(rest, F.lit(1), stop - 1)).otherwise(rest))


def attributes(html: Column | str, tag: str, name: str) -> Column:
    """The values of one attribute over all elements of a tag that have it, decoded; empty ones do not count."""
    tags = F.regexp_extract_all(text_or_empty(html), F.lit(rf"(?i)<{re.escape(tag)}\b[^>]*>"), F.lit(0))
    quoted = rf"(?i){re.escape(name)}=[\"']([^\"']+)[\"']"
    return F.transform(F.filter(tags, lambda t: t.rlike(quoted)), lambda t: decode_entities(F.regexp_extract(t, quoted, 1)))


def page_summary(html: Column | str) -> Column:
    """title, text_chars, line_count and ld_json count of a page."""
    lines = text_lines(html)
    return F.struct(
        title_decoded(html).alias("title"),
        F.length(F.array_join(lines, "\n")).alias("text_chars"),
        F.size(lines).alias("line_count"),
        F.size(ld_json(html)).alias("ld_blocks"),
    )
