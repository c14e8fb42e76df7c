"""Scalar functions on addresses, as Column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import constants as K
from .text import holds_any, text_or_empty

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?(\[[^\]]*\]|[^/?#:]*)"


def host(url: Column | str) -> Column:
    """The lower-cased host without port and credentials; empty if there is none."""
    return F.lower(F.regexp_replace(F.regexp_extract(text_or_empty(url), HOST, 1), r"[\[\]]", ""))


def timeout_s(url: Column | str) -> Column:
    path = F.element_at(F.split(F.lower(text_or_empty(url)), r"\?"), 1)
    return F.when(F.endswith(path, F.lit(".pdf")), F.lit(K.PDF_TIMEOUT_S)).otherwise(F.lit(K.TIMEOUT_S))


def robots_path(url: Column | str) -> Column:
    """The path, or /, with the query behind it."""
    rest = F.regexp_replace(text_or_empty(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*|#.*$", "")
    path = F.regexp_extract(rest, r"^([^?]*)", 1)
    query = F.regexp_extract(rest, r"^[^?]*\?(.*)$", 1)
    path = F.when(path == "", F.lit("/")).otherwise(path)
    return F.when(query == "", path).otherwise(F.concat(path, F.lit("?"), query))


def origin(url: Column | str) -> Column:
    return F.regexp_extract(text_or_empty(url), r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)


def is_asset(url: Column | str) -> Column:
    return text_or_empty(url).rlike("(?i)" + K.ASSET)


def is_third_party(url: Column | str) -> Column:
    return text_or_empty(url).rlike("(?i)" + K.THIRD_PARTY)


def is_avatar(url: Column | str, markers: tuple[str, ...] = K.AVATAR_MARKERS) -> Column:
    return holds_any(url, list(markers))


def hires(template: Column, media_id: Column, width: int = K.HIRES_WIDTH) -> Column:
    """The first {id} and the first {w} of a template filled in; ids are taken as they are."""

    def filled(text: Column, place: str, value: Column) -> Column:
        at = F.locate(place, text)
        return F.when(at > 0, F.concat(F.substr(text, F.lit(1), at - 1), value, F.substr(text, at + len(place)))).otherwise(text)

    return filled(filled(template, "{id}", media_id), "{w}", F.lit(str(width)))


def media_id(url: Column | str, pattern: str) -> Column:
    """The pattern's first group, or null."""
    return F.nullif(F.regexp_extract(text_or_empty(url), pattern, 1), F.lit(""))


def is_relative(url: Column | str) -> Column:
    return ~text_or_empty(url).rlike("(?i)^[a-z]+://")


@F.pandas_udf(StringType())
def encode_url(urls: pd.Series) -> pd.Series:
    """An address as it is sent: host in IDNA form, path, query and fragment percent-encoded once."""
    from urllib.parse import quote, urlsplit, urlunsplit

    def one(url: str | None) -> str | None:
        if url is None:
            return None
        try:
            parts = urlsplit(url)
            name, port = parts.hostname or "", parts.port
        except ValueError:
            return None
        try:
            name = name.encode("idna").decode("ascii") if name else ""
        except UnicodeError:
            pass
        user = parts.username or ""
        if user and parts.password:
            user += f":{parts.password}"
        where = (f"{user}@" if user else "") + name + (f":{port}" if port else "")
        return urlunsplit((parts.scheme, where, quote(parts.path, "/%"), quote(parts.query, "=&%"), quote(parts.fragment, "%")))

    return urls.map(one)


def pin(entry: Column | str) -> Column:
    """``host:address`` as struct(host, address), split at the first colon; address null unless an IP literal."""
    entry = text_or_empty(entry)
    address = F.regexp_replace(F.regexp_extract(entry, "^[^:]*:(.*)$", 1), r"^\[|\]$", "")
    octet = "(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
    v4, v6 = rf"^{octet}(\.{octet}){{3}}$", r"^(?=.*:)[0-9A-Fa-f:]{2,39}$"
    shown = F.when(address.rlike(v4), address).when(address.rlike(v6), F.concat(F.lit("["), address, F.lit("]")))
    return F.struct(F.regexp_extract(entry, "^([^:]*):", 1).alias("host"), shown.alias("address"))
