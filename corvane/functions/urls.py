"""URL expressions that never fail on a bad URL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def page_of(source_url: str = "source_url", url: str = "url") -> Column:
    """``source_url`` as written, ``url`` where that is null or empty."""
    return F.coalesce(F.nullif(F.col(source_url), F.lit("")), F.col(url))


def site_of(url: Column) -> Column:
    """The host in lower case, without user, port and a leading ``www.``; empty where there is none."""
    host = F.regexp_extract(F.lower(F.trim(url)), r"^(?:[a-z][a-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.regexp_replace(host, r"^www\.", "")


def language_of(language: Column) -> Column:
    """A two-letter code from the spellings of one language: case, region and a few names; ``und`` where it isn't given."""
    low = F.lower(F.trim(F.coalesce(language, F.lit(""))))
    base = F.regexp_extract(low, r"^([^-_]*)", 1)
    named = F.coalesce(*(F.when(base == name, F.lit(code)) for name, code in LANGUAGE_NAMES.items()), base)
    return F.when(named == "", "und").otherwise(named)


#: Names and wrong codes in use for a language, and its code.
LANGUAGE_NAMES = {
    "english": "en", "german": "de", "deutsch": "de", "french": "fr", "français": "fr", "francais": "fr", "spanish": "es", "español": "es",
    "portuguese": "pt", "português": "pt", "russian": "ru", "русский": "ru", "japanese": "ja", "日本語": "ja", "jp": "ja", "unknown": "und",
}
