"""Column functions over URLs and HTML."""

import html as _html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestry import fixed_values as fv
from attestry.functions.text import collapse, let
from attestry.params import DEFAULTS

# Entities handled on the JVM; text with any other entity goes to Python.
_COMMON = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"),
           ("&nbsp;", "\u00a0"), ("&copy;", "©"), ("&middot;", "·"), ("&reg;", "®"))
_OTHER_ENTITY = "&(?!(?:amp|%s);)[#a-zA-Z]" % "|".join(e[1:-1] for e, _ in _COMMON)


@F.pandas_udf(T.StringType())
def _unescape(s: pd.Series) -> pd.Series:
    return s.map(_html.unescape, na_action="ignore")


def unescape(c: Column) -> Column:
    rare = c.rlike(_OTHER_ENTITY)
    plain = c
    for entity, char in _COMMON:
        plain = F.replace(plain, F.lit(entity), F.lit(char))
    plain = F.replace(plain, F.lit("&amp;"), F.lit("&"))
    return F.coalesce(_unescape(F.when(rare, c)), plain)


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]+>", " ")


def whole_text(html: Column) -> Column:
    return collapse(unescape(strip_tags(html)))


def page_text(html: Column, limit: int | None = DEFAULTS.page_text_limit) -> Column:
    """STRUCT(text, n_chars, truncated): the text up to the limit (None: all of it) and what the limit left out."""
    struct = lambda w: F.struct((w if limit is None else F.left(w, F.lit(limit))).alias("text"), F.length(w).alias("n_chars"),
                                (F.lit(False) if limit is None else F.length(w) > limit).alias("truncated"))
    return let(whole_text(html), struct)


def domain(url: Column) -> Column:
    full = F.when(url.contains("://"), url).otherwise(F.concat(F.lit("https://"), url))
    authority = F.regexp_extract(full, "^[^:/?#]*://([^/?#]*)", 1)
    host = F.regexp_replace(F.regexp_replace(authority, "^.*@", ""), r":\d*$", "")
    host = F.rtrim(F.lower(host), F.lit("."))
    return F.nullif(F.regexp_replace(host, r"^www\.", ""), F.lit(""))


def is_official(url: Column, owner: Column) -> Column:
    host, allowed = domain(url), domain(owner)
    return F.coalesce((host == allowed) | F.endswith(host, F.concat(F.lit("."), allowed)), F.lit(False))


def links(html: Column, pattern: str = fv.RESULT_LINK) -> Column:
    """ARRAY<STRUCT(href, title)> of the search links in a page, in page order."""
    rx = F.lit("(?is)" + pattern)
    return F.arrays_zip(F.regexp_extract_all(html, rx, F.lit(1)).alias("href"),
                        F.regexp_extract_all(html, rx, F.lit(2)).alias("title"))


def unwrap_redirect(href: Column, param: str = fv.REDIRECT_PARAM) -> Column:
    plain = unescape(href)
    query = F.regexp_extract(plain, r"[?&]%s=([^&#]+)" % param, 1)
    once = F.coalesce(F.try_url_decode(query), query)
    # a redirect target is encoded twice; a plus sign survives the second decode
    twice = F.coalesce(F.try_url_decode(F.replace(once, F.lit("+"), F.lit("%2B"))), once)
    return F.when(query != "", twice).otherwise(plain)


def found_text(html: Column) -> Column:
    """Search-result titles and snippets as they stand in the page, tags left out."""
    parts = F.regexp_extract_all(html, F.lit("(?is)" + fv.RESULT_TEXT), F.lit(1))
    return F.array_join(F.transform(parts, strip_tags), " ")


def mentions(html: Column) -> Column:
    """Search-result titles and snippets joined into one evidence text."""
    return collapse(unescape(found_text(html)))
