"""Column functions for cleaning text and building comparison keys."""

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestry import fixed_values as fv

# Characters whose compatibility form equals themselves (or that later steps map
# anyway): text made only of these never needs the Python normalizer.
_NEEDS_NFKC = (r"[^\x00-\x7F\u00A0-\u00A7\u00A9\u00AB-\u00AE\u00B0\u00B1\u00B6\u00B7\u00BB\u00BF-\u00FF"
               r"\u2010-\u2014\u2212]")


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def nfkc(c: Column) -> Column:
    """Compatibility normalization; only text that can change is sent to Python."""
    return F.coalesce(_nfkc(F.when(c.rlike(_NEEDS_NFKC), c)), c)


def let(value: Column, body) -> Column:
    """Evaluate `value` once and hand it to `body`, for costly values used many times."""
    return F.get(F.transform(F.array(value), body), 0)


def collapse(c: Column) -> Column:
    """Runs of any Unicode whitespace to one blank, ends trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)[\s\x1c-\x1f]+", " "))


def tidy(c: Column) -> Column:
    """The JVM-side part of `clean_text`, for text known to be NFKC-stable."""
    plain = F.translate(c, fv.DASHES, "-" * len(fv.DASHES))
    plain = F.regexp_replace(plain, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    return F.nullif(collapse(plain), F.lit(""))


def clean_text(c: Column) -> Column:
    return tidy(nfkc(c))


# case folding beyond lower case: letters that fold to one other letter, and those that fold to several
_FOLDED = "".join(c for c in map(chr, range(0x80, 0x2000)) if len(c.casefold()) == 1 and c.casefold() != c.lower())
_SPELLED = {c: c.casefold() for c in "ßŉǰẖẗẘẙẚﬀﬁﬂﬃﬄﬅﬆ"}


def casefold(c: Column) -> Column:
    """Unicode case folding; final sigma and ligatures included.  ASCII text is only lowered."""

    def spelled(low: Column) -> Column:
        out = low
        for letter, written in _SPELLED.items():
            out = F.replace(out, F.lit(letter), F.lit(written))
        return F.when(low.rlike(f"[{''.join(_SPELLED)}]"), out).otherwise(low)

    full = let(F.translate(F.lower(c), _FOLDED, _FOLDED.casefold()), spelled)
    return F.when(c.rlike(r"[^\x00-\x7F]"), full).otherwise(F.lower(c))


def is_placeholder(cleaned: Column) -> Column:
    """Expects cleaned text; NULL counts as a placeholder."""
    token = F.btrim(casefold(cleaned), F.lit(fv.PLACEHOLDER_TRIM))
    return F.coalesce(token.isin(*fv.PLACEHOLDERS), F.lit(True))


def clean_optional(c: Column) -> Column:
    return let(clean_text(c), lambda x: F.when(~is_placeholder(x), x))


def display_name(cleaned: Column) -> Column:
    return F.trim(F.regexp_replace(cleaned, r"(?U)\s*\([^()]+\)\s*$", ""))


def comparison_key(c: Column) -> Column:
    return F.trim(F.regexp_replace(casefold(c), "[^a-z0-9]+", " "))


def entity_key(cleaned: Column) -> Column:
    """Name key without vendor code, punctuation and trailing legal suffixes."""
    return display_key(display_name(cleaned))


def display_key(display: Column) -> Column:
    """Name key of a name that is shown without its vendor code."""
    key = comparison_key(F.replace(display, F.lit("&"), F.lit(" and ")))
    return F.trim(F.regexp_replace(key, "(?:(?:^| )(?:%s))+$" % "|".join(fv.LEGAL_SUFFIXES), ""))


def part_key(c: Column) -> Column:
    return F.regexp_replace(casefold(c), "[^a-z0-9]+", "")


def comparison_text(c: Column, remove_trademarks: bool = False) -> Column:
    base = F.translate(c, "®™", "") if remove_trademarks else c
    return F.coalesce(collapse(casefold(base)), F.lit(""))


def words(c: Column, min_length: int = 1) -> Column:
    found = F.regexp_extract_all(casefold(c), F.lit("[a-z0-9]+"), F.lit(0))
    return F.filter(found, lambda w: F.length(w) >= min_length)


def content_words(c: Column) -> Column:
    """Words that start with a letter, three or more characters, without stopwords."""
    found = F.regexp_extract_all(F.lower(c), F.lit("[a-z][a-z0-9]{2,}"), F.lit(0))
    return F.array_except(F.array_distinct(found), F.array(*[F.lit(w) for w in fv.SAMPLE_STOPWORDS]))


def is_sparse(description: Column) -> Column:
    d = F.coalesce(description, F.lit(""))
    flat = collapse(d)
    n_words = F.when(flat == "", 0).otherwise(F.size(F.split(flat, " ")))
    return (F.length(d) < 80) | (n_words < 8)


def regex_quote(c: Column) -> Column:
    """Literal pattern for a column value."""
    return F.concat(F.lit("\\Q"), F.replace(c, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def classification_query(description: Column, part_number: Column) -> Column:
    q = F.coalesce(description, F.lit(""))
    q = F.when(F.length(part_number) > 0,
               F.regexp_replace(q, F.concat(F.lit("(?iu)"), regex_quote(part_number)), F.lit(" "))
               ).otherwise(q)
    for pattern, replacement in fv.QUERY_REWRITES:
        q = F.regexp_replace(q, "(?iuU)" + pattern, replacement)
    for patterns, extra in fv.QUERY_EXPANSIONS:
        hit = F.lit(True)
        for pattern in patterns:
            hit = hit & q.rlike("(?iuU)" + pattern)
        q = F.when(hit, F.concat(q, F.lit(" " + extra))).otherwise(q)
    return F.btrim(F.regexp_replace(q, r"(?U)\s+", " "), F.lit(" -_,"))


def leaf(path: Column, sep: str = ">") -> Column:
    return F.element_at(F.split(path, sep), -1)
