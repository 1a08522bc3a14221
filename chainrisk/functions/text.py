"""Text expressions: transcript cleaning, n-grams, company names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Legal-form endings removed from company names.
LEGAL_FORMS = [
    "ab", "ag", "as", "asa", "bv", "co", "company", "corp", "corporation", "gmbh", "inc",
    "incorporated", "kg", "kk", "limited", "llc", "llp", "lp", "ltd", "nv", "oy", "oyj", "plc",
    "pte", "pty", "sa", "sas", "se", "spa", "srl",
]


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clean_text(text: Column | str) -> Column:
    """Lower case, then delete everything that is no letter and no blank.

    Deletion (not replacement) glues words around hyphens and line breaks.
    """
    return F.regexp_replace(F.lower(_c(text)), "[^a-zA-Z ]", "")


def words_of(text: Column | str) -> Column:
    """Words of the cleaned text, without empty tokens."""
    return F.filter(F.split(clean_text(text), " +"), lambda w: w != "")


def bigrams_of(words: Column | str) -> Column:
    """Adjacent word pairs joined by a blank."""
    w = _c(words)
    pairs = F.greatest(F.size(w) - 1, F.lit(0))
    return F.zip_with(
        F.slice(w, 1, pairs), F.slice(w, 2, pairs), lambda a, b: F.concat(a, F.lit(" "), b)
    )


def base_name(name: Column | str) -> Column:
    """Lower-cased company name without up to two trailing legal forms."""
    ending = "[ ,.]+(" + "|".join(LEGAL_FORMS) + ")[.]?$"
    once = F.regexp_replace(F.trim(F.lower(_c(name))), ending, "")
    return F.trim(F.regexp_replace(once, ending, ""))


def name_tokens(name: Column | str) -> Column:
    """Sorted distinct tokens of a name: ASCII letters, digits and underscores."""
    plain = F.regexp_replace(_c(name), "[^\\x00-\\x7F]", "")
    plain = F.regexp_replace(F.lower(plain), "[^a-z0-9_]", " ")
    return F.array_sort(F.array_distinct(F.filter(F.split(plain, " +"), lambda t: t != "")))
