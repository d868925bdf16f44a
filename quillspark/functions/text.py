"""Tokens, n-grams and predicates on text as column expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import STOPWORDS

WHITE = r"\p{IsWhite_Space}"
#: A grouped numeral that no letter or digit follows, else a run of letters and digits. Possessive, so that nothing is given back.
_TOKEN = r"(?:[0-9]{1,3}+(?:\.[0-9]{3})++(?:,[0-9]++)?+(?![\p{IsAlphabetic}\p{N}]))|[\p{IsAlphabetic}\p{N}]++"
_THOUSANDS = r"^[0-9]{1,3}(\.[0-9]{3})+(,[0-9]+)?$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def collapse(text: Column) -> Column:
    """Arabic vowel marks dropped, white space collapsed and trimmed; compatibility forms are left as they are."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), "[ً-ْٰ]", "")
    return F.trim(F.regexp_replace(bare, f"{WHITE}+", " "))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(_TOKEN), F.lit(0))


def is_thousands(token: Column) -> Column:
    return token.rlike(_THOUSANDS)


def white_terms(text: Column) -> Column:
    """Lower-case words between white space, punctuation kept."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), f"{WHITE}+"), lambda x: x != "")


def without_stopwords(words: Column, stopwords: Sequence[str] = STOPWORDS) -> Column:
    return F.filter(words, lambda x: ~x.isin(*stopwords))


def _indices(n: Column) -> Column:
    """1..n, empty for n < 1."""
    return F.when(n >= 1, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))


def bigrams(words: Column) -> Column:
    """a_b of neighbours that both have more than two bytes."""
    pair = lambda a, b: F.when((F.octet_length(a) > 2) & (F.octet_length(b) > 2), F.concat(a, F.lit("_"), b))
    pairs = lambda w: F.zip_with(F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, F.lit(2), F.size(w)), pair)
    return let(words, lambda w: F.filter(pairs(w), lambda x: x.isNotNull()))


def padded_trigrams(word: Column) -> Column:
    return let(F.concat(F.lit("#"), word, F.lit("#")), lambda p: F.transform(_indices(F.length(p) - 2), lambda i: F.substring(p, i, F.lit(3))))


def trigrams(words: Column) -> Column:
    """Trigrams of words of four characters or more that are no grouped numerals, repeats kept."""
    long = F.filter(words, lambda w: (F.length(w) >= 4) & ~is_thousands(w))
    return F.flatten(F.transform(long, padded_trigrams))


def wide_bigrams(word: Column, ascii_first: bool) -> Column:
    """Neighbouring characters of which the first is a CJK one (from U+4E00) or, on request, an ASCII letter."""
    pairs = F.transform(_indices(F.length(word) - 1), lambda i: F.substring(word, i, F.lit(2)))
    return F.filter(pairs, lambda x: (F.ascii(x) >= 0x4E00) | (x.rlike("^[A-Za-z]") if ascii_first else F.lit(False)))


def has_term(text: Column, terms: Sequence[str]) -> Column:
    """Whether any of the terms is in the lower-case text."""
    return F.lower(text).rlike("|".join("\\Q" + t + "\\E" for t in terms)) if terms else F.lit(False)


def digit_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[0-9]"))


def snippet(text: Column, n: int) -> Column:
    return F.left(F.regexp_replace(text, WHITE, " "), F.lit(n))


def query_params(url: Column) -> Column:
    """The parameters of a URL's query as an array of key and value; %20 is a space, the first = of a part separates."""
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    parts = F.filter(F.split(query, "&"), lambda x: F.contains(x, F.lit("=")))
    space = lambda x: F.replace(x, F.lit("%20"), F.lit(" "))
    pair = lambda x: F.struct(space(F.substring_index(x, "=", 1)).alias("key"), space(F.regexp_replace(x, "^[^=]*=", "")).alias("value"))
    return F.transform(parts, pair)
