"""Tokens and n-grams as array expressions."""

from pyspark.sql import functions as F
from pyspark.ml.feature import StopWordsRemover

# The patterns that define a token.
CONTRACTION = r"(?i)(n['’]t|['’](?:s|re|ve|ll|d|m))([^\p{L}\p{N}]|$)"
SEPARATOR = r"[^\p{L}\p{N}]+"
ALPHABETIC = r"^\p{L}+$"


def default_stopwords():
    """Spark's own English list; needs a running session."""
    return StopWordsRemover.loadDefaultStopWords("english")


def pieces(text):
    """Split on anything that is no letter or digit, after cutting contraction tails."""
    return F.split(F.regexp_replace(text, CONTRACTION, " $2"), SEPARATOR)


def surface_tokens(text, stopwords=()):
    """Alphabetic tokens whose lower-cased surface form is no stopword."""
    stop = sorted({w.lower() for w in stopwords or ()})

    def keep(token):
        alphabetic = token.rlike(ALPHABETIC)
        return alphabetic & ~F.lower(token).isin(stop) if stop else alphabetic

    return F.filter(pieces(text), keep)


def tokens(text, stopwords=(), lowercase=True):
    if not lowercase:
        return surface_tokens(text, stopwords)
    stop = sorted({w.lower() for w in stopwords or ()})
    words = F.transform(surface_tokens(text), F.lower)  # once a token, for the stopwords and the result
    return F.filter(words, lambda token: ~token.isin(stop)) if stop else words


def ngrams(words, n):
    """All n-grams of a token array joined by one space; empty if it is too short.

    Tokens are taken by position: slicing out each n-gram would copy the array every time.
    """
    if n == 1:
        return words
    starts = F.slice(words, n, F.greatest(F.size(words), F.lit(1)))
    return F.transform(starts, lambda _, i: F.concat_ws(
        " ", *[F.get(words, i + k) for k in range(n)]))
