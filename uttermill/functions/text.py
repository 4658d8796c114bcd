"""String column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ascii_fold(col) -> Column:
    """Drop every non-ASCII character and trim blanks (the paraphrase
    clean-up and the stand-in corpus both use it)."""
    return F.trim(F.regexp_replace(_c(col), "[^\\x01-\\x7F]", ""))


def norm_paraphrase(col) -> Column:
    """Near-equality key: ``? . ,`` removed, lower case."""
    return F.lower(F.translate(_c(col), "?.,", ""))


def md5_order(seed, *cols) -> Column:
    """Deterministic pseudo-random sort key: md5 of seed and columns
    joined by ``|``."""
    parts = [F.lit(str(seed))] + [_c(c).cast("string") for c in cols]
    return F.md5(F.concat_ws("|", *parts))


def tokens_space(col) -> Column:
    """Blank-separated tokens, empties kept (positions are exact)."""
    return F.split(_c(col), " ")


def words_ws(col) -> Column:
    """Whitespace-separated words without empties (``str.split()``)."""
    return F.filter(F.split(_c(col), "\\s+"), lambda x: x != "")


def tokens_lower(col) -> Column:
    """Classifier tokens: lower case, split on non-alphanumerics."""
    return F.filter(F.split(F.lower(_c(col)), "[^a-z0-9]+"), lambda x: x != "")


def lemma_rule(col) -> Column:
    """Rule lemmatiser used to build test lexicons: drop a final ``ing``,
    ``ed`` or ``s`` if at least three letters remain."""
    t = _c(col)
    n = F.length(t)
    return (
        F.when(t.endswith("ing") & (n >= 6), t.substr(F.lit(1), n - 3))
        .when(t.endswith("ed") & (n >= 5), t.substr(F.lit(1), n - 2))
        .when(t.endswith("s") & (n >= 4), t.substr(F.lit(1), n - 1))
        .otherwise(t)
    )
