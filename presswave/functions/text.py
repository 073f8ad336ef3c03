"""Text functions as column expressions, and the few that need Python (Unicode decomposition)."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from presswave.functions.expressions import let


@F.pandas_udf(StringType())
def fold(text: pd.Series) -> pd.Series:
    """Compatibility decomposition without combining marks, lower case, [a-z0-9 -] only, spaces folded."""

    def one(x: str | None) -> str | None:
        if x is None:
            return None
        x = "".join(c for c in unicodedata.normalize("NFKD", x) if not "̀" <= c <= "ͯ").lower()
        return re.sub(r"\s+", " ", re.sub(r"[^a-z0-9\s-]", " ", x)).strip()

    return text.map(one)


@F.pandas_udf(StringType())
def fold_keyword(text: pd.Series) -> pd.Series:
    """Like ``fold`` but keeps letters and digits of all scripts and drops quotes."""

    def one(x: str | None) -> str | None:
        if x is None:
            return None
        x = "".join(c for c in unicodedata.normalize("NFKD", x) if not "̀" <= c <= "ͯ").lower()
        x = re.sub(r"[\"'`‘’“”]", "", x)
        return re.sub(r"\s+", " ", "".join(c if c.isalnum() or c in "- " else " " for c in x)).strip()

    return text.map(one)


def tokens(text: Column, least: int = 3, stopwords: tuple[str, ...] = ()) -> Column:
    """Distinct lower-case words of at least ``least`` characters that are no stopwords."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) >= least)
    return F.array_distinct(F.array_except(words, F.array(*map(F.lit, stopwords))) if stopwords else words)


def word_list(text: Column, least: int = 3) -> Column:
    """All lower-case words of at least ``least`` characters, in order."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) >= least)


def grams(text: Column, n: int) -> Column:
    """Character n-grams in order (for scripts without spaces)."""
    run = lambda t: F.transform(F.sequence(F.lit(1), F.length(t) - (n - 1)), lambda i: F.substring(t, i, F.lit(n)))
    return let(text, lambda t: F.when(F.length(t) >= n, run(t)).otherwise(F.array().cast("array<string>")))


def parts(text: Column, sizes: Column) -> Column:
    """Structs of i (from 1) and word: every run of ``sizes`` (an array) characters of a text.

    The characters are taken apart once: places in a text of more than ASCII are found by counting from its start.
    """
    none = F.array().cast("array<struct<i:int,word:string>>")
    runs = lambda c, k: F.when(F.size(c) >= k, F.transform(F.sequence(F.lit(1), F.size(c) - k + 1), lambda i: F.struct(i.alias("i"), F.array_join(F.slice(c, i, k), "").alias("word")))).otherwise(none)
    return let(F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, "")), lambda c: F.flatten(F.transform(sizes, lambda k: runs(c, k))))


def bigrams(words: Column) -> Column:
    """Neighbouring pairs of a word list, which is computed once."""
    pairs = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.concat_ws(" ", F.get(w, i - 1), F.get(w, i)))
    return let(words, lambda w: F.when(F.size(w) >= 2, pairs(w)).otherwise(F.array().cast("array<string>")))


def most_frequent(words: Column, most: int) -> Column:
    """Structs of down (the negative count) and word: the ``most`` commonest elements of an array without nulls, ties to the smaller.

    The array is sorted and its runs are measured, so counting needs no shuffle.
    """
    starts = lambda w: F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: (i == 0) | (F.get(w, i) != F.get(w, i - 1)))
    runs = lambda w, at: F.transform(at, lambda i, k: F.struct((i - F.coalesce(F.get(at, k + 1), F.size(w))).cast("long").alias("down"), F.get(w, i).alias("word")))
    none = F.array().cast("array<struct<down:bigint,word:string>>")
    return let(F.sort_array(words), lambda w: F.when(F.size(w) > 0, let(starts(w), lambda at: F.slice(F.sort_array(runs(w, at)), 1, most))).otherwise(none))


def trigrams(text: Column) -> Column:
    """Distinct trigrams of each word padded by two spaces before and one after."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))))


def jaccard(a: Column, b: Column, both_empty: float = 0.0) -> Column:
    """Of two arrays without repeats; ``both_empty`` for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(both_empty)).otherwise(F.size(F.array_intersect(a, b)) / union)


def containment(a: Column, b: Column) -> Column:
    least = F.least(F.size(a), F.size(b))
    return F.when(least == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / least)


def trigram_similarity(a: Column, b: Column) -> Column:
    return jaccard(trigrams(a), trigrams(b))


def weighted_jaccard(a: Column, b: Column) -> Column:
    """Of two maps from keys to weights: sum of least over sum of greatest."""
    keys = F.array_union(F.map_keys(a), F.map_keys(b))
    of = lambda m, k: F.coalesce(F.element_at(m, k), F.lit(0.0))
    least = F.aggregate(keys, F.lit(0.0), lambda s, k: s + F.least(of(a, k), of(b, k)))
    most = F.aggregate(keys, F.lit(0.0), lambda s, k: s + F.greatest(of(a, k), of(b, k)))
    return F.when(most == 0, F.lit(0.0)).otherwise(least / most)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """A vector at unit length; its norm is computed once."""
    return let(F.sqrt(dot(v, v)), lambda n: F.transform(v, lambda x: x / n))


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is zero."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, F.lit(0.0)).otherwise(dot(a, b) / norm)


def domain(url: Column) -> Column:
    return F.regexp_replace(F.parse_url(url, F.lit("HOST")), r"^www\.", "")


def number(cell: Column) -> Column:
    """The first number of a table cell: footnotes, parentheses and group separators are dropped, dashes are minus signs."""
    bare = F.regexp_replace(F.translate(cell, "−–—", "---"), r"\[[^\]]*\]|\([^)]*\)", "")
    return F.regexp_replace(F.regexp_extract(bare, r"-?[0-9][0-9,]*(?:\.[0-9]+)?", 0), ",", "").try_cast("double")


def fingerprint(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *(F.coalesce(p, F.lit("")) for p in parts)), 256)


def ascii_edges(pattern: str) -> str:
    """A pattern whose word boundaries know ASCII words alone, as in SQL and the reference; those of Java take letters of all scripts for words."""
    return pattern.replace(r"\b", r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))")


def is_ascii(text: Column) -> Column:
    return text.rlike(r"^[\x00-\x7F]*$")


def has_prefixes(text: Column, prefixes: tuple[str, ...]) -> Column:
    """Every prefix starts some word of the text."""
    words = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    starts = [(lambda p: F.exists(words, lambda w: w.startswith(p)))(p) for p in prefixes]
    return reduce(lambda a, b: a & b, starts, F.lit(True))
