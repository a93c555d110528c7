"""Text folding, tokens and similarities."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ACCENTED = "ÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇáàâäãåéèêëíìîïóòôöõúùûüñç"
PLAIN = "AAAAAAEEEEIIIIOOOOOUUUUNCaaaaaaeeeeiiiiooooouuuunc"


def fold(text: Column) -> Column:
    """Lower case without accents, other signs as single blanks; null if nothing is left."""
    t = F.trim(F.regexp_replace(F.lower(F.translate(text, ACCENTED, PLAIN)), "[^a-z0-9]+", " "))
    return F.when(t != "", t)


def slug(text: Column) -> Column:
    return F.replace(fold(text), F.lit(" "), F.lit("-"))


def split_glued(text: Column) -> Column:
    """Blanks between a small and a capital letter, and between letters and digits."""
    t = F.regexp_replace(text, "([a-z])([A-Z])", "$1 $2")
    return F.regexp_replace(F.regexp_replace(t, "([A-Za-z])([0-9])", "$1 $2"), "([0-9])([A-Za-z])", "$1 $2")


def plural_stem(token: Column) -> Column:
    """Singular-like form of a Spanish word of more than four letters."""
    return F.when((F.length(token) > 5) & F.endswith(token, F.lit("es")), F.left(token, F.length(token) - 2)).when((F.length(token) > 4) & F.endswith(token, F.lit("s")), F.left(token, F.length(token) - 1)).otherwise(token)


def char_ngrams(text: Column, *sizes: int) -> Column:
    """n-grams of the given sizes of every word of a folded text, edges marked, with repeats;
    words too short for a size have none of it."""
    padded = F.transform(F.split(text, " "), lambda w: F.concat(F.lit("#"), w, F.lit("#")))
    grams = lambda n: F.flatten(F.transform(F.filter(padded, lambda w: F.length(w) >= n), lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - (n - 1)), lambda i: F.substring(w, i, F.lit(n)))))
    return F.concat(*[grams(n) for n in sizes])


def jaro(a: str, b: str) -> float:
    """0 for empty texts; out of order are pairs of letters, so half of them counts, rounded down."""
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken = [False] * len(b)
    mine = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                mine.append(c)
                break
    if not mine:
        return 0.0
    theirs = [b[j] for j in range(len(b)) if taken[j]]
    swaps = sum(x != y for x, y in zip(mine, theirs, strict=True)) // 2
    m = len(mine)
    return (m / len(a) + m / len(b) + (m - swaps) / m) / 3


def jaro_winkler_text(a: str, b: str, scale: float = 0.1) -> float:
    """Jaro with a boost for up to four equal first letters, whatever the score."""
    base, prefix = jaro(a, b), 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        prefix += 1
    return base + prefix * scale * (1 - base)


def token_set_text(a: str, b: str) -> float:
    """Best matching ratio of the common words against either side's words."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    common = " ".join(sorted(x & y))
    left, right = (common + " " + " ".join(sorted(x - y))).strip(), (common + " " + " ".join(sorted(y - x))).strip()
    ratios = [SequenceMatcher(None, left, right, autojunk=False).ratio()]
    if common:
        ratios += [SequenceMatcher(None, common, s, autojunk=False).ratio() for s in (left, right)]
    return max(ratios)


def tokens_match(a: str, b: str) -> bool:
    """Equal, the shorter of four letters or more begins the longer, or both have five or more
    and are alike to 0.93 by Jaro-Winkler."""
    if a == b:
        return True
    least = min(len(a), len(b))
    return (least >= 4 and (a.startswith(b) or b.startswith(a))) or (least >= 5 and jaro_winkler_text(a, b) >= 0.93)


def soft_overlap_text(a: str, b: str) -> float:
    """Dice over distinct words, each paired with the first free one that matches."""
    x, free = list(dict.fromkeys(a.split())), list(dict.fromkeys(b.split()))
    if not x or not free:
        return 0.0
    total, hits = len(x) + len(free), 0
    for w in x:
        hit = next((z for z in free if tokens_match(w, z)), None)
        if hit is not None:
            free.remove(hit)
            hits += 1
    return 2 * hits / total


def _pairwise(f):
    @F.pandas_udf(T.DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else f(x, y) for x, y in zip(a, b, strict=True)])

    return run


jaro_winkler = _pairwise(jaro_winkler_text)
token_set_ratio = _pairwise(token_set_text)
soft_token_overlap = _pairwise(soft_overlap_text)
