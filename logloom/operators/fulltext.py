"""Full-text search: every word of the query, with some typing errors allowed, in one field.

Words up to 2 letters match exactly, up to 5 with one edit, longer ones with two; an edit inserts, deletes or
replaces a letter or swaps two neighbours.  Spark's Levenshtein distance counts a swap as two edits, so the words
that a swap makes of the query's word are compared as well.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.metadata import bound
from ..functions.texts import tokens
from ..schema import KEYWORDS, TEXTS

_TOKEN = re.compile(r"[^\W]+(?:['.][^\W\d]+|[.,]\d+)*")


def query_words(text: str) -> list[str]:
    return list(dict.fromkeys(_TOKEN.findall(text.lower())))


def edits(word: str) -> int:
    return 0 if len(word) <= 2 else 1 if len(word) <= 5 else 2


def swaps(word: str) -> list[str]:
    """The word with two neighbours swapped, in every way that changes it."""
    return sorted({word[:i] + word[i + 1] + word[i] + word[i + 2 :] for i in range(len(word) - 1)} - {word})


def word_matches(t: Column, word: str) -> Column:
    k = edits(word)
    if k == 0:
        return t == word
    # Words of too different a length are out before any distance is computed.
    near = F.length(t).between(len(word) - k, len(word) + k)
    close = F.levenshtein(t, F.lit(word), k) >= 0
    once = swaps(word)
    if once:
        close |= t.isin(*once)
    if k == 2:
        twice = sorted({b for s in once for b in swaps(s)})
        if twice:
            close |= t.isin(*twice)
        if once:  # a swap is two edits, so only words three edits away are left for a swap and another edit
            close |= (F.levenshtein(t, F.lit(word), 3) >= 0) & reduce(lambda a, b: a | b, [F.levenshtein(t, F.lit(s), 1) >= 0 for s in once])
    return near & close


def field_matches(name: str, text: str) -> Column:
    if name in KEYWORDS:
        return F.col(name) == text
    said = query_words(text)
    if not said:
        return F.lit(False)
    return bound(tokens(F.col(name)), lambda words: reduce(lambda a, b: a & b, [some_match(words, w) for w in said]))


def some_match(words: Column, word: str) -> Column:
    return F.exists(words, lambda t: word_matches(t, word))


def matches_text(text: str, fields: tuple[str, ...]) -> Column:
    """Whether one of the fields has all words of the text; unknown fields are left out."""
    known = [f for f in fields if f in TEXTS or f in KEYWORDS]
    return reduce(lambda a, b: a | b, [field_matches(f, text) for f in known], F.lit(False))
