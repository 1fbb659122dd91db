"""Matches of a text search marked in its fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.texts import TOKEN
from ..options import LogQuery
from ..schema import TEXTS
from .fulltext import query_words, some_match, word_matches

PRE, POST = '<em class="highlight">', "</em>"
FRAGMENT_CHARS, FRAGMENTS = 150, 3
SENTENCE = rf"(?s).{{1,{FRAGMENT_CHARS}}}?(?:[.!?]+\s+|\n+|$)|.{{1,{FRAGMENT_CHARS}}}(?:\b|$)|.{{1,{FRAGMENT_CHARS}}}"


def marked_fragments(field: Column, text: str) -> Column:
    """Up to three passages that have a match, with the matching words marked.

    Passages are sentences, longer ones broken between words after 150 characters.  Those with most different words of the query
    are chosen, of equal ones the earlier, and shown in their order.
    """
    pieces = F.regexp_extract_all(F.coalesce(field, F.lit("")), F.lit(SENTENCE), 0)
    words = query_words(text)

    def hit(t: Column) -> Column:
        out = F.lit(False)
        for w in words:
            out = out | word_matches(F.lower(t), w)
        return out

    def score(said: Column) -> Column:
        out = F.lit(0)
        for w in words:
            out = out + some_match(said, w).cast("int")
        return out

    def mark(piece: Column) -> Column:
        words, gaps = F.regexp_extract_all(piece, F.lit(TOKEN), 0), F.split(piece, TOKEN)
        shown = F.transform(words, lambda t: F.when(hit(t), F.concat(F.lit(PRE), t, F.lit(POST))).otherwise(t))
        # one gap more than words; both arrays are made once a passage
        return F.array_join(F.zip_with(gaps, shown, lambda g, t: F.concat(g, F.coalesce(t, F.lit("")))), "")

    told = F.transform(pieces, lambda p, i: F.struct(i.alias("i"), p.alias("piece"), F.regexp_extract_all(F.lower(p), F.lit(TOKEN), 0).alias("said")))
    scored = F.filter(F.transform(told, lambda s: F.struct((-score(s["said"])).alias("order"), s["i"].alias("i"), s["piece"].alias("piece"))), lambda s: s["order"] < 0)
    best = F.transform(F.slice(F.array_sort(scored), 1, FRAGMENTS), lambda s: F.struct(s["i"].alias("i"), s["piece"].alias("piece")))
    return F.transform(F.array_sort(best), lambda s: mark(s["piece"]))


def highlights(entries: DataFrame, q: LogQuery) -> DataFrame:
    """id and highlights, a map of field to fragments, of the entries that have any."""
    if not (q.highlight and q.search_text):
        return entries.select("id", F.lit(None).cast("map<string,array<string>>").alias("highlights")).limit(0)
    fields = [f for f in q.effective_search_fields if f in TEXTS]
    found = F.map_from_arrays(F.array(*[F.lit(f) for f in fields]), F.array(*[marked_fragments(F.col(f), q.search_text) for f in fields]))
    # A row's passages are found once: they are the rows that `inline` makes, none or one, not a column that a filter and those who read
    # it each compute anew.
    marked = F.map_filter(found, lambda k, v: F.size(v) > 0)
    return entries.select("id", F.inline(F.filter(F.array(F.struct(marked.alias("highlights"))), lambda s: F.size(s["highlights"]) > 0)))
