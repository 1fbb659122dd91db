"""Licence scan over a positional index of rare words; DataFrame functions only.

Each licence template is a run of words, such as a file header, with a mandatory key
phrase inside it.  The templates' index has postings for the words of the key phrases:
word -> (template, offset).  The scan goes in two steps:

1. Every file is split into words once.  Which licence words it has is kept, and its
   words only if some key phrase can stand in it, that is if it has all words of one.
2. How many files have a licence word gives its inverse document frequency.  Of each
   key phrase that can stand in a file, the file's word with the highest one is looked
   up (of equally rare words the smallest): its places propose starts of templates by
   the postings' offsets.  A start counts when the whole key phrase stands there and,
   intersecting by relative position, at least `min_match` of the template's words do.

A key phrase stands nowhere without its rarest word, so no start is lost.  Everything
about a file is decided within its row, so the files are never shuffled; only the
counts of the licence words are, some dozen rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Words after lower-casing: digits, a-z and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The only character beyond ASCII that `lower` turns into an ASCII letter alone, and another that it leaves as it is.
KELVIN, OTHER = "\u212a", "\u00e9"


class Template(NamedTuple):
    label: str
    words: tuple[str, ...]
    key_start: int
    key_words: int
    base: bool

    @property
    def key(self) -> tuple[str, ...]:
        return self.words[self.key_start : self.key_start + self.key_words]


def template(label: str, text: str, key: str | None = None, base: bool = False) -> Template:
    """`text` and `key` in lower-case ASCII words; the whole text is the key phrase if none is given."""
    words, phrase = tuple(text.split()), tuple((key or text).split())
    start = next(i for i in range(len(words)) if words[i : i + len(phrase)] == phrase)
    return Template(label, words, start, len(phrase), base)


#: Phrases whose every place is counted, then notices and headers as the licences' publishers word them.
TEMPLATES = (
    template("mit", "under the mit license", base=True),
    template("apache-2", "apache license version 2", base=True),
    template("cc-by-nc", "cc by nc", base=True),
    template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software"
        " to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense"
        " and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    ),
    template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    template(
        "apache-2",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"
        " you may obtain a copy of the license at http www apache org licenses license 2 0",
        "apache license version 2 0",
    ),
    template("gpl-3", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    template("gpl-2", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    template(
        "gpl-3",
        "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"
        " either version 3 of the license or at your option any later version",
        "gnu general public license as published by the free software foundation either version 3",
    ),
    template(
        "gpl-2",
        "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"
        " either version 2 of the license or at your option any later version",
        "gnu general public license as published by the free software foundation either version 2",
    ),
    template("lgpl", "under the terms of the gnu lesser general public license", "gnu lesser general public license"),
    template(
        "lgpl",
        "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
        "gnu lesser general public license as published by the free software foundation",
    ),
    template("agpl-3", "licensed under the gnu affero general public license version 3", "gnu affero general public license"),
    template(
        "agpl-3",
        "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation",
        "gnu affero general public license as published by the free software foundation",
    ),
    template("mpl-2", "subject to the terms of the mozilla public license version 2 0", "mozilla public license version 2"),
    template(
        "mpl-2",
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file"
        " you can obtain one at",
        "mozilla public license v 2 0",
    ),
    template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"
        " 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        "redistributions of source code must retain the above copyright notice",
    ),
    template("isc", "permission to use copy modify and or distribute this software for any purpose", "permission to use copy modify and or distribute"),
    template(
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages"
        " arising from the use of this software permission is granted to anyone to use this software for any purpose",
        "in no event will the authors be held liable for any damages arising from the use of this software",
    ),
    template(
        "bsl-1",
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation",
        "to any person or organization obtaining a copy of the software and accompanying documentation",
    ),
    template("epl-2", "made available under the terms of the eclipse public license 2 0", "eclipse public license 2 0"),
    template("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    template("cc0", "cc0 1 0 universal public domain dedication", "cc0 1 0 universal"),
    template("cc-by-sa", "licensed under cc by sa", "cc by sa"),
    template("cc-by-sa", "creative commons attribution sharealike", "creative commons attribution sharealike"),
)
MATCHES = "array<struct<at:int,share:double,label:string,base:boolean>>"


def _literal(value, ddl: str) -> Column:
    """A nested constant, however large, as one literal of the plan."""
    return F.from_json(F.lit(json.dumps({"v": value})), f"struct<v:{ddl}>")["v"]


def words_of(text: Column) -> Column:
    """The words of a text after lower-casing A-Z; null counts as empty.  Other capitals are lower-cased too, which
    changes neither where words end nor whether one equals a word of ASCII."""
    plain = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit(KELVIN), F.lit(OTHER)))
    return F.regexp_extract_all(plain, F.lit(WORD), 0)


def file_counts(files: DataFrame) -> dict[str, int]:
    """How many files have each licence word, from their lists `found`; a row for each licence word at most."""
    return {r["word"]: r["count"] for r in files.select(F.explode("found").alias("word")).groupBy("word").count().collect()}


def template_index(templates: Iterable[Template], counts: dict[str, int]) -> dict[str, list[dict]]:
    """Postings of each key phrase under its rarest word."""
    index: dict[str, list[dict]] = {}
    for k, t in enumerate(templates):
        word = min(t.key, key=lambda w: (counts.get(w, 0), w))
        index.setdefault(word, []).append({"t": k, "offset": t.key_start + t.key.index(word)})
    return index


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[Template, ...] = TEMPLATES, min_match: float = 0.6) -> DataFrame:
    """One row per row of `df`: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts every place of a base phrase, overlapping ones too; first_word and
    last_word are the smallest and largest start of one, in words from 0, or null.
    labels has the base labels and those that the other templates add.  score is the
    largest share of a template's words that stand at their relative positions
    around a verified key phrase, 0 if there is none.  A null or empty text has no
    words and no labels; repeated rows each get the same answer; other columns are
    not looked at.  An empty table gives an empty result.
    """
    keys = sorted({tuple(sorted(set(t.key))) for t in templates})
    vocabulary = _literal(sorted({w for k in keys for w in k}), "array<string>")
    rows = df.select(F.col(id_col).alias("_id"), words_of(F.col(text_col)).alias("words"))
    rows = rows.select("_id", F.size("words").cast("long").alias("n_words"), F.array_intersect("words", vocabulary).alias("found"), "words")
    able = F.exists(_literal(keys, "array<array<string>>"), lambda key: F.size(F.array_except(key, "found")) == 0)
    files = written(rows.select("_id", "n_words", "found", F.when(able, F.col("words")).alias("words")), "licence-words")

    index = template_index(templates, file_counts(files))
    entries = F.array_intersect("found", _literal(sorted(index), "array<string>"))
    postings = _literal(index, "map<string,array<struct<t:int,offset:int>>>")
    known = _literal([{"label": t.label, "words": t.words, "key": t.key, "key_start": t.key_start, "base": t.base} for t in templates], "array<struct<label:string,words:array<string>,key:array<string>,key_start:int,base:boolean>>")

    places = F.filter(F.transform("words", lambda w, i: F.when(F.array_contains("entries", w), F.struct(w.alias("word"), i.alias("at")))), lambda p: p.isNotNull())
    starts = F.flatten(F.transform(places, lambda p: F.transform(F.element_at(postings, p["word"]), lambda o: F.struct((p["at"] - o["offset"]).alias("at"), F.get(known, o["t"]).alias("of")))))
    key_at = lambda s: s["at"] + s["of"]["key_start"]
    verified = F.filter(starts, lambda s: (key_at(s) >= 0) & (F.slice("words", F.greatest(key_at(s), F.lit(0)) + 1, F.size(s["of"]["key"])) == s["of"]["key"]))
    standing = lambda s: F.size(F.filter(s["of"]["words"], lambda w, j: F.coalesce(F.get("words", s["at"] + j) == w, F.lit(False))))
    scored = F.transform(verified, lambda s: F.struct(s["at"].alias("at"), (standing(s) / F.size(s["of"]["words"])).alias("share"), s["of"]["label"].alias("label"), s["of"]["base"].alias("base")))
    matches = F.when(F.col("words").isNotNull() & (F.size("entries") > 0), F.filter(scored, lambda m: m["share"] >= min_match)).otherwise(F.array().cast(MATCHES))

    def labels(m: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(m, lambda x: x["label"]))), ",")

    found = files.withColumn("entries", entries).select("_id", "n_words", matches.alias("matches")).withColumn("base", F.filter("matches", lambda m: m["base"]))
    return found.select(
        F.col("_id").alias(id_col),
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda m: m["at"])).cast("long").alias("first_word"),
        F.array_max(F.transform("base", lambda m: m["at"])).cast("long").alias("last_word"),
        labels(F.col("base")).alias("base_labels"),
        labels(F.col("matches")).alias("labels"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["share"])), F.lit(0.0)).alias("score"),
    )


def scan_sql(templates: tuple[Template, ...] = TEMPLATES, min_match: float = 0.6) -> str:
    """The same answer as SQL, which looks at every place; the choice of words to look up doesn't change what is found."""
    strings = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    known = ",\n  ".join(f"('{t.label}', {str(t.base).lower()}, {t.key_start}, {strings(t.key)}, {strings(t.words)})" for t in templates)
    return f"""
WITH t(label, base, key_start, key, known) AS (VALUES
  {known}),
w AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS words FROM documents),
k AS (SELECT r, words, t.*, unnest(list_filter(range(1, len(words) + 1), lambda p: words[p] = key[1] AND list_slice(words, p, p + len(key) - 1) = key)) - key_start AS s
      FROM w JOIN t ON list_has_all(words, key)),
m AS (SELECT r, label, base, s - 1 AS place, len(list_filter(range(1, len(known) + 1), lambda j: s + j - 1 >= 1 AND words[s + j - 1] = known[j])) / len(known)::DOUBLE AS share FROM k),
f AS (SELECT r, count(*) FILTER (WHERE base) AS n_base, min(place) FILTER (WHERE base) AS first_word, max(place) FILTER (WHERE base) AS last_word,
             string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
      FROM m WHERE share >= {min_match} GROUP BY r)
SELECT doc_id, len(words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM w LEFT JOIN f USING (r)"""
