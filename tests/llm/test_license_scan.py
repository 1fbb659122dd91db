import random
import re

import pytest

from logloom.llm.license_scan import TEMPLATES, WORD, scan_licenses, template


def scan(df):
    return {r["doc_id"]: r for r in scan_licenses(df).collect()}


def test_places_labels_and_words(docs):
    rows = scan(
        docs(
            [
                (1, "Released under the MIT License. And UNDER THE MIT-LICENSE, CC BY-NC 4.0"),
                (2, "This work is licensed under the GNU General Public License, version 3."),
                (3, "mit the under license"),
                (4, None),
                (5, ""),
                (6, "under the mit licenseé apache license version 2"),
                (7, "general public license"),
                (8, "license version 2 apache license version 2"),
                (9, "mit license"),
            ]
        )
    )
    assert (rows[1]["n_words"], rows[1]["n_base"], rows[1]["first_word"], rows[1]["last_word"], rows[1]["base_labels"]) == (15, 3, 1, 10, "cc-by-nc,mit")
    assert (rows[2]["n_base"], rows[2]["base_labels"], rows[2]["labels"], rows[2]["score"]) == (0, "", "gpl-3", 1.0)
    assert (rows[3]["n_base"], rows[3]["first_word"], rows[3]["score"]) == (0, None, 0.0)
    assert rows[4]["n_words"] == rows[5]["n_words"] == 0 and rows[5]["labels"] == ""
    assert (rows[6]["base_labels"], rows[6]["first_word"]) == ("apache-2", 4)  # é makes another word
    assert rows[7]["labels"] == "" and rows[9]["labels"] == ""
    assert (rows[8]["n_base"], rows[8]["first_word"]) == (1, 3)


def test_part_of_a_template_scores_less(docs):
    row = scan(docs([(1, "see gnu general public license version 3")]))[1]
    assert row["labels"] == "gpl-3" and row["score"] == pytest.approx(6 / 9)


def test_edges(spark, docs, clashing):
    assert scan_licenses(docs([])).count() == 0
    assert scan_licenses(docs([(None, "under the mit license"), (None, "under the mit license")])).where("n_base = 1").count() == 2
    long = "x " * 50_000 + "under the mit license " * 1000
    row = scan(clashing([(1, long)]))[1]
    assert (row["n_words"], row["n_base"], row["last_word"]) == (54_000, 1000, 50_000 + 999 * 4)


NOTICES = {
    "gpl-2": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-3": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "agpl-3": "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    "mpl-2": "This Source Code Form is subject to the terms of the Mozilla Public\n# License, v. 2.0. If a copy of the MPL was not distributed with this\n# file, You can obtain one at https://example.org/",
    "mit": 'Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the "Software"), to deal',
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    "bsl-1": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",
    "epl-2": "are made available under the terms of the Eclipse Public License 2.0 which",
    "apache-2": 'Licensed under the Apache License, Version 2.0 (the "License");\n you may not use this file except in compliance with the License.\n',
}


def test_real_notices(docs):
    names = sorted(NOTICES)
    rows = scan(docs([(k, "Some text before.\n/* " + NOTICES[n] + " */ and after") for k, n in enumerate(names)]))
    assert {n: rows[k]["labels"] for k, n in enumerate(names)} == {n: n for n in names}


def brute_force(text, min_match=0.6):
    words = re.findall(WORD, "".join(c.lower() if c.isascii() else c for c in text or ""))
    found = []
    for t in TEMPLATES:
        for p in range(len(words)):
            if tuple(words[p : p + t.key_words]) == t.key:
                s = p - t.key_start
                share = sum(0 <= s + j < len(words) and words[s + j] == w for j, w in enumerate(t.words)) / len(t.words)
                if share >= min_match:
                    found.append((s, share, t.label, t.base))
    base = [s for s, _, _, b in found if b]
    return len(words), len(base), min(base, default=None), max(base, default=None), ",".join(sorted({x[2] for x in found if x[3]})), ",".join(sorted({x[2] for x in found})), max((x[1] for x in found), default=0.0)


def test_equals_brute_force(docs):
    r = random.Random(11)
    parts = [" ".join(t.words) for t in TEMPLATES] + [" ".join(t.key) for t in TEMPLATES]

    def text():
        words = " ".join(r.choice(parts) if r.random() < 0.5 else r.choice(["x", "Étude", "the", "license", "GNU", "mİt", "\u212ait", "ß", "public"]) for _ in range(r.randint(0, 6))).split()
        words = [w for w in words if r.random() > 0.03]
        return "".join((w.upper() if r.random() < 0.1 and w.isascii() else w) + r.choice([" ", " ", " ", "-", ", ", "\n"]) for w in words)

    texts = [text() for _ in range(400)] + ["under the \u212a mit license", "cc by nc\u212a cc by nc", None]
    rows = scan(docs(list(enumerate(texts))))
    assert {k: tuple(v)[1:] for k, v in rows.items()} == {k: brute_force(t) for k, t in enumerate(texts)}


def test_a_plan_as_long_for_many_templates(docs):
    many = TEMPLATES + tuple(template(f"own-{k}", f"some own license number {k} of mine", f"license number {k}") for k in range(300))
    nodes = lambda df: df._jdf.queryExecution().analyzed().toString().count("transform(")
    few = scan_licenses(docs([(1, "x")]))
    assert nodes(scan_licenses(docs([(1, "x")]), templates=many)) == nodes(few)
    assert scan_licenses(docs([(1, "Some own license, number 217 of mine")]), templates=many).first()["labels"] == "own-217"
