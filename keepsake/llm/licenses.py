"""Licence notices by a positional index of rare words.

Templates are notices, each with the phrases that it must hold, and names of licences, which
are one phrase. A first pass counts in how many files each mandatory word stands. The
two rarest of each template are then looked up in every file: two places that agree on
where the template would start make a candidate, and only at candidates are the
mandatory phrases compared, word for word, at their places in the template. A template that
stands holds its rarest words, so none is missed, and a text of common words
is never compared. Built-in functions only; apart from the word counts nothing is shuffled.

Words are runs of letters, digits and non-ASCII characters; case counts only
outside A-Z. Words between the mandatory phrases of a notice may differ, not their number.

Edge cases. Null or empty text has no words and no labels (empty strings, null
first and last word, score 0). Null ids and repeated rows are judged like any
other row. An empty table gives an empty result. Texts of any length are read whole. Input
columns of any name are allowed beside id and text.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsake.llm.common import Scratch, text_of

#: Phrase and label.
NAMED = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]
_FSF = "you can redistribute it and or modify it under the terms of the gnu {} public license as published by the free software foundation either version {} of the license or at your option any later version"
#: Label, words of the notice, and the phrases that it must hold.
NOTICES = [
    ("agpl-notice", "this program is free software " + _FSF.format("affero general", "3"), ("free software you can redistribute it", "terms of the gnu affero general public license")),
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    ("apache-header", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", ("apache license version 2 0 the license", "you may not use this file except in compliance with the license")),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms", "permitted provided that the following conditions are met")),
    ("bsd-disclaimer", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed", ("provided by the copyright holders and contributors as is", "fitness for a particular purpose are disclaimed")),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    ("cc0-1.0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ("waived all copyright", "related or neighboring rights")),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("general public license version 3",)),
    ("gpl-notice", "this program is free software " + _FSF.format("general", "3"), ("free software you can redistribute it", "terms of the gnu general public license")),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ("distribute this software for any purpose with or without fee", "copyright notice and this permission notice appear in all copies")),
    ("lgpl", "licensed under the terms of the gnu lesser general public license", ("lesser general public license",)),
    ("lgpl-notice", "this library is free software " + _FSF.format("lesser general", "3"), ("free software you can redistribute it", "terms of the gnu lesser general public license")),
    ("mit", "released under the mit license", ("mit license",)),
    ("mit-notice", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ("permission is hereby granted free of charge to any person obtaining a copy", "permission notice shall be included in all copies or substantial portions of the software")),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("subject to the terms of the mozilla public license",)),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software", ("free and unencumbered software released into the public domain", "anyone is free to copy modify publish use compile sell or distribute this software")),
]
#: Rarest words of each template that are looked up, all of which must agree on the start.
AGREEING = 2
#: Words of a notice of at least so many letters are compared for its score.
SCORED = 4
_SHIFT, _OFFSET = 1 << 40, 1 << 30


def phrases_at(text: str, phrases: tuple[str, ...]) -> list[tuple[int, int, str]]:
    """(place in text, number of words, phrase) of each phrase."""
    words = text.split()
    return [(next(k for k in range(len(words)) if words[k : k + len(p.split())] == p.split()), len(p.split()), p) for p in phrases]


#: Of each template: its label, and its mandatory phrases with their places; names of licences first.
TEMPLATES = [(label, phrases_at(p, (p,))) for p, label in NAMED] + [(label, phrases_at(text, phrases)) for label, text, phrases in NOTICES]
#: Of each template: (place, word) of its mandatory words.
MANDATORY = [[(at + j, w) for at, _, p in phrases for j, w in enumerate(p.split())] for _, phrases in TEMPLATES]
NOTICE_SETS = [sorted({w for w in text.split() if len(w) >= SCORED}) for _, text, _ in NOTICES]
_BLANK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _plain(word: Column) -> Column:
    """A word in lower case; null if it has other than ASCII characters, as those of the templates have none."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word))


def _worded(docs: DataFrame, columns: list[str], text_col: str) -> DataFrame:
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"), text_of(text_col).alias("_text"))
    return rows.select("_row", F.array_remove(F.split("_text", _BLANK), "").alias("words"))


def rare_words(docs: DataFrame, text_col: str = "text") -> dict[str, list[tuple[int, int]]]:
    """Postings (template, place) of the rarest mandatory words of each template, by their inverse document frequency."""
    known = sorted({w for of in MANDATORY for _, w in of})
    found = F.array_distinct(F.transform(F.filter("words", lambda w: _plain(w).isin(known)), lambda w: F.lower(w)))
    # one number for each word of the templates
    counts = {r["w"]: r["count"] for r in _worded(docs, [], text_col).select(F.explode(found).alias("w")).groupBy("w").count().collect()}
    total = docs.count()
    idf = {w: round(math.log((total + 1) / (counts.get(w, 0) + 1)), 6) for w in known}
    rare: dict[str, list[tuple[int, int]]] = {}
    for t, of in enumerate(MANDATORY):
        for at, w in sorted(of, key=lambda x: (-idf[x[1]], x[1], x[0]))[:AGREEING]:
            rare.setdefault(w, []).append((t, at))
    return rare


def matches(docs: DataFrame, columns: list[str], text_col: str, rare: dict[str, list[tuple[int, int]]]) -> DataFrame:
    """(_row, words, candidates, found) of each document; the last two are (template, start) numbers, template * SHIFT + OFFSET + start."""
    rows = _worded(docs, columns, text_col)
    words = F.col("words")
    places = F.when(F.size(words) > 0, F.sequence(F.lit(0), F.size(words) - 1)).otherwise(F.array().cast("array<int>"))
    known = F.filter(places, lambda i: _plain(words[i]).isin(sorted(rare)))
    # word -> template * SHIFT + OFFSET - place, so that adding a word's place gives one number for (template, start)
    table = F.create_map(*[x for w, ps in sorted(rare.items()) for x in (F.lit(w), F.array(*[F.lit(t * _SHIFT + _OFFSET - at).cast("long") for t, at in ps]))])
    votes = F.sort_array(F.flatten(F.transform(known, lambda i: F.transform(table[F.lower(words[i])], lambda p: p + i))))
    rows = rows.withColumn("votes", votes)
    near = F.col("votes")
    # after sorting, a number that is given n times equals the one n - 1 places on
    rows = rows.withColumn("candidates", F.array_distinct(F.filter(near, lambda x, j: F.coalesce(F.get(near, j + AGREEING - 1) == x, F.lit(False))))).drop("votes")
    phrases = F.array(*[F.array(*[F.struct(F.lit(at).alias("at"), F.lit(n).alias("n"), F.lit(p).alias("p")) for at, n, p in of]) for _, of in TEMPLATES])

    def stands(x: Column) -> Column:
        start = F.pmod(x, F.lit(_SHIFT)) - _OFFSET
        there = lambda p: F.array_join(F.slice(words, (start + p["at"]).cast("int") + 1, p["n"]), " ")
        return F.forall(F.get(phrases, F.floor(x / _SHIFT).cast("int")), lambda p: F.when(start + p["at"] >= 0, F.coalesce(_plain(there(p)) == p["p"], F.lit(False))).otherwise(False))

    return rows.withColumn("found", F.filter("candidates", stands))


def scan(docs: DataFrame, columns: list[str], text_col: str = "text") -> DataFrame:
    """(_row, n_words, n_base, first_word, last_word, base_labels, labels, score) for each document."""
    rows = matches(docs, columns, text_col, rare_words(docs, text_col))
    names, sets = F.array(*[F.lit(label) for label, _ in TEMPLATES]), F.array(*[F.array(*map(F.lit, s)) for s in NOTICE_SETS])
    template = lambda x: F.floor(x / _SHIFT).cast("int")
    places = F.transform(F.filter("found", lambda x: x < len(NAMED) * _SHIFT), lambda x: F.pmod(x, F.lit(_SHIFT)) - _OFFSET)
    rows = rows.select("_row", F.size("words").cast("long").alias("n_words"), places.alias("places"), F.array_distinct(F.transform("found", template)).alias("t"), F.when(F.size("found") > 0, F.array_distinct(F.transform("words", _plain))).alias("w"))
    base = F.transform(F.filter("t", lambda t: t < len(NAMED)), lambda t: names[t])
    notices = F.filter("t", lambda t: t >= len(NAMED))
    shares = F.transform(notices, lambda t: F.size(F.array_intersect(F.get(sets, t - len(NAMED)), F.col("w"))) / F.size(F.get(sets, t - len(NAMED))))
    n_base = F.size("places").cast("long")
    found = rows.select(
        "_row",
        "n_words",
        n_base.alias("n_base"),
        F.array_min("places").alias("first_word"),
        F.array_max("places").alias("last_word"),
        F.array_join(F.sort_array(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_distinct(F.transform("t", lambda t: names[t]))), ",").alias("labels"),
        F.round(F.greatest(F.when(n_base > 0, 0.5).otherwise(0.0), F.coalesce(F.array_max(shares), F.lit(0.0))), 6).alias("score"),
    )
    with Scratch(docs.sparkSession) as tmp:
        return tmp.result(found, "licences")


def oracle(table: str = "documents") -> str:
    """The result in DuckDB SQL by its definition: a template holds where all its mandatory words stand at their places, looked up in no index."""
    quoted = lambda s: "'" + s + "'"
    values = lambda rows: "(VALUES " + ", ".join("(" + ", ".join(quoted(x) if isinstance(x, str) else str(x) for x in r) + ")" for r in rows) + ")"
    keys = [(t, at, w, len(of)) for t, of in enumerate(MANDATORY) for at, w in of]
    notice = [(t + len(NAMED), w) for t, s in enumerate(NOTICE_SETS) for w in s]
    names = [(t, label, len(NOTICE_SETS[t - len(NAMED)]) if t >= len(NAMED) else 0) for t, (label, _) in enumerate(TEMPLATES)]
    return rf"""
WITH lowered AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM {table}),
words AS (SELECT doc_id, unnest(words) AS w, unnest(range(len(words))) AS i FROM lowered),
keys(t, j, w, n) AS {values(keys)},
notice(t, w) AS {values(notice)},
names(t, label, n) AS {values(names)},
found AS (SELECT doc_id, t, i - j AS i FROM words JOIN keys USING (w) GROUP BY doc_id, t, i - j, n HAVING count(*) = n),
holds AS (SELECT DISTINCT doc_id, t FROM found),
shares AS (SELECT doc_id, t, count(DISTINCT w) / any_value(names.n) AS share FROM holds JOIN names USING (t) JOIN notice USING (t) JOIN words USING (doc_id, w) GROUP BY doc_id, t),
base AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM found JOIN names USING (t) WHERE t < {len(NAMED)} GROUP BY doc_id),
labels AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM holds JOIN names USING (t) GROUP BY doc_id)
SELECT doc_id, len(words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  round(greatest(CASE WHEN n_base > 0 THEN 0.5 ELSE 0.0 END, coalesce((SELECT max(share) FROM shares s WHERE s.doc_id = l.doc_id), 0.0)), 6) AS score
FROM lowered l LEFT JOIN base USING (doc_id) LEFT JOIN labels USING (doc_id)
"""
