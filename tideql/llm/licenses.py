"""License scans by an exact set-similarity join, with DataFrame functions only.

A text's blocks for a template are runs of words, ``SPREAD`` times as many as the
template has, one at every word of the text; a template matches a block that holds
``PERCENT`` of the template's distinct words or more.  (The best block starts at a
word of the template, so only those are formed.)  All words of the templates are
ordered by the number of documents that have them, rarest first.  The join goes
from the words of a text to the templates in whose prefix they stand: the rarest
words of a template, as many as any match must have one of.  A template met so is
compared with its blocks past three filters: length (text and block have enough
template words), prefix (the rarest words of block and template have one in
common), and position (past the first common word, both have enough words left).
What passes is counted in full, so the join is exact.

The templates are one literal of the plan, so that neither their number changes the
plan nor is anything shuffled: the join takes place where a document is read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .wordlists import SQL_WORDS, listed, normal

SPREAD, PERCENT = 2, 80

#: The phrases of the base rule.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Wording of public licenses, notices and whole grants.
TEMPLATES = [
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
]


def _words(text: str) -> list[str]:
    return re.findall("[0-9a-z\x80-\U0010ffff]+", text.lower())


def template_sets(templates=TEMPLATES, spread: int = SPREAD) -> list[tuple[str, list[str], int]]:
    """Each template's label, distinct words, and the length of the blocks that it is compared with."""
    return [(label, list(dict.fromkeys(_words(t))), spread * len(_words(t))) for label, t in templates]


def _needed(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def _array(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def word_order(words: DataFrame, vocabulary: list[str]) -> list[str]:
    """The templates' words by the number of documents in which they are found, rarest first; as many as the templates have."""
    counts = words.select(F.explode(F.array_intersect(_array(vocabulary), F.col("w"))).alias("x")).groupBy("x").count()
    n = {r.x: r["count"] for r in counts.collect()}
    return sorted(vocabulary, key=lambda w: (n.get(w, 0), w))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _share(w: Column, t: Column) -> Column:
    """The largest part of template ``t`` that a block of the words ``w`` has, if it is enough; else 0."""
    n, need, whole = F.size(t["words"]), t["need"], t["words"]

    def block(start: Column) -> Column:
        # In the order of all templates' words: the template's are found in their own order, rarest first.
        return _let(F.array_intersect(whole, F.slice(w, start + 1, t["block"])), counted)

    def counted(b: Column) -> Column:
        first = F.get(F.array_intersect(F.slice(whole, 1, n - need + 1), F.slice(b, 1, F.size(b) - need + 1)), F.lit(0))
        left = 1 + F.least(n - F.array_position(whole, first), F.size(b) - F.array_position(b, first))
        return F.when(F.size(b) < need, 0).when(F.coalesce(left, F.lit(0)) < need, 0).otherwise(F.size(b))

    starts = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: F.array_contains(whole, F.get(w, i)))
    best = F.coalesce(F.array_max(F.transform(starts, block)), F.lit(0))
    return F.when(F.size(F.array_intersect(whole, w)) >= need, F.when(best >= need, best / n.cast("double"))).otherwise(None)


def _literal(sets: list[tuple[str, list[str], int]], percent: int) -> Column:
    rows = [F.struct(F.lit(label).alias("label"), _array(t).alias("words"), F.lit(_needed(len(t), percent)).alias("need"), F.lit(block).alias("block")) for label, t, block in sets]
    return F.array(*rows)


def scan(df: DataFrame, text: str = "text", doc_id: str = "doc_id", templates=TEMPLATES, percent: int = PERCENT) -> DataFrame:
    """For each row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``score`` is 1 where a phrase stands, else the largest part of a template that a block of the
    text has, if it is ``percent`` or more; else 0.  Null and wordless texts have no words and no
    labels.  Rows are judged one by one, so repeated rows, null ids and an empty table need no
    rule; other columns are not looked at.
    """
    sets = template_sets(templates)
    docs = df.select(F.col(doc_id).alias("id"), normal(F.col(text)).alias("norm"))
    words = docs.select("id", "norm", listed(F.col("norm")).alias("w"))
    order = word_order(words, sorted({w for _, t, _ in sets for w in t}))
    rank = {w: i for i, w in enumerate(order)}
    sets = [(label, sorted(t, key=rank.__getitem__), block) for label, t, block in sets]
    # The join's index: from a word to the templates in whose prefix it stands.
    index: dict[str, list[int]] = {}
    for i, (_, t, _) in enumerate(sets):
        for w in t[: len(t) - _needed(len(t), percent) + 1]:
            index.setdefault(w, []).append(i)

    padded = F.concat(F.lit(" "), F.col("norm"), F.lit(" "))
    has = {p: F.contains(padded, F.lit(f" {p} ")) for p in PHRASES}
    some = None
    for c in has.values():
        some = c if some is None else some | c

    def at(phrase: str) -> Column:
        parts = phrase.split(" ")

        def stands(i: Column) -> Column:
            ok = F.get("w", i) == parts[0]
            for k, p in enumerate(parts[1:], 1):
                ok = ok & (F.get("w", i + k) == p)
            return F.coalesce(ok, F.lit(False))

        return F.filter(F.sequence(F.lit(0), F.size("w") - 1), stands)

    none = F.array().cast("array<int>")
    places = F.when(some, F.flatten(F.array(*[F.when(c, at(p)).otherwise(none) for p, c in has.items()]))).otherwise(none)
    base = F.array_compact(F.array(*[F.when(has[p], F.lit(label)) for p, label in PHRASES.items()]))
    met = F.array_intersect(_array(list(index)), F.col("w"))
    lists = F.array(*[F.array(*map(F.lit, x)) for x in index.values()])
    candidates = F.array_distinct(F.flatten(F.transform(met, lambda x: F.get(lists, (F.array_position(_array(list(index)), x) - 1).cast("int")))))
    shares = F.transform(candidates, lambda i: _let(F.get(_literal(sets, percent), i), lambda t: F.struct(t["label"].alias("label"), _share(F.col("w"), t).alias("share"))))
    out = words.select("id", F.size("w").alias("n"), places.alias("places"), base.alias("base"), F.filter(shares, lambda s: s["share"].isNotNull()).alias("found"))
    added = F.transform("found", lambda s: s["label"])
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    return out.select(
        F.col("id").alias(doc_id),
        F.col("n").cast("long").alias("n_words"),
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"),
        F.array_max("places").cast("long").alias("last_word"),
        joined(F.col("base")).alias("base_labels"),
        joined(F.concat("base", added)).alias("labels"),
        F.greatest(F.when(F.size("places") > 0, 1.0).otherwise(0.0), F.coalesce(F.array_max(F.transform("found", lambda s: s["share"])), F.lit(0.0))).alias("score"),
    )


def op7(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql() -> str:
    phrases = ", ".join(f"('{p}', '{label}', {len(p.split())})" for p, label in PHRASES.items())
    rows = ", ".join(f"('{label}', {t!r}, {_needed(len(t), PERCENT)}, {block})" for label, t, block in template_sets())
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, l FROM (SELECT doc_id, {SQL_WORDS} AS l FROM documents)),
ph AS (SELECT * FROM (VALUES {phrases}) v(p, label, k)),
pl AS (SELECT r, label, i - 1 AS i FROM (SELECT r, l, unnest(range(1, len(l) + 1)) AS i FROM d), ph WHERE array_to_string(l[i : i + k - 1], ' ') = p),
b AS (SELECT r, count(*) AS n, min(i) AS a, max(i) AS z FROM pl GROUP BY r),
te AS (SELECT * FROM (VALUES {rows}) v(label, t, need, size)),
c AS (SELECT r, l, label, t, need, size FROM d, te WHERE len(list_intersect(t, l)) >= need),
m AS (SELECT r, label, n::DOUBLE / k AS s FROM (SELECT r, label, need, len(t) AS k, len(list_intersect(t, l[i : i + size - 1])) AS n FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM c)) WHERE n >= need),
la AS (SELECT r, label, true AS base, 1.0::DOUBLE AS s FROM pl UNION ALL SELECT r, label, false, s FROM m),
s AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS bs, string_agg(DISTINCT label, ',' ORDER BY label) AS ls, max(s) AS s FROM la GROUP BY r)
SELECT doc_id, len(l)::BIGINT AS n_words, coalesce(b.n, 0)::BIGINT AS n_base, b.a::BIGINT AS first_word, b.z::BIGINT AS last_word,
  coalesce(bs, '') AS base_labels, coalesce(ls, '') AS labels, coalesce(s.s, 0)::DOUBLE AS score
FROM d LEFT JOIN b USING (r) LEFT JOIN s USING (r)
"""


SQL7 = _sql()
