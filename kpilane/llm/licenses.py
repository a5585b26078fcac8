"""Licence scan by a positional index of rare words; DataFrame functions only.

Templates are short licence notices. Each is posted in the index under the word of its
key phrase that is rarest in the corpus (highest inverse document frequency,
counted over all documents). One pass over a file's words keeps the postings (word, position) of
those words, few or none in most files; each posting fixes where the templates under its word would
start. There a template's
other words are intersected by relative position, and the place counts if the
whole key phrase stands there and at least ``MIN_SHARE`` of the template's words do.

Three templates are base phrases, whose key phrase is all of them: every place
where their words stand consecutively is found, since every such place holds the word
they are posted under. The other templates add labels.

All of it happens within the row: no join and no grouping but the count of document
frequencies (one row per template word and task), whose result, a number per
template word, is the only thing that reaches the driver.

Defined results: null and empty texts have no words, no places, empty labels and
score 0; repeated rows are scanned each on their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kpilane.llm.common import ascii_lower

SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
MIN_SHARE = 0.6

# label, template, key phrase: fixed values
BASE = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]
TEMPLATES = [
    ("agpl-3", "licensed under the gnu affero general public license version 3", "gnu affero general public license"),
    ("apache-2", "you may not use this file except in compliance with the license",
     "use this file except in compliance"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted",
     "redistribution and use in source and binary forms"),
    ("cc-by-sa", "licensed under cc by sa", "cc by sa"),
    ("gpl-2", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("gpl-3", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose",
     "permission to use copy modify"),
    ("lgpl", "licensed under the gnu lesser general public license", "gnu lesser general public license"),
    ("mit", "mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software",
     "permission is hereby granted free of charge"),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain",
     "free and unencumbered software"),
]


def templates() -> list[tuple[str, list[str], int, list[str], bool]]:
    """(label, words, where the key phrase starts, its words, is a base phrase)."""
    rows = [(label, phrase, phrase, True) for label, phrase in BASE] + [(*t, False) for t in TEMPLATES]
    out = []
    for label, template, key, base in rows:
        words, key_words = template.split(), key.split()
        at = next(i for i in range(len(words)) if words[i:i + len(key_words)] == key_words)
        out.append((label, words, at, key_words, base))
    return out


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), SEPARATOR), "")


def document_frequencies(words: DataFrame) -> dict[str, int]:
    """In how many documents each template word stands; one number per template word."""
    vocabulary = sorted({w for _, _, _, key, _ in templates() for w in key})
    counted = (words.select(F.explode(F.array_intersect(F.array(*map(F.lit, vocabulary)), "words")).alias("word"))
               .groupBy("word").count().collect())
    return {w: 0 for w in vocabulary} | {r["word"]: r["count"] for r in counted}


def _places(template: list[str], at: int, key: list[str], base: bool, offset: int) -> Column:
    """Where a base phrase starts; of another template the share of its words, for every place."""

    def verified(start: Column) -> Column:
        # a template may start before the text does; its key phrase may not
        return (start >= -at) & (F.slice("words", F.greatest(start + at, F.lit(0)) + 1, len(key))
                                 == F.array(*map(F.lit, key)))

    def share(start: Column) -> Column:
        same = [F.when((start + k >= 0) & (F.get("words", start + k) == w), 1).otherwise(0)
                for k, w in enumerate(template)]
        return sum(same[1:], same[0]) / F.lit(float(len(template)))

    mine = F.filter("postings", lambda p: p["word"] == template[offset])
    starts = F.filter(F.transform(mine, lambda p: p["at"] - offset), verified)
    return starts if base else F.filter(F.transform(starts, share), lambda s: s >= MIN_SHARE)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    words = docs.select(F.col(id_col).cast("long").alias("doc_id"), words_of(F.col(text_col)).alias("words"))
    frequency = document_frequencies(words)
    index = []
    for label, template, at, key, base in templates():
        rarest = min(range(len(key)), key=lambda i: (frequency[key[i]], -len(key[i]), key[i]))
        index.append((label, template, at, key, base, at + rarest))
    posted = sorted({t[offset] for _, t, _, _, _, offset in index}, key=lambda w: (frequency[w], w))
    index_words = F.array(*map(F.lit, posted))
    places = F.transform("words", lambda w, i: F.struct(w.alias("word"), i.alias("at")))
    postings = F.filter(places, lambda p: F.array_contains(index_words, p["word"]))
    found = words.withColumn("postings", F.when(F.arrays_overlap("words", index_words), postings)
                             .otherwise(F.array().cast("array<struct<word:string,at:int>>")))
    columns = [_places(*row[1:]).alias(f"p{n}") for n, row in enumerate(index)]
    found = found.select("doc_id", F.size("words").cast("long").alias("n_words"), *columns)
    base = [n for n, row in enumerate(index) if row[4]]
    places = F.concat(*[F.col(f"p{n}") for n in base])

    def labels(numbers: list[int]) -> Column:
        each = [F.when(F.size(f"p{n}") > 0, F.lit(index[n][0])) for n in numbers]
        return F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*each)))), ",")

    shares = [F.when(F.size(f"p{n}") > 0, F.lit(1.0) if index[n][4] else F.array_max(f"p{n}")).otherwise(F.lit(0.0))
              for n in range(len(index))]
    return found.select("doc_id", "n_words", F.size(places).cast("long").alias("n_base"),
                        F.array_min(places).cast("long").alias("first_word"),
                        F.array_max(places).cast("long").alias("last_word"),
                        labels(base).alias("base_labels"), labels(list(range(len(index)))).alias("labels"),
                        F.greatest(*shares).alias("score"))


# stated apart from BASE, so that a wrong phrase there shows
ORACLE_BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def oracle_sql() -> str:
    """The same scan for DuckDB, trying every place for every template."""
    rows = [(label, phrase.split(), 0, phrase.split(), True) for phrase, label in ORACLE_BASE.items()] \
        + [row for row in templates() if not row[4]]
    columns, share_columns = [], []
    for n, (label, template, at, key, base) in enumerate(rows):
        wanted = "[" + ", ".join(f"'{w}'" for w in key) + "]"
        # i is the place of the key phrase, from 1
        guard = max(key, key=len)
        keyed = (f"list_filter(CASE WHEN list_contains(words, '{guard}') THEN range(1, len(words) + 1) ELSE [] END, "
                 f"lambda i: words[i:i + {len(key) - 1}] = {wanted})")
        if base:
            columns.append(f"list_transform({keyed}, lambda i: i - 1) AS p{n}")
        else:
            same = " + ".join(f"CASE WHEN i + {k - at} >= 1 AND words[i + {k - at}] = '{w}' THEN 1 ELSE 0 END"
                              for k, w in enumerate(template))
            columns.append(f"list_filter(list_transform({keyed}, lambda i: ({same}) / {float(len(template))}::DOUBLE), "
                           f"lambda s: s >= {MIN_SHARE}) AS p{n}")
        share_columns.append(f"CASE WHEN len(p{n}) > 0 THEN {'1.0::DOUBLE' if base else f'list_max(p{n})'} "
                             "ELSE 0.0::DOUBLE END")
    base = [n for n, r in enumerate(rows) if r[4]]

    def labels(numbers: list[int]) -> str:
        each = ", ".join(f"CASE WHEN len(p{n}) > 0 THEN '{rows[n][0]}' END" for n in numbers)
        return f"array_to_string(list_sort(list_distinct([{each}])), ',')"

    places = "list_concat(" * (len(base) - 1) + f"p{base[0]}" + "".join(f", p{n})" for n in base[1:])
    return f"""
WITH words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{SEPARATOR}'), lambda w: w <> '') AS words
  FROM documents),
found AS (SELECT doc_id, len(words) AS n_words, {', '.join(columns)} FROM words)
SELECT doc_id, n_words, len({places})::BIGINT AS n_base, list_min({places})::BIGINT AS first_word,
  list_max({places})::BIGINT AS last_word, {labels(base)} AS base_labels,
  {labels(list(range(len(rows))))} AS labels, greatest({', '.join(share_columns)}) AS score
FROM found"""
