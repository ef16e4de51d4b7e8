"""Licence scan with a positional rare-token index (operator 3).

Templates are short licence texts with one mandatory key phrase each. A first
pass counts, over all documents, how many hold each template word; each
template's posting is its highest-IDF key word with its relative position.
The second pass looks up the words of a file that are such postings, turns
each into the place where its template would stand, intersects with the
template's second-rarest word by relative position, and verifies the whole
key phrase there. The score of a place is the share of the template's words
that stand at their relative positions.

DataFrame functions only; both passes are maps over the documents, and the
only shuffle carries one row per template word and task. The choice of the
rarest words decides cost alone: a verified place does not depend on it.

Defined results: a null text counts as empty (no words, no labels, score 0,
null places); repeated rows each get their own equal row; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Label, licence text, and the key phrase that must stand whole.
BASE = (
    ("cc-by", "cc by", "cc by"),
    ("gpl", "general public license", "general public license"),
    ("reserved", "all rights reserved", "all rights reserved"),
)
TEMPLATES = (
    ("agpl", "this program is licensed under the gnu affero general public license", "gnu affero general public license"),
    ("apache-2.0", "licensed under the apache license version 2.0", "apache license version 2.0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted",
     "redistribution and use in source and binary forms"),
    ("bsd", "licensed under the bsd license", "bsd license"),
    ("cc-by-4.0", "licensed under cc by 4.0", "cc by 4.0"),
    ("cc-by-4.0", "licensed under the creative commons attribution 4.0 international license", "creative commons attribution 4.0"),
    ("cc-by-nc-4.0", "licensed under cc by-nc 4.0", "cc by-nc 4.0"),
    ("cc-by-sa-4.0", "licensed under cc by-sa 4.0", "cc by-sa 4.0"),
    ("cc0", "released under cc0 1.0 universal", "cc0 1.0"),
    ("copyright", "copyright all rights reserved by the author", "copyright all rights reserved"),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
     "permission to use copy modify and or distribute this software"),
    ("lgpl", "this library is licensed under the gnu lesser general public license", "gnu lesser general public license"),
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software",
     "permission is hereby granted free of charge"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2.0", "mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
)

SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def template_rows() -> list[tuple[str, list[str], int, list[str], bool]]:
    """(label, words, key position, key words, is base) of every template."""
    out = []
    for base, group in ((True, BASE), (False, TEMPLATES)):
        for label, text, key in group:
            w, k = re.findall("[a-z0-9]+", text), re.findall("[a-z0-9]+", key)
            at = next(i for i in range(len(w)) if w[i:i + len(k)] == k)
            out.append((label, w, at, k, base))
    return out


def words_of(text: Column) -> Column:
    """Words as written; the empty strings at the ends of a split go."""
    parts = F.split(F.coalesce(text, F.lit("")), SEPARATORS)
    first = F.when(F.element_at(parts, 1) == "", 2).otherwise(1)
    last = F.when(F.element_at(parts, -1) == "", 1).otherwise(0)
    return F.slice(parts, first, F.greatest(F.lit(0), F.size(parts) - last - first + 1))


def word_idf(docs: DataFrame, vocabulary: list[str]) -> dict[str, float]:
    """IDF of the given words over all documents: a pass that sends one row
    per word and task."""
    vocab = F.array(*map(F.lit, vocabulary))
    seen = docs.select(F.array_intersect(F.split(F.lower(F.coalesce("text", F.lit(""))), SEPARATORS), vocab).alias("w"))
    counts = seen.select(F.explode(F.array_append("w", F.lit(""))).alias("word")).groupBy("word").count().collect()
    n = {r.word: r["count"] for r in counts}  # at most one row per vocabulary word, and "" for all documents
    return {w: math.log((1 + n.get("", 0)) / (1 + n.get(w, 0))) for w in vocabulary}


def _postings(idf: dict[str, float]):
    """word -> [(template, its position in the key)] for each template's
    rarest key word, and every template as a literal struct."""
    index: dict[str, list] = {}
    structs = []
    for t, (label, words, at, key, base) in enumerate(template_rows()):
        by_idf = sorted(range(len(key)), key=lambda i: (-idf[key[i]], i))
        rare, second = by_idf[0], by_idf[1]
        index.setdefault(key[rare], []).append((t, rare))
        structs.append(F.struct(
            F.lit(label).alias("label"), F.array(*map(F.lit, words)).alias("words"), F.lit(at).alias("at"),
            F.array(*map(F.lit, key)).alias("key"), F.lit(second).alias("second"), F.lit(key[second]).alias("second_word"),
            F.lit(base).alias("base")))
    return index, F.array(*structs)


def license_scan(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word,
    last_word, base_labels, labels, score, n_places (verified places of the
    method's templates)."""
    vocabulary = sorted({w for r in template_rows() for w in (*r[1], *r[3])})
    index, templates = _postings(word_idf(docs, vocabulary))
    lookup = F.create_map(*[x for word, posts in index.items() for x in (
        F.lit(word), F.array(*[F.struct(F.lit(t).alias("t"), F.lit(i).alias("i")) for t, i in posts]))])

    def plain(word: Column) -> Column:
        return F.translate(word, UPPER, LOWER)

    words = F.col("words")
    rare = F.transform(words, lambda w, i: F.when(F.lower(w).isin(list(index)), i).otherwise(-1))
    places = F.flatten(F.transform("rare", lambda p: F.coalesce(
        F.transform(F.try_element_at(lookup, plain(F.get(words, p))),
                    lambda x: F.struct(F.element_at(templates, x.t + 1).alias("t"), (p - x.i).alias("p"))), F.array())))

    def verified(c: Column) -> Column:
        n = F.size(c.t.key)
        near = (c.p >= 0) & (c.p + n <= F.size(words)) & (plain(F.get(words, c.p + c.t.second)) == c.t.second_word)
        return F.when(near, F.transform(F.slice(words, c.p + 1, n), plain) == c.t.key).otherwise(F.lit(False))

    def share(c: Column) -> Column:
        same = F.filter(c.t.words, lambda w, j: F.coalesce(
            plain(F.get(words, F.when(c.p - c.t["at"] + j >= 0, c.p - c.t["at"] + j))) == w, F.lit(False)))
        return F.size(same) / F.size(c.t.words)

    hits = F.transform(F.filter(places, verified), lambda c: F.struct(
        c.p.alias("p"), c.t.label.alias("label"), c.t.base.alias("base"), share(c).alias("share")))
    base = F.filter("hits", lambda h: h.base)
    return (docs.select("doc_id", words_of(F.col("text")).alias("words"))
            .withColumn("rare", F.filter(rare, lambda i: i >= 0))
            .withColumn("hits", hits)
            .select(F.col("doc_id").cast("long").alias("doc_id"), F.size("words").cast("long").alias("n_words"),
                    F.size(base).cast("long").alias("n_base"),
                    F.array_min(F.transform(base, lambda h: h.p)).cast("long").alias("first_word"),
                    F.array_max(F.transform(base, lambda h: h.p)).cast("long").alias("last_word"),
                    F.concat_ws(",", F.sort_array(F.array_distinct(F.transform(base, lambda h: h.label)))).alias("base_labels"),
                    F.concat_ws(",", F.sort_array(F.array_distinct(F.transform("hits", lambda h: h.label)))).alias("labels"),
                    F.coalesce(F.array_max(F.transform("hits", lambda h: h.share)), F.lit(0.0)).alias("score"),
                    F.size(F.filter("hits", lambda h: ~h.base)).cast("long").alias("n_places")))


def oracle() -> str:
    """The same rows in DuckDB: every position of every text is compared with
    every key phrase."""
    def lst(x):
        return "[" + ", ".join(f"'{w}'" for w in x) + "]"
    rows = ",\n    ".join(f"('{label}', {lst(w)}, {at}, {lst(k)}, {str(base).lower()})" for label, w, at, k, base in template_rows())
    return f"""
with t(label, words, lead, k, base) as (values
    {rows}),
d as (select row_number() over () as r, doc_id,
        regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
                           '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents),
p as (select r, w, unnest(range(len(w))) as p from d),
h as (select r, p, label, base,
        len(list_filter(range(len(words)), lambda j: p - lead + j >= 0 and coalesce(w[p - lead + j + 1] = words[j + 1], false)))
          / cast(len(words) as double) as share
      from p join t on w[p + 1] = k[1] and list_slice(w, p + 1, p + len(k)) = k),
g as (select r, count(*) filter (base) as n_base, min(p) filter (base) as first_word, max(p) filter (base) as last_word,
        string_agg(distinct label, ',' order by label) filter (base) as base_labels,
        string_agg(distinct label, ',' order by label) as labels, max(share) as score, count(*) filter (not base) as n_places
      from h group by r)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_base, 0) as n_base, first_word, last_word,
  coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0.0) as score,
  coalesce(n_places, 0) as n_places
from d left join g using (r)"""
