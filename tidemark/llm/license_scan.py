r"""License scans by an exact set-similarity join. DataFrame functions only.

Blocks are lines, and, as notices are wrapped, all runs of as many words as the template
has, across line ends. Both sides are sets of words in one order, by how many documents of
the whole corpus hold a word, rarest first. A block that holds the share t of a
template's words must hold one of the template's first |T| - need + 1 words, need = ceil(t |T|);
those are the index. Candidates pass the length filter (at least `need` words that any
template knows) and the positional filter (what can still follow the common word on
both sides reaches `need`), and are verified by counting. Templates are a short fixed
list, so the index is a constant in the plan and blocks never leave their row.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What separates words, before and after A-Z become lower case.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
# Base phrases with their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
# Well-known license notices, as words in lower case.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("mit-notice", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit-released", "released under the mit license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-4.0", "licensed under cc by 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc0-1.0", "this work has been dedicated to the public domain under cc0 1 0"),
    ("all-rights-reserved", "copyright all rights reserved"),
)
_S = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def words_of(text: str) -> str:
    """SQL: the words in one string, one space between, in the case they have."""
    return f"trim(regexp_replace({text}, {_S(GAP)}, ' '))"


def frequencies(docs: DataFrame, vocabulary: Sequence[str]) -> dict[str, int]:
    """How many documents hold each word of the templates: one row per word reaches the driver. All documents count. docs: ws, the words of each."""
    words = docs.select(F.explode(F.array_intersect("ws", F.array(*map(F.lit, vocabulary)))).alias("word"))
    return {r.word: r.n for r in words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}


class Index:
    """The prefix index of the templates, as SQL constants: words in order, templates, and the entries (template, place) of each index word."""

    def __init__(self, templates: Sequence[tuple[str, str]], threshold: float, freq: dict[str, int]) -> None:
        vocabulary = sorted({w for _, t in templates for w in t.split()}, key=lambda w: (freq.get(w, 0), w))
        at = {w: i for i, w in enumerate(vocabulary)}
        entries: dict[str, list[str]] = {}
        rows = []
        for n, (label, text) in enumerate(templates):
            ws = sorted(set(text.split()), key=at.__getitem__)
            need = math.ceil(threshold * len(ws) - 1e-9)
            rows.append(f"named_struct('label', {_S(label)}, 'words', array({', '.join(map(_S, ws))}), 'need', {need}, 'len', {len(text.split())})")
            for i, w in enumerate(ws[: len(ws) - need + 1]):
                entries.setdefault(w, []).append(f"named_struct('t', {n + 1}, 'i', {i})")
        self.order = f"array({', '.join(map(_S, vocabulary))})"
        self.words = f"array({', '.join(map(_S, entries))})"
        self.probe = f"map({', '.join(f'{_S(w)}, array({", ".join(es)})' for w, es in entries.items())})"
        self.template = f"element_at(array({', '.join(rows)}), e.t)"


def found_in(index: Index) -> str:
    """SQL over `text` and `ws`: array of struct(label, score) of the templates that some line or run of words holds to the threshold."""
    found = f"concat({lines(index)}, {runs(index)})"
    return f"CASE WHEN arrays_overlap(ws, {index.words}) THEN transform({found}, x -> named_struct('label', x.label, 'score', cast(x.n AS double) / x.of)) ELSE cast(array() AS array<struct<label: string, score: double>>) END"


def lines(index: Index) -> str:
    """SQL over `text`: the templates that a line holds. b is a line's set of words, in the common order."""
    t = index.template
    block = f"array_intersect({index.order}, split(lower({words_of('l')}), ' '))"
    blocks = f"filter(transform(split(text, '\n'), l -> {block}), b -> arrays_overlap(b, {index.words}))"
    # index entries of a line's words, filtered by length and by what can still follow on both sides, then verified
    may = f"size(b) >= {t}.need AND least(size({t}.words) - e.i, size(b) - j) >= {t}.need"
    hits = f"array_distinct(flatten(transform(b, (w, j) -> transform(filter(coalesce(element_at({index.probe}, w), array()), e -> {may}), e -> e.t))))"
    scored = f"transform(transform({hits}, x -> named_struct('t', x)), e -> named_struct('label', {t}.label, 'n', size(array_intersect({t}.words, b)), 'need', {t}.need, 'of', size({t}.words)))"
    return f"flatten(transform({blocks}, b -> filter({scored}, x -> x.n >= x.need)))"


def runs(index: Index) -> str:
    """SQL over `ws`: the templates that a run of words holds, each run as long as the template, wherever lines end.

    Such a run has an index word. All runs around it that the template's length allows are first judged as one stretch.
    """
    t = index.template
    start = f"greatest(1, p - {t}.len + 1)"
    stretch = f"size(array_intersect({t}.words, slice(ws, {start}, p - {start} + {t}.len))) >= {t}.need"
    best = f"array_max(transform(sequence({start}, p), s -> size(array_intersect({t}.words, slice(ws, s, {t}.len)))))"
    near = f"transform(filter(element_at({index.probe}, element_at(ws, p)), e -> {stretch}), e -> named_struct('label', {t}.label, 'n', {best}, 'need', {t}.need, 'of', size({t}.words)))"
    places = f"filter(transform(ws, (w, i) -> if(array_contains({index.words}, w), i + 1, 0)), p -> p > 0)"
    return f"filter(flatten(transform({places}, p -> {near})), x -> x.n >= x.need)"


def starts_of(phrase: str) -> str:
    """SQL over `low`, the words in lower case with one space around each: the numbers of the words at which the phrase stands, in order."""
    p, n = _S(f" {phrase} "), len(phrase.split())
    gaps = f"split(low, {_S(f' {phrase}(?= )')}, -1)"
    count = "cast(char_length(g) - char_length(replace(g, ' ', '')) AS bigint)"
    # a gap before a place holds as many spaces as words, as each word has one before it
    state = "struct<pos: bigint, out: array<bigint>>"
    step = f"named_struct('pos', acc.pos + {count} + {n}L, 'out', concat(acc.out, array(acc.pos + {count})))"
    walk = f"aggregate(slice({gaps}, 1, size({gaps}) - 1), cast(named_struct('pos', 0L, 'out', cast(array() AS array<bigint>)) AS {state}), (acc, g) -> cast({step} AS {state}), acc -> acc.out)"
    return f"CASE WHEN contains(low, {p}) THEN {walk} ELSE cast(array() AS array<bigint>) END"


def scan(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    score is 1 for a base phrase, else the largest share of a template's words in one line, or in a run of words as
    long as the template, that reaches the threshold, else 0. Null and empty texts have no words. Each row is judged by itself, so null and repeated
    ids are rows like others. Columns other than doc_id and text are ignored; an empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("words", F.expr(f"lower({words_of('text')})")).withColumn("ws", F.split("words", " "))
    freq = frequencies(docs, sorted({w for _, t in templates for w in t.split()}))
    rows = docs.select("doc_id", F.concat(F.lit(" "), "words", F.lit(" ")).alias("low"), F.when(F.col("words") == "", 0).otherwise(F.size("ws")).cast("long").alias("n_words"), F.expr(found_in(Index(templates, threshold, freq))).alias("found"))
    rows = rows.select("doc_id", "n_words", *[F.expr(starts_of(p)).alias(f"p{i}") for i, (p, _) in enumerate(PHRASES)], "found")
    own = F.array_compact(F.array(*[F.when(F.size(f"p{i}") > 0, F.lit(label)) for i, (_, label) in enumerate(PHRASES)]))
    rows = rows.select("doc_id", "n_words", F.concat(*[f"p{i}" for i in range(len(PHRASES))]).alias("starts"), own.alias("own"), "found")
    labels = F.array_sort(F.array_union("own", F.col("found.label")))
    score = F.when(F.size("own") > 0, 1.0).otherwise(F.coalesce(F.array_max("found.score"), F.lit(0.0)))
    return rows.select("doc_id", "n_words", F.size("starts").cast("long").alias("n_base"), F.array_min("starts").alias("first_word"), F.array_max("starts").alias("last_word"), F.array_join(F.array_sort(F.array_distinct("own")), ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"))


def oracle(templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = 0.8) -> str:
    """The same by comparing each line with each template, and each word position with each phrase; it does not know runs over line ends."""
    split = r"string_split(trim(regexp_replace(regexp_replace(lower({}), '{}', ' ', 'g'), '\x20+', ' ', 'g')), ' ')"
    gap = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    w = split.format("text", gap)
    places = " UNION ALL ".join(f"SELECT doc_id, '{label}' AS label, {i} AS p, unnest(list_filter(range(0, len(w)), lambda i: {' AND '.join(f'''w[i + {k + 1}] = '{x}' ''' for k, x in enumerate(phrase.split()))})) AS s FROM d" for i, (phrase, label) in enumerate(PHRASES))
    values = ", ".join(f"('{label}', ['" + "', '".join(sorted(set(t.split()))) + f"'], {math.ceil(threshold * len(set(t.split())) - 1e-9)})" for label, t in templates)
    return f"""WITH d AS (SELECT doc_id, text, CASE WHEN text IS NULL OR {w} = [''] THEN [] ELSE {w} END AS w FROM documents), b AS ({places}),
g AS (SELECT doc_id, count(*) AS n, min(s) AS first_word, max(s) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base, list(DISTINCT label) AS ls FROM b GROUP BY doc_id),
l AS (SELECT doc_id, {split.format("line", gap)} AS ws FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)),
f AS (SELECT doc_id, label, len(list_intersect(t, ws)) AS n, len(t) AS m FROM l, (VALUES {values}) v(label, t, need) WHERE len(list_intersect(t, ws)) >= need),
k AS (SELECT doc_id, list(DISTINCT label) AS ls, max(n / m) AS score FROM f GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(g.n, 0)::BIGINT AS n_base, first_word, last_word, coalesce(base, '') AS base_labels,
array_to_string(list_sort(list_distinct(list_concat(coalesce(g.ls, []), coalesce(k.ls, [])))), ',') AS labels, CASE WHEN g.n > 0 THEN 1.0 ELSE coalesce(k.score, 0.0) END::DOUBLE AS score FROM d LEFT JOIN g USING (doc_id) LEFT JOIN k USING (doc_id)"""
