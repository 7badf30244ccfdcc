"""Operator 13: license scans by a positional index of rare words, with DataFrame and SQL functions only.

Words are runs of ASCII letters and digits (A-Z lower-cased) and of all characters beyond ASCII. How many documents have
each of the templates' words is counted over the whole corpus. The index holds, for each template, the places of its RARE
words of highest inverse document frequency. Those of them that a file has are looked up; each word at place p of the file
and q of the template says that the template begins at p - q. Where at least LEAST words agree (all, if a template has
fewer), and every mandatory phrase of the template stands within SLACK words of its place there, the template's label is
the file's.

The contract's phrases are found wherever they stand. `score` is the greatest share, by inverse document frequency, of an
accepted template's indexed words that agree on one place; a file with one of the contract's phrases has BASE_SCORE at
least, one without any label 0.

Texts are split where they are; only places of rare words and of phrases move on, as rows, so a very long text is a group
of many rows and no long array, and files without any rare word cost nothing more. Templates and their index are small and
fixed, whatever the corpus. Null and empty texts have no words. Rows that repeat get the same result each, null doc_ids
are kept, extra columns, whatever their names, are ignored, and an empty table gives an empty result. Words that equally
many documents have rank by the alphabet.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table
from .decontamination import words


@dataclass(frozen=True)
class Template:
    """text: words as a text is split into; keys: phrases of it that a file must have."""

    name: str
    label: str
    text: str
    keys: tuple[str, ...]


#: The contract's phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Notices and opening sentences of public licenses, in lower case and without marks.
TEMPLATES = (
    Template("mit-notice", "mit", "released under the mit license", ("mit license",)),
    Template("mit-grant", "mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ("hereby granted free of charge", "to deal in the software without restriction")),
    Template("apache-notice", "apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    Template("apache-terms", "apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ("in compliance with the license", "apache org licenses license 2 0")),
    Template("bsd-terms", "bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("source and binary forms", "with or without modification")),
    Template("isc-grant", "isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee is hereby granted",)),
    Template("gpl-3-notice", "gpl-3.0", "licensed under the gnu general public license version 3", ("gnu general public license", "license version 3")),
    Template("gpl-2-notice", "gpl-2.0", "licensed under the gnu general public license version 2", ("gnu general public license", "license version 2")),
    Template("gpl-terms", "gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("gnu general public license", "free software foundation")),
    Template("lgpl-terms", "lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", ("gnu lesser general public license",)),
    Template("agpl-terms", "agpl", "under the terms of the gnu affero general public license as published by the free software foundation", ("gnu affero general public license",)),
    Template("mpl-notice", "mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Template("cc-by-nc-notice", "cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    Template("cc-by-sa-notice", "cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    Template("cc-by-nd-notice", "cc-by-nd", "licensed under cc by nd 4 0", ("cc by nd",)),
    Template("cc-by-words", "cc-by", "licensed under a creative commons attribution 4 0 international license", ("creative commons attribution",)),
    Template("unlicense-terms", "unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
)
RARE, LEAST, SLACK = 6, 2, 3
BASE_SCORE = 0.5


def _set(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in sorted(values)) + ")"


def frequencies(docs: DataFrame, templates: tuple[Template, ...]) -> tuple[int, dict[str, int]]:
    """How many rows docs (text) has, and how many of them have each of the templates' words: one pass, a row a word to the driver."""
    vocabulary = {w for t in templates for w in t.text.split()}
    seen = docs.select(words(F.col("text")).alias("w")).select(F.explode(F.expr(f"concat(array(''), array_distinct(filter(w, x -> x IN {_set(vocabulary)})))")).alias("word"))
    found = {r.word: r.n for r in seen.groupBy("word").agg(F.count("*").alias("n")).collect()}
    return found.pop("", 0), found


def postings(n: int, frequency: dict[str, int], templates: tuple[Template, ...], rare: int = RARE) -> list[tuple[str, str, int, float]]:
    """(word, template, q, idf) of each template's `rare` words of highest inverse document frequency, at all their places."""
    out = []
    for t in templates:
        own = t.text.split()
        chosen = sorted(set(own), key=lambda w: (frequency.get(w, 0), w))[:rare]
        out += [(w, t.name, q, math.log((n + 1) / (frequency.get(w, 0) + 1)) + 1) for q, w in enumerate(own) if w in chosen]
    return out


def _places(docs: DataFrame, rare: set[str], phrases: set[str]) -> DataFrame:
    """(row, doc_id, n_words, hits, phrases): where rare words and whole phrases stand in each text."""
    firsts = {p.split()[0] for p in phrases}
    by_size = {m: {p for p in phrases if p.count(" ") + 1 == m} for m in sorted({p.count(" ") + 1 for p in phrases})}
    of_size = ", ".join(f"transform(filter(places, i -> array_join(slice(w, i + 1, {m}), ' ') IN {_set(own)}), i -> named_struct('p', i, 'phrase', array_join(slice(w, i + 1, {m}), ' ')))" for m, own in by_size.items())
    rows = docs.select("doc_id", words(F.col("text")).alias("w"))
    rows = rows.withColumn("places", F.expr(f"filter(sequence(0, size(w)), i -> i < size(w) AND w[i] IN {_set(rare | firsts)})"))
    return rows.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.size("w").cast("long").alias("n_words"),
        F.expr(f"transform(filter(places, i -> w[i] IN {_set(rare)}), i -> named_struct('p', i, 'word', w[i]))").alias("hits"), F.expr(f"concat({of_size})").alias("phrases"),
    )


def _literals(spark: SparkSession, rows: list[tuple], names: str) -> DataFrame:
    """A small fixed table within the plan."""
    values = ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else f"{v!r}D" if isinstance(v, float) else str(v) for v in r) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({names})")


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) for each row of docs (doc_id, text)."""
    spark = docs.sparkSession
    index = postings(*frequencies(docs, templates), templates)
    keys = [(t.name, k, t.text.split(f" {k}")[0].count(" ") + 1 if not t.text.startswith(k) else 0) for t in templates for k in t.keys]
    totals: dict[str, list] = {}
    for _, name, _, idf in index:
        totals.setdefault(name, []).append(idf)
    found = stored(_places(docs, {w for w, *_ in index}, {*BASE, *(k for _, k, _ in keys)}), "places")

    offers = _literals(spark, [(*p, min(LEAST, len(totals[p[1]])), sum(totals[p[1]])) for p in index], "word, template, q, idf, least, total")
    hits = found.filter("size(hits) > 0").select("row", F.explode("hits").alias("x")).select("row", "x.p", "x.word").join(F.broadcast(offers), "word")
    begins = hits.groupBy("row", "template", (F.col("p") - F.col("q")).alias("d"), "least", "total").agg(F.count("*").alias("k"), F.sum("idf").alias("agreed")).filter("k >= least")
    begins = begins.select("row", "template", "d", F.least(F.lit(1.0), F.round(F.col("agreed") / F.col("total"), 6)).alias("share"))
    # Every place where a key may stand, so that places meet by equality.
    wanted = begins.join(F.broadcast(_literals(spark, keys, "template, phrase, o")), "template").select("row", "template", "d", "share", "phrase", F.explode(F.expr(f"sequence(d + o - {SLACK}, d + o + {SLACK})")).alias("p"))
    there = found.filter("size(phrases) > 0").select("row", F.explode("phrases").alias("x")).select("row", "x.p", "x.phrase")
    names = _literals(spark, [(t.name, t.label, len(t.keys)) for t in templates], "template, label, n_keys")
    whole = wanted.join(there, ["row", "phrase", "p"]).groupBy("row", "template", "d", "share").agg(F.count_distinct("phrase").alias("k")).join(F.broadcast(names), "template").filter("k = n_keys")
    accepted = whole.groupBy("row").agg(F.collect_set("label").alias("own"), F.max("share").alias("share"))

    of_base = F.expr(f"filter(phrases, x -> x.phrase IN {_set(BASE)})")
    label = "CASE x.phrase " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in BASE.items()) + " END"
    rows = found.select("row", "doc_id", "n_words", of_base.alias("base"))
    rows = rows.select(
        "row", "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.expr("cast(array_min(transform(base, x -> x.p)) as bigint)").alias("first_word"), F.expr("cast(array_max(transform(base, x -> x.p)) as bigint)").alias("last_word"),
        F.expr(f"array_distinct(transform(base, x -> {label}))").alias("base_labels"),
    )
    joined = lambda c: F.array_join(F.array_sort(c), ",")
    least = F.when(F.col("n_base") > 0, BASE_SCORE).otherwise(0.0)
    return rows.join(accepted, "row", "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", joined("base_labels").alias("base_labels"),
        joined(F.array_union("base_labels", F.coalesce("own", F.array().cast("array<string>")))).alias("labels"), F.greatest(F.coalesce("share", F.lit(0.0)), least).alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


_TEXTS = ", ".join(f"('{t.name}', '{t.label}', string_split('{t.text}', ' '))" for t in TEMPLATES)
_KEYS = ", ".join(f"('{t.name}', '{k}', {len(t.keys)})" for t in TEMPLATES for k in t.keys)
_BASE = ", ".join(f"('{k}', '{v}')" for k, v in BASE.items())
SQL = rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
 x AS MATERIALIZED (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS p FROM d),
 t(template, label, w) AS (VALUES {_TEXTS}),
 tw AS (SELECT template, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS q FROM t),
 df AS MATERIALIZED (SELECT v.word, count(DISTINCT r) AS df FROM (SELECT DISTINCT word FROM tw) v LEFT JOIN x ON x.word = v.word GROUP BY v.word),
 rk AS (SELECT template, word, df FROM (SELECT DISTINCT template, word FROM tw) JOIN df USING (word) QUALIFY row_number() OVER (PARTITION BY template ORDER BY df, word) <= {RARE}),
 po AS MATERIALIZED (SELECT template, word, q, ln(((SELECT count(*) FROM d) + 1)::DOUBLE / (df + 1)) + 1 AS idf FROM tw JOIN rk USING (template, word)),
 tot AS (SELECT template, least({LEAST}, count(*)) AS least, sum(idf) AS total FROM po GROUP BY template),
 c AS MATERIALIZED (SELECT r, template, p - q AS d, least(1.0::DOUBLE, round(sum(idf) / any_value(total), 6)) AS share FROM x JOIN po USING (word) JOIN tot USING (template) GROUP BY r, template, p - q HAVING count(*) >= any_value(least)),
 k AS (SELECT template, phrase, n_keys, len(string_split(phrase, ' ')) AS m, (SELECT min(i) FROM unnest(range(0, 60)) AS u(i) WHERE array_to_string(list_slice(t.w, i + 1, i + len(string_split(phrase, ' '))), ' ') = phrase) AS o FROM (VALUES {_KEYS}) AS y(template, phrase, n_keys) JOIN t USING (template)),
 b(phrase, label) AS (VALUES {_BASE}),
 f AS (SELECT phrase, len(string_split(phrase, ' ')) AS m FROM (SELECT phrase FROM k UNION SELECT phrase FROM b)),
 o AS MATERIALIZED (SELECT r, phrase, p FROM x JOIN f ON word = string_split(phrase, ' ')[1] JOIN d USING (r) WHERE array_to_string(list_slice(w, p + 1, p + m), ' ') = phrase),
 v AS (SELECT c.r, c.template, c.d, share FROM c JOIN k USING (template) JOIN o ON o.r = c.r AND o.phrase = k.phrase AND abs(o.p - c.d - k.o) <= {SLACK} GROUP BY ALL HAVING count(DISTINCT o.phrase) = any_value(n_keys)),
 l AS (SELECT r, label, share, NULL AS p FROM v JOIN t USING (template) UNION ALL SELECT r, label, NULL, p FROM o JOIN b USING (phrase)),
 g AS (SELECT r, count(p) AS n_base, min(p) AS first_word, max(p) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (p IS NOT NULL) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS share FROM l GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, greatest(coalesce(share, 0), CASE WHEN n_base > 0 THEN {BASE_SCORE} ELSE 0 END)::DOUBLE AS score
FROM d LEFT JOIN g USING (r)
"""
