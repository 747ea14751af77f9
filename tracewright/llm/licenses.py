"""License scans: an exact set-similarity join of text blocks with license templates.

A block is any run of consecutive words of a text, as long as the template (and a little
longer, see ``window_of``), wherever lines break; it must hold at least the threshold's
share of the template's distinct tokens. Tokens are ordered by their frequency over the
whole corpus, rarest first, and the templates' prefixes (their first ``|T| - need + 1``
tokens) are an index that a broadcast join meets with the words of the texts: every block
that meets the threshold holds a prefix token (prefix filter). Around such a word only
tokens not rarer than it count, as blocks with a rarer one are found from that (positional
filter), and there must be ``need`` of them at all (length filter). What passes is verified
block by block. Built-in expressions only: no Python on executors.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, read

#: Phrases of the base scan and their labels.
PHRASES = (
    ("cc by", "cc-by"),
    ("general public license", "gpl"),
    ("all rights reserved", "reserved"),
)

#: Wording of widespread public license notices.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction"),
    ("apache-2.0", "licensed under the apache license version 2 0 you may not use this file except in compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("warranty-none", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "this work is licensed under a creative commons attribution international license"),
    ("cc-by", "released under cc by 4 0"),
    ("public-domain", "this is free and unencumbered software released into the public domain"),
    ("reserved", "copyright all rights reserved no part of this publication may be reproduced"),
    ("gpl", "distributed under the gnu general public license"),
    # short grants: of up to four words all must be there, so one license is not taken for another
    ("mit", "under the mit license"),
    ("mit", "spdx license identifier mit"),
    ("apache-2.0", "apache license 2 0"),
    ("bsd", "under the bsd license"),
    ("bsd", "bsd 2 clause license"),
    ("bsd", "bsd 3 clause license"),
    ("bsd", "spdx license identifier bsd"),
    ("mpl-2.0", "mozilla license 2 0"),
    ("mpl-2.0", "mpl 2 0"),
)

THRESHOLD = 0.8
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: What separates words once A-Z are lower case: all of ASCII but digits and letters.
BREAK = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def lowered(text: Column) -> Column:
    """Only A-Z become lower case; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())


def spaced(low: Column) -> Column:
    """The words of a lowered text with one blank before, between and after them."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(low, BREAK, " ")), F.lit(" "))


def templates_of(templates=TEMPLATES) -> list[tuple[str, list[str]]]:
    return [(label, sorted(set(words.split()))) for label, words in templates]


def token_frequencies(docs: DataFrame, templates=TEMPLATES) -> dict[str, int]:
    """Occurrences over the whole corpus of each token that any template has.

    The result has one row for each template token at most, whatever the corpus.
    """
    vocabulary = sorted({w for _, words in templates_of(templates) for w in words})
    words = F.split(F.trim(F.regexp_replace(lowered(F.col("text")), BREAK, " ")), " ")
    hits = docs.select(F.explode(F.filter(words, lambda w: w.isin(vocabulary))).alias("w"))
    counted = {r["w"]: r["n"] for r in hits.groupBy("w").agg(F.count("*").alias("n")).collect()}
    return {w: counted.get(w, 0) for w in vocabulary}


def needed(size: int, threshold: float) -> int:
    """Smallest overlap that meets the containment threshold."""
    return max(1, -int(-(size * threshold - 1e-9) // 1))


def window_of(words: str, threshold: float) -> int:
    """Words of a block for a template: its own number, and as many more as the threshold
    allows, two at least."""
    n = len(words.split())
    return max(n + 2, -int(-(n / threshold) // 1))


def prefix_index(spark: SparkSession, frequencies: dict[str, int], templates=TEMPLATES, threshold: float = THRESHOLD) -> tuple[DataFrame, list[str], list[str], int]:
    """(index, its tokens, all templates' tokens, longest block). The index has a row for each
    prefix token of each template: w, label, after (tokens not rarer than w), need, width,
    total. Its size is that of the list of templates, whatever the corpus."""
    rank = {w: i for i, w in enumerate(sorted(frequencies, key=lambda w: (frequencies[w], w)))}
    rows = []
    for label, words in templates:
        tokens = sorted(set(words.split()), key=rank.get)
        need, width = needed(len(tokens), threshold), window_of(words, threshold)
        rows += [(tokens[k], label, tokens[k:], need, width, len(tokens)) for k in range(len(tokens) - need + 1)]
    index = spark.createDataFrame(rows, "w string, label string, after array<string>, need int, width int, total int")
    return index, sorted({r[0] for r in rows}), sorted(rank), max(r[4] for r in rows)


def template_matches(low: DataFrame, frequencies: dict[str, int], templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """key, found (sorted labels), share (best containment) of each text (key, low) that has a
    block of any template; texts of one key are equal."""
    index, first, vocabulary, most = prefix_index(low.sparkSession, frequencies, templates, threshold)
    words = F.split(F.trim(F.regexp_replace(F.col("low"), BREAK, " ")), " ")

    def around(ws: Column) -> Column:
        """The prefix tokens among the words, each with the template tokens near it."""
        hits = F.filter(F.transform(ws, lambda w, i: F.struct(i.alias("at"), w.alias("w"))), lambda x: x["w"].isin(vocabulary))

        def marked(all_: Column) -> Column:
            placed = F.filter(F.transform(all_, lambda x, j: F.struct(x["at"].alias("at"), x["w"].alias("w"), j.alias("j"))), lambda x: x["w"].isin(first))
            # a block has ``most`` hits at most, on either side of the prefix token
            return F.transform(placed, lambda x: F.struct(x["at"].alias("p"), x["w"].alias("w"), F.slice(all_, F.greatest(x["j"] + 2 - most, F.lit(1)), 2 * most - 1).alias("near")))

        return F.when(F.exists(ws, lambda w: w.isin(first)), let(hits, marked))

    met = low.select("key", F.explode(let(words, around)).alias("x")).select("key", "x.*").join(F.broadcast(index), "w")
    own = F.filter("near", lambda x: (x["at"] > F.col("p") - F.col("width")) & (x["at"] < F.col("p") + F.col("width")) & F.array_contains("after", x["w"]))
    kept = met.select("key", "label", "need", "width", "total", "p", own.alias("own"))
    kept = kept.where(F.size(F.array_distinct(F.transform("own", lambda x: x["w"]))) >= F.col("need"))

    def distinct_from(x: Column) -> Column:
        inside = F.filter("own", lambda y: (y["at"] >= x["at"]) & (y["at"] < x["at"] + F.col("width")))
        return F.size(F.array_distinct(F.transform(inside, lambda y: y["w"])))

    starts = F.filter("own", lambda x: (x["at"] <= F.col("p")) & (x["at"] > F.col("p") - F.col("width")))
    found = kept.select("key", "label", "need", "total", F.array_max(F.transform(starts, distinct_from)).alias("n")).where("n >= need")
    return found.groupBy("key").agg(F.array_sort(F.collect_set("label")).alias("found"), F.max(F.col("n") / F.col("total").cast("double")).alias("share"))


def scan(docs: DataFrame, frequencies: dict[str, int] | None = None, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Adds nothing to and drops nothing from the rows: one result row for each input row.

    ``labels`` has those of the phrases and of the templates that a block of the text
    contains; ``score`` is 1 where a phrase stands, else the best containment of a block that
    meets the threshold, else 0.

    Null and empty texts: no words, no labels, score 0. Null doc_ids are carried through;
    repeated rows each get their result. Other columns of ``docs`` are ignored.
    """
    rows = docs.select("doc_id", "text")
    if frequencies is None:
        frequencies = token_frequencies(rows, templates)
    low = rows.select("doc_id", lowered(F.col("text")).alias("low")).withColumn("key", F.unhex(F.md5("low")))
    matches = template_matches(low, frequencies, templates, threshold)
    flat = low.select("doc_id", "key", spaced(F.col("low")).alias("flat"))
    any_phrase = reduce(lambda a, b: a | b, [F.col("flat").contains(f" {p} ") for p, _ in PHRASES])
    words = F.split(F.trim(F.col("flat")), " ")

    def places(ws: Column, phrase: str, name: str) -> Column:
        def here(i: Column) -> Column:
            return reduce(lambda a, b: a & b, [F.coalesce(F.get(ws, i + k) == F.lit(w), F.lit(False)) for k, w in enumerate(phrase.split())])

        return F.transform(F.filter(F.sequence(F.lit(0), F.size(ws) - 1), here), lambda i: F.struct(i.cast("long").alias("at"), F.lit(name).alias("label")))

    def starts(ws: Column) -> Column:
        return F.flatten(F.array(*[places(ws, p, name) for p, name in PHRASES]))

    empty = F.array().cast("array<struct<at:long,label:string>>")
    n_words = F.when(F.length("flat") <= 2, F.lit(0)).otherwise(F.length("flat") - F.length(F.replace(F.col("flat"), F.lit(" "), F.lit(""))) - 1)
    base = flat.select("doc_id", "key", n_words.cast("long").alias("n_words"), F.when(any_phrase, let(words, starts)).otherwise(empty).alias("base"))
    out = base.join(matches, "key", "left")
    by_phrase = F.array_distinct(F.transform("base", lambda b: b["label"]))
    return out.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda b: b["at"])).alias("first_word"),
        F.array_max(F.transform("base", lambda b: b["at"])).alias("last_word"),
        F.array_join(F.array_sort(by_phrase), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(by_phrase, F.coalesce("found", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"))


def _oracle() -> str:
    words = "regexp_extract_all(low, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

    def places(phrase: str) -> str:
        return "[i FOR i IN range(len(ws)) IF " + " AND ".join(f"coalesce(ws[i + {k + 1}] = '{w}', FALSE)" for k, w in enumerate(phrase.split())) + "]"

    def most(template: str) -> str:
        listed = ", ".join(f"'{t}'" for t in sorted(set(template.split())))
        need = needed(len(set(template.split())), THRESHOLD)
        return f"CASE WHEN len(list_intersect(ds, [{listed}])) >= {need} THEN list_max([len(list_intersect(list_distinct(ws[i + 1:i + {window_of(template, THRESHOLD)}]), [{listed}])) FOR i IN range(len(ws))]) ELSE 0 END"

    plans = [(label, len(set(t.split())), needed(len(set(t.split())), THRESHOLD)) for label, t in TEMPLATES]
    found = ", ".join(f"CASE WHEN s[{i + 1}] >= {need} THEN '{label}' END" for i, (label, _, need) in enumerate(plans))
    shares = ", ".join(f"CASE WHEN s[{i + 1}] >= {need} THEN s[{i + 1}] / CAST({n} AS DOUBLE) END" for i, (_, n, need) in enumerate(plans))
    base = ", ".join(f"CASE WHEN len(p{i}) > 0 THEN '{label}' END" for i, (_, label) in enumerate(PHRASES))
    every = " || ".join(f"p{i}" for i in range(len(PHRASES)))
    sort = "array_to_string(list_sort(list_distinct([x FOR x IN {0} IF x IS NOT NULL])), ',')"
    return f"""WITH low AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}') AS low FROM documents),
w AS (SELECT doc_id, {words} AS ws, list_distinct({words}) AS ds FROM low),
p AS (SELECT doc_id, len(ws) AS n_words, {", ".join(f"{places(p)} AS p{i}" for i, (p, _) in enumerate(PHRASES))}, [{", ".join(most(t) for _, t in TEMPLATES)}] AS s FROM w),
q AS (SELECT doc_id, n_words, {every} AS places, [{base}] AS base, [{found}] AS found, list_max([{shares}]) AS best FROM p)
SELECT doc_id, n_words, len(places) AS n_base, list_min(places) AS first_word, list_max(places) AS last_word, {sort.format("base")} AS base_labels, {sort.format("base || found")} AS labels, CASE WHEN len(places) > 0 THEN CAST(1 AS DOUBLE) ELSE coalesce(best, 0) END AS score FROM q"""


#: The same rows in DuckDB's SQL.
ORACLE_SQL = _oracle()
