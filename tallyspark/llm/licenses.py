"""License scans: an exact set-similarity join of text blocks with license templates.

Blocks are the lines of a text, as sets of words.  A block matches a template when
it holds at least ``THRESHOLD`` of the template's words.  The join is exact:

* template words are ordered by their frequency in all texts, rarest first;
* prefix filter: with |T| words of which ``need`` must be met, a match meets one of
  the |T| - need + 1 rarest, so only those are in the index from word to template;
* length filter: a block with fewer than ``need`` template words is passed over;
* positional filter: at a met word, the words left in the template's and in the
  block's order bound the overlap that is still possible;
* candidates are verified by the size of the intersection.

With ``windows``, statements are found wherever line ends fall: windows of consecutive words of
the whole text are blocks too, for each template twice as
long as its statement and begun every half statement, so that any stretch of one and a
half statements lies in one.  Every text is cut into them, however many lines it has, by the same
filters, unless all its words together do not reach the template's ``need``.  Hits of windows that overlap are one.

The index holds the templates' words only (a parameter, not data), so it travels
inside the plan, and each text meets it in place: no text is shuffled and no block
can be hot.  Besides, fixed phrases are found as consecutive words of the whole text.
Only DataFrame functions are used.

Defined results: a null text is an empty one, without words, places or labels;
a text repeated is judged alike; an empty table gives an empty result (all word
frequencies zero); other columns come back unchanged.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, unused

THRESHOLD = 0.8
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SEPARATORS_IN_LINE = r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases that carry a label wherever they stand.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

#: Opening statements of public licenses, with the label they carry.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
)


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased.  Other letters may change case, but never to or from ASCII: the two that would keep theirs."""
    upper, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(text.rlike("[İK]"), F.translate(text, upper, low)).otherwise(F.lower(text))


def template_words(statement: str) -> frozenset[str]:
    return frozenset(re.findall(r"[0-9a-z]+", statement.lower()))


def need(size: int, threshold: float) -> int:
    return math.ceil(round(threshold * size, 9))


def lines_of(text: Column) -> Column:
    """The text lower-cased, runs of separators as one space, line ends kept."""
    return F.regexp_replace(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS_IN_LINE, " ")


def word_counts(docs: DataFrame, text_col: str, words: list[str]) -> dict[str, int]:
    """How often each of ``words`` stands in all texts (one row a word reaches the driver)."""
    each = F.split(lines_of(F.col(text_col)), "[ \n]")
    found = docs.select(F.explode(F.filter(each, lambda w: w.isin(words))).alias("word"))
    return {r.word: r.n for r in found.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}


def matches(blocks: Column, templates, counts: dict[str, int], threshold: float) -> Column:
    """Array of struct(line, label, containment) of the blocks (arrays of words) that match; ``line`` is the block's number."""
    sets = [template_words(statement) for _, statement in templates]
    words = sorted(set().union(*sets), key=lambda w: (counts.get(w, 0), w))
    rank = {w: i for i, w in enumerate(words)}
    ordered = [sorted(rank[w] for w in s) for s in sets]
    needed = [need(len(s), threshold) for s in sets]
    index: list[list[tuple[int, int, int]]] = [[] for _ in words]
    for t, (ranks, least) in enumerate(zip(ordered, needed)):
        for at, r in enumerate(ranks[: len(ranks) - least + 1]):
            index[r].append((t, len(ranks) - at, least))
    ints = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<int>")
    entry = lambda e: F.struct(F.lit(e[0]).alias("t"), F.lit(e[1]).alias("left"), F.lit(e[2]).alias("need"))
    none = F.array().cast("array<struct<t:int,left:int,need:int>>")
    postings = F.array(*[F.array(*map(entry, es)) if es else none for es in index])
    rank_of = F.create_map(*[x for w, r in rank.items() for x in (F.lit(w), F.lit(r))])
    members = F.array(*map(ints, ordered))
    least_of = ints(needed)
    size_of = ints(map(len, ordered))
    labels = F.array(*[F.lit(label) for label, _ in templates])

    def block(own: Column) -> Column:
        """Ranks of the block's template words, rarest first."""
        return F.sort_array(F.array_distinct(F.transform(F.filter(own, lambda w: w.isin(words)), lambda w: rank_of[w])))

    def candidates(b: Column) -> Column:
        def met(r: Column, at: Column) -> Column:
            possible = F.filter(F.get(postings, r), lambda e: F.least(e["left"], F.size(b) - at) >= e["need"])
            return F.transform(possible, lambda e: e["t"])

        return F.array_distinct(F.flatten(F.transform(b, met)))

    def verified(b: Column, at: Column) -> Column:
        overlap = lambda t: F.size(F.array_intersect(b, F.get(members, t)))
        kept = F.filter(candidates(b), lambda t: overlap(t) >= F.get(least_of, t))
        return F.transform(
            kept,
            lambda t: F.struct(
                at.alias("line"), F.get(labels, t).alias("label"), (overlap(t) / F.get(size_of, t)).alias("containment")
            ),
        )

    empty = F.array().cast("array<struct<line:int,label:string,containment:double>>")
    long_enough = lambda b: F.size(b) >= min(needed)
    of_block = lambda x, i: let(block(x), lambda b: F.when(long_enough(b), verified(b, i)).otherwise(empty))
    return F.flatten(F.transform(blocks, of_block))


def wrapped(lines: Column, normal: Column, templates, counts: dict[str, int], threshold: float) -> Column:
    """Array of struct(line, label, containment) of the word windows that match; ``line`` is that of the first word."""
    every = sorted(set().union(*(template_words(statement) for _, statement in templates)))
    kind = "array<struct<line:int,label:string,containment:double>>"
    numbered = F.flatten(
        F.transform(
            lines, lambda x, i: F.transform(F.filter(F.split(x, " "), lambda w: w != ""), lambda w: F.struct(w.alias("w"), i.alias("line")))
        )
    )

    def hits(words: Column, label: str, statement: str) -> Column:
        size = len(re.findall(r"[0-9a-z]+", statement.lower()))
        step = max(size // 2, 1)
        starts = F.sequence(F.lit(0), F.size(words) - 1, F.lit(step))
        windows = F.transform(starts, lambda i: F.transform(F.slice(words, i + 1, 2 * size), lambda x: x["w"]))
        found = F.transform(
            matches(windows, ((label, statement),), counts, threshold),
            lambda x: F.struct(
                (x["line"] * step).alias("at"), F.get(words, x["line"] * step)["line"].alias("line"), x["containment"].alias("met")
            ),
        )

        def merge(acc: Column, x: Column) -> Column:
            last = F.element_at(acc, -1)
            both = F.struct(x["at"].alias("at"), last["line"].alias("line"), F.greatest(last["met"], x["met"]).alias("met"))
            joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(both))
            return F.when((F.size(acc) > 0) & (x["at"] < F.try_element_at(acc, F.lit(-1))["at"] + 2 * size), joined).otherwise(
                F.concat(acc, F.array(x))
            )

        merged = F.aggregate(found, F.array().cast("array<struct<at:int,line:int,met:double>>"), merge)
        one = lambda x: F.struct(x["line"].alias("line"), F.lit(label).alias("label"), x["met"].alias("containment"))
        return F.transform(merged, one).cast(kind)

    def of_text(seen: Column) -> Column:
        """Per template, whether the words of the whole text reach its need."""
        enough = [
            F.size(F.array_intersect(seen, F.array(*map(F.lit, sorted(t))))) >= need(len(t), threshold)
            for t in (template_words(statement) for _, statement in templates)
        ]
        empty = F.array().cast(kind)
        all_hits = lambda words: F.concat(
            *[F.when(e, hits(words, *t)).otherwise(empty) for e, t in zip(enough, templates)]
        )
        return F.when(reduce(lambda a, b: a | b, enough), let(numbered, all_hits)).otherwise(empty)

    seen = F.array_distinct(F.filter(F.split(normal, " "), lambda w: w.isin(every)))
    return let(seen, of_text)


def places(normal: Column, phrase: str) -> Column:
    """Word numbers at which the phrase's words stand consecutively in single-spaced ``normal`` text."""
    size = len(phrase.split())
    blank = lambda p: F.trim(p) == ""
    count = lambda p: F.when(blank(p), 0).otherwise(F.size(F.split(F.trim(p), " ")))

    def step(acc: Column, piece: Column) -> Column:
        at = acc["n"] + count(piece)
        return F.struct((at + size).alias("n"), F.concat(acc["at"], F.array(at)).alias("at"))

    start = F.struct(F.lit(0).alias("n"), F.array().cast("array<int>").alias("at"))
    cut = F.split(normal, f"(?<![^ ]){phrase}(?![^ ])")
    found = let(cut, lambda p: F.aggregate(F.slice(p, 1, F.size(p) - 1), start, step, lambda acc: acc["at"]))
    return F.when(F.contains(normal, F.lit(phrase)), found).otherwise(F.array().cast("array<int>"))


def scan(
    docs: DataFrame, text_col: str = "text", templates=TEMPLATES, phrases=PHRASES, threshold: float = THRESHOLD,
    windows: bool = False,
) -> DataFrame:
    """``docs`` and the columns n_words, places (struct label, word), blocks (struct line, label, containment).

    Names get ``_`` where taken.  ``line`` counts from 0.  With ``windows`` also wrapped,
    like blocks, for the windows.
    """
    counts = word_counts(docs, text_col, sorted(set().union(*(template_words(s) for _, s in templates))))
    name = {k: unused(k, docs.columns) for k in ("n_words", "places", "blocks")}
    lines, normal = unused("license_lines", docs.columns), unused("license_normal", docs.columns)
    out = docs.withColumn(lines, lines_of(F.col(text_col)))
    out = out.withColumn(normal, F.trim(F.regexp_replace(F.col(lines), "[ \n]+", " ")))
    text = F.col(normal)
    n_words = F.when(text == "", 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) + 1)
    of = lambda p, label: F.transform(places(text, p), lambda at: F.struct(F.lit(label).alias("label"), at.alias("word")))
    found = F.concat(*[of(p, label) for p, label in phrases])
    blocks = matches(F.transform(F.split(F.col(lines), "\n"), lambda x: F.split(x, " ")), templates, counts, threshold)
    out = out.withColumns({name["n_words"]: n_words.cast("long"), name["places"]: found, name["blocks"]: blocks})
    if windows:
        name["wrapped"] = unused("wrapped", docs.columns)
        out = out.withColumn(name["wrapped"], wrapped(F.split(F.col(lines), "\n"), text, templates, counts, threshold))
    return out.select(*docs.columns, *name.values())
