"""Licence notices in texts, found by a positional index of the notices' rarest words.

The project's records hold numbers and bits, no prose, so this operator is general: any table with an id and a text. Spark expressions only.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statewatch.functions.arrays import let
from statewatch.llm.common import ascii_lower, plain

#: A word: no ASCII but digits and lower-case letters, and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Names whose every place is reported, with their labels.
NAMES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Label, notice, and the key phrases that must stand at their places in it.
NOTICES = [
    ("agpl-3.0", "licensed under the gnu affero general public license version 3", ["affero general public license version 3"]),
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license version 2 0"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ["redistribution and use", "source and binary forms"]),
    ("cc-by-4.0", "licensed under cc by 4 0", ["cc by 4 0"]),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ["cc by nc 4 0"]),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ["cc by sa 4 0"]),
    ("cc0-1.0", "released under the cc0 1 0 universal public domain dedication", ["cc0 1 0", "public domain"]),
    ("epl-2.0", "made available under the terms of the eclipse public license 2 0", ["eclipse public license 2 0"]),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ["gnu general public license version 2"]),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ["gnu general public license version 3"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", ["use copy modify and or distribute", "any purpose"]),
    ("lgpl", "licensed under the gnu lesser general public license", ["lesser general public license"]),
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", ["hereby granted free of charge", "obtaining a copy"]),
    ("mpl-2.0", "subject to the terms of the mozilla public license version 2 0", ["mozilla public license version 2 0"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["unencumbered software", "public domain"]),
]
#: What a name alone is worth as a sign of a licence; a notice is worth the share of its words that stand in their places.
NAME_ALONE = 0.5


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    keys: tuple[tuple[int, tuple[str, ...]], ...]  # position and words of each key phrase

    @staticmethod
    def of(label: str, text: str, keys: Sequence[str]) -> Template:
        words = tuple(re.findall(r"[^ ]+", text))
        found = []
        for key in keys:
            part = tuple(key.split(" "))
            at = next((i for i in range(len(words)) if words[i : i + len(part)] == part), None)
            if at is None:
                raise ValueError(f"key phrase {key!r} is not in its notice")
            found.append((at, part))
        return Template(label, words, tuple(found))

    @property
    def needed(self) -> list[str]:
        """Distinct words of the key phrases; a text without one of them holds no place of this template."""
        return sorted({w for _, part in self.keys for w in part})

    def rarest(self, rank: dict[str, int], depth: int) -> list[tuple[str, int]]:
        """The ``depth`` places of key phrases with the rarest words."""
        places = [(w, at + i) for at, part in self.keys for i, w in enumerate(part)]
        return sorted(places, key=lambda p: (rank[p[0]], p[1]))[:depth]


def templates(names: dict[str, str], notices: Sequence[tuple[str, str, Sequence[str]]]) -> tuple[list[Template], list[Template]]:
    return [Template.of(label, text, [text]) for text, label in names.items()], [Template.of(*n) for n in notices]


def strings(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def word_array(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def word_ranks(texts: DataFrame, vocabulary: Sequence[str]) -> dict[str, int]:
    """Ranks of the licence words, the one with the largest inverse document frequency first, equal ones in order.

    Every text is counted; each task counts its own texts and hands on at most one row for each licence word.
    """
    seen = texts.select(F.explode(F.array_intersect(strings(vocabulary), word_array(F.col("text")))).alias("word"))
    counts = {r["word"]: r["n"] for r in seen.groupBy("word").agg(F.count("*").alias("n")).collect()}
    order = sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))
    return {w: i for i, w in enumerate(order)}


def starts(rarest: Sequence[tuple[str, int]], hits: Column) -> Column:
    """Where the template may begin: the starts that all its rarest words agree on, each counted back from the word's place."""

    def counted_back(word: str, at: int) -> Column:
        return F.transform(F.filter(hits, lambda h: h["word"] == word), lambda h: h["at"] - at)

    return F.array_distinct(reduce(F.array_intersect, [counted_back(word, at) for word, at in rarest]))


def verified(template: Template, found: Column, words: Column) -> Column:
    """The starts where every key phrase stands at its place. A start may lie before the text if only the notice's first words are missing."""

    def holds(start: Column) -> Column:
        checks = [
            (start + at >= 0) & (F.slice(words, F.greatest(start + at, F.lit(0)) + 1, len(part)) == strings(part)) for at, part in template.keys
        ]
        whole = checks[0]
        for check in checks[1:]:
            whole = whole & check
        return whole

    return F.filter(found, holds)


def share(template: Template, places: Column, words: Column) -> Column:
    """The largest share of the template's words that stand in their places at one of ``places``; 0 without any."""

    def matched(start: Column) -> Column:
        same = F.transform(strings(template.words), lambda w, i: F.when((start + i >= 0) & (F.get(words, start + i) == w), 1).otherwise(0))
        return F.aggregate(same, F.lit(0), lambda a, b: a + b)

    return F.coalesce(F.array_max(F.transform(places, matched)), F.lit(0)) / F.lit(float(len(template.words)))


def scan_licences(
    docs: DataFrame, id: str = "doc_id", text: str = "text", names: dict[str, str] | None = None,
    notices: Sequence[tuple[str, str, Sequence[str]]] | None = None, depth: int = 2,
) -> DataFrame:
    """One row per row of ``docs``: ``id, n_words, n_base, first_word, last_word, base_labels, labels, score``.

    Texts are cut into words after A-Z are lower-cased. ``names`` (phrase to label) are found at every place: ``n_base`` counts the places of all,
    ``first_word`` and ``last_word`` are the smallest and largest start. ``notices`` (label, text, key phrases) are found where all their
    key phrases stand at the right distances; other words may differ. ``labels`` are those of both, ``base_labels`` of names only; distinct,
    sorted, joined by commas. ``score`` is the largest share of a notice's words in their places, and at least ``NAME_ALONE`` with a name.

    The corpus gives each licence word its document frequency. A text is looked up by its licence words: a template is considered
    where all words of its key phrases occur, through the postings of its ``depth`` rarest ones; their relative positions must agree
    on a start, and the key phrases are verified there. The frequencies say where to look first and never what is found.

    Cases: NULL text counts as empty; an empty text has no words, labels ``''``, score 0 and NULL starts. Repeated rows give repeated results, ties
    in frequency go by the word. An empty table gives no rows. Texts of any length are read whole. Other columns are not read.
    """
    named, noted = templates(NAMES if names is None else names, NOTICES if notices is None else notices)
    if not named and not noted:
        raise ValueError("there must be a name or a notice to find")
    every = [*named, *noted]
    vocabulary = sorted({w for t in every for w in t.needed})
    source = docs.select(F.col(id).alias("id"), ascii_lower(plain(text)).alias("text"))
    rank = word_ranks(source, vocabulary)
    ranked = sorted(vocabulary, key=rank.__getitem__)
    postings = {t: t.rarest(rank, depth) for t in every}

    def look_up(words: Column) -> Column:
        return let(F.array_intersect(strings(ranked), words), lambda present: considered(words, present))

    def considered(words: Column, present: Column) -> Column:
        open_ = [F.size(F.array_except(strings(t.needed), present)) == 0 for t in every]
        tokens = F.array_distinct(
            F.flatten(F.array(*[F.when(o, strings([w for w, _ in postings[t]])).otherwise(strings([])) for t, o in zip(every, open_, strict=True)]))
        )
        return let(tokens, lambda wanted: F.when(F.size(wanted) > 0, let(hits_of(words, wanted), lambda hits: report(words, hits))))

    def hits_of(words: Column, wanted: Column) -> Column:
        at = F.transform(words, lambda w, i: F.when(F.array_contains(wanted, w), F.struct(w.alias("word"), i.alias("at"))))
        return F.filter(at, lambda h: h.isNotNull())

    def report(words: Column, hits: Column) -> Column:
        places = F.array(*[verified(t, starts(postings[t], hits), words) for t in every])
        return let(places, lambda p: summary(words, p))

    def summary(words: Column, places: Column) -> Column:
        def of(i: int) -> Column:
            return F.get(places, F.lit(i))

        def labels(which: Sequence[int]) -> Column:
            found = F.array(*[F.when(F.size(of(i)) > 0, F.lit(every[i].label)) for i in which]) if which else strings([])
            return F.array_join(F.array_sort(F.array_distinct(F.filter(found, lambda x: x.isNotNull()))), ",")

        base = range(len(named))
        bases = F.flatten(F.slice(places, 1, len(named))) if named else F.array().cast("array<int>")
        shares = [share(every[i], of(i), words) for i in range(len(named), len(every))]
        alone = F.when(F.size(bases) > 0, F.lit(NAME_ALONE)).otherwise(F.lit(0.0))
        return F.struct(
            F.size(bases).cast("bigint").alias("n_base"),
            F.array_min(bases).cast("bigint").alias("first_word"),
            F.array_max(bases).cast("bigint").alias("last_word"),
            labels(list(base)).alias("base_labels"),
            labels(range(len(every))).alias("labels"),
            F.greatest(alone, *shares).alias("score") if shares else alone.alias("score"),
        )

    found = source.select("id", let(word_array(F.col("text")), lambda w: F.struct(F.size(w).cast("bigint").alias("n_words"), look_up(w).alias("f"))).alias("r"))
    return found.select(
        "id",
        "r.n_words",
        F.coalesce("r.f.n_base", F.lit(0).cast("bigint")).alias("n_base"),
        F.col("r.f.first_word").alias("first_word"),
        F.col("r.f.last_word").alias("last_word"),
        F.coalesce("r.f.base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("r.f.labels", F.lit("")).alias("labels"),
        F.coalesce("r.f.score", F.lit(0.0)).alias("score"),
    )
