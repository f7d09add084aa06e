"""Licence notices in texts, found with a positional index of rare tokens.

The index lists, for each licence word, the templates and places it stands in.  One pass counts
in how many texts each word occurs; a template is then looked up by its rarest words only.  In
a text each of these gives a start for its templates, place less place; starts on which enough
rare words agree are candidates.  A candidate is accepted where its mandatory key phrase stands
word for word and most of the template's other words stand at their places.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from branchlore.llm.common import folded_words, kept_columns, whole

RARE_WORDS = 4  # of a template that are looked up
AGREEING = 2  # of them that must give the same start, where the template has so many
LEAST_SCORE = 0.7


@dataclass(frozen=True)
class Template:
    """``key`` is the mandatory phrase inside ``text``; both in small letters, words split by blanks."""

    label: str
    text: str
    key: str

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def key_at(self) -> int:
        words, key = self.words, self.key.split()
        return next(i for i in range(len(words)) if words[i : i + len(key)] == key)


# Three given phrases, then sentences of public licence notices.
BASE = (
    Template("cc-by", "cc by", "cc by"),
    Template("gpl", "general public license", "general public license"),
    Template("reserved", "all rights reserved", "all rights reserved"),
)
TEMPLATES = (
    *BASE,
    Template("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "source and binary forms"),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    Template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    Template("gpl-2.0", "licensed under the gnu general public license version 2", "general public license version 2"),
    Template("gpl-3.0", "licensed under the gnu general public license version 3", "general public license version 3"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose", "and or distribute this software"),
    Template("lgpl", "under the terms of the gnu lesser general public license", "lesser general public license"),
    Template("mit", "released under the mit license", "mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "hereby granted free of charge"),
    Template("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software"),
)


def _worded(docs: DataFrame) -> DataFrame:
    rows = kept_columns(docs, "doc_id", "text")
    return rows.select("doc_id", folded_words(whole("text")).alias("words"))


def word_frequencies(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> dict[str, int]:
    """In how many texts each word of the templates occurs: at most as many numbers as the templates have words."""
    vocabulary = sorted({w for t in templates for w in t.words})
    present = F.array_intersect("words", F.array(*map(F.lit, vocabulary)))
    counted = _worded(docs).select(F.explode(present).alias("word")).groupBy("word").count()
    return {r["word"]: r["count"] for r in counted.collect()}


def rare_postings(frequencies: dict[str, int], templates: tuple[Template, ...] = TEMPLATES) -> dict[str, list[tuple[int, int]]]:
    """The index: rare word to (number of the template, place in it).

    Besides its rarest words a template has the rarest of its key phrase: these stand in place in
    every notice that counts, whatever else in it is altered.
    """
    index: dict[str, list[tuple[int, int]]] = {}
    for number, template in enumerate(templates):
        known = sorted((frequencies[w], w) for w in set(template.words) if frequencies.get(w))
        chosen = {w for _, w in known[: 1 if template in BASE else RARE_WORDS]}
        if template not in BASE:
            chosen |= {w for _, w in [x for x in known if x[1] in template.key.split()][:AGREEING]}
        for place, word in enumerate(template.words):
            if word in chosen:
                index.setdefault(word, []).append((number, place))
    return index


def _needed(number: int, index: dict[str, list[tuple[int, int]]], templates: tuple[Template, ...]) -> int:
    chosen = {w for w, posts in index.items() if any(n == number for n, _ in posts)}
    return min(AGREEING, len(chosen)) if templates[number] not in BASE else 1


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, least_score: float = LEAST_SCORE) -> DataFrame:
    """Per document row ``doc_id``, ``n_words`` and ``found``: (``start``, ``number`` of the template, ``label``, ``score``) by start.

    Missing and empty texts have no words and nothing found; repeated rows stay, each with its
    result; an empty table gives none; other columns are not looked at.
    """
    index = rare_postings(word_frequencies(docs, templates), templates)
    texts = _worded(docs)
    none = "array<struct<start:int,number:int,label:string,score:double>>"
    n_words = F.size("words").cast("long").alias("n_words")
    if not index:
        return texts.select("doc_id", n_words, F.array().cast(none).alias("found"))
    hits = F.array_compact(
        F.transform("words", lambda w, i: F.when(w.isin(*sorted(index)), F.struct(w.alias("word"), i.alias("at"))))
    )
    posts = F.create_map(
        *[
            x
            for word, places in sorted(index.items())
            for x in (F.lit(word), F.array(*[F.struct(F.lit(n).alias("number"), F.lit(p).alias("place")) for n, p in places]))
        ]
    )
    starts = F.flatten(
        F.transform(
            "hits",
            lambda h: F.transform(
                F.element_at(posts, h["word"]),
                lambda p: F.struct((h["at"] - p["place"]).alias("start"), p["number"].alias("number")),
            ),
        )
    )
    spelled = F.array(*[F.array(*map(F.lit, t.words)) for t in templates])
    keys = F.array(*[F.struct(F.lit(t.key_at).alias("at"), F.array(*map(F.lit, t.key.split())).alias("words")) for t in templates])
    labels = F.array(*[F.lit(t.label) for t in templates])
    needed = F.array(*[F.lit(_needed(n, index, templates)) for n in range(len(templates))])

    def agreed(c: Column, i: Column) -> Column:
        """The first of a run of equal starts that is long enough; ``starts`` is sorted."""
        last = F.get("starts", i + F.get(needed, c["number"]) - 1)
        return F.coalesce(last == c, F.lit(False)) & F.coalesce(F.get("starts", i - 1) != c, F.lit(True))

    def score(c: Column) -> Column:
        template = F.get(spelled, c["number"])
        in_place = F.filter(template, lambda w, i: F.coalesce(F.get("words", c["start"] + i) == w, F.lit(False)))
        return (F.size(in_place) / F.size(template)).cast("double")

    def key_stands(c: Column) -> Column:
        key = F.get(keys, c["number"])
        at = c["start"] + key["at"]
        return F.when(at >= 0, F.slice("words", F.greatest(at, F.lit(0)) + 1, F.size(key["words"])) == key["words"]).otherwise(F.lit(False))

    chosen = F.filter(F.filter("starts", agreed), key_stands)
    scored = F.transform(
        chosen,
        lambda c: F.struct(
            c["start"].alias("start"), c["number"].alias("number"), F.get(labels, c["number"]).alias("label"), score(c).alias("score")
        ),
    )
    found = F.array_sort(F.filter(scored, lambda c: c["score"] >= least_score))
    texts = texts.withColumn("hits", hits).withColumn("starts", F.array_sort(starts))
    return texts.select("doc_id", n_words, found.alias("found"))


def licences(docs: DataFrame) -> DataFrame:
    """The digest per document: places of the base phrases, base labels, all labels and the best score."""
    n_base = len(BASE)
    base = F.filter("found", lambda f: f["number"] < n_base)
    distinct = lambda found: F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda f: f["label"]))), ",")
    starts = F.transform("base", lambda f: f["start"].cast("long"))
    return scan(docs).withColumn("base", base).select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        distinct(F.col("base")).alias("base_labels"),
        distinct(F.col("found")).alias("labels"),
        F.coalesce(F.array_max(F.transform("found", lambda f: f["score"])), F.lit(0.0)).alias("score"),
    )
