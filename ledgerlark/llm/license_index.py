"""Licence scan by a positional index of rare words; DataFrame functions only.

The index holds, for every licence template, its words of highest IDF (document frequencies are counted over all
documents) with their positions.  A file's words are looked up in it: each rare word that stands at position p and
has a posting (template, q) proposes that the template starts at p - q.  Postings are intersected by that relative
position (most of the template's rare words must propose the same start), and a start counts only where every
mandatory key phrase of the template stands at its place.

Scale: two passes over the texts and one small aggregate (a row per template word); nothing else is shuffled, no row
meets another.  Only the index is held on the driver and in the tasks: it is bounded by the templates, never by the
documents.  The lookup is linear in a document's words, also when one licence word fills the whole text.

Defined results: a null or empty text has no words and no places; equal rows give equal results; texts of any length are
whole; a template whose words occur nowhere is never found; equal document frequencies are ordered by position in the
template; an empty table gives no rows; columns beside ``doc_id`` and ``text`` are not looked at.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: After A-Z are lower-cased: ASCII letters, digits and all beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The one letter beyond ASCII that lower() turns into an ASCII word letter, and a letter that it leaves alone.
KELVIN, STAND_IN = "K", "ĸ"
LOOKUPS = 4  # rare words of a template
AGREE = 0.75  # share of them that must propose the same start


@dataclass(frozen=True)
class Template:
    """A notice, the phrases of it that must stand at their places, and its label; ``base`` phrases are all mandatory."""

    label: str
    text: str
    keys: tuple[str, ...] = ()
    base: bool = False

    @property
    def words(self) -> list[str]:
        return re.findall(WORD, self.text.lower())

    @property
    def key_places(self) -> list[tuple[int, list[str]]]:
        """(start, words) of every mandatory phrase."""
        words, found = self.words, []
        for key in [self.text] if self.base else self.keys:
            parts = re.findall(WORD, key.lower())
            found.append((next(i for i in range(len(words)) if words[i:i + len(parts)] == parts), parts))
        return found


#: Phrases and labels of the base.
BASE = (
    Template("gpl", "gnu general public license", base=True),
    Template("apache", "apache license", base=True),
    Template("cc-by", "cc by", base=True),
    Template("mit", "mit license", base=True),
)
#: Notices of public licences, as their authors ask to put them into files.
NOTICES = (
    Template("agpl", "gnu affero general public license", ("affero general public license",)),
    Template("apache-2.0", "licensed under the apache license version 2.0", ("apache license version 2",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted",
             ("redistribution and use in source and binary forms",)),
    Template("cc-by-nc", "licensed under cc by nc 4.0", ("cc by nc",)),
    Template("cc-by-sa", "licensed under cc by sa 4.0", ("cc by sa",)),
    Template("gpl-3.0", "licensed under the gnu general public license version 3", ("public license version 3",)),
    Template("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the "
             "gnu general public license", ("free software", "redistribute it and or modify it")),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is "
             "hereby granted", ("for any purpose with or without fee",)),
    Template("lgpl", "gnu lesser general public license", ("lesser general public license",)),
    Template("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
             "associated documentation files", ("hereby granted free of charge",)),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license",
             ("mozilla public license",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain",
             ("unencumbered software", "public domain")),
)
TEMPLATES = BASE + NOTICES


def text_words(text: str) -> Column:
    lowered = F.lower(F.replace(F.coalesce(F.col(text), F.lit("")), F.lit(KELVIN), F.lit(STAND_IN)))
    return F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0))


def word_frequencies(words: DataFrame, templates: Sequence[Template]) -> DataFrame:
    """(word, df, idf) of the templates' words that occur; ``words``: a row per document with an array ``words``."""
    vocabulary = sorted({w for t in templates for w in t.words})
    documents = words.select(F.explode(F.array_append(F.array_intersect("words", _strings(vocabulary)), F.lit(""))).alias("word"))
    counts = documents.groupBy("word").agg(F.count("*").alias("df"))
    one = counts.agg(F.max(F.when(F.col("word") == "", F.col("df"))).alias("n"),  # a row per template word at most
                     F.collect_list(F.struct("word", "df")).alias("counts"))
    return (one.select("n", F.inline("counts")).where("word <> ''")
            .select("word", "df", F.ln(F.col("n") / F.col("df")).alias("idf")))


def _strings(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def _rarest(template: Template, idf: dict[str, float]) -> list[tuple[str, int]]:
    """(word, position) of the template's words of highest IDF; each word at its first position."""
    first: dict[str, int] = {}
    for position, word in enumerate(template.words):
        first.setdefault(word, position)
    known = [(w, q) for w, q in first.items() if w in idf]
    return sorted(known, key=lambda x: (-idf[x[0]], x[1]))[:LOOKUPS]


def _index(templates: Sequence[Template], idf: dict[str, float]) -> tuple[list[str], Column]:
    """The rare words, and the positional postings and key phrases of every template as one array literal."""
    entries, rare_words = [], set()
    for t in templates:
        rare = _rarest(t, idf)
        if not rare:
            continue
        rare_words.update(w for w, _ in rare)
        entries.append(F.struct(
            F.lit(t.label).alias("label"), F.lit(t.base).alias("base"),
            F.array(*[F.struct(F.lit(w).alias("w"), F.lit(q).alias("q")) for w, q in rare]).alias("rare"),
            F.lit(math.ceil(AGREE * len(rare))).alias("need"), _strings(t.words).alias("words"),
            F.array(*[F.struct(F.lit(q).alias("q"), _strings(k).alias("words")) for q, k in t.key_places]).alias("keys")))
    return sorted(rare_words), F.array(*entries) if entries else None


_PLACES = "array<struct<label:string,base:boolean,start:int,share:double>>"


def _places(words: Column, rare_words: list[str], index: Column) -> Column:
    hits = F.filter(F.transform(words, lambda w, i: F.when(w.isin(rare_words), F.struct(w.alias("w"), i.alias("i")))),
                    lambda h: h.isNotNull())

    def proposed(t: Column) -> Column:
        return F.array_distinct(F.flatten(F.transform(t["rare"], lambda r: F.transform(
            F.filter(hits_of, lambda h: h["w"] == r["w"]), lambda h: h["i"] - r["q"]))))

    def stands(t: Column, start: Column) -> Column:
        agree = F.size(F.filter(t["rare"], lambda r: F.get(words, start + r["q"]) == r["w"])) >= t["need"]
        keys = F.forall(t["keys"], lambda k: F.when(start + k["q"] < 0, F.lit(False)).otherwise(
            F.slice(words, start + k["q"] + 1, F.size(k["words"])) == k["words"]))
        return agree & keys

    def share(t: Column, start: Column) -> Column:
        same = F.filter(t["words"], lambda w, q: F.get(words, start + q) == w)
        return F.size(same) / F.size(t["words"])

    hits_of = F.col("hits")
    found = F.flatten(F.transform(index, lambda t: F.transform(
        F.filter(proposed(t), lambda s: stands(t, s)),
        lambda s: F.struct(t["label"].alias("label"), t["base"].alias("base"), s.alias("start"), share(t, s).alias("share")))))
    return hits, F.when(F.size("hits") > 0, found).otherwise(F.array().cast(_PLACES))


def license_places(docs: DataFrame, templates: Sequence[Template] = TEMPLATES) -> DataFrame:
    """(doc_id, n_words, places): every place where a template stands, with the share of its words found in place."""
    words = docs.select("doc_id", text_words("text").alias("words"))
    idf = {r["word"]: r["idf"] for r in word_frequencies(words, templates).collect()}  # a row per template word at most
    rare_words, index = _index(templates, idf)
    if index is None:  # no template word occurs anywhere
        return words.select("doc_id", F.size("words").cast("long").alias("n_words"), F.array().cast(_PLACES).alias("places"))
    hits, places = _places(F.col("words"), rare_words, index)
    gated = F.when(F.arrays_overlap("words", _strings(rare_words)), hits).otherwise(
        F.array().cast("array<struct<w:string,i:int>>"))
    return (words.withColumn("hits", gated)
            .select("doc_id", F.size("words").cast("long").alias("n_words"), places.alias("places")))


def scan_licenses(docs: DataFrame, templates: Sequence[Template] = TEMPLATES) -> DataFrame:
    """One row per document: places of the base phrases, labels by base and by all templates, and the best share."""
    base = F.filter("places", lambda p: p["base"])

    def joined(places: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")

    starts = F.transform("base_places", lambda p: p["start"].cast("long"))
    return (license_places(docs, templates).withColumn("base_places", base)
            .select("doc_id", "n_words", F.size("base_places").cast("long").alias("n_base"),
                    F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
                    joined(F.col("base_places")).alias("base_labels"), joined(F.col("places")).alias("labels"),
                    F.coalesce(F.array_max(F.transform("places", lambda p: p["share"])), F.lit(0.0)).alias("score")))
