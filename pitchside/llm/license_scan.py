"""License scans: a positional index of licence templates, entered by each file's rarest licence words.

DataFrame operations only. A template is a word sequence with a mandatory key phrase.
One pass counts in how many files each template word stands; the word of a key phrase with
the highest inverse document frequency becomes that phrase's entry in the postings. The scan
then takes each file's entry words with their places, looks their postings up, shifts each
place to where the template would begin, and keeps a place only if the whole key phrase stands
there word by word. The other words of the template, met at their relative positions, give the
score. Postings, templates and frequencies have the size of the template list, never of the
data; texts are not shuffled.

Edge cases: null text has no words, no labels and score 0; repeated words give every place;
places may overlap; a file without licence words has null first and last; frequencies over an
empty table are all equal and the result is empty; input columns beside id and text are kept out.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, table

#: A word of a lower-cased text: letters a-z, digits, and everything beyond ASCII.
TERM = r"[a-z[0-9[\x{80}-\x{10FFFF}]]]++"


@dataclass(frozen=True)
class Template:
    """``lead`` + ``phrase`` + ``tail`` is the usual wording; ``phrase`` is mandatory."""

    label: str
    phrase: str
    lead: str = ""
    tail: str = ""
    base: bool = False


#: Phrases fixed by the contract.
BASE = (
    Template("mit", "under the mit license", lead="released", base=True),
    Template("apache-2", "apache license version 2", lead="licensed under the", tail="0", base=True),
    Template("cc-by-nc", "cc by nc", lead="licensed under", tail="4 0", base=True),
)
TEMPLATES = BASE + (
    Template("gpl-3", "gnu general public license version 3", lead="this work is licensed under the"),
    Template("gpl-2", "gnu general public license version 2", lead="this work is licensed under the"),
    Template("lgpl", "gnu lesser general public license", lead="under the terms of the"),
    Template("agpl-3", "gnu affero general public license", lead="under the terms of the", tail="version 3"),
    Template("mpl-2", "mozilla public license", lead="subject to the terms of the", tail="v 2 0"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy", tail="of this software"),
    Template("mit", "spdx license identifier mit"),
    Template("apache-2", "spdx license identifier apache 2 0"),
    Template("bsd", "redistribution and use in source and binary forms", tail="with or without modification"),
    Template("cc-by-nc", "creative commons attribution noncommercial", lead="licensed under a", tail="4 0 international license"),
    Template("cc-by-sa", "cc by sa", lead="licensed under", tail="4 0"),
    Template("cc0", "cc0 1 0 universal", lead="licensed under"),
)


def _strings(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def terms(text: Column) -> Column:
    """The words of a text, A-Z lower-cased.

    ``lower`` is much faster than a character map and differs from it only beyond ASCII, where
    words are neither cut nor matched; the two characters that it turns into ASCII letters go
    through the map instead.
    """
    text = F.coalesce(text, F.lit(""))
    low = F.when(F.contains(text, F.lit("\u212a")) | F.contains(text, F.lit("\u0130")), ascii_lower(text)).otherwise(F.lower(text))
    return F.regexp_extract_all(low, F.lit(TERM), F.lit(0))


def term_idf(docs: DataFrame, vocabulary: Sequence[str], text_col: str = "text") -> dict[str, float]:
    """ln((files + 1) / (files with the word + 1)) over all files, for the template words alone."""
    held = F.explode(F.concat(F.array_intersect(terms(F.col(text_col)), _strings(vocabulary)), _strings([""])))
    rows = {r["term"]: r["n"] for r in docs.select(held.alias("term")).groupBy("term").agg(F.count("*").alias("n")).collect()}
    files = rows.get("", 0)
    return {w: math.log((files + 1) / (rows.get(w, 0) + 1)) for w in vocabulary}


def scan_licenses(docs: DataFrame, templates: Sequence[Template] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per file: id, n_words, places (label, base, start, n_words, coverage of each verified key phrase)."""
    phrases = [t.phrase.split() for t in templates]
    wordings = [[*t.lead.split(), *t.phrase.split(), *t.tail.split()] for t in templates]
    vocabulary = sorted({w for p in wordings for w in p})
    idf = term_idf(docs, vocabulary, text_col)

    postings: dict[str, list[tuple[int, int]]] = {}
    for k, phrase in enumerate(phrases):
        at = max(range(len(phrase)), key=lambda i: (idf[phrase[i]], -i))
        postings.setdefault(phrase[at], []).append((k, at))
    entry = sorted(postings)
    index = F.create_map(*[x for w in entry for x in (F.lit(w), F.array(*[
        F.struct(F.lit(k).alias("t"), F.lit(at).alias("at")) for k, at in postings[w]]))])
    rows = F.array(*[F.struct(
        F.lit(t.label).alias("label"), F.lit(t.base).alias("base"), _strings(phrase).alias("phrase"),
        _strings(wording).alias("wording"), F.lit(len(t.lead.split())).alias("lead"),
        F.array(*[F.lit(max(idf[w], 1e-9)) for w in wording]).alias("idf"))
        for t, phrase, wording in zip(templates, phrases, wordings, strict=True)])

    words = docs.select(F.col(id_col).alias("doc_id"), terms(F.col(text_col)).alias("words"))
    places = F.array_compact(F.transform("words", lambda w, i: F.when(w.isin(entry), i)))

    def verified(c: Column) -> Column:
        t = F.get(F.col("templates"), c["t"])
        met = F.transform(t["wording"], lambda w, k: F.when(F.get(F.col("words"), c["start"] - t["lead"] + k) == w, F.get(t["idf"], k)).otherwise(0.0))
        total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
        return F.struct(t["label"].alias("label"), t["base"].alias("base"), c["start"].cast("long").alias("start"),
                        F.size(t["phrase"]).alias("n_words"), F.least(F.lit(1.0), total(met) / total(t["idf"])).alias("coverage"))

    def stands(c: Column) -> Column:
        t = F.get(F.col("templates"), c["t"])
        return (c["start"] >= 0) & (F.slice("words", F.greatest(c["start"], F.lit(0)) + 1, F.size(t["phrase"])) == t["phrase"])

    looked = F.flatten(F.transform(places, lambda i: F.transform(
        F.element_at(index, F.get(F.col("words"), i)), lambda p: F.struct(p["t"].alias("t"), (i - p["at"]).alias("start")))))
    found = words.withColumn("templates", rows).withColumn("cands", looked)
    return found.select("doc_id", F.size("words").cast("long").alias("n_words"), F.transform(F.filter("cands", stands), verified).alias("places"))


def op3_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = scan_licenses(table(spark, sf_dir, "documents"))
    base = F.filter("places", lambda p: p["base"])
    starts = F.transform(base, lambda p: p["start"])
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(F.transform(a, lambda p: p["label"]))), ",")
    return scanned.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), joined(base).alias("base_labels"), joined(F.col("places")).alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda p: p["coverage"])), F.lit(0.0)).alias("score"))
