"""Licence families of paragraphs: a logistic regression over word pairs and triples, confirmed against templates.

A paragraph is a line. The model is trained by gradient steps on the driver from a small labelled table; scoring is DataFrame expressions only, without a shuffle. A paragraph without any known word
pair is unknown by definition, and so needs no score. The cut-off for unknown is calibrated on the labelled table:
half-way between the surest foreign paragraph and the least sure right one.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skirmish.llm.common import whole_text

# The customary wordings of licence notices.
TEMPLATES = {
    "apache": ["licensed under the apache license version 2.0", "you may not use this file except in compliance with the license", "apache license version 2.0 january 2004"],
    "mit": ["released under the mit license", "licensed under the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software"],
    "gpl": ["licensed under the gnu general public license version 3", "under the terms of the gnu general public license as published by the free software foundation", "this work is licensed under the gnu general public license version 2"],
    "bsd": ["licensed under the bsd 3 clause license", "redistribution and use in source and binary forms with or without modification are permitted", "released under the bsd license"],
    "cc": ["licensed under cc by nc 4.0", "licensed under cc by sa 4.0", "licensed under a creative commons attribution 4.0 international license", "this work is licensed under cc by 4.0"],
    "mpl": ["subject to the terms of the mozilla public license v 2.0", "licensed under the mozilla public license version 2.0"],
}
OTHER = [
    "the driver needs a license to drive the car", "this work is the best of the year", "a license is hereby granted to hunt in the woods", "you may not use this file on the train",
    "the general public is free to visit the museum", "version 2.0 of the program is slower", "copy of this letter was sent to any person in the house", "the apache lived in the south west",
    "she studied at mit in boston", "all rights reserved by the owner", "licensed under the laws of the state", "released under the bridge at night", "the terms of the contract were published by the foundation",
]
NONE = "unknown"


def labelled(spark: SparkSession) -> DataFrame:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    rows = [(family, t) for family, ts in TEMPLATES.items() for t in ts] + [(NONE, t) for t in OTHER]
    return spark.sql("SELECT * FROM VALUES " + ", ".join(f"({quote(f)}, {quote(t)})" for f, t in rows) + " AS t(family, text)")


def words_of(text: Column) -> Column:
    """Lower-case words of letters, digits and inner dots."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}.]+|\.(?![0-9])", " "), " +"), lambda w: w != "")


def grams(words: Column, n: int) -> Column:
    """The runs of ``n`` words, linear in the words."""
    out = words
    for i in range(2, n + 1):
        out = F.filter(F.zip_with(out, F.slice(words, F.lit(i), F.size(words)), lambda a, b: F.concat(a, F.lit(" "), b)), lambda g: g.isNotNull())
    return out


def once(column: Column) -> Column:
    """A generator of one row: filters are not pushed below it, so the expression is evaluated once."""
    return F.explode(F.array(column))


class Model:
    """Weights of the word n-grams for each family, as plain numbers, and the calibrated cut-off."""

    def __init__(self, table: DataFrame):
        words = words_of(F.col("text"))
        rows = table.withColumn("words", words).withColumn("grams", F.array_distinct(F.concat(grams(F.col("words"), 2), grams(F.col("words"), 3))))
        known = [(r["family"], r["grams"]) for r in rows.select("family", "grams").collect()]  # the labelled table is small
        self.families, self.vocabulary = sorted({f for f, _ in known} | {NONE}), sorted({g for _, gs in known for g in gs})
        place = {g: i for i, g in enumerate(self.vocabulary)}
        holds, gold = np.zeros((len(known), len(place) + 1)), np.zeros((len(known), len(self.families)))
        for r, (family, gs) in enumerate(known):
            holds[r, [place[g] for g in gs]], holds[r, -1], gold[r, self.families.index(family)] = 1, 1, 1
        weights = np.zeros((len(place) + 1, len(self.families)))
        for _ in range(500):
            sure = np.exp(np.einsum("rf,fc->rc", holds, weights))
            slope = np.einsum("rf,rc->fc", holds, gold - sure / sure.sum(axis=1, keepdims=True)) / max(1, len(known))
            weights += 0.5 * (slope - 0.001 * weights)
        self.weights, self.start = weights[:-1].tolist(), weights[-1].tolist()
        scored = rows.withColumn("scores", self.scores(F.col("grams")))
        family, sure = self.best(F.col("scores"))
        scored = scored.select("family", sure.alias("sure"), family.alias("best"))
        foreign = F.max(F.when(F.col("family") == NONE, F.col("sure")))
        right = F.min(F.when((F.col("family") != NONE) & (F.col("family") == F.col("best")), F.col("sure")))
        low, high = scored.agg(foreign, right).first()
        self.cut = ((low or 0.0) + (1.0 if high is None else high)) / 2

    def scores(self, found: Column) -> Column:
        known = F.map_from_arrays(F.lit(self.vocabulary), F.array(*[F.lit(w) for w in self.weights]))
        each = F.array_intersect(found, F.lit(self.vocabulary))
        start = F.lit([float(s) for s in self.start])
        return F.aggregate(each, start, lambda sums, g: F.zip_with(sums, F.element_at(known, g), lambda a, b: a + b))

    def best(self, scores: Column) -> tuple[Column, Column]:
        """The most likely family other than unknown, and its probability among all classes."""
        named = [(f, F.element_at(scores, i + 1)) for i, f in enumerate(self.families)]
        family = F.greatest(*[F.struct(s.alias("score"), F.lit(f).alias("family")) for f, s in named if f != NONE])
        whole = sum(F.exp(s - F.array_max(scores)) for _, s in named)
        return family["family"], F.exp(family["score"] - F.array_max(scores)) / whole


def licence_paragraphs(docs: DataFrame, table: DataFrame | None = None, confirm: float = 0.6, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, paragraph, family, probability, confirmed`` for each line with a licence; lines of unknown kind have no row.

    ``confirmed``: at least ``confirm`` of the word pairs of a template of the family stand in the line. Null and empty
    texts have no lines; null ids and repeated rows keep theirs; other columns are not read; whole texts are scanned.
    """
    model = Model(labelled(docs.sparkSession) if table is None else table)
    lines = docs.select(F.col(id_column).alias("doc_id"), F.posexplode(F.split(whole_text(text_column), "\n")).alias("paragraph", "line"))
    words = lines.select("doc_id", "paragraph", once(words_of(F.col("line"))).alias("words"))
    pairs = words.select("*", once(grams(F.col("words"), 2)).alias("pairs"))
    two = [g for g in model.vocabulary if g.count(" ") == 1]
    gated = pairs.where(F.arrays_overlap("pairs", F.lit(two)))
    scored = gated.select("*", once(model.scores(F.array_distinct(F.concat("pairs", grams(F.col("words"), 3))))).alias("scores"))
    family, sure = model.best(F.col("scores"))
    found = scored.withColumns({"family": family, "probability": sure}).where(F.col("probability") > model.cut)
    confirmed = F.lit(False)
    for name, texts in TEMPLATES.items():
        for text in texts:
            words = text.split()
            template = sorted({f"{a} {b}" for a, b in zip(words, words[1:])})
            share = F.size(F.array_intersect("pairs", F.lit(template))) / len(template)
            confirmed = confirmed | ((F.col("family") == name) & (share >= confirm))
    return found.select("doc_id", F.col("paragraph").cast("long").alias("paragraph"), "family", F.round("probability", 4).alias("probability"), confirmed.alias("confirmed"))
