"""License scans: a trained paragraph classifier, confirmed by templates.  DataFrame functions and Spark ML only.

A paragraph is a line, or a line with the two that follow it (to the next blank one), since notices
are wrapped, or with as many as follow until REACH words are read, since some are wrapped narrowly.  Lines
with a part of a word that licence notices are made of (ANCHORS) start a paragraph, and so does every
other line in which three words of a template begin, if its paragraph has the words that some family needs
(RULES): by the rules below no other line can be confirmed, so nothing that has a family is passed over.  It
gets a sparse vector of the word unigrams and bigrams that the training lines have; multinomial logistic regression, trained here on
NOTICES, on NAMES set in FRAMES, on their shortened and extended variants, and on lines that grant
nothing, gives families and their probabilities.  A second, one-dimensional logistic regression turns
the margin of the likeliest into the chance that it is right, fitted on names in frames (HELD_FRAMES)
that the first did not see; under one half the paragraph is ``unknown``.

Among the RIVALS likeliest families the one whose templates share most word trigrams with the
paragraph is taken, if they share enough (CONFIRM), if the paragraph has the words that tell the
family from its neighbours and none of theirs (RULES), and if it does not say that the licence does
not apply (NEGATED); otherwise it is ``unknown``.  A longer paragraph counts only where the shorter
ones of the same line are unknown.  The scope is the families of NAMES; notices of others are unknown.

Defined results: null and empty texts have no lines to classify and give no row; a document gives a
row for each candidate line, equal lines each their own; rows that repeat are repeated; texts are
read whole, a long one by its lines; ties go to the likelier family, then to the later of NAMES.
"""

from __future__ import annotations

import json
import re
from functools import reduce

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ANCHORS = ("licen", "copyright", "copyleft", "warrant", "redistribut", "permission", "permitted", "public domain", "unencumbered", "free software", "source code form", "accompanying materials", "creative commons", "cc by", "cc-by", "cc0", "gpl", " mpl", "mpl-2", " epl", "epl-2", "spdx")
UNKNOWN = "unknown"
#: Share of the shorter side's trigrams that a paragraph and a template must have in common.
CONFIRM = 0.6
RIVALS = 3
WRAPPED = 3

# Names of public licences by family, the article included where a sentence needs one.
NAMES = {
    "apache-2.0": ("the Apache License, Version 2.0", "the Apache 2.0 license", "the Apache License 2.0", "Apache-2.0"),
    "mit": ("the MIT License", "the MIT licence (Expat)", "MIT"),
    "isc": ("the ISC License", "the Internet Systems Consortium (ISC) license", "ISC"),
    "bsd": ("the BSD 3-Clause License", "the BSD 2-Clause License", "a BSD-style license", "the New BSD License", "BSD-3-Clause", "BSD-2-Clause"),
    "zlib": ("the zlib License", "the zlib/libpng license", "Zlib"),
    "boost": ("the Boost Software License, Version 1.0", "BSL-1.0"),
    "gpl-2": ("the GNU General Public License, version 2", "the GNU GPL v2", "the GPLv2", "GPL-2.0-only", "GPL-2.0-or-later"),
    "gpl-3": ("the GNU General Public License, version 3", "the GNU GPL v3", "the GPLv3", "GPL-3.0-only", "GPL-3.0-or-later"),
    "gpl": ("the GNU General Public License", "the GNU GPL", "the GPL"),
    "lgpl": ("the GNU Lesser General Public License", "the GNU Lesser General Public License, version 3", "the GNU Lesser General Public License, version 2.1", "the GNU LGPL v3", "the LGPL", "LGPL-3.0-or-later", "LGPL-2.1-only"),
    "agpl": ("the GNU Affero General Public License", "the GNU Affero General Public License, version 3", "the GNU AGPL v3", "the AGPL", "AGPL-3.0-or-later", "AGPL-3.0-only"),
    "mpl-2.0": ("the Mozilla Public License, version 2.0", "the Mozilla Public License 2.0", "the MPL 2.0", "MPL-2.0"),
    "epl": ("the Eclipse Public License, version 2.0", "the Eclipse Public License 1.0", "the EPL 2.0", "EPL-2.0"),
    "cc-by": ("CC BY 4.0", "CC BY 3.0", "a Creative Commons Attribution 4.0 International License", "the Creative Commons Attribution License", "CC-BY-4.0"),
    "cc-by-sa": ("CC BY-SA 4.0", "CC BY-SA 3.0", "a Creative Commons Attribution-ShareAlike 4.0 International License", "the Creative Commons Attribution-ShareAlike License", "CC-BY-SA-4.0"),
    "cc-by-nd": ("CC BY-ND 4.0", "CC BY-ND 3.0", "a Creative Commons Attribution-NoDerivatives 4.0 International License", "the Creative Commons Attribution-NoDerivatives License", "CC-BY-ND-4.0"),
    "cc-by-nc": ("CC BY-NC 4.0", "CC BY-NC 3.0", "a Creative Commons Attribution-NonCommercial 4.0 International License", "the Creative Commons Attribution-NonCommercial License", "CC-BY-NC-4.0"),
    "cc-by-nc-sa": ("CC BY-NC-SA 4.0", "CC BY-NC-SA 3.0", "a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", "CC-BY-NC-SA-4.0"),
    "cc-by-nc-nd": ("CC BY-NC-ND 4.0", "CC BY-NC-ND 3.0", "a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License", "CC-BY-NC-ND-4.0"),
    "cc0": ("CC0 1.0", "the CC0 1.0 Universal Public Domain Dedication", "CC0-1.0"),
    "unlicense": ("the Unlicense", "Unlicense"),
}
FRAMES = ("Licensed under {}.", "This work is licensed under {}.", "Released under {}.", "This software is distributed under the terms of {}.", "SPDX-License-Identifier: {}", "{} applies to this file; see the license for details.")
HELD_FRAMES = ("This project is covered by {}; see the license file.", "License: {}", "The source code is available under {}.", "Published under the terms of {}.")
IDLE_FRAMES = ("This project is not released under {}.", "We compared {} with other licenses last year.", "The lecture was about {} and its history.")

# Wording of public licence notices by family; the last family has lines that grant nothing.
NOTICES = {
    "apache-2.0": ('Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.', "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    "mit": ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",),
    "isc": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "bsd": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    "zlib": ("Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely",),
    "boost": ("Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", "Distributed under the Boost Software License, Version 1.0."),
    "gpl-2": ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",),
    "gpl-3": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",),
    "gpl": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",),
    "lgpl": ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",),
    "agpl": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",),
    "mpl-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "epl": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",),
    "cc0": ("To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0.", "This work has been dedicated to the public domain."),
    "unlicense": ("This is free and unencumbered software released into the public domain.",),
    UNKNOWN: (
        "Copyright reserved by the author, all rights reserved.",
        "The driver lost his license after the accident on the road.",
        "A warranty of two years is given by the shop for this device.",
        "Please read the license terms before you install the product.",
        "The city council discussed license fees for restaurants and bars.",
        "No license is granted by this page and no permission is given.",
        "Licensed premises must close at midnight under the new act.",
        "The court held that copyright had not been infringed by the paper.",
        "Fishing licenses are sold at the harbour office every morning.",
        "Licensed under an agreement between the two parties.",
        "Licensed under a commercial license of the company.",
        "He released the record under another name the year before.",
        "Redistribution of income was the topic of the public lecture.",
        "Parking is permitted on this side of the road until noon.",
        "The general public was not admitted to the hearing without permission.",
        "The software is proprietary and may not be copied without permission.",
    ),
}

# Words that tell a family from its neighbours; of each group one must stand in the paragraph, and none of the barred.
_NC, _SA, _ND = ("nc", "noncommercial", "commercial"), ("sa", "sharealike", "alike"), ("nd", "noderivatives", "noderivs", "derivatives")
_THREE, _TWO, _WEAK, _WEB = ("3", "v3", "gplv3"), ("2", "v2", "gplv2"), ("lesser", "lgpl", "library"), ("affero", "agpl")
_GENERAL = ("general", "gpl", "gplv2", "gplv3")
RULES = {
    "apache-2.0": ((("apache",),), ()),
    "mit": ((("mit", "expat", "associated"),), ()),
    "isc": ((("isc", "internet", "fee"),), ()),
    "bsd": ((("bsd", "binary"),), ()),
    "zlib": ((("zlib", "anyone"),), ()),
    "boost": ((("boost", "bsl", "organization"),), ()),
    "gpl-2": ((_GENERAL, _TWO), (*_WEAK, *_WEB, *_THREE)),
    "gpl-3": ((_GENERAL, _THREE), (*_WEAK, *_WEB, *_TWO)),
    "gpl": ((_GENERAL,), (*_WEAK, *_WEB, *_TWO, *_THREE)),
    "lgpl": ((("lesser", "lgpl"),), _WEB),
    "agpl": ((_WEB,), ("lesser", "lgpl")),
    "mpl-2.0": ((("mozilla", "mpl"),), ()),
    "epl": ((("eclipse", "epl"),), ()),
    "cc-by": ((("by", "attribution"),), (*_NC, *_SA, *_ND)),
    "cc-by-sa": ((_SA,), (*_NC, *_ND)),
    "cc-by-nd": ((_ND,), (*_NC, *_SA)),
    "cc-by-nc": ((_NC,), (*_SA, *_ND)),
    "cc-by-nc-sa": ((_NC, _SA), _ND),
    "cc-by-nc-nd": ((_NC, _ND), _SA),
    "cc0": ((("cc0", "dedicated", "waived"),), ()),
    "unlicense": ((("unlicense", "unencumbered"),), ()),
    UNKNOWN: ((), ()),
}
#: In the paragraph's words: the licence is named and denied.
NEGATED = r"(^| )(not|never|nor|neither|cannot|longer|nicht|pas) ([a-z]+ ){0,2}(licen[sc]ed|released|distributed|available|covered|governed|offered|published|dedicated|under)( |$)"
FILLER = ("please", "see", "below", "project", "file", "data", "text", "author", "note", "this")
FAMILIES = (*NAMES, UNKNOWN)


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def anchored(text: Column) -> Column:
    # as the one element of an array, the text is lower-cased once and not again for each anchor
    return F.exists(F.array(F.lower(text)), lambda low: reduce(Column.__or__, (low.contains(a) for a in ANCHORS)))


def _grams(tokens: Column, n: int) -> Column:
    """Joined runs of n tokens (none if there are fewer)."""
    last = F.size(tokens) - n
    runs = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.array_join(F.slice(tokens, i + 1, F.lit(n)), " "))
    return F.when(last >= 0, runs).otherwise(F.array().cast("array<string>"))


def templates() -> list[tuple[int, str]]:
    """(label, wording) of everything that a family is confirmed by."""
    named = [(i, frame.format(name)) for i, f in enumerate(FAMILIES) for name in NAMES.get(f, ()) for frame in FRAMES]
    return named + [(i, text) for i, f in enumerate(FAMILIES) for text in NOTICES.get(f, ())]


def python_grams(text: str, n: int) -> list[str]:
    """Runs of n words of a constant."""
    found = [w for w in re.split(r"[\W_]+", text.lower()) if w]
    return [" ".join(found[i : i + n]) for i in range(len(found) - n + 1)]


#: Words after which no further line is read: twice those of the longest template.
REACH = 2 * max(len(python_grams(t, 1)) for _, t in templates())


def _literal(value, kind: str) -> Column:
    """A nested constant; Spark folds it into one literal."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def _featured(rows: DataFrame, tokens: str, features: str) -> DataFrame:
    """rows with the vector of a column of tokens."""
    terms = rows.withColumn("terms", F.concat(tokens, _grams(F.col(tokens), 2)))
    known = sorted({g for line in _lines() for n in (1, 2) for g in python_grams(line[1], n)})
    return CountVectorizerModel.from_vocabulary(known, "terms", features).setBinary(True).setMinTF(1.0).transform(terms).drop("terms")


def _lines() -> list[tuple[float, str, bool]]:
    """(label, line, held): templates, names in frames, and lines that grant nothing; held ones only calibrate."""
    rows = [(float(i), t, False) for i, t in templates()]
    rows += [(float(i), frame.format(name), True) for i, f in enumerate(NAMES) for name in NAMES[f] for frame in HELD_FRAMES]
    return rows + [(float(len(FAMILIES) - 1), frame.format(names[0]), k == 1) for names in NAMES.values() for k, frame in enumerate(IDLE_FRAMES)]


def _training(spark: SparkSession) -> DataFrame:
    """_lines() as (label, tokens, held)."""
    constant = _literal([{"label": i, "notice": t, "held": h} for i, t, h in _lines()], "array<struct<label:double,notice:string,held:boolean>>")
    return spark.range(1).select(F.explode(constant).alias("x")).select("x.label", words(F.col("x.notice")).alias("tokens"), "x.held")


def _variants(notices: DataFrame) -> DataFrame:
    """Each notice as it is, cut at either end, between foreign words, and without one word."""
    n, t, k = F.size("tokens"), F.col("tokens"), F.col("k")
    filler = F.array(*map(F.lit, FILLER))
    gone = F.pmod(F.xxhash64("label", "tokens", "k"), n).cast("int")
    changed = (
        F.when(k == 0, t)
        .when(k == 1, F.slice(t, F.lit(1), F.ceil(n * 0.75).cast("int")))
        .when(k == 2, F.slice(t, F.floor(n * 0.25).cast("int") + 1, n))
        .when(k == 3, F.concat(F.slice(filler, 6, 4), t, F.slice(filler, 1, 2)))
        .otherwise(F.concat(F.slice(t, F.lit(1), F.greatest(gone, F.lit(0))), F.slice(t, gone + 2, n)))
    )
    return notices.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(4)))).select("label", changed.alias("tokens"), "held")


def _margin(probability: Column) -> Column:
    top = F.array_max(probability)
    return F.ln(F.greatest(top, F.lit(1e-9)) / F.greatest(1 - top, F.lit(1e-9)))


_TRAINED: dict[str, tuple[LogisticRegressionModel, float, float]] = {}


def train(spark: SparkSession) -> tuple[LogisticRegressionModel, float, float]:
    """The classifier, and slope and offset of the calibration; fitted once for each application, on the constants above."""
    name = spark.sparkContext.applicationId
    if name not in _TRAINED:
        rows = _featured(_variants(_training(spark)), "tokens", "features").coalesce(1).cache()
        model = LogisticRegression(family="multinomial", regParam=0.001, maxIter=20).fit(rows.where("not held"))
        said = model.transform(rows.where("held")).select(vector_to_array("probability").alias("p"), "label", "prediction")
        # what is right: the family, where there is one; lines that grant nothing are never right
        right = (F.col("label") == F.col("prediction")) & (F.col("label") != len(FAMILIES) - 1)
        judged = VectorAssembler(inputCols=["margin"], outputCol="features").transform(said.select(_margin(F.col("p")).alias("margin"), right.cast("double").alias("label")))
        scaled = LogisticRegression(regParam=0.01).fit(judged)
        rows.unpersist()
        _TRAINED[name] = model, float(scaled.coefficients[0]), float(scaled.intercept)
    return _TRAINED[name]


def _judge(rows: DataFrame, tokens: str, verdict: str) -> DataFrame:
    """rows with ``verdict``: struct<guess, probability, similarity, family> of a column of tokens."""
    model, slope, offset = train(rows.sparkSession)
    bank = [{"label": i, "grams": sorted(set(python_grams(t, 3)))} for i, t in templates()]
    bank = _literal([t for t in bank if t["grams"]], "array<struct<label:int,grams:array<string>>>")
    rules = _literal([{"needs": RULES[f][0], "bars": RULES[f][1]} for f in FAMILIES], "array<struct<needs:array<array<string>>,bars:array<string>>>")
    family = F.array(*map(F.lit, FAMILIES))
    scored = model.copy().setFeaturesCol("features").setProbabilityCol("probability").setRawPredictionCol("raw").setPredictionCol("prediction").transform(_featured(rows, tokens, "features"))
    scored = scored.select(*rows.columns, vector_to_array("probability").alias("p"), F.array_distinct(_grams(F.col(tokens), 3)).alias("grams"))

    def alike(label: Column) -> Column:
        own = F.filter(bank, lambda t: t["label"] == label)
        shares = F.transform(own, lambda t: F.size(F.array_intersect("grams", t["grams"])) / F.greatest(F.lit(1), F.least(F.size("grams"), F.size(t["grams"]))))
        return F.coalesce(F.array_max(shares), F.lit(0.0))

    rivals = F.slice(F.reverse(F.array_sort(F.transform("p", lambda x, i: F.struct(x.alias("p"), i.alias("label"))))), 1, RIVALS)
    closest = F.array_max(F.transform(rivals, lambda r: F.struct(F.round(alike(r["label"]), 6).alias("similarity"), r["p"].alias("p"), r["label"].alias("label"))))
    scored = scored.withColumns({"closest": closest, "guess": F.get(family, F.array_position("p", F.array_max("p")).cast("int") - 1), "chance": 1 / (1 + F.exp(-(_margin(F.col("p")) * slope + offset)))})
    rule, held = F.get(rules, F.col("closest.label")), F.col(tokens)
    told = F.forall(rule["needs"], lambda some: F.arrays_overlap(held, some)) & ~F.arrays_overlap(held, rule["bars"]) & ~F.array_join(held, " ").rlike(NEGATED)
    sure = (F.col("chance") >= 0.5) & (F.col("closest.similarity") >= CONFIRM) & told
    out = F.struct("guess", F.round("chance", 6).alias("probability"), F.col("closest.similarity").alias("similarity"), F.when(sure, F.get(family, F.col("closest.label"))).otherwise(UNKNOWN).alias("family"))
    return scored.select(*rows.columns, out.alias(verdict))


def _may_be_told(tokens: Column) -> Column:
    """Whether a paragraph has the words that some family needs."""
    rules = _literal([RULES[f][0] for f in NAMES], "array<array<array<string>>>")
    return F.exists(rules, lambda needs: F.forall(needs, lambda some: F.arrays_overlap(tokens, some)))


def _pattern(grams: list[str]) -> str:
    """Runs of words as a regular expression in the form of a tree, so that a text is left at the first letter that no run goes on with."""
    tree: dict = {}
    for gram in grams:
        at = tree
        for c in f"{gram}$":
            at = at.setdefault(c, {})

    def told(at: dict) -> str:
        ways = [{"$": r"(?![\p{L}\p{N}])", " ": r"[^\p{L}\p{N}]+"}.get(c, c) + told(below) for c, below in sorted(at.items())]
        return ways[0] if len(ways) == 1 else f"(?:{'|'.join(ways)})" if ways else ""

    return r"(?<![\p{L}\p{N}])" + told(tree)


def _worded(text: Column) -> Column:
    """Whether three words of a template stand in a row."""
    return F.lower(text).rlike(_pattern(sorted({g for _, t in templates() for g in python_grams(t, 3)})))


def _starts(docs: DataFrame) -> DataFrame:
    """(doc_id, at, tokens, few, more, read): the candidate lines; few has the words of WRAPPED lines, more those of ``read`` lines."""
    split = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("at"), words(x).alias("w"), anchored(x).alias("named"), (F.btrim(x, F.lit(" \t\r\f\v")) == "").alias("blank")))
    # lines of marks alone have no words and end no paragraph
    lines = docs.where(anchored(F.col("text")) | _worded(F.col("text"))).select("doc_id", F.filter(split, lambda x: x["blank"] | (F.size(x["w"]) > 0)).alias("lines"))
    none = F.array().cast("array<string>")

    def runs_on(x: Column, k: Column) -> Column:
        """The words of a line and the two that follow them."""
        after = [F.coalesce(F.get("lines", k + i)["w"], none) for i in (1, 2)]
        return F.concat(x["w"], F.slice(F.concat(*after), 1, 2))

    def read_on(x: Column, k: Column) -> Column:
        first = F.struct(x["at"].alias("at"), x["named"].alias("named"), x["w"].alias("tokens"), x["w"].alias("few"), x["w"].alias("more"), F.lit(1).alias("read"), F.lit(True).alias("open"))

        def add(held: Column, y: Column) -> Column:
            on, how_far = held["open"] & ~y["blank"] & (F.size(held["more"]) < REACH), y["at"] - x["at"] + 1
            few = F.when(on & (how_far <= WRAPPED), F.concat(held["few"], y["w"])).otherwise(held["few"])
            more = F.when(on, F.concat(held["more"], y["w"])).otherwise(held["more"])
            return F.struct(held["at"].alias("at"), held["named"].alias("named"), held["tokens"].alias("tokens"), few.alias("few"), more.alias("more"), F.when(on, how_far).otherwise(held["read"]).alias("read"), on.alias("open"))

        return F.aggregate(F.slice("lines", k + 2, F.lit(REACH)), first, add)

    found = F.transform("lines", lambda x, k: F.when(x["named"] | _worded(F.array_join(runs_on(x, k), " ")), read_on(x, k)))
    starts = lines.select("doc_id", F.explode(F.array_compact(found)).alias("x")).select("doc_id", "x.*")
    return starts.where(F.col("named") | _may_be_told(F.col("more"))).drop("named", "open")


def scan(docs: DataFrame) -> DataFrame:
    """One row a candidate line: doc_id, paragraph (the line, from 0), lines (1, WRAPPED, or as many as were read), guess, probability, similarity, family."""
    judged = _starts(docs)
    for tokens, verdict in (("tokens", "one"), ("few", "several"), ("more", "whole")):
        judged = _judge(judged, tokens, verdict)
    known = lambda verdict: F.col(f"{verdict}.family") != UNKNOWN
    lines = lambda n, verdict: F.struct(n.cast("int").alias("lines"), F.col(verdict).alias("x"))
    one = lines(F.lit(1), "one")
    best = F.when(known("one"), one).when(known("several"), lines(F.lit(WRAPPED), "several")).when(known("whole"), lines(F.col("read"), "whole")).otherwise(one)
    chosen = judged.select("doc_id", F.col("at").alias("paragraph"), best.alias("b"))
    return chosen.select("doc_id", "paragraph", "b.lines", "b.x.guess", "b.x.probability", "b.x.similarity", "b.x.family")
