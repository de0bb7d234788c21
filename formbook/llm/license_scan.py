"""License scans: TF-IDF cosine to templates, and inheritance down the path.

A text's segments are its lines and its paragraphs, as far as they hold an anchor word
(every template has one). Segment and template are sparse TF-IDF vectors over words;
document frequencies are counted over all documents, and a word that fewer than one in
``RARE`` have weighs as if so many had it. The best template from ``THRESHOLD`` on is the
segment's license, unless the segment names a rival: another version, or a word that
tells licences of one family apart (lesser, affero, noncommercial). Whole texts are
compared with whole licences; from ``FILE_THRESHOLD`` on the document is a licence file.

A licence file speaks for its directory and all below. So does a file with a header
whose base name says so (LICENSE, COPYING); a header in any other file, be it the whole
of it, speaks for that file only. A document without a header inherits from the nearest
directory above it.

Directories are resolved once each, by joining all their ancestors with those that
hold a licence file, so documents take part in one join on their directory.

Null text counts as empty: it has no license of its own but can inherit. A null path
has no directory. Of several licence files in a directory the best match counts,
then the smaller name; of templates that match equally well the first. Rows with the
same id are scanned each. Texts of any length are scanned whole, in a task's slice or
alone. An empty table gives an empty result. Kept columns that clash with results
(license, how, cosine) must be renamed by the caller; others stay out of the way.
"""

from __future__ import annotations

import math
import pkgutil
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formbook.llm.arrow import append_columns, text_slices
from formbook.llm.graph import stored

THRESHOLD = 0.6
# Cosine from which a whole text is a licence file, not a text with a header.
FILE_THRESHOLD = 0.85
# A word that fewer than one in so many documents have (a name, mostly) weighs as if so
# many had it, so a score does not fall as the table grows.
RARE = 100

# Header texts of public licenses by SPDX name.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "Licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, ISC License"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "Released under CC0 1.0, public domain dedication license."),
    ("Unlicense", "This is free and unencumbered software released into the public domain, unlicense."),
)
# Words that tell the licences of a family apart: one that has a mark is none without it,
# and the other way round.
MARKS = {
    "GNU": {"LGPL": ("lesser", "library"), "AGPL": ("affero",)},
    "CC": {"NC": ("nc", "noncommercial"), "SA": ("sa", "sharealike"), "ND": ("nd", "noderivatives", "noderivs")},
    "BSD": {},
}
# In the conditions of a BSD licence, what only the one of three clauses says.
THIRD_CLAUSE = ("endorse",)

# Whole licences, for whole documents only.
WHOLE = (
    "MIT", "Apache-2.0", "GPL-3.0", "GPL-2.0", "LGPL-3.0", "LGPL-2.1", "MPL-2.0", "BSD-3-Clause", "BSD-2-Clause", "ISC", "CC0-1.0",
)


def _whole_texts() -> tuple[tuple[str, str], ...]:
    texts = {name: pkgutil.get_data("formbook.llm", f"licences/{name}.txt").decode() for name in WHOLE}
    # The Affero license is the general one under another name but for a section.
    affero = re.sub(r"(?i)(?<!Affero )General\s+Public\s+License", "Affero General Public License", texts["GPL-3.0"])
    return (*texts.items(), ("AGPL-3.0", affero))


WHOLE_TEXTS = _whole_texts()

_WORDS = re.compile(r"[^\W_]+")
_ANCHOR = re.compile(r"(?i)licen[cs]e|permission|redistribution|public domain")


def words(text: str) -> list[str]:
    return _WORDS.findall(text.lower())


def family(name: str) -> str:
    if name.split("-")[0] in ("GPL", "LGPL", "AGPL"):
        return "GNU"
    return name.split("-")[0] if name.split("-")[0] in ("CC", "BSD") else name


def marks(name: str) -> dict[str, bool]:
    """Per mark of the licence's family, whether it is in the name."""
    return {m: m in name.split("-") for m in MARKS.get(family(name), {})}


_VERSION = re.compile(r"(?i)\bv(?:ersion|\.)?[\s.]*(\d+(?:\.\d+)*)|\b(\d+\.\d+)\b|\b(\d)-clause")


def versions(segment: str) -> set[str]:
    """The numbers a segment gives as versions: 2.0 and 2 are one."""
    found = (a or b or c for a, b, c in _VERSION.findall(segment))
    return {re.sub(r"(\.0)+$", "", v) for v in found}


def own_version(name: str) -> str | None:
    number = re.search(r"-(\d+(?:\.\d+)?)(?:-Clause)?$", name)
    return re.sub(r"\.0$", "", number.group(1)) if number else None


def is_rival(name: str, segment_words: set[str], stated: set[str]) -> bool:
    """Does the segment say that it is another licence than ``name``?"""
    for mark, has in marks(name).items():
        if has == segment_words.isdisjoint(MARKS[family(name)][mark]):
            return True
    mine = own_version(name)
    return mine is not None and bool(stated) and mine not in stated


def _own_words() -> list[frozenset[str] | None]:
    """Per template the words that no header of another family has (none: None)."""
    out: list[frozenset[str] | None] = []
    for name, t in TEMPLATES:
        others = (words(x) for other, x in TEMPLATES if family(other) != family(name))
        out.append(frozenset(words(t)).difference(*others) or None)
    return out


# Of these a segment must have one: other words alone name no license.
OWN_WORDS = _own_words()
VOCABULARY = frozenset(w for _, t in (*TEMPLATES, *WHOLE_TEXTS) for w in words(t))


def document_frequencies(docs: DataFrame, text: str = "text") -> tuple[int, dict[str, int]]:
    """Number of documents, and of those with each template word and each other word
    that at least one in ``RARE`` documents has; exact, over all documents."""

    def batch(seen):
        counts = [*seen.items()]
        return pa.RecordBatch.from_arrays(
            [pa.array([w for w, _ in counts], pa.string()), pa.array([n for _, n in counts], pa.int64())], ["word", "n"]
        )

    def run(batches):
        seen = Counter()
        for _, texts in text_slices(batches, text):
            seen[""] += len(texts)
            for t in texts:
                seen.update(set(words(t)))
            if len(seen) > 200_000:
                yield batch(seen)
                seen.clear()
        yield batch(seen)

    counts = stored(docs.select(text).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "license-words")
    n_docs = sum(r["n"] for r in counts.where("word = ''").collect())
    # As many rows as the templates have words, and at most RARE for each of the
    # different words that a document has on average.
    kept = counts.where((F.col("n") * RARE >= n_docs) | F.col("word").isin(sorted(VOCABULARY))).where("word <> ''")
    return n_docs, {r["word"]: r["n"] for r in kept.collect()}


class Matcher:
    """The best template of a text's segments."""

    def __init__(self, n_docs: int, frequencies: dict[str, int]):
        # No word but a template's weighs more than one in RARE documents.
        self.rare = math.log(1 + min(n_docs, RARE)) or 1.0
        counts = dict.fromkeys(VOCABULARY, 1) | frequencies
        self.idf = {w: math.log(1 + n_docs / max(1, n)) or 1.0 for w, n in counts.items()}
        self.templates = [(name, self.vector(words(t))) for name, t in TEMPLATES]
        self.wholes = [(name, self.vector(words(t))) for name, t in WHOLE_TEXTS]

    def vector(self, found: list[str]) -> dict[str, float]:
        weights = {w: n * self.idf.get(w, self.rare) for w, n in Counter(found).items()}
        norm = math.sqrt(sum(v * v for v in weights.values())) or 1.0
        return {w: v / norm for w, v in weights.items()}

    def cosine(self, template: dict[str, float], mine: dict[str, float]) -> float:
        return sum(v * mine.get(w, 0.0) for w, v in template.items())

    def best_whole(self, text: str) -> tuple[str | None, float]:
        mine = self.vector(words(text))
        return max(((name, self.cosine(t, mine)) for name, t in self.wholes), key=lambda x: x[1])

    def best(self, segment: str) -> tuple[str | None, float]:
        mine, stated = self.vector(words(segment)), versions(segment)
        found: tuple[str | None, float] = (None, 0.0)
        for (name, t), own in zip(self.templates, OWN_WORDS):
            if (own is None or not own.isdisjoint(mine)) and not is_rival(name, set(mine), stated):
                score = self.cosine(t, mine)
                found = (name, score) if score > found[1] else found
        return found

    def scan(self, text: str) -> tuple[str | None, float, bool]:
        """(license, cosine, is a whole licence) of a whole text."""
        if not _ANCHOR.search(text):
            return None, 0.0, False
        whole = self.best_whole(text)
        if whole[1] >= FILE_THRESHOLD:
            return *whole, True
        # Paragraphs too, and as one line each, since notices are wrapped.
        segments = dict.fromkeys(s for s in [*text.split("\n"), *re.split(r"\n\W*\n", text)] if _ANCHOR.search(s))
        name, score = max(map(self.best, segments), key=lambda x: x[1], default=(None, 0.0))
        if score < THRESHOLD:
            return None, 0.0, False
        if name == "BSD-2-Clause" and not set(THIRD_CLAUSE).isdisjoint(words(text)):
            name = "BSD-3-Clause"
        return name, score, False


# Base names of files that speak for their directory with a header alone.
FILE_NAME = r"(?i)^(.*/)?(un)?(licen[cs]e|copying)[^/]*$"


def directory(path: Column) -> Column:
    """What stands before the last slash (empty: the top)."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def scan(docs: DataFrame, path: str = "path", text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, ``path`` and ``license, how, cosine``; ``how`` is file, header,
    inherited or none."""
    n_docs, frequencies = document_frequencies(docs, text)
    shared = docs.sparkSession.sparkContext.broadcast((n_docs, frequencies))

    def make():
        matcher = Matcher(*shared.value)

        def run(texts):
            found = [matcher.scan(t) for t in texts]
            return [
                pa.array([f[0] for f in found], pa.string()),
                pa.array([f[1] for f in found], pa.float64()),
                pa.array([f[2] for f in found], pa.bool_()),
            ]

        return run

    added = {"_own": "string", "_cosine": "double", "_file": "boolean"}
    columns = list(dict.fromkeys([*keep, path]))
    own = stored(append_columns(docs, text, columns, added, make), "license-own").withColumn("_dir", directory(F.col(path)))
    named = F.coalesce(F.col(path).rlike(FILE_NAME), F.lit(False)) & F.col("_own").isNotNull()
    own = own.withColumn("_file", F.col("_file") | named)
    files = (
        own.where("_file AND _dir IS NOT NULL")
        .groupBy("_dir")
        .agg(F.min(F.struct((-F.col("_cosine")).alias("c"), F.col(path).alias("p"), F.col("_own").alias("license"))).alias("best"))
        .select(F.col("_dir").alias("_above"), F.col("best.license").alias("license"))
    )
    # Every directory with all above it, nearest first; the empty name is the top.
    parts = F.split("_dir", "/")
    above = F.transform(F.sequence(F.size(parts), F.lit(0), F.lit(-1)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    dirs = own.where("_dir IS NOT NULL").select("_dir").distinct()
    # Written, so that the join below can divide a directory with very many documents.
    near = stored(
        dirs.select("_dir", F.posexplode(above).alias("_up", "_above"))
        .join(files, "_above")
        .groupBy("_dir")
        .agg(F.min_by("license", "_up").alias("_inherited")),
        "license-near",
    )
    how = (
        F.when(F.col("_file"), "file").when(F.col("_own").isNotNull(), "header").when(F.col("_inherited").isNotNull(), "inherited")
    ).otherwise("none")
    return own.join(near, "_dir", "left").select(
        *columns, F.coalesce("_own", "_inherited").alias("license"), how.alias("how"), F.round("_cosine", 6).alias("cosine")
    )
