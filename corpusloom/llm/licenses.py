"""License scans: TF-IDF cosine to templates, then inheritance from the nearest ancestor directory."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.75
TERM = re.compile(r"[a-z]+|[0-9]+(?:\.[0-9]+)*")

# Short wordings by which files state their licence, several for each.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, version 3."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "This work has been dedicated to the public domain under CC0 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)


def terms(text: str) -> list[str]:
    return TERM.findall(text.lower())


def anchor_terms(vector: dict[str, float]) -> list[str]:
    """Terms of which every passage that is THRESHOLD like the template holds at least one.

    A cosine is at most the root of the summed squares of the template's weights over the
    terms that both share.  So once the heaviest terms are taken out and the squares of the
    rest stay below the square of THRESHOLD, a passage without any of those can't reach it.
    """
    out, rest = [], 1.0
    for term, weight in sorted(vector.items(), key=lambda x: (-x[1], x[0])):
        if rest < THRESHOLD**2 - 1e-9:
            break
        out.append(term)
        rest -= weight * weight
    return out


class Templates:
    """Templates as unit TF-IDF vectors over their terms; other terms of a passage weigh as much as the rarest."""

    def __init__(self, idf: dict[str, float], rarest: float):
        self.idf, self.rarest = idf, rarest
        counts = [Counter(terms(t)) for _, t in TEMPLATES]
        self.names = [name for name, _ in TEMPLATES]
        self.vectors = []
        self.owners: dict[str, list[int]] = {}
        for i, c in enumerate(counts):
            weights = {t: n * idf.get(t, rarest) for t, n in c.items()}
            norm = sum(w * w for w in weights.values()) ** 0.5
            self.vectors.append({t: w / norm for t, w in weights.items()})
            for t in c:
                self.owners.setdefault(t, []).append(i)
        self.anchors = sorted({t for v in self.vectors for t in anchor_terms(v)})
        self.hint = re.compile(r"(?<![a-z0-9])(?:" + "|".join(map(re.escape, sorted(self.anchors, key=len, reverse=True))) + r")(?![a-z0-9])", re.IGNORECASE)
        longest = max(sum((n * idf.get(t, rarest)) ** 2 for t, n in c.items()) for c in counts)
        self.room = 2 * longest / THRESHOLD**2  # twice the squared norm at which one whole template falls to the threshold

    def may_state(self, text: str) -> bool:
        """Whether the text holds an anchor of any template; if not, no passage of it reaches the threshold."""
        low = text.lower()
        return any(a in low for a in self.anchors) and self.hint.search(low) is not None

    def best(self, passage: str) -> tuple[str | None, float]:
        """Most similar template's license and the cosine; of equals the first."""
        return self.best_of(Counter(terms(passage)))

    def best_of(self, found: Counter[str]) -> tuple[str | None, float]:
        norm = self.weight(found) ** 0.5
        dots: dict[int, float] = {}
        for t, n in found.items():
            for i in self.owners.get(t, ()):
                dots[i] = dots.get(i, 0.0) + n * self.idf.get(t, self.rarest) * self.vectors[i][t]
        if not dots:
            return None, 0.0
        i = min(dots, key=lambda i: (-dots[i], i))
        return self.names[i], dots[i] / norm

    def weight(self, found: Counter[str]) -> float:
        """Squared norm of a passage's vector."""
        return sum((n * self.idf.get(t, self.rarest)) ** 2 for t, n in found.items())


SENTENCE = re.compile(r"[^.;]*(?:\.(?!\s)[^.;]*)*(?:[.;]|$)")


def passages(text: str, templates: Templates) -> Iterator[Counter[str]]:
    """Terms of all that may state a licence in a text.

    Lines that hold an anchor (see `anchor_terms`; others can't be alike enough) and their
    sentences; and of each run of lines between blank lines (the whole text if it has none)
    that holds one, the run, its sentences across lines and its windows of consecutive lines.
    A window ends at twice the squared norm beyond which a statement made once in it stays
    below the threshold.
    """
    hint = templates.hint
    for run in re.split(r"\n\s*\n", text):
        if not hint.search(run):
            continue
        lines = run.split("\n")
        for line in lines:
            if hint.search(line):
                yield Counter(terms(line))
                for sentence in SENTENCE.findall(line):
                    yield Counter(terms(sentence))
        if len(lines) == 1:
            continue
        yield Counter(terms(run))
        for sentence in SENTENCE.findall(run.replace("\n", " ")):
            if hint.search(sentence):
                yield Counter(terms(sentence))
        starts = np.cumsum([0] + [len(line) + 1 for line in lines])
        need = [len(lines)] * (len(lines) + 1)  # line by which a hint that begins here or later has ended
        for m in hint.finditer(run):
            a, b = np.searchsorted(starts, [m.start(), m.end() - 1], side="right") - 1
            need[int(a)] = min(need[int(a)], int(b))
        for i in range(len(lines) - 1, -1, -1):
            need[i] = min(need[i], need[i + 1])
        counts = [Counter(terms(line)) for line in lines]
        used = [i for i, c in enumerate(counts) if c]
        for at, start in enumerate(used):
            found: Counter[str] = Counter()
            for end in used[at:]:
                found.update(counts[end])
                if templates.weight(found) > templates.room:
                    break
                if end > start and end >= need[start]:
                    yield found


def scan_batches(batches: Iterator[pa.RecordBatch], templates: Templates) -> Iterator[pa.RecordBatch]:
    """`_id, _path, _text` -> `_id, _path, _license, _similarity, _words`."""
    for batch in batches:
        names, scores, words = [], [], []
        for text in batch.column(2):
            value = text.as_py() or ""
            best = (None, 0.0)
            if templates.may_state(value):
                for p in passages(value, templates):
                    name, score = templates.best_of(p)
                    if score > best[1]:
                        best = (name, score)
            sure = best[1] >= THRESHOLD
            names.append(best[0] if sure else None)
            scores.append(min(1.0, best[1]) if sure else None)
            words.append(len(value.split()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(words, pa.int64())], names=["_id", "_path", "_license", "_similarity", "_words"])


def term_weights(texts: DataFrame) -> Templates:
    """Inverse document frequencies of the templates' terms, counted over all texts; at most as many rows as terms."""
    known = sorted({t for _, text in TEMPLATES for t in terms(text)})
    words = F.array_distinct(F.split(F.lower("_text"), r"[^a-z0-9.]+"))
    trimmed = F.transform(words, lambda w: F.regexp_replace(w, r"^\.+|\.+$", ""))
    found = F.array_intersect(F.array_distinct(trimmed), F.array(*map(F.lit, known)))
    n = texts.count()
    counts = {r["t"]: r["n"] for r in texts.select(F.explode(found).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect()}
    idf = {t: float(np.log((1 + n) / (1 + counts.get(t, 0))) + 1) for t in known}
    return Templates(idf, max(idf.values()))


def directory(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def scan_licenses(
    files: DataFrame, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text", name_pattern: str = r"(?i)^(licen[cs]e|copying|unlicense)([.-].*)?$"
) -> DataFrame:
    """The license of each file, from its own header or from the nearest directory above that has one.

    A file's lines, sentences, windows of lines and paragraphs are compared with the templates
    by sparse TF-IDF cosine, but for those that no template's weights let reach the threshold;
    document frequencies cover all files.  Files
    whose name matches `name_pattern` and that state a license give it to their directory
    (of several, the most similar, then the smallest path).  A file without one of its own
    takes that of its nearest ancestor directory: the distinct directories are joined with
    their ancestors, and the files with their directory.

    Returns one row for each row of `files`: `id_col, path_col, license, similarity` (own
    statement only), `origin` ('own', 'inherited' or 'none') and `from_directory` (where it
    was inherited from).

    Null and empty texts state nothing; a null path inherits nothing; files at the top level
    have directory ''; texts of any length are read whole; of equally similar templates the
    first counts; repeated rows get equal results; an empty table gives an empty result; other
    columns don't take part, whatever their names.
    """
    from corpusloom.shared import stash

    rows = files.select(F.col(id_col).alias("_id"), F.col(path_col).alias("_path"), F.col(text_col).alias("_text"))
    templates = term_weights(rows.select("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    own = stash(rows.mapInArrow(lambda it: scan_batches(it, templates), f"_id {kind}, _path string, _license string, _similarity double, _words long"), "licenses")
    own = own.withColumn("_dir", directory(F.col("_path")))
    given = own.filter(F.col("_license").isNotNull() & F.regexp_extract("_path", r"[^/]*$", 0).rlike(name_pattern))
    order = F.struct((-F.col("_similarity")).alias("s"), "_path", "_license")
    given = given.groupBy(F.col("_dir").alias("_giver")).agg(F.min(order).alias("_best")).select("_giver", F.col("_best._license").alias("_given"))
    parts = F.split(F.col("_dir"), "/")
    dirs = own.filter("_dir is not null").select("_dir").distinct()
    above = F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, F.lit(1), n), "/").alias("up"))))
    ancestors = dirs.withColumn("_a", above).filter("_dir <> '' or _a.depth = 0").select("_dir", "_a.depth", "_a.up")
    nearest = ancestors.join(given, F.col("up") == F.col("_giver")).groupBy(F.col("_dir").alias("_d")).agg(F.max(F.struct("depth", "up", "_given")).alias("_near"))
    joined = own.join(stash(nearest, "license-dirs"), F.col("_dir") == F.col("_d"), "left")
    stated = F.col("_license").isNotNull()
    inherited = ~stated & F.col("_near").isNotNull()
    return joined.select(
        F.col("_id").alias(id_col),
        F.col("_path").alias(path_col),
        F.coalesce("_license", "_near._given").alias("license"),
        F.col("_similarity").alias("similarity"),
        F.when(stated, "own").when(inherited, "inherited").otherwise("none").alias("origin"),
        F.when(inherited, F.col("_near.up")).alias("from_directory"),
    )
