"""Licence scan: sparse TF-IDF cosine of text lines and whole files to licence templates, then nearest-ancestor inheritance.

Terms are words and pairs of neighbouring words. Their weight is tf * idf; document frequencies of the templates' terms are
counted over all documents, every other term weighs as one that a single document holds. Each line (header notices stand in
lines) is compared with the short notices, each whole text (licence files) with the notices and the full licence texts. For full texts tf counts as
1 + log(tf), else the common words of long texts would make all licences alike. Lines and texts without an anchor term are skipped:
the anchors are chosen so that none without one can reach the threshold.

A text that is like a template as a whole is a licence file and declares its licence for its directory. A document takes the
licence of its own lines, else the declaration of the nearest ancestor directory, found by joining ancestor paths.

Defined results: null and empty texts have no licence of their own but may inherit; null paths are the root; ties between
templates go to the first by name; several licences in one directory are joined by commas; repeated rows are scanned one by one.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import append, batches_of, emit, field, skew_join, stored, table

#: The usual notices of each licence.
TEMPLATES = {
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3.", "GNU Affero General Public License as published by the Free Software Foundation, version 3"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"],
    "ISC": ["Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "MIT": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
}
#: Full texts, a file a licence, for whole texts only. Copyright lines are left out where they name a holder.
FOLDER = Path(__file__).parent / "license_texts"
LEAST = 0.65
#: Of full texts: a sample of installed licence files had 0.89 or more with their own licence, files of other licences up to 0.79.
LEAST_FULL = 0.8
WORD = re.compile(rb"[a-z0-9\x80-\xff]+")


def terms(text: bytes) -> Counter:
    w = WORD.findall(text.lower())
    return Counter(w) + Counter(a + b" " + b for a, b in zip(w, w[1:], strict=False))


def full_texts() -> dict[str, list[str]]:
    return {p.stem: [p.read_text(encoding="utf-8")] for p in sorted(FOLDER.glob("*.txt"))}


class Templates:
    """Unit vectors of one set of templates, by term, and their anchors. `damped` takes 1 + log(tf) for tf."""

    def __init__(self, texts: dict[str, list[str]], idf: dict[bytes, float], least: float, damped: bool):
        self.least, self.damped = least, damped
        self.names, self.at = [n for n in sorted(texts) for _ in texts[n]], {}
        vectors = []
        for k, x in enumerate(x for n in sorted(texts) for x in texts[n]):
            v = {t: c * idf[t] for t, c in self.counts(terms(x.encode())).items()}
            size = math.sqrt(sum(y * y for y in v.values()))
            vectors.append({t: y / size for t, y in v.items()})
            for t, y in vectors[-1].items():
                self.at.setdefault(t, []).append((k, y))
        # a text's cosine is at most the length of the template's part that it shares: drop the commonest words while what all
        # non-anchors share stays under the threshold for every template
        pairs: dict[bytes, list] = {}
        for t in self.at:
            if b" " in t:
                a, e = t.split(b" ")
                pairs.setdefault(a, []).append((e, t))
                if a != e:
                    pairs.setdefault(e, []).append((a, t))
        words = sorted((t for t in self.at if b" " not in t), key=lambda t: (idf[t], t))
        plain: set[bytes] = set()
        shared, most = [0.0] * len(vectors), (least * 0.999) ** 2
        for w in words:
            more: Counter = Counter()
            for t in [w, *(t for e, t in pairs.get(w, ()) if e == w or e in plain)]:
                for k, y in self.at[t]:
                    more[k] += y * y
            if all(shared[k] + y < most for k, y in more.items()):
                plain.add(w)
                for k, y in more.items():
                    shared[k] += y
        self.anchors = frozenset(w for w in words if w not in plain)

    def counts(self, found: Counter) -> dict[bytes, float]:
        return {t: 1 + math.log(c) for t, c in found.items()} if self.damped else found


class Scanner:
    def __init__(self, templates: dict[str, list[str]], texts: dict[str, list[str]], frequency: dict[bytes, int], n: int, least: float):
        self.rare = math.log((n + 1) / 2) + 1
        self.idf = {t: math.log((n + 1) / (frequency.get(t, 0) + 1)) + 1 for t in _vocabulary(templates) | _vocabulary(texts)}
        self.notices, self.full = Templates(templates, self.idf, least, False), Templates(texts, self.idf, LEAST_FULL, True)

    def best(self, text: bytes, among: Templates) -> tuple[str | None, float]:
        v = among.counts(terms(text))
        size = math.sqrt(sum((k * self.idf.get(t, self.rare)) ** 2 for t, k in v.items()))
        scores = [0.0] * len(among.names)
        for t in v.keys() & among.at.keys():
            x = v[t] * self.idf[t] / size
            for k, y in among.at[t]:
                scores[k] += x * y
        name, score = None, 0.0
        for template, s in zip(among.names, scores, strict=True):
            if s > score + 1e-12:
                name, score = template, s
        return (name, score) if score >= among.least else (None, score)

    def scan(self, text: bytes) -> tuple[list[str], str | None, float]:
        """Licences of the lines, licence of the whole text, highest cosine."""
        found, whole, top, anchors, low = set(), None, 0.0, self.notices.anchors, text.lower()
        words = set(WORD.findall(low))
        if not anchors.isdisjoint(words):
            for x in low.split(b"\n"):
                if not anchors.isdisjoint(WORD.findall(x)):
                    name, score = self.best(x, self.notices)
                    top = max(top, score)
                    if name:
                        found.add(name)
            whole, score = self.best(low, self.notices)
            top = max(top, score)
        if not self.full.anchors.isdisjoint(words):
            name, score = self.best(low, self.full)
            whole, top = name or whole, max(top, score)
        return sorted(found), whole, top


def _vocabulary(templates: dict[str, list[str]]) -> set[bytes]:
    return {t for some in templates.values() for x in some for t in terms(x.encode())}


def frequencies(docs: DataFrame, known: set[bytes], text: str = "text") -> tuple[dict[bytes, int], int]:
    """Document frequency of the known terms over all documents, and the number of documents."""
    single = frozenset(t for t in known if b" " not in t)
    pairs = frozenset(t for t in known if b" " in t)

    def make():
        def run(batches):
            seen: Counter = Counter()
            for b in batches:
                for t in b.column(0).to_pylist():
                    seen[b"\0"] += 1
                    w = WORD.findall((t or b"").lower())
                    some = single.intersection(w)
                    seen.update(some)
                    if len(some) > 1:
                        seen.update({x for a, e in zip(w, w[1:], strict=False) if a in some and e in some and (x := a + b" " + e) in pairs})
            yield {"t": list(seen), "n": list(seen.values())}

        return run

    got = {bytes(r["t"]): r["n"] for r in emit(docs.select(F.col(text).cast("binary")), "t binary, n long", make).groupBy("t").agg(F.sum("n").alias("n")).collect()}
    return got, got.pop(b"\0", 0)


def scan(docs: DataFrame, path: str = "path", text: str = "text", templates: dict[str, list[str]] | None = None, least: float = LEAST, texts: dict[str, list[str]] | None = None) -> DataFrame:
    """docs without the text but with licenses (of its lines), file_license (of the whole text), similarity, inherited (of the nearest
    declaring directory) and inherited_from. Own templates come without the full texts, unless `texts` has some."""
    texts = texts if texts is not None else {} if templates else full_texts()
    templates = templates or TEMPLATES
    with batches_of(docs.sparkSession):
        frequency, n = frequencies(docs, _vocabulary(templates) | _vocabulary(texts), text)
    held = docs.sparkSession.sparkContext.broadcast(Scanner(templates, texts, frequency, n, least))

    def make():
        scanner = held.value

        def run(b):
            got = [scanner.scan(t or b"") for t in b.column(0).to_pylist()]
            return {"licenses": [x[0] for x in got], "file_license": [x[1] for x in got], "similarity": [round(x[2], 6) for x in got]}

        return run

    results = {"licenses", "file_license", "similarity", "directory", "inherited", "inherited_from"}
    fields = [field("licenses", "array<string>"), field("file_license", "string"), field("similarity", "double")]
    others = F.struct(*(f"`{c}`" for c in docs.columns if c != text and c not in results)).alias("row")
    found = append(docs.select(F.col(text).cast("binary").alias("bytes"), others, F.coalesce(F.col(path).cast("string"), F.lit("")).alias("path")), fields, make)
    with batches_of(docs.sparkSession):
        found = stored(found.select("row", "licenses", "file_license", "similarity", _parent(F.col("path")).alias("directory")), "licenses")
    declared = found.where("file_license is not null").groupBy("directory").agg(F.array_join(F.array_sort(F.collect_set("file_license")), ",").alias("inherited"))
    ancestors = found.select("directory").distinct().withColumn("up", F.explode(_ancestors(F.col("directory"))))
    near = ancestors.join(declared.withColumnRenamed("directory", "up"), "up").groupBy("directory").agg(F.max(F.struct(F.length("up").alias("n"), F.col("up").alias("inherited_from"), "inherited")).alias("m"))
    out = skew_join(found, stored(near.select("directory", "m.inherited", "m.inherited_from"), "declared"), "directory", "left")
    return out.select("row.*", "licenses", "file_license", "similarity", "directory", "inherited", "inherited_from")


def _parent(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def _ancestors(directory: Column) -> Column:
    """The directory and all above it, with the root as an empty name."""
    parts = F.split(directory, "/")
    return F.array_distinct(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))))


def op7_licenses(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.col("source"), F.col("lang"), F.col("doc_id").cast("string"))
    out = scan(docs.select("doc_id", "text", path.alias("path")))
    return out.select("doc_id", F.array_join("licenses", ",").alias("licenses"), "file_license", "similarity", "inherited", "inherited_from")
