"""License scans: sparse TF-IDF cosine of notices and licence files to templates, then inheritance by directory.

Terms of the templates get their inverse document frequency from all documents; any other term has that of a term seen
nowhere, so that foreign words lengthen a text's vector and lower its cosine. Each line of a file, and each block of
consecutive lines about as long as a template (terms leave out comment marks and wraps), is compared as a header, wherever
it stands, and the whole text as a licence file. Full licence texts are templates for blocks and whole texts of like length
alone, as a few common words come near them. A file's terms bound every cosine in it, so most files are settled by one
lookup of their distinct words, without loss.

Files without a licence of their own take the one of the nearest ancestor directory that holds a licence file: the
distinct directories are exploded into their ancestors, joined with the directories that hold one, and the deepest wins.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineweave.llm.licence_texts import TEXTS
from lineweave.llm._shared import PerWorker, over_arrow, stored, text_of

#: Terms of all templates at most; they are broadcast.
MAX_TERMS = 50_000
#: Lengths of the blocks of lines that are compared with a template, as shares of its terms.
BLOCKS = (0.8, 1.0, 1.25)
#: Base names of licence files.
LICENCE_NAMES = r"(?i)^(un)?(licen[sc]e|copying|notice)([._-].*)?$"
_TERM = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*").findall

#: Notices of common licences, by SPDX identifier.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License. You may obtain a copy of the License at apache.org/licenses/LICENSE-2.0"),
    ("GPL-2.0", "This program is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Released under the ISC License."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
)


def terms(text: str) -> list[str]:
    return _TERM(text.lower())


class TemplateIndex:
    """Unit TF-IDF vectors of the templates, by term."""

    def __init__(self, spec: tuple[tuple[tuple[str, str], ...], tuple[tuple[str, str], ...], dict[str, int], int]):
        templates, texts, df, n = spec
        self.notices = len(templates)
        templates += texts
        self.lengths = [len(terms(text)) for _, text in templates]
        self.names = [name for name, _ in templates]
        self.unseen = math.log(1 + n) + 1
        self.idf = {t: math.log((1 + n) / (1 + c)) + 1 for t, c in df.items()}
        self.by_term: dict[str, list[tuple[int, float]]] = {}
        for i, (_, text) in enumerate(templates):
            weights = {t: c * self.idf[t] for t, c in Counter(terms(text)).items()}
            norm = math.sqrt(sum(w * w for w in weights.values())) or 1.0
            for t, w in weights.items():
                self.by_term.setdefault(t, []).append((i, w / norm))

    def within_bound(self, known: set[str], least: float) -> list[int]:
        """Templates that a text whose template terms are ``known``, or a part of it, may reach (Cauchy-Schwarz)."""
        sums = [0.0] * len(self.names)
        for t in known:
            for i, w in self.by_term[t]:
                sums[i] += w * w
        return [i for i, x in enumerate(sums) if x >= least * least - 1e-9]

    def best(self, text: str, full: bool = False) -> tuple[float, int]:
        """(cosine, template) of the nearest notice, with ``full`` also of texts of half to twice the length; ties to the first."""
        counts = Counter(terms(text))
        dots = [0.0] * len(self.names)
        norm = 0.0
        for t, c in counts.items():
            w = c * self.idf.get(t, self.unseen)
            norm += w * w
            for i, v in self.by_term.get(t, ()):
                dots[i] += w * v
        if not norm:
            return 0.0, 0
        n = sum(counts.values())
        among = [i for i, size in enumerate(self.lengths) if i < self.notices or full and size <= 2 * n <= 4 * size]
        top = max(among, key=lambda i: (dots[i], -i))
        return dots[top] / math.sqrt(norm), top

    def blocks(self, lines: list[list[str]], among: list[int]) -> Iterator[tuple[float, int, int]]:
        """(cosine, template, first line from 1) of blocks of several lines, around each length in ``BLOCKS``."""
        full = [(at, x) for at, x in enumerate(lines, 1) if x]
        for i in among:
            vector = {t: v for t, own in self.by_term.items() for j, v in own if j == i}
            for size in {round(share * self.lengths[i]) for share in BLOCKS}:
                counts: Counter = Counter()
                dot, norm, n, end = 0.0, 0.0, 0, 0
                for start, (at, _) in enumerate(full):
                    while end < len(full) and (n < size or end <= start):
                        for t in full[end][1]:
                            w = self.idf.get(t, self.unseen)
                            norm += w * w * (2 * counts[t] + 1)
                            counts[t] += 1
                            dot += w * vector.get(t, 0.0)
                        n, end = n + len(full[end][1]), end + 1
                        if end > start + 1 and norm > 0 and 2 * n >= size and n <= 2 * size:
                            yield dot / math.sqrt(norm), i, at
                    if end > start + 1 and norm > 0 and n <= 2 * size:
                        yield dot / math.sqrt(norm), i, at
                    for t in full[start][1]:
                        w = self.idf.get(t, self.unseen)
                        counts[t] -= 1
                        norm -= w * w * (2 * counts[t] + 1)
                        dot -= w * vector.get(t, 0.0)
                    n -= len(full[start][1])


def document_frequencies(docs: DataFrame, vocabulary: set[str]) -> tuple[dict[str, int], int]:
    """Documents that hold each template term, and all documents; counted by task before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            texts = batch.column(0).to_pylist()
            found[""] += len(texts)
            for text in texts:
                found.update(vocabulary.intersection(terms(text)))
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["term", "n"])

    rows = over_arrow(docs.select("text"), count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    counts = {r.term: r.n for r in rows}
    n = counts.pop("", 0)
    return {t: counts.get(t, 0) for t in vocabulary}, n


def directory(path: Column) -> Column:
    """All before the last slash; empty for files at the top."""
    return F.regexp_replace(F.regexp_replace(path, r"[^/]*$", ""), r"/+$", "")


def scan_licenses(df: DataFrame, *, path: Column, templates: tuple[tuple[str, str], ...] = TEMPLATES, texts: tuple[tuple[str, str], ...] = TEXTS, least: float = 0.75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licences of files.

    Returns ``doc_id``, ``path``, ``license``, ``score`` (cosine of the notice that decided), ``origin`` (``own``,
    ``inherited`` or null), ``line`` (the first of an own notice, from 1; 0 if the whole text matched) and ``from_dir`` (where an
    inherited one stands). A file is a licence file if its whole text reaches ``least`` or its base name says so and a
    line or block does. Several licence files in a directory: the highest score, then the first name, decides.

    Null and empty texts have no licence of their own and may inherit. Null paths inherit nothing. Null ids are
    allowed. Repeated rows have a result each. An empty table gives none. Other columns are not read.
    """
    docs = df.select(F.col(id_col).alias("doc_id"), path.cast("string").alias("path"), text_of(text_col).alias("text"))
    vocabulary = {t for _, text in (*templates, *texts) for t in terms(text)}
    if len(vocabulary) > MAX_TERMS:
        raise ValueError(f"templates have more than {MAX_TERMS} terms")
    shared = PerWorker(df.sparkSession, (tuple(templates), tuple(texts), *document_frequencies(docs, vocabulary)), TemplateIndex)
    kind = df.schema[id_col].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.get()
        vocab = set(index.idf)
        for batch in batches:
            out = []
            for text in batch.column(2).to_pylist():
                found: tuple = (None, None, None, None)
                if among := index.within_bound(vocab.intersection(terms(text)), least):
                    whole = index.best(text, full=True)
                    scores = [(*index.best(x), at) for at, x in enumerate(text.split("\n"), 1)] if "\n" in text else [(*index.best(text), 1)]
                    score, i, at = max(scores, key=lambda s: (s[0], -s[2]))
                    if "\n" in text:
                        block = max(index.blocks([terms(x) for x in text.split("\n")], among), key=lambda s: (s[0], -s[2]), default=(0.0, 0, 0))
                        if block[0] > score + 1e-9:
                            score, i, at = block
                    file = whole[0] >= least
                    if file and whole[0] >= score:
                        score, i, at = *whole, 0
                    if score >= least:
                        found = (index.names[i], round(score, 9), at, file)
                out.append(found)
            name, score, at, file = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(name, pa.string()), pa.array(score, pa.float64()), pa.array(at, pa.int32()), pa.array(file, pa.bool_())],
                names=["doc_id", "path", "license", "score", "line", "file"],
            )

    found = stored(over_arrow(docs, scan, f"doc_id {kind}, path string, license string, score double, line int, file boolean").withColumn("dir", directory(F.col("path"))), "licenses")
    named = F.regexp_extract("path", r"([^/]*)$", 1).rlike(LICENCE_NAMES)
    given = found.where(F.col("license").isNotNull() & F.col("dir").isNotNull() & (F.col("file") | named))
    given = given.groupBy(F.col("dir").alias("from_dir")).agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("x")).select("from_dir", F.col("x.license").alias("given"), (-F.col("x.s")).alias("given_score"))
    dirs = found.where("dir is not null").select("dir").distinct()
    parts = F.split("dir", "/")
    above = dirs.select("dir", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.when(n == 0, F.lit("")).otherwise(F.array_join(F.slice(parts, 1, n), "/")))).alias("from_dir"))
    nearest = above.join(given, "from_dir").groupBy("dir").agg(F.max_by(F.struct("from_dir", "given", "given_score"), F.length("from_dir")).alias("near"))
    near = F.when(F.col("license").isNull(), F.col("near"))
    return found.join(nearest, "dir", "left").select(
        "doc_id",
        "path",
        F.coalesce("license", near["given"]).alias("license"),
        F.coalesce("score", near["given_score"]).alias("score"),
        F.when(F.col("license").isNotNull(), "own").when(near.isNotNull(), "inherited").alias("origin"),
        "line",
        near["from_dir"].alias("from_dir"),
    )
