"""License scans against plain vectors over all lines, and inheritance against a walk up the path."""

import math
import random
from collections import Counter

from pyspark.sql import functions as F

from lineweave.llm import licenses

LEAST = 0.75


def brute(rows):
    vocab = {t for _, x in licenses.TEMPLATES for t in licenses.terms(x)}
    df = Counter(t for _, _, x in rows for t in set(licenses.terms(x or "")) & vocab)
    n = len(rows)
    idf = lambda t: math.log((1 + n) / (1 + df[t])) + 1 if t in vocab else math.log(1 + n) + 1

    def vector(text):
        v = {t: c * idf(t) for t, c in Counter(licenses.terms(text)).items()}
        size = math.sqrt(sum(w * w for w in v.values())) or 1
        return {t: w / size for t, w in v.items()}

    models = [(name, vector(x)) for name, x in licenses.TEMPLATES]

    def best(text):
        v = vector(text)
        return max(((sum(w * m.get(t, 0) for t, w in v.items()), -i) for i, (_, m) in enumerate(models)))

    own, given = {}, {}
    for doc, path, text in rows:
        lines = [best(x) for x in (text or "").split("\n")]
        top, whole = max(lines), best(text or "")
        file = whole[0] >= LEAST - 1e-12
        score, i = whole if file and whole[0] >= top[0] else top
        if score >= LEAST:
            own[doc] = licenses.TEMPLATES[-i][0]
            base = path.rpartition("/")[2].lower()
            if file or base.startswith(("license", "copying")):
                d = path.rpartition("/")[0]
                given[d] = min(given.get(d, (9, "")), (-round(score, 9), own[doc]))
    out = {}
    for doc, path, _ in rows:
        if doc in own:
            out[doc] = (own[doc], "own")
            continue
        d = path.rpartition("/")[0]
        while d not in given and d:
            d = d.rpartition("/")[0]
        out[doc] = (given[d][1], "inherited") if d in given else (None, None)
    return out


def test_against_brute(spark):
    rng = random.Random(4)
    vocab = ["the", "of", "under", "work", "license", "version", "public"] + [f"w{i}" for i in range(60)]
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    rows = []
    for i in range(160):
        path = "/".join([*(rng.choice("abcdefgh") for _ in range(rng.randint(1, 4))), f"f{i}.txt"])
        text = prose(rng.choice([3, 40]))
        kind = rng.random()
        if kind < 0.1:
            text += "\n" + rng.choice(licenses.TEMPLATES)[1]
        elif kind < 0.16:
            text = rng.choice(licenses.TEMPLATES)[1]
        elif kind < 0.2:
            path, text = path.replace(f"f{i}.txt", "LICENSE"), prose(9) + "\n" + rng.choice(licenses.TEMPLATES)[1]
        rows.append((i, path, text))
    rows += [(500, "a/b/x", None), (501, "a/LICENSE.txt", "Released under the MIT License.")]
    df = spark.createDataFrame(rows, "doc_id long, file string, text string")
    got = {r.doc_id: (r.license, r.origin) for r in licenses.scan_licenses(df, path=F.col("file"), least=LEAST).collect()}
    assert got == brute(rows)
    assert {o for _, o in got.values()} == {"own", "inherited", None}


def test_edges(spark):
    schema = "doc_id long, path string, text string"
    rows = [(1, None, "x"), (None, "a/b", ""), (3, "a/LICENSE", "Licensed under CC BY-NC 4.0."), (3, "a/LICENSE", "Licensed under CC BY-NC 4.0."), (4, "top", None)]
    got = sorted((str(r.doc_id), r.license, r.origin, r.from_dir) for r in licenses.scan_licenses(spark.createDataFrame(rows, schema), path=F.col("path")).collect())
    assert got == [("1", None, None, None), ("3", "CC-BY-NC-4.0", "own", None), ("3", "CC-BY-NC-4.0", "own", None), ("4", None, None, None), ("None", "CC-BY-NC-4.0", "inherited", "a")]
    assert licenses.scan_licenses(spark.createDataFrame([], schema), path=F.col("path")).count() == 0


def test_wrapped_headers_and_licence_files(spark):
    code = "\n".join(f"value_{i} = compute({i}, other_{i})" for i in range(60))
    gpl = "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version.\n#\n"
    more = "# This program is distributed in the hope that it will be useful,\n# but WITHOUT ANY WARRANTY; without even the implied warranty of\n# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the\n# GNU General Public License for more details.\n"
    rows = [(i, f"d{i}/LEGAL", f"Copyright (c) 2020 Some One\n\n{text}") for i, (_, text) in enumerate(licenses.TEXTS)]
    rows += [(i + 100, f"d{i}/sub/code.py", code) for i in range(len(licenses.TEXTS))]
    rows += [(200, "x/a.py", f"#!/usr/bin/python\n{gpl}{more}\n{code}"), (201, "x/b.py", code), (202, "x/c.txt", "to the of\nor a the of to")]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string")
    got = {r.doc_id: (r.license, r.origin, r.line) for r in licenses.scan_licenses(df, path=F.col("path")).collect()}
    for i, (name, _) in enumerate(licenses.TEXTS):
        assert got[i][:2] == (name, "own") and got[i + 100] == (name, "inherited", None)
    assert got[200] == ("GPL-3.0", "own", 2)
    assert got[201] == got[202] == (None, None, None)
