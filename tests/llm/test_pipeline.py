"""The pipeline: each stage on what its predecessor kept, against plain versions of what it decides."""

import os
import random
from collections import Counter

import corpus_pipeline
from tests.llm.test_minhash import brute as near_brute
from tests.llm.test_toxicity import corpus as toxic_corpus


def tables(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, t, "en", f"s{i % 4}", len(t)) for i, t, _ in toxic_corpus(400)]
    words = [f"w{i}" for i in range(500)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = text(120)
    shared = "\n".join(text(9) for _ in range(4))
    rows += [(1000 + i, f"{base} {text(2)}", "en", "s0", 0) for i in range(12)]
    rows += [(1100 + i, f"{text(20)}\n{shared}\n{text(15)}", "de", None, 0) for i in range(10)]
    rows += [(1200, shared, "de", "s1", 0), (1300, None, "en", "s2", None), (None, text(30), "en", "s2", 3), (1400, text(25), "en", "s3", 1), (1400, text(25), "en", "s3", 1)]
    path = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(os.path.join(path, "documents.parquet"))
    spark.createDataFrame([(i, y, 1) for i, _, y in toxic_corpus(400)], "doc_id long, toxic int, quality int").write.parquet(os.path.join(path, "labels.parquet"))
    return path, rows, {i: y for i, _, y in toxic_corpus(400)}


def test_stages(spark, tmp_path):
    path, rows, toxic = tables(spark, tmp_path)
    docs = spark.read.parquet(path + "/documents.parquet")
    columns = docs.columns

    def step(i, x):
        out = corpus_pipeline.STAGES[i][1](spark, x, path)
        out.write.parquet(f"{path}/stage{i}")
        return spark.read.parquet(f"{path}/stage{i}")

    clean = step(0, docs)
    assert clean.columns == columns
    ids = {r.doc_id for r in clean.collect()}
    wrong = [i for i, y in toxic.items() if (i in ids) == bool(y)]
    assert len(wrong) <= 0.03 * len(toxic) and {1000, 1100, 1200, 1300, 1400, None} <= ids

    cut = step(1, clean)
    kept = {r.doc_id: r for r in cut.collect() if r.doc_id and r.doc_id >= 1000}
    assert cut.columns == columns and 1200 not in kept
    assert kept[1100].text.count("\n") == 5 and all(kept[1100 + i].text.count("\n") == 1 for i in range(1, 10))
    assert all(kept[1100 + i].n_chars == len(kept[1100 + i].text) for i in range(1, 10)) and kept[1300].text is None

    apart = step(2, cut)
    before = [(r.doc_id, r.text) for r in cut.collect()]
    single = [(i, t) for i, t in before if i is not None and i != 1400]
    want = {i for i, (_, _, ok) in near_brute(single, 5).items() if ok}
    got = [r.doc_id for r in apart.collect()]
    assert apart.columns == columns and {i for i in got if i is not None and i != 1400} == want and got.count(1400) == 2

    mixed = step(3, apart)
    times = Counter(r.doc_id for r in mixed.collect())
    assert mixed.columns == columns and set(times) <= set(got) and max(v for i, v in times.items() if i != 1400) <= 3

    tokens = step(4, mixed)
    assert tokens.count() == mixed.count() and {"doc_id", "n_tokens", "ids_sha256"} <= set(tokens.columns)
    assert sorted(map(str, (r.ids_sha256 for r in tokens.collect()))) == sorted(str(r.ids_sha256) for r in corpus_pipeline.run(spark, path).collect())
