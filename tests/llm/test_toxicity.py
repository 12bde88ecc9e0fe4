"""Toxicity: held-out accuracy, no use of held-out labels, odd rows."""

import random
import zlib

from lineweave.llm import toxicity


def corpus(n=600, seed=1):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefghiklmnoprstu") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    rows = []
    for i in range(n):
        words = [rng.choice(vocab) for _ in range(rng.randint(3, 60))]
        toxic = int(rng.random() < 0.25)
        for _ in range(toxic * rng.randint(1, 3)):  # an invented stem with any ending, or a common insult
            words.insert(rng.randrange(len(words)), rng.choice(["idiot", "zorgal" + rng.choice(vocab), "m0r0n,"]))
        rows.append((i, " ".join(words), toxic))
    return rows


def test_held_out(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "en") for i, t, _ in rows] + [(None, None, "x"), (9000, None, "x"), (9001, "", "x"), (0, rows[0][1], "y")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (5, None), (77777, 1)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == len(rows) + 4
    truth = {i: y for i, _, y in rows}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert len({r.score for r in got if r.doc_id == 0}) == 1
    # labels of held-out rows change nothing
    flipped = spark.createDataFrame([(i, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, _, y in rows], "doc_id long, toxic int")
    again = {r.doc_id: r.score for r in toxicity.toxicity(docs, flipped).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-9 for r in got)


def test_no_labels_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {(r.doc_id, r.score, r.predicted) for r in toxicity.toxicity(docs, none).collect()} == {(1, 0.0, 0), (2, 0.0, 0)}
    assert toxicity.toxicity(docs.limit(0), none).count() == 0


def test_plain():
    assert toxicity.plain("«M0r0n!!»") == ("moron", True)
    assert toxicity.plain("i.d.i.o.t") == ("idiot", True)
    assert toxicity.plain("Hello,") == ("hello", False)
    assert toxicity.plain("2024.") == ("2024", False)


def test_lexicon_limit_is_a_parameter(spark):
    rows = [(f"grobword{i % 3} shared text{i}", 1) for i in range(30)] + [(f"shared kind{i} text", 0) for i in range(60)]
    labelled = spark.createDataFrame(rows, "text string, toxic int")
    every = [tuple(r) for r in toxicity.learned_lexicon(labelled).collect()]
    assert len(every) > 2
    assert [tuple(r) for r in toxicity.learned_lexicon(labelled, 2).collect()] == every[:2]
