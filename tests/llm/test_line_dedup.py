"""Line dedup: alignment properties, and whole tables against a sequential version that aligns with every earlier text."""

import difflib
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from lineweave.llm import line_dedup


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 8), max_size=25), st.lists(st.integers(0, 8), max_size=25))
def test_alignment(a, b):
    got = line_dedup.aligned(a, b)
    assert all(a[i] == b[j] for i, j in got)
    assert all(i < u and j < v for (i, j), (u, v) in zip(got, got[1:]))


@settings(max_examples=200, deadline=None)
@given(st.permutations(list(range(12))), st.sets(st.integers(0, 11)))
def test_unique_lines_align_longest(b, drop):
    a = [x for x in range(12) if x not in drop]
    best = [1] * 12
    for i in range(12):
        best[i] = 0 if b[i] in drop else 1 + max([best[j] for j in range(i) if b[j] < b[i] and b[j] not in drop], default=0)
    got = line_dedup.aligned(a, b)
    assert len(got) <= max(best)
    if a == b:
        assert len(got) == len(a)


def brute(rows, min_words=5):
    first = {}
    out = {}
    for doc, text in sorted(rows):
        lines = text.split("\n")
        gone = set()
        partners = {first[x.strip()] for x in lines if len(x.split()) >= min_words and x.strip() in first}
        for p in partners:
            a = [x.strip() for x in dict(rows)[p].split("\n")]
            b = [x.strip() for x in lines]
            gone |= set(line_dedup.common_blocks([hash(x) for x in a], [hash(x) for x in b], [len(x.split()) for x in b], min_words))
        for x in lines:
            if len(x.split()) >= min_words:
                first.setdefault(x.strip(), doc)
        out[doc] = (len(lines), len(gone), "\n".join(x for i, x in enumerate(lines) if i not in gone))
    return out


def test_table(spark):
    rng = random.Random(2)
    pool = [" ".join(rng.choice("abcdefgh") for _ in range(rng.choice([1, 3, 6, 9]))) for _ in range(150)]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.choice([1, 4, 12])))) for i in range(80)]
    passage = "\n".join(f"this is the shared passage line number {i}" for i in range(5))
    rows += [(i, f"own words {i}\n{passage}\nmore own words {i}") for i in range(80, 140)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, kept string")
    got = {r.doc_id: (r.n_lines, r.n_removed, r.kept) for r in line_dedup.dedup_lines(df).collect()}
    assert got == brute(rows)
    assert got[80][1] == 0 and all(got[i] == (7, 5, f"own words {i}\nmore own words {i}") for i in range(81, 140))


def test_whole_copy_and_blocks(spark):
    text = "\n".join(f"line {i} of a text that is copied whole" for i in range(3000))
    rows = [(1, text), (2, text), (3, "As.\nBe."), (4, "As.\nBe."), (5, None), (5, None), (None, text), (6, ""), (6, "a b c d e f"), (6, "a b c d e f")]
    got = [(r.doc_id, r.n_lines, r.n_removed) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == sorted([(1, 3000, 3000), (2, 3000, 3000), (3, 2, 0), (4, 2, 0), (5, 1, 0), (5, 1, 0), (None, 3000, 0), (6, 1, 0), (6, 1, 0), (6, 1, 0)], key=str)
    assert line_dedup.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_more_than_half_of_difflib():
    rng = random.Random(7)
    a = [rng.randrange(500) for _ in range(200)]
    b = a[:50] + [900 + i for i in range(30)] + a[60:]
    ours = len(line_dedup.aligned(a, b))
    assert ours >= 0.9 * sum(m.size for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())


def test_rows_keep_their_columns(spark):
    line = "one line of seven words in all"
    rows = [(1, line + "\nown", "x", 5, 1.5), (2, line + "\nother", "y", 9, 2.5), (3, line, "z", 9, 3.5), (4, None, "n", None, None), (None, "free", "f", 4, 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, gone string, n_chars long, b double")
    got = line_dedup.without_common_lines(df)
    assert got.schema.names == df.schema.names
    assert sorted(map(tuple, got.collect()), key=str) == sorted([rows[0], (2, "other", "y", 5, 2.5), rows[3], rows[4]], key=str)


def test_every_block(spark):
    rng = random.Random(3)
    pool = [" ".join(rng.choice("abcdefgh") for _ in range(rng.choice([1, 2, 3, 6, 9]))) for _ in range(60)]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.choice([2, 5, 12])))) for i in range(90)]
    one, two = "the first of two whole lines", "the second of two whole lines"
    rows += [(100, f"{two}\n{one}"), (101, f"{one}\n{two}"), (102, f"{one}\n{two}")]
    words = {x: line_dedup.measured(x) for _, t in rows for x in t.split("\n")}
    want = {}
    for at, (doc, text) in enumerate(rows):
        b = text.split("\n")
        want[doc] = set()
        for _, earlier in rows[:at]:
            want[doc] |= set(line_dedup.common_blocks([hash(x) for x in earlier.split("\n")], [hash(x) for x in b], [words[x] for x in b], 5))
    got = {r.doc_id: r.kept for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), every_block=True).collect()}
    assert got == {i: "\n".join(x for j, x in enumerate(t.split("\n")) if j not in want[i]) for i, t in rows}
    assert got[102] == ""


def test_short_and_spaceless_lines(spark):
    short = "\n".join(f"item {i}\n" for i in range(30))
    tabs = "one\ttwo\tthree\tfour\tfive\tsix"
    han = "春眠不觉晓处处闻啼鸟"
    rows = [(i + 10 * j, f"own{i + 10 * j}\n{t}\nend{i + 10 * j}") for j, t in enumerate((short, tabs, han)) for i in (1, 2)] + [(50, "a\nb"), (51, "a\nb")]
    got = {r.doc_id: r.kept for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), every_block=True).collect()}
    assert [got[i] for i in (2, 12, 22, 51)] == ["own2\nend2", "own12\nend12", "own22\nend22", "a\nb"]
    assert got[1] == rows[0][1]
