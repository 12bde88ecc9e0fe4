"""Rectangles, rows and columns of drawn tables: values worked out by hand, and the row cascade against a loop."""

import math
import random

from pyspark.sql import functions as F

from lineweave.functions import rects
from lineweave.operators import tables

R = "struct<x: double, y: double, width: double, height: double>"


def values(spark, schema, rows, make):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + schema)
    return [r.v for r in sorted(df.select("i", make.alias("v")).collect(), key=lambda r: r.i)]


def flat(rs):
    return [tuple(r) for r in rs]


def test_rectangles(spark):
    c = [F.col(x) for x in "xywh"]
    got = values(spark, "x double, y double, w double, h double", [(5.0, 6.0, -2.0, 3.0), (0.0, 0.0, 0.0, -4.0)], rects.normalised(*c))
    assert flat(got) == [(3.0, 6.0, 2.0, 3.0), (0.0, -4.0, 0.0, 4.0)]
    area = F.lit(10.0), F.lit(20.0), F.lit(100.0), F.lit(50.0)
    got = values(spark, "x double, y double, w double, h double", [(0.0, 0.0, 500.0, 500.0), (200.0, 30.0, 5.0, 0.0), (50.0, 60.0, 10.0, 20.0)], rects.clamped(rects.rect(*c), rects.rect(*area)))
    assert flat(got) == [(10.0, 20.0, 100.0, 50.0), (109.0, 30.0, 1.0, 1.0), (50.0, 60.0, 10.0, 10.0)]


def test_shares_and_parts(spark):
    rows = [(2, [1.0, 3.0]), (2, None), (3, [1.0, 1.0]), (2, [0.0, math.nan]), (3, [2.0, 1.0, 1.0, 9.0]), (2, [None, 0.0001])]
    got = values(spark, "n int, g array<double>", rows, rects.ratios(F.col("n"), F.col("g")))
    assert got == [[0.25, 0.75], [0.5, 0.5], [1 / 3] * 3, [0.5, 0.5], [0.5, 0.25, 0.25], [0.5, 0.5]]
    box = rects.rect(F.lit(10.5), F.lit(-0.5), F.lit(100.0), F.lit(7.4))
    got = values(spark, "n int, g array<double>", [(2, [1.0, 3.0])], rects.sub_regions(box, F.col("n"), F.col("g")))
    assert flat(got[0]) == [(0, 11, 0, 25, 7), (1, 36, 0, 75, 7)]


def test_guides(spark):
    rows = [([0.5, 0.2, 0.2015, 0.203, 1.0, 0.0, -1.0, math.inf, math.nan, None],), (None,), ([i / 100 for i in range(1, 99)],)]
    got = values(spark, "g array<double>", rows, rects.guides(F.col("g")))
    assert got[:2] == [[0.2, 0.203, 0.5], []] and len(got[2]) == 40


def test_fixed_rows(spark):
    area = rects.rect(F.lit(0.0), F.lit(0.0), F.lit(100.0), F.lit(50.0))
    t = rects.rect(F.col("x"), F.col("y"), F.col("w"), F.col("h"))
    got = values(spark, "x double, y double, w double, h double", [(5.0, 10.0, 20.0, 15.0), (0.0, 40.0, 9.0, 30.0), (0.0, 0.0, 9.0, 0.0)], rects.fixed_rows(area, t))
    assert flat(got[0]) == [(5.0, 10.0, 20.0, 15.0), (5.0, 25.0, 20.0, 15.0)] and flat(got[1]) == [(0.0, 40.0, 9.0, 10.0)] and len(got[2]) == 50


def cascade(rows, overrides, area):
    ax, ay, aw, ah = area
    last = {o[0]: o for o in overrides}
    ok = lambda v: v is not None and math.isfinite(v)
    out, cursor = [], None
    for i, r in enumerate(rows):
        if r is None:
            continue
        o = last.get(float(i), (0, None, None))
        h = o[2] if ok(o[2]) and o[2] >= 4 else r[3]
        y = o[1] if ok(o[1]) else r[1] if cursor is None else cursor
        out.append((r[0], y, r[2], h))
        cursor = y + h
    kept = []
    for x, y, w, h in out:
        if y >= ay + ah:
            continue
        top = max(y, ay)
        h = min(h, ay + ah - top)
        if h >= 4:
            cx = max(ax, min(x, max(ax, ax + aw - 1)))
            kept.append((cx, top, max(1.0, min(w, max(1.0, ax + aw - cx))), h))
    return kept


def test_overridden_rows_against_a_loop(spark):
    rng = random.Random(8)
    rows, want = [], []
    for _ in range(150):
        base = [rng.choice([None, (float(rng.randint(-5, 90)), float(20 * i), float(rng.randint(1, 120)), float(rng.randint(4, 30)))]) if rng.random() < 0.2 else (3.0, 20.0 * i, 50.0, 20.0) for i in range(rng.randint(0, 6))]
        over = [(float(rng.choice([-1, 0, 1, 2, 3, 2.5, 9])), rng.choice([None, math.nan, 7.0, 55.0, -30.0]), rng.choice([None, 3.0, 4.0, 33.0, math.inf])) for _ in range(rng.randint(0, 4))]
        area = (0.0, 5.0, 80.0, float(rng.choice([3, 60, 100])))
        rows.append((base, rng.choice([over, over, None]) if not over else over, area))
        want.append(cascade(base, over, area))
    got = values(spark, f"r array<{R}>, o array<struct<rowIndex: double, y: double, height: double>>, a {R}", rows, rects.overridden_rows(F.col("r"), F.col("o"), F.col("a")))
    assert [flat(g) for g in got] == want and sum(map(len, want)) > 200


def bounds(spark, expected, matched, **more):
    e = spark.createDataFrame([("d", k, i, r) for i, (k, r) in enumerate(expected)], "doc_id string, key string, place int, required boolean")
    m = spark.createDataFrame([("d", k, float(x), float(w), x + w / 2) for k, x, w in matched], "doc_id string, key string, x double, w double, cx double")
    t = spark.createDataFrame([("d", 0.0, 400.0)], "doc_id string, x_min double, x_max double")
    return [(r.key, r.x_start, r.x_end, r.header_cx, r.source[:5]) for r in sorted(tables.expected_boundaries(e, m, t, **more).collect(), key=lambda r: r.header_cx)]


def test_expected_columns(spark):
    four = [("a", True), ("b", True), ("c", False), ("d", True)]
    # b lies at a third of the way from a to d, c is optional and left out; half a column is 400 / 3 * 0.4
    got = bounds(spark, four, [("a", 20, 40), ("d", 320, 40)])
    half = 400 / 3 * 0.4
    assert [g[0] for g in got] == ["a", "b", "d"] and [g[4] for g in got] == ["expec", "inter", "expec"] and math.isclose(got[1][3], 140)
    assert got[0][1] == 0 and got[2][2] == 400 and math.isclose(got[0][2], (60 + 140 - half) / 2) and math.isclose(got[1][2], (140 + half + 320) / 2)
    assert bounds(spark, four, [("a", 20, 40)]) == []
    one = bounds(spark, four, [("b", 150, 40)], allow_single=True)
    assert [g[0] for g in one] == ["a", "b", "d"] and math.isclose(one[0][3], max(190 / 3 * 0.5, 170 - 190 / 3 * 2)) and math.isclose(one[2][3], min(400 - 250 / 2 * 0.5, 170 + 250 / 2 * 2))
    # headers that overlap part at the middle of their centres
    assert bounds(spark, four[:2], [("a", 0, 300), ("b", 10, 40)])[0][0] == "b"


def test_columns_from_guides(spark):
    rows = [("fit", [100.0], ["a", "b"]), ("many", [300.0, 100.0, 200.0], ["a", "b"]), ("few", [100.0], ["a", "b", "c", "d"]), ("none", None, ["a", "rowIndex"]), ("out", [-5.0, 500.0], ["a"]), ("one", [50.0], ["a"]), ("empty", [1.0], [])]
    df = spark.createDataFrame([(k, 0.0, 400.0, g, keys) for k, g, keys in rows], "doc_id string, x_min double, x_max double, guides array<double>, keys array<string>")
    got = {}
    for r in sorted(tables.guide_boundaries(df).collect(), key=lambda r: (r.doc_id, r.x_start)):
        got.setdefault((r.doc_id, r.mismatch), []).append((r.key, r.x_start, r.x_end))
    assert got == {
        ("fit", None): [("a", 0, 100), ("b", 100, 400)], ("many", "too_many:3vs1"): [("a", 0, 100), ("b", 100, 400)],
        ("few", "fewer:1vs3"): [("a", 0, 100), ("b", 100, 250), ("c", 250, 325), ("d", 325, 400)],
        ("none", "no_guides_even_split"): [("a", 0, 200), ("rowIndex", 200, 400)], ("out", None): [("a", 0, 400)], ("one", "too_many:1vs0"): [("a", 0, 400)],
    }
