"""Column functions on rectangles (structs of x, y, width, height) and the parts of tables drawn on a page.

Each works on one row's small arrays: rows of one table area, guides of one table.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Least height of a row, rows and guides of a table at most, guides that count as one, least share of a part.
LEAST_ROW, MOST_ROWS, MOST_GUIDES, GUIDE_APART, LEAST_RATIO = 4.0, 5001, 40, 0.002, 0.0001
RECT = "struct<x: double, y: double, width: double, height: double>"


def rect(x: Column, y: Column, width: Column, height: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), width.cast("double").alias("width"), height.cast("double").alias("height"))


def finite(c: Column) -> Column:
    """False for null, NaN and infinity."""
    return F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))


def normalised(x: Column, y: Column, w: Column, h: Column) -> Column:
    """The rectangle between two corners, whichever way it was drawn."""
    return rect(F.when(w < 0, x + w).otherwise(x), F.when(h < 0, y + h).otherwise(y), F.abs(w), F.abs(h))


def _within(c: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(c, high))


def clamped(r: Column, area: Column) -> Column:
    """``r`` moved and cut to lie in ``area``, one pixel wide and high at least."""
    right, bottom, one = area["x"] + area["width"], area["y"] + area["height"], F.lit(1.0)
    x = _within(r["x"], area["x"], F.greatest(area["x"], right - 1))
    y = _within(r["y"], area["y"], F.greatest(area["y"], bottom - 1))
    return rect(x, y, _within(r["width"], one, F.greatest(one, right - x)), _within(r["height"], one, F.greatest(one, bottom - y)))


def ratios(parts: Column, given: Column) -> Column:
    """Shares of ``parts`` parts that sum to one: the given ones if there are as many (those not finite or tiny count little), else equal ones."""
    some = F.slice(F.coalesce(given, F.array().cast("array<double>")), F.lit(1), parts)
    sound = F.transform(some, lambda v: F.when(finite(v), F.greatest(F.lit(LEAST_RATIO), v)).otherwise(LEAST_RATIO))
    total = F.aggregate(sound, F.lit(0.0), lambda a, v: a + v)
    return F.when(F.size(some) == parts, F.transform(sound, lambda v: v / total)).otherwise(F.array_repeat(1 / parts.cast("double"), parts))


def sub_regions(r: Column, parts: Column, given: Column) -> Column:
    """The parts of a region from left to right, in whole pixels: array of index, x, y, width, height."""
    whole = lambda c: F.floor(c + 0.5).cast("int")  # noqa: E731  halves go up, below zero too
    starts = F.aggregate(ratios(parts, given), F.array(F.lit(0.0)), lambda at, v: F.concat(at, F.array(F.element_at(at, -1) + v)))

    def part(i: Column) -> Column:
        start = F.get(starts, i)
        width = F.when(i == parts - 1, r["width"] * (1 - start)).otherwise(r["width"] * F.get(ratios(parts, given), i))
        return F.struct(i.cast("int").alias("index"), whole(r["x"] + r["width"] * start).alias("x"), whole(r["y"]).alias("y"), whole(width).alias("width"), whole(r["height"]).alias("height"))

    return F.transform(F.sequence(F.lit(0), parts - 1), part)


def guides(given: Column) -> Column:
    """Dividers of columns as shares of a table's width: inside it, in order, those close to the one before left out, the first forty."""
    inside = F.array_sort(F.filter(F.coalesce(given, F.array().cast("array<double>")), lambda v: finite(v) & (v > 0) & (v < 1)))
    none = F.array().cast("array<double>")
    apart = F.aggregate(inside, none, lambda kept, v: F.when((F.size(kept) == 0) | (F.abs(F.try_element_at(kept, F.lit(-1)) - v) > GUIDE_APART), F.concat(kept, F.array(v))).otherwise(kept))
    return F.slice(apart, 1, MOST_GUIDES)


def fixed_rows(area: Column, template: Column) -> Column:
    """Rows of one height below one another, from the template's place in ``area`` on as long as they fit."""
    t = clamped(template, area)
    n = F.least(F.lit(MOST_ROWS), F.floor((area["y"] + area["height"] - t["y"]) / t["height"]).cast("int"))
    made = F.transform(F.sequence(F.lit(0), n - 1), lambda i: rect(t["x"], t["y"] + i * t["height"], t["width"], t["height"]))
    return F.when(n > 0, made).otherwise(F.array().cast(f"array<{RECT}>"))


def overridden_rows(rows: Column, overrides: Column, area: Column) -> Column:
    """Rows with some places and heights set by hand; rows below follow the one before, and all are cut to ``area``.

    ``overrides``: array of rowIndex (from 0), y, height (doubles); of several for a row the last counts, and of one each value that
    is finite (a height from ``LEAST_ROW`` on). A row without a place of its own begins where the one before ends. Rows
    that begin below the area, or of which less than ``LEAST_ROW`` is left, go.
    """
    given = F.coalesce(overrides, F.array().cast("array<struct<rowIndex: double, y: double, height: double>>"))
    numbered = F.filter(F.transform(rows, lambda r, i: F.struct(r.alias("r"), i.alias("i"))), lambda p: p["r"].isNotNull())

    def placed(state: Column, p: Column) -> Column:
        own = F.try_element_at(F.filter(given, lambda o: o["rowIndex"] == p["i"]), F.lit(-1))
        height = F.when(finite(own["height"]) & (own["height"] >= LEAST_ROW), own["height"]).otherwise(p["r"]["height"])
        y = F.when(finite(own["y"]), own["y"]).otherwise(F.coalesce(state["next"], p["r"]["y"]))
        return F.struct(F.concat(state["out"], F.array(rect(p["r"]["x"], y, p["r"]["width"], height))).alias("out"), (y + height).alias("next"))

    empty = F.struct(F.array().cast(f"array<{RECT}>").alias("out"), F.lit(None).cast("double").alias("next"))
    cascade = F.aggregate(numbered, empty, placed, lambda state: state["out"])
    bottom = area["y"] + area["height"]

    def cut(r: Column) -> Column:
        inside, y = clamped(r, area), F.greatest(r["y"], area["y"])
        return rect(inside["x"], y, inside["width"], F.least(r["height"], bottom - y))

    return F.filter(F.transform(F.filter(cascade, lambda r: r["y"] < bottom), cut), lambda r: r["height"] >= LEAST_ROW)


def dividers(low: Column, high: Column, inner: Column, columns: Column) -> Column:
    """``columns`` + 1 edges from ``low`` to ``high``: the inner ones in order, the first if too many; the widest gap is halved until enough; evenly spread if none.

    Of gaps as wide the last is halved.
    """
    sound = F.array_sort(F.filter(F.coalesce(inner, F.array().cast("array<double>")), lambda g: finite(g) & g.between(low, high)))
    even = F.transform(F.sequence(F.lit(0), columns), lambda i: low + i * ((high - low) / F.greatest(columns, F.lit(1))))

    def halved(edges: Column, _: Column) -> Column:
        gaps = F.transform(F.sequence(F.lit(1), F.size(edges) - 1), lambda i: F.struct((F.get(edges, i) - F.get(edges, i - 1)).alias("gap"), i.alias("i")))
        at = F.array_max(gaps)["i"]
        middle = (F.get(edges, at - 1) + F.get(edges, at)) / 2
        return F.when(F.size(edges) > columns, edges).otherwise(F.concat(F.slice(edges, F.lit(1), at), F.array(middle), F.slice(edges, at + 1, F.size(edges) - at)))

    some = F.concat(F.array(low), F.slice(sound, F.lit(1), F.greatest(columns - 1, F.lit(0))), F.array(high))
    filled = F.aggregate(F.sequence(F.lit(1), F.greatest(columns, F.lit(1))), some, halved)
    return F.when(F.size(sound) > 0, filled).otherwise(even)
