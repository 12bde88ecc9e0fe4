"""Differences of runs by hand: texts of changes, types that one run lacks, null arrays, empty runs."""

from lineweave.operators import snapshots

SCHEMA = "filename string, doc_type string, status string, source string, row_status string, actual_rows int, missing array<string>, warnings array<string>"


def run(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def test_changes(spark):
    before = run(
        spark,
        ("a", "card", "rejected", "x", "short", 2, ["biz", "total"], None),
        ("b", "card", "selected", "x", "exact", 3, None, ["shift"]),
        ("c", "pos", "selected", "x", "exact", 1, [], []),
        ("d", "pos", None, "x", None, None, ["biz"], []),
        ("e", "bank", "selected", "x", "over", 5, [], []),
    )
    after = run(
        spark,
        ("a", "card", "selected", "x", "exact", 4, ["biz"], None),
        ("b", "pos", "selected", "y", "over", 3, ["total"], []),
        ("c", "pos", "rejected", "x", "exact", 1, [], []),
        ("d", "pos", None, "x", None, 1, [], ["blank"]),
        ("f", None, "selected", "x", "exact", 5, ["biz"], []),
    )
    got = {r.filename: r for r in snapshots.sample_changes(before, after).collect()}
    assert {k: r.verdict for k, r in got.items()} == {"a": "improved", "b": "regressed", "c": "regressed", "d": "improved", "e": "removed", "f": "new"}
    assert got["a"].improvements == ["rowCount: short → exact", "missing: 2 → 1", "status: rejected → selected"] and got["a"].regressions == []
    assert got["b"].regressions == ["rowCount: exact → over", "missing: 0 → 1"] and (got["b"].doc_type_changed, got["b"].source_changed, got["b"].status_changed) == (True, True, False)
    assert got["c"].regressions == ["status: selected → rejected"]
    assert (got["d"].rows_delta, got["d"].missing_delta, got["d"].warning_delta, got["d"].row_status_changed) == (1, -1, 1, False)
    assert got["e"].improvements == [] and got["e"].rows_delta is None and got["f"].status_changed is None
    fields = {(r.doc_type, r.name): (r.before, r.after, r.delta) for r in snapshots.name_changes(before, after, "missing").collect()}
    assert fields == {("card", "total"): (1, 0, -1), ("pos", "biz"): (1, 0, -1), ("pos", "total"): (0, 1, 1), ("", "biz"): (0, 1, 1)}
    types = {r.doc_type: r for r in snapshots.type_changes(before, after).collect()}
    assert {k: (r.row_exact_delta, r.missing_delta, r.verdict) for k, r in types.items()} == {"card": (0, -1, "improved"), "pos": (0, 0, "unchanged"), "bank": (0, 0, "unchanged"), "": (1, 1, "improved")}
    assert (types["card"].before_total, types["card"].after_total, types["card"].warned_delta, types["bank"].row_over_delta) == (2, 1, -1, -1)


def test_empty_runs(spark):
    none = run(spark)
    for f in (snapshots.sample_changes, snapshots.type_changes):
        assert f(none, none).count() == 0
    assert snapshots.name_changes(none, none, "warnings").count() == 0
