"""Schema rules on a write: each violation is counted and set aside."""

import pytest

from tarnsift.operators import schema as C

RULES = (
    C.Rule("unique", ("id",)),
    C.Rule("unique", ("a.b", "kind")),
    C.Rule("required", ("id", "name")),
    C.Rule("type", ("size",), "int"),
    C.Rule("values", ("kind",), ("x", "y")),
)
ROWS = [
    (1, "p", "1", "x", "n1"), (2, "q", None, "y", "n2"), (3, "r", "2.5 mm", "x", "n3"), (4, None, "4", "x", "n4"), (5, "s", "5", "z", "n5"),
    (6, "t", "6", None, "n6"), (6, "u", "7", "x", "n7"), (None, "v", "8", "x", "n8"), (None, "w", "9", "y", "n9"), (7, "a", "1", "x", "same"),
    (8, "b", "1", "x", "same"), (9, "c", "1", "y", "same"),
]
WANT = {
    3: ["type(size)"], 4: ["required(id, name)"], 5: ["values(kind)"], 6: ["unique(id)"], None: ["required(id, name)"],
    7: ["unique(a.b, kind)"], 8: ["unique(a.b, kind)"],
}


def frame(spark, rows=ROWS):
    return spark.createDataFrame(rows, "id long, name string, size string, kind string, `a.b` string").repartition(3)


def test_each_violation_is_counted_and_set_aside(spark, tmp_path):
    path = f"{tmp_path}/t"
    counts = C.apply(frame(spark), RULES, path)
    assert counts == {
        "rows": 12, "unique(id)": 2, "unique(a.b, kind)": 2, "required(id, name)": 3, "type(size)": 1, "values(kind)": 1,
    }
    good, bad = C.accepted(spark, path), C.aside(spark, path)
    assert sorted(r.id for r in good.collect()) == [1, 2, 9] and good.columns == frame(spark).columns
    assert sorted((str(r.id), *r.violations) for r in bad.collect()) == sorted((str(r[0]), *WANT[r[0]]) for r in ROWS if r[0] in WANT)
    assert dict(C.report(frame(spark), RULES).collect()) == {k: v for k, v in counts.items() if k != "rows"}


def test_without_rows_or_rules(spark, tmp_path):
    assert C.apply(frame(spark, []), RULES, f"{tmp_path}/a") == {"rows": 0} | {r.name: 0 for r in RULES}
    assert C.apply(frame(spark), (), f"{tmp_path}/b") == {"rows": 12} and C.accepted(spark, f"{tmp_path}/b").count() == 12
    with pytest.raises(ValueError):
        C.report(frame(spark), [C.Rule("odd", ("id",))])


def test_a_report_joins_no_counts_back(spark):
    """Only rows of one count meet (F14)."""
    plan = C.report(frame(spark), RULES)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftOuter" not in plan and plan.count("Join") == 2
    assert {r.n for r in C.report(frame(spark, []), RULES).collect()} == {0}
