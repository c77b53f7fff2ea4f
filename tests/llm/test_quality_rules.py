import pytest

from tarnsift.llm import quality_rules as Q
from tests.llm.cases import awkward, docs, empty, words


def brute(text):
    t, ws = text or "", words(text)
    lines = [x for x in t.split("\n") if words(x)]
    seen = {}
    for i in range(len(ws) - 4):
        seen.setdefault(tuple(ws[i : i + 5]), []).append(i)
    covered = {p for at in seen.values() if len(at) > 1 for i in at for p in range(i, i + 5)}
    n, rep = len(ws), len(covered)
    return (
        n, sum(map(len, ws)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), rep, n < 10 or 100 * rep > 20 * n,
    )


def test_equals_brute_force(spark):
    cols = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    got = {r.doc_id: tuple(r[c] for c in cols) for r in Q.op2(docs(spark)).collect()}
    assert got == {i: brute(t) for i, t, *_ in awkward()}


def test_empty_table(spark):
    assert Q.op2(empty(spark)).count() == 0


def test_extra_and_clashing_columns(spark):
    df = docs(spark).selectExpr("*", "'x' AS n_words", "1 AS `odd name`", "true AS kept")
    out = Q.apply_rules(df)
    assert "odd name" in out.columns and out.columns.count("n_words") == 1
    assert out.where("n_words = 0").count() == 3


def test_a_filter_on_the_verdict_stays_above(spark):
    plan = Q.apply_rules(docs(spark)).where("kept")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate inline" in plan and plan.index("Filter") < plan.index("Generate inline")


@pytest.mark.parametrize(
    ("text", "kept"),
    [
        ("the cat and a dog went to the shop in town for some milk", True),
        ("a### b$$$ c%%% d&&& e### f$$$ g%%% h&&& the### of$$$ and%%%", False),
        ("BUY IT NOW!! THE BEST!! OF ALL!! IT IS HERE!! COME TO IT!!", False),
        ("too few words", False),
    ],
)
def test_verdicts(spark, text, kept):
    df = docs(spark, [(1, text, "en", "s", 1)])
    assert Q.op2(df).first().kept is kept


def test_repeated_rows_are_judged_one_by_one(spark):
    row = (1, "a b c d e f g h i j k", "en", "s", 1)
    assert [r.n_words for r in Q.op2(docs(spark, [row, row])).collect()] == [11, 11]
