"""Fill-in-middle against a plain rebuilding of every row."""

import hashlib
import re

from pyspark.sql import functions as F

from tarnsift.llm import fill_middle
from tests.llm.cases import awkward, docs, empty, prose

SENTINELS = ("<P>", "<S>", "<M>")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def brute(doc_id, text):
    t = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", t)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if t == "" or any(x in t for x in SENTINELS) or h3 % 100 >= 100:
        return (doc_id, n, "plain", None, None, sha(t), sha(t))
    form = "spm" if h4 % 100 < 50 else "psm"
    out = f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"
    return (doc_id, n, form, len(p), len(m), sha(out), sha(t))


def more():
    lines = ["\n".join(prose(70 + k, 6) for _ in range(k % 7)) + "\n" * (k % 3) for k in range(60)]
    odd = ["a <P> b", "x<S>", "<M>", "ends with <\nS>\n<P\n>", "<\n<\n<", "\n", "\n\n", "a\r\nb\x85c d\n", "😀\n日\n本", "y" * 300_000, "q\n" * 50_000]
    return [(1000 + k, t, "en", "s", 0) for k, t in enumerate(lines + odd)] + [(None, "no\nid\n", None, None, None), (1000, "same id\nas another", None, None, None)] * 2


def test_rows_are_those_of_a_plain_rebuilding(spark):
    rows = awkward() + more()
    got = sorted(map(tuple, fill_middle.op12(docs(spark, rows)).collect()), key=str)
    assert got == sorted((brute(i, t) for i, t, *_ in rows), key=str)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    assert fill_middle.op12(empty(spark)).count() == 0


def test_outputs_restore_and_columns_pass(spark):
    d = docs(spark, more()).withColumn("output", F.lit(1)).withColumn("form", F.lit(2)).withColumn("a.b", F.lit(3))
    got = fill_middle.arrange(d).withColumn("back", fill_middle.restore())
    assert got.columns.count("output") == 1 and got.where("back = text").count() == d.count() and "a.b" in got.columns
    rate = fill_middle.arrange(docs(spark, more()), rate=0)
    assert rate.where("form <> 'plain' or output <> text").count() == 0


def test_no_python_and_no_shuffle(spark):
    plan = fill_middle.op12(docs(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Aggregate" not in plan and "Join" not in plan
